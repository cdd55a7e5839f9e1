"""Operator 7: secret scans with corpus-wide ownership frequency.

One scan of the whole texts finds candidates of three kinds (assignments, access keys, hex strings). The value of every
candidate is hashed, and the distinct repositories and owners of each hash are counted over the whole corpus, in two
aggregation steps so that a value copied everywhere is a few rows per owner before it meets. A value of one owner that looks
live (long, mixed and of high entropy) is added as `live`, a value that several owners have as `shared`: a widely copied
example. The candidates themselves always stay.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import bounded_batches, stored
from ._text import column_bytes

KINDS = ("assign", "access", "hex")
# The patterns of the three kinds, and the least length of what each must have.
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
_HINTS = (b"passw", b"secret", b"token", b"api")
_IS_HEX = np.zeros(256, bool)
_IS_HEX[[*range(0x30, 0x3A), *range(0x61, 0x67)]] = True


def _hex_runs(data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Maximal runs of 16 or more hex digits in each document, as byte bounds inside it."""
    inside = _IS_HEX[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (np.append(True, ~inside[:-1]) | edge[:-1]))
    ends = np.flatnonzero(inside & (np.append(~inside[1:], True) | edge[1:])) + 1
    long = ends - starts >= LEAST["hex"]
    out: dict[int, list[tuple[int, int]]] = {}
    for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
        k = int(np.searchsorted(offsets, a, "right")) - 1
        out.setdefault(k, []).append((a - int(offsets[k]), b - int(offsets[k])))
    return out


def candidates(text: bytes, hex_runs: list[tuple[int, int]]) -> list[tuple[str, int, int, int, int, bytes]]:
    """(kind, start, end, value start, value end, value) of a UTF-8 text, in code points, by start and kind."""
    found = []
    low = text.lower()
    if any(x in low for x in _HINTS):
        found += [("assign", *m.span(), *m.span(1)) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST["assign"]]
    if b"AKIA" in text:
        found += [("access", *m.span(), *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [("hex", a, b, a, b) for a, b in hex_runs]
    values = [text[c:d] for _, _, _, c, d in found]
    if found and not text.isascii():
        points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)]).tolist()
        found = [(kind, *(points[x] for x in own)) for kind, *own in found]
    rows = [(*x, v) for x, v in zip(found, values, strict=True)]
    return sorted(rows, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def looks_live(value: bytes) -> bool:
    """Long, of many different characters, and not of one sort only."""
    counts, n = Counter(value), len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    return n >= 12 and entropy >= 2.5 and any(0x30 <= c <= 0x39 for c in value) and any(c > 0x39 for c in value)


_FOUND = "id long, row long, found array<struct<kind:string,start:int,end:int,value_start:int,value_end:int,hash:long,live:boolean>>"


def _finder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind_ = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value_start", pa.int32()), ("value_end", pa.int32()), ("hash", pa.int64()), ("live", pa.bool_())]))
    for batch in batches:
        data, offsets = column_bytes(batch.column(batch.num_columns - 1))
        raw, runs, rows = data.tobytes(), _hex_runs(data, offsets), []
        at = offsets.tolist()
        for k in range(batch.num_rows):
            text, own = raw[at[k] : at[k + 1]], []
            for kind, a, b, c, d, value in candidates(text, runs.get(k, [])):
                number = xxhash.xxh64_intdigest(value, 7)
                own.append({"kind": kind, "start": a, "end": b, "value_start": c, "value_end": d, "hash": number - (1 << 64) if number >> 63 else number, "live": looks_live(value)})
            rows.append(own)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, kind_)], names=[*batch.schema.names[:-1], "found"])


def scan_secrets(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository=None, owner=None, shared_owners: int = 2) -> DataFrame:
    """Rows (id, found, extra): the candidates of each text, and the spans that ownership frequency adds.

    found: kind, start, end (code points, end exclusive), value_start, value_end, hash (XXH64 of the value), live (looks so),
    by start and kind. extra: kind `live` or `shared`, start, end (of the value), repositories, owners. repository and owner are
    columns (by default `source` and language, and `source`); null counts as a value of its own.

    Null and empty texts have no candidates; a row without an id is scanned like any other; repeated rows are repeated in the
    result; candidates that begin at the same place come in the order of their kinds; other columns, whatever their names, are
    ignored; an empty table gives an empty result. A text is held whole in one task. Ids are whole numbers, or text of such;
    any other id ends the job with Spark's CAST_INVALID_INPUT.
    """
    bounded_batches(documents.sparkSession)
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))) if repository is None else repository
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.coalesce(repository.cast("string"), F.lit("")).alias("repository"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    kind = "id long, repository string, owner string, row long, " + _FOUND.partition("row long, ")[2]
    scanned = stored(rows.mapInArrow(_finder, kind))
    each = scanned.where(F.size("found") > 0).select("row", "repository", "owner", F.explode("found").alias("x")).select("row", "repository", "owner", "x.*")
    each = each.select("row", "repository", "owner", "value_start", "value_end", "hash", "live").distinct()
    by_owner = each.groupBy("hash", "owner", "repository").agg(F.lit(1)).groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    counts = stored(by_owner.groupBy("hash").agg(F.sum("repositories").alias("repositories"), F.count("*").alias("owners")))
    judged = each.join(counts, "hash").where((F.col("owners") >= shared_owners) | F.col("live"))
    verdict = F.when(F.col("owners") >= shared_owners, F.lit("shared")).otherwise(F.lit("live"))
    extra = judged.groupBy("row").agg(F.sort_array(F.collect_set(F.struct(F.col("value_start").alias("start"), F.col("value_end").alias("end"), verdict.alias("kind"), "repositories", "owners"))).alias("extra"))
    return scanned.select("id", "row", "found").join(extra, "row", "left").drop("row")


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    done = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    written = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.array_join(F.transform("found", written), ",")
    order = lambda x: F.struct(x["start"].alias("start"), F.array_position(F.array(*map(F.lit, (*KINDS, "live", "shared"))), x["kind"]).alias("order"), x["end"].alias("end"), x["kind"].alias("kind"))
    both = F.array_sort(F.concat(F.transform("found", order), F.coalesce(F.transform("extra", order), F.array().cast("array<struct<start:int,order:bigint,end:int,kind:string>>"))))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return done.select(F.col("id").alias("doc_id"), *map(count, KINDS), F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform(both, written), ",").alias("spans"))
