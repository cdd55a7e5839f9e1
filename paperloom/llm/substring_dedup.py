"""Operator 1: removal of long word passages that repeat across documents, by De Bruijn compaction.

Every window of `window` consecutive words is an edge of the De Bruijn graph whose nodes are the
overlaps of window - 1 words. The graph is never written edge by edge:

1. In one scan, edges that follow one another in a document and share the same minimizer (the least
   value of their `anchor`-word k-mers) are compacted to one path piece. Equal windows have equal
   minimizers, so all copies of an edge meet under one anchor. A piece is a row of five numbers, about
   one for every twenty words.
2. Anchors that one document alone has are dropped (an aggregate and a join on the anchor).
3. Pieces with the same words in an earlier document are nonbranching there and are repeated whole:
   a join with the first source coordinates of each piece settles them without looking at their edges.
4. At an anchor where different pieces meet the path branches. Only there, and only for the first copy
   of each piece, the piece is opened into its edges, which are joined with their first source.
5. Spans of a document whose source coordinates continue one another are merged to one span.
6. Values of 64 bits named the pieces; the spans' words are now compared with those at the source coordinates, by their BLAKE2
   digests of 256 bits. Only what agrees is removed.

A hot anchor, piece or edge is aggregated before it is shuffled. The aggregates are stored, so that its
occurrences meet the one row of it in plain joins of two exchanges, which AQE can split. Nothing is collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import bounded_batches, discard, key_filter, maybe_in, stored
from ._text import SPACE_WORD, SpanHash, blocks, column_bytes, ranges, sliding_min, spaced, word_bounds, word_hashes

_PIECES = "anchor long, piece long, id long, text_key long, start int, edges int"


def _cut(words: np.ndarray, documents: np.ndarray, window: int, anchor: int):
    """First words, numbers of edges, documents and anchors of the pieces of a block."""
    spans, n = SpanHash(words), len(words)
    kmers = np.arange(n - anchor + 1)
    least = sliding_min(spans(kmers, kmers + anchor), window - anchor + 1)
    owner = np.repeat(np.arange(len(documents) - 1), np.diff(documents))[: len(least)]
    whole = documents[1:][owner] >= np.arange(len(least)) + window
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | ~whole[:-1]
    starts = np.flatnonzero(new & whole)
    bounds = np.append(np.flatnonzero(new | ~whole), len(least))
    edges = bounds[np.searchsorted(bounds, starts, "right")] - starts
    return starts, edges, owner[starts], least[starts]


def _pieces(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(2))
            ids, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            for first, _, d, o in blocks(data, offsets):
                s, e, documents = word_bounds(d, o, SPACE_WORD)
                if len(s) < window:
                    continue
                starts, edges, owner, least = _cut(word_hashes(d, s, e), documents, window, anchor)
                text, first_byte, last_byte = spaced(d, s, e, SPACE_WORD)
                text, digest = memoryview(text), xxhash.xxh3_64_intdigest
                value = np.array([digest(text[a:b]) for a, b in zip(first_byte[starts].tolist(), last_byte[starts + edges + window - 2].tolist(), strict=True)], np.uint64)
                columns = [least.view(np.int64), value.view(np.int64), ids[first + owner].astype(np.int64), keys[first + owner], (starts - documents[owner]).astype(np.int32), edges.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "piece", "id", "text_key", "start", "edges"])

    return run


def _edges(window: int, anchor: int):
    """Opens the listed pieces of each text: a row for each of their edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(2))
            ids, keys, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(), batch.column(3)
            bounds, items = lists.offsets.to_numpy(), lists.values
            at, count = items.field("start").to_numpy(), items.field("edges").to_numpy()
            for first, last, d, o in blocks(data, offsets):
                s, e, documents = word_bounds(d, o, SPACE_WORD)
                spans = SpanHash(word_hashes(d, s, e))
                rows = slice(bounds[first], bounds[last])
                owner = np.repeat(np.arange(last - first), np.diff(bounds[first : last + 1]))
                starts, edges = documents[owner] + at[rows], count[rows].astype(np.int64)
                # the anchor again, as the piece's first edge has it
                inner = np.repeat(starts, window - anchor + 1) + np.tile(np.arange(window - anchor + 1), len(starts))
                least = spans(inner, inner + anchor).reshape(len(starts), -1).min(axis=1) if len(starts) else np.empty(0, np.uint64)
                each, of = ranges(starts, edges), np.repeat(np.arange(len(starts)), edges)
                columns = [least[of].view(np.int64), spans(each, each + window).view(np.int64), ids[first + owner[of]].astype(np.int64), keys[first + owner[of]], (each - documents[owner[of]]).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "edge", "id", "text_key", "start"])

    return run


_SPAN = "start int, end int, source_id long, source_key long, source_start int"


def _merged(window: int):
    """A row for each span of a text, its pieces merged where their sources continue one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = []
            for id_, key, pieces in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                last = None
                for x in sorted(pieces, key=lambda x: (x["source_id"], x["source_key"], x["source_start"] - x["start"], x["start"])):
                    at, end, source = x["start"], x["start"] + x["edges"] + window - 1, (x["source_id"], x["source_key"], x["source_start"] - x["start"])
                    if last and source == last[1] and at <= last[0][3]:
                        last[0][3] = max(last[0][3], end)
                    else:
                        last = [id_, key, at, end, x["source_id"], x["source_key"], x["source_start"]], source
                        out.append(last[0])
            columns = list(zip(*out, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["id", "text_key", *[x.split()[0] for x in _SPAN.split(", ")]])

    return run


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=32).digest()


def _source_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digests of the words at the places that are asked for."""
    for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
        out = []
        for id_, key, text, asked in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
            words = (text or "").encode().split()
            out += [(id_, key, x["start"], x["n"], _digest(words[x["start"] : x["start"] + x["n"]])) for x in asked]
        columns = list(zip(*out, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["source_id", "source_key", "source_start", "n", "digest"])


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removes the words of the spans that are those of their sources."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("source_id", pa.int64()), ("source_start", pa.int32())]))
    for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
        n_words, n_removed, kept, verified = [], [], [], []
        for text, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            words = (text or "").encode().split()
            gone, out = np.zeros(len(words), bool), []
            for x in sorted(spans or (), key=lambda x: (x["start"], x["source_id"], x["source_start"])):
                if _digest(words[x["start"] : x["end"]]) == x["digest"]:
                    gone[x["start"] : x["end"]] = True
                    out.append({name: x[name] for name in ("start", "end", "source_id", "source_start")})
            n_words.append(len(words))
            n_removed.append(int(gone.sum()))
            kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if out else words).decode())
            verified.append(out)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(verified, kind)], names=["id", "n_words", "n_removed", "kept_text", "spans"])


def repeated_pieces(docs: DataFrame, window: int, anchor: int) -> tuple[DataFrame, list[DataFrame]]:
    """Rows (id, text_key, start, edges, source_id, source_key, source_start): edges that start in a document with a smaller id;
    and the tables that they are read from."""
    rows = docs.where("id IS NOT NULL")
    source = [F.col(f"source.{c}").alias(f"source_{n}") for c, n in (("id", "id"), ("text_key", "key"), ("start", "start"))]
    pieces = stored(rows.mapInArrow(_pieces(window, anchor), _PIECES))
    anchors = stored(pieces.groupBy("anchor").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), (F.min("piece") != F.max("piece")).alias("branches")).where("first_id < last_id").select("anchor", "branches"))
    shared = stored(pieces.join(anchors, "anchor"))
    discard(pieces, anchors)
    first = stored(shared.groupBy("anchor", "piece").agg(F.min(F.struct("id", "text_key", "start")).alias("source")))
    placed = shared.join(first, ["anchor", "piece"])
    whole = placed.where("id > source.id").select("id", "text_key", "start", "edges", *source)
    opened = stored(placed.where("branches AND id = source.id").groupBy("id", "text_key").agg(F.collect_list(F.struct("start", "edges")).alias("pieces")))
    wanted = maybe_in(rows, key_filter(opened, "id", "text_key"), "id", "text_key").where("__maybe").drop("__maybe")
    edges = stored(wanted.join(opened, ["id", "text_key"]).select("id", "text_key", "text", "pieces").mapInArrow(_edges(window, anchor), "anchor long, edge long, id long, text_key long, start int"))
    sources = stored(edges.groupBy("anchor", "edge").agg(F.min(F.struct("id", "text_key", "start")).alias("source"), F.max("id").alias("last_id")).where("source.id < last_id"))
    single = edges.join(sources, ["anchor", "edge"]).where("id > source.id").select("id", "text_key", "start", F.lit(1).alias("edges"), *source)
    return whole.unionByName(single), [shared, first, opened, edges, sources]


def verified_spans(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(id, text_key, spans): the merged spans of each text that has any, with the digests of the words at their sources."""
    rows, tables = repeated_pieces(docs, window, anchor)
    pieces = rows.groupBy("id", "text_key").agg(F.collect_list(F.struct("start", "edges", "source_id", "source_key", "source_start")).alias("pieces"))
    spans = stored(pieces.mapInArrow(_merged(window), "id long, text_key long, " + _SPAN))
    discard(*tables)
    asked = stored(spans.groupBy(F.col("source_id").alias("id"), F.col("source_key").alias("text_key")).agg(F.collect_set(F.struct(F.col("source_start").alias("start"), (F.col("end") - F.col("start")).alias("n"))).alias("asked")))
    texts = maybe_in(docs, key_filter(asked, "id", "text_key"), "id", "text_key").where("__maybe").join(asked, ["id", "text_key"])
    digests = texts.select("id", "text_key", "text", "asked").mapInArrow(_source_digests, "source_id long, source_key long, source_start int, n int, digest binary")
    digests = stored(digests.groupBy("source_id", "source_key", "source_start", "n").agg(F.min("digest").alias("digest")))
    both = spans.withColumn("n", F.col("end") - F.col("start")).join(digests, ["source_id", "source_key", "source_start", "n"])
    found = stored(both.groupBy("id", "text_key").agg(F.collect_list(F.struct("start", "end", "source_id", "source_start", "digest")).alias("spans")))
    discard(spans, asked, digests)
    return found


def substring_dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, anchor: int = 12) -> DataFrame:
    """Documents without the words of passages that a document with a smaller id also has.

    A word `[^\\x20\\x09-\\x0D]+` goes if a window of `window` words that covers it also starts in a document with a
    smaller id, judged on the input. Returns id, n_words, n_removed, kept_text (kept words joined by one space) and spans
    (start, end, source_id, source_start; merged while the source runs on).

    A null text has no words; texts shorter than the window are kept; rows without an id take part in no comparison and
    keep all their words; rows that repeat an id are judged one by one, and rows with the same id are no source for each
    other; other columns, whatever their names, are ignored; an empty table gives an empty result. A text is held whole in one
    task. Ids are whole numbers, or text of such; any other id ends the job with Spark's CAST_INVALID_INPUT.
    """
    if not 0 < anchor <= window:
        raise ValueError("anchor must be from 1 to window")
    bounded_batches(documents.sparkSession)
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    found = verified_spans(docs, window, anchor)
    marked = maybe_in(docs, key_filter(found, "id", "text_key"), "id", "text_key")
    out = "id long, n_words long, n_removed long, kept_text string, spans array<struct<start:int,end:int,source_id:long,source_start:int>>"
    columns = ["id", "text_key", "text", "spans"]
    touched = marked.where("__maybe").join(found, ["id", "text_key"], "left").select(*columns)
    others = marked.where("NOT __maybe").withColumn("spans", F.lit(None).cast(found.schema["spans"].dataType)).select(*columns)
    return touched.unionByName(others).mapInArrow(_keep, out).withColumnRenamed("id", id_col)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    done = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
