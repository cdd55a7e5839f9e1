"""Groups of texts by the Jaccard similarity of their word shingles: how operator 4 verifies and completes what fingerprints propose.

1. A scan counts all shingles in a table of bins of fixed size; a second one makes each text's set of shingles and its SimHash
   fingerprint. Equal sets are one row from here on.
2. Fingerprints within the radius, which vantage-point trees find, propose pairs.
3. Two sets of similarity t share one of the first n - ceil(t * n) + 1 of their shingles in the order of rarity (prefix filter).
   These are dealt out; where sets meet at a shingle, each is paired with its next NEXT in the order of length, if lengths and places allow t.
4. All pairs are verified in integers, on sets that a third scan makes for the texts in question. Links give components.
5. Shingles at which more than NEXT + 1 sets meet are looked at again, with the components: pairs of different components
   that 512-bit parity vectors allow are verified too. Pairs within a component can't change it, so a dense group makes no square.

The components are those of all pairs of similarity t or more.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import bounded_batches, discard, key_filter, maybe_in, stored
from ._text import LOWER, SPACE_WORD, SpanHash, blocks, column_bytes, mix, ranges, word_bounds, word_hashes
from .components import connected_components
from .line_dedup import _PART, _RANK_BITS, RARITY_BITS, _bin, _by_part, _meeting, _name, _packed_counts, _summed_counts, _unpack, _wide_parity
from .vantage import fingerprints, near_links

#: Sets that each set is paired with at a shingle, before its components are known.
NEXT = 8
#: A prefix shingle of a set as it travels: its low bits, the set's key and size, and its place in the set.
_ROW = [("word", np.uint32), ("key", np.int64), ("n", np.int32), ("place", np.int32)]
_U = np.uint64


class _Sets:
    """The sets of shingles of a block's texts, each in the order of rarity; a text of fewer words is one shingle."""

    def __init__(self, d: np.ndarray, o: np.ndarray, shingle: int, rarity: np.ndarray | None) -> None:
        low = LOWER[d]
        s, e, at = word_bounds(low, o, SPACE_WORD)
        count = np.diff(at)
        many = np.where(count > 0, np.maximum(1, count - shingle + 1), 0)
        starts, owner = ranges(at[:-1], many), np.repeat(np.arange(len(count)), many)
        values = SpanHash(word_hashes(low, s, e))(starts, np.minimum(starts + shingle, at[1:][owner]))
        rank = np.zeros(len(values), _U) if rarity is None else rarity[_bin(values)]
        order = np.lexsort((values, rank, owner))
        values, owner = values[order], owner[order]
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        self.values = values[new]
        self.n = np.bincount(owner[new], minlength=len(count)).astype(np.int64)
        self.starts = np.cumsum(self.n) - self.n

    def keys(self) -> np.ndarray:
        """A 64-bit value of each set; zero for the empty one."""
        out, full = np.zeros(len(self.n), _U), self.n > 0
        if full.any():
            out[full] = mix(np.add.reduceat(mix(self.values ^ _U(0x5851F42D4C957F2D)), self.starts[full]))
        return out.view(np.int64)


def _count(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << RARITY_BITS, np.int64)
        for batch in batches:
            for _, _, d, o in blocks(*column_bytes(batch.column(0))):
                counts += np.bincount(_bin(_Sets(d, o, shingle, None).values), minlength=len(counts))
        yield _packed_counts(counts)

    return run


_MARKS = "id long, text_key long, key long, parity binary, fingerprint long"


def _marks(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, d, o in blocks(*column_bytes(batch.column(2))):
                sets = _Sets(d, o, shingle, None)
                parity = pa.array([x.tobytes() for x in _wide_parity(sets.values, sets.n)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], batch.column(1)[first:last], pa.array(sets.keys()), parity, pa.array(fingerprints(d, o, shingle).view(np.int64))], names=["id", "text_key", "key", "parity", "fingerprint"])

    return run


def _deal(rarity, shingle: int, p: int, q: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, dealt = rarity.value, []
        for batch in batches:
            for _, _, d, o in blocks(*column_bytes(batch.column(0))):
                sets = _Sets(d, o, shingle, table)
                key = sets.keys()
                use = np.unique(key, return_index=True)[1]
                use = use[sets.n[use] > 0]
                if not len(use):
                    continue
                prefix = sets.n[use] - -(-p * sets.n[use] // q) + 1
                at, of = ranges(sets.starts[use], prefix), np.repeat(use, prefix)
                dealt.append({"part": (sets.values[at] >> _U(64 - bits)).astype(np.int64), "word": sets.values[at].astype(np.uint32), "key": key[of], "n": sets.n[of], "place": at - sets.starts[of]})
                if sum(len(x["word"]) for x in dealt) > _PART:
                    yield _by_part(dealt, _ROW, 0)
        if dealt:
            yield _by_part(dealt, _ROW, 0)

    return run


_MET = "a long, b long, word long, n int, place int"


def _allowed(a: np.ndarray, b: np.ndarray, n: np.ndarray, place: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs lengths and places allow, if their first common shingle is this one; and the shingles they need."""
    need = -(-p * (n[a] + n[b]) // (p + q))
    return (place[a] <= n[a] - need) & (place[b] <= n[b] - need), need


def _meet(p: int, q: int, most: int):
    """Pairs (a, b) of sets that meet at a shingle, and (b null) the rows of shingles at which not all pairs were looked at."""

    def run(key_: tuple, table: pa.Table) -> pa.Table:
        rows = _unpack(table["rows"].to_pylist(), _ROW)
        order = np.lexsort((rows["place"], rows["key"], rows["n"], rows["word"]))
        rows = {name: v[order] for name, v in rows.items()}
        word, key = rows["word"], rows["key"]
        new = np.ones(len(word), bool)
        new[1:] = (word[1:] != word[:-1]) | (key[1:] != key[:-1])
        word, key, n, place = word[new], key[new], rows["n"][new].astype(np.int64), rows["place"][new].astype(np.int64)
        found = [(np.empty(0, np.int64),) * 2]
        for k in range(1, most + 1):
            a = np.flatnonzero(word[k:] == word[:-k])
            b = a + k
            ok, _ = _allowed(a, b, n, place, p, q)
            found.append((key[a[ok]], key[b[ok]]))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        group = np.cumsum(np.append(0, word[1:] != word[:-1]))
        cut = np.flatnonzero(np.bincount(group)[group] > most + 1)
        name = _name(np.full(len(cut), key_[0].as_py() // 4), word[cut])
        none = lambda t, k: pa.nulls(k, t)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        columns = [pa.array(np.concatenate([pairs[:, 0], key[cut]])), pa.chunked_array([pa.array(pairs[:, 1], pa.int64()), none(kinds[1], len(cut))])]
        columns += [pa.chunked_array([none(t, len(pairs)), pa.array(x, t)]) for t, x in zip(kinds[2:], (name, n[cut], place[cut]), strict=True)]
        return pa.table(columns, names=["a", "b", "word", "n", "place"])

    return run


def _meet_again(p: int, q: int):
    """Pairs (a, b) of one shingle's sets that are of different components and that parity vectors allow."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("n")
        key, root, n, place = (table[x].to_numpy().astype(np.int64) for x in ("key", "root", "n", "place"))
        parity = np.frombuffer(b"".join(table["parity"].to_pylist()), np.uint64).reshape(-1, 8)
        found = [(np.empty(0, np.int64),) * 2]
        for a, b in _meeting(np.arange(len(n)), np.zeros(len(n), np.int64), n, p, q):
            ok = root[a] != root[b]
            a, b = a[ok], b[ok]
            ok, need = _allowed(a, b, n, place, p, q)
            a, b, need = a[ok], b[ok], need[ok]
            apart = np.zeros(len(a), np.int64)
            for k in range(8):
                apart += np.bitwise_count(parity[a, k] ^ parity[b, k])
            ok = apart <= n[a] + n[b] - 2 * need
            found.append((key[a[ok]], key[b[ok]]))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def _shingles(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, d, o in blocks(*column_bytes(batch.column(0))):
                sets = _Sets(d, o, shingle, None)
                lists = pa.array([sets.values[a : a + k].tobytes() for a, k in zip(sets.starts.tolist(), sets.n.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(sets.keys()), lists], names=["key", "shingles"])

    return run


def _similar(p: int, q: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append((p + q) * common >= p * (len(x) + len(y)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def similar_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = 2) -> DataFrame:
    """Rows (id, text_key, root): root is the same for the texts that pairs of `similarity` or more connect.

    A text is the set of its shingles of `shingle` words `[^\\x20\\x09-\\x0D]+`, A-Z counting as a-z (a text with fewer words is one
    shingle); similarity is Jaccard's. Sets are told apart by 64-bit values, as are shingles. Null and empty texts and texts
    without words have one set, the empty one; null ids are ids like others; repeated rows are repeated in the result; an
    empty table gives an empty one. A text is held whole in one task.
    """
    t = Fraction(str(similarity))
    if not 0 < t <= 1:
        raise ValueError("similarity must be over 0 and at most 1")
    p, q = t.numerator, t.denominator
    spark = documents.sparkSession
    bounded_batches(spark)
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    texts = docs.select("text")
    counts = _summed_counts(texts.mapInArrow(_count(shingle), "chunk int, counts binary"))
    rarity = spark.sparkContext.broadcast((counts.astype(np.float32).view(np.uint32) >> np.uint32(32 - 1 - _RANK_BITS)).astype(_U))
    bits = max(4, int(int(counts.sum()) * (q - p + 1) // (q * _PART)).bit_length())
    marks = stored(docs.mapInArrow(_marks(shingle), _MARKS))
    sets = stored(marks.groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key", "parity", "fingerprint")).alias("x")).select("key", "x.id", "x.text_key", "x.parity", "x.fingerprint"))
    met = stored(texts.mapInArrow(_deal(rarity, shingle, p, q, bits), "part long, rows binary, words binary").groupBy("part").applyInArrow(_meet(p, q, NEXT), _MET))

    def verified(pairs: DataFrame) -> DataFrame:
        keys = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
        wanted = stored(sets.join(keys, "key", "left_semi").select(F.coalesce("id", F.lit(0)).alias("id"), "text_key"))
        chosen = maybe_in(docs.withColumn("id", F.coalesce("id", F.lit(0))), key_filter(wanted, "id", "text_key"), "id", "text_key").where("__maybe")
        known = stored(chosen.select("text").mapInArrow(_shingles(shingle), "key long, shingles binary").dropDuplicates(["key"]))
        x, y = known.select(F.col("key").alias("a"), F.col("shingles").alias("x")), known.select(F.col("key").alias("b"), F.col("shingles").alias("y"))
        return stored(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_similar(p, q), "a long, b long"))

    # of a fingerprint's sets the least stands for all, and of a link's fingerprints their sets
    prints = stored(sets.groupBy("fingerprint").agg(F.min("key").alias("first")))
    ends = [prints.select(F.col("fingerprint").alias(x), F.col("first").alias(f"key_{x}")) for x in "ab"]
    close = near_links(prints.select(F.col("fingerprint").alias("value")), radius).join(ends[0], "a").join(ends[1], "b").select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))
    close = close.union(sets.select("key", "fingerprint").join(prints, "fingerprint").where("key <> first").select("first", "key")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = stored(met.where("b IS NOT NULL").select("a", "b").union(close).distinct())
    links = verified(pairs)
    roots = connected_components(links)
    hot = met.where("b IS NULL").select("word", F.col("a").alias("key"), "n", "place").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    hot = stored(hot)
    discard(met, prints)
    several = hot.groupBy("word").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("word")
    again = hot.join(several, "word", "left_semi").join(sets.select("key", "parity"), "key").groupBy("word").applyInArrow(_meet_again(p, q), "a long, b long")
    more = stored(again.distinct().join(pairs, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        roots = connected_components(links.union(verified(more)))
    discard(pairs, links, hot, more, sets)
    return marks.join(roots.withColumnRenamed("node", "key"), "key", "left").select("id", "text_key", F.coalesce("root", "key").alias("root"))
