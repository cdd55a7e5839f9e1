"""Operator 2: benchmark decontamination with an FM-index per shard of documents.

The phrases are the small side: their windows are compiled once and sent to every task, in blocks of bounded
size. Each task indexes its own documents shard by shard and searches all windows in the index:

* words outside the phrases' vocabulary cannot be part of an occurrence, so a shard's text is the sequence of
  runs of vocabulary words (runs shorter than every window are left out), each closed by a separator;
* suffix order by prefix doubling, Burrows-Wheeler transform, wavelet matrix with rank tables;
* backward search of all windows at once: one rank query per symbol and bound;
* suffix positions are sampled (every 16th and every run's first); the others are found by walking back;
* occurrences are merged to removal spans per document.

No document is shuffled. Every document costs time in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import beside, bounded_batches, discard, numbered, renamed, stored
from ._text import ALNUM_WORD, LOWER, blocks, column_bytes, ranges, word_bounds, word_hashes

#: Most characters of phrases that one compiled block holds (and a broadcast carries); more phrases make more passes.
PHRASE_BLOCK = 8_000_000
#: Symbols of a shard's index; one run is never divided.
SHARD_SYMBOLS = 1 << 18
_SAMPLE = 16
_VOCABULARY_BITS = 20

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    ]
)


class Phrases:
    """Windows of the phrases as symbol sequences over their own vocabulary."""

    def __init__(self, items: list[tuple[str | None, str]], window: int) -> None:
        data, offsets = column_bytes(pa.array([text for _, text in items], pa.large_string()))
        data = LOWER[data]
        starts, ends, documents = word_bounds(data, offsets, ALNUM_WORD)
        hashes = word_hashes(data, starts, ends)
        self.vocabulary = np.unique(hashes)
        self.maybe = np.zeros(1 << _VOCABULARY_BITS, bool)
        self.maybe[(self.vocabulary >> np.uint64(64 - _VOCABULARY_BITS)).astype(np.int64)] = True
        symbols = np.searchsorted(self.vocabulary, hashes).astype(np.int32) + 1
        owners: dict[tuple[int, ...], set[int]] = {}
        for k in range(len(items)):
            own = symbols[documents[k] : documents[k + 1]].tolist()
            for p in range(max(1, len(own) - window + 1) if own else 0):
                owners.setdefault(tuple(own[p : p + window]), set()).add(k)
        self.ids = [i for i, _ in items]
        self.lengths = np.array([len(w) for w in owners], np.int64)
        self.windows = np.zeros((len(owners), window), np.int32)
        for row, w in zip(self.windows, owners, strict=True):
            row[: len(w)] = w
        self.items = np.array([i for own in owners.values() for i in sorted(own)], np.int64)
        self.n_items = np.array([len(own) for own in owners.values()], np.int64)
        self.first_item = np.cumsum(self.n_items) - self.n_items
        self.shortest = int(self.lengths.min()) if len(owners) else 0

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """1, 2 ... for words of the vocabulary, 0 for all others."""
        out = np.zeros(len(hashes), np.int32)
        at = np.flatnonzero(self.maybe[(hashes >> np.uint64(64 - _VOCABULARY_BITS)).astype(np.int64)])
        found = np.searchsorted(self.vocabulary, hashes[at])
        found[found == len(self.vocabulary)] = 0
        same = self.vocabulary[found] == hashes[at]
        out[at[same]] = found[same] + 1
        return out


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffix array of a text whose symbols 0 are separators: each differs from the others, and from all symbols."""
    n, separators = len(text), text == 0
    first = text.astype(np.int64) + np.count_nonzero(separators)
    first[separators] = np.arange(np.count_nonzero(separators))
    order = np.argsort(first, kind="stable")
    key = first[order]
    rank = np.empty(n, np.int64)
    group = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(group, n))
    rank[order] = np.repeat(group, size)
    open_, step = np.repeat(size > 1, size), 1
    while open_.any():
        slots = np.flatnonzero(open_)  # these groups' places in order
        rows = order[slots]
        keys = rank[rows] * (n + 1) + rank[np.minimum(rows + step, n - 1)]
        by = np.argsort(keys, kind="stable")
        rows, keys = rows[by], keys[by]
        order[slots] = rows
        group = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        size = np.diff(np.append(group, len(keys)))
        rank[rows] = np.repeat(slots[group], size)
        open_[slots] = np.repeat(size > 1, size)
        step *= 2
    return order


class WaveletMatrix:
    """How often a symbol stands before a place, in a fixed number of steps."""

    def __init__(self, symbols: np.ndarray, top: int) -> None:
        self.levels, rest = [], symbols
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            ones = (rest >> bit) & 1
            count = np.zeros(len(rest) + 1, np.int32)
            np.cumsum(ones, out=count[1:])
            zero = ones == 0
            self.levels.append((bit, count, int(np.count_nonzero(zero))))
            rest = np.concatenate([rest[zero], rest[~zero]])
        self.base = self._down(np.arange(top + 1), np.zeros(top + 1, np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, count, zeros in self.levels:
            ones = count[at]
            at = np.where((symbols >> bit) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._down(symbols, at) - self.base[symbols]


class FMIndex:
    """Full-text index of runs of symbols 1 to top, each closed by a 0."""

    def __init__(self, text: np.ndarray, top: int) -> None:
        order = suffix_order(text)
        self.last = text[order - 1]  # order - 1 is -1 for the first suffix: a separator closes the text
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))]).astype(np.int64)
        self.tree = WaveletMatrix(self.last, top)
        sampled = (order % _SAMPLE == 0) | (self.last == 0)
        self.sampled, self.at = sampled, order[sampled]
        self.nth = np.cumsum(sampled) - 1

    def search(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The windows that occur, with the bounds of their rows."""
        alive = np.arange(len(windows))
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), len(self.last), np.int64)
        for back in range(1, windows.shape[1] + 1):
            more = lengths[alive] >= back
            rows = alive[more]
            symbols = windows[rows, lengths[rows] - back].astype(np.int64)
            low[rows] = self.before[symbols] + self.tree.rank(symbols, low[rows])
            high[rows] = self.before[symbols] + self.tree.rank(symbols, high[rows])
            alive = alive[low[alive] < high[alive]]
        return alive, low[alive], high[alive]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the index."""
        out, todo, rows, walked = np.empty(len(rows), np.int64), np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            here = self.sampled[rows]
            out[todo[here]] = self.at[self.nth[rows[here]]] + walked
            todo, rows = todo[~here], rows[~here]
            symbols = self.last[rows].astype(np.int64)
            rows = self.before[symbols] + self.tree.rank(symbols, rows)
            walked += 1
        return out


def _shards(lengths: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of groups of runs of about SHARD_SYMBOLS symbols."""
    ends, out, first = np.cumsum(lengths + 1), [], 0
    while first < len(lengths):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + SHARD_SYMBOLS, "right")))
        out.append((first, last))
        first = last
    return out


def _occurrences(phrases: Phrases, symbols: np.ndarray, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence in a batch of documents."""
    inside = symbols > 0
    edge = np.zeros(len(symbols) + 1, bool)
    edge[documents] = True
    starts = np.flatnonzero(inside & (np.append(True, ~inside[:-1]) | edge[:-1]))
    ends = np.flatnonzero(inside & (np.append(~inside[1:], True) | edge[1:])) + 1
    long = ends - starts >= max(1, phrases.shortest)
    starts, lengths = starts[long], (ends - starts)[long]
    where, which = [], []
    for first, last in _shards(lengths):
        own, n = starts[first:last], lengths[first:last]
        source = ranges(own, n + 1)  # a run's words, and one place for the separator
        text = symbols[np.minimum(source, len(symbols) - 1)].copy()
        text[np.cumsum(n + 1) - 1] = 0
        index = FMIndex(text, len(phrases.vocabulary))
        found, low, high = index.search(phrases.windows, phrases.lengths)
        where.append(source[index.locate(ranges(low, high - low))])
        which.append(np.repeat(found, high - low))
    return np.concatenate(where or [np.empty(0, np.int64)]), np.concatenate(which or [np.empty(0, np.int64)])


def _finder(phrases, n_carried: int):
    """What the phrases hit in the texts, which follow n_carried other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = phrases.value
        for batch in batches:
            data, offsets = column_bytes(batch.column(n_carried))
            symbols, counts = [], []
            for _, _, d, o in blocks(data, offsets):
                d = LOWER[d]
                s, e, documents = word_bounds(d, o, ALNUM_WORD)
                symbols.append(known.symbols(word_hashes(d, s, e)))
                counts.append(np.diff(documents))
            n_words = np.concatenate(counts or [np.empty(0, np.int64)])
            documents = np.concatenate([[0], np.cumsum(n_words)])
            where, which = _occurrences(known, np.concatenate(symbols or [np.empty(0, np.int32)]), documents)
            owner = np.searchsorted(documents, where, "right") - 1
            items = np.repeat(owner, known.n_items[which]) * len(known.ids) + known.items[ranges(known.first_item[which], known.n_items[which])]
            by_document: dict[int, set[str]] = {}
            for x in np.unique(items).tolist():
                if (name := known.ids[x % len(known.ids)]) is not None:
                    by_document.setdefault(x // len(known.ids), set()).add(name)
            hit = np.zeros(documents[-1] + 1, np.int64)
            np.add.at(hit, where, 1)
            np.subtract.at(hit, where + known.lengths[which], 1)
            hit = np.cumsum(hit[:-1]) > 0
            rows = []
            touched = np.zeros(len(n_words), bool)
            touched[owner] = True
            for k, (n, now) in enumerate(zip(n_words.tolist(), touched.tolist(), strict=True)):
                if not now:
                    rows.append({"n_words": n, "n_hit": 0, "items": [], "spans": []})
                    continue
                own = hit[documents[k] : documents[k + 1]]
                turns = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
                rows.append({"n_words": n, "n_hit": int(own.sum()), "items": sorted(by_document.get(k, ())), "spans": [{"start": a, "end": b} for a, b in turns.reshape(-1, 2).tolist()]})
            kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
            columns = [batch.column(k) for k in range(n_carried)] + [pa.array(rows, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{k}" for k in range(n_carried)] + ["__found"])

    return run


def _phrase_blocks(items: DataFrame) -> Iterator[list[tuple[str | None, str]]]:
    """The phrases in blocks of at most PHRASE_BLOCK characters (one longer phrase is a block of its own)."""
    block, size = [], 0
    for row in items.toLocalIterator():
        if block and size + len(row["text"]) > PHRASE_BLOCK:
            yield block
            block, size = [], 0
        block.append((row["id"], row["text"]))
        size += len(row["text"])
    if block:
        yield block


def find_phrases(documents: DataFrame, phrases: DataFrame, text_col: str = "text", carry: list[str] | None = None, item_col: str = "item_id", phrase_col: str = "text", window: int = 13) -> DataFrame:
    """documents' columns (or those in carry) and __found: n_words, n_hit, items (sorted strings), spans (word start, end).

    A-Z count as a-z, words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. A window is `window` consecutive words of a phrase,
    or the whole phrase if it has fewer. A document word is hit if an occurrence of a window covers it.

    Null texts and phrases have no words; a phrase without an id hits words but names no item; repeated rows count once in
    items and give as many rows in the result; no phrases: nothing is hit; no documents: no rows; a column named __found is
    returned with underscores in front, other columns as they are. A text is held whole in one task.
    """
    carry = documents.columns if carry is None else carry
    return renamed(_found(documents, phrases, text_col, carry, item_col, phrase_col, window), beside(carry, "__found"), "__found")


def _found(documents: DataFrame, phrases: DataFrame, text_col: str, carry: list[str], item_col: str, phrase_col: str, window: int) -> DataFrame:
    """The columns in carry as c0, c1 ..., and __found."""
    spark = documents.sparkSession
    bounded_batches(spark)
    plain = len(carry)
    source = numbered(documents.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text_col}`").cast("string").alias("text")).toDF(*[f"c{k}" for k in range(plain)], "text"))
    items = phrases.select(F.col(item_col).cast("string").alias("id"), F.col(phrase_col).cast("string").alias("text")).where("text IS NOT NULL")
    blocks_ = _phrase_blocks(items)
    block = next(blocks_, [])
    following = next(blocks_, None)
    if following is None:  # one block of phrases, one scan
        schema = T.StructType([*source.schema.fields[:plain], T.StructField("__found", FOUND)])
        return source.mapInArrow(_finder(spark.sparkContext.broadcast(Phrases(block, window)), plain), schema)
    # a row's number names it, and what each block finds is kept apart from the texts
    source = stored(source.withColumn("row", F.monotonically_increasing_id()))
    names, parts = source.columns[:plain], []
    while block is not None:
        shared = spark.sparkContext.broadcast(Phrases(block, window))
        found = source.select("row", f"c{plain}").mapInArrow(_finder(shared, 1), T.StructType([T.StructField("c0", T.LongType()), T.StructField("__found", FOUND)]))
        parts.append(stored(found.where(F.size("__found.spans") > 0) if parts else found))
        shared.destroy()
        block, following = following, next(blocks_, None)
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    merged = F.array_sort(F.flatten(F.collect_list("__found.spans")))
    found = every.groupBy("c0").agg(F.max("__found.n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("__found.items")))).alias("items"), _union(merged).alias("spans"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    found = found.select(F.col("c0").alias("row"), F.struct("n_words", hit.alias("n_hit"), "items", "spans").cast(FOUND).alias("__found"))
    out = stored(source.drop(f"c{plain}").join(found, "row").select(*names, "__found"))
    discard(source, *parts)
    return out


def _union(spans):
    """Sorted spans with those that overlap or touch merged."""
    start = F.array().cast("array<struct<start:int,end:int>>")
    last = lambda out: F.element_at(out, -1)
    longer = lambda out, x: F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last(out)["start"].alias("start"), F.greatest(last(out)["end"], x["end"]).alias("end"))))
    return F.aggregate(spans, start, lambda out, x: F.when((F.size(out) > 0) & (F.get(out, F.size(out) - 1)["end"] >= x["start"]), longer(out, x)).otherwise(F.concat(out, F.array(x))))


def is_contaminated(found: str = "__found"):
    """At least a twentieth of the document's words are hit."""
    return (F.col(f"{found}.n_hit") > 0) & (F.lit(20) * F.col(f"{found}.n_hit") >= F.col(f"{found}.n_words"))


def decontaminate(documents: DataFrame, phrases: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """documents without those that is_contaminated() names; the others are unchanged, all columns included, whatever their names."""
    options = {"item_col": "item_id", "phrase_col": "text", "window": 13} | options
    return renamed(_found(documents, phrases, text_col, documents.columns, **options).where(~is_contaminated()), documents.columns)


def op2_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_phrases(documents, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=["doc_id"])
    return found.select("doc_id", "__found.n_words", "__found.n_hit", F.size("__found.items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "__found.items"), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))
