"""SimHash fingerprints, and all pairs of them within a Hamming distance by vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import column_bytes
from .components import local_components, spanning_links

SEED = 42
#: Residents of a shard that the tree is built for, fingerprints of the sample for each shard, and their most.
SHARD, PER_SHARD, MOST_SAMPLED = 1 << 16, 8, 1 << 18
_BLOCK = 1 << 20
_SMALL = 96
_LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 0x100))


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The SimHash of a UTF-8 text; zero if it has no words."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n], ends[min(shingle, len(words)) - 1 :]
    votes, digest = np.zeros(64, np.int64), xxhash.xxh64_digest
    for k in range(0, n, _BLOCK >> 4):
        values = b"".join([digest(line[s:e], SEED) for s, e in zip(starts[k : k + (_BLOCK >> 4)].tolist(), ends[k : k + (_BLOCK >> 4)].tolist(), strict=True)])
        votes += np.unpackbits(np.frombuffer(values, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    """The fingerprints of a block's texts."""
    raw, at = data.tobytes(), offsets.tolist()
    return np.array([fingerprint(raw[at[k] : at[k + 1]], shingle) for k in range(len(at) - 1)], np.uint64)


def scan_fingerprints(shingle: int):
    """(id, text_key, text) to (id, text_key, fingerprint as long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = fingerprints(*column_bytes(batch.column(2)), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values.view(np.int64))], names=["id", "text_key", "fingerprint"])

    return run


class VantageTree:
    """Top levels of a vantage-point tree over 64-bit fingerprints, as arrays. A child below zero is leaf -1 - child."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 7) -> None:
        self.point, self.median, self.inside, self.outside = [], [], [], []
        self.leaves, self._random = 0, np.random.default_rng(seed)
        self.root = self._grow(sample, max(1, leaves))
        self.point = np.array(self.point, np.uint64)

    def _grow(self, sample: np.ndarray, leaves: int) -> int:
        if leaves > 1 and len(sample) > 4:
            tried = sample[self._random.integers(0, len(sample), 8)]
            away = np.bitwise_count(sample[:, None] ^ tried[None, :]).astype(np.int64)
            best = int(np.argmax(away.var(axis=0)))
            away = away[:, best]
            median = int(np.sort(away)[(len(away) - 1) // 2])
            near = away <= median
            if near.all():  # the median is the greatest distance: split below it
                median -= 1
                near = away <= median
            if near.any() and not near.all():
                node = len(self.point)
                for column, value in ((self.point, tried[best]), (self.median, median), (self.inside, 0), (self.outside, 0)):
                    column.append(value)
                share = max(1, min(leaves - 1, round(leaves * near.mean())))
                self.inside[node] = self._grow(sample[near], share)
                self.outside[node] = self._grow(sample[~near], leaves - share)
                return node
        self.leaves += 1
        return -self.leaves

    def deal(self, values: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, places in values, whether they live there) for every leaf where a value lives or visits.

        Of two values within the radius whose homes part at a node, the one that lives inside visits the outside; so each pair
        meets once, and nobody visits the inside from an outside home.
        """
        todo = [(self.root, np.arange(len(values)), np.ones(len(values), bool))]
        while todo:
            node, rows, home = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                yield -1 - node, rows, home
                continue
            away = np.bitwise_count(values[rows] ^ self.point[node]).astype(np.int64)
            near = away <= self.median[node]
            inside = near | (~home & (away - radius <= self.median[node]))
            todo.append((self.inside[node], rows[inside], home[inside]))
            outside = ~near | (away + radius > self.median[node])
            todo.append((self.outside[node], rows[outside], (home & ~near)[outside]))


def near_pairs(values: np.ndarray, home: np.ndarray, radius: int) -> np.ndarray:
    """Component labels of a shard: links of residents with greater residents and with visitors within the radius."""
    random, label = np.random.default_rng(11), np.arange(len(values))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    pending = 0

    def settle() -> None:
        nonlocal label, found, pending
        if found:
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            label = local_components(len(values), np.concatenate([a, np.arange(len(values))]), np.concatenate([b, label]))
            found, pending = [], 0

    todo = [(np.flatnonzero(home), np.arange(len(values)))]
    while todo:
        mine, all_ = todo.pop()
        if not len(mine) or not len(all_):
            continue
        if len(mine) > _SMALL:
            point = values[mine[random.integers(len(mine))]]
            away, reach = np.bitwise_count(values[mine] ^ point).astype(np.int64), np.bitwise_count(values[all_] ^ point).astype(np.int64)
            median = int(np.sort(away)[(len(away) - 1) // 2])
            median -= int((away <= median).all())
            if (away <= median).any():
                todo.append((mine[away <= median], all_[reach - radius <= median]))
                todo.append((mine[away > median], all_[reach + radius > median]))
                continue
        rows = max(1, _BLOCK // len(all_))
        for k in range(0, len(mine), rows):
            part = mine[k : k + rows]
            close = (np.bitwise_count(values[part][:, None] ^ values[all_][None, :]) <= radius) & (~home[all_] | (values[part][:, None] < values[all_][None, :]))
            a, b = np.nonzero(close)
            if len(a):
                found.append((part[a], all_[b]))
                pending += len(a)
                if pending > _BLOCK:
                    settle()
    settle()
    return label


def _dealer(tree, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            for leaf, rows, home in tree.value.deal(values, radius):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), leaf, np.int32)), pa.array(values[rows].view(np.int64)), pa.array(home)], names=["leaf", "value", "home"])

    return run


def _shard(radius: int):
    def run(table: pa.Table) -> pa.Table:
        values = table["value"].to_numpy().view(np.uint64)
        a, b = spanning_links(near_pairs(values, table["home"].to_numpy(), radius))
        return pa.table({"a": values[a].view(np.int64), "b": values[b].view(np.int64)})

    return run


def near_links(values: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) with the components of all pairs of distinct values (column value, long) within the radius."""
    spark = values.sparkSession
    count = values.count()
    leaves = -(-count // SHARD)
    bound = min(MOST_SAMPLED, leaves * PER_SHARD * 32)
    rows = values.orderBy(F.xxhash64("value")).limit(bound).collect() if leaves > 1 else []
    sample = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    tree = spark.sparkContext.broadcast(VantageTree(sample, min(leaves, max(1, bound // PER_SHARD))))
    dealt = values.mapInArrow(_dealer(tree, radius), "leaf int, value long, home boolean")
    return dealt.groupBy("leaf").applyInArrow(_shard(radius), "a long, b long")
