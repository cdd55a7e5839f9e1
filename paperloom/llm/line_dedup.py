"""Operator 3: near-duplicate lines, by an exact set-similarity join.

A line is the set of its words. The words of a line are ordered by rarity in the whole corpus; two lines of Jaccard
similarity t or more then share a word within the first n - ceil(t * n) + 1 of each (prefix filter).

1. A scan counts all words in a table of 2**20 bins, added up over the tasks: its size doesn't depend on the input.
   Any fixed order makes the filter exact; words that share a bin only make it a little less sharp.
2. A second scan deals the prefix words of all lines out by word, and the lines by the key of their word set. Rows of one
   batch and part travel as one packed record, so that the shuffle costs bytes and hardly any rows. The number of parts
   follows the number of words, so a part has a bounded share of the rows.
3. Copies of one word set within a task find their first there, and the firsts of all tasks meet in a part of lines, so a line that
   is everywhere costs a row for each task. In each part of words, rows with the same word meet in
   numpy, in order of length: length filter, positional filter, and a parity filter (a 64-bit parity vector of each set:
   differing bits can't outnumber differing words). Copies of one set count once. Each line keeps its most promising earlier
   lines for each word (BEST of them where the closest surely is close, MANY in borderline cases and for short lines), so a dense group makes
   no square.
4. A third scan fetches the words of the lines in question, which a bitmap of fixed size picks out, and parity vectors of 512
   bits, which leave few false pairs. The similarity is verified in integers: with the closest earlier line first, then, where
   that fails, with the others; lines that fail with all of a list that was cut meet all their candidates in one more pass.
5. A line goes if an earlier line of the corpus, by document id and line number, has the same words or is similar.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import bounded_batches, discard, key_filter, maybe_in, numbered, renamed, stored
from ._text import SPACE_WORD, blocks, column_bytes, mix, ranges, word_bounds, word_hashes

RARITY_BITS = 20
_RANK_BITS = 20
_BITMAP_BITS = 25
_CHUNK = 1 << 14
_U = np.uint64


def _bin(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U(64 - RARITY_BITS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, pending = np.zeros(1 << RARITY_BITS, np.int64), []
    for batch in batches:
        data, offsets = column_bytes(batch.column(0))
        for _, _, d, o in blocks(data, offsets):
            s, e, _ = word_bounds(d, o, SPACE_WORD)
            pending.append(_bin(word_hashes(d, s, e)))
            if sum(map(len, pending)) > 1 << RARITY_BITS:
                counts += np.bincount(np.concatenate(pending), minlength=len(counts))
                pending = []
    if pending:
        counts += np.bincount(np.concatenate(pending), minlength=len(counts))
    yield _packed_counts(counts)


def _packed_counts(counts: np.ndarray) -> pa.RecordBatch:
    packed = [zlib.compress(counts[k : k + _CHUNK].tobytes(), 1) for k in range(0, len(counts), _CHUNK)]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(packed), dtype=np.int32)), pa.array(packed, pa.binary())], names=["chunk", "counts"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(zlib.decompress(packed), np.int64)
            sums[chunk] = sums[chunk] + own if chunk in sums else own
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], names=["chunk", "counts"])


def word_rarity(documents: DataFrame, text_col: str) -> np.ndarray:
    """How many words of all texts fall in each of the 2**RARITY_BITS bins."""
    return _summed_counts(documents.select(F.col(text_col).cast("string")).mapInArrow(_count, "chunk int, counts binary"))


def _summed_counts(parts: DataFrame) -> np.ndarray:
    rows = parts.repartition("chunk").mapInArrow(_add, "chunk int, counts binary").collect()  # at most 64 chunks
    out = np.zeros(1 << RARITY_BITS, np.int64)
    for r in rows:
        out[r["chunk"] * _CHUNK : (r["chunk"] + 1) * _CHUNK] += np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return out


class _Lines:
    """The word sets of the lines of a block, each in the order of rarity."""

    def __init__(self, d: np.ndarray, o: np.ndarray, rarity: np.ndarray | None) -> None:
        s, e, documents = word_bounds(d, o, SPACE_WORD)
        words = word_hashes(d, s, e)
        breaks = np.concatenate([[0], np.cumsum(d == 10)])
        self.breaks = breaks[o]  # line breaks before each document
        owner = np.repeat(np.arange(len(o) - 1), np.diff(documents))
        line = breaks[s] + owner
        shift = _U(max(1, int(line[-1]).bit_length() if len(line) else 1))
        rank = np.zeros(len(words), _U) if rarity is None else rarity[_bin(words)]
        bits = shift if rarity is None else shift + _U(_RANK_BITS)
        by = line.astype(_U) << (_U(64) - shift) | rank << (_U(64) - bits) | words >> bits
        order = np.argsort(by)
        by, words = by[order], words[order]
        if ((by[1:] == by[:-1]) & (words[1:] != words[:-1])).any():  # two words agree in the bits that are left
            words = word_hashes(d, s, e)
            order = np.lexsort((words, rank, line))
            words = words[order]
        line, owner = line[order], owner[order]
        new = np.ones(len(words), bool)
        new[1:] = (words[1:] != words[:-1]) | (line[1:] != line[:-1])
        words, line, owner = words[new], line[new], owner[new]
        self.words = words
        self.starts = np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(line) else np.empty(0, np.int64)
        self.n = np.diff(np.append(self.starts, len(line)))
        self.owner = owner[self.starts]
        self.number = line[self.starts] - self.owner - self.breaks[self.owner]

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.starts):
            return np.empty(0, np.int64), np.empty(0, np.int32)
        a = np.add.reduceat(mix(self.words ^ _U(0x5851F42D4C957F2D)), self.starts)
        b = np.add.reduceat(mix(self.words ^ _U(0x14057B7EF767814F)), self.starts)
        return mix(a).view(np.int64), (mix(b) >> _U(33)).astype(np.int32)


#: A prefix word of a line as it travels: the word's low bits, its line's key, parity vector, size and first place, and its own place.
_WORD = [("word", np.uint32), ("key", np.int64), ("parity", np.uint64), ("n", np.int32), ("place", np.int32), ("id", np.int64), ("line", np.int32)]
#: A line as it travels.
_LINE = [("key", np.int64), ("key2", np.int32), ("id", np.int64), ("text_key", np.int64), ("line", np.int32)]
#: A line that an earlier one of its task has the words of.
_SETTLED = [("id", np.int64), ("text_key", np.int64), ("line", np.int32)]
#: Rows that a part is made for, pairs that are looked at together, and the most candidates that a line keeps for a word.
_PART, _PAIRS, BEST, MANY = 1 << 17, 1 << 19, 8, 256
#: Rows of a word beyond which its pairs are looked for by bands of the parity vectors.
HOT_WORD = 4096


def _pack(rows: dict[str, np.ndarray], a: int, b: int) -> bytes:
    """Rows a to b, column after column; each as differences from its least value if they fit in fewer bytes."""
    out = [np.int64(b - a).tobytes()]
    for name, own in rows.items():
        own = own[a:b]
        low = own.min()
        span = int(own.max()) - int(low)
        kind = next((k for k in (np.uint8, np.uint16, np.uint32) if span <= np.iinfo(k).max and np.dtype(k).itemsize < own.itemsize), None)
        out += [np.int8(0 if kind is None else np.dtype(kind).itemsize).tobytes(), low.tobytes(), own.tobytes() if kind is None else (own - low).astype(kind).tobytes()]
    return b"".join(out)


def _unpack(packed: list[bytes], columns: list) -> dict[str, np.ndarray]:
    out: dict[str, list[np.ndarray]] = {name: [] for name, _ in columns}
    for x in packed:
        n, at = int(np.frombuffer(x, np.int64, 1)[0]), 8
        for name, kind in columns:
            size, low = x[at], np.frombuffer(x, kind, 1, at + 1)[0]
            at += 1 + np.dtype(kind).itemsize
            short = {0: kind, 1: np.uint8, 2: np.uint16, 4: np.uint32}[size]
            own = np.frombuffer(x, short, n, at)
            out[name].append(own if not size else own.astype(kind) + low)
            at += own.nbytes
    return {name: np.concatenate(v) for name, v in out.items()}


def _by_part(dealt: list[dict[str, np.ndarray]], columns: list, kind: int, sets: list[np.ndarray] | None = None) -> pa.RecordBatch:
    """One packed record for each part of the rows; sets: the words of each row's line, to go along."""
    rows = {name: np.concatenate([x[name] for x in dealt]) for name in ["part", *[name for name, _ in columns]]}
    dealt.clear()
    order = np.argsort(rows["part"], kind="stable")
    part = rows.pop("part")[order]
    rows = {name: rows[name][order].astype(k, copy=False) for name, k in columns}
    bounds = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    ends = [*bounds[1:].tolist(), len(order)]
    out = [_pack(rows, a, b) for a, b in zip(bounds.tolist(), ends, strict=True)]
    words = pa.nulls(len(out), pa.binary())
    if sets is not None:
        words = pa.array([b"".join([sets[k].tobytes() for k in order[a:b].tolist()]) for a, b in zip(bounds.tolist(), ends, strict=True)], pa.binary())
        sets.clear()
    return pa.RecordBatch.from_arrays([pa.array(part[bounds] * 4 + kind, pa.int64()), pa.array(out, pa.binary()), words], names=["part", "rows", "words"])


def _deal(rarity, p: int, q: int, bits: int, only):
    """Packed prefix words (kind 0 of a part), lines (1) and later copies among the lines of a task, dealt out at random (2);
    only: no lines, the words in this bitmap, and whole word sets."""

    def lines_out(copies: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        rows = {name: np.concatenate([x[name] for x in copies]) for name in ["part", *[name for name, _ in _LINE]]}
        copies.clear()
        order, later = _later(rows)
        settled, open_ = order[later], order[~later]
        yield _by_part([{name: v[open_] for name, v in rows.items()}], _LINE, 1)
        if len(settled):
            rows = {name: rows[name][settled] for name, _ in _SETTLED}
            rows["part"] = (_occurrence(rows["text_key"], rows["id"], rows["line"]).view(_U) >> _U(64 - bits)).astype(np.int64)
            yield _by_part([rows], _SETTLED, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, words, copies, sets = rarity.value, [], [], None if only is None else []
        for batch in batches:
            data, offsets = column_bytes(batch.column(2))
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids, texts = batch.column(0).fill_null(0).to_numpy(), batch.column(1).to_numpy()
            for first, _, d, o in blocks(data, offsets):
                lines = _Lines(d, o, table)
                own = first + lines.owner
                use = np.flatnonzero(known[own])
                if not len(use):
                    continue
                key, key2 = lines.keys()
                if only is None:
                    copies.append({"part": (key[use].view(_U) >> _U(64 - bits)).astype(np.int64), "key": key[use], "key2": key2[use], "id": ids[own[use]], "text_key": texts[own[use]], "line": lines.number[use]})
                use = use[np.lexsort((lines.number[use], ids[own[use]], key[use]))]
                use = use[np.append(True, key[use][1:] != key[use][:-1])]  # the first of the copies in this block
                prefix = lines.n[use] - -(-p * lines.n[use] // q) + 1
                at, of = ranges(lines.starts[use], prefix), np.repeat(use, prefix)
                place = np.arange(len(at)) - np.repeat(np.cumsum(prefix) - prefix, prefix)
                part, word = (lines.words[at] >> _U(64 - bits)).astype(np.int64), lines.words[at].astype(np.uint32)
                if only is not None:
                    here = _in_bitmap(only.value, _name(part, word))
                    of, place, part, word = of[here], place[here], part[here], word[here]
                    sets += [lines.words[a:b] for a, b in zip(lines.starts[of].tolist(), (lines.starts[of] + lines.n[of]).tolist(), strict=True)]
                parity = np.bitwise_xor.reduceat(_U(1) << (mix(lines.words) & _U(63)), lines.starts)
                words.append({"part": part, "word": word, "key": key[of], "parity": parity[of], "n": lines.n[of], "place": place, "id": ids[own[of]], "line": lines.number[of]})
                if sum(len(x["word"]) for x in words) > _PART:
                    yield _by_part(words, _WORD, 0, sets)
            if sum(len(x["key"]) for x in copies) > 4 * _PART:
                yield from lines_out(copies)
        if words and any(len(x["word"]) for x in words):
            yield _by_part(words, _WORD, 0, sets)
        if copies:
            yield from lines_out(copies)

    return run


def _name(part: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A word's part and low bits, as one scrambled value."""
    return mix(part.astype(_U) << _U(32) | word.astype(_U)).view(np.int64)


def _occurrence(key: np.ndarray, id_: np.ndarray, line: np.ndarray) -> np.ndarray:
    """A line of a document, as one scrambled value."""
    return mix(key.view(_U) ^ mix(id_.astype(np.int64).view(_U) * _U(0x9E3779B97F4A7C15) + line.astype(_U))).view(np.int64)


def _in_bitmap(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    bit = values.view(np.uint64) >> _U(64 - _BITMAP_BITS)
    return (bitmap[(bit >> _U(3)).astype(np.int64)] >> (bit & _U(7)).astype(np.uint8) & 1) > 0


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = np.zeros(1 << _BITMAP_BITS, bool)
    for batch in batches:
        out[(batch.column(0).to_numpy().view(_U) >> _U(64 - _BITMAP_BITS)).astype(np.int64)] = True
    packed = zlib.compress(np.packbits(out, bitorder="little").tobytes(), 1)
    yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], names=["bits"])


def _bitmap(values: DataFrame) -> np.ndarray:
    """A bitmap of the first bits of a column of scrambled 64-bit values: 4 MB at most, whatever their number."""
    out = np.zeros(1 << (_BITMAP_BITS - 3), np.uint8)
    for r in values.repartition(4).mapInArrow(_mark, "bits binary").collect():
        out |= np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return out


def _by_time(rows: dict[str, np.ndarray]) -> np.ndarray:
    """The rows' places in the order of document id, line number and key."""
    id_, line = rows["id"], rows["line"]
    if len(id_) and 0 <= id_.min() and id_.max() < 1 << 40 and line.max() < 1 << 23:
        at = id_ << 23 | line
        order = np.argsort(at)
        if (at[order][1:] != at[order][:-1]).all():
            return order
    return np.lexsort((rows["key"], line, id_))


def _merged_copies(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The rows with one for each word and word set: that of the earliest line; in the order of word and length."""
    when = np.empty(len(rows["id"]), np.int64)
    when[_by_time(rows)] = np.arange(len(when))
    meeting = rows["word"].astype(_U) << _U(32) | rows["key"].view(_U) >> _U(32)
    same = np.argsort(meeting)
    start = np.flatnonzero(np.append(True, meeting[same][1:] != meeting[same][:-1])) if len(same) else np.empty(0, np.int64)
    size = np.diff(np.append(start, len(same)))
    several = np.repeat(size > 1, size)
    some = same[several]
    some = some[np.lexsort((when[some], rows["key"][some], rows["word"][some]))]
    word, key = rows["word"][some], rows["key"][some]
    first = some[np.append(True, (word[1:] != word[:-1]) | (key[1:] != key[:-1]))] if len(some) else some
    kept = np.concatenate([same[~several], first])
    kept = kept[np.argsort(rows["word"][kept].astype(_U) << _U(32) | rows["n"][kept].astype(_U))]
    return {name: v[kept] for name, v in rows.items()}


_MET = "kind string, key long, other long, apart int, word long, id long, text_key long, line int, own long, theirs long"


def _result(kind: str, n: int, **columns: np.ndarray) -> pa.Table:
    types = {"key": pa.int64(), "other": pa.int64(), "apart": pa.int32(), "word": pa.int64(), "id": pa.int64(), "text_key": pa.int64(), "line": pa.int32(), "own": pa.int64(), "theirs": pa.int64()}
    return pa.table({"kind": pa.array([kind] * n, pa.string())} | {name: pa.array(columns[name], t) if name in columns else pa.nulls(n, t) for name, t in types.items()})


def _later(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order of lines by word set and time, and which of them, in that order, have an earlier line of the same words."""
    order = np.lexsort((rows["line"], rows["id"], rows["key2"], rows["key"]))
    key, key2, id_, line = (rows[name][order] for name in ("key", "key2", "id", "line"))
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (key2[1:] != key2[:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    return order, (id_ > id_[first]) | (line > line[first])


def _later_copies(packed: list[bytes]) -> pa.Table:
    """Lines (kind `copy`) whose word set an earlier line has."""
    rows = _unpack(packed, _LINE)
    order, later = _later(rows)
    return _result("copy", int(later.sum()), **{name: rows[name][order[later]] for name, _ in _SETTLED})


def _meeting(rows: np.ndarray, group: np.ndarray, n: np.ndarray, p: int, q: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group whose lengths allow the similarity; the rows come in the order of group and length n."""
    at = group << 31
    count = np.searchsorted(at | n, at | np.minimum(q * n // p, (1 << 31) - 1), "right") - np.arange(len(n)) - 1
    ends, first = np.cumsum(count), 0
    while first < len(n):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + _PAIRS, "right")))
        yield np.repeat(rows[first:last], count[first:last]), rows[ranges(np.arange(first, last) + 1, count[first:last])]
        first = last


def _pairs(word: np.ndarray, n: np.ndarray, parity: np.ndarray, p: int, q: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows with one word that can be similar by length, a block at a time, each pair once.

    A word of more than HOT_WORD rows is divided further, by classes of length in the ratio of the similarity: rows of a class meet
    those of their own and the next one. The parity vectors of similar sets differ in at most d bits, which follows from the class,
    so of d + 1 bands of them one at least is the same; rows meet where a band is, and a pair counts in the first band that it shares.
    """
    size = np.bincount(word, minlength=1) if len(word) else np.zeros(1, np.int64)
    cold = np.flatnonzero(size[word] <= HOT_WORD)
    yield from _meeting(cold, word[cold], n[cold], p, q)
    for w in np.flatnonzero(size > HOT_WORD).tolist():
        rows = np.flatnonzero(word == w)
        edges = [int(n[rows].min())]
        while edges[-1] <= n[rows].max():
            edges.append(max(edges[-1] + 1, edges[-1] * q // p + 1))
        class_ = np.searchsorted(edges, n, "right") - 1
        for c in np.unique(class_[rows]).tolist():
            near = rows[(class_[rows] == c) | (class_[rows] == c + 1)]
            for a, b in _banded(near, n, parity, p, q):
                ok = (class_[a] == c) | (class_[b] == c)
                yield a[ok], b[ok]


def _banded(rows: np.ndarray, n: np.ndarray, parity: np.ndarray, p: int, q: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that share a band of their parity vectors; all pairs of few rows, or where bands would have less than four bits."""
    bands = int(2 * n[rows].max() * (q - p) // (q + p)) + 1
    if bands > 16 or len(rows) <= HOT_WORD // 8:
        rows = rows[np.argsort(n[rows], kind="stable")]
        yield from _meeting(rows, np.zeros(len(rows), np.int64), n[rows], p, q)
        return
    edges = [64 * k // bands for k in range(bands + 1)]
    mask = [_U(((1 << (b - a)) - 1) & 0xFFFFFFFFFFFFFFFF) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    for k in range(bands):
        value = np.unique(parity[rows] >> _U(edges[k]) & mask[k], return_inverse=True)[1]
        order = np.lexsort((n[rows], value))
        for a, b in _meeting(rows[order], value[order], n[rows][order], p, q):
            apart = parity[a] ^ parity[b]
            new = np.ones(len(a), bool)
            for j in range(k):
                new &= (apart >> _U(edges[j]) & mask[j]) != 0
            yield a[new], b[new]


def _meet(p: int, q: int, wanted):
    """What the rows of a part have in common: `copy` rows of a part of lines; of a part of words, the most promising earlier
    lines of each line for each word (kind `pair`) and the words at which such a list was cut (`cut`); wanted: of the lines in this
    bitmap those that are similar to any earlier line (`similar`), by the word sets that came along."""

    def run(key_: tuple, table: pa.Table) -> pa.Table:
        part, packed = key_[0].as_py(), table["rows"].to_pylist()
        if part % 4 == 1:
            return _later_copies(packed)
        if part % 4 == 2:
            rows = _unpack(packed, _SETTLED)
            return _result("copy", len(rows["id"]), **rows)
        rows = _unpack(packed, _WORD)
        if wanted is not None:
            sets = np.split(np.frombuffer(b"".join(table["words"].to_pylist()), np.uint64), np.cumsum(rows["n"])[:-1])
            rows["at"] = np.arange(len(rows["n"]))
        rows = _merged_copies(rows)
        n, place, parity, key = rows["n"].astype(np.int64), rows["place"].astype(np.int64), rows["parity"], rows["key"]
        where_ = _occurrence(key, rows["id"], rows["line"])
        when = np.empty(len(n), np.int64)
        when[_by_time(rows)] = np.arange(len(n))
        found: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64),) * 4]
        all_ = np.zeros(len(n), np.int64)
        for a, b in _pairs(np.cumsum(np.append(0, rows["word"][1:] != rows["word"][:-1])), n, parity, p, q):
            need = -(-p * (n[a] + n[b]) // (p + q))
            ok = (place[a] <= n[a] - need) & (place[b] <= n[b] - need)
            a, b, need = a[ok], b[ok], need[ok]
            bits, most = np.bitwise_count(parity[a] ^ parity[b]).astype(np.int64), n[a] + n[b] - 2 * need
            ok = bits <= most
            a, b, bits, most = a[ok], b[ok], bits[ok], most[ok]
            swap = when[a] < when[b]
            later, earlier = np.where(swap, b, a), np.where(swap, a, b)
            if wanted is None:
                all_ += np.bincount(later, minlength=len(n))
                later, earlier, bits, most = _best(later, earlier, bits, most, when)
            found.append((later, earlier, bits, most))
        later, earlier, bits, most = (np.concatenate(x) for x in zip(*found, strict=True))
        if wanted is not None:
            ok = _in_bitmap(wanted.value, key[later])
            at, similar = rows["at"], set()
            for a, b in zip(later[ok].tolist(), earlier[ok].tolist(), strict=True):
                x, y = sets[at[a]], sets[at[b]]
                if a not in similar and (p + q) * len(np.intersect1d(x, y)) >= p * (len(x) + len(y)):
                    similar.add(a)
            found_ = np.array(sorted(similar), np.int64)
            return _result("similar", len(found_), key=key[found_])
        kept = _best(later, earlier, bits, most, when)
        cut = np.flatnonzero(all_ > np.bincount(kept[0], minlength=len(n)))
        pairs = _result("pair", len(kept[0]), key=key[kept[0]], other=key[kept[1]], apart=kept[2].astype(np.int32), own=where_[kept[0]], theirs=where_[kept[1]])
        return pa.concat_tables([pairs, _result("cut", len(cut), key=key[cut], word=_name(np.full(len(cut), part // 4), rows["word"][cut]))])

    return run


def _best(later: np.ndarray, earlier: np.ndarray, bits: np.ndarray, most: np.ndarray, when: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each line's pairs the BEST, or MANY if the closest is a borderline case."""
    order = np.lexsort((when[earlier], bits, later))
    later, earlier, bits, most = later[order], earlier[order], bits[order], most[order]
    group = np.flatnonzero(np.append(True, later[1:] != later[:-1])) if len(later) else np.empty(0, np.int64)
    size = np.diff(np.append(group, len(later)))
    sure = (2 * bits[group] <= most[group]) & (most[group] >= 4) & (bits[group] <= 8)  # a longer vector may be one of many words
    limit = np.where(sure, BEST, MANY)
    ok = np.arange(len(later)) - np.repeat(group, size) < np.repeat(limit, size)
    return later[ok], earlier[ok], bits[ok], most[ok]


#: Lines, and (with key null, n being its lines) a row for each document.
_SETS = "key long, key2 int, id long, text_key long, line int, n int, parity array<long>, words array<long>"


def _wide_parity(words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """512-bit parity vectors of sets that follow one another, each as a row of eight values."""
    out = np.zeros((len(n), 8), np.int64)
    full = n > 0
    starts = (np.cumsum(n) - n)[full]
    bit = mix(words ^ _U(0x3C6EF372FE94F82B))
    for k in range(8 if len(starts) else 0):
        out[full, k] = np.bitwise_xor.reduceat(np.where(bit >> _U(61) == k, _U(1) << (bit & _U(63)), _U(0)), starts).view(np.int64)
    return out


def _fetch(wanted, places):
    """The lines whose keys the bitmap has; with their words those whose occurrences the second bitmap has. And all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(2))
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids, texts = batch.column(0).fill_null(0).to_numpy(), batch.column(1).to_numpy()
            void = batch.column(2).is_null().to_numpy(zero_copy_only=False)
            for first, last, d, o in blocks(data, offsets):
                lines = _Lines(d, o, None)
                key, key2 = lines.keys()
                own = first + lines.owner
                total, size = np.where(void[first:last], 0, np.diff(lines.breaks) + 1).astype(np.int32), last - first
                none = [pa.nulls(size, t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([none[0], none[1], pa.array(ids[first:last], mask=~known[first:last]), pa.array(texts[first:last]), none[2], pa.array(total), none[3], none[3]], names=["key", "key2", "id", "text_key", "line", "n", "parity", "words"])
                full = _in_bitmap(places.value, _occurrence(key, ids[own], lines.number))
                use = np.flatnonzero(known[own] & (full | _in_bitmap(wanted.value, key)))
                own, n = own[use], lines.n[use] * full[use]
                words = lines.words[ranges(lines.starts[use], n)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(words.view(np.int64)))
                parity = pa.ListArray.from_arrays(pa.array(np.arange(0, 8 * len(n) + 1, 8, dtype=np.int32)), pa.array(_wide_parity(words, n).ravel()))
                columns = [pa.array(x) for x in (key[use], key2[use], ids[own], texts[own], lines.number[use].astype(np.int32), n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*columns, parity, lists], names=["key", "key2", "id", "text_key", "line", "n", "parity", "words"])

    return run


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, gone in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            gone = set(gone or ())
            out.append("\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone) if gone else text)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, pa.string())], names=batch.schema.names[:-1])


def _keyed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).cast("string").alias("text"))


def repeated_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Lines that an earlier line matches, and the documents they are in.

    The first result has rows (id, text_key, line): lines, counted from 0, to which an earlier line (smaller id, then line
    number) has a Jaccard similarity of `similarity` or more, as sets of words `[^\\x20\\x09-\\x0D]+`. The second
    has a row (id, text_key, n_lines) for each document. Lines are parted by line feeds and judged on the input.

    A null text has no lines, an empty one has one empty line; lines without words match nothing; documents without an id
    take part in no comparison; identical rows (same id and text) are one document, and lose the same lines; an empty table
    gives empty results; other columns, whatever their names, are ignored. A text is held whole in one task, lines of any
    length included. Ids are whole numbers, or text of such; any other id ends the job with Spark's CAST_INVALID_INPUT.
    """
    t = Fraction(str(similarity))
    if not 0 < t <= 1:
        raise ValueError("similarity must be over 0 and at most 1")
    p, q = t.numerator, t.denominator
    spark = documents.sparkSession
    bounded_batches(spark)
    docs = _keyed(documents, id_col, text_col)
    counts = word_rarity(documents, text_col)
    # ranks of 20 bits in the order of the counts: their float32 patterns without the last bits
    rarity = spark.sparkContext.broadcast((counts.astype(np.float32).view(np.uint32) >> np.uint32(32 - 1 - _RANK_BITS)).astype(_U))
    bits = max(4, int(int(counts.sum()) * (q - p + 1) // (q * _PART)).bit_length())
    def met(only, wanted) -> DataFrame:
        return docs.mapInArrow(_deal(rarity, p, q, bits, only), "part long, rows binary, words binary").groupBy("part").applyInArrow(_meet(p, q, wanted), _MET)

    def fetched(pairs: DataFrame) -> DataFrame:
        """All lines with the pairs' keys (and, by the bitmap's nature, some others); with words each set's first line."""
        keys = spark.sparkContext.broadcast(_bitmap(pairs.select("key")))
        places = spark.sparkContext.broadcast(_bitmap(pairs.select("own").union(pairs.select("theirs"))))
        return stored(docs.mapInArrow(_fetch(keys, places), _SETS))

    def alike(tried: DataFrame, sets: DataFrame) -> DataFrame:
        """key, key2 of the lines that are similar to the earlier line of one of their pairs (key, other)."""
        ends = tried.select("key").union(tried.select("other"))
        one = maybe_in(sets.where("n > 0"), key_filter(ends, "key"), "key").where("__maybe").select("key", "key2", "words")
        other = one.select(F.col("key").alias("other"), F.col("key2").alias("other2"), F.col("words").alias("other_words"))
        both = tried.select("key", "other").join(one, "key").join(other, "other")
        overlap = F.size(F.array_intersect("words", "other_words"))
        return both.where(F.lit(p + q) * overlap >= F.lit(p) * (F.size("words") + F.size("other_words"))).select("key", "key2").distinct()

    found = stored(met(None, None))
    copies, cuts = found.where("kind = 'copy'").select("id", "text_key", "line"), found.where("kind = 'cut'").select("key", "word")
    pairs = stored(found.where("kind = 'pair'").groupBy("key", "other", "own", "theirs").agg(F.min("apart").alias("apart")))
    lines = fetched(pairs)
    whole, sets = lines.where("key IS NULL").select("id", "text_key", F.col("n").cast("long").alias("n_lines")), lines.where("key IS NOT NULL")
    mine, theirs = (sets.where("n > 0").select(*[F.col(c).alias(f"{name}{c}") for c in ("key", "n", "parity")]) for name in ("", "other_"))
    apart = sum((F.bit_count(F.get("parity", F.lit(k)).bitwiseXOR(F.get("other_parity", F.lit(k)))) for k in range(8)), F.lit(0))
    need = F.expr(f"({p} * (n + other_n) + {p + q - 1}) div {p + q}")
    close = pairs.select("key", "other").join(mine, "key").join(theirs.withColumnRenamed("other_key", "other"), "other").withColumn("apart", apart)
    close = stored(close.where(F.col("apart") <= F.col("n") + F.col("other_n") - 2 * need).select("key", "other", "apart"))
    discard(pairs)
    best = stored(close.groupBy("key").agg(F.min(F.struct("apart", "other")).alias("best")).select("key", F.col("best.other").alias("other")))
    likely = stored(alike(best, sets))
    failed = stored(close.join(best, ["key", "other"], "left_anti").join(likely, "key", "left_anti").select("key", "other"))
    similar = stored(likely.union(alike(failed, sets)))
    discard(close, best, likely, failed)
    parts = [sets.join(similar, ["key", "key2"]).select("id", "text_key", "line")]
    open_ = stored(cuts.join(similar, "key", "left_anti"))
    if not open_.isEmpty():
        keys, words = (spark.sparkContext.broadcast(_bitmap(open_.select(c))) for c in ("key", "word"))
        again = met(words, keys).where("kind = 'similar'").join(open_.select("key").distinct(), "key", "left_semi").select("key").distinct()
        parts.append(sets.join(again, "key").select("id", "text_key", "line"))
    gone = copies
    for x in parts:
        gone = gone.union(x)
    gone = stored(gone.distinct())
    discard(found, similar, open_)
    return gone, whole


def drop_repeated_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """documents with the lines of repeated_lines taken out of their texts; all rows and other columns stay, whatever their names.
    The text column is a string afterwards; a null text stays null."""
    gone, whole = repeated_lines(documents, id_col, text_col, similarity)
    lists = stored(gone.groupBy("id", "text_key").agg(F.collect_list("line").alias("gone")))
    discard(gone)
    columns = documents.columns
    at, own = columns.index(text_col), [f"c{k}" for k in range(len(columns))]
    rows = numbered(documents).withColumns({"id": F.col(f"c{columns.index(id_col)}").cast("long"), "text_key": F.xxhash64(f"c{at}")})
    marked = maybe_in(rows, key_filter(lists, "id", "text_key"), "id", "text_key")
    calm = marked.where("NOT __maybe").select(*own)
    busy = marked.where("__maybe").join(lists, ["id", "text_key"], "left")
    busy = busy.select(*[c for c in own if c != f"c{at}"], F.col(f"c{at}").cast("string").alias("text"), "gone")
    cut = busy.mapInArrow(_without, busy.drop("gone").schema).withColumnRenamed("text", f"c{at}").select(*own)
    return renamed(calm.unionByName(cut), columns)


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, removed_lines (their numbers from 0, ascending, comma-joined) of every document."""
    gone, whole = repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    lists = gone.groupBy("id", "text_key").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    rows = whole.join(lists, ["id", "text_key"], "left")
    return rows.select(F.col("id").alias("doc_id"), "n_lines", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.concat_ws(",", F.col("lines").cast("array<string>")), F.lit("")).alias("removed_lines"))
