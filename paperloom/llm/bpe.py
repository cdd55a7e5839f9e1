"""Operator 6: BPE encoding and decoding of whole texts with a public tokenizer file.

The tokenizer is read from its JSON file, never trained. A text is normalised and cut to words as the file says; each
distinct word of a task is encoded once, thousands of words at a time:

* a word is a row of symbols; a segment tree over the row has the rank of each adjacent pair in its leaves and the
  least (rank, place) of its children in every node, so the root is the leftmost lowest-rank merge;
* a merge rewrites one symbol and updates three leaves and the nodes above them, so it costs the logarithm of the
  word's length; rows stop when the root has no merge left;
* all rows of one size take their steps together in numpy.

A bounded dictionary of words spares repeated work within a Python worker. There is no shuffle.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import beside, bounded_batches, renamed
from ._text import ranges

_NO = np.int64((1 << 63) - 1)
_PLACE_BITS = 32
#: Most words a worker remembers, and their most characters; other words are encoded anew in each slice of a batch.
REMEMBERED, LONGEST_REMEMBERED = 200_000, 64
_SLICE = 256
#: Rows times leaves of the trees that are worked on together.
_CELLS = 1 << 21
# What the tokenizer file's \s matches.
_SPACE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if it is visible, else the next free one from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


class Bpe:
    """A BPE model with word ends, as a tokenizers JSON file describes it."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        cuts = [x["type"] for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or cuts != ["Split", "ByteLevel"] or spec["decoder"] or not model["end_of_word_suffix"]:
            raise ValueError("not a lower-case byte-letter BPE with word ends")
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = pattern.replace("\\s", _SPACE)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + end] for c in letters], np.int64)
        merges = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        keep = np.append(True, keys[order][1:] != keys[order][:-1])  # the first rank of a pair that is listed twice
        self.keys, self.ranks = keys[order][keep], order[keep]
        size = max([*vocab.values(), *self.special.values()]) + 1
        if len(merges) >> 63 - _PLACE_BITS:
            raise ValueError("too many merges")
        with open(path, "rb") as f:
            self.digest = hashlib.file_digest(f, "sha256").hexdigest()
        self.tokens: list[bytes] = [b""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token.encode()

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of pairs of symbols, _NO if they don't merge. A symbol below zero stands for none."""
        key = left << 20 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], _NO)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each has. Words are not empty."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        symbols = self.inner[data]
        symbols[starts + lengths - 1] = self.final[data[starts + lengths - 1]]
        alive = np.ones(len(symbols), bool)
        size = np.maximum(2, 1 << np.ceil(np.log2(lengths)).astype(np.int64))
        for leaves in np.unique(size).tolist():
            rows = np.flatnonzero(size == leaves)
            step = max(1, _CELLS // leaves)
            for k in range(0, len(rows), step):
                self._merge(symbols, alive, starts[rows[k : k + step]], lengths[rows[k : k + step]], leaves)
        kept = np.concatenate([[0], np.cumsum(alive)])
        return symbols[alive], kept[starts + lengths] - kept[starts]

    def _merge(self, symbols: np.ndarray, alive: np.ndarray, starts: np.ndarray, lengths: np.ndarray, leaves: int) -> None:
        """Merge the rows at starts in place; alive: the places whose symbol is left."""
        n, width = len(starts), leaves + 2  # a place before the row, and one after it, hold no symbol
        row = np.full((n, width), -1, np.int64)
        where, of = ranges(starts, lengths), np.repeat(np.arange(n), lengths)
        place = where - starts[of]
        row[of, place + 1] = symbols[where]
        after = np.tile(np.arange(1, width + 1), (n, 1))
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        tree = np.full((n, 2 * leaves), _NO, np.int64)
        rank = self._rank(row[:, 1:-1].ravel(), row[:, 2:].ravel()).reshape(n, leaves)
        tree[:, leaves:] = np.where(rank == _NO, _NO, rank << _PLACE_BITS | np.arange(leaves))
        half = leaves
        while half > 1:
            half >>= 1
            tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
        row, after, before, tree = row.ravel(), after.ravel(), before.ravel(), tree.ravel()
        active = np.arange(n)
        while True:
            top = tree[active * 2 * leaves + 1]
            active, top = active[top < _NO], top[top < _NO]
            if not len(active):
                break
            base, root = active * width, active * 2 * leaves
            here = (top & ((1 << _PLACE_BITS) - 1)) + 1
            gone = after[base + here]
            follows, precedes = np.minimum(after[base + gone], width - 1), before[base + here]
            new = self.merged[top >> _PLACE_BITS]
            row[base + here] = new
            row[base + gone] = -1
            after[base + here] = follows
            before[base + follows] = here
            alive[starts[active] + gone - 1] = False
            right = self._rank(new, row[base + follows])
            left = self._rank(row[base + precedes], new)
            tree[root + leaves + here - 1] = np.where(right == _NO, _NO, right << _PLACE_BITS | (here - 1))
            inside = precedes >= 1
            tree[(root + leaves + precedes - 1)[inside]] = np.where(left == _NO, _NO, left << _PLACE_BITS | (precedes - 1))[inside]
            closing = gone - 1 < leaves
            tree[(root + leaves + gone - 1)[closing]] = _NO
            for leaf in (here - 1, np.maximum(precedes, 1) - 1, np.minimum(gone - 1, leaves - 1)):
                node = leaf + leaves >> 1
                while node[0] >= 1:
                    tree[root + node] = np.minimum(tree[root + 2 * node], tree[root + 2 * node + 1])
                    node = node >> 1
        symbols[where] = row[of * width + place + 1]


class Encoder:
    """Texts to ids, with a bounded memory of words."""

    def __init__(self, bpe: Bpe) -> None:
        self.bpe = bpe
        self.words = regex.compile(bpe.pattern)
        self.special = regex.compile("|".join(f"({regex.escape(x)})" for x in bpe.special)) if bpe.special else None
        self.known: dict[str, int] = {}
        self._clear()

    def _clear(self) -> None:
        self.known.clear()
        self.flat = np.empty(0, np.int32)
        self.first, self.count = np.empty(0, np.int64), np.empty(0, np.int64)

    def _pieces(self, text: str) -> list[str | int]:
        """The words of a text; ids stand for special tokens in it."""
        parts = self.special.split(text) if self.special and "<" in text else [text]
        out: list[str | int] = []
        for x in parts:
            if x is None:
                continue
            if x in self.bpe.special:
                out.append(self.bpe.special[x])
            elif x:
                plain = x if x.isascii() else unicodedata.normalize("NFC", x).replace("Σ", "σ")
                out += self.words.findall(plain.lower())
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the n + 1 bounds of each text's ids."""
        pieces = [self._pieces(x) for x in texts]
        if len(self.known) > REMEMBERED:
            self._clear()
        fresh = {w for own in pieces for w in own if w not in self.known}
        numbers = [x for x in fresh if isinstance(x, int)]
        words = [x for x in fresh if not isinstance(x, int)]
        base, known = len(self.first), self.known
        ids, count = self.bpe.encode_words([w.encode() for w in words]) if words else (np.empty(0, np.int64), np.empty(0, np.int64))
        count = np.concatenate([count, np.ones(len(numbers), np.int64)])
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.flat = np.concatenate([self.flat, ids.astype(np.int32), np.array(numbers, np.int32)])
        known.update(zip(words + numbers, range(base, base + len(words) + len(numbers)), strict=True))
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        at = np.fromiter((known[w] for own in pieces for w in own), np.int64, int(sizes.sum()))
        n = self.count[at]
        bounds = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(sizes)])]
        out = self.flat[ranges(self.first[at], n)]
        for w in words:
            if len(w) > LONGEST_REMEMBERED:
                del known[w]
        return out, bounds


class Decoder:
    """Ids to the text of their tokens, joined by one space (what a file without a decoder asks for)."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.data = np.frombuffer(b"".join(x + b" " for x in tokens), np.uint8)
        self.length = np.array([len(x) + 1 for x in tokens], np.int64)
        self.first = np.cumsum(self.length) - self.length

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        length = self.length[ids]
        data = self.data[ranges(self.first[ids], length)]
        ends = np.concatenate([[0], np.cumsum(length)])[bounds]
        texts = [data[a : max(a, b - 1)].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return pa.array(texts, pa.binary()).cast(pa.string())


_workers: dict[str, tuple[Encoder, Decoder]] = {}


def _worker(model) -> tuple[Encoder, Decoder]:
    key = model.value.digest
    if key not in _workers:
        _workers.clear()
        _workers[key] = Encoder(model.value), Decoder(model.value.tokens)
    return _workers[key]


def _coder(model, n_carried: int, decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _worker(model)
        for batch in batches:
            for k in range(0, batch.num_rows, _SLICE):
                part = batch.slice(k, _SLICE)
                ids, bounds = encoder.encode([x or "" for x in part.column(n_carried).to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32()))
                text = decoder.decode(ids, bounds) if decode else pa.nulls(part.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:n_carried], lists, text], names=[*part.schema.names[:n_carried], "__ids", "__decoded"])

    return run


def bpe_encode(documents: DataFrame, tokenizer: str, text_col: str = "text", carry: list[str] | None = None, decode: bool = True) -> DataFrame:
    """documents' columns (or those in carry), ids array<int> as `__ids`, and the text decoded from them as `__decoded`.

    tokenizer: the path of a tokenizers JSON file, read by the driver. Ids are those of
    Tokenizer.encode(text, add_special_tokens=False); special tokens' strings in a text become their ids; the decoded text
    is that of decode(ids, skip_special_tokens=False).

    A null or empty text has no ids and decodes to an empty text; rows keep their multiplicity; other columns are carried
    along as they are, but one named __ids or __decoded gets underscores in front; an empty table gives an empty result. A text
    is held whole in one task.
    """
    bounded_batches(documents.sparkSession)
    carry = documents.columns if carry is None else carry
    model = documents.sparkSession.sparkContext.broadcast(Bpe(tokenizer))
    names = [f"c{k}" for k in range(len(carry))]
    source = documents.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(names, carry, strict=True)], F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("__ids", T.ArrayType(T.IntegerType())), T.StructField("__decoded", T.StringType())])
    done = source.mapInArrow(_coder(model, len(carry), decode), schema)
    return renamed(done, beside(carry, "__ids", "__decoded"), "__ids", "__decoded")


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    done = bpe_encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), carry=["doc_id"])
    ids = F.concat_ws(" ", F.col("__ids").cast("array<string>"))
    return done.select("doc_id", F.size("__ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("__decoded", 256).alias("decoded_sha256"))
