import hashlib
import random
import re

import numpy as np
from helpers import DOCUMENTS, corpus, stored_tables

from paperloom.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k=13):
    windows = {}
    for i, t in items:
        w = WORD.findall((t or "").translate(LOW))
        for p in range(max(1, len(w) - k + 1) if w else 0):
            windows.setdefault(tuple(w[p : p + k]), set()).add(i)
    out = []
    for i, t in docs:
        w = WORD.findall((t or "").translate(LOW))
        hit, found = [False] * len(w), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[p : p + n]))) is not None:
                    hit[p : p + n] = [True] * n
                    found |= {str(x) for x in own if x is not None}
        n = sum(hit)
        out.append((i, len(w), n, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), n > 0 and 20 * n >= len(w)))
    return sorted(out, key=str)


def items(rows):
    texts = [" ".join((r[1] or "").split()[5:40]) for r in rows[:12]]
    return [*enumerate(texts), (20, None), (21, ""), (22, "w1 W2, w3"), (22, "é w4"), (None, "straße w5"), (23, "!!! ?"), (24, texts[0])]


def test_query_against_brute_force(spark, tmp_path):
    rows = corpus(5, 50)
    bench = items(rows)
    d = stored_tables(spark, tmp_path, documents=(rows, DOCUMENTS), benchmark=(bench, "item_id long, text string"))
    assert sorted(map(tuple, D.op2_benchmark_decontamination(spark, d).collect()), key=str) == brute([r[:2] for r in rows], bench)


def test_blocks_of_phrases_give_the_same(spark, tmp_path, monkeypatch):
    rows = corpus(6, 30)
    bench = items(rows)
    d = stored_tables(spark, tmp_path, documents=(rows, DOCUMENTS), benchmark=(bench, "item_id long, text string"))
    monkeypatch.setattr(D, "PHRASE_BLOCK", 300)
    assert sorted(map(tuple, D.op2_benchmark_decontamination(spark, d).collect()), key=str) == brute([r[:2] for r in rows], bench)


def test_filter_keeps_clean_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, "q " * 100, 5), (2, "a b c d e f g h i j k l m n", 6), (2, "a b c d e f g h i j k l m n", 6)], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame([(1, "A b c, d e f g h i j k l m")], "item_id long, text string")
    kept = D.decontaminate(docs, bench)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, "q " * 100, 5)]
    assert D.decontaminate(docs, bench.limit(0)).count() == 3
    assert D.decontaminate(docs.limit(0), bench).count() == 0


def test_index_finds_every_occurrence():
    r = random.Random(2)
    text = [r.randrange(1, 4) if r.random() > 0.05 else 0 for _ in range(800)] + [0]
    index = D.FMIndex(np.array(text, np.int32), 3)
    windows = [[r.randrange(1, 4) for _ in range(n)] for n in (1, 2, 3, 5, 8) for _ in range(6)]
    padded = np.zeros((len(windows), 8), np.int32)
    for row, w in zip(padded, windows):
        row[: len(w)] = w
    found, low, high = index.search(padded, np.array([len(w) for w in windows]))
    got = {int(k): sorted(index.locate(np.arange(a, b)).tolist()) for k, a, b in zip(found, low, high)}
    want = {k: [p for p in range(len(text) - len(w) + 1) if text[p : p + len(w)] == w] for k, w in enumerate(windows)}
    assert got == {k: v for k, v in want.items() if v}
