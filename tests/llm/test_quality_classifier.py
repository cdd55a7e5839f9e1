import math
import zlib

import numpy as np
import pandas as pd
from helpers import DOCUMENTS, corpus

from paperloom.llm import quality_classifier as D


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = D.op9_quality_classifier(spark, d).toPandas()
    rows = got.merge(pd.read_parquet(f"{d}/labels.parquet"), on="doc_id")
    held = rows[rows.held_out]
    assert (held.predicted == held.quality).mean() > 0.95
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()


def test_labels_of_held_out_rows_change_nothing(spark):
    docs = spark.createDataFrame([(k, ("good words here " if k % 2 else "BAD!! JUNK!! ") * 5, "", "", 0) for k in range(60)], DOCUMENTS)
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int").where(~D.is_held_out("doc_id"))
    more = labels.union(spark.createDataFrame([(None, 1), (3, None), (5, 7)], "doc_id long, quality int"))
    one, two = D.train_quality(docs, labels), D.train_quality(docs, more)
    assert (one.weights == two.weights).all() and one.bias == two.bias


def test_nulls_empty_tables_and_carried_columns(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 6), (None, "x " * 5000, 7), (2, "", 6)], "doc_id long, text string, score int")
    model = D.fit(["good text", "bad!!"], [1, 0])
    done = D.score_quality(docs, model)
    scores = [r["__score"] for r in done.collect()]
    assert done.columns == [*docs.columns, "__score"] and scores[0] == scores[1] == scores[3] and all(0 < s < 1 for s in scores)
    assert D.score_quality(docs.limit(0), model).count() == 0
    assert D.train_quality(docs, spark.createDataFrame([], "doc_id long, quality int")).bias == 0


def test_texts_do_not_travel_to_the_driver(spark, monkeypatch):
    rows = [(k, ("good words here " if k % 2 else "BAD!! JUNK!! ") * (1 + k % 5)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    collected, kind = [], type(docs)
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: collected.append(self.columns) or collect(self))
    model = D.train_quality(docs, labels)
    assert collected and not any("text" in columns for columns in collected)
    known = D.fit([text for _, text in rows], [k % 2 for k, _ in rows])
    assert np.allclose(model.weights, known.weights, atol=1e-6) and abs(model.bias - known.bias) < 1e-6 and model.bits == known.bits


def brute_score(model, text):
    """The score from the model's numbers, feature by feature."""
    from paperloom.llm._text import mix, word_hashes

    raw, total, n = (text or "").encode(), 0.0, 0
    words, mask = raw.split(), (1 << 64) - 1
    value = lambda w: int(word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])
    hashes = [value(w) for w in words]
    rows = [h >> 64 - model.bits for h in hashes]
    rows += [0 if a == b else int(mix(np.array([a * 3 + b & mask], np.uint64))[0]) >> 64 - model.bits for a, b in zip(hashes, hashes[1:])]
    code = [0x20 if 9 <= ord(x) <= 13 else ord(x) for x in text or ""]
    for k in (3, 4):
        for p in range(len(code) - k + 1):
            gram = code[p]
            for x in code[p + 1 : p + k]:
                gram = (gram * 0x01000193 & 0xFFFFFFFF) ^ x
            rows.append((gram * 0x9E3779B1 + (k * 0x85EBCA6B & 0xFFFFFFFF) & 0xFFFFFFFF) >> 32 - model.bits)
    total = sum(float(model.weights[r]) for r in rows)
    n = len(rows) + D.NEUTRAL
    return 1 / (1 + math.exp(-max(-60, min(60, total / n + model.bias))))


def test_scores_against_brute_force(spark):
    rows = [r[:2] for r in corpus(3, 40)] + [(900, "x" * 200_000), (901, "long " * 30_000), (902, "é\n\tß 中文")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(r[0], r[0] % 2) for r in rows[:40]], "doc_id long, quality int")
    model = D.train_quality(docs, labels, max_chars=5000)
    got = {r.doc_id: r["__score"] for r in D.score_quality(docs, model, carry=["doc_id"]).collect()}
    for k, text in rows:
        assert abs(got[k] - brute_score(model, text)) < 1e-6, k


def test_longer_texts_than_the_limit_teach_nothing(spark):
    rows = [(k, "fine words " * 5) for k in range(9)] + [(20 + k, "JUNK " * 9) for k in range(9)]
    labels = spark.createDataFrame([(k, int(k < 20)) for k, _ in rows] + [(99, 0)], "doc_id long, quality int")
    docs = lambda more: spark.createDataFrame(rows + more, "doc_id long, text string")
    one, two = (D.train_quality(docs(x), labels, max_chars=200) for x in ([], [(99, "fine words " * 50)]))
    assert (one.weights == two.weights).all()


def test_texts_that_are_not_utf8_score_alike_everywhere():
    model = D.fit(["good text", "bad!!"], [1, 0])
    texts = ["plain é".encode(), b"\xff\xfe odd \x80", "中文".encode(), b""]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    alone = [model.score(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert np.allclose(model.score(data, at), alone, atol=1e-12)
