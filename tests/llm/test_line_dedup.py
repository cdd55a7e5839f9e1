import random
import re

import pytest
from helpers import DOCUMENTS, documents, stored_tables

from paperloom.llm import line_dedup as D


def brute(docs):
    lines = []
    for i, t in docs:
        for k, x in enumerate(t.split("\n") if t is not None else ()):
            if (w := frozenset(re.findall(r"[^\x20\x09-\x0D]+", x))) and i is not None:
                lines.append((i, k, w))
    gone = {}
    for i, k, w in lines:
        if any((j, m) < (i, k) and 9 * len(w & v) >= 4 * (len(w) + len(v)) for j, m, v in lines):
            gone.setdefault(i, set()).add(k)
    return gone


def corpus(seed, n=25, short=False):
    r = random.Random(seed)
    base = [[f"w{r.randrange(60)}" for _ in range(r.randrange(1, 7 if short else 40))] for _ in range(20)]
    rows = []
    for k in range(n):
        lines = []
        for _ in range(r.randrange(1, 8)):
            w = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                w[r.randrange(len(w))] = f"x{r.randrange(300)}"
            r.shuffle(w)
            lines.append((r.choice([" ", "  ", "\t"])).join(w))
        rows.append((n - k, r.choice(["\n", "\n\n"]).join(lines), "en", "s", 1))
    return [*rows, (100, None, "", "", 0), (101, "", "", "", 0), (102, "\n \n", "", "", 0), (103, rows[0][1], "", "", 0), (None, rows[0][1], "", "", 0)]


@pytest.mark.parametrize("seed, short, best, hot", [(1, False, 8, 4096), (2, True, 8, 3), (3, False, 1, 2), (4, True, 1, 4096)])
def test_query_against_brute_force(spark, tmp_path, monkeypatch, seed, short, best, hot):
    monkeypatch.setattr(D, "HOT_WORD", hot)
    monkeypatch.setattr(D, "BEST", best)
    monkeypatch.setattr(D, "MANY", 256 if best > 1 else 1)
    rows = corpus(seed, short=short)
    d = stored_tables(spark, tmp_path, documents=(rows, DOCUMENTS))
    gone = brute([r[:2] for r in rows])
    want = {(i, t.count("\n") + 1 if t is not None else 0, len(gone.get(i, ())), ",".join(map(str, sorted(gone.get(i, ()))))) for i, t, *_ in rows}
    assert {tuple(r) for r in D.op3_line_dedup(spark, d).collect()} == want


def test_texts_lose_their_lines_and_columns_stay(spark):
    rows = corpus(5)
    docs = documents(spark, rows).selectExpr("*", "7 AS key", "8 AS line")
    gone = brute([r[:2] for r in rows])
    got = {r.doc_id: r.text for r in D.drop_repeated_lines(docs).collect()}
    assert got == {i: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t, *_ in rows}
    assert D.drop_repeated_lines(docs).columns == docs.columns


def test_empty_table_and_identical_rows(spark):
    assert D.drop_repeated_lines(spark.createDataFrame([], DOCUMENTS)).count() == 0
    same = spark.createDataFrame([(1, "a b\nc d\na b")] * 2, "doc_id long, text string")
    assert [r.text for r in D.drop_repeated_lines(same).collect()] == ["a b\nc d"] * 2
