import hashlib
import re

import pytest
from helpers import DOCUMENTS, corpus, documents, stored_tables

from paperloom.llm.substring_dedup import op1_substring_dedup, substring_dedup


def brute(rows, window=50):
    first, texts = {}, [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, w in texts:
        for p in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[p : p + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if i is not None and first[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_query_against_brute_force(spark, tmp_path):
    rows = corpus(7, 50, 140)
    d = stored_tables(spark, tmp_path, documents=(rows, DOCUMENTS))
    assert sorted(map(tuple, op1_substring_dedup(spark, d).collect()), key=str) == brute([r[:2] for r in rows])


@pytest.mark.parametrize("window, anchor", [(5, 2), (8, 8), (50, 12)])
def test_windows_nulls_and_repeated_rows(spark, window, anchor):
    rows = corpus(3, 30) + [(None, corpus(3, 30)[0][1], None, None, 1), corpus(3, 30)[2], corpus(3, 30)[2]]
    done = substring_dedup(documents(spark, rows), window=window, anchor=anchor).collect()
    got = sorted([(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in done], key=str)
    assert got == brute([r[:2] for r in rows], window)


def test_spans_name_their_source(spark):
    passage = " ".join(f"p{k}" for k in range(80))
    done = {r.doc_id: r for r in substring_dedup(documents(spark, [(1, f"x {passage} y", "", "", 0), (2, f"{passage} z q", "", "", 0)])).collect()}
    assert [tuple(s) for s in done[2].spans] == [(0, 80, 1, 1)] and done[2].kept_text == "z q" and not done[1].spans


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, id long, anchor string, spans string, text_key int")
    assert substring_dedup(empty).count() == 0
    clash = documents(spark, corpus(2, 5)).selectExpr("*", "1 AS id", "2 AS text_key", "'x' AS spans", "3 AS start")
    assert substring_dedup(clash).count() == 12


def thue_morse(a, b, n):
    return [b if bin(k).count("1") % 2 else a for k in range(n)]


def test_regular_strings_are_told_apart(spark):
    """Words and sequences of words for which sums of powers modulo 2**64 agree."""
    one, other = "".join(thue_morse("a", "b", 2048)), "".join(thue_morse("b", "a", 2048))
    tail = [f"t{k}" for k in range(49)]
    rows = [(1, " ".join([one, *tail])), (2, " ".join([other, *tail])), (3, " ".join(thue_morse("x", "y", 2048))), (4, " ".join(thue_morse("y", "x", 2048)))]
    done = substring_dedup(documents(spark, [(i, t, "", "", 0) for i, t in rows]))
    got = sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in done.collect())
    assert got == brute(rows) and got[1][2] == 0


def test_spans_that_differ_from_their_source_are_kept(spark):
    """Should values of pieces agree by chance, the words decide."""
    import pyarrow as pa

    from paperloom.llm import substring_dedup as D

    span = {"start": 0, "end": 3, "source_id": 1, "source_start": 4}
    spans = [[span | {"digest": D._digest([b"a", b"b", b"c"])}], [span | {"digest": D._digest([b"a", b"b", b"x"])}]]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("source_id", pa.int64()), ("source_start", pa.int32()), ("digest", pa.binary())]))
    batch = pa.RecordBatch.from_arrays([pa.array([2, 3]), pa.array([0, 0]), pa.array(["a b c d"] * 2), pa.array(spans, kind)], names=["id", "text_key", "text", "spans"])
    done = pa.Table.from_batches(D._keep(iter([batch]))).to_pylist()
    assert [(r["n_removed"], r["kept_text"], r["spans"]) for r in done] == [(3, "d", [span]), (0, "a b c d", [])]
