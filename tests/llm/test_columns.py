"""Columns of the user's that have the operators' own names, and ids that are text."""

import public_tokenizers
import pytest
from helpers import corpus

from paperloom.llm import bpe, chat_format, decontamination, license_scan, line_dedup, quality_classifier, secret_scan, simhash, substring_dedup, topk_search

NAMES = ["__id", "__key", "__word", "__found", "__ids", "__decoded", "__score", "__matches", "__text", "__maybe", "__gone", "__stays", "id", "text_key", "c0", "c1", "gone", "row", "root", "rank", "shard", "place", "kind"]
PHRASES = "item_id long, text string"


def docs(spark):
    rows = [(*r[:2], "en", f"s{k % 3}", *(f"{n}{k}" for n in NAMES)) for k, r in enumerate(corpus(5, 25))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in NAMES))


def theirs(df, columns):
    return {tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()}


KEEPING = {
    "lines": lambda d, s: line_dedup.drop_repeated_lines(d),
    "simhash": lambda d, s: simhash.drop_near_duplicates(d),
    "similarity": lambda d, s: simhash.drop_near_duplicates(d, shingle=5, similarity=0.8),
    "decontamination": lambda d, s: decontamination.decontaminate(d, s.createDataFrame([(1, "w1 w2 w3")], PHRASES)),
    "quality": lambda d, s: quality_classifier.keep_good(d, quality_classifier.fit(["w1 w2", "w3"], [1, 0]), least=0.0),
}
ADDING = {
    "__found": lambda d, s: decontamination.find_phrases(d, s.createDataFrame([(1, "w1 w2 w3")], PHRASES)),
    "__ids": lambda d, s: bpe.bpe_encode(d, public_tokenizers.path("word_bpe_49k.json")),
    "__score": lambda d, s: quality_classifier.score_quality(d, quality_classifier.fit(["w1 w2", "w3"], [1, 0])),
    "__matches": lambda d, s: license_scan.scan_licenses(d),
}
OWN = {
    "passages": lambda d: substring_dedup.substring_dedup(d),
    "secrets": lambda d: secret_scan.scan_secrets(d),
    "search": lambda d: topk_search.bm25_search(d, d.limit(3)),
    "groups": lambda d: simhash.simhash_groups(d),
    "repeats": lambda d: line_dedup.repeated_lines(d)[0],
}


@pytest.mark.parametrize("name", list(KEEPING))
def test_filters_keep_all_columns(spark, name):
    d = docs(spark)
    done = KEEPING[name](d, spark)
    assert done.columns == d.columns and done.count() > 5
    rest = [c for c in d.columns if c != "text"]
    assert theirs(done, rest) <= theirs(d, rest)
    assert KEEPING[name](d.limit(0), spark).count() == 0


@pytest.mark.parametrize("name", list(ADDING))
def test_added_columns_leave_others(spark, name):
    d = docs(spark)
    done = ADDING[name](d, spark)
    assert done.columns.count(name) == 1 and len(set(done.columns)) == len(done.columns) and "_" + name in done.columns
    same = [c for c in d.columns if c in done.columns and c not in ADDING and c != "__decoded"]
    assert theirs(done, [*same, "_" + name]) == theirs(d, [*same, name])


@pytest.mark.parametrize("name", list(OWN))
def test_other_columns_are_ignored(spark, name):
    d = docs(spark)
    plain = d.select("doc_id", "text", "lang", "source")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(OWN[name](d)) == key(OWN[name](plain))


def test_ids_that_are_text(spark):
    d = spark.createDataFrame([("7", "a b c"), ("8", "a b c")], "doc_id string, text string")
    assert {r["group"] for r in simhash.simhash_groups(d).collect()} == {7}
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        simhash.simhash_groups(d.selectExpr("concat('x', doc_id) AS doc_id", "text")).collect()
    turns = chat_format.format_turns(spark.createDataFrame([("x", 0, "assistant", "t")], "conv_id string, turn long, role string, text string"))
    assert [r.conv_id for r in turns.collect()] == ["x"]
