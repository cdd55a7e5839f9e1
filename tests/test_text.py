"""Text expressions against the expectations of the survey (T11, T18, captions, headings, file names)."""

import pytest
from pyspark.sql import functions as F

from paperloom.functions import constants as K
from paperloom.functions import text as T


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).collect()[0]["x"]


def test_quality_states(spark):
    noisy = "\x01\x02\x03\x04" * 120 + "abc"
    good = ("This is readable extracted PDF text with words and numbers 12345. " * 40).strip()
    assert one(spark, T.quality_state("t"), t=noisy) == "unreadable"
    assert one(spark, T.quality_metrics("t")["control_ratio"], t=noisy) >= 0.3
    assert one(spark, T.quality_state("t"), t=good) == "ok"
    assert one(spark, T.quality_metrics("t")["printable_ratio"], t=good) == 1.0
    assert one(spark, T.quality_state("t"), t="") == "unreadable"
    assert one(spark, T.quality_state("t"), t="word " * 20) == "warn"


def test_content_limit(spark):
    out = one(spark, T.content_limit("t"), t="A" * 300_000)
    assert out == "A" * 200_000 + "\n... [Content truncated]" and one(spark, T.content_limit("t"), t="A") == "A"


@pytest.mark.parametrize(
    "text, want",
    [
        ("Formula (cid:16)x(cid:17) and (cid:40)y(cid:41)", "Formula 〈x〉 and (y)"),
        (r"\alpha + \beta = \gamma", "α + β = γ"),
        (r"\times \div \pm \leq \geq", "× ÷ ± ≤ ≥"),
        (r"a \subseteq b \cdots \infty x^{2}_{10}^{n}", "a ⊂eq b ·s ∞ x^2_10^n"),
        (None, None),
        ("", ""),
    ],
)
def test_latex(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(T.fix_latex("t")).collect()[0][0] == want


def test_latex_longest_first(spark):
    assert one(spark, T.fix_latex("t", longest_first=True), t=r"\subseteq \cdots \infty") == "⊆ ⋯ ∞"


@pytest.mark.parametrize(
    "path, want",
    [("/a/b.PDF", "pdf"), ("x.tar.zip", "zip"), ("/d/.hidden", None), ("noext", None), ("a.unknown", None), ("A.YML", "yaml"), ("/x.d/readme", None)],
)
def test_formats(spark, path, want):
    assert one(spark, T.detect_format("p"), p=path) == want


@pytest.mark.parametrize("text", ["Chapter 1 Introduction", "CHAPTER 2 Methods", "Ch. 3 Results", "第一章 绪论", "第二章 相关工作", "Part I Foundations", "Part II Advanced", "# Heading", "## Sub heading"])
def test_headings(spark, text):
    assert one(spark, T.chapter_heading("t"), t="x\n" + text)


@pytest.mark.parametrize("text", ["This Chapter is long", "Page 1 of 10", "\\chapter{Introduction}", ""])
def test_no_headings(spark, text):
    assert one(spark, T.chapter_heading("t"), t=text) is None


def test_pattern_order_wins_over_place(spark):
    assert one(spark, T.chapter_heading("t"), t="# first\nChapter 7 later") == "Chapter 7"


def test_title_keywords(spark):
    assert one(spark, T.title_keywords("t"), t="The Art of Computer Programming") == ["Art", "Computer", "Programming"]
    assert one(spark, T.title_keywords("t"), t="The and With") == ["The", "and", "With"]
    assert one(spark, T.title_keywords("t"), t="") == []


def test_captions_and_references(spark):
    assert one(spark, T.figure_references("t"), t="Figure 3, figure 1; Figure 3 Fig. 9") == [1, 3]
    assert (one(spark, T.caption_kind("t"), t="表2 说明"), one(spark, T.caption_label("t"), t="Fig. s2a: x")) == ("table", "S2A")
    assert one(spark, T.caption_kind("t"), t="text Figure 1") is None


def test_sample_pages(spark):
    assert one(spark, T.sample_pages("n"), n=3) == [0, 1, 2]
    assert one(spark, T.sample_pages("n"), n=0) == []
    assert one(spark, T.sample_pages("n"), n=100) == sorted({round(i * 99 / 9) for i in range(10)})


def test_cid_ratio(spark):
    text = "(cid:1)(cid:22) ab\n"
    assert one(spark, T.cid_ratio("t"), t=text) == pytest.approx(2 / (2 + 18 - 15))


def test_image_names_and_labels(spark):
    rows = spark.createDataFrame([("d/page001_img002_raster.png",), ("page2_img1_cluster.png",), ("page0_img3_image_block.png",), ("table_math.png",)], "path string").withColumns(T.image_metadata("path"))
    got = [(r.page_in_chunk, r.kind, r.region_source, r.labels) for r in rows.withColumn("labels", T.candidate_labels("path", "kind", "region_source")).collect()]
    assert got == [(1, "raster", None, ["figure_like"]), (2, "vector_region", "cluster", ["unknown"]), (0, "vector_region", "image_block", ["figure_like"]), (None, "unknown", None, ["formula_like", "table_like", "unknown"])]


def test_hashes(spark):
    assert one(spark, T.hash_distance("a", "b"), a="aaaaaaaaaaaaaaaa", b="aaaaaaaaaaaaaaab") == 1
    assert one(spark, T.hash_distance("a", "b"), a="ffffffffffffffff", b="0000000000000000") == 64
    assert one(spark, T.hash_distance("a", "b"), a="aa", b="aaa") is None and one(spark, T.hash_distance("a", "b"), a="zz", b="aa") is None
    pixels = [[(r * c) % 7 for c in range(9)] for r in range(8)]
    from paperloom.operators.images import dhash_of

    got = one(spark, T.difference_hash("p"), p=[x for row in pixels for x in row])
    assert got % (1 << 64) == dhash_of(pixels)


def test_boxes(spark):
    assert one(spark, T.valid_box("b", "w", "h"), b=[0.0, 0.0, 10.0, 10.0], w=10.0, h=10.0)
    for bad in ([-1.0, 0.0, 10.0, 10.0], [0.0, 0.0, float("nan"), 1.0], [5.0, 0.0, 5.0, 1.0], [0.0, 0.0, 11.0, 1.0], [0.0, 0.0, 1.0], [0.0, 0.0, float("inf"), 1.0]):
        assert not one(spark, T.valid_box("b", "w", "h"), b=bad, w=10.0, h=10.0)
    assert one(spark, T.box_overlap("a", "b"), a=[0.0, 0.0, 4.0, 4.0], b=[2.0, 2.0, 9.0, 9.0]) == 4.0
    assert one(spark, T.ordered_box("b"), b=[4.0, 9.0, 1.0, 2.0]) == [1.0, 2.0, 4.0, 9.0]
    assert one(spark, T.expanded_box("b", 3.0, "w", "h"), b=[1.0, 5.0, 8.0, 9.0], w=10.0, h=10.0) == [0.0, 2.0, 10.0, 10.0]


@pytest.mark.parametrize("path, want", [("a/b.txt", True), ("../x", False), ("/etc/x", False), ("a/../b", True), ("a/../../b", False), ("C:/x", False), ("a\\..\\..\\b", False)])
def test_archive_members(spark, path, want):
    assert one(spark, T.safe_member("p"), p=path) is want


def test_names(spark):
    assert one(spark, T.safe_name("p"), p="a b/ü.x") == "a_b___x" and one(spark, T.safe_stem("p"), p="a b ü") == "a_b_ü"
    assert one(spark, T.image_type("p"), p="x.PNG") == "image/png" and one(spark, T.image_type("p"), p="x") == "image/jpeg"
    assert one(spark, T.first_line_title("t"), t="  Title \nmore") == "Title" and one(spark, T.first_line_title("t"), t="\nx") is None
    assert len(K.GREEK) == 46 and len(K.CID_CHARACTERS) == 23 and len(K.MATH) == 39
