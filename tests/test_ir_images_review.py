"""Blocks, indexes and Markdown (T8, T17), images (T9, T10, T20), review rules (T12 to T14), caches (T19)."""

import json

import pytest
from pyspark.sql import functions as F

from paperloom import sinks
from paperloom.operators import cache, images, ir, review

BLOCKS = "doc_id long, seq long, type string, page int, level int, content string, path string, caption string, latex string, number string"
NINE = [
    (1, 0, "section", 1, 1, "Introduction", None, None, None, None), (1, 1, "paragraph", 1, None, "text", None, None, None, None),
    (1, 2, "image", 1, None, None, "images/fig1.png", "Figure 1: System overview", None, None), (1, 3, "section", 2, 1, "Methods", None, None, None, None),
    (1, 4, "section", 2, 2, "Data Collection", None, None, None, None), (1, 5, "table", 2, None, None, None, "Table 1: Sample data", None, None),
    (1, 6, "display_formula", 2, None, None, None, None, "E = mc^2", "1"), (1, 7, "section", 3, 1, "Results", None, None, None, None), (1, 8, "image", 3, None, None, "images/fig2.png", "Figure 2: Results chart", None, None),
]


def nine(spark):
    return spark.createDataFrame(NINE, BLOCKS)


def test_index(spark):
    blocks, docs = nine(spark), spark.createDataFrame([(1, 3)], "doc_id long, page_count int")
    assert {(r.content, r.parent_seq) for r in ir.section_parents(blocks).collect()} == {("Introduction", None), ("Methods", None), ("Data Collection", 3), ("Results", None)}
    assert [r.n_blocks for r in ir.page_index(blocks, docs).orderBy("page").collect()] == [3, 4, 2]
    assert [ir.figures_index(blocks).count(), ir.tables_index(blocks).count(), ir.formulas_index(blocks).count()] == [2, 1, 1]
    index = json.loads(sinks.index_json(docs, blocks).collect()[0].json)
    assert len(index["sections"]) == 4 and index["unlocated_block_ids"] == [] and index["pages"][1]["n_blocks"] == 4
    nested = json.loads(sinks.nested_documents(docs, blocks).collect()[0].json)
    assert nested["reading_order"][2] == "block_00000002" and nested["blocks"]["block_00000004"]["level"] == 2


def test_unknown_pages_and_annotations(spark):
    blocks = spark.createDataFrame([(1, 0, "paragraph", None, None, "body", None, None, None, None)], BLOCKS)
    docs = spark.createDataFrame([(1, 8)], "doc_id long, page_count int")
    assert ir.page_index(blocks, docs).where("n_blocks = 0").count() == 8
    assert ir.unlocated_blocks(blocks).collect()[0].block_ids == ["block_00000000"]
    notes = spark.createDataFrame([(1, 5, "T")], "doc_id long, seq long, caption string")
    assert [(r.page, r.annotated) for r in ir.tables_index(blocks, notes).collect()] == [(None, 1)]


def test_markdown(spark):
    text = ir.render_markdown(nine(spark)).collect()[0].markdown
    assert text.startswith("# Introduction\n\ntext\n\n![Figure 1: System overview](images/fig1.png)\n\n---\n\n# Methods\n\n## Data Collection\n\n**Table:** Table 1: Sample data\n\n$$E = mc^2$$ \\[1\\]\n\n---\n\n# Results")


def test_lists_and_breaks_beside_unknown_pages(spark):
    rows = [(1, 0, "list", 1, ["a", "b"], False), (1, 1, "list", 1, ["c"], True), (1, 2, "text", None, None, None), (1, 3, "list", 3, ["d"], False)]
    blocks = spark.createDataFrame(rows, "doc_id long, seq long, type string, page int, items array<string>, ordered boolean").withColumn("content", F.when(F.col("type") == "text", "t"))
    assert ir.render_markdown(blocks).collect()[0].markdown == "- a\n- b\n1. c\n\nt\n\n- d"


def test_sections_of_markdown(spark):
    docs = spark.createDataFrame([(1, "lost\n# Section 1\nbody\n\n## Section 1.1\nmore\n# Section 2\nend"), (2, "no headings"), (3, "  # odd")], "doc_id long, text string")
    got = {(r.doc_id, r.level, r.heading, r.start_line, r.end_line, r.content) for r in ir.markdown_sections(docs).collect()}
    assert got == {(1, 1, "Section 1", 1, 3, "body\n"), (1, 2, "Section 1.1", 4, 5, "more"), (1, 1, "Section 2", 6, 7, "end"), (3, 0, "# odd", 0, 0, "")}


def test_front_matter(spark):
    values = {"author": F.lit("A"), "title": F.lit("T"), "subject": F.lit("")}
    assert spark.range(1).select(ir.front_matter(values)).collect()[0][0] == "---\ntitle: T\nauthor: A\n---"
    assert spark.range(1).select(ir.kept_metadata(F.create_map(F.lit("title"), F.lit("T"), F.lit("x"), F.lit("y")))).collect()[0][0] == {"title": "T"}


IMAGES = "doc_id long, ordinal long, path string, checksum string, kind string, label string, phash long"


def test_exact_and_near_groups(spark):
    rows = [(1, 0, "a", "h1", "raster", "x", None), (1, 1, "b", "h1", "vector", "y", 7), (1, 2, "c", None, "raster", "x", 6), (1, 3, "d", None, "raster", "x", 0x7FFF)]
    groups = {r.path: r for r in images.exact_groups(spark.createDataFrame(rows, IMAGES)).collect()}
    assert set(groups) == {"a", "c", "d"} and groups["a"].occurrences == 2 and groups["a"].kinds == ["raster", "vector"] and groups["a"].phash == 7
    assert {(r.a, r.b, r.bits) for r in images.near_pairs(spark.createDataFrame(rows, IMAGES), 8).collect()} == {(1, 2, 1)}
    pairs = [(1, k, "p", "h", "raster", "x", (1 << k) - 1) for k in range(0, 25, 5)]  # neighbours 5 apart, the next 10
    found = [(r.anchor, r.member, r.group_no) for r in images.near_groups(spark.createDataFrame(pairs, IMAGES), 8).orderBy("group_no", "member").collect()]
    assert found == [(0, 0, 1), (0, 5, 1), (10, 10, 2), (10, 15, 2)]


def test_near_groups_of_copies(spark):
    """Copies of hashes, at places before and after others, against the fold over all images."""
    import random

    r = random.Random(3)
    values = [(1 << (5 * r.randrange(9))) - 1 for _ in range(60)]
    taken, want = set(), []
    for a in range(60):
        members = [b for b in range(a + 1, 60) if bin(values[a] ^ values[b]).count("1") <= 8]
        if a not in taken and members:
            want += [(a, m) for m in (a, *members)]
            taken.update((a, *members))
    found = images.near_groups(spark.createDataFrame([(1, k, "p", "h", "", "", v) for k, v in enumerate(values)], IMAGES), 8).collect()
    assert sorted((r.anchor, r.member) for r in found) == sorted(want)


def test_near_groups_of_first_images_only(spark):
    """Nearness that is no equivalence, with copies: only images that no earlier one is near are anchors."""
    import random

    r = random.Random(4)
    values = [(1 << (5 * r.randrange(12))) - 1 for _ in range(30)]
    near = lambda a, b: bin(values[a] ^ values[b]).count("1") <= 8
    anchors = [a for a in range(30) if not any(near(a, b) for b in range(a)) and any(near(a, b) for b in range(a + 1, 30))]
    want = [(a, m) for a in anchors for m in range(a, 30) if near(a, m)]
    rows = spark.createDataFrame([(1, k, "p", "h", "", "", v) for k, v in enumerate(values)], IMAGES)
    assert sorted((x.anchor, x.member) for x in images.near_groups(rows, 8, first_only=True).collect()) == sorted(want)
    assert {x.anchor for x in images.near_groups(rows, 8).collect()} > set(anchors)


def test_q36_where_nearness_is_not_transitive(spark, tmp_path):
    """Images of a document 0, 7, 14 and 21 bits apart from the first: the SQL has one anchor, greedy groups have two."""
    import duckdb

    from paperloom import queries as catalog

    fall = [7.0, 6.0, 5.0, 4.0, 3.0, 2.0, 1.0, 0.0, 1.0]  # a row of grey values with 7 bits
    vectors = [[x for row in range(8) for x in (fall if 1 <= row <= n else map(float, range(9)))][:64] for n in range(4)]
    rows = [(4 * k, v) for k, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, anchor, member, group_no FROM ({catalog.ORACLES['q36_near_dup_groups']})").fetchall())
    got = catalog.QUERIES["q36_near_dup_groups"](spark, str(tmp_path)).select("doc_id", "anchor", "member", "group_no").collect()
    assert sorted(map(tuple, got)) == want and {r.anchor for r in got} == {0}


def test_near_pairs_against_brute_force(spark):
    import random

    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(12)]
    values = [x ^ sum(1 << b for b in r.sample(range(64), r.randrange(12))) for x in base for _ in range(8)]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {(x.a, x.b) for x in images.near_pairs(spark.createDataFrame([(1, k, "p", "h", "", "", v) for k, v in enumerate(signed)], IMAGES), 8).collect()}
    assert got == {(i, j) for j in range(len(values)) for i in range(j) if bin(values[i] ^ values[j]).count("1") <= 8}


def test_slots_and_matches(spark):
    text = "# Ch 1  (pages 1–2)\nFigure 1: Test figure caption and Figure 7\nas Figure 2 and figure 3 show"
    slots = images.figure_slots(spark.createDataFrame([(1, text)], "doc_id long, markdown string"))
    assert [(s.slot_id, s.line_no, s.figure_no, s.caption, s.page_hint) for s in slots.orderBy("slot_no").collect()] == [("slot_0001", 2, 1, "Test figure caption and Figure 7", 1), ("slot_0002", 3, 2, None, 1), ("slot_0003", 3, 3, None, 1)]
    pictures = spark.createDataFrame([(1, 1, 1, ["figure_like"]), (1, 2, 4, ["unknown"]), (1, 3, None, ["unknown"]), (1, 4, 1, ["figure_like"]), (1, 5, 2, ["unknown"])], "doc_id long, image_no int, page int, labels array<string>")
    got = [(m.rank, m.image_no, m.score) for m in images.match_figures(slots.where("slot_no = 1"), pictures).orderBy("rank").collect()]
    assert got == [(1, 1, 0.9), (2, 4, 0.9), (3, 5, 0.6417)]


def test_decisions(spark):
    decisions = spark.createDataFrame([(1, 0, "slot_0001", "i1", None, "Matched"), (1, 1, "", None, "g9", "unmatched"), (1, 2, "slot_9", "i9", "g1", "x")], "doc_id long, entry int, slot_id string, image_id string, group_id string, status string")
    known = lambda name, v: spark.createDataFrame([(1, v)], f"doc_id long, {name} string")
    got = {(r.entry, r.issue) for r in images.validate_decisions(decisions, known("slot_id", "slot_0001"), known("image_id", "i1"), known("group_id", "g1")).collect()}
    assert got == {(1, "unknown_group"), (2, "unknown_slot"), (2, "unknown_image")}
    assert tuple(images.decision_tally(decisions).collect()[0])[1:] == (1, 0, 1)


def page(spark, regions, captions):
    pages = spark.createDataFrame([(1, 600.0, 800.0)], "page_id long, width double, height double")
    r = spark.createDataFrame([(1, i, k, b, t, c) for k, (i, b, t, c) in enumerate(regions)], "page_id long, region_id string, seq int, bbox array<double>, type string, caption_id string")
    c = spark.createDataFrame([(1, *x) for x in captions], "page_id long, caption_id string, bbox array<double>, kind string, label string")
    return pages, r, c


R1, C1 = ("r1", [50.0, 80.0, 300.0, 300.0], "image", None), ("c1", [50.0, 310.0, 300.0, 340.0], "figure", "1")


@pytest.mark.parametrize(
    "regions, captions, want",
    [
        ([R1], [C1], set()),
        ([("r1", R1[1], "table", None)], [C1], {("r1", "caption_category_conflict")}),
        ([R1], [("c1", [400.0, 310.0, 590.0, 340.0], "figure", "1")], {("r1", "missing_caption"), ("r1", "unassigned_caption")}),
        ([R1], [C1, ("c2", [50.0, 315.0, 300.0, 345.0], "figure", "2")], {("r1", "ambiguous_captions"), ("r1", "unassigned_caption")}),
        ([("a", R1[1], "image", None), ("b", [51.0, 81.0, 301.0, 301.0], "image", None)], [C1], {(r, i) for r in "ab" for i in ("overlapping_regions", "shared_caption_possible_panels")}),
        ([("r1", [-1.0, 0.0, 10.0, 10.0], "unknown", None)], [], {("r1", "invalid_bounds"), ("r1", "unknown_category"), ("r1", "missing_caption"), ("r1", "unassigned_caption")}),
        ([("r1", R1[1], "image", "c9")], [C1], {("r1", "upstream_caption_conflict")}),
    ],
)
def test_rules(spark, regions, captions, want):
    assert {(x.region_id, x.issue) for x in review.review_issues(*page(spark, regions, captions)).collect()} == want


DECISION = "page_id long, region_id string, type string, bbox array<double>, caption_id string, status string, reason string, merge_with array<string>, split_boxes array<array<double>>"
GOOD = (1, "r1", "table", R1[1], "c1", "corrected", "seen", None, None)


@pytest.mark.parametrize(
    "change, want",
    [
        ({}, []), ({1: "zz"}, ["incomplete_coverage", "unknown_or_repeated_region"]), ({4: "c7"}, ["unknown_caption"]), ({3: [0.0, 0.0, float("nan"), 1.0]}, ["invalid_coordinates"]), ({3: [0.0, 0.0, 900.0, 1.0]}, ["invalid_coordinates"]),
        ({2: "blob"}, ["invalid_type"]), ({6: " "}, ["missing_reason"]), ({7: ["r7"]}, ["invalid_merge"]), ({7: ["r1"]}, ["invalid_merge"]), ({8: [R1[1]]}, ["invalid_split"]), ({5: "maybe"}, ["invalid_status"]),
    ],
)
def test_responses(spark, change, want):
    tables = page(spark, [R1], [C1])
    decision = tuple(change.get(k, v) for k, v in enumerate(GOOD))
    verdict = review.validate_responses(spark.createDataFrame([decision], DECISION), *tables)
    assert verdict.collect()[0].broken == want
    kinds = [r.type for r in review.apply_decisions(tables[1], spark.createDataFrame([decision], DECISION), verdict).collect()]
    assert kinds == (["table"] if not want else ["image"])


def test_budget_and_rollup(spark):
    states = spark.createDataFrame([(1, "a", 0, "rule_passed"), (2, "a", 1, "needs_review"), (3, "a", 2, "needs_review")], "page_id long, region_id string, issues int, status string")
    assert [(r.page_id, r.requested) for r in review.select_pages(states, "auto", 1).orderBy("page_id").collect()] == [(1, False), (2, True), (3, False)]
    assert review.select_pages(states, "online", 9).where("requested").count() == 3
    assert [r.status for r in review.rollup(states, ["page_id"]).orderBy("page_id").collect()] == ["rule_passed", "needs_review", "needs_review"]


def test_caches(spark):
    requests = spark.createDataFrame([("k1", 0), ("k2", 1), ("k2", 2), ("k3", 3)], "key string, ordinal int")
    known = spark.createDataFrame([("k3", "yes")], "key string, answer string")
    assert [(r.key, r.ordinal, r.waiting) for r in cache.work_list(requests, known).orderBy("key").collect()] == [("k1", 0, 1), ("k2", 1, 2)]
    assert [r.cache_hit for r in cache.look_up(requests, known).orderBy("ordinal").collect()] == [False, False, False, True]
    entries = spark.createDataFrame([(0, 5), (9000, 7)], "t long, size long").withColumn("ts", F.timestamp_seconds("t"))
    assert cache.live_entries(entries, F.lit(10_000)).count() == 1
    assert tuple(cache.cache_statistics(entries, F.lit(10_000), "size").collect()[0]) == (2, 12, 10_000, 1000)
    backends = spark.createDataFrame([("hybrid", 1, True, ["pdf"]), ("simple", 2, True, None), ("off", 0, False, None)], "name string, priority int, available boolean, formats array<string>")
    formats = spark.createDataFrame([("pdf",), ("html",)], "format string")
    assert {(r.format, r.backend) for r in cache.select_backend(formats, backends).collect()} == {("pdf", "hybrid"), ("html", "simple")}


def test_captions_are_compared_with_kept_ones(spark):
    rows = [("p", f"c{k}", k, [0.0, 8.0 * k, 10.0, 8.0 * k + 10], " same " if k % 2 else "same") for k in range(4)] + [("p", "d", 9, [0.0, 0.0, 10.0, 10.0], "other")]
    kept = review.distinct_captions(spark.createDataFrame(rows, "page_id string, caption_id string, seq int, bbox array<double>, text string"))
    assert sorted(r.caption_id for r in kept.collect()) == ["c0", "c2", "d"]
