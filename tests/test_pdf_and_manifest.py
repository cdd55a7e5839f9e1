"""Provider tables, manifests, review inputs, answers and the nested form, on small examples."""

from pyspark.sql import functions as F

from paperloom import sinks
from paperloom.operators import cache, images, ir, pdf, review


def test_words_take_the_last_span_that_has_them(spark):
    words = spark.createDataFrame([(1, 1, 0, 0, "al", [0.0]), (1, 1, 0, 1, "zz", [0.0])], "doc_id long, page int, block int, word_no int, word string, bbox array<double>")
    spans = spark.createDataFrame([(1, 1, 0, 0, "alpha", "A", 9.0), (1, 1, 0, 1, "also", "B", 8.0)], "doc_id long, page int, block int, span_no int, text string, font string, size double")
    assert {(r.word, r.font) for r in pdf.words_with_fonts(words, spans).collect()} == {("al", "B"), ("zz", None)}


def test_regions(spark):
    pages = spark.createDataFrame([(1, 1, 100.0, 100.0), (1, 2, 100.0, 100.0)], "doc_id long, page_no int, width double, height double")
    rows = [(1, 1, "cluster", [90.0, 90.0, 20.0, 20.0]), (1, 1, "drawing", [0.0, 0.0, 50.0, 50.0]), (1, 1, "raster", [0.0, 0.0, 11.0, 90.0]), (1, 2, "drawing", [0.0, 0.0, 99.0, 50.0])]
    got = {(r.page, r.source, tuple(r.bbox)) for r in pdf.figure_regions(spark.createDataFrame(rows, "doc_id long, page int, source string, bbox array<double>"), pages).collect()}
    assert got == {(1, "cluster", (17.0, 17.0, 93.0, 93.0)), (2, "drawing", (0.0, 0.0, 100.0, 53.0))}


def test_tables_fields_and_structure(spark):
    t = spark.createDataFrame([([[" a ", None], ["1", "2"]],)], "rows array<array<string>>").select(pdf.table_markdown(F.col("rows"))).collect()[0][0]
    assert t == "| a |  |\n|---|---|\n| 1 | 2 |"
    fields = spark.createDataFrame([(1, 0, "x", 7, ["q"], 2), (1, 1, "x", 4, ["q"], 1), (1, 2, "x", 7, None, 0), (1, 3, "x_1", 0, None, 3)], "doc_id long, ordinal int, name string, type_code int, choices array<string>, flags int")
    got = [(r.name, r.type, r.choices, r.required, r.read_only) for r in pdf.form_fields(fields).orderBy("ordinal").collect()]
    assert got == [("x", "text", None, True, False), ("x_1", "listbox", ["q"], False, True), ("x_2", "text", None, False, False), ("x_1_1", "unknown", None, True, True)]
    outline, fonts = spark.createDataFrame([(1, "t")], "doc_id long, title string"), spark.createDataFrame([(1, 0, "B"), (1, 1, "A"), (1, 12, "C"), (2, 0, "Z")], "doc_id long, page_index int, font string")
    assert {(r.doc_id, r.outline_entries, tuple(r.fonts)) for r in pdf.structure(outline, fonts).collect()} == {(1, 1, ("A", "B")), (2, 0, ("Z",))}


def test_scans(spark):
    text = "readable words " * 20
    pages = spark.createDataFrame([(d, 0, 1, t, 10.0, 10.0) for d, t in [(1, text), (2, "x"), (3, text), (4, text), (5, "(cid:1)" * 40 + "abc")]], "doc_id long, page_index int, page_no int, text string, width double, height double")
    fonts = spark.createDataFrame([(3, "Type0", "Identity-H", True, False), (1, "Type0", "Identity-H", True, True)], "doc_id long, subtype string, encoding string, has_descendant boolean, has_to_unicode boolean")
    pictures = spark.createDataFrame([(4, 1, [0.0, 0.0, 10.0, 9.0])], "doc_id long, page int, bbox array<double>")
    assert {(r.doc_id, r.kind) for r in pdf.classify_scans(pages, fonts, pictures).collect()} == {(1, "text"), (2, "ocr"), (3, "ocr"), (4, "ocr"), (5, "ocr")}


def test_scans_broadcast_no_exploded_rows(spark, tmp_path):
    """Twelve pages of documents of a small file, which the planner takes for as few bytes; one document is covered on ten pages."""
    spark.range(2).selectExpr("id AS doc_id").coalesce(1).write.parquet(f"{tmp_path}/ids")
    rows = spark.read.parquet(f"{tmp_path}/ids").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("page_index"))
    pages = rows.selectExpr("doc_id", "page_index", "page_index + 1 AS page_no", "repeat('word ', 30) AS text", "10.0D AS width", "10.0D AS height")
    pictures = rows.where("page_index < 10").selectExpr("doc_id", "page_index + 1 AS page", "array(0.0D, 0.0D, 10.0D, 9.0D * doc_id) AS bbox")
    fonts = rows.selectExpr("doc_id", "'Type1' AS subtype", "'' AS encoding", "false AS has_descendant", "true AS has_to_unicode")
    kinds, cover = pdf.classify_scans(pages, fonts, pictures), pdf.image_coverage(pictures, pages)
    assert not [x for x in (kinds, cover) if "BroadcastExchange" in x._jdf.queryExecution().toString()]
    assert {(r.doc_id, r.kind) for r in kinds.collect()} == {(0, "text"), (1, "ocr")}
    assert {(r.doc_id, r.covered_share) for r in cover.collect()} == {(0, 0.0), (1, 10 / 12)}


def test_manifest(spark):
    rows = spark.createDataFrame([(1, "d/page001_img000_raster.png", 0, 4), (1, "d/page000_img001_cluster.png", 0, 4), (1, "x.png", 1, 9)], "doc_id long, path string, chunk_index int, phys_start int")
    found = images.occurrences(rows)
    assert {(r.estimated_page, r.linked_path) for r in found.collect()} == {(6, "chunk-0-images-2.png"), (5, "chunk-0-images-1.png"), (None, "chunk-1-images-1.png")}
    ordered = images.image_order(found.withColumnRenamed("image_index_in_page", "image_index"))
    assert [r.path[-5] for r in ordered.orderBy("image_no").collect()] == ["r", "r", "x"] and ordered.where("image_no = 1").collect()[0].image_id == "image_0001"
    slots = images.figure_slots(spark.createDataFrame([(1, "Figure 1: a\nFigure 2: b\nFigure 3: c")], "doc_id long, markdown string"))
    matches = spark.createDataFrame([(1, 1, 1, 7, 0.9), (1, 1, 2, 8, 0.2)], "doc_id long, slot_no int, rank int, image_no int, score double")
    near = spark.createDataFrame([(1, 7, 1), (1, 7, 2)], "doc_id long, member int, group_no int")
    assert {(r.image_no, r.near_group) for r in images.groups_of_candidates(matches, near).collect()} == {(7, 2), (8, None)}
    template = images.mapping_template(slots, matches)
    assert template.count() == 3 and [(r.slot_id, r.image_no, r.status) for r in images.decision_example(template).orderBy("slot_id").collect()] == [("slot_0001", 7, "matched"), ("slot_0002", None, "unmatched")]
    assert tuple(images.manifest_totals(rows, rows.limit(2), near).collect()[0]) == (1, 3, 2, 2)
    files = spark.createDataFrame([("a.png", 5), ("b.txt", 5), ("c.png", 30 << 20)], "path string, length long")
    assert [r.path for r in images.readable_images(files).collect()] == ["a.png"]


def test_review_inputs(spark):
    box = lambda d: [0.0 + d, 0.0, 100.0 + d, 100.0]
    regions = spark.createDataFrame([(1, "a", 0, box(0)), (1, "b", 1, box(0.5)), (1, "c", 2, box(1.5)), (2, "d", 0, box(0))], "page_id long, region_id string, seq int, bbox array<double>")
    assert {r.region_id for r in review.distinct_regions(regions).collect()} == {"a", "c", "d"} or {r.region_id for r in review.distinct_regions(regions).collect()} == {"a", "d"}
    lines = spark.createDataFrame([(1, 0, box(0), "Figure 1: x"), (1, 1, box(5), " Figure 1: x "), (1, 2, box(500), "Figure 1: x"), (1, 3, box(0), "text")], "page_id long, seq int, bbox array<double>, text string")
    captions = review.captions_of_texts(lines)
    assert captions.count() == 3 and {r.seq for r in review.distinct_captions(captions).collect()} == {0, 2}
    own = spark.createDataFrame([(1, "r", "see Figure 1: x here"), (1, "q", "none")], "page_id long, region_id string, caption string")
    assert {(r.region_id, r.caption_id) for r in review.upstream_captions(own, captions).collect()} == {("r", "c1"), ("q", None)}
    pages, done = spark.createDataFrame([(1, 1), (1, 2)], "doc_id long, page_no int"), spark.createDataFrame([(1, [2, 2, 9])], "doc_id long, processed_pages array<int>")
    assert [r.page_no for r in review.pages_in_range(pages, done).collect()] == [2]


def test_answers_are_asked_once(spark):
    requests = spark.createDataFrame([(0, "a", "q", b"1"), (1, "b", "q", b"2"), (2, "a", "q", b"1"), (3, "c", "bad", b"3")], "ordinal int, key string, question string, content binary")
    known = spark.createDataFrame([("b", "known")], "key string, answer string")
    got = cache.answer(requests, known, lambda question, content: "Error: no" if question == "bad" else content.decode()).orderBy("ordinal").collect()
    assert [(r.answer, r.cache_hit, r.error) for r in got] == [("1", False, None), ("known", True, None), ("1", False, None), (None, False, "Error: no")]
    assert cache.answer(requests, known).where("error = 'Error: not configured'").count() == 3
    assert cache.with_defaults(spark.createDataFrame([(None, ["w", "w"])], "x string, warnings array<string>"), {"x": "d", "y": 1}).collect()[0] == ("d", ["w"], 1)


def test_nested_form_and_quality(spark):
    blocks = spark.createDataFrame([(1, 0, "section", 1, "A"), (1, 1, "text", None, "B")], "doc_id long, seq long, type string, page int, content string")
    nested = sinks.nested_documents(spark.createDataFrame([(1, 2)], "doc_id long, page_count int"), blocks)
    rows = ir.from_nested(nested).select("seq", "block_id", F.get_json_object("body", "$.content").alias("c")).orderBy("seq").collect()
    assert [tuple(r) for r in rows] == [(0, "block_00000000", "A"), (1, "block_00000001", "B")]
    odd = spark.createDataFrame([(1, '{"blocks":{"x":{}},"reading_order":["gone","x"]}')], "doc_id long, json string")
    assert [(r.block_id, r.body) for r in ir.from_nested(odd).orderBy("seq").collect()] == [("gone", None), ("x", "{}")]
    states = spark.createDataFrame([(None, "warn", "ok", None, ["w"]), (None, None, "unreadable", None, None), ("ok", "warn", None, True, None)], "payload_state string, metadata_state string, computed_state string, requires_ocr boolean, warnings array<string>")
    assert [(r.state, r.requires_ocr, r.warnings) for r in ir.resolved_quality(states).collect()] == [("warn", False, ["w", "text quality: warn"]), ("unreadable", True, ["text quality: unreadable"]), ("ok", True, [])]
