"""Queries over what is made of documents: artefacts, plans and merges, images, review, caches and answers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import sinks
from ..functions import text as T
from ..operators import cache, images, ir, review
from ..plans import chunks, merge, ranges
from ..sources import decoders
from . import geometry
from .catalog import blocks
from .registry import query, table

_BLOCKS = """block AS (SELECT conv_id AS doc_id, turn AS seq, CASE WHEN role = 'assistant' THEN 'paragraph' ELSE 'section' END AS type, CASE WHEN turn <> 3 THEN CAST(turn // 2 AS INTEGER) + 1 END AS page,
    CASE WHEN role = 'system' THEN 1 WHEN role = 'user' THEN 1 + CAST(turn % 3 AS INTEGER) END AS level, text AS content FROM conversations)"""


def parts(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), "p_name", "p_brand", "p_size")


def turns(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("turn"), "role", "text")


# -- artefacts --------------------------------------------------------------------------------------------------------------


@query("q77_run_names", "SELECT p_partkey AS doc_id, regexp_replace(p_name || ' é ' || p_brand, '[^a-zA-Z0-9_-]', '_', 'g') || '_20240102_030405_' || substring(sha256(CAST(p_partkey AS VARCHAR)), 1, 12) AS name FROM part")
def q77(spark, d):
    path = F.concat(F.lit("/a.b/"), "p_name", F.lit(" é "), "p_brand", F.lit(".pdf"))
    return parts(spark, d).select("doc_id", sinks.run_name(path, F.lit("2024-01-02 03:04:05").cast("timestamp"), F.col("doc_id")).alias("name"))


@query(
    "q78_nested_documents",
    f"""WITH {_BLOCKS} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS BIGINT) AS seq, printf('block_%08x', seq) AS block_id, type, page, content, CAST(doc_id % 5 AS INTEGER) AS page_count FROM block
    UNION ALL SELECT doc_id, CAST(count(*) AS BIGINT), 'block_ffffffff', NULL, NULL, NULL, CAST(doc_id % 5 AS INTEGER) FROM block GROUP BY doc_id""",
)
def q78(spark, d):
    """Written as nested documents and read back; an id that no block has renders nothing."""
    rows = blocks(spark, d)
    documents = rows.select("doc_id").distinct().select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("doc_id") % 5).cast("int").alias("page_count"))
    nested = sinks.nested_documents(documents, rows)
    nested = nested.withColumn("json", F.regexp_replace("json", r'\]\}$', r',"block_ffffffff"]}'))
    body = lambda key, kind: F.get_json_object("body", f"$.{key}").cast(kind).alias(key)
    out = ir.from_nested(nested).join(nested.select("doc_id", F.get_json_object("json", "$.source.page_count").cast("int").alias("page_count")), "doc_id")
    return out.select("doc_id", "seq", "block_id", body("type", "string"), body("page", "int"), body("content", "string"), "page_count")


@query("q79_metadata", "SELECT p_partkey AS doc_id, CASE WHEN p_size % 2 = 0 THEN 'author,title' ELSE 'title' END AS keys, CAST(CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 0.9 END AS DOUBLE) AS confidence FROM part")
def q79(spark, d):
    entries = F.create_map(F.lit("title"), F.col("p_name"), F.lit("pages"), F.lit("9"), F.when(F.col("p_size") % 2 == 0, "author").otherwise("other"), F.col("p_brand"))
    rows = parts(spark, d).select("doc_id", F.array_join(F.array_sort(F.map_keys(ir.kept_metadata(entries))), ",").alias("keys"))
    default, given = ir.with_confidence(rows.where("doc_id % 3 <> 0")), ir.with_confidence(rows.where("doc_id % 3 = 0").withColumn("confidence", F.lit(None).cast("double")))
    return default.withColumn("confidence", F.col("confidence").cast("double")).unionByName(given)


@query("q80_output_markdown", "SELECT p_partkey AS doc_id, CASE WHEN p_size % 3 = 0 THEN 'native ' || p_brand ELSE '# ' || p_name END AS markdown FROM part")
def q80(spark, d):
    rows = parts(spark, d)
    rendered = ir.render_markdown(rows.select("doc_id", F.lit(0).alias("seq"), F.lit("section").alias("type"), F.lit(1).alias("page"), F.lit(1).alias("level"), F.col("p_name").alias("content")))
    return sinks.output_markdown(rendered, rows.where("p_size % 3 = 0").select("doc_id", F.concat(F.lit("native "), "p_brand").alias("native")))


@query(
    "q81_index_json",
    f"""WITH {_BLOCKS} SELECT doc_id, CAST(count(CASE WHEN type = 'section' THEN 1 END) AS INTEGER) AS sections, CAST(sum(CASE WHEN type = 'section' THEN coalesce(level, 1) ELSE 0 END) AS BIGINT) AS levels, 3 AS pages, CAST(count(CASE WHEN page IS NULL THEN 1 END) AS INTEGER) AS unlocated,
    CAST(count(CASE WHEN page = 1 THEN 1 END) AS BIGINT) AS on_first FROM block GROUP BY doc_id""",
)
def q81(spark, d):
    rows = blocks(spark, d)
    done = sinks.index_json(rows.select("doc_id").distinct().withColumn("page_count", F.lit(3)), rows)
    part = F.from_json("json", "sections array<struct<level:int>>, pages array<struct<page:int,n_blocks:bigint>>, unlocated_block_ids array<string>")
    levels = F.aggregate(part["sections"], F.lit(0).cast("long"), lambda n, x: n + x["level"])
    first = F.filter(part["pages"], lambda x: x["page"] == 1)
    return done.select("doc_id", F.size(part["sections"]).alias("sections"), levels.alias("levels"), F.size(part["pages"]).alias("pages"), F.size(part["unlocated_block_ids"]).alias("unlocated"), F.get(first, F.lit(0))["n_blocks"].cast("long").alias("on_first"))


@query(
    "q82_run_summary",
    """SELECT p_partkey AS doc_id, CASE WHEN p_size % 4 = 0 THEN 'failed' WHEN p_size % 4 = 1 THEN 'partial' ELSE 'complete' END AS status, p_size % 4 > 1 AS success, CASE WHEN p_size % 4 = 0 THEN 1 WHEN p_size % 4 = 1 THEN 2 ELSE 0 END AS exit_code,
    CASE WHEN p_size % 4 = 0 THEN 'No requested content was processed successfully.' END AS error, p_size AS chunk_count, CASE WHEN p_size % 4 = 1 THEN 1 ELSE 0 END AS chunk_failure_count, p_size % 8 = 0 AS all_chunks_failed FROM part""",
)
def q82(spark, d):
    k = F.col("p_size") % 4
    rows = parts(spark, d).select("doc_id", (k != 0).alias("success"), (F.col("p_size") % 8 == 0).alias("all_chunks_failed"), F.when(k == 1, 1).otherwise(0).alias("chunk_failure_count"), F.col("p_size").alias("chunk_count"), F.col("p_name").alias("secret_body"))
    return sinks.run_summary(rows)


@query("q83_structural_toc", "SELECT p_partkey AS doc_id, CAST(k + 1 AS INTEGER) AS chunk_index, printf('chunk_%04d', k) AS title, 1 AS level, CAST(k * 4 + 1 AS INTEGER) AS first_page, CAST(least(k * 4 + 4, p_size) AS BIGINT) AS last_page FROM part, (SELECT unnest(generate_series(0, 20)) AS k) WHERE k * 4 < p_size")
def q83(spark, d):
    return sinks.structural_toc(chunks.plan_fixed(parts(spark, d).select("doc_id", F.col("p_size").alias("page_count")), 4))


@query(
    "q84_manifest",
    """WITH i AS (SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS turn, CASE WHEN turn % 2 = 0 THEN 9 - turn // 2 END AS est, 'p' || (9 - turn) AS path, sha256(role) AS checksum FROM conversations),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(est, 3) ASC NULLS LAST, turn % 2, turn, path) AS no FROM i), g AS (SELECT doc_id, count(*) AS unique_images FROM (SELECT DISTINCT doc_id, checksum FROM i) GROUP BY doc_id)
    SELECT o.doc_id, CAST(count(*) AS BIGINT) AS raw_images, any_value(unique_images) AS unique_images, CAST(0 AS BIGINT) AS near_groups, string_agg(printf('image_%04d', no) || '=' || path, ',' ORDER BY no) AS images FROM o JOIN g ON g.doc_id = o.doc_id GROUP BY o.doc_id""",
)
def q84(spark, d):
    turn = F.col("turn")
    rows = turns(spark, d).select("doc_id", F.concat(F.lit("p"), (9 - turn).cast("string")).alias("path"), F.lit(2).alias("phys_start"), F.when(turn % 2 == 0, 9 - F.floor(turn / 2)).cast("int").alias("estimated_page"), (turn % 2).alias("page_in_chunk"), turn.alias("image_index"), turn.alias("ordinal"), F.sha2("role", 256).alias("checksum"), F.lit("raster").alias("kind"), F.lit("x").alias("label"), F.lit(None).cast("long").alias("phash"))
    ordered, groups = images.image_order(rows), images.exact_groups(rows)
    near = groups.limit(0).select("doc_id", F.lit(0).alias("group_no"))
    totals = images.manifest_totals(rows, groups, near)
    done = sinks.manifest_json(ordered, groups, totals)
    body = F.from_json("json", "raw_images bigint, unique_images bigint, near_groups bigint, images array<struct<image_no:int,image_id:string,path:string>>")
    listed = F.array_join(F.transform(body["images"], lambda x: F.concat(x["image_id"], F.lit("="), x["path"])), ",")
    return done.select("doc_id", body["raw_images"].alias("raw_images"), body["unique_images"].alias("unique_images"), body["near_groups"].alias("near_groups"), listed.alias("images"))


@query("q85_linked_paths", "SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS chunk_index, 'chunk-' || turn || '-images-' || k || CASE k WHEN 1 THEN '.png' ELSE '.jpg' END AS linked_path, CAST(turn * 10 + k + 1 AS INTEGER) AS estimated_page, CASE k WHEN 1 THEN 'raster' ELSE 'vector_region' END AS kind FROM conversations, (VALUES (1), (2)) AS v(k)")
def q85(spark, d):
    names = F.array(F.lit("a/page1_img1_raster.PNG"), F.lit("b/page2_img7_cluster.jpg"))
    rows = turns(spark, d).select("doc_id", F.col("turn").alias("chunk_index"), (F.col("turn") * 10).alias("phys_start"), F.explode(names).alias("path"))
    return images.occurrences(rows).select("doc_id", "chunk_index", "linked_path", "estimated_page", "kind")


@query("q86_native_files", "SELECT p_partkey AS doc_id, 'middle_json' AS name, p_name AS payload FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, 'content_list', p_brand FROM part")
def q86(spark, d):
    return sinks.native_files(parts(spark, d).select("doc_id", F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("middle_json"), F.col("p_brand").alias("content_list")))


@query("q87_adapter", "SELECT p_partkey AS doc_id, CAST(0 AS BIGINT) AS seq, 'text' AS type, CASE WHEN p_size % 2 = 0 THEN 1 END AS page, p_name AS content, CAST(NULL AS VARCHAR) AS path FROM part UNION ALL SELECT p_partkey, 1 + k, 'image', CASE WHEN p_size % 2 = 0 THEN 4 + k END, NULL, 'i' || k FROM part, (VALUES (0), (1)) AS v(k)")
def q87(spark, d):
    """Native blocks with pages for PDF files, one body of unknown page for others, and images after all text."""
    rows = parts(spark, d)
    bodies = rows.select("doc_id", F.when(F.col("p_size") % 2 == 0, "pdf").otherwise("word").alias("format"), F.col("p_name").alias("content"))
    native = rows.where("p_size % 2 = 0").select("doc_id", F.lit(0).cast("long").alias("seq"), F.lit(1).alias("page"), F.array(F.lit(0.0)).alias("bbox"), F.col("p_name").alias("content"))
    pictures = rows.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("ordinal")).select("doc_id", "ordinal", (F.col("ordinal") + 3).alias("page"), F.concat(F.lit("i"), F.col("ordinal").cast("string")).alias("path"), F.lit("c").alias("caption"))
    return decoders.adapted(bodies, native, pictures).select("doc_id", "seq", "type", "page", "content", "path")


@query("q88_result_json", """SELECT p_partkey AS doc_id, '{"title":"' || p_name || '","text_content":"' || p_brand || '","sections":[' || CASE WHEN p_size % 2 = 0 THEN '"s"' ELSE '' END || ']' || CASE WHEN p_size % 2 = 0 THEN ',"form_fields":["f"]' ELSE '' END || CASE WHEN p_size % 5 = 0 THEN ',"error":"e"' ELSE '' END || '}' AS json FROM part""")
def q88(spark, d):
    even, none = F.col("p_size") % 2 == 0, F.array().cast("array<string>")
    rows = parts(spark, d).select("doc_id", F.col("p_name").alias("title"), F.col("p_brand").alias("text_content"), F.when(even, F.array(F.lit("s"))).otherwise(none).alias("sections"), F.when(even, F.array(F.lit("f"))).otherwise(none).alias("form_fields"), F.when(F.col("p_size") % 5 == 0, "e").alias("error"), F.array(F.lit("i")).alias("images"))
    return decoders.result_json(rows)


@query(
    "q89_mapping_template",
    """SELECT p_partkey AS doc_id, printf('slot_%04d', k) AS slot_id, CAST(k AS INTEGER) AS figure_no, CASE WHEN k = 1 THEN '2,1' ELSE '' END AS candidates, 'pending' AS status, CASE WHEN k = 1 THEN 2 END AS chosen, CASE k WHEN 1 THEN 'matched' WHEN 2 THEN 'unmatched' END AS example, CASE WHEN k = 1 THEN 2 END AS near_group
    FROM part, (VALUES (1), (2), (3)) AS v(k)""",
)
def q89(spark, d):
    rows = parts(spark, d)
    slots = rows.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("slot_no")).select("doc_id", "slot_no", F.format_string("slot_%04d", "slot_no").alias("slot_id"), F.col("slot_no").alias("figure_no"), F.lit("c").alias("caption"))
    matches = rows.select("doc_id", F.lit(1).alias("slot_no"), F.explode(F.array(F.struct(F.lit(1).alias("rank"), F.lit(2).alias("image_no"), F.lit(0.9).alias("score")), F.struct(F.lit(2).alias("rank"), F.lit(1).alias("image_no"), F.lit(0.2).alias("score")))).alias("x")).select("doc_id", "slot_no", "x.*")
    groups = rows.select("doc_id", F.explode(F.array(*[F.struct(F.lit(g).alias("group_no"), F.lit(m).alias("member")) for g, m in ((1, 2), (2, 2), (1, 5))])).alias("x")).select("doc_id", "x.*")
    template = images.mapping_template(slots, matches)
    example = images.decision_example(template).select("doc_id", "slot_id", F.col("image_no").alias("chosen"), F.col("status").alias("example"))
    near = images.groups_of_candidates(matches, groups).where("rank = 1").select("doc_id", F.format_string("slot_%04d", "slot_no").alias("slot_id"), "near_group")
    out = template.join(example, ["doc_id", "slot_id"], "left").join(near, ["doc_id", "slot_id"], "left")
    return out.select("doc_id", "slot_id", "figure_no", F.array_join(F.transform("candidates", lambda x: x["image_no"].cast("string")), ",").alias("candidates"), "status", "chosen", "example", "near_group")


@query("q90_image_files", "SELECT p_partkey AS doc_id, CASE p_size % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' ELSE 'image/webp' END AS mime, regexp_replace(p_name, '[^\\p{L}\\p{N}_-]', '_', 'g') AS stem FROM part WHERE p_size <= 20")
def q90(spark, d):
    k = F.col("p_size") % 3
    path = F.concat(F.lit("/x/a b"), F.when(k == 0, ".PNG").when(k == 1, ".jpg").otherwise(".webp"))
    rows = parts(spark, d).select("doc_id", "p_name", path.alias("path"), (F.col("p_size") * 1024 * 1024).cast("long").alias("length"))
    return images.readable_images(rows).select("doc_id", T.image_type("path").alias("mime"), T.safe_stem("p_name").alias("stem"))


@query("q91_analysis_markdown", "SELECT p_partkey AS ordinal, '# Image analysis' || chr(10) || chr(10) || '**Image:** i.png' || chr(10) || chr(10) || '**Question:** ' || p_name || chr(10) || chr(10) || CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'Error: none' END AS markdown FROM part")
def q91(spark, d):
    even = F.col("p_size") % 2 == 0
    rows = parts(spark, d).select(F.col("doc_id").alias("ordinal"), F.lit("i.png").alias("path"), F.col("p_name").alias("question"), F.when(even, F.col("p_brand")).alias("answer"), F.when(~even, "none").alias("error"))
    return cache.analysis_markdown(rows)


@query("q92_envelope", "SELECT p_partkey AS doc_id, CASE WHEN p_size % 2 = 0 THEN 'ok' ELSE 'unknown' END AS state, true AS offline, CASE WHEN p_size % 3 = 0 THEN '' ELSE 'b,a' END AS warnings FROM part")
def q92(spark, d):
    rows = parts(spark, d).select("doc_id", F.when(F.col("p_size") % 2 == 0, "ok").alias("state"), F.when(F.col("p_size") % 3 != 0, F.array(F.lit("b"), F.lit("a"), F.lit("b"))).alias("warnings"))
    return cache.with_defaults(rows, {"state": "unknown", "offline": True}).select("doc_id", "state", "offline", F.array_join("warnings", ",").alias("warnings"))


@query(
    "q93_render_kinds",
    """SELECT p_partkey AS doc_id, '1. ' || p_name || chr(10) || '2. b' || chr(10) || '- ' || p_brand || chr(10) || chr(10) || '![cap](i.png)' || chr(10) || chr(10) || '**Image**' || chr(10) || chr(10) || '**Table:** T' || chr(10) || chr(10) || '| a |' || chr(10) || chr(10) || '$$x^' || p_size || '$$ \\[7\\]' || chr(10) || chr(10) || '$y$' || chr(10) || chr(10) || 'other' || chr(10) || chr(10) || '**only caption**' AS markdown FROM part""",
)
def q93(spark, d):
    names = ["type", "items", "ordered", "path", "caption", "markdown", "latex", "number", "content"]
    kinds = ["string", "array<string>", "boolean", "string", "string", "string", "string", "string", "string"]
    rows = [
        {"type": F.lit("list"), "items": F.array(F.col("p_name"), F.lit("b")), "ordered": F.lit(True)}, {"type": F.lit("list"), "items": F.array("p_brand")}, {"type": F.lit("image"), "path": F.lit("i.png"), "caption": F.lit("cap")},
        {"type": F.lit("image")}, {"type": F.lit("table"), "caption": F.lit("T"), "markdown": F.lit("| a |")}, {"type": F.lit("display_formula"), "latex": F.concat(F.lit("x^"), F.col("p_size").cast("string")), "number": F.lit("7")},
        {"type": F.lit("inline_formula"), "latex": F.lit("y")}, {"type": F.lit("footnote"), "content": F.lit("other")}, {"type": F.lit("chart"), "caption": F.lit("only caption")}, {"type": F.lit("list"), "items": F.array().cast("array<string>")},
    ]
    each = [F.struct(F.lit(k).alias("seq"), *[r.get(n, F.lit(None)).cast(t).alias(n) for n, t in zip(names, kinds, strict=True)]) for k, r in enumerate(rows)]
    return ir.render_markdown(parts(spark, d).select("doc_id", F.explode(F.array(*each)).alias("x")).select("doc_id", F.lit(1).alias("page"), "x.*"))


@query(
    "q94_text_and_quality",
    f"""WITH {_BLOCKS}, t AS (SELECT doc_id, string_agg(content, chr(10) ORDER BY seq) AS text FROM block WHERE content IS NOT NULL GROUP BY doc_id),
    s AS (SELECT doc_id, md5(text) AS digest, CASE doc_id % 3 WHEN 0 THEN 'warn' WHEN 1 THEN 'unreadable' ELSE 'ok' END AS state FROM t) SELECT doc_id, digest, state, CASE WHEN doc_id % 6 = 1 THEN false ELSE state = 'unreadable' END AS requires_ocr, CASE WHEN state = 'ok' THEN 'w' ELSE 'w,text quality: ' || state END AS warnings FROM s""",
)
def q94(spark, d):
    k = F.col("doc_id") % 3
    rows = ir.text_of(blocks(spark, d)).select("doc_id", F.md5("text").alias("digest"), F.when(k == 0, "warn").alias("payload_state"), F.when(k == 1, "unreadable").when(k == 0, "ok").alias("metadata_state"), F.lit("ok").alias("computed_state"), F.when(F.col("doc_id") % 6 == 1, F.lit(False)).alias("requires_ocr"), F.array(F.lit("w")).alias("warnings"))
    return ir.resolved_quality(rows).select("doc_id", "digest", "state", "requires_ocr", F.array_join("warnings", ",").alias("warnings"))


# -- plans and merges -------------------------------------------------------------------------------------------------------


@query(
    "q95_small_chapters",
    """SELECT p_partkey AS doc_id, CAST(k AS INTEGER) AS chunk_idx, CASE k WHEN 0 THEN 1 WHEN 1 THEN 6 ELSE 9 END AS phys_start, CAST(CASE k WHEN 0 THEN 5 WHEN 1 THEN 8 ELSE p_size + 11 END AS INTEGER) AS phys_end, CASE k WHEN 0 THEN 'c1 / c2' WHEN 1 THEN 'c3' ELSE 'c4' END AS title,
    CAST(CASE k WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE least(64, p_size + 3) END AS INTEGER) AS batch_size FROM part, (VALUES (0), (1), (2)) AS v(k)""",
)
def q95(spark, d):
    """A chapter of one page joins the one before, and goes if there is none."""
    rows = parts(spark, d).select("doc_id", (F.col("p_size") + 12).alias("page_count"))
    chapters = rows.select("doc_id", F.posexplode(F.array(*map(F.lit, (0, 1, 5, 6, 9)))).alias("seq", "phys_index")).select("doc_id", "seq", F.lit(1).alias("level"), F.concat(F.lit("c"), F.col("seq").cast("string")).alias("title"), "phys_index")
    return chunks.plan_chapters(rows, chapters, 0, 2).select("doc_id", "chunk_idx", "phys_start", "phys_end", "title", "batch_size")


@query(
    "q96_plan_modes",
    """WITH p AS (SELECT p_partkey AS doc_id, p_size AS n, p_partkey % 3 AS k FROM part), c AS (
    SELECT doc_id, n, 'auto' AS mode, 0 AS chunk_idx, 0 AS a, 2147483647 AS b FROM p WHERE n <= 30 UNION ALL SELECT doc_id, n, 'auto', 0, 0, CASE WHEN k = 0 THEN 12 ELSE n - 1 END FROM p WHERE n > 30 UNION ALL SELECT doc_id, n, 'auto', 1, 10, n - 1 FROM p WHERE n > 30 AND k = 0
    UNION ALL SELECT doc_id, n, 'ten', CAST(i AS INTEGER), CAST(i * 10 AS INTEGER), CAST(least(i * 10 + 9, n - 1) AS INTEGER) FROM p, (SELECT unnest(generate_series(0, 9)) AS i) WHERE i * 10 < n UNION ALL SELECT doc_id, n, 'off', 0, 0, 2147483647 FROM p)
    SELECT doc_id, mode, CAST(chunk_idx AS INTEGER) AS chunk_idx, CAST(greatest(a, 2) AS INTEGER) AS phys_start, CAST(least(b, 14) AS INTEGER) AS phys_end FROM c WHERE greatest(a, 2) <= least(b, 14)""",
)
def q96(spark, d):
    """The planner's modes, cut to pages 2 to 14; a third of the documents has chapters."""
    rows = parts(spark, d).select("doc_id", F.col("p_size").alias("page_count"), F.lit(2).alias("range_start"), F.lit(14).alias("range_end"))
    chapters = rows.where("doc_id % 3 = 0").select("doc_id", F.posexplode(F.array(F.lit(0), F.lit(10))).alias("seq", "phys_index")).select("doc_id", "seq", F.lit(1).alias("level"), F.lit("c").alias("title"), "phys_index")
    out = None
    for mode, split, toc in (("auto", "auto", chapters), ("ten", 10, None), ("off", None, chapters)):
        own = chunks.plan(rows, toc, split, 3).select("doc_id", F.lit(mode).alias("mode"), "chunk_idx", "phys_start", "phys_end")
        out = own if out is None else out.unionByName(own)
    return out


@query(
    "q97_toc_chain",
    """SELECT p_partkey AS doc_id, CASE p_partkey % 3 WHEN 0 THEN 'labels' WHEN 1 THEN 'minus_one' ELSE 'text_scan' END AS mode, CAST(CASE WHEN p_partkey % 3 = 2 THEN 1 ELSE 2 END AS BIGINT) AS chapters, CASE p_partkey % 3 WHEN 0 THEN '3,7' WHEN 1 THEN '0,4' ELSE '1' END AS pages, CAST(CASE p_partkey % 3 WHEN 0 THEN 0.95 WHEN 1 THEN 0.0 ELSE 0.3 END AS DOUBLE) AS confidence FROM part""",
)
def q97(spark, d):
    """Chapters by page labels, by the logical page less one where nothing is found, and from headings where there is no table."""
    k, rows = F.col("doc_id") % 3, parts(spark, d)
    toc = rows.where(k != 2).select("doc_id", F.posexplode(F.array(F.lit(1), F.lit(5))).alias("seq", "logical_page")).select("doc_id", "seq", F.lit(1).alias("level"), F.lit("Qqq zzz").alias("title"), "logical_page")
    pages = rows.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("page_index")).select("doc_id", "page_index", F.when(k == 0, (F.col("page_index") - 2).cast("string")).alias("label"), F.when((k == 2) & (F.col("page_index") == 1), "Chapter 1 of it").otherwise("text").alias("text"))
    done = ranges.resolve_toc(toc, pages)
    own = done.groupBy("doc_id", "mode").agg(F.count("*").alias("chapters"), F.array_join(F.transform(F.array_sort(F.collect_list("phys_index")), lambda x: x.cast("string")), ",").alias("pages"), F.max("confidence").cast("double").alias("confidence"))
    return own


@query("q98_label_confidence", "SELECT p_partkey AS doc_id, CAST(p_size % 4 AS BIGINT) AS label_hits, CAST(3 AS BIGINT) AS chapters, least(1.0, 0.45 + 0.5 * (p_size % 4) / 3) AS confidence FROM part WHERE p_size % 4 < 4")
def q98(spark, d):
    rows = parts(spark, d).select("doc_id", "p_size", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k")).select("doc_id", (F.col("k") <= F.col("p_size") % 4).alias("is_label_hit"))
    return ranges.label_confidence(rows)


@query("q99_processed_pages", "SELECT p_partkey AS doc_id, CAST(least(k * 20, p_size - 1) AS INTEGER) AS phys_start, CAST(greatest(least(k * 20, p_size - 1), least(k * 20 + 19, p_size - 1)) AS INTEGER) AS phys_end, CAST(least(k * 20, p_size - 1) + 6 AS INTEGER) AS page, CAST(greatest(least(k * 20, p_size - 1), least(k * 20 + 19, p_size - 1)) - least(k * 20, p_size - 1) + 1 AS INTEGER) AS pages FROM part, (VALUES (0), (1)) AS v(k)")
def q99(spark, d):
    rows = parts(spark, d)
    own = rows.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).select("doc_id", (F.col("k") * 20).alias("phys_start"), (F.col("k") * 20 + 19).alias("phys_end"))
    done = merge.processed_pages(own, rows.select("doc_id", F.col("p_size").alias("page_count")))
    return ranges.page_offset(done.withColumn("page", F.lit(6)), F.col("phys_start")).select("doc_id", "phys_start", "phys_end", "page", F.size("processed_pages").alias("pages"))


@query(
    "q100_merge_by_pages",
    """SELECT p_partkey AS doc_id, '---' || chr(10) || '# one  (pages 1–2)' || chr(10) || chr(10) || p_name || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'shared' || chr(10) || chr(10) || chr(10) || '---' || chr(10) || '# two  (pages 2–3)' || chr(10) || chr(10) || p_brand
    || chr(10) || chr(10) || chr(10) || '---' || chr(10) || '## [three] (processing failed)' || chr(10) || chr(10) || 'Error: bad' || chr(10) || chr(10) || chr(10) || chr(10) || '---' || chr(10) || '# four  (pages 5–5)' || chr(10) || chr(10) || 'native' AS markdown FROM part""",
)
def q100(spark, d):
    """Pages that an earlier chunk has are left out of the later one, which is rendered anew; native Markdown stays as it is."""
    rows = parts(spark, d)
    kinds = [(0, "one", 0, 1, None), (1, "two", 1, 2, None), (2, "three", 3, 3, "bad"), (3, "four", 4, 4, None)]
    each = [F.struct(F.lit(k).alias("chunk_idx"), F.lit(t).alias("title"), F.lit(a).alias("phys_start"), F.lit(b).alias("phys_end"), F.lit(e).cast("string").alias("error"), F.lit("native").alias("markdown")) for k, t, a, b, e in kinds]
    results = rows.select("doc_id", F.explode(F.array(*each)).alias("x")).select("doc_id", "x.*")
    items = [(0, 0, 1, F.col("p_name")), (0, 1, 2, F.lit("shared")), (1, 0, 2, F.lit("shared")), (1, 1, 3, F.col("p_brand")), (2, 0, 4, F.lit("lost"))]
    own = [F.struct(F.lit(k).alias("chunk_idx"), F.lit(s).alias("seq"), F.lit("paragraph").alias("type"), F.lit(p).alias("page"), c.alias("content")) for k, s, p, c in items]
    return merge.merge_markdown(results, rows.select("doc_id", F.explode(F.array(*own)).alias("x")).select("doc_id", "x.*"))


@query(
    "q101_merge_documents",
    """SELECT p_partkey AS doc_id, p_brand AS author, CAST(greatest(20, p_size) AS INTEGER) AS page_count, '1,2,3,5' AS processed, 's0,s1,s2' AS sections FROM part""",
)
def q101(spark, d):
    rows = parts(spark, d)
    none = F.create_map().cast("map<string,string>")
    each = [F.struct(F.lit(k).alias("chunk_idx"), F.lit(e).alias("phys_end"), (F.create_map(F.lit("author"), F.col("p_brand")) if k == 1 else none).alias("metadata"), F.col("p_size").alias("page_count"), F.array(*map(F.lit, p)).alias("processed_pages")) for k, e, p in ((0, 9, (1, 2)), (1, 19, (3, 2, 5)))]
    done = merge.merge_documents(rows.select("doc_id", F.explode(F.array(*each)).alias("x")).select("doc_id", "x.*"))
    notes = rows.select("doc_id", F.explode(F.array(F.struct(F.lit(1).alias("chunk_idx"), F.array(F.lit("s2")).alias("items")), F.struct(F.lit(0).alias("chunk_idx"), F.array(F.lit("s0"), F.lit("s1")).alias("items")))).alias("x")).select("doc_id", F.lit("sections").alias("kind"), "x.*")
    out = done.join(merge.merge_annotations(notes), "doc_id")
    return out.select("doc_id", F.get_json_object("metadata", "$.author").alias("author"), F.col("page_count").cast("int").alias("page_count"), F.array_join(F.transform("processed_pages", lambda x: x.cast("string")), ",").alias("processed"), F.array_join("items", ",").alias("sections"))


# -- review -----------------------------------------------------------------------------------------------------------------


def _review(spark, d):
    return geometry.tables(table(spark, d, "lineitem"))


@query("q102_pages_in_range", f"WITH {geometry.SQL} SELECT DISTINCT page_id % 50 AS doc_id, page_id AS page_no FROM region WHERE page_id % 3 <> 0")
def q102(spark, d):
    _, regions, _ = _review(spark, d)
    pages = regions.select((F.col("page_id") % 50).alias("doc_id"), F.col("page_id").alias("page_no")).distinct()
    wanted = pages.where("page_no % 3 <> 0").groupBy("doc_id").agg(F.concat(F.collect_list("page_no"), F.collect_list("page_no"), F.array(F.lit(-5).cast("long"))).alias("processed_pages"))
    return review.pages_in_range(pages, wanted)


@query("q103_region_dedup", f"WITH {geometry.SQL} SELECT page_id, 'r' || n AS region_id, CAST(n AS INTEGER) AS seq FROM region UNION ALL SELECT page_id, 's' || n, CAST(n + 200 AS INTEGER) FROM region WHERE (x1 - x0) < 150")
def q103(spark, d):
    """Nearly equal copies go; copies moved by three points stay where the region is small."""
    _, regions, _ = _review(spark, d)
    b = F.col("bbox")
    same = regions.select("page_id", F.concat(F.lit("x"), "region_id").alias("region_id"), (F.col("seq") + 100).alias("seq"), F.array(b[0], b[1], b[2] + 0.01, b[3]).alias("bbox"))
    moved = regions.where(b[2] - b[0] < 150).select("page_id", F.concat(F.lit("s"), F.substring("region_id", 2, 9)).alias("region_id"), (F.col("seq") + 200).alias("seq"), F.array(b[0] + 3, b[1] + 3, b[2] + 3, b[3] + 3).alias("bbox"))
    rows = regions.select("page_id", "region_id", "seq", "bbox").unionByName(same).unionByName(moved)
    apart = rows.withColumn("bbox", F.transform("bbox", lambda v, i: F.when(i % 2 == 0, v + F.pmod(F.regexp_extract("region_id", r"(\d+)", 1).cast("int"), F.lit(50)) * 1000).otherwise(v)))
    return review.distinct_regions(apart).select("page_id", "region_id", F.col("seq").cast("int").alias("seq"))


@query(
    "q104_caption_dedup",
    f"""WITH {geometry.SQL} SELECT page_id, 'c' || n AS caption_id, CAST(n AS INTEGER) AS seq FROM caption UNION ALL SELECT page_id, 'z' || n, CAST(n + 200 AS INTEGER) FROM caption""",
)
def q104(spark, d):
    """Of three captions of one text in a chain, the middle one meets both others: it goes, and the last, which meets only it, stays."""
    _, _, captions = _review(spark, d)
    b, n = F.col("bbox"), F.substring("caption_id", 2, 9)
    base = F.array(b[0], n.cast("double") * 1000, b[2], n.cast("double") * 1000 + 10)
    rows = captions.select("page_id", "caption_id", n.cast("int").alias("seq"), base.alias("bbox"), F.concat(F.lit(" t"), n).alias("text"))
    move = lambda by: F.transform("bbox", lambda v, i: F.when(i % 2 == 1, v + by).otherwise(v))
    middle = rows.select("page_id", F.concat(F.lit("y"), F.col("seq").cast("string")).alias("caption_id"), (F.col("seq") + 100).alias("seq"), move(8.0).alias("bbox"), F.trim("text").alias("text"))
    last = rows.select("page_id", F.concat(F.lit("z"), F.col("seq").cast("string")).alias("caption_id"), (F.col("seq") + 200).alias("seq"), move(16.0).alias("bbox"), "text")
    return review.distinct_captions(rows.unionByName(middle).unionByName(last)).select("page_id", "caption_id", "seq")


@query("q105_upstream_captions", f"WITH {geometry.SQL} SELECT r.page_id, 'r' || r.n AS region_id, (SELECT 'c' || min(c.n) FROM caption c WHERE c.page_id = r.page_id AND c.q = r.q) AS caption_id FROM region r")
def q105(spark, d):
    _, regions, captions = _review(spark, d)
    q = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("n")).agg(F.max(F.col("l_quantity").cast("int")).alias("q"))
    words = F.concat(F.lit("Figure <"), F.col("q").cast("string"), F.lit(">"))
    r = regions.join(q.withColumnRenamed("n", "seq"), ["page_id", "seq"]).select("page_id", "region_id", F.concat(F.lit("see "), words, F.lit(" here")).alias("caption"))
    c = captions.withColumn("seq", F.substring("caption_id", 2, 9).cast("int")).join(q.withColumnRenamed("n", "seq"), ["page_id", "seq"]).select("page_id", "caption_id", "seq", F.concat(words, F.lit(" ")).alias("text"))
    return review.upstream_captions(r, c).select("page_id", "region_id", "caption_id")


@query("q106_budget", f"WITH {geometry.SQL}, p AS (SELECT page_id, page_id % 20 AS doc_id, bool_or(q % 2 = 0) AS needed FROM region GROUP BY page_id) SELECT page_id, doc_id, needed, needed AND row_number() OVER (PARTITION BY doc_id, needed ORDER BY page_id) <= 8 AS requested FROM p")
def q106(spark, d):
    return review.select_pages(_states(spark, d), "auto", 8, "doc_id").select("page_id", "doc_id", "needed", "requested")


def _states(spark, d) -> DataFrame:
    q = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("n")).agg(F.max(F.col("l_quantity").cast("int")).alias("q")).where("n % 2 = 1")
    return q.select("page_id", (F.col("page_id") % 20).alias("doc_id"), F.concat(F.lit("r"), F.col("n").cast("string")).alias("region_id"), F.when(F.col("q") % 2 == 0, "needs_review").otherwise("rule_passed").alias("status"))


_PAYLOAD = """'{"regions":' || CASE page_id % 5 WHEN 4 THEN '{}' WHEN 3 THEN '[7]' ELSE '[' || string_agg('{"region_id":"r' || n || '","type":"' || CASE page_id % 5 WHEN 1 THEN 'table' ELSE 'image' END || '","bbox":[1,2,30,40],"caption_id":null,' || CASE page_id % 5 WHEN 2 THEN '' ELSE '"status":"' || CASE WHEN n = 1 THEN 'ambiguous' ELSE 'confirmed' END || '",' END || '"reason":"seen"}', ',' ORDER BY n) || ']' END || '}'"""


@query(
    "q107_responses",
    f"""WITH {geometry.SQL} SELECT page_id, page_id % 5 < 2 AS valid, CASE page_id % 5 WHEN 4 THEN 'incomplete_coverage,no_regions_array' WHEN 3 THEN 'incomplete_coverage,invalid_record' WHEN 2 THEN 'invalid_status,missing_fields' ELSE '' END AS broken FROM region GROUP BY page_id""",
)
def q107(spark, d):
    pages, regions, captions = _review(spark, d)
    decisions, problems = review.read_responses(_responses(regions))
    verdicts = review.with_problems(review.validate_responses(decisions, pages, regions, captions), problems)
    return verdicts.select("page_id", "valid", F.array_join("broken", ",").alias("broken"))


def _responses(regions: DataFrame) -> DataFrame:
    k = F.col("page_id") % 5
    status = F.when(k == 2, "").otherwise(F.concat(F.lit('"status":"'), F.when(F.col("region_id") == "r1", "ambiguous").otherwise("confirmed"), F.lit('",')))
    item = F.concat(F.lit('{"region_id":"'), "region_id", F.lit('","type":"'), F.when(k == 1, "table").otherwise("image"), F.lit('","bbox":[1,2,30,40],"caption_id":null,'), status, F.lit('"reason":"seen"}'))
    own = regions.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", item.alias("item")))), lambda x: x["item"]), ",").alias("items"))
    body = F.when(k == 4, "{}").when(k == 3, "[7]").otherwise(F.concat(F.lit("["), "items", F.lit("]")))
    return own.select("page_id", F.concat(F.lit('{"regions":'), body, F.lit("}")).alias("payload"))


@query(
    "q108_apply_decisions",
    f"""WITH {geometry.SQL} SELECT page_id, 'r' || n AS region_id, CASE page_id % 5 WHEN 0 THEN 'image' WHEN 1 THEN 'table' ELSE CASE WHEN q % 5 = 0 THEN 'table' ELSE 'image' END END AS type, CASE WHEN page_id % 5 < 2 THEN 1.0 ELSE CAST(x0 AS DOUBLE) END AS x0, CASE WHEN page_id % 5 < 2 THEN CASE WHEN n = 1 THEN 'ambiguous' ELSE 'confirmed' END END AS review_status FROM region""",
)
def q108(spark, d):
    pages, regions, captions = _review(spark, d)
    decisions, problems = review.read_responses(_responses(regions))
    verdicts = review.with_problems(review.validate_responses(decisions, pages, regions, captions), problems)
    done = review.apply_decisions(regions, decisions, verdicts)
    return done.select("page_id", "region_id", "type", F.col("bbox")[0].alias("x0"), "review_status")


@query(
    "q109_review_report",
    f"""WITH {geometry.SQL}, p AS (SELECT page_id, page_id % 20 AS doc_id, bool_or(q % 2 = 0) AS needed, count(*) AS regions, count(CASE WHEN n = 1 THEN 1 END) AS first, count(CASE WHEN q % 2 = 0 THEN 1 END) AS open FROM region GROUP BY page_id),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, needed ORDER BY page_id) AS place FROM p),
    s AS (SELECT *, CASE WHEN NOT needed THEN 'not_requested' WHEN place > 8 THEN 'budget_exhausted' WHEN page_id % 5 < 2 THEN 'reviewed' ELSE 'failed' END AS outcome FROM o)
    SELECT doc_id, CAST(sum(regions) AS BIGINT) AS regions, CAST(sum(CASE WHEN outcome = 'reviewed' THEN first ELSE open END) AS BIGINT) AS unresolved, CAST(count(CASE WHEN outcome IN ('reviewed', 'failed') THEN 1 END) AS BIGINT) AS api_calls,
      coalesce(string_agg(CASE WHEN outcome IN ('failed', 'budget_exhausted') THEN 'page ' || page_id || ': ' || outcome END, ',' ORDER BY page_id), '') AS warnings,
      CASE WHEN sum(CASE WHEN outcome = 'reviewed' THEN first ELSE open END) > 0 OR count(CASE WHEN outcome IN ('failed', 'budget_exhausted') THEN 1 END) > 0 THEN 'needs_review' WHEN count(CASE WHEN outcome IN ('reviewed', 'failed') THEN 1 END) > 0 THEN 'vlm_reviewed' ELSE 'rule_passed' END AS status FROM s GROUP BY doc_id""",
)
def q109(spark, d):
    """From selection within the budget over answers and their validation to the written report."""
    pages, regions, captions = _review(spark, d)
    states = _states(spark, d)
    selected = review.select_pages(states, "auto", 8, "doc_id").drop("doc_id")
    decisions, problems = review.read_responses(_responses(regions))
    verdicts = review.with_problems(review.validate_responses(decisions, pages, regions, captions), problems)
    outcomes = review.page_outcomes(states.select("page_id").distinct(), selected, verdicts)
    keys = states.select("page_id", "doc_id", F.col("page_id").alias("page_no")).distinct()
    report = review.review_report(review.reviewed_regions(states.drop("doc_id"), decisions, outcomes), outcomes, keys)
    body = F.from_json("json", "regions bigint, unresolved bigint, api_calls bigint, warnings array<string>, status string")
    return sinks.report_json(report).select("doc_id", body["regions"].alias("regions"), body["unresolved"].alias("unresolved"), body["api_calls"].alias("api_calls"), F.array_join(body["warnings"], ",").alias("warnings"), body["status"].alias("status"))


@query(
    "q110_review_requests",
    f"""WITH {geometry.SQL}, r AS (SELECT page_id, count(*) AS regions, string_agg('r' || n, ',' ORDER BY n) AS ids FROM region GROUP BY page_id), c AS (SELECT page_id, count(*) AS captions FROM caption GROUP BY page_id)
    SELECT r.page_id, CASE WHEN r.page_id % 4 <> 0 THEN ids END AS ids, CASE WHEN r.page_id % 4 <> 0 THEN CAST(coalesce(captions, 0) AS INTEGER) END AS captions, CASE WHEN r.page_id % 4 = 0 THEN 'request_too_large' END AS error FROM r LEFT JOIN c ON c.page_id = r.page_id""",
)
def q110(spark, d):
    pages, regions, captions = _review(spark, d)
    issues = regions.limit(0).select("page_id", "region_id", F.lit("x").alias("issue"))
    size = pages.select("page_id", F.when(F.col("page_id") % 4 == 0, 30 * 1024 * 1024).otherwise(1000).alias("bytes"))
    body = F.from_json("body", "regions array<struct<region_id:string>>, captions array<struct<caption_id:string>>")
    done = review.requests(pages, regions, captions, issues, size)
    return done.select("page_id", F.array_join(F.transform(body["regions"], lambda x: x["region_id"]), ",").alias("ids"), F.when(F.col("body").isNotNull(), F.size(body["captions"])).alias("captions"), "error")


# -- images, caches and answers ---------------------------------------------------------------------------------------------


@query("q111_decision_tally", "SELECT doc_id // 10 AS doc_id, CAST(count(CASE WHEN lang = 'en' THEN 1 END) AS BIGINT) AS matched, CAST(count(CASE WHEN lang = 'de' THEN 1 END) AS BIGINT) AS ambiguous, CAST(count(CASE WHEN lang = 'fr' THEN 1 END) AS BIGINT) AS unmatched FROM documents GROUP BY doc_id // 10")
def q111(spark, d):
    status = F.when(F.col("lang") == "en", "Matched").when(F.col("lang") == "de", "AMBIGUOUS").when(F.col("lang") == "fr", "unmatched").otherwise("other")
    return images.decision_tally(table(spark, d, "documents").select(F.floor(F.col("doc_id") / 10).alias("doc_id"), status.alias("status")))


@query(
    "q113_answers",
    """SELECT doc_id, CASE WHEN n % 3 = 0 THEN 'known' WHEN n % 3 = 1 THEN 'asked ' || n END AS answer, CASE WHEN n % 3 = 2 THEN 'Error: no ' || n END AS error, n % 3 = 0 AS cache_hit FROM (SELECT doc_id, doc_id % 30 AS n FROM documents)""",
)
def q113(spark, d):
    """Equal keys are asked once; a failed request is an error of its rows."""
    n = (F.col("doc_id") % 30).cast("string")
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("ordinal"), n.alias("key"), n.alias("question"), F.lit(None).cast("binary").alias("content"))
    known = spark.range(30).where("id % 3 = 0").select(F.col("id").cast("string").alias("key"), F.lit("known").alias("answer"))
    done = cache.answer(rows, known, lambda question, content: f"Error: no {question}" if int(question) % 3 == 2 else f"asked {question}")
    return done.select(F.col("ordinal").alias("doc_id"), "answer", "error", "cache_hit")


@query("q114_batches", "SELECT event_id, user_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 5 AS INTEGER) AS batch_no FROM events")
def q114(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", F.col("event_id").alias("ordinal"))
    return cache.batches(rows, 5, "user_id").drop("ordinal")


@query("q115_invalidate", "SELECT event_id FROM events WHERE user_id % 4 <> 1")
def q115(spark, d):
    rows = table(spark, d, "events")
    gone = rows.where("user_id % 4 = 1").select("user_id")
    return cache.invalidate(rows, gone, "user_id").select("event_id")


@query("q116_not_ready", "SELECT p_brand AS name, false AS ready, p_brand || ' is not ready: ' || array_to_string((list(p_name ORDER BY p_partkey))[1:5], '; ') AS warning FROM part WHERE p_size % 2 = 0 GROUP BY p_brand UNION ALL SELECT p_brand, true, NULL FROM part GROUP BY p_brand HAVING count(CASE WHEN p_size % 2 = 0 THEN 1 END) = 0")
def q116(spark, d):
    rows = parts(spark, d).select(F.col("p_brand").alias("name"), F.col("doc_id").alias("ordinal"), F.col("p_name").alias("part"), (F.col("p_size") % 2 != 0).alias("present"))
    return cache.not_ready(rows)


@query("q117_toc_evidence", "SELECT p_partkey AS doc_id, 3 AS page_offset, CAST(6 AS BIGINT) AS matches, 1.0 AS confidence FROM part")
def q117(spark, d):
    """The first six chapters of level 1 are looked for in the heads of the first pages; later ones would shift the median."""
    rows = parts(spark, d)
    names = F.array(*map(F.lit, ("Alpha", "Bravo", "Charlie", "Delta", "Echoes", "Foxtrot", "Golfing", "Hotels")))
    toc = rows.select("doc_id", F.posexplode(names).alias("seq", "title")).select("doc_id", "seq", F.lit(1).alias("level"), "title", (F.col("seq") * 2 + 1).alias("logical_page"))
    pages = rows.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("page_index")).select("doc_id", "page_index", F.when((F.col("page_index") >= 3) & ((F.col("page_index") - 3) % 2 == 0), F.concat(F.coalesce(F.get(names, F.floor((F.col("page_index") - 3) / 2).cast("int")), F.lit("none")), F.lit(" head"))).otherwise("text").alias("text"))
    return ranges.heuristic_offset(toc, pages).select("doc_id", "page_offset", "matches", F.col("confidence").cast("double").alias("confidence"))


# -- streams ----------------------------------------------------------------------------------------------------------------


@query("q118_single_flight", "SELECT user_id % 40 AS key, CAST(count(*) AS BIGINT) AS requests, CAST(1 AS BIGINT) AS asked FROM events GROUP BY user_id % 40")
def q118(spark, d):
    """A stream of requests, read to its end: of those with one key within the time to live one is asked."""
    from ..streaming import incremental

    rows = table(spark, d, "events").select((F.col("user_id") % 40).alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    stream = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").parquet(f"{d}/events.parque[t]")  # a pattern: it may be a file or a folder
    asked = incremental.first_in_ttl(stream.select((F.col("user_id") % 40).alias("key"), "ts"), ttl="400 days")
    name = f"asked_{uuid.uuid4().hex}"
    # one row for each key: the sink stays small however many requests there are
    asked.select("key").writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    own = spark.table(name).groupBy("key").agg(F.count("*").alias("asked"))
    return rows.groupBy("key").agg(F.count("*").alias("requests")).join(own, "key").select("key", "requests", "asked")
