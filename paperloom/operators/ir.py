"""The block model: a row for each block of a document, in reading order, and what is made of it.

blocks: doc_id, seq, type, page (1-based, null: unknown), level, title, content, items, ordered, path, caption, markdown, html,
latex, number. A null says "unknown"; no operator fills it in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import METADATA_KEYS


def block_id(seq: str | Column = "seq") -> Column:
    """block_ and eight hexadecimal digits of the block's place."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    return F.concat(F.lit("block_"), F.lower(F.lpad(F.hex(seq), 8, "0")))


def with_block_ids(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("block_id", block_id())


def with_confidence(blocks: DataFrame) -> DataFrame:
    """blocks with a confidence: 0.9 where the source has no such column; a null that was given stays."""
    return blocks if "confidence" in blocks.columns else blocks.withColumn("confidence", F.lit(0.9))


def kept_metadata(metadata: str | Column) -> Column:
    """A metadata map without keys other than the six that a document keeps."""
    metadata = F.col(metadata) if isinstance(metadata, str) else metadata
    return F.map_filter(metadata, lambda k, _: k.isin(METADATA_KEYS))


def front_matter(values: dict[str, Column]) -> Column:
    """YAML-like header of the values that are not empty, in the keys' fixed order; empty if none is."""
    lines = [F.when(F.coalesce(F.length(values[k]), F.lit(0)) > 0, F.concat(F.lit(f"{k}: "), values[k])) for k in METADATA_KEYS if k in values]
    body = F.concat_ws("\n", *lines)
    return F.when(body == "", "").otherwise(F.concat(F.lit("---\n"), body, F.lit("\n---")))


def _has(blocks: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in blocks.columns else F.lit(None).cast(kind)


# -- index ------------------------------------------------------------------------------------------------------------------


def section_parents(blocks: DataFrame) -> DataFrame:
    """Sections with parent_seq: the nearest section before with a smaller level, null if there is none.

    One window for each level that occurs up to 9 (deeper levels count as 9): no join, and memory for one row.
    """
    rows = blocks.where("type = 'section'").withColumn("level", F.coalesce("level", F.lit(1)))
    before = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.last(F.when(F.least(F.col("level"), F.lit(9)) == k, F.col("seq")), True).over(before) for k in range(0, 10)}
    rows = rows.withColumns({f"__{k}": c for k, c in last.items()})
    parent = F.lit(None).cast("long")
    for k in range(0, 10):
        parent = F.greatest(parent, F.when(F.col("level") > k, F.col(f"__{k}").cast("long")))
    return rows.withColumn("parent_seq", parent).drop(*[f"__{k}" for k in range(0, 10)])


def tables_index(blocks: DataFrame, annotations: DataFrame | None = None) -> DataFrame:
    """Tables in reading order; annotated ones (without page or block) come after the others."""
    own = blocks.where("type = 'table'").select("doc_id", "seq", "page", _has(blocks, "caption").alias("caption"), F.lit(0).alias("annotated"))
    if annotations is None:
        return own
    return own.unionByName(annotations.select("doc_id", "seq", F.lit(None).cast("int").alias("page"), "caption", F.lit(1).alias("annotated")))


def figures_index(blocks: DataFrame) -> DataFrame:
    return blocks.where("type = 'image'").select("doc_id", "seq", "page", _has(blocks, "path").alias("path"), _has(blocks, "caption").alias("caption"))


def formulas_index(blocks: DataFrame) -> DataFrame:
    return blocks.where("type IN ('display_formula', 'inline_formula')").select("doc_id", "seq", "page", "type", _has(blocks, "latex").alias("latex"), _has(blocks, "number").alias("number"))


def page_index(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, page, n_blocks, block_ids (in order) of every page: all pages of documents with a page count, else those seen."""
    pages = documents.where("page_count > 0").select("doc_id", F.explode(F.sequence(F.lit(1), F.col("page_count").cast("int"))).alias("page"))
    located = blocks.where("page >= 1").select("doc_id", F.col("page").cast("int").alias("page"), "seq")
    own = located.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list("seq")).alias("__seqs"))
    unknown = own.join(documents.where("page_count > 0").select("doc_id"), "doc_id", "left_anti")
    rows = pages.join(own, ["doc_id", "page"], "left").unionByName(unknown)
    ids = F.transform(F.coalesce("__seqs", F.array().cast("array<bigint>")), block_id)
    return rows.select("doc_id", "page", F.size(ids).alias("n_blocks"), ids.alias("block_ids"))


def unlocated_blocks(blocks: DataFrame) -> DataFrame:
    """doc_id, block_ids (in order) of blocks whose page is unknown."""
    own = blocks.where("page IS NULL").groupBy("doc_id").agg(F.sort_array(F.collect_list("seq")).alias("__seqs"))
    return own.select("doc_id", F.transform("__seqs", block_id).alias("block_ids"))


def text_of(blocks: DataFrame) -> DataFrame:
    """doc_id, text: the contents of the blocks in reading order, a line each."""
    own = blocks.where("content IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "content"))).alias("__parts"))
    return own.select("doc_id", F.array_join(F.transform("__parts", lambda x: x["content"]), "\n").alias("text"))


# -- Markdown ---------------------------------------------------------------------------------------------------------------


def rendered(blocks: DataFrame) -> Column:
    """A block as Markdown; null if it renders nothing."""
    c = {name: _has(blocks, name) for name in ("content", "caption", "path", "markdown", "latex", "number")}
    level, items, ordered = _has(blocks, "level", "int"), _has(blocks, "items", "array<string>"), _has(blocks, "ordered", "boolean")
    full = lambda x: F.coalesce(F.length(x), F.lit(0)) > 0
    numbered = F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    bulleted = F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")
    listed = F.when(F.size(items) > 0, F.when(F.coalesce(ordered, F.lit(False)), numbered).otherwise(bulleted))
    image = F.when(full(c["path"]), F.concat(F.lit("!["), F.coalesce(c["caption"], F.lit("Image")), F.lit("]("), c["path"], F.lit(")"))).otherwise(F.concat(F.lit("**"), F.coalesce(c["caption"], F.lit("Image")), F.lit("**")))
    table = F.nullif(F.concat_ws("\n\n", F.when(full(c["caption"]), F.concat(F.lit("**Table:** "), c["caption"])), F.when(full(c["markdown"]), c["markdown"])), F.lit(""))
    formula = F.when(full(c["latex"]), F.concat(F.lit("$$"), c["latex"], F.lit("$$"), F.when(full(c["number"]), F.concat(F.lit(" \\["), c["number"], F.lit("\\]"))).otherwise("")))
    generic = F.when(full(c["content"]), c["content"]).when(full(c["caption"]), F.concat(F.lit("**"), c["caption"], F.lit("**")))
    return (
        F.when(F.col("type").isin("section", "header"), F.concat(F.repeat(F.lit("#"), F.coalesce(level, F.lit(1))), F.lit(" "), F.coalesce(c["content"], F.lit(""))))
        .when(F.col("type").isin("paragraph", "text"), F.when(full(c["content"]), c["content"]))
        .when(F.col("type") == "list", listed)
        .when(F.col("type") == "image", image)
        .when(F.col("type") == "table", table)
        .when(F.col("type") == "display_formula", formula)
        .when(F.col("type") == "inline_formula", F.when(full(c["latex"]), F.concat(F.lit("$"), c["latex"], F.lit("$"))))
        .otherwise(generic)
    )


def render_markdown(blocks: DataFrame, page_breaks: bool = True) -> DataFrame:
    """doc_id, markdown: blocks in reading order with blank lines between them and a rule where the page changes.

    No rule stands before the first block nor next to a block of unknown page. Between items of lists (a list after a line that
    looks like an item) there is no blank line.
    """
    order = Window.partitionBy("doc_id").orderBy("seq")
    rows = blocks.withColumn("__text", rendered(blocks))
    before = F.lag("page").over(order)
    rows = rows.withColumn("__break", F.when(F.lit(page_breaks) & before.isNotNull() & F.col("page").isNotNull() & (before != F.col("page")), F.lit("---\n\n")).otherwise(""))
    last_line = F.regexp_extract("__text", r"([^\n]*)$", 1)
    line = F.last(F.when(F.col("__text").isNotNull(), last_line), True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__before", line)
    item = F.col("__before").rlike(r"^(- |[1-9]\.)") & (F.col("type") == "list")
    gap = F.when(F.col("__before").isNull(), "").when(item & (F.col("__break") == ""), "\n").otherwise("\n\n")
    part = F.concat(gap, F.col("__break"), F.coalesce("__text", F.lit("")))
    part = F.when(F.col("__text").isNull() & (F.col("__break") == ""), "").otherwise(part)
    own = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", part.alias("part")))).alias("__parts"))
    return own.select("doc_id", F.array_join(F.transform("__parts", lambda x: x["part"]), "").alias("markdown"))


def markdown_sections(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, section, level, heading, start_line, end_line, content of the headings of Markdown texts.

    A line whose stripped form begins with # is a heading; its level is the number of # at the beginning of the line as it is.
    Text before the first heading belongs to no section; code fences are not looked at; end_line is inclusive.
    """
    lines = documents.select("doc_id", F.posexplode(F.split(F.col(text_col), "\n")).alias("line", "text"))
    is_heading = F.regexp_replace("text", r"(?U)^\s+", "").startswith("#")
    order = Window.partitionBy("doc_id").orderBy("line")
    rows = lines.withColumns({"__h": is_heading, "section": F.sum(is_heading.cast("int")).over(order)}).where("section > 0")
    own = rows.groupBy("doc_id", "section").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.min_by("text", "line").alias("__head"), F.array_sort(F.collect_list(F.when(~F.col("__h"), F.struct("line", "text")))).alias("__body"))
    level = F.length(F.regexp_extract("__head", "^(#*)", 1))
    heading = F.trim(F.regexp_replace("__head", "^#*", ""))
    return own.select("doc_id", "section", level.alias("level"), heading.alias("heading"), "start_line", "end_line", F.array_join(F.transform("__body", lambda x: x["text"]), "\n").alias("content"))


# -- nested form and precedence ---------------------------------------------------------------------------------------------


def from_nested(documents: DataFrame, json_col: str = "json") -> DataFrame:
    """blocks of nested documents (doc_id, json with blocks by id and reading_order): doc_id, seq, block_id and the body as JSON.

    An id in the reading order that no block has renders nothing: its body is null. Without an order the blocks' own holds.
    """
    bodies = F.from_json(F.get_json_object(json_col, "$.blocks"), "map<string,string>")
    order = F.from_json(F.get_json_object(json_col, "$.reading_order"), "array<string>")
    rows = documents.select("doc_id", bodies.alias("__b"), F.when(F.size(order) > 0, order).otherwise(F.map_keys(bodies)).alias("__o"))
    out = rows.select("doc_id", "__b", F.posexplode("__o").alias("seq", "block_id"))
    return out.select("doc_id", F.col("seq").cast("long").alias("seq"), "block_id", F.try_element_at("__b", F.col("block_id")).alias("body"))


def resolved_quality(documents: DataFrame) -> DataFrame:
    """documents (payload_state, metadata_state, computed_state, requires_ocr, warnings) with state, requires_ocr and warnings.

    A state that was given wins over one in the metadata, and that over a computed one; unreadable texts require OCR unless
    something else was said, and warn once.
    """
    state = F.coalesce("payload_state", "metadata_state", "computed_state")
    out = documents.withColumn("state", state)
    warned = F.when(F.col("state") != "ok", F.array(F.concat(F.lit("text quality: "), F.col("state")))).otherwise(F.array().cast("array<string>"))
    return out.withColumns({"requires_ocr": F.coalesce("requires_ocr", F.col("state") == "unreadable"), "warnings": F.array_distinct(F.concat(F.coalesce("warnings", F.array().cast("array<string>")), warned))})
