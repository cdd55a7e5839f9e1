"""Merging chunk results: text that overlapping chunks repeat, and the parts of the merged document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.constants import LINE_BREAKS, OVERLAP_LINES
from ..operators import ir


def lines_of(text: Column) -> Column:
    """The lines of a text by all line breaks, without an empty last one."""
    parts = F.split(text, LINE_BREAKS)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def overlap_lines(before: Column, now: Column, most: Column) -> Column:
    """How many lines at the end of one text the other begins with: the greatest number up to `most`.

    One line counts only if it has 40 characters or more, blanks aside.
    """
    top = F.least(F.size(before), F.size(now), most).cast("int")
    sizes = F.when(top >= 1, F.sequence(top, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    same = F.filter(sizes, lambda k: (F.slice(before, F.size(before) - k + 1, k) == F.slice(now, 1, k)) & ((k >= 2) | (F.length(T.strip(F.element_at(now, 1))) >= 40)))
    return F.coalesce(F.get(same, F.lit(0)), F.lit(0))


def trim_overlaps(results: DataFrame) -> DataFrame:
    """Chunk results (doc_id, chunk_idx, phys_start, phys_end, markdown, error) with trimmed and kept_markdown.

    A chunk that begins on pages of the one before loses the lines that it repeats, at most 40 for each such page. It is
    compared with the text before as it was; after a failed chunk nothing is compared.
    """
    order = Window.partitionBy("doc_id").orderBy("chunk_idx")
    lines = lines_of(F.coalesce("markdown", F.lit("")))
    rows = results.withColumn("__lines", lines)
    before = F.lag(F.when(F.col("error").isNull(), F.struct("__lines", "phys_end"))).over(order)
    rows = rows.withColumn("__before", before)
    pages = F.greatest(F.lit(0), F.col("__before.phys_end") - F.col("phys_start") + 1)
    usable = F.col("__before").isNotNull() & F.col("error").isNull() & (pages > 0)
    k = F.when(usable, overlap_lines(F.col("__before.__lines"), F.col("__lines"), pages * OVERLAP_LINES)).otherwise(0)
    rows = rows.withColumn("trimmed", k)
    rest = F.array_join(F.slice("__lines", F.col("trimmed") + 1, F.greatest(F.size("__lines") - F.col("trimmed"), F.lit(0))), "\n")
    kept = F.when(F.col("trimmed") > 0, F.regexp_replace(rest, r"^\n+", "")).otherwise(F.coalesce("markdown", F.lit("")))
    return rows.withColumn("kept_markdown", kept).drop("__lines", "__before")


def uncovered_markdown(results: DataFrame, blocks: DataFrame) -> DataFrame:
    """results with the Markdown of chunks that have blocks rendered anew, without pages that an earlier chunk has.

    blocks: doc_id, chunk_idx, seq, type, page of the whole file, and what they hold; none of chunks with native Markdown.
    Blocks of unknown pages stay. A failed chunk covers nothing.
    """
    good = results.where("error IS NULL").select("doc_id", "chunk_idx")
    own = blocks.join(good, ["doc_id", "chunk_idx"], "left_semi")
    first = F.min("chunk_idx").over(Window.partitionBy("doc_id", "page"))
    kept = own.withColumn("__first", first).where("page IS NULL OR chunk_idx = __first").drop("__first")
    texts = ir.render_markdown(kept.withColumn("doc_id", F.struct("doc_id", "chunk_idx"))).select("doc_id.doc_id", "doc_id.chunk_idx", F.col("markdown").alias("__new"))
    known = own.select("doc_id", "chunk_idx").distinct().withColumn("__known", F.lit(True))
    out = results.join(known, ["doc_id", "chunk_idx"], "left").join(texts, ["doc_id", "chunk_idx"], "left")
    return out.withColumn("markdown", F.when(F.col("__known"), F.coalesce("__new", F.lit(""))).otherwise(F.col("markdown"))).drop("__known", "__new")


def merge_markdown(results: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """doc_id, markdown: each chunk's header and text (or its error) one after the other; see uncovered_markdown for blocks."""
    rows = trim_overlaps(results if blocks is None else uncovered_markdown(results, blocks))
    title = F.coalesce("title", F.lit(""))
    head = F.concat(F.lit("\n\n---\n# "), title, F.lit("  (pages "), (F.col("phys_start") + 1).cast("string"), F.lit("–"), (F.col("phys_end") + 1).cast("string"), F.lit(")\n\n"))
    failed = F.concat(F.lit("\n\n---\n## ["), F.coalesce("title", F.lit("error")), F.lit("] (processing failed)\n\nError: "), F.col("error"), F.lit("\n"))
    part = F.when(F.col("error").isNotNull(), failed).otherwise(F.concat(head, F.col("kept_markdown")))
    ordered = F.array_sort(F.collect_list(F.struct("chunk_idx", part.alias("part"))))
    return rows.groupBy("doc_id").agg(T.strip(F.array_join(F.transform(ordered, lambda x: x["part"]), "\n")).alias("markdown"))


def processed_pages(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with first and last page clamped to the document, and processed_pages (from 1)."""
    rows = chunks.join(documents.select("doc_id", "page_count"), "doc_id")
    start = F.greatest(F.lit(0), F.least(F.col("phys_start"), F.col("page_count") - 1))
    rows = rows.withColumn("phys_start", start).withColumn("phys_end", F.greatest(F.col("phys_start"), F.least(F.col("phys_end"), F.col("page_count") - 1)))
    return rows.withColumn("processed_pages", F.sequence(F.col("phys_start") + 1, F.col("phys_end") + 1)).drop("page_count")


def merge_annotations(annotations: DataFrame) -> DataFrame:
    """doc_id, kind, items: annotations (doc_id, chunk_idx, kind, items as an array) of all chunks in their order."""
    own = annotations.groupBy("doc_id", "kind").agg(F.array_sort(F.collect_list(F.struct("chunk_idx", "items"))).alias("__parts"))
    return own.select("doc_id", "kind", F.flatten(F.transform("__parts", lambda x: x["items"])).alias("items"))


def merge_documents(chunks: DataFrame) -> DataFrame:
    """doc_id, metadata (of the first chunk that has any), page_count, processed_pages of chunk documents.

    chunks: doc_id, chunk_idx, phys_end, metadata (map), page_count, processed_pages (array); failed ones left out.
    """
    order = F.struct("chunk_idx")
    some = F.when(F.size("metadata") > 0, F.col("metadata"))
    return chunks.groupBy("doc_id").agg(
        F.min_by(F.to_json(some), F.when(F.size("metadata") > 0, order)).alias("metadata"),
        F.max(F.greatest(F.col("phys_end") + 1, F.coalesce("page_count", F.lit(0)))).alias("page_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("processed_pages")))).alias("processed_pages"),
    )
