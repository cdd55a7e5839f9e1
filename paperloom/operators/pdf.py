"""What a page provider reports about PDF files, as tables: words, regions, tables, form fields, fonts, structure, and scans.

A provider with a PDF library fills the tables; the operators here need none. Boxes are x0, y0, x1, y1 in points from the top left.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T



def words_with_fonts(words: DataFrame, spans: DataFrame) -> DataFrame:
    """words (doc_id, page, block, word_no, word, bbox) with font and size of the last span of their block that contains them."""
    s = spans.select("doc_id", "page", "block", "span_no", "text", "font", "size")
    met = words.join(s, ["doc_id", "page", "block"], "left").where(F.col("text").isNull() | F.contains("text", F.col("word")))
    own = met.groupBy("doc_id", "page", "block", "word_no").agg(F.max_by("font", "span_no").alias("font"), F.max_by("size", "span_no").alias("size"))
    return words.join(own, ["doc_id", "page", "block", "word_no"], "left")


def figure_regions(regions: DataFrame, pages: DataFrame, least_area: float = K.LEAST_AREA) -> DataFrame:
    """regions (doc_id, page, source, bbox) that are large enough, grown by the margin within their page.

    Clusters stand for drawings on pages that have any; nothing is deduplicated.
    """
    clusters = regions.where("source = 'cluster'").select("doc_id", "page").distinct().withColumn("__clustered", F.lit(True))
    rows = regions.join(clusters, ["doc_id", "page"], "left").where("NOT (source = 'drawing' AND coalesce(__clustered, false))").drop("__clustered")
    box = T.ordered_box("bbox")
    rows = rows.withColumn("bbox", box).where((F.col("bbox")[2] - F.col("bbox")[0] >= K.LEAST_SIDE) & (F.col("bbox")[3] - F.col("bbox")[1] >= K.LEAST_SIDE) & (T.box_area("bbox") >= least_area))
    size = pages.select("doc_id", F.col("page_no").alias("page"), "width", "height")
    return rows.join(size, ["doc_id", "page"]).withColumn("bbox", T.expanded_box("bbox", K.MARGIN, "width", "height")).drop("width", "height")


def table_markdown(rows: Column) -> Column:
    """A pipe table of rows (array of arrays of strings): the first is the header; null cells are empty, cells are stripped."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: T.strip(F.coalesce(c, F.lit("")))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(F.get(rows, F.lit(0)))))
    rest = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(line(F.get(rows, F.lit(0))), rule), rest), "\n"))


def form_fields(widgets: DataFrame) -> DataFrame:
    """widgets (doc_id, ordinal, name, type_code, value, rect, page, flags, choices) with type, required, read_only and unique names.

    A name that an earlier field has gets the first free of _1, _2 ...; a field without a name is field_ and its number. Which
    names are free depends on all fields before, so a document's fields are one group. Choices are those of choice fields.
    """
    kinds = F.create_map(*[F.lit(x) for pair in K.FIELD_TYPES.items() for x in pair])
    rows = widgets.withColumns({"type": F.coalesce(F.try_element_at(kinds, F.col("type_code")), F.lit("unknown")), "required": F.col("flags").bitwiseAND(2) != 0, "read_only": F.col("flags").bitwiseAND(1) != 0})
    rows = rows.withColumn("choices", F.when(F.col("type").isin("combobox", "listbox"), F.coalesce("choices", F.array().cast("array<string>"))))
    return unique_field_names(rows.drop("type_code", "flags"))


def unique_field_names(fields: DataFrame) -> DataFrame:
    """fields (doc_id, ordinal, name) with names that no earlier field of the document has; see form_fields. The fold streams
    documents one after the other and remembers the names of one."""
    at = fields.columns.index("name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, document, taken, k = False, None, set(), 0
        for batch in batches:
            names = []
            for own, name in zip(batch.column("doc_id").to_pylist(), batch.column("name").to_pylist(), strict=True):
                if not begun or own != document:
                    begun, document, taken, k = True, own, set(), 0
                base = unique = name or f"field_{k}"
                n = 1
                while unique in taken:
                    unique = f"{base}_{n}"
                    n += 1
                taken.add(unique)
                names.append(unique)
                k += 1
            yield batch.set_column(at, batch.schema.field(at), pa.array(names, batch.schema.field(at).type))

    return fields.repartition("doc_id").sortWithinPartitions("doc_id", "ordinal").mapInArrow(run, fields.schema)


def structure(outline: DataFrame, fonts: DataFrame, documents: DataFrame | None = None, most_pages: int = 10) -> DataFrame:
    """doc_id, outline_entries, fonts (sorted, of the first pages) of documents; with documents (doc_id, metadata as a map,
    page_count, has_acroform, is_encrypted) also these, the eight metadata fields empty where they are not known."""
    entries = outline.groupBy("doc_id").agg(F.count("*").alias("outline_entries"))
    names = fonts.where(F.col("page_index") < most_pages).groupBy("doc_id").agg(F.array_sort(F.collect_set("font")).alias("fonts"))
    out = entries.join(names, "doc_id", "full")
    if documents is not None:
        metadata = F.map_from_entries(F.array(*[F.struct(F.lit(k), F.coalesce(F.try_element_at("metadata", F.lit(k)), F.lit(""))) for k in K.PDF_METADATA]))
        out = documents.select("doc_id", metadata.alias("metadata"), "page_count", "has_acroform", "is_encrypted").join(out, "doc_id", "left")
    more = [c for c in out.columns if c not in ("doc_id", "outline_entries", "fonts")]
    return out.select("doc_id", F.coalesce("outline_entries", F.lit(0)).alias("outline_entries"), F.coalesce("fonts", F.array().cast("array<string>")).alias("fonts"), *more)


def broken_fonts(fonts: DataFrame) -> DataFrame:
    """doc_id of documents with a composite font of identity encoding whose characters can't be told."""
    bad = (F.col("subtype") == "Type0") & F.col("encoding").isin("Identity-H", "Identity-V") & F.col("has_descendant") & ~F.col("has_to_unicode")
    return fonts.where(bad).select("doc_id").distinct()


def image_coverage(images: DataFrame, pages: DataFrame, covered: float = 0.8) -> DataFrame:
    """doc_id, covered_share: the share of pages of which images fill `covered` or more (pages without images count)."""
    area = images.groupBy("doc_id", "page").agg(F.sum(T.box_area("bbox")).alias("__area"))
    rows = pages.select("doc_id", F.col("page_no").alias("page"), (F.col("width") * F.col("height")).alias("__page")).join(area.hint("merge"), ["doc_id", "page"], "left")
    share = F.least(F.coalesce(F.col("__area"), F.lit(0.0)) / F.greatest(F.col("__page"), F.lit(1.0)), F.lit(1.0))
    return rows.groupBy("doc_id").agg(F.avg((share >= covered).cast("double")).alias("covered_share"))


def classify_scans(pages: DataFrame, fonts: DataFrame, images: DataFrame) -> DataFrame:
    """doc_id, kind (text or ocr): the first test that says ocr wins, on up to ten evenly spaced pages.

    Fewer than 50 characters a page without blanks; glyph codes or broken fonts; images on four of five pages.
    """
    counted = pages.withColumn("__n", F.count("*").over(Window.partitionBy("doc_id")).cast("int"))
    sample = counted.where(F.array_contains(T.sample_pages("__n"), F.col("page_index")))
    text = sample.groupBy("doc_id").agg(F.avg(F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", ""))).alias("__chars"), F.max(T.cid_ratio("text")).alias("__cid"))
    bad = broken_fonts(fonts).withColumn("__bad", F.lit(True))
    cover = image_coverage(images, sample.select("doc_id", "page_no", "width", "height"))
    # merged, never broadcast: pages may have been exploded, and are more than the planner thinks
    rows = text.join(bad.hint("merge"), "doc_id", "left").join(cover.hint("merge"), "doc_id", "left")
    ocr = (F.col("__chars") < 50) | (F.col("__cid") > 0.05) | F.coalesce("__bad", F.lit(False)) | (F.coalesce("covered_share", F.lit(0.0)) >= 0.8)
    return rows.select("doc_id", F.when(ocr, "ocr").otherwise("text").alias("kind"))
