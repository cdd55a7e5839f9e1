"""Files as DataFrames: scanning, decoding by format, rows and blocks of decoded documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import office
from .html_markdown import html_to_markdown as _html

#: (page_no from 1, label or null, text, width, height, rotation) of a paged file's bytes.
PageProvider = Callable[[bytes], list[tuple[int, str | None, str, float, float, int]]]


def scan(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """doc_id (a hash of the path), path, format, length, modified and content of files; unknown formats count as text."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    rows = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    return rows.select(F.xxhash64("path").alias("doc_id"), "path", F.coalesce(T.detect_format("path"), F.lit("text")).alias("format"), "length", F.col("modificationTime").alias("modified"), "content")


def _decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = []
        for doc, path, kind, content in zip(rows["doc_id"], rows["path"], rows["format"], rows["content"], strict=True):
            try:
                title, text = office.decode(kind, bytes(content), path)
                out.append((doc, title, text, None))
            except Exception as e:  # noqa: BLE001  a file that can't be read is a row with an error
                out.append((doc, None, None, f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(out, columns=["doc_id", "title", "text", "error"])


def decode(files: DataFrame) -> DataFrame:
    """doc_id, title, text, error of scanned files; one file's failure, and a format that has no decoder, is its own row's error.

    HTML, Word and presentation files without a title have their name's stem as one, if there is a path.
    """
    path = F.col("path") if "path" in files.columns else F.lit(None).cast("string")
    return files.select("doc_id", path.alias("path"), "format", "content").mapInPandas(_decoded, "doc_id long, title string, text string, error string")


def body_blocks(decoded: DataFrame) -> DataFrame:
    """One paragraph of unknown page for each document that was decoded."""
    return decoded.where("error IS NULL").select("doc_id", F.lit(0).cast("long").alias("seq"), F.lit("paragraph").alias("type"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("level"), F.col("text").alias("content"))


def default_pages(content: bytes) -> list[tuple[int, str | None, str, float, float, int]]:
    return [(k + 1, None, text, 612.0, 792.0, 0) for k, text in enumerate(office.pdf_pages(content))]


def pages(files: DataFrame, provider: PageProvider = default_pages) -> DataFrame:
    """doc_id, page_index, page_no, label, text, width, height, rotation, error of paged files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for doc, content in zip(rows["doc_id"], rows["content"], strict=True):
                try:
                    out += [(doc, n - 1, n, label, text, w, h, turn, None) for n, label, text, w, h, turn in provider(bytes(content))]
                except Exception as e:  # noqa: BLE001
                    out.append((doc, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["doc_id", "page_index", "page_no", "label", "text", "width", "height", "rotation", "error"]).astype({c: "Int32" for c in ("page_index", "page_no", "rotation")})

    return files.select("doc_id", "content").mapInPandas(run, "doc_id long, page_index int, page_no int, label string, text string, width double, height double, rotation int, error string")


def cells(files: DataFrame) -> DataFrame:
    """Cells of spreadsheets with their styles: doc_id, sheet, sheet_no, row, col, value, bold, italic, underline, font_color,
    bg_color, error. A workbook that can't be read is one row with an error."""
    names = ["doc_id", "sheet", "sheet_no", "row", "col", "value", "bold", "italic", "underline", "font_color", "bg_color", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out: list[dict] = []
            for doc, content in zip(rows["doc_id"], rows["content"], strict=True):
                try:
                    out += [{"doc_id": doc} | cell for cell in office.sheet_cells(bytes(content))]
                except Exception as e:  # noqa: BLE001
                    out.append({"doc_id": doc, "error": f"{type(e).__name__}: {e}"})
            frame = pd.DataFrame(out, columns=names).astype(object)
            yield frame.where(frame.notna(), None).astype({c: "Int32" for c in ("sheet_no", "row", "col")})

    return files.select("doc_id", "content").mapInPandas(run, "doc_id long, sheet string, sheet_no int, row int, col int, value string, bold boolean, italic boolean, underline boolean, font_color string, bg_color string, error string")


def sheet_sizes(cells: DataFrame) -> DataFrame:
    """doc_id, sheet, rows, cols: the used range from the first cell."""
    return cells.where("row IS NOT NULL").groupBy("doc_id", "sheet").agg(F.max("row").alias("rows"), F.max("col").alias("cols"))


def column_widths(cells: DataFrame) -> DataFrame:
    """doc_id, sheet, col, width: the longest value and two, at least five."""
    return cells.where("row IS NOT NULL").groupBy("doc_id", "sheet", "col").agg(F.greatest(F.max(F.length("value")) + 2, F.lit(5)).alias("width"))


def rows_to_markdown(rows: DataFrame) -> DataFrame:
    """doc_id, markdown of rows (doc_id, row_no, cells): a pipe table in the rows' order, a rule after the first."""
    line = F.concat(F.lit("| "), F.array_join("cells", " | ", ""), F.lit(" |\n"))
    own = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("row_no", line.alias("line"), F.size("cells").alias("n")))).alias("x"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.element_at("x", 1)["n"]), F.lit("\n"))
    body = F.array_join(F.transform(F.slice("x", 2, F.greatest(F.size("x") - 1, F.lit(0))), lambda x: x["line"]), "")
    return own.select("doc_id", F.concat(F.element_at("x", 1)["line"], rule, body).alias("markdown"))


def html_to_markdown(documents: DataFrame, html_col: str = "html") -> DataFrame:
    """documents with title, markdown and error of their HTML: a document that can't be converted is its own row's error."""

    @F.pandas_udf("title string, markdown string, error string")
    def convert(html: pd.Series) -> pd.DataFrame:
        out = []
        for x in html:
            try:
                out.append((*(_html(x) if x is not None else (None, None)), None))
            except Exception as e:  # noqa: BLE001
                out.append((None, None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["title", "markdown", "error"])

    return documents.withColumn("__converted", convert(html_col)).select("*", "__converted.title", "__converted.markdown", "__converted.error").drop("__converted")


def layout_blocks(layouts: DataFrame) -> DataFrame:
    """Blocks of native layout trees (doc_id, layout as JSON): doc_id, seq, type, page, content, html, path, bbox, error.

    pdf_info is a list of pages with para_blocks (else preproc_blocks); a block's text is that of its spans, depth first; its
    children are part of it. Other types keep their names. A layout that can't be read is one row with an error.
    """
    renamed = {"title": "header", "interline_equation": "display_formula", "chart": "image"}

    def spans(block: dict):
        todo = [block]
        while todo:
            now = todo.pop()
            for line in now.get("lines") or ():
                yield from line.get("spans") or ()
            todo += reversed(now.get("blocks") or ())

    def blocks_of(doc: int, layout: str) -> Iterator[tuple]:
        import json

        seq = 0
        for page in json.loads(layout).get("pdf_info") or ():
            for block in page.get("para_blocks") or page.get("preproc_blocks") or ():
                own = list(spans(block))
                path = next((s["image_path"] for s in own if s.get("image_path")), None)
                html = "\n".join(s["html"] for s in own if s.get("html")) or None
                yield doc, seq, renamed.get(block.get("type"), block.get("type")), page.get("page_idx", 0) + 1, " ".join(s["content"] for s in own if s.get("content")) or None, html, path, block.get("bbox"), None
                seq += 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out: list[tuple] = []
            for doc, layout in zip(rows["doc_id"], rows["layout"], strict=True):
                try:
                    out += list(blocks_of(doc, layout))
                except Exception as e:  # noqa: BLE001
                    out.append((doc, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["doc_id", "seq", "type", "page", "content", "html", "path", "bbox", "error"]).astype({"seq": "Int64", "page": "Int32"})

    return layouts.select("doc_id", "layout").mapInPandas(run, "doc_id long, seq long, type string, page int, content string, html string, path string, bbox array<double>, error string")


def native_captions(layouts: DataFrame) -> DataFrame:
    """page texts (doc_id, page, bbox, text) of the caption children of native layout blocks, for pages without a text layer."""
    child = "array<struct<type:string,bbox:array<double>,lines:array<struct<spans:array<struct<content:string>>>>>>"
    block = f"struct<blocks:{child}>"
    tree = F.from_json("layout", f"struct<pdf_info:array<struct<page_idx:int,para_blocks:array<{block}>,preproc_blocks:array<{block}>>>>")
    pages = layouts.select("doc_id", F.explode(tree["pdf_info"]).alias("p"))
    blocks = F.when(F.size("p.para_blocks") > 0, F.col("p.para_blocks")).otherwise(F.col("p.preproc_blocks"))
    rows = pages.select("doc_id", (F.coalesce("p.page_idx", F.lit(0)) + 1).alias("page"), F.posexplode(blocks).alias("k", "b")).select("doc_id", "page", "k", F.posexplode("b.blocks").alias("j", "c"))
    text = F.array_join(F.transform(F.flatten(F.transform("c.lines", lambda x: x["spans"])), lambda x: F.coalesce(x["content"], F.lit(""))), " ")
    return rows.where(F.contains(F.coalesce("c.type", F.lit("")), F.lit("caption"))).select("doc_id", "page", (F.col("k") * 1000 + F.col("j")).alias("seq"), F.col("c.bbox").alias("bbox"), text.alias("text"))


def adapted(bodies: DataFrame, native: DataFrame, images: DataFrame) -> DataFrame:
    """Blocks of decoded documents: doc_id, seq, type, page, bbox, content, path, caption.

    bodies: doc_id, format, content. native: doc_id, seq, page, bbox, content (text blocks with pages); a document that has
    none is one text block of unknown page. images: doc_id, ordinal, page (from 0), path, caption; they follow all text, and
    only those of PDF files keep a page.
    """
    none = lambda kind: F.lit(None).cast(kind)
    text = native.select("doc_id", "seq", F.lit("text").alias("type"), "page", "bbox", "content", none("string").alias("path"), none("string").alias("caption"))
    rest = bodies.where(F.length("content") > 0).join(native.select("doc_id").distinct(), "doc_id", "left_anti")
    text = text.unionByName(rest.select("doc_id", F.lit(0).cast("long").alias("seq"), F.lit("text").alias("type"), none("int").alias("page"), none("array<double>").alias("bbox"), "content", none("string").alias("path"), none("string").alias("caption")))
    counts = text.groupBy("doc_id").agg(F.max("seq").alias("__last"))
    own = images.join(bodies.select("doc_id", "format"), "doc_id").join(counts, "doc_id", "left")
    seq = F.coalesce("__last", F.lit(-1)) + 1 + F.col("ordinal")
    pictures = own.select("doc_id", seq.alias("seq"), F.lit("image").alias("type"), F.when(F.col("format") == "pdf", F.col("page") + 1).alias("page"), none("array<double>").alias("bbox"), none("string").alias("content"), "path", "caption")
    return text.unionByName(pictures)


def result_json(results: DataFrame) -> DataFrame:
    """doc_id, json: a result's fields; the optional ones only where they are not empty, and images never.

    results: doc_id, title, text_content and any of the fields of a result; collections are arrays or maps.
    """
    always = [c for c in ("title", "text_content", "metadata", "sections", "tables", "pagination_info", "blocks") if c in results.columns]
    optional = [c for c in ("rendered_pages", "extracted_tables", "form_fields", "structure", "text_with_coords") if c in results.columns]
    plain = [c for c in ("processing_time_ms", "error") if c in results.columns]
    fields = [F.col(c) for c in always] + [F.when(F.size(c) > 0, F.col(c)).alias(c) for c in optional] + [F.col(c) for c in plain]
    return results.select("doc_id", F.to_json(F.struct(*fields)).alias("json"))
