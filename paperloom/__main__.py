"""python -m paperloom convert PATH --out FOLDER: files of a path to tables and Markdown, one Spark job for all of them.

Writes pages, texts, blocks, documents, chunks, quality, index and markdown below the folder, which must not have them yet, prints the counts
of each status as JSON, and exits with 0 (all complete), 2 (some failed) or 1 (all failed).
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import sinks
from .api import Corpus
from .session import configure


def _split(value: str) -> str | int | None:
    """How documents are divided: auto, by chapters, not at all, or every so many pages."""
    names = {"auto": "auto", "chapter": "chapters", "chapters": "chapters", "section": "chapters", "off": None, "false": None, "none": None}
    if value in names:
        return names[value]
    if value.isdigit() and int(value) > 0:
        return int(value)
    raise argparse.ArgumentTypeError("auto, chapter, section, off or a positive number of pages")


def convert(spark: SparkSession, path: str, out: str, split: str | int | None = "auto", first_page: int | None = None, last_page: int | None = None, mode: str = "physical", strict: bool = False) -> dict[str, int]:
    """Documents of each status. first_page and last_page are inclusive, from 0 or, in the logical mode, as readers count them;
    everything that is written holds these pages only. strict: the range is one chunk."""
    corpus = Corpus.read(spark, path).limited(first_page, last_page, mode).decoded_once(out)
    chunks = corpus.plan(None if strict else split)
    for name, rows in (("documents", corpus.results()), ("blocks", corpus.blocks()), ("chunks", sinks.structural_toc(chunks)), ("quality", corpus.quality())):
        sinks.write_table(rows, f"{out}/{name}")
    for name, rows, column in (("markdown", corpus.markdown(), "markdown"), ("index", corpus.index(), "json")):
        sinks.write_texts(rows, f"{out}/{name}", column)
    return dict(spark.read.parquet(f"{out}/documents").groupBy("status").count().collect())


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="paperloom", description=__doc__.split("\n")[0])
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("convert")
    one.add_argument("path")
    one.add_argument("--out", required=True)
    one.add_argument("--chapter-split", "--split", dest="split", type=_split, default="auto")
    one.add_argument("--start-page", type=int, help="first page: an index from 0, or a page number in the logical mode")
    one.add_argument("--end-page", type=int, help="last page, counted likewise")
    one.add_argument("--page-range-mode", choices=("physical", "logical"), default="physical")
    one.add_argument("--strict-page-range", action="store_true", help="the range is one chunk")
    args = parser.parse_args(argv)
    spark = configure(SparkSession.builder.appName("paperloom")).getOrCreate()
    counts = convert(spark, args.path, args.out, args.split, args.start_page, args.end_page, args.page_range_mode, args.strict_page_range)
    failed, all_ = counts.get("failed", 0), sum(counts.values())
    status = "failed" if failed == all_ else "partial" if failed else "complete"
    print(json.dumps({"schema_version": "1.0", "status": status, "documents": counts}))
    return {"complete": 0, "partial": 2, "failed": 1}[status]


if __name__ == "__main__":
    sys.exit(main())
