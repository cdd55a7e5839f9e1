"""Text operators as Column expressions: everything stays in the JVM and inside whole-stage code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import constants as K


def _column(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def _left(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def strip(text) -> Column:
    """The text without white space of any script at its ends."""
    return F.regexp_replace(_column(text), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


# -- text quality -----------------------------------------------------------------------------------------------------------


def quality_counts(text) -> dict[str, Column]:
    """Characters of a text: all, control characters, readable and alphanumeric ones."""
    text = F.coalesce(_column(text), F.lit(""))
    n = F.length(text)
    return {
        "n_chars": n,
        "n_control": n - _left(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"),
        "n_readable": n - _left(text, r"[\n\r\t \p{L}\p{M}\p{N}\p{P}\p{S}]"),
        "n_alnum": n - _left(text, r"[\p{L}\p{N}]"),
    }


def quality_metrics(text, pages=None) -> dict[str, Column]:
    """Unrounded ratios of control, printable and alphanumeric characters, and readable characters a page."""
    return _metrics(quality_counts(text), pages)


def _metrics(counts: dict[str, Column], pages=None) -> dict[str, Column]:
    n = F.greatest(counts["n_chars"], F.lit(1)).cast("double")
    pages = F.lit(1) if pages is None else F.when(_column(pages) > 0, _column(pages)).otherwise(1)
    return {
        "control_ratio": counts["n_control"] / n,
        "printable_ratio": counts["n_readable"] / n,
        "alnum_ratio": counts["n_alnum"] / n,
        "chars_per_page": counts["n_readable"].cast("double") / pages,
    }


def _state(counts: dict[str, Column], m: dict[str, Column]) -> Column:
    bad = (m["control_ratio"] >= 0.30) | (m["printable_ratio"] < 0.60) | (m["alnum_ratio"] < 0.10) | (m["chars_per_page"] < 40)
    poor = (m["control_ratio"] >= 0.12) | (m["printable_ratio"] < 0.85) | (m["alnum_ratio"] < 0.25) | (m["chars_per_page"] < 180)
    return F.when((counts["n_chars"] == 0) | bad, "unreadable").when(poor, "warn").otherwise("ok")


def quality_state(text, pages=None) -> Column:
    """unreadable, warn or ok, judged on the unrounded metrics. For tables of texts see with_quality."""
    counts = quality_counts(text)
    return _state(counts, _metrics(counts, pages))


def with_quality(documents: DataFrame, text: str = "text", pages: str | None = None) -> DataFrame:
    """documents with state and the four metrics; the characters of a text are counted once for all of them."""
    rows = documents.withColumns({f"__{name}": c for name, c in quality_counts(text).items()})
    counts = {name: F.col(f"__{name}") for name in ("n_chars", "n_control", "n_readable", "n_alnum")}
    metrics = _metrics(counts, pages)
    return rows.withColumns({"state": _state(counts, metrics)} | metrics).drop(*[f"__{name}" for name in counts])


def cid_ratio(text) -> Column:
    """Share of (cid:n) glyph codes among the codes and the other characters of a text; over 0.05 points at broken fonts."""
    text = F.coalesce(_column(text), F.lit(""))
    codes = F.regexp_extract_all(text, F.lit(r"(\(cid:\d+\))"), 1)
    n = F.size(codes)
    rest = F.length(F.replace(text, F.lit("\n"), F.lit(""))) - F.length(F.array_join(codes, ""))
    return F.when(n + rest > 0, n / (n + rest)).otherwise(0.0)


# -- scalar rewrites --------------------------------------------------------------------------------------------------------


def content_limit(text, limit: int = K.CONTENT_LIMIT) -> Column:
    """A text of at most limit characters; a longer one is cut and says so."""
    text = _column(text)
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(K.TRUNCATED))).otherwise(text)


def latex_commands(longest_first: bool = False) -> list[tuple[str, str]]:
    """Literal replacements in their order. longest_first mends commands that begin with another command's name."""
    commands = [(f"\\{name}", c) for name, c in [*K.GREEK.items(), *K.MATH.items()]]
    if longest_first:
        commands.sort(key=lambda x: -len(x[0]))
    return [(f"(cid:{code})", c) for code, c in K.CID_CHARACTERS.items()] + commands


def fix_latex(text, longest_first: bool = False) -> Column:
    """Glyph codes, Greek letters and mathematical commands as characters; single exponents and indices without braces."""
    out = reduce(lambda t, x: F.replace(t, F.lit(x[0]), F.lit(x[1])), latex_commands(longest_first), _column(text))
    for pattern in (r"\^\{(\d+)\}", r"_\{(\d+)\}", r"\^\{([a-zA-Z])\}", r"_\{([a-zA-Z])\}"):
        out = F.regexp_replace(out, pattern, ("^" if pattern[1] == "^" else "_") + "$1")
    return out


def safe_name(text) -> Column:
    """A name of letters, digits, - and _ for an output folder."""
    return F.regexp_replace(_column(text), "[^a-zA-Z0-9_-]", "_")


def safe_stem(text) -> Column:
    """The same, keeping letters and digits of all scripts."""
    return F.regexp_replace(_column(text), r"[^\p{L}\p{N}_-]", "_")


def first_line_title(text) -> Column:
    """The first line, stripped, if it has 1 to 199 characters."""
    line = strip(F.element_at(F.split(_column(text), "\n"), 1))
    return F.when((F.length(line) > 0) & (F.length(line) < 200), line)


# -- files ------------------------------------------------------------------------------------------------------------------


def extension(path) -> Column:
    """The last extension with its dot, in lower case; empty if there is none."""
    name = F.regexp_extract(_column(path), r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(name, r"^\.*[^.].*?(\.[^.]*)$", 1))


def detect_format(path) -> Column:
    """The format of a file by its extension; null if it is unknown."""
    known = F.create_map(*[F.lit(x) for pair in K.FORMATS.items() for x in pair])
    return F.element_at(known, extension(path))


def image_type(path) -> Column:
    known = F.create_map(*[F.lit(x) for pair in K.IMAGE_TYPES.items() for x in pair])
    return F.coalesce(F.element_at(known, extension(path)), F.lit("image/jpeg"))


def safe_member(path) -> Column:
    """Whether an archive member stays inside the archive: relative, and not above its root at any step."""
    path = F.replace(_column(path), F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    # the deepest that .. reaches: below zero is outside
    depth = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("least")),
        lambda acc, x: F.struct(
            F.when(x == "..", acc["now"] - 1).otherwise(acc["now"] + 1).alias("now"),
            F.least(acc["least"], F.when(x == "..", acc["now"] - 1).otherwise(acc["now"] + 1)).alias("least"),
        ),
    )
    return ~path.startswith("/") & ~path.rlike("^[A-Za-z]:") & (depth["least"] >= 0)


# -- figures and captions ---------------------------------------------------------------------------------------------------


def figure_references(text) -> Column:
    """Distinct numbers of figures that a text names, ascending."""
    found = F.regexp_extract_all(F.coalesce(_column(text), F.lit("")), F.lit(K.FIGURE_REFERENCE), 1)
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int"))))


def caption_kind(text) -> Column:
    """table or figure if the text is a caption, else null."""
    word = F.lower(F.regexp_extract(_column(text), K.CAPTION, 1))
    return F.when(word == "", None).when(word.isin("table", "表"), "table").otherwise("figure")


def caption_label(text) -> Column:
    """The caption's number in upper case, else null."""
    return F.nullif(F.upper(F.regexp_extract(_column(text), K.CAPTION, 2)), F.lit(""))


def chapter_heading(text) -> Column:
    """The chapter heading in the first characters of a page, by the first pattern that matches; null if none does."""
    head = F.substring(_column(text), 1, K.SCAN_CHARS)
    return F.coalesce(*[F.when(head.rlike(p), F.trim(F.regexp_replace(F.regexp_extract(head, p, 0), r"\s+$", ""))) for p in K.CHAPTER_PATTERNS])


def title_keywords(title) -> Column:
    """Words of three or more characters that are no stop words; if there are none, the first three words."""
    words = F.regexp_extract_all(F.coalesce(_column(title), F.lit("")), F.lit(r"(?U)(\w{3,})"), 1)
    kept = F.filter(words, lambda x: ~F.lower(x).isin(K.TITLE_STOP_WORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(F.slice(words, 1, 3))


def numeric_label(label) -> Column:
    """A page label that is a number, as one."""
    text = strip(label)
    return F.when(text.rlike(r"^\d+$"), text.try_cast("int"))


def sample_pages(pages) -> Column:
    """Indices of up to ten evenly spaced pages of so many, ascending."""
    n = _column(pages)
    k = F.least(n, F.lit(K.SAMPLE_PAGES))
    spread = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.rint(i * (n - 1) / (k - 1)).cast("int"))
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= K.SAMPLE_PAGES, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1).cast("array<int>")).otherwise(F.array_sort(F.array_distinct(spread)))


# -- images -----------------------------------------------------------------------------------------------------------------


def image_metadata(path) -> dict[str, Column]:
    """Page and number of an image, its kind and the source of a region, from the file's name."""
    name = F.regexp_extract(_column(path), r"([^/]*)$", 1)
    token = F.lower(F.regexp_extract(name, K.IMAGE_KIND, 1))
    region = token.isin("cluster", "drawing", "image_block")
    return {
        "page_in_chunk": F.nullif(F.regexp_extract(name, K.IMAGE_NAME, 1), F.lit("")).cast("int"),
        "image_index_in_page": F.nullif(F.regexp_extract(name, K.IMAGE_NAME, 2), F.lit("")).cast("int"),
        "kind": F.when(token == "", "unknown").when(region, "vector_region").otherwise(token),
        "region_source": F.when(region, token),
    }


def candidate_labels(path, kind, region_source) -> Column:
    """Sorted labels of what an image may be."""
    path, kind, source = F.lower(_column(path)), _column(kind), _column(region_source)
    vector = kind == "vector_region"
    named = F.array(
        F.when(path.contains("table"), F.lit("table_like")),
        F.when(path.contains("formula") | path.contains("math"), F.lit("formula_like")),
        F.when(path.contains("icon"), F.lit("icon_like")),
        F.when((kind == "raster") | (vector & (source == "image_block")), F.lit("figure_like")),
        F.when(F.coalesce(vector & source.isin("drawing", "cluster"), F.lit(False)) | ~F.coalesce(kind, F.lit("")).isin("raster", "vector_region"), F.lit("unknown")),
    )
    found = F.filter(named, lambda x: x.isNotNull())
    return F.array_sort(F.array_distinct(F.when(F.size(found) == 0, F.array(F.lit("unknown"))).otherwise(found)))


def difference_hash(pixels) -> Column:
    """64 bits of an 8 by 9 greyscale array (row by row): whether a pixel is brighter than the one to its right."""
    p = _column(pixels)
    places = F.lit([r * 9 + c + 1 for r in range(8) for c in range(8)])
    return F.aggregate(places, F.lit(0).cast("long"), lambda acc, i: F.shiftleft(acc, 1).bitwiseOR((F.element_at(p, i) > F.element_at(p, i + 1)).cast("long")))


def hamming(a, b) -> Column:
    return F.bit_count(_column(a).bitwiseXOR(_column(b)))


def hash_distance(a, b) -> Column:
    """Differing bits of two hexadecimal hashes; null if their lengths differ or one is no hash."""
    a, b = _column(a), _column(b)
    good = (F.length(a) == F.length(b)) & a.rlike("^[0-9a-fA-F]{1,16}$") & b.rlike("^[0-9a-fA-F]{1,16}$")
    return F.when(good, hamming(F.conv(a, 16, -10).cast("long"), F.conv(b, 16, -10).cast("long")))


# -- geometry: a box is x0, y0, x1, y1 ---------------------------------------------------------------------------------------


def ordered_box(box) -> Column:
    b = _column(box)
    return F.array(F.least(b[0], b[2]), F.least(b[1], b[3]), F.greatest(b[0], b[2]), F.greatest(b[1], b[3]))


def expanded_box(box, by: float, width, height) -> Column:
    b = _column(box)
    return F.array(F.greatest(F.lit(0.0), b[0] - by), F.greatest(F.lit(0.0), b[1] - by), F.least(_column(width), b[2] + by), F.least(_column(height), b[3] + by))


def valid_box(box, width, height) -> Column:
    """Four finite numbers inside the page, with a positive width and height."""
    b = _column(box)
    finite = (F.size(b) == 4) & ~F.exists(b, lambda v: v.isNull() | F.isnan(v) | v.isin(float("inf"), float("-inf")))
    at = [F.get(b, F.lit(i)) for i in range(4)]
    inside = (at[0] >= 0) & (at[0] < at[2]) & (at[2] <= _column(width)) & (at[1] >= 0) & (at[1] < at[3]) & (at[3] <= _column(height))
    return F.coalesce(finite & inside, F.lit(False))


def box_area(box) -> Column:
    b = _column(box)
    return F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1])


def box_overlap(a, b) -> Column:
    """Area of the intersection of two boxes."""
    a, b = _column(a), _column(b)
    return F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


# -- HTML, where a document needs no parser ---------------------------------------------------------------------------------


def html_title(html) -> Column:
    """Text of the title element, stripped; null if there is none."""
    return F.nullif(strip(F.regexp_extract(_column(html), r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def html_text(html) -> Column:
    """The text without comments, scripts, styles and tags, white space as single blanks."""
    out = F.regexp_replace(_column(html), r"(?s)<!--.*?-->", " ")
    for tag in ("script", "style"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(?s)<[^>]*>", " "), r"[ \t\r\n]+", " "))


def html_links(html) -> Column:
    """Targets of links that a Markdown rendering keeps: relative ones and those of http, https and file."""
    found = F.regexp_extract_all(_column(html), F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), 1)
    scheme = lambda x: F.lower(F.regexp_extract(x, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.filter(found, lambda x: scheme(x).isin("", "http", "https", "file"))
