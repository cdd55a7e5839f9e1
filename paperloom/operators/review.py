"""Rule-based review of regions and captions on pages.

pages: page_id, width, height. regions: page_id, region_id, seq, bbox (array of four), type, caption_id (null: none).
captions: page_id, caption_id, bbox, kind, label. All joins are within a page.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T


def caption_candidates(pages: DataFrame, regions: DataFrame, captions: DataFrame) -> DataFrame:
    """(page_id, region_id, caption_id, gap, place): captions in a region's column and near it, with no region between, nearest first."""
    r = regions.select("page_id", "region_id", F.col("bbox").alias("r"))
    c = captions.select("page_id", "caption_id", F.col("bbox").alias("c"))
    rx, cx = F.col("r"), F.col("c")
    shared = F.greatest(F.lit(0.0), F.least(rx[2], cx[2]) - F.greatest(rx[0], cx[0])) / F.greatest(F.lit(1.0), F.least(rx[2] - rx[0], cx[2] - cx[0]))
    gap = F.greatest(F.lit(0.0), cx[1] - rx[3], rx[1] - cx[3])
    near = r.join(c, "page_id").join(pages.select("page_id", "height"), "page_id").withColumn("gap", gap).where((shared >= 0.3) & (F.col("gap") <= F.col("height") * 0.15))
    other = regions.select("page_id", F.col("region_id").alias("__other"), F.col("bbox").alias("o"))
    ox = F.col("o")
    between = (F.col("__other") != F.col("region_id")) & (F.least(rx[3], cx[3]) <= ox[1]) & (ox[3] <= F.greatest(rx[1], cx[1])) & (F.least(ox[2], cx[2]) > F.greatest(ox[0], cx[0]))
    n, o = near.alias("n"), other.alias("o_")
    clear = n.join(o, (F.col("n.page_id") == F.col("o_.page_id")) & between, "left_anti")
    order = Window.partitionBy("page_id", "region_id").orderBy("gap", "caption_id")
    return clear.select("page_id", "region_id", "caption_id", "gap").withColumn("place", F.row_number().over(order))


def associate_captions(pages: DataFrame, regions: DataFrame, captions: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Each region with selected_id (a single candidate, or one over 12 points nearer than the next), effective_id and candidates."""
    found = caption_candidates(pages, regions, captions) if found is None else found
    own = found.groupBy("page_id", "region_id").agg(F.count("*").alias("candidates"), F.max(F.when(F.col("place") == 1, F.col("caption_id"))).alias("__first"), (F.max(F.when(F.col("place") == 2, F.col("gap"))) - F.max(F.when(F.col("place") == 1, F.col("gap")))).alias("__lead"))
    out = regions.join(own, ["page_id", "region_id"], "left")
    clear = (F.col("candidates") == 1) | (F.col("__lead") > 12)
    out = out.withColumn("selected_id", F.when(clear, F.col("__first"))).withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    return out.withColumn("effective_id", F.coalesce("caption_id", "selected_id")).drop("__first", "__lead")


def overlapping_regions(regions: DataFrame) -> DataFrame:
    """(page_id, a, b) of regions of which the smaller lies in the other by more than 0.8, a before b."""
    a, b = (regions.select("page_id", F.col("region_id").alias(s), F.col("seq").alias(f"{s}_seq"), F.col("bbox").alias(f"{s}_box")) for s in "ab")
    share = T.box_overlap("a_box", "b_box") / F.greatest(F.lit(1.0), F.least(T.box_area("a_box"), T.box_area("b_box")))
    return a.join(b, "page_id").where((F.col("a_seq") < F.col("b_seq")) & (share > 0.8)).select("page_id", "a", "b")


def review_issues(pages: DataFrame, regions: DataFrame, captions: DataFrame) -> DataFrame:
    """Issues (page_id, region_id, check, issue) of all rules."""
    candidates = caption_candidates(pages, regions, captions)
    rows = associate_captions(pages, regions, captions, candidates).join(pages.select("page_id", "width", "height"), "page_id")
    chosen = captions.select("page_id", F.col("caption_id").alias("selected_id"), F.col("kind").alias("__kind"))
    rows = rows.join(chosen, ["page_id", "selected_id"], "left")
    shared = F.count(F.col("effective_id")).over(Window.partitionBy("page_id", "effective_id"))
    rows = rows.withColumn("__shared", F.when(F.col("effective_id").isNotNull(), shared))
    labels = captions.withColumn("__same", F.count("*").over(Window.partitionBy("page_id", "kind", "label"))).where("__same > 1").select("page_id", "caption_id")
    doubled = candidates.join(labels, ["page_id", "caption_id"], "left_semi").select("page_id", "region_id").distinct().withColumn("__doubled", F.lit(True))
    pairs = overlapping_regions(regions)
    crossed = pairs.select("page_id", F.col("a").alias("region_id")).union(pairs.select("page_id", "b")).distinct().withColumn("__crossed", F.lit(True))
    rows = rows.join(doubled, ["page_id", "region_id"], "left").join(crossed, ["page_id", "region_id"], "left")
    expected = F.when(F.col("__kind") == "table", "table").otherwise("image")
    conflict = F.col("selected_id").isNotNull() & (F.col("type") != "unknown") & (F.col("type") != expected) & ~((expected == "image") & (F.col("type") == "chart"))
    none = F.col("selected_id").isNull()
    rules = [
        ("boundary", "invalid_bounds", ~T.valid_box("bbox", "width", "height")),
        ("boundary", "overlapping_regions", F.col("__crossed")),
        ("category", "unknown_category", F.col("type") == "unknown"),
        ("category", "caption_category_conflict", conflict),
        ("association", "duplicate_caption_labels", F.col("__doubled")),
        ("association", "upstream_caption_conflict", F.col("caption_id").isNotNull() & (F.col("caption_id") != F.col("selected_id"))),
        ("association", "ambiguous_captions", none & (F.col("candidates") > 0)),
        ("association", "missing_caption", none & (F.col("candidates") == 0)),
        ("association", "unassigned_caption", F.col("effective_id").isNull()),
        ("association", "shared_caption_possible_panels", F.col("__shared") > 1),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(check).alias("check"), F.lit(issue).alias("issue"))) for check, issue, when in rules]), lambda x: x.isNotNull())
    return rows.select("page_id", "region_id", F.explode(found).alias("x")).select("page_id", "region_id", "x.check", "x.issue")


def region_states(regions: DataFrame, issues: DataFrame) -> DataFrame:
    """(page_id, region_id, issues, status): a region with any issue needs review."""
    n = issues.groupBy("page_id", "region_id").agg(F.count("*").alias("issues"))
    out = regions.select("page_id", "region_id").join(n, ["page_id", "region_id"], "left").withColumn("issues", F.coalesce("issues", F.lit(0)))
    return out.withColumn("status", F.when(F.col("issues") > 0, "needs_review").otherwise("rule_passed"))


def select_pages(states: DataFrame, mode: str = "auto", budget: int = 8, group: str | None = None) -> DataFrame:
    """page_id, needed, requested of pages: online asks for all with regions, auto for those that need review, offline for none;
    the first `budget` in page order (of each group, if a column is given) are requested."""
    keys = ["page_id"] if group is None else [group, "page_id"]
    pages = states.groupBy(*keys).agg(F.bool_or(F.col("status") == "needs_review").alias("__open"))
    needed = {"online": F.lit(True), "auto": F.col("__open"), "offline": F.lit(False)}[mode]
    rows = pages.withColumn("needed", needed)
    order = Window.partitionBy(*([F.lit(0)] if group is None else [group]), "needed").orderBy("page_id")
    if group is None:  # the budget is small: the first pages by order, without a window over all pages
        first = rows.where("needed").orderBy("page_id").limit(budget).select("page_id", F.lit(True).alias("requested"))
        return rows.join(first, "page_id", "left").select("page_id", "needed", F.coalesce("requested", F.lit(False)).alias("requested"))
    return rows.withColumn("requested", F.col("needed") & (F.row_number().over(order) <= budget)).drop("__open")


def rollup(states: DataFrame, keys: list[str]) -> DataFrame:
    """Regions, unresolved ones and the status of each group of pages."""
    out = states.groupBy(*keys).agg(F.count("*").alias("regions"), F.count_if(F.col("status") == "needs_review").alias("unresolved"))
    return out.withColumn("status", F.when(F.col("unresolved") > 0, "needs_review").otherwise("rule_passed"))


def validate_responses(decisions: DataFrame, pages: DataFrame, regions: DataFrame, captions: DataFrame) -> DataFrame:
    """page_id, valid, broken (sorted names of rules): a page's decisions hold all or not at all.

    decisions: page_id, region_id, type, bbox, caption_id, status, reason, merge_with, split_boxes.
    """
    known_r = regions.select("page_id", F.col("region_id"), F.lit(True).alias("__region"))
    known_c = captions.select("page_id", F.col("caption_id"), F.lit(True).alias("__caption"))
    all_ids = regions.groupBy("page_id").agg(F.collect_set("region_id").alias("__ids"))
    rows = decisions.join(known_r, ["page_id", "region_id"], "left").join(known_c, ["page_id", "caption_id"], "left").join(pages.select("page_id", "width", "height"), "page_id").join(all_ids, "page_id", "left")
    times = F.count("*").over(Window.partitionBy("page_id", "region_id"))
    rows = rows.withColumn("__times", times)
    merge, split = F.col("merge_with"), F.col("split_boxes")
    rules = [
        ("unknown_or_repeated_region", F.col("__region").isNull() | (F.col("__times") > 1)),
        ("invalid_type", ~F.coalesce(F.col("type").isin(K.REGION_TYPES), F.lit(False))),
        ("invalid_status", ~F.coalesce(F.col("status").isin(K.DECISION_STATES), F.lit(False))),
        ("invalid_coordinates", ~T.valid_box("bbox", "width", "height")),
        ("unknown_caption", F.col("caption_id").isNotNull() & F.col("__caption").isNull()),
        ("missing_reason", F.coalesce(F.length(T.strip("reason")), F.lit(0)) == 0),
        ("invalid_merge", merge.isNotNull() & ((F.size(F.array_except(merge, "__ids")) > 0) | F.array_contains(merge, F.col("region_id")))),
        ("invalid_split", split.isNotNull() & ((F.size(split) < 2) | F.exists(split, lambda b: ~T.valid_box(b, "width", "height")))),
    ]
    broken = F.filter(F.array(*[F.when(F.coalesce(when, F.lit(False)), F.lit(name)) for name, when in rules]), lambda x: x.isNotNull())
    own = rows.groupBy("page_id").agg(F.array_distinct(F.flatten(F.collect_list(broken))).alias("__broken"), F.collect_set("region_id").alias("__seen"))
    out = pages.select("page_id").join(all_ids, "page_id").join(own, "page_id", "left")
    empty = F.array().cast("array<string>")
    missing = F.size(F.array_except("__ids", F.coalesce("__seen", empty))) > 0
    found = F.array_sort(F.concat(F.coalesce("__broken", empty), F.when(missing, F.array(F.lit("incomplete_coverage"))).otherwise(empty)))
    return out.select("page_id", (F.size(found) == 0).alias("valid"), found.alias("broken"))


_REQUIRED = ["region_id", "type", "bbox", "caption_id", "status", "reason"]


def read_responses(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decisions of raw responses (page_id, payload as JSON) for validate_responses, and what is malformed (page_id, problem).

    A response is an object with an array `regions` of objects that have all required fields.
    """
    items = F.from_json(F.get_json_object("payload", "$.regions"), "array<string>")
    is_list = F.coalesce(F.get_json_object("payload", "$.regions"), F.lit("")).startswith("[")
    rows = responses.select("page_id", F.when(is_list, items).alias("items"))
    shape = rows.where("items IS NULL").select("page_id", F.lit("no_regions_array").alias("problem"))
    each = rows.select("page_id", F.explode("items").alias("item"))
    keys = F.json_object_keys("item")
    body = F.from_json("item", "region_id string, type string, bbox array<double>, caption_id string, status string, reason string, merge_with array<string>, split_boxes array<array<double>>")
    each = each.withColumns({"__keys": keys, "__body": body})
    record = each.where("__keys IS NULL").select("page_id", F.lit("invalid_record").alias("problem"))
    missing = F.size(F.array_except(F.array(*map(F.lit, _REQUIRED)), "__keys")) > 0
    fields = each.where(F.col("__keys").isNotNull() & missing).select("page_id", F.lit("missing_fields").alias("problem"))
    return each.where("__keys IS NOT NULL").select("page_id", "__body.*"), shape.union(record).union(fields).distinct()


def with_problems(verdicts: DataFrame, problems: DataFrame) -> DataFrame:
    """Verdicts of validate_responses with the problems of read_responses: a malformed response is invalid as a whole."""
    own = problems.groupBy("page_id").agg(F.collect_set("problem").alias("__problems"))
    rows = verdicts.join(own, "page_id", "left")
    broken = F.array_sort(F.array_union("broken", F.coalesce("__problems", F.array().cast("array<string>"))))
    return rows.select("page_id", (F.size(broken) == 0).alias("valid"), broken.alias("broken"))


def requests(pages: DataFrame, regions: DataFrame, captions: DataFrame, issues: DataFrame, image_bytes: DataFrame, most_mb: int = 20) -> DataFrame:
    """page_id, body (JSON: width, height, captions, regions with what they are and their checks), error.

    image_bytes: page_id, bytes of the pictures that go along; a page with more than most_mb megabytes is not asked for.
    """
    checks = issues.groupBy("page_id", "region_id").agg(F.array_sort(F.collect_set("issue")).alias("checks"))
    own = regions.join(checks, ["page_id", "region_id"], "left").withColumn("checks", F.coalesce("checks", F.array().cast("array<string>")))
    r = own.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("seq", "region_id", "bbox", "type", "caption_id", "checks"))).alias("__r"))
    c = captions.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("caption_id", "kind", "label", "bbox"))).alias("captions"))
    size = image_bytes.groupBy("page_id").agg(F.sum("bytes").alias("__bytes"))
    rows = pages.join(r, "page_id").join(c, "page_id", "left").join(size, "page_id", "left")
    listed = F.transform("__r", lambda x: F.struct(x["region_id"].alias("region_id"), x["bbox"].alias("bbox"), x["type"].alias("type"), x["caption_id"].alias("caption_id"), x["checks"].alias("checks")))
    body = F.to_json(F.struct("width", "height", F.coalesce("captions", F.array().cast(c.schema["captions"].dataType)).alias("captions"), listed.alias("regions")))
    large = F.coalesce(F.col("__bytes"), F.lit(0)) > most_mb * 1024 * 1024
    return rows.select("page_id", F.when(~large, body).alias("body"), F.when(large, "request_too_large").alias("error"))


def page_outcomes(pages: DataFrame, selected: DataFrame, verdicts: DataFrame, enabled: bool = True) -> DataFrame:
    """page_id, outcome: not_requested, unavailable, budget_exhausted, reviewed or failed (no answer, or an invalid one)."""
    rows = pages.select("page_id").join(selected, "page_id", "left").join(verdicts.select("page_id", "valid"), "page_id", "left")
    needed, asked = F.coalesce("needed", F.lit(False)), F.coalesce("requested", F.lit(False))
    outcome = F.when(~needed, "not_requested").when(~F.lit(enabled), "unavailable").when(~asked, "budget_exhausted").when(F.coalesce("valid", F.lit(False)), "reviewed").otherwise("failed")
    return rows.select("page_id", outcome.alias("outcome"))


def reviewed_regions(states: DataFrame, decisions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """states with status after review: on reviewed pages ambiguous (so decided, or with a proposal to merge or split) or vlm_reviewed."""
    good = decisions.join(outcomes.where("outcome = 'reviewed'"), "page_id", "left_semi")
    open_ = (F.col("status") == "ambiguous") | (F.size("merge_with") > 0) | (F.size("split_boxes") > 0)
    own = good.select("page_id", "region_id", F.when(F.coalesce(open_, F.lit(False)), "ambiguous").otherwise("vlm_reviewed").alias("__status"))
    return states.join(own, ["page_id", "region_id"], "left").withColumn("status", F.coalesce("__status", "status")).drop("__status")


def review_report(states: DataFrame, outcomes: DataFrame, keys: DataFrame) -> DataFrame:
    """doc_id, status, regions, unresolved, api_calls, warnings of each document; keys: page_id, doc_id, page_no."""
    unresolved = F.col("status").isin("needs_review", "ambiguous")
    own = states.groupBy("page_id").agg(F.count("*").alias("regions"), F.count_if(unresolved).alias("unresolved"))
    rows = keys.join(outcomes, "page_id").join(own, "page_id", "left")
    bad = F.col("outcome").isin("failed", "unavailable", "budget_exhausted")
    note = F.when(bad, F.struct("page_no", F.concat(F.lit("page "), F.col("page_no").cast("string"), F.lit(": "), F.col("outcome")).alias("text")))
    out = rows.groupBy("doc_id").agg(
        F.coalesce(F.sum("regions"), F.lit(0)).alias("regions"),
        F.coalesce(F.sum("unresolved"), F.lit(0)).alias("unresolved"),
        F.count_if(F.col("outcome").isin("reviewed", "failed")).alias("api_calls"),
        F.transform(F.array_sort(F.collect_list(note)), lambda x: x["text"]).alias("warnings"),
    )
    status = F.when(F.col("regions") == 0, "no_regions_detected").when((F.col("unresolved") > 0) | (F.size("warnings") > 0), "needs_review").when(F.col("api_calls") > 0, "vlm_reviewed").otherwise("rule_passed")
    return out.withColumn("status", status)


def apply_decisions(regions: DataFrame, decisions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Regions with type, bbox and caption_id as decided, on pages whose decisions are valid; others as they were."""
    good = decisions.join(verdicts.where("valid"), "page_id", "left_semi").select("page_id", "region_id", *[F.col(c).alias(f"__{c}") for c in ("type", "bbox", "caption_id", "status")])
    out = regions.join(good, ["page_id", "region_id"], "left")
    done = F.col("__status").isNotNull()
    return out.withColumns({c: F.when(done, F.col(f"__{c}")).otherwise(F.col(c)) for c in ("type", "bbox", "caption_id")} | {"review_status": F.col("__status")}).drop("__type", "__bbox", "__caption_id", "__status")


# -- what is reviewed -------------------------------------------------------------------------------------------------------


def _kept(rows: DataFrame, columns: list[str], keep) -> DataFrame:
    """rows that keep(kept so far on the page, *values of the columns) lets pass, page by page in the order of seq: a fold that
    streams its pages and remembers the kept rows of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, page, kept = False, None, {}
        for batch in batches:
            passes = []
            for own, *values in zip(*[batch.column(c).to_pylist() for c in ("page_id", *columns)], strict=True):
                if not begun or own != page:
                    begun, page, kept = True, own, {}
                passes.append(keep(kept, *values))
            yield batch.filter(pa.array(passes, pa.bool_()))

    return rows.repartition("page_id").sortWithinPartitions("page_id", "seq").mapInArrow(run, rows.schema)


def _shared_area(a: list[float], b: list[float]) -> float:
    return max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))


def distinct_regions(regions: DataFrame, share: float = 0.98) -> DataFrame:
    """regions (page_id, region_id, seq, bbox) without those that nearly equal an earlier one that is kept."""
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])

    def keep(kept: dict, box: list[float]) -> bool:
        boxes = kept.setdefault("boxes", [])
        if any(_shared_area(box, o) / max(1.0, area(box), area(o)) > share for o in boxes):
            return False
        boxes.append(box)
        return True

    return _kept(regions, ["bbox"], keep)


def distinct_captions(captions: DataFrame) -> DataFrame:
    """captions (page_id, caption_id, seq, bbox, text) without those with the text of an earlier kept one that they meet."""

    def keep(kept: dict, box: list[float], text: str | None) -> bool:
        boxes = kept.setdefault((text or "").strip(), [])
        if any(_shared_area(box, o) > 0 for o in boxes):
            return False
        boxes.append(box)
        return True

    return _kept(captions, ["bbox", "text"], keep)


def captions_of_texts(lines: DataFrame) -> DataFrame:
    """lines (page_id, seq, bbox, text) that are captions, with caption_id, kind and label."""
    order = Window.partitionBy("page_id").orderBy("seq")
    rows = lines.withColumns({"kind": T.caption_kind("text"), "label": T.caption_label("text")}).where("kind IS NOT NULL")
    return rows.withColumn("caption_id", F.concat(F.lit("c"), F.row_number().over(order).cast("string")))


def upstream_captions(regions: DataFrame, captions: DataFrame) -> DataFrame:
    """regions (page_id, region_id, caption) with caption_id: the first caption whose text the region's caption contains."""
    rows = regions.join(captions.select("page_id", "seq", F.col("caption_id").alias("__id"), T.strip("text").alias("__text")), "page_id").where(F.contains("caption", F.col("__text")))
    first = rows.groupBy("page_id", "region_id").agg(F.min_by("__id", "seq").alias("caption_id"))
    return regions.drop("caption_id").join(first, ["page_id", "region_id"], "left")


def pages_in_range(pages: DataFrame, processed: DataFrame) -> DataFrame:
    """Pages (doc_id, page_no) that were processed: whole numbers of pages that there are, once each."""
    wanted = processed.select("doc_id", F.explode(F.array_distinct("processed_pages")).alias("page_no"))
    return pages.join(wanted, ["doc_id", "page_no"], "left_semi")
