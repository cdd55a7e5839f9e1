"""Keyed answer and result caches as tables: expiry, lookup, work lists, statistics; and run status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def answer_key(image_hash, question, model, version: str) -> Column:
    """SHA-256 of the request as JSON with sorted keys."""
    body = F.to_json(F.struct(F.col(image_hash).alias("image_hash"), F.col(model).alias("model"), F.lit(version).alias("prompt_version"), F.col(question).alias("question")))
    return F.sha2(body, 256)


def live_entries(entries: DataFrame, now: Column, ttl_seconds: int = 3600, at: str = "ts") -> DataFrame:
    """Entries that have not expired."""
    return entries.where(now - F.unix_timestamp(at) <= ttl_seconds)


def cache_statistics(entries: DataFrame, now: Column, size: str, at: str = "ts", by: list[str] | None = None) -> DataFrame:
    """Entries, bytes, and the ages of the oldest and the newest, of all or of each group of the columns in `by`."""
    rows = entries.withColumn("__age", now - F.unix_timestamp(at))
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("entries"), F.sum(size).alias("bytes"), F.max("__age").alias("oldest"), F.min("__age").alias("newest"))


def look_up(requests: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Requests with the cached answer and cache_hit."""
    known = cache.select(F.col(key), F.col("answer"), F.lit(True).alias("__hit"))
    return requests.join(known, key, "left").withColumn("cache_hit", F.coalesce("__hit", F.lit(False))).drop("__hit")


def work_list(requests: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """One request for each key that the cache doesn't have: the first by ordinal."""
    missing = requests.join(cache.select(key), key, "left_anti")
    return missing.groupBy(key).agg(F.min("ordinal").alias("ordinal"), F.count("*").alias("waiting"))


def invalidate(entries: DataFrame, gone: DataFrame, key: str = "key") -> DataFrame:
    """The cache without the entries of the given keys; the entries of an empty table are none, so clearing is a filter on nothing."""
    return entries.join(gone.select(key).distinct(), key, "left_anti")


def batches(requests: DataFrame, size: int, run: str = "run_id") -> DataFrame:
    """requests (run_id, ordinal) with batch_no: slices of `size` in each run's order; a size below one counts as one."""
    order = Window.partitionBy(run).orderBy("ordinal")
    return requests.withColumn("batch_no", F.floor((F.row_number().over(order) - 1) / F.lit(max(1, size))).cast("int"))


def not_ready(parts: DataFrame, most: int = 5) -> DataFrame:
    """name, ready, warning of backends: their first missing parts, joined. parts: name, ordinal, part, present."""
    missing = F.array_sort(F.collect_list(F.when(~F.col("present"), F.struct("ordinal", "part"))))
    own = parts.groupBy("name").agg(F.transform(F.slice(missing, 1, most), lambda x: x["part"]).alias("__m"))
    return own.select("name", (F.size("__m") == 0).alias("ready"), F.when(F.size("__m") > 0, F.concat("name", F.lit(" is not ready: "), F.array_join("__m", "; "))).alias("warning"))


def select_backend(formats: DataFrame, backends: DataFrame, fallback: str = "simple") -> DataFrame:
    """format, backend: of the available backends that support it (null formats: all) the one of least priority number."""
    usable = backends.where("available").select(F.struct("priority", "name").alias("best"), "formats")
    named = usable.select(F.explode("formats").alias("format"), "best").groupBy("format").agg(F.min("best").alias("__named"))
    general = usable.where("formats IS NULL").agg(F.min("best").alias("__general"))  # one row
    best = F.least("__named", "__general")
    return formats.join(named, "format", "left").join(F.broadcast(general)).select("format", F.coalesce(best["name"], F.lit(fallback)).alias("backend"))


def answer(requests: DataFrame, cache: DataFrame, ask=None) -> DataFrame:
    """requests (ordinal, key, question, content) with answer, error and cache_hit; equal keys are asked once.

    ask: a function of (question, content) to a text, run on the executors; an answer that begins with "Error:" is an error.
    Without one, requests that the cache doesn't answer fail with "not configured". The order is the requests' ordinal.
    """

    def run(batches):
        import pandas as pd

        for rows in batches:
            out = []
            for key, question, content in zip(rows["key"], rows["question"], rows["content"], strict=True):
                try:
                    text = ask(question, content) if ask else "Error: not configured"
                except Exception as e:  # noqa: BLE001  a failed request is a row with an error
                    text = f"Error: {e}"
                out.append((key, None, text) if text.startswith("Error:") else (key, text, None))
            yield pd.DataFrame(out, columns=["key", "__new", "error"])

    first = work_list(requests, cache).select("key", "ordinal")
    asked = requests.join(first, ["key", "ordinal"], "left_semi").select("key", "question", "content")
    fresh = asked.mapInPandas(run, "key string, __new string, error string")
    out = look_up(requests, cache).join(fresh, "key", "left")
    return out.withColumn("answer", F.coalesce("answer", "__new")).drop("__new")


def with_defaults(results: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """results with a default for each null or missing column; warnings stay unique in their order."""
    for name, value in defaults.items():
        results = results.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in results.columns else F.lit(value))
    if "warnings" in results.columns:
        results = results.withColumn("warnings", F.array_distinct(F.coalesce("warnings", F.array().cast("array<string>"))))
    return results


def analysis_markdown(answers: DataFrame) -> DataFrame:
    """ordinal, markdown: an answer as a page of its own."""
    text = F.concat(F.lit("# Image analysis\n\n**Image:** "), "path", F.lit("\n\n**Question:** "), "question", F.lit("\n\n"), F.coalesce("answer", F.concat(F.lit("Error: "), F.coalesce("error", F.lit("unknown")))))
    return answers.select("ordinal", text.alias("markdown"))
