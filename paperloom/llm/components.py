"""Connected components of a link table, by relabelling in Spark joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import discard, key_filter, maybe_in, numbered, renamed, stored


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is a node of the component, the same for all its nodes.

    Each round draws a new random order of the labels, gives every node the first label among itself and its neighbours,
    and rewrites the links with the new labels; links whose ends agree go. In a random order a constant share of the labels
    goes in each round, whatever the shape of the component, so a path of n links takes rounds in proportion to the logarithm
    of n. Minima are aggregated before they are shuffled, and each round is written to the shared folder. The rounds' maps
    shrink as the labels do, and are joined to one, the smallest first. Nothing is collected but "are links left".
    """
    links = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps: list[DataFrame] = []
    while not (steps and links.isEmpty()):
        order = lambda c: F.struct(F.xxhash64(c, F.lit(len(steps))).alias("order"), F.col(c).alias("label"))  # noqa: B023, E731
        ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
        first = ends.groupBy("node").agg(F.min(order("other")).alias("other"))
        step = stored(first.select("node", F.least("other", order("node"))["label"].alias("root")))
        a = step.select(F.col("node").alias("a"), F.col("root").alias("__a"))
        b = step.select(F.col("node").alias("b"), F.col("root").alias("__b"))
        moved = stored(links.join(a, "a").join(b, "b").where("__a <> __b").select(F.least("__a", "__b").alias("a"), F.greatest("__a", "__b").alias("b")).distinct())
        discard(links)
        links = moved
        steps.append(step)
    discard(links)
    roots = steps.pop()
    while steps:
        step = steps.pop()
        later = roots.select(F.col("node").alias("root"), F.col("root").alias("__last"))
        joined = stored(step.join(later, "root", "left").select("node", F.coalesce("__last", "root").alias("root")))
        discard(step, roots)
        roots = joined
    return roots


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least reachable node of each of n nodes, in memory."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def spanning_links(label: np.ndarray, fan: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the nodes of each component as a shallow tree in which no node has more than fan + 1."""
    size = np.bincount(label, minlength=len(label))
    nodes = np.flatnonzero(size[label] > 1)
    nodes = nodes[np.argsort(label[nodes], kind="stable")]
    roots = label[nodes]
    first = np.flatnonzero(np.append(True, roots[1:] != roots[:-1])) if len(nodes) else np.empty(0, np.int64)
    count = np.diff(np.append(first, len(nodes)))
    place = np.arange(len(nodes)) - np.repeat(first, count)
    child = np.flatnonzero(place > 0)
    above = child - place[child] + (place[child] - 1) // fan
    return nodes[child], nodes[above]


def keep_first(documents: DataFrame, marks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """documents with one row of each group, all columns as they are; marks has a row (id, text_key, root) for each document, root (never null) naming its group."""
    marks = stored(marks.select("id", "text_key", "root"))
    # both sides are stored, so that a large group's rows meet their one best in a plain join of two exchanges, which AQE can split
    keys = stored(marks.groupBy("root", "id", "text_key").agg(F.count("*").alias("n")))
    best = stored(marks.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("best")))
    judged = keys.join(best, "root").select("id", "text_key", "n", (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("text_key") == F.col("best.text_key"))).alias("__stays"))
    others = stored(judged.where("NOT __stays OR n > 1"))
    discard(marks, keys, best)
    columns = documents.columns
    own = [f"c{k}" for k in range(len(columns))]
    rows = numbered(documents).withColumns({"id": F.col(f"c{columns.index(id_col)}").cast("long"), "text_key": F.xxhash64(f"c{columns.index(text_col)}")})
    marked = maybe_in(rows, key_filter(others, "id", "text_key"), "id", "text_key")
    calm = marked.where("NOT __maybe").select(*own)
    known = others.select(F.col("id").alias("other"), F.col("text_key").alias("other_key"), "__stays")
    busy = marked.where("__maybe").join(known, F.col("id").eqNullSafe(F.col("other")) & (F.col("text_key") == F.col("other_key")), "left")
    busy = busy.where("coalesce(__stays, true)").dropDuplicates(["id", "text_key"]).select(*own)
    return renamed(calm.unionByName(busy), columns)
