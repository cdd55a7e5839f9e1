"""Operator 4: SimHash near-duplicates, with exact pairs from vantage-point trees.

1. Fingerprints: a majority vote over the XXH64 values of a text's word shingles, in one scan.
2. The distinct fingerprints are partitioned by Hamming distance: a vantage-point tree over a bounded sample of
   them has at every node a vantage point and the median distance from it. A fingerprint lives in one leaf, and
   also visits the leaves further out that the triangle inequality can't rule out for its radius.
3. In each leaf (one shard) a local vantage-point tree goes on splitting residents and visitors alike, down to
   small blocks that are compared bit by bit. So every pair within the radius is found in one leaf. A shard reports a
   spanning tree of each group it finds, which is as good as all pairs for components and no larger than the shard.
4. Components of the links by relabelling in Spark joins.

Copies of one fingerprint are aggregated before anything is compared, so a hot group of copies is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import bounded_batches, stored
from .components import connected_components, keep_first
from .shingle_dedup import similar_groups
from .vantage import near_links, scan_fingerprints


def simhash_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """Rows (id, text_key, fingerprint as long, group): fingerprints that differ in at most `radius` bits are linked.

    A-Z count as a-z; words `[^\\x20\\x09-\\x0D]+`; shingles of `shingle` words with repeats (a text with fewer words is one
    shingle); XXH64 with seed 42; a bit is set if over half of the values have it. group is the smallest id that links reach.

    Null and empty texts have fingerprint zero, which is linked like any other; null ids count in no minimum, so that a
    group of rows without ids has group null; repeated rows are repeated in the result; an empty table gives an empty one;
    other columns, whatever their names, are ignored. A text is held whole in one task. Ids are whole numbers, or text of such;
    any other id ends the job with Spark's CAST_INVALID_INPUT.
    """
    return _rooted(documents, id_col, text_col, shingle, radius).select("id", "text_key", "fingerprint", "group")


def _rooted(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """The rows of simhash_groups with root, a fingerprint of the component: unlike group it is never null."""
    bounded_batches(documents.sparkSession)
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    marks = stored(docs.mapInArrow(scan_fingerprints(shingle), "id long, text_key long, fingerprint long"))
    values = stored(marks.groupBy("fingerprint").agg(F.min("id").alias("first")))
    roots = connected_components(near_links(values.select(F.col("fingerprint").alias("value")), radius))
    rooted = values.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    rooted = stored(rooted)
    groups = rooted.groupBy("root").agg(F.min("first").alias("group"))
    return marks.join(rooted.join(groups, "root").select("fingerprint", "group", "root"), "fingerprint").select("id", "text_key", "fingerprint", "group", "root")


def drop_near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, similarity: float | None = None) -> DataFrame:
    """documents with one row of each group: the one with the smallest id (ties: the smallest text key). All columns stay.

    Without similarity, groups are those of simhash_groups. With it, they are what pairs of texts connect whose sets of shingles
    have that Jaccard similarity or more: the links of the fingerprints propose pairs, which are verified on the sets. Similar
    texts need not have close fingerprints (at a similarity of 0.8 some ten of 64 bits differ, where triangle bounds no
    longer prune), so the pairs that the fingerprints miss are joined by the sets' rarest shingles, exactly; see similar_groups.
    """
    if similarity is None:
        marks = _rooted(documents, id_col, text_col, shingle, radius)
    else:
        marks = similar_groups(documents, id_col, text_col, shingle, similarity, radius)
    return keep_first(documents, marks, id_col, text_col)


def op4_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.col("group").alias("component_id"))
