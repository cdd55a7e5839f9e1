"""Images of documents: exact and near duplicates, figure slots, and which image is which figure."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T


def with_checksums(images: DataFrame, content: str = "content") -> DataFrame:
    return images.withColumn("checksum", F.sha2(F.col(content), 256))


def exact_groups(images: DataFrame) -> DataFrame:
    """One row for each distinct image of a document.

    images: doc_id, path, checksum (null: the file is missing), ordinal, kind, label, phash. The first occurrence stands for
    its group; kinds and labels are sorted and unique; the hash is the first that is known; a missing file is a group of its own.
    """
    key = F.coalesce("checksum", F.format_string("missing_%06d", F.col("ordinal").cast("int")))
    return images.groupBy("doc_id", key.alias("group_key")).agg(
        F.min_by("path", "ordinal").alias("path"),
        F.count("*").alias("occurrences"),
        F.min("ordinal").alias("first_ordinal"),
        F.first("checksum").alias("checksum"),
        F.array_sort(F.collect_set("kind")).alias("kinds"),
        F.array_sort(F.collect_set("label")).alias("labels"),
        F.min_by("phash", F.when(F.col("phash").isNotNull(), F.col("ordinal"))).alias("phash"),
    )


def near_hashes(hashes: DataFrame, most: int) -> DataFrame:
    """(key, x, y, bits) of distinct 64-bit hashes (key, phash) of one key that differ in at most `most` bits, each pair both ways.

    Of most + 1 bands of bits two such hashes agree in one at least; so only hashes that share a band meet, and a pair is kept
    once however many bands it shares. Copies of a hash are one row, so they never meet each other.
    """
    bands, at, parts = most + 1, 0, []
    for k in range(bands):
        width = 64 // bands + (1 if k < 64 % bands else 0)
        mask = (1 << width) - 1 if width < 64 else -1
        parts.append(F.struct(F.lit(k).alias("band"), F.shiftrightunsigned("phash", at).bitwiseAND(F.lit(mask)).alias("bits")))
        at += width
    rows = hashes.select("key", "phash", F.explode(F.array(*parts)).alias("p")).select("key", "phash", "p.band", "p.bits")
    left, right = (rows.withColumnRenamed("phash", s) for s in "xy")
    met = left.join(right, ["key", "band", "bits"]).where("x <> y").withColumn("apart", T.hamming("x", "y")).where(F.col("apart") <= most)
    return met.groupBy("key", "x", "y").agg(F.min("apart").alias("bits"))


def near_pairs(images: DataFrame, most: int = K.NEAR_DUPLICATE_BITS, key: str = "doc_id") -> DataFrame:
    """(key, a, b, bits) of images whose 64-bit hashes (phash, long) differ in at most `most` bits, a before b by ordinal."""
    rows = images.where("phash IS NOT NULL").select(F.col(key).alias("key"), "ordinal", "phash")
    a, b = (rows.select("key", F.col("ordinal").alias(n), F.col("phash").alias(h)) for n, h in (("a", "x"), ("b", "y")))
    near = near_hashes(rows.select("key", "phash").distinct(), most).join(a, ["key", "x"]).join(b, ["key", "y"]).where("a < b").select("key", "a", "b", "bits")
    same = a.join(b.withColumnRenamed("y", "x"), ["key", "x"]).where("a < b").select("key", "a", "b", F.lit(0).alias("bits"))
    return near.unionByName(same).withColumnRenamed("key", key)


def _greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of a document at a time: rows (key, a, b: members of an anchor a, itself included) come in order of key, a and b."""
    key_of, taken, anchor, members = None, set(), None, []
    out: dict[str, list] = {"key": [], "anchor": [], "member": []}

    def close() -> None:
        if anchor is not None and anchor not in taken:
            for m in members:
                out["key"].append(key_of)
                out["anchor"].append(anchor)
                out["member"].append(m)
            taken.update(members)

    for batch in batches:
        for key, a, b in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if (key, a) != (key_of, anchor):
                close()
                if key != key_of:
                    taken.clear()
                key_of, anchor, members = key, a, []
            members.append(b)
        yield _emptied(out)
    close()
    yield _emptied(out)


def _emptied(out: dict[str, list]) -> pa.RecordBatch:
    batch = pa.RecordBatch.from_arrays([pa.array(out[n], pa.int64()) for n in out], names=list(out))
    for v in out.values():
        v.clear()
    return batch


def near_groups(images: DataFrame, most: int = K.NEAR_DUPLICATE_BITS, key: str = "doc_id", first_only: bool = False) -> DataFrame:
    """(key, anchor, member, group_no): the first free image and all later ones near it are a group; groups may share members.

    With first_only, an image that any earlier one is near is no anchor, though no group has it.
    The scan is greedy in the images' order, so it is a fold: it streams the pairs in order and keeps one document's members.
    Copies of a hash are free or taken together, so that the fold runs over distinct hashes, each named by its first image.
    """
    rows = images.where("phash IS NOT NULL").select(F.col(key).cast("long").alias("key"), F.col("ordinal").cast("long").alias("ordinal"), "phash")
    hashes = rows.groupBy("key", "phash").agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))
    a, b = hashes.select("key", F.col("phash").alias("x"), F.col("first").alias("a")), hashes.select("key", F.col("phash").alias("y"), F.col("first").alias("b"), "last")
    met = near_hashes(hashes.select("key", "phash"), most).join(a, ["key", "x"]).join(b, ["key", "y"]).select("key", "a", "b", "last")
    near = met.where("last > a").select("key", "a", "b")
    some = near.select("key", "a").union(hashes.where("last > first").select("key", "first")).distinct()  # anchors that have members
    pairs = near.unionByName(some.select("key", "a", F.col("a").alias("b")))
    if first_only:
        pairs = pairs.join(met.where("b < a").select("key", "a").distinct(), ["key", "a"], "left_anti")
    found = pairs.repartition("key").sortWithinPartitions("key", "a", "b").mapInArrow(_greedy, "key long, anchor long, member long")
    copies = rows.join(hashes, ["key", "phash"]).select("key", F.col("first").alias("member"), "ordinal")
    each = found.join(copies, ["key", "member"]).where("ordinal >= anchor").select("key", "anchor", F.col("ordinal").alias("member"))
    order = Window.partitionBy("key").orderBy("anchor")
    return each.withColumn("group_no", F.dense_rank().over(order)).withColumnRenamed("key", key)


def figure_slots(documents: DataFrame, text_col: str = "markdown") -> DataFrame:
    """Places of figures in Markdown: doc_id, slot_no, slot_id, line_no (from 1), figure_no, caption, page_hint.

    A caption line is one slot, and other references on it do not count; every reference on another line is a slot without
    caption. The hint is the first page of the last header of a page range.
    """
    lines = documents.select("doc_id", F.posexplode(F.split(F.col(text_col), K.LINE_BREAKS)).alias("line", "text"))
    header = F.nullif(F.regexp_extract("text", K.CHUNK_HEADER, 1), F.lit("")).cast("int")
    order = Window.partitionBy("doc_id").orderBy("line")
    rows = lines.withColumns({"__header": header, "page_hint": F.last(header, True).over(order)}).where("__header IS NULL")
    number = F.nullif(F.regexp_extract("text", K.FIGURE_CAPTION, 1), F.lit(""))
    caption = F.when(number.isNotNull(), F.regexp_extract("text", K.FIGURE_CAPTION, 2))
    found = F.when(number.isNotNull(), F.array(number)).otherwise(F.regexp_extract_all("text", F.lit(K.FIGURE_REFERENCE), 1))
    slots = rows.select("doc_id", "line", "page_hint", caption.alias("caption"), F.posexplode(found).alias("k", "number"))
    place = Window.partitionBy("doc_id").orderBy("line", "k")
    return slots.withColumn("slot_no", F.row_number().over(place)).select("doc_id", "slot_no", F.format_string("slot_%04d", F.col("slot_no")).alias("slot_id"), (F.col("line") + 1).alias("line_no"), F.col("number").cast("int").alias("figure_no"), "caption", "page_hint")


def match_score(page_hint, image_page, figure_like):
    """0.7 for the nearness of known pages (twelve apart and more is nothing) and 0.2 for what looks like a figure."""
    near = F.when(page_hint.isNotNull() & image_page.isNotNull(), 0.7 * F.greatest(F.lit(0.0), F.lit(1.0) - F.least(F.abs(image_page - page_hint), F.lit(12)) / 12.0)).otherwise(0.0)
    return near + F.when(figure_like, 0.2).otherwise(0.0)


def match_figures(slots: DataFrame, images: DataFrame, kept: int = K.CANDIDATES_KEPT) -> DataFrame:
    """The best candidates of each slot: doc_id, slot_no, rank, image_no, score (4 digits).

    images: doc_id, image_no, page, labels. Slots and images meet within their document only; ties go to the earlier image,
    and candidates without any score are left out.
    """
    rows = slots.join(images, "doc_id").withColumn("__score", match_score(F.col("page_hint"), F.col("page"), F.array_contains("labels", "figure_like")))
    order = Window.partitionBy("doc_id", "slot_no").orderBy(F.col("__score").desc(), "image_no")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= kept) & (F.col("__score") > 0))
    return ranked.select("doc_id", "slot_no", "rank", "image_no", F.round("__score", 4).alias("score"))


def validate_decisions(decisions: DataFrame, slots: DataFrame, images: DataFrame, groups: DataFrame) -> DataFrame:
    """Issues (doc_id, entry, issue) of mapping decisions: slots, images and groups that do not exist.

    An empty slot and a null image or group are no issues.
    """

    def missing(column: str, known: DataFrame, name: str, issue: str) -> DataFrame:
        asked = decisions.where(F.col(column).isNotNull() & (F.col(column) != "")).select("doc_id", "entry", F.col(column).alias("__x"))
        there = known.select("doc_id", F.col(name).alias("__x"))
        return asked.join(there, ["doc_id", "__x"], "left_anti").select("doc_id", "entry", F.lit(issue).alias("issue"))

    return missing("slot_id", slots, "slot_id", "unknown_slot").unionByName(missing("image_id", images, "image_id", "unknown_image")).unionByName(missing("group_id", groups, "group_id", "unknown_group"))


def decision_tally(decisions: DataFrame) -> DataFrame:
    status = F.lower("status")
    return decisions.groupBy("doc_id").agg(*[F.count_if(status == s).alias(s) for s in ("matched", "ambiguous", "unmatched")])


def dhash_of(pixels: list[list[int]]) -> int:
    """The difference hash of 8 rows of 9 grey values, for providers that have decoded an image."""
    p = np.asarray(pixels)
    return int.from_bytes(np.packbits(p[:, :-1] > p[:, 1:]).tobytes(), "big")


# -- manifest ---------------------------------------------------------------------------------------------------------------


def image_order(images: DataFrame) -> DataFrame:
    """images with image_no (from 1) and image_id by page (else the chunk's first), place on it, number and path.

    images: doc_id, path, phys_start, estimated_page, page_in_chunk, image_index.
    """
    page = F.coalesce("estimated_page", F.col("phys_start") + 1)
    order = Window.partitionBy("doc_id").orderBy(page.asc_nulls_last(), F.col("page_in_chunk").asc_nulls_last(), F.col("image_index").asc_nulls_last(), "path")
    number = F.row_number().over(order)
    return images.withColumn("image_no", number).withColumn("image_id", F.format_string("image_%04d", F.col("image_no")))


def occurrences(images: DataFrame) -> DataFrame:
    """images (doc_id, path, chunk_index, phys_start) with what their names tell, their page in the file and a linked name."""
    rows = images.withColumns(T.image_metadata("path"))
    page = F.col("phys_start") + F.col("page_in_chunk") + 1
    place = F.row_number().over(Window.partitionBy("doc_id", "chunk_index").orderBy("path"))
    link = F.concat(F.lit("chunk-"), F.col("chunk_index").cast("string"), F.lit("-images-"), place.cast("string"), T.extension("path"))
    return rows.withColumns({"estimated_page": page, "linked_path": link, "labels": T.candidate_labels("path", "kind", "region_source")})


def groups_of_candidates(matches: DataFrame, groups: DataFrame) -> DataFrame:
    """matches (doc_id, slot_no, rank, image_no) with near_group: the last group that has the image (groups may overlap)."""
    last = groups.groupBy("doc_id", F.col("member").alias("image_no")).agg(F.max("group_no").alias("near_group"))
    return matches.join(last, ["doc_id", "image_no"], "left")


def mapping_template(slots: DataFrame, matches: DataFrame) -> DataFrame:
    """doc_id, slot_id, figure_no, caption, candidates (by rank), status pending, for a reader's decisions."""
    own = matches.groupBy("doc_id", "slot_no").agg(F.array_sort(F.collect_list(F.struct("rank", "image_no", "score"))).alias("candidates"))
    rows = slots.join(own, ["doc_id", "slot_no"], "left")
    return rows.select("doc_id", "slot_id", "figure_no", "caption", F.coalesce("candidates", F.array().cast(own.schema["candidates"].dataType)).alias("candidates"), F.lit("pending").alias("status"))


def decision_example(template: DataFrame, entries: int = 2) -> DataFrame:
    """The first slots of each document with their best candidate as the decision."""
    order = Window.partitionBy("doc_id").orderBy("slot_id")
    rows = template.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= entries)
    best = F.get("candidates", F.lit(0))["image_no"]
    return rows.select("doc_id", "slot_id", best.alias("image_no"), F.when(best.isNotNull(), "matched").otherwise("unmatched").alias("status"))


def manifest_totals(raw: DataFrame, groups: DataFrame, near: DataFrame) -> DataFrame:
    """doc_id, raw_images, unique_images, near_groups."""
    a = raw.groupBy("doc_id").agg(F.count("*").alias("raw_images"))
    b = groups.groupBy("doc_id").agg(F.count("*").alias("unique_images"))
    c = near.groupBy("doc_id").agg(F.max("group_no").alias("near_groups"))
    return a.join(b, "doc_id", "left").join(c, "doc_id", "left").select("doc_id", "raw_images", F.coalesce("unique_images", F.lit(0)).alias("unique_images"), F.coalesce("near_groups", F.lit(0)).alias("near_groups"))


def readable_images(files: DataFrame, most_mb: int = 20) -> DataFrame:
    """Image files of at most so many megabytes."""
    return files.where((F.col("length") > 0) & (F.col("length") <= most_mb * 1024 * 1024) & F.element_at(F.create_map(*[F.lit(x) for p in K.IMAGE_TYPES.items() for x in p]), T.extension("path")).isNotNull())
