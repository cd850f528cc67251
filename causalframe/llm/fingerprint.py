"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the k least different hashes of a text's shingles, ascending. The sketch of a whole is the k least of its
parts' sketches, so they merge; two sketches estimate resemblance, containment and numbers of different shingles.
All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causalframe.llm.scratch import table, written
from causalframe.llm.shingles import hashes, let, words

K = 128
WIDTH = 5
_SPAN = float(1 << 63)


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """array<long>: the k least different 63-bit hashes of the shingles of a text. Empty for a text of no words, or null."""
    return F.slice(F.sort_array(F.array_distinct(F.transform(hashes(words(text), width), lambda h: F.shiftrightunsigned(h, 1)))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both sets together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_count(a: Column, k: int = K) -> Column:
    """The estimated number of different shingles: exact below k."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) * F.lit(_SPAN) / F.get(a, F.lit(k - 1)))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of common shingles among all of both: 1 if both are empty."""
    both = lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)
    return F.when(a == b, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(let(merged(a, b, k), both))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of the shingles of a that are in b: 1 if a is empty."""
    common = resemblance(a, b, k) * distinct_count(merged(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), common / distinct_count(a, k)))


def text_of(a: Column) -> Column:
    """A sketch as text: 16 hex digits a hash."""
    return F.lower(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def _followers(keys: DataFrame) -> DataFrame:
    """keys with next_id0 and next_tie: of each key the one behind it in descending order, and behind the last the first.

    keys: doc_id, id0, tie and others. Keys are range-partitioned and written; places follow within each part, and a table of one
    row a part links their ends. Null doc_ids come last.
    """
    parts = written(keys.repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie").withColumn("part", F.spark_partition_id()), "order")
    rows = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "tie")
    me = F.struct("id0", "tie")
    here = parts.withColumn("next", F.lag(me).over(rows)).withColumn("place", F.row_number().over(rows))
    ends = here.groupBy("part").agg(F.max_by(me, "place").alias("last"))
    order = Window.orderBy("part")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lag("last").over(order), F.last("last").over(whole)).alias("before"))
    linked = here.join(ends, "part").withColumn("next", F.coalesce("next", "before"))
    return linked.select(*keys.columns, F.col("next.id0").alias("next_id0"), F.col("next.tie").alias("next_tie"))


def with_edits(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """Sketches of each text, of the text with its last third replaced by the next document's beginning, and likenesses.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, sketch, n_distinct (the
    estimated number of different shingles). A null text is empty. Rows without a doc_id come behind all others; rows
    of one doc_id follow by the hash of their texts; a doc_id may be of any type that has an order; rows that repeat both are one place in that order and each has
    its result. A sole document is followed by itself. An empty table gives no rows.
    """
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    id0 = F.xxhash64("doc_id").alias("id0")
    texts = texts.select("doc_id", id0, F.xxhash64("doc_id", "text").alias("tie"), "text")
    keys = texts.select("doc_id", "id0", "tie", F.char_length("text").alias("n")).groupBy("doc_id", "id0", "tie", "n").agg(F.count("*").alias("rows"))
    follow = written(_followers(keys), "follow")
    repeated = (follow.agg(F.max("rows")).first()[0] or 1) > 1

    # Both joins read the texts by the same key and columns, so that one exchange of them serves both.
    texts = texts.select("id0", "tie", "text")
    asks = follow.select("doc_id", F.col("id0").alias("to_id0"), F.col("tie").alias("to_tie"), F.col("next_id0").alias("id0"), F.col("next_tie").alias("tie"), F.expr("n div 3").alias("need"))
    gift = F.substring(F.col("text"), F.lit(1), F.col("need").cast("int"))
    gifts = texts.join(asks, ["id0", "tie"]).select("doc_id", "to_id0", "to_tie", F.col("need").cast("int").alias("need"), gift.alias("gift"), sketch(F.col("text"), k, width).alias("next_sketch"))
    if repeated:
        gifts = gifts.dropDuplicates(["to_id0", "to_tie"])
    rows = texts.join(gifts, (texts["id0"] == gifts["to_id0"]) & (texts["tie"] == gifts["to_tie"]))
    size = F.char_length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), size - F.col("need")), F.col("gift"))
    rows = rows.select("doc_id", size.cast("long").alias("n_chars"), sketch(F.col("text"), k, width).alias("sketch"), edited.alias("edited"), "next_sketch")
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), "sketch", sketch(F.col("edited"), k, width).alias("edited_sketch"), "next_sketch")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", text_of(F.col("sketch")).alias("fingerprint"), text_of(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"), "sketch", distinct_count(F.col("sketch"), k).alias("n_distinct"),
    )


def op5_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return with_edits(table(spark, sf_dir, "documents")).drop("sketch")
