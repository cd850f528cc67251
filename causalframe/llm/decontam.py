"""Benchmark items inside documents: size-partitioned containment search by MinHash sketches, verified exactly.

The hashes of an item's shingles are put in ascending order, which is a random order. If a document holds the share t
of an item's q shingles, it lacks at most q - ceil(t q) of them, so it holds one of the q - ceil(t q) + 1 least: that
bottom-k sketch is all that an item posts, and no item is missed. Documents are partitioned by the power of two of
their number of shingles, repeats included, which is no less than that of different ones, and an item posts its sketch only to the partitions whose documents are large
enough to hold it. The greatest hash posted to a partition is its threshold: a document's sketch is its hashes up to that
of its own partition, and nothing else of it is looked up. Documents that hit a sketch are verified by counting an item's shingles, as text, in them.

Banding of signatures, as an LSH ensemble does it, is no use here: an item of 40 shingles in a document of 10,000 has a
resemblance of 0.003, and the bands to find that are more than the document's shingles. Hence the items' sketches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causalframe.llm.scratch import fresh, small, table, written
from causalframe.llm.shingles import MARKS, hashes, let, strings, words

#: A side of a join is broadcast up to so many counted rows, of a hash and two numbers or of one shingle.
BROADCAST_ROWS = 200_000
TOP_CLASS = 40


def _class(size: Column) -> Column:
    """The partition of a size: the power of two below it."""
    return F.floor(F.log2(F.greatest(size, F.lit(1)))).cast("int")


def contained(docs: DataFrame, items: DataFrame, least: float = 0.8, width: int = 5) -> DataFrame:
    """row_key, doc_id, item_id, n_shared, n_item, containment: the items of which documents hold the share least or more.

    Words are runs of letters and digits, lower-cased; shingles are sets. An item of fewer than width words is one
    shingle of as many words as it has, found wherever these follow each other; one of no words is found nowhere, and
    null texts have none. row_key is a hash of doc_id and text: repeated rows of docs give one row for each item, and rows
    without a doc_id are told apart by it. Each row of items is an item by itself, whatever its item_id, a null one too;
    those of one id and one set of shingles count once. Only doc_id, item_id and text are read.
    """
    n_words = F.least(F.size(words(F.col("text"), MARKS)), F.lit(width)).alias("width")
    items = written(items.select("item_id", "text", n_words).where("width > 0"), "texts")
    widths = sorted({width, *(r["width"] for r in items.select("width").distinct().collect())})
    return reduce(DataFrame.unionByName, [_contained(docs, items.where(F.col("width") == w), least, w) for w in widths])


def _contained(docs: DataFrame, items: DataFrame, least: float, width: int) -> DataFrame:
    """contained() of items of width words at least."""
    items = items.select("item_id", F.array_sort(F.array_distinct(strings(words(F.col("text"), MARKS), width))).alias("own")).distinct()
    items = written(items.select(F.xxhash64("item_id", "own").alias("item"), "item_id", "own", F.size("own").alias("n_item")), "items")
    need = F.ceil(F.col("n_item") * F.lit(least) - F.lit(1e-9)).cast("int")
    hashed = F.sort_array(F.array_distinct(F.transform("own", lambda s: hashes(F.split(s, " "), width)[0])))
    sketch = items.select("n_item", need.alias("need"), F.slice(hashed, F.lit(1), F.col("n_item") - need + 1).alias("least"))
    fits = F.explode(F.sequence(_class(F.col("need")), F.lit(TOP_CLASS)))
    posts = sketch.select("need", "least", fits.alias("class")).select("class", F.explode("least").alias("h")).distinct()
    posts = written(posts, "posts")
    tops = posts.groupBy("class").agg(F.max("h").alias("top")).collect()  # a row for each partition

    key = F.xxhash64("doc_id", "text").alias("row_key")
    sets = docs.select(key, hashes(words(F.col("text"), MARKS), width).alias("own")).withColumn("class", _class(F.size("own")))
    top = F.create_map(*[F.lit(x) for r in tops for x in (r["class"], r["top"])])[F.col("class")] if tops else F.lit(None).cast("long")
    least_of = let(top, lambda t: F.filter("own", lambda h: h <= t))
    probes = sets.select("row_key", "class", F.explode(least_of).alias("h"))
    hits = written(probes.join(small(posts, BROADCAST_ROWS), ["class", "h"], "left_semi").select("row_key").distinct(), "hits")

    wanted = docs.select(key, "doc_id", "text").join(small(hits, BROADCAST_ROWS), "row_key", "left_semi").select("row_key", "doc_id", "text")
    found = wanted.select("row_key", "doc_id", F.explode(F.array_distinct(strings(words(F.col("text"), MARKS), width))).alias("s")).distinct()
    shingles = items.select("item", "item_id", "n_item", F.explode("own").alias("s"))
    shared = found.join(small(shingles, BROADCAST_ROWS), "s")
    counts = shared.groupBy("row_key", "doc_id", "item", "item_id", "n_item").agg(F.count("*").alias("n_shared"))
    share = F.col("n_shared") / F.col("n_item")
    return counts.where(F.col("n_shared") >= F.ceil(F.col("n_item") * F.lit(least) - F.lit(1e-9))).select("row_key", "doc_id", "item_id", "n_shared", F.col("n_item").cast("long").alias("n_item"), share.alias("containment"))


def decontaminated(docs: DataFrame, items: DataFrame, least: float = 0.8) -> DataFrame:
    """The rows of docs that hold no item; the columns of docs."""
    name = fresh(docs, "row_key")
    found = written(contained(docs, items, least).select(F.col("row_key").alias(name)).distinct(), "found")
    return docs.withColumn(name, F.xxhash64("doc_id", "text")).join(small(found, BROADCAST_ROWS), name, "left_anti").drop(name)


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every benchmark item of which a document holds four fifths of the 5-word shingles or more, over all documents."""
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_key")


OP3_SQL = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x != '') w from documents),
b as (select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x != '') w from benchmark),
ds as (select distinct doc_id, unnest(case when len(w) >= 5 then [array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)] when len(w) > 0 then [array_to_string(w, ' ')] else [] end) s from d),
bs as (select distinct item_id, unnest(case when len(w) >= 5 then [array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)] when len(w) > 0 then [array_to_string(w, ' ')] else [] end) s from b),
n as (select item_id, count(*) n_item from bs group by item_id)
select doc_id, item_id, count(*) as n_shared, n_item, count(*) / n_item as containment
from ds join bs using (s) join n using (item_id) group by doc_id, item_id, n_item having count(*) >= ceil(n_item * 0.8 - 1e-9)
"""
