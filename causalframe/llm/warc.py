"""WARC fixity audit by Merkle trees.

Records of a WARC file are hashed and are the leaves, in order of offset; a leaf hashes its record's offsets with it, and
every inner node the offset range that it covers and its children's hashes. Two replicas agree if the roots of their files do. Where they do not, children are
compared level by level, below mismatching nodes only, down to the records that are damaged, moved, missing or extra.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causalframe.llm.scratch import fresh, table, written

FANOUT = 16
RECORDS_PER_FILE = 4096


def record(key: Column, url: Column, body: Column) -> Column:
    """The text of a WARC 1.1 resource record. Null parts are empty."""
    body = F.coalesce(body, F.lit(""))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    head = ["WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:", text(key), ">\r\nWARC-Target-URI: ", text(url), "\r\nContent-Type: text/html\r\nContent-Length: ", F.octet_length(body).cast("string"), "\r\n\r\n"]
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in head], body, F.lit("\r\n\r\n"))


def placed(rows: DataFrame, by: list[str], weight: str) -> DataFrame:
    """rows with ordinal (from 0, in ascending order of by, nulls first) and before (the sum of weight of all rows before).

    Rows are range-partitioned and written; sums run within parts and over a table of one row a part. Columns of rows by
    the two names are replaced.
    """
    rows = rows.drop("ordinal", "before")
    part, n0, w0 = (fresh(rows, n) for n in ("_part", "_n0", "_w0"))
    order = [F.col(c).asc_nulls_first() for c in by]
    parts = written(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "placed")
    ends = parts.groupBy(part).agg(F.count("*").alias("n"), F.sum(weight).alias("w"))
    up = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(part, F.coalesce(F.sum("n").over(up), F.lit(0)).alias(n0), F.coalesce(F.sum("w").over(up), F.lit(0)).alias(w0))
    here = Window.partitionBy(part).orderBy(*order)
    sums = F.coalesce(F.sum(weight).over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = parts.withColumn("ordinal", F.row_number().over(here) - 1).withColumn("before", sums).join(ends, part)
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("ordinal") + F.col(n0)).cast("long").alias("ordinal"), (F.col("before") + F.col(w0)).cast("long").alias("before"))


def in_files(rows: DataFrame, by: list[str], per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """rows (with length) laid out in files of per_file records: file, place in the file (from 0) and offset in it.

    Columns of rows by these names, or named ordinal or before, are replaced. An empty table gives no rows.
    """
    spots = placed(rows.drop("file", "place", "offset"), by, "length").withColumn("file", F.expr(f"ordinal div {per_file}")).withColumn("place", F.col("ordinal") % per_file)
    spots = written(spots, "layout")
    first = fresh(spots, "_first")
    starts = spots.groupBy("file").agg(F.min("before").alias(first))
    return spots.join(starts, "file").withColumn("offset", F.col("before") - F.col(first)).drop("before", first, "ordinal")


def tree(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels of nodes (file, node, start, stop, digest), leaves first, up to one root a file. A leaf has record, too: its own digest.

    leaves: file, place, offset, length, digest; places of missing records are simply absent. A node gathers at most
    fanout children, so no group grows with the data.
    """
    level = leaves.select("file", F.col("place").alias("node"), F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("stop"), F.col("digest").alias("record"))
    level = level.withColumn("digest", F.sha2(F.concat_ws("|", F.col("start").cast("string"), F.col("stop").cast("string"), "record"), 256))
    levels = [written(level, "merkle")]
    last = levels[0].agg(F.max("node")).first()[0] or 0
    while last > 0:
        child = F.struct("node", "digest")
        up = levels[-1].groupBy("file", F.expr(f"node div {fanout}").alias("node"))
        up = up.agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.array_sort(F.collect_list(child)).alias("children"))
        line = F.array_join(F.transform("children", lambda c: F.concat(c["node"].cast("string"), F.lit(":"), c["digest"])), ";")
        text = F.concat_ws("|", F.col("start").cast("string"), F.col("stop").cast("string"), line)
        levels.append(written(up.select("file", "node", "start", "stop", F.sha2(text, 256).alias("digest")), "merkle"))
        last //= fanout
    return levels


def audit(primary: DataFrame, replica: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """file, place, digest, replica_digest, kind (damaged, moved, missing or extra) of each record in which replicas differ.

    A record is moved if its digest is the same and its offset or length is not.

    Both: file, place, offset, length, digest, of different (file, place); rows with a null in these are no records.
    Equal tables, empty ones too, give no rows.
    """
    whole = lambda d: d.dropna(subset=["file", "place", "offset", "length", "digest"])
    ours, theirs = tree(whole(primary), fanout), tree(whole(replica), fanout)
    while len(ours) < len(theirs):
        ours.append(_raised(ours[-1], fanout))
    while len(theirs) < len(ours):
        theirs.append(_raised(theirs[-1], fanout))
    bad = None
    for a, b in zip(reversed(ours), reversed(theirs)):
        if bad is not None:
            up = bad.select("file", F.col("node").alias("up"))
            a, b = (x.withColumn("up", F.expr(f"node div {fanout}")).join(up, ["file", "up"], "left_semi").drop("up") for x in (a, b))
        pair = a.select("file", "node", F.col("digest").alias("digest")).join(b.select("file", "node", F.col("digest").alias("replica_digest")), ["file", "node"], "full")
        bad = written(pair.where("not (digest <=> replica_digest)"), "mismatch")
    spots = bad.select("file", "node")
    a, b = (x[0].join(spots, ["file", "node"]).select("file", "node", F.col("record").alias(c)) for x, c in ((ours, "digest"), (theirs, "replica_digest")))
    bad = a.join(b, ["file", "node"], "full")
    kind = F.when(F.col("replica_digest").isNull(), "missing").when(F.col("digest").isNull(), "extra")
    kind = kind.when(F.col("digest") == F.col("replica_digest"), "moved").otherwise("damaged")
    return bad.select("file", F.col("node").alias("place"), "digest", "replica_digest", kind.alias("kind"))


def _raised(level: DataFrame, fanout: int) -> DataFrame:
    return level.withColumn("node", F.expr(f"node div {fanout}"))


OP7_SQL = r"""
with r as (select page_id, url, html, concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: resource', chr(13), chr(10), 'WARC-Record-ID: <urn:page:', page_id, '>', chr(13), chr(10), 'WARC-Target-URI: ', url, chr(13), chr(10),
'Content-Type: text/html', chr(13), chr(10), 'Content-Length: ') as head, concat(chr(13), chr(10), chr(13), chr(10)) as gap from pages),
t as (select page_id, concat(head, strlen(html), gap, html, gap) as rec, case when page_id % 389 = 7 then null when page_id % 97 = 13 then concat(head, strlen(html), gap, 'X', substring(html, 2), gap) else concat(head, strlen(html), gap, html, gap) end as rep from r),
o as (select page_id, strlen(rec) as length, sha256(rec) as digest, sha256(rep) as replica_digest, row_number() over (order by page_id) - 1 as ordinal from t),
f as (select *, ordinal // 4096 as file, ordinal % 4096 as place from o),
p as (select *, coalesce(sum(length) over (partition by file order by place rows between unbounded preceding and 1 preceding), 0) as "offset" from f)
select page_id, file, place, cast("offset" as bigint) as "offset", cast(length as bigint) as length, digest, replica_digest, case when replica_digest is null then 'missing' else 'damaged' end as kind
from p where digest is distinct from replica_digest
"""


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """Damaged and missing records of a replica of all pages.

    The tables have no replica: the query makes one, in which pages of id modulo 389 = 7 are missing and those of id
    modulo 97 = 13 have another first character. It is laid out by its own records' lengths; a missing one leaves its room.
    """
    pages = table(spark, sf_dir, "pages")
    body = F.when(F.col("page_id") % 97 == 13, F.concat(F.lit("X"), F.expr("substring(html, 2)"))).otherwise(F.col("html"))
    gone = F.col("page_id") % 389 == 7
    rec, rep = record(F.col("page_id"), F.col("url"), F.col("html")), record(F.col("page_id"), F.col("url"), body)
    rows = pages.select("page_id", F.xxhash64("url", "html").alias("tie"), F.octet_length(rec).cast("long").alias("length"), F.sha2(rec, 256).alias("digest"))
    gone = F.coalesce(gone, F.lit(False))
    copies = pages.select("page_id", F.xxhash64("url", "html").alias("tie"), F.octet_length(F.when(gone, rec).otherwise(rep)).cast("long").alias("length"), F.when(~gone, F.sha2(rep, 256)).alias("digest"))
    layout = written(in_files(rows, ["page_id", "tie"]), "records")
    found = audit(layout, in_files(copies, ["page_id", "tie"]))
    return found.join(layout.select("page_id", "file", "place", "offset", "length"), ["file", "place"]).select("page_id", "file", "place", "offset", "length", "digest", "replica_digest", "kind")
