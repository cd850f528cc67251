"""URL filters as a temporal join: dated list entries become validity intervals, and captures meet those active at fetch time.

A list is a table of dated events: at a time, a pattern of a list is added or removed. A pattern is a host, which also
covers the hosts below it, or a host and a path, which covers paths that start with its segments. Events of one pattern
become intervals from an addition to the next removal. A capture is turned into the patterns that could cover it, of the
depths that the list has, and each is looked up by equality, with the time in the interval; the intervals of a pattern
with a long history are posted by dyadic blocks of time, so that a capture does not meet all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causalframe.llm.scratch import fresh, small, table, written
from causalframe.llm.shingles import let

FOREVER = "9999-12-01"
#: Dyadic levels over seconds: more than a time until FOREVER has bits.
LEVELS = 40


def host_of(url: Column) -> Column:
    """The lower-cased host of a URL without user, port or a final dot; empty if there is none."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(rest, r"^.*@", ""), r"\.?(:[0-9]*)?$", ""))


def path_of(url: Column) -> Column:
    """The path of a URL without query or fragment; empty if there is none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def shape(pattern: Column) -> Column:
    """labels and segments: how many a pattern, as intervals() gives it, has of both."""
    host = F.substring_index(pattern, "/", 1)
    return F.struct(F.size(F.split(host, r"\.")).alias("labels"), (F.size(F.split(pattern, "/")) - 1).alias("segments"))


def patterns(url: Column, shapes: Column) -> Column:
    """The patterns of shapes (an array of shape()) that cover a URL: its host or one above it, with a leading part of the path."""
    labels = F.split(host_of(url), r"\.")
    segments = F.filter(F.split(path_of(url), "/"), lambda s: s != "")

    def body(x: Column) -> Column:
        fits = F.filter(shapes, lambda d: (d["labels"] <= F.size(x["labels"])) & (d["segments"] <= F.size(x["segments"])))
        host = lambda d: F.array_join(F.slice(x["labels"], F.size(x["labels"]) - d["labels"] + 1, d["labels"]), ".")
        path = lambda d: F.concat(F.lit("/"), F.array_join(F.slice(x["segments"], 1, d["segments"]), "/"))
        return F.transform(fits, lambda d: F.when(d["segments"] == 0, host(d)).otherwise(F.concat(host(d), path(d))))

    each = let(F.struct(labels.alias("labels"), segments.alias("segments")), body)
    return F.when(host_of(url) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(each))


def intervals(events: DataFrame) -> DataFrame:
    """list, pattern, valid_from, valid_to: the half-open times in which an entry is active.

    events: list, pattern, at, action ('add' or 'remove'). Of events of one entry at one time a removal wins; an
    addition while active and a removal while inactive change nothing; an addition without a later removal is active
    for ever. Events with a null in any of these columns are left out.
    """
    clean = events.where("list is not null and pattern is not null and at is not null and action in ('add', 'remove')")
    host, path = F.substring_index("pattern", "/", 1), F.expr("substring(pattern, length(substring_index(pattern, '/', 1)) + 1)")
    pattern = F.concat(F.lower(host), F.regexp_replace(path, "/+$", ""))
    clean = clean.select("list", pattern.alias("pattern"), "at", (F.col("action") == "add").alias("on"))
    times = clean.groupBy("list", "pattern", "at").agg(F.bool_and("on").alias("on"))
    order = Window.partitionBy("list", "pattern").orderBy("at")
    turns = times.withColumn("was", F.coalesce(F.lag("on").over(order), F.lit(False))).where("on != was")
    spans = turns.select("list", "pattern", F.col("at").alias("valid_from"), F.coalesce(F.lead("at").over(order), F.lit(FOREVER).cast("timestamp")).alias("valid_to"), "on")
    return spans.where("on").drop("on")


def _blocks(start: Column, stop: Column) -> Column:
    """The dyadic blocks (level, place) that make up the whole numbers from start to before stop: at most two a level."""
    found = []
    for level in range(LEVELS):
        lo, hi = F.shiftright(start + F.lit((1 << level) - 1), level), F.shiftright(stop, level)
        for odd, place in ((lo, lo), (hi, hi - 1)):
            block = F.struct(F.lit(level).alias("level"), place.alias("place"))
            found.append(F.when((lo < hi) & (odd.bitwiseAND(F.lit(1)) == 1), block))
    return F.filter(F.array(*found), lambda b: b.isNotNull())


def active(captures: DataFrame, events: DataFrame, key: str = "page_id", crowd: int = 64) -> DataFrame:
    """One row for each capture and list with an entry active at fetch time: its key, url, fetched_at, list, pattern and valid_from.

    captures: key, url, fetched_at; a capture is these three, so that each time and URL of a key has entries of its own.
    Of several active patterns of a list the longest is named. Captures with a null url or time, or a URL with no host,
    meet nothing. Repeated rows are looked up as one.

    Patterns of captures that no list has are dropped first. A pattern of at most crowd intervals is joined with them; the
    intervals of one with more are posted by the dyadic blocks of seconds that make them up, and a capture looks up the
    block of every level that its time is in, so that it meets an interval or two of a list there.
    """
    spans = written(intervals(events), "spans")
    shapes = spans.select(shape(F.col("pattern")).alias("d")).agg(F.collect_set("d").alias("shapes"))  # a row for each depth
    known = written(spans.groupBy("pattern").agg(F.count("*").alias("n")), "patterns")
    whole = [key, "url", "fetched_at"]
    looked = captures.where("url is not null and fetched_at is not null").select(*whole).crossJoin(F.broadcast(shapes))
    looked = looked.select(*whole, F.explode(patterns(F.col("url"), F.col("shapes"))).alias("pattern")).join(small(known), "pattern")
    inside = (F.col("fetched_at") >= F.col("valid_from")) & (F.col("fetched_at") < F.col("valid_to"))
    columns = [*whole, "list", "pattern", "valid_from"]
    met = looked.where(F.col("n") <= crowd).join(spans, "pattern").where(inside).select(*columns)
    crowded = known.where(F.col("n") > crowd).select("pattern")
    if not crowded.isEmpty():
        stop = F.unix_seconds("valid_to") + 1  # a second in which an interval ends is one of its own
        posted = spans.join(small(crowded), "pattern", "left_semi").withColumn("block", F.explode(_blocks(F.unix_seconds("valid_from"), stop)))
        second = F.unix_seconds("fetched_at")
        levels = F.array(*[F.struct(F.lit(n).alias("level"), F.shiftright(second, n).alias("place")) for n in range(LEVELS)])
        hot = looked.where(F.col("n") > crowd).select(*whole, "pattern", F.explode(levels).alias("block"))
        met = met.unionByName(hot.join(posted, ["pattern", "block"]).where(inside).select(*columns))
    best = F.max(F.struct(F.length("pattern").alias("n"), "pattern", "valid_from")).alias("best")
    return met.groupBy(*whole, "list").agg(best).select(*whole, "list", "best.pattern", "best.valid_from")


def judged(captures: DataFrame, events: DataFrame, key: str = "page_id") -> DataFrame:
    """captures with blocked, allowed, lists (the sorted names of lists that meet it) and pattern (the longest that does).

    Of an entry of a list named 'allow' and others, the longer pattern decides, and at one length 'allow' does. Every
    row of captures is returned with the verdict of its own key (null or not), url and time, whatever its nulls;
    captures without an active entry are neither blocked nor allowed. Columns of captures by these names are replaced.
    """
    captures = captures.drop("blocked", "allowed", "lists", "pattern", "best")
    met = active(captures, events, key)
    best = F.max(F.struct(F.length("pattern").alias("n"), (F.col("list") == "allow").alias("ok"), "pattern")).alias("best")
    by = met.groupBy(key, "url", "fetched_at").agg(F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), best)
    names = [fresh(captures, f"_of_{i}") for i in range(3)]
    by = by.select(*[F.col(c).alias(n) for c, n in zip((key, "url", "fetched_at"), names)], "lists", "best")
    same = captures[key].eqNullSafe(F.col(names[0])) & (captures["url"] == F.col(names[1])) & (captures["fetched_at"] == F.col(names[2]))
    rows = captures.join(by, same, "left").drop(*names)
    ok = F.coalesce(F.col("best.ok"), F.lit(False))
    return rows.withColumn("blocked", F.col("best").isNotNull() & ~ok).withColumn("allowed", ok).withColumn("pattern", F.col("best.pattern")).withColumn("lists", F.coalesce("lists", F.lit(""))).drop("best")


#: The tables have no lists and no fetch times: the query makes both from the pages by this rule, which its SQL repeats.
LIST_SQL = """
with h as (select distinct lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) as host from pages where url is not null),
k as (select host, cast(conv(substr(md5(host), 1, 6), 16, 10) as bigint) as x from h where host != '')
select 'adult' as list, host as pattern, timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(x % 300 as int)) as at, 'add' as action from k where x % 3 = 0
union all select 'adult', host, timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(x % 300 + 90 as int)), 'remove' from k where x % 3 = 0 and x % 2 = 0
union all select 'spam', concat(host, '/en'), timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(x % 200 as int)), 'add' from k where x % 4 = 1
union all select 'allow', concat(host, '/en'), timestamp '2024-03-01 00:00:00', 'add' from k where x % 6 = 0
union all select 'spam', substring(host, instr(host, '.') + 1), timestamp '2024-06-01 00:00:00', 'add' from k where x % 11 = 5
union all select 'spam', substring(host, instr(host, '.') + 1), timestamp '2024-09-01 00:00:00', 'remove' from k where x % 11 = 5
"""

OP6_SQL = r"""
with h as (select distinct lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) as host from pages where url is not null),
k as (select host, cast(concat('0x', substr(md5(host), 1, 6)) as bigint) as x from h where host != ''),
e as (select distinct list, lower(pattern) as pattern, since, action from (
select 'adult' as list, host as pattern, timestamp '2024-01-01 00:00:00' + to_days(cast(x % 300 as int)) as since, 'add' as action from k where x % 3 = 0
union all select 'adult', host, timestamp '2024-01-01 00:00:00' + to_days(cast(x % 300 + 90 as int)), 'remove' from k where x % 3 = 0 and x % 2 = 0
union all select 'spam', concat(host, '/en'), timestamp '2024-01-01 00:00:00' + to_days(cast(x % 200 as int)), 'add' from k where x % 4 = 1
union all select 'allow', concat(host, '/en'), timestamp '2024-03-01 00:00:00', 'add' from k where x % 6 = 0
union all select 'spam', substring(host, instr(host, '.') + 1), timestamp '2024-06-01 00:00:00', 'add' from k where x % 11 = 5
union all select 'spam', substring(host, instr(host, '.') + 1), timestamp '2024-09-01 00:00:00', 'remove' from k where x % 11 = 5)),
c as (select page_id, url, timestamp '2024-01-01 00:00:00' + to_days(cast(page_id % 366 as int)) as fetched_at, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) as host,
regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as path from pages),
m as (select c.page_id, e.list, e.pattern, arg_max(e.action, (e.since, e.action)) as last from c join e on e.since <= c.fetched_at and c.host != ''
and (c.host = split_part(e.pattern, '/', 1) or ends_with(c.host, concat('.', split_part(e.pattern, '/', 1))))
and (not contains(e.pattern, '/') or starts_with(concat(c.path, '/'), concat(substring(e.pattern, instr(e.pattern, '/')), '/')))
group by c.page_id, e.list, e.pattern),
a as (select page_id, string_agg(distinct list, ',' order by list) as lists, max((length(pattern), list = 'allow', pattern)) as best from m where last = 'add' group by page_id)
select c.page_id, c.host, c.fetched_at, coalesce(not best[2], false) as blocked, coalesce(best[2], false) as allowed, best[3] as pattern, coalesce(lists, '') as lists from c left join a using (page_id)
"""


def op6_urlfilter(spark, sf_dir: str) -> DataFrame:
    """Every page's URL against the list entries that were active when it was fetched."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    events = spark.sql(LIST_SQL.replace("from pages", "from {pages}"), pages=pages)
    fetched = (F.lit("2024-01-01").cast("timestamp") + F.make_interval(days=(F.col("page_id") % 366).cast("int"))).alias("fetched_at")
    found = judged(pages.select("page_id", "url", fetched), events)
    return found.select("page_id", host_of(F.col("url")).alias("host"), "fetched_at", "blocked", "allowed", "pattern", "lists")
