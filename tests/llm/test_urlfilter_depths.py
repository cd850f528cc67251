from pyspark.sql import functions as F

from causalframe.llm.urlfilter import intervals, judged

EVENT, PAGE = "list string, pattern string, at string, action string", "page_id long, url string, t string"


def _judged(spark, events, pages):
    events = spark.createDataFrame(events, EVENT).withColumn("at", F.col("at").cast("timestamp"))
    pages = spark.createDataFrame(pages, PAGE).withColumn("fetched_at", F.col("t").cast("timestamp"))
    return events, judged(pages, events).collect()


def test_deep_entries(spark):
    host, path = ".".join("abcdefghijklmnop"), "/1/2/3/4/5/6/7/8"
    events, rows = _judged(
        spark,
        [("spam", host, "2024-01-01", "add"), ("spam", "deep.com" + path, "2024-01-01", "add"), ("allow", "deep.com/1/2/3/4/5/6/7/8/9", "2024-01-01", "add"), ("spam", "q.z" + "/x" * 40, "2024-01-01", "add")],
        [(1, f"http://www.{host}/x", "2024-02-01"), (2, f"http://deep.com{path}/y", "2024-02-01"), (3, f"http://deep.com{path}/9/y", "2024-02-01"), (4, "http://deep.com/1/2/3/4/5/6/7", "2024-02-01"), (5, "http://a.q.z" + "/x" * 41, "2024-02-01"), (6, "http://b.c/", "2024-02-01")],
    )
    assert intervals(events).count() == 4
    assert {r["page_id"] for r in rows if r["blocked"]} == {1, 2, 5} and {r["page_id"] for r in rows if r["allowed"]} == {3}


def test_captures_of_one_key(spark):
    events = [("spam", "bad.com", "2024-01-10", "add"), ("spam", "bad.com", "2024-02-10", "remove"), ("adult", "other.com", "2024-01-01", "add")]
    pages = [(1, "http://bad.com/", "2024-01-15"), (1, "http://bad.com/", "2024-03-01"), (1, "http://other.com/", "2024-01-15"), (1, "http://fine.com/", "2024-01-15"), (None, "http://bad.com/", "2024-01-20"), (None, "http://fine.com/", "2024-01-20"), (None, None, "2024-01-20"), (2, "http://bad.com/", None), (1, "http://bad.com/", "2024-01-15")]
    _, rows = _judged(spark, events, pages)
    got = sorted((str(r["page_id"]), str(r["url"]), str(r["t"]), r["lists"]) for r in rows)
    lists = ["spam", "", "adult", "", "spam", "", "", "", "spam"]
    assert got == sorted((str(i), str(u), str(t), found) for (i, u, t), found in zip(pages, lists))
