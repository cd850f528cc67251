import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from causalframe.llm.urlfilter import _blocks, active

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def test_blocks(spark):
    rng = random.Random(4)
    spans = [(0, 0), (5, 6), (0, 1 << 20), (3, 17), (-9, 12)] + [(a, a + rng.randrange(400)) for a in (rng.randrange(-300, 5000) for _ in range(60))]
    rows = spark.createDataFrame(spans, "a long, b long").select("a", "b", _blocks(F.col("a"), F.col("b")).alias("x")).collect()
    for r in rows:
        covered = [v for level, place in r["x"] for v in range(place << level, (place + 1) << level)]
        assert sorted(covered) == list(range(r["a"], r["b"])) and len(r["x"]) <= 2 * 21


def test_long_history(spark):
    """Entries of many intervals, some shorter than a second, against a scan of all events."""
    rng = random.Random(8)
    events, at = [], {}
    for name, pattern, n in (("spam", "a.com", 300), ("adult", "a.com", 90), ("spam", "b.a.com/x", 40), ("spam", "c.com", 1)):
        t = START
        for i in range(n):
            t += timedelta(seconds=rng.choice([0.25, 1, 60, 86_400, 9_000_000]))
            events.append((name, pattern, t, "add" if i % 2 == 0 else "remove"))
            at.setdefault((name, pattern), []).append((t, i % 2 == 0))
    times = [e[2] + timedelta(seconds=s) for e in events for s in (-0.1, 0, 0.1)] + [START, START + timedelta(days=200_000)]
    urls = ["http://a.com/", "http://b.a.com/x/y", "http://c.com/", "http://d.com/"]
    pages = [(i, urls[i % 4], t) for i, t in enumerate(times)]
    pages.append(pages[0])

    def covers(url, pattern):
        host, _, path = url.removeprefix("http://").partition("/")
        top, _, below = pattern.partition("/")
        return (host == top or host.endswith("." + top)) and (not below or (path + "/").startswith(below + "/"))

    want = set()
    for i, url, t in pages:
        for name in ("spam", "adult"):
            on = [p for (n, p), turns in at.items() if n == name and covers(url, p) and [o for w, o in turns if w <= t][-1:] == [True]]
            if on:
                want.add((i, name, max(on, key=lambda p: (len(p), p))))
    events = spark.createDataFrame(events, "list string, pattern string, at timestamp, action string")
    captures = spark.createDataFrame(pages, "page_id long, url string, fetched_at timestamp")
    for crowd in (64, 0, 10_000):
        got = [(r["page_id"], r["list"], r["pattern"]) for r in active(captures, events, crowd=crowd).collect()]
        assert len(got) == len(set(got)) and set(got) == want
