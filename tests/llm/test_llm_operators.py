import hashlib
import random
import zlib

import numpy as np
import pytest
from compare import oracle, spark_rows
from pyspark.sql import functions as F

from causalframe.llm import queries
from causalframe.llm.components import connected_components
from causalframe.llm.eliasfano import EliasFano, encode
from conftest import MID, SMALL

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOC)


ODD = [(1, None, "a"), (2, "", "a"), (3, "  \n ", None), (4, "one", "b"), (5, "one two three four five six", "b"), (5, "one two three four five six", "b"), (None, "no id here at all, none", None), (7, "x " * 30_000, "a"), (8, "ONE two", "b")]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, MID)) == oracle(queries.ORACLE_SQL[name], MID)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(90)] + [(500, 500), (7, 7)]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def _groups(fps, bits=4):
    ids, up = list(fps), {i: i for i in fps}
    find = lambda x: x if up[x] == x else find(up[x])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if bin(fps[a] ^ fps[b]).count("1") <= bits:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_fixture(spark):
    from causalframe.llm.simhash import first_of_groups, near_groups, simhash

    assert simhash(None) == simhash(b" \n") == 0
    assert simhash(b"A b") == simhash(b"a\tB ") != simhash(b"a b c")
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghij") * 3 + str(rng.randrange(50)) for _ in range(120)) for _ in range(8)]
    rows = [(i, base[i % 8] if i < 16 else base[i % 8].replace(str(i % 9), "q", 1), "s") for i in range(60)]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in near_groups(docs(spark, rows), crowded=8).collect()}
    fps = {i: simhash(t.encode()) for i, t, _ in rows}
    want = _groups(fps)
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}
    kept = first_of_groups(docs(spark, rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values())) and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_simhash_crowded_postings_lose_nothing(spark):
    from causalframe.llm.simhash import near_links

    rng = random.Random(9)
    fps = {(1 << 40) ^ sum(1 << b for b in rng.sample(range(30), rng.randrange(4))) for _ in range(300)} | {rng.getrandbits(63) for _ in range(100)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = _groups({f: f for f in fps})
    for crowded, blocks in ((8192, None), (16, 1), (16, 2), (8192, 3)):
        labels = {r["node"]: r["label"] for r in connected_components(near_links(df, 4, crowded, blocks)).collect()}
        assert {f: labels.get(f, f) for f in fps} == want


def test_simhash_odd_rows(spark):
    from causalframe.llm.simhash import first_of_groups, near_groups

    rows = docs(spark, ODD).withColumn("fp", F.lit("clash"))
    got = near_groups(rows)
    assert got.count() == len(ODD) and {r["component_id"] for r in got.where("fingerprint = '0000000000000000'").collect()} == {1}
    kept = first_of_groups(rows)
    assert kept.columns == rows.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 4, 5, 7, 8]
    assert near_groups(rows.where("false")).count() == 0


def test_html():
    from causalframe.llm.html import main_text

    page = """<html><head><title>t</title></head><body class="has-sidebar"><header><h1>Site</h1></header><div class="cookie-notice"><p>We use cookies, yes, all of them, every day.</p></div>
    <nav><a href="/">Home</a></nav><div class="post"><h2>Title</h2><p>First paragraph, with&nbsp;text, that goes on, and on, for long &amp; longer.<p>Second <b>one</b>
    with a <a href=x>link</a>.<ul><li>x<li>y</ul></div><aside><p>Side text, side text, side text, side.</p></aside><section id="comments"><p>A comment, I like it, very much, indeed.</p></section>
    <form><p>Enter, your, mail, here, please, now</p></form><footer>c</footer><script>var a="<p>x</p>"</script></body></html>"""
    assert main_text(page) == "Title\n\nFirst paragraph, with text, that goes on, and on, for long & longer.\n\nSecond one with a link.\n\nx\n\ny"
    assert main_text(None) == main_text("") == main_text("<script>x") == "" and main_text("plain &lt;b") == "plain <b"
    main_text('<a b="' * 20_000), main_text("<div>x" * 20_000), main_text("<p>" * 50_000)


def test_html_query(spark):
    import re
    from html import unescape

    rows = queries.QUERIES["op2_html"](spark, SMALL).join(spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "html"), "page_id").collect()
    for r in rows:
        parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", r["html"], re.S)[1])
        want = [" ".join(unescape(re.sub("<[^>]*>", "", p.replace("<br>", " "))).split()) for p in parts]
        assert r["text"] == "\n\n".join(w for w in want if w) and r["n_chars"] == len(r["text"])
    odd = spark.createDataFrame([(1, None, None), (None, "u", "<p>a, b</p>"), (1, None, None)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    from causalframe.llm.html import extract

    assert sorted(r["text"] for r in extract(odd).collect()) == ["", "", "a, b"] and extract(odd.where("false")).count() == 0


def test_decontamination_odd_rows(spark):
    from causalframe.llm.decontam import contained, decontaminated

    item = " ".join(f"w{i}" for i in range(20))
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "tiny"), (5, item + " more"), (1, item)], "item_id long, text string").withColumn("own", F.lit(0))
    long_text = " ".join(f"x{i}" for i in range(30_000)) + " " + item.upper().replace(" ", ", ") + " " + " ".join(f"y{i}" for i in range(30_000))
    rows = docs(spark, [*ODD, (20, long_text, "s"), (21, item.replace("w3 ", ""), "s"), (22, item.replace("w10 ", "").replace("w4 ", ""), "s"), (23, "Tiny!", "s"), (None, item, "s")]).withColumn("h", F.lit(0)).withColumn("row_key", F.lit(0))
    got = {(r["doc_id"], r["item_id"]): r["n_shared"] for r in contained(rows, items).collect()}
    assert got == {(20, 1): 16, (20, 5): 16, (23, 4): 1, (None, 1): 16, (None, 5): 16}
    clean = decontaminated(rows, items)
    assert clean.columns == rows.columns and clean.count() == len(ODD) + 2
    assert contained(rows.where("false"), items).count() == 0 and contained(rows, items.where("false")).count() == 0


def _targets(sizes, share=1.5, most=2.0, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    goal, left, open_ = {}, share * sum(sizes.values()), set(order)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] >= most * sizes[s]}
        if not full:
            return goal | {s: level * w[s] for s in open_}
        for s in full:
            goal[s] = most * sizes[s]
            left -= goal[s]
        open_ -= full
    return goal


def test_mixing(spark):
    from causalframe.llm.mixing import mix, mixed

    table = spark.read.parquet(f"{MID}/documents.parquet")
    rows = mix(table).toPandas()
    again = mix(table.repartition(5)).toPandas()
    assert rows.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))
    by = rows.merge(table.select("doc_id", "source").toPandas(), on="doc_id").groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    want = _targets(by["size"].to_dict())
    assert all(abs(by["target"][s] - t) < 1e-6 for s, t in want.items()) and (abs(by["taken"] - by["target"]) <= 1).all() and (rows["taken"] <= 2 * rows["size"]).all()
    odd = docs(spark, ODD)
    for clash in ("size", "c", "m", "z", "mark", "nth", "one", "copies", "target"):
        odd = odd.withColumn(clash, F.lit("clash"))
    assert mix(odd).count() == len(ODD) and mixed(odd).columns == odd.columns and mix(odd.where("false")).count() == 0
    whole = mixed(table).groupBy("source").agg(F.count("*").alias("n")).count()
    assert whole == by.shape[0]


def test_knapsack():
    from causalframe.llm.mixing import fit_budget

    rng = random.Random(2)
    for _ in range(60):
        lengths = np.array(sorted(rng.sample(range(1, 60), 6)))
        counts = np.array([rng.randrange(4) for _ in lengths])
        budget = rng.randrange(0, 200)
        sums = {0}
        for v, c in zip(lengths, counts):
            sums = {s + int(v) * k for s in sums for k in range(c + 1)}
        take = fit_budget(lengths, counts, budget, reach=1 << 16)
        assert (take <= counts).all() and (take >= 0).all()
        best = max(s for s in sums if s <= budget)
        assert int((take * lengths).sum()) <= budget and best - int((take * lengths).sum()) <= max(lengths)
        from causalframe.llm.mixing import _knapsack

        assert int((_knapsack(lengths, counts, budget) * lengths).sum()) == best


def _shingles(text):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").lower()) if x]
    return set(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else ({tuple(w)} if w else set())


def test_fingerprints(spark):
    from causalframe.llm.fingerprint import containment, merged, resemblance, sketch, with_edits

    table = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").toPandas().sort_values("doc_id", ascending=False).reset_index(drop=True)
    got = queries.QUERIES["op5_fingerprints"](spark, SMALL).toPandas().set_index("doc_id")
    like = lambda a, b: 1.0 if a == b else len(a & b) / len(a | b)
    off = []
    for k, (i, t) in enumerate(table.itertuples(index=False)):
        n = len(t)
        edited = t[: n - n // 3] + table["text"][(k + 1) % len(table)][: n // 3]
        assert got["edited_sha256"][i] == hashlib.sha256(edited.encode()).hexdigest() and got["n_chars"][i] == n
        off.append(abs(like(_shingles(t), _shingles(edited)) - got["near_edited"][i]))
    assert np.mean(off) < 0.04 and max(off) < 0.2
    odd = with_edits(docs(spark, ODD).withColumn("tie", F.lit(0)))
    assert odd.count() == len(ODD) and with_edits(docs(spark, [])).count() == 0
    a, b = " ".join(f"a{i}" for i in range(900)), " ".join(f"a{i}" for i in range(450, 900))
    df = spark.createDataFrame([(a, b)], "a string, b string").select(sketch(F.col("a")).alias("x"), sketch(F.col("b")).alias("y"), sketch(F.concat_ws(" ", "a", "b")).alias("ab"))
    r = df.select(resemblance(F.col("x"), F.col("y")).alias("r"), containment(F.col("y"), F.col("x")).alias("c"), F.size(F.array_intersect(merged(F.col("x"), F.col("y")), F.col("ab"))).alias("m")).first()
    assert abs(r["r"] - 0.5) < 0.15 and r["c"] > 0.8 and r["m"] > 120


def test_urlfilter(spark):
    from causalframe.llm.urlfilter import intervals, judged

    ts = "list string, pattern string, at string, action string"
    events = spark.createDataFrame([("adult", "Bad.com", "2024-01-10", "add"), ("adult", "bad.com", "2024-02-10", "remove"), ("adult", "bad.com", "2024-01-20", "add"), ("spam", "ok.com/x", "2024-01-01", "add"), ("allow", "good.bad.com", "2024-01-01", "add"), ("spam", None, "2024-01-01", "add"), ("spam", "one.com", "2024-01-01", "add"), ("spam", "one.com", "2024-01-01", "remove")], ts).withColumn("at", F.col("at").cast("timestamp"))
    assert intervals(events).count() == 3
    urls = [(1, "http://www.bad.com/a", "2024-01-15"), (2, "http://bad.com:80/", "2024-02-10"), (3, "https://u@BAD.com./", "2024-02-09"), (4, "http://ok.com/x/y?z", "2150-01-01"), (5, "http://ok.com/xy", "2024-05-01"), (6, "http://good.bad.com/", "2024-01-15"), (7, None, "2024-01-15"), (8, "junk", "2024-01-15"), (9, "http://bad.com/", None), (10, "http://notbad.com/", "2024-01-15"), (1, "http://www.bad.com/a", "2024-01-15")]
    captures = spark.createDataFrame(urls, "page_id long, url string, t string").select("page_id", "url", F.col("t").cast("timestamp").alias("fetched_at"))
    rows = judged(captures, events).collect()
    assert len(rows) == len(urls) and {r["page_id"] for r in rows if r["blocked"]} == {1, 3, 4} and {r["page_id"] for r in rows if r["allowed"]} == {6}
    assert judged(captures.where("false"), events).count() == 0 and judged(captures, events.where("false")).where("blocked").count() == 0


def test_warc(spark):
    from causalframe.llm.warc import audit, in_files

    rows = spark.range(700).select(F.col("id").alias("k"), (F.col("id") % 5 + 1).alias("length"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    layout = in_files(rows, ["k"], 300)
    got = layout.orderBy("k").collect()
    assert [(r["file"], r["place"]) for r in got] == [(i // 300, i % 300) for i in range(700)]
    assert [r["offset"] for r in got[:4]] == [0, 1, 3, 6] and got[300]["offset"] == 0
    bad = layout.where("k not in (5, 450)").withColumn("digest", F.when(F.col("k").isin(17, 699), "x").otherwise(F.col("digest")))
    assert {(r["file"], r["place"], r["kind"]) for r in audit(layout, bad, 4).collect()} == {(0, 5, "missing"), (1, 150, "missing"), (0, 17, "damaged"), (2, 99, "damaged")}
    assert {(r["file"], r["place"], r["kind"]) for r in audit(bad.where("k < 3"), layout.where("k < 40"), 4).collect()} == {(0, i, "extra") for i in range(3, 40)}
    assert audit(layout, layout).count() == 0 and audit(layout.where("false"), layout.where("false")).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (5, 2), (1000, 10), (1000, 10**6), (3000, 2**50)):
        values = np.sort(rng.integers(0, top, n).astype(np.uint64))
        code = EliasFano(encode(values))
        assert code.all().tolist() == values.tolist() and [code[i] for i in range(0, n, 17)] == values[::17].tolist()
    size = len(encode(np.arange(0, 600_000_000, 600, dtype=np.uint64)))
    assert size * 8 / 1_000_000 < 2 + np.log2(600) + 0.3
    with pytest.raises(IndexError):
        EliasFano(encode(np.array([1], np.uint64)))[1]


def test_tokens(spark):
    from tokenizers import Tokenizer

    from causalframe.llm.tokens import TokenFile, read_tokens, tokenizer_path, write_tokens

    plain = Tokenizer.from_file(tokenizer_path())
    plain.encode_special_tokens = True
    want = lambda t: [*plain.encode(t or "", add_special_tokens=False).ids, 0]
    rows = [*ODD, (9, "a  b \n c  'tis  1 2", "s"), (-4, " lead", "s"), (10, "trail ", "s"), (11, "<|endoftext|> é x", "s"), (12, "a" * 70_000, "s")]
    folder, manifest = write_tokens(docs(spark, rows).withColumn("start", F.lit(0)), tokenizer_path(), file_bytes=2000)
    got = sorted(read_tokens(folder, manifest).collect(), key=lambda r: r["start"])
    keys = [r["doc_id"] for r in got]
    assert keys[0] is None and keys[1:] == sorted(keys[1:]) and len(keys) == len(rows)
    texts, at = {i: t for i, t, _ in rows}, 0
    for r in got:
        ids = want(texts[r["doc_id"]])
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    first = manifest.orderBy("file").first()["file"]
    file = TokenFile(folder, first)
    assert file[0].tolist() == want(texts[file.key(0)]) and manifest.count() > 1
    folder, manifest = write_tokens(docs(spark, []), tokenizer_path())
    assert read_tokens(folder, manifest).count() == 0
    other = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    folder, manifest = write_tokens(docs(spark, [(1, "Hello  World", "s")]), tokenizer_path("word_bpe_49k.json"))
    assert read_tokens(folder, manifest).first()["n_tokens"] == len(other.encode("Hello  World", add_special_tokens=False).ids) + 1


def test_segments():
    from causalframe.llm.toxicity import segments

    rng = random.Random(4)
    for _ in range(200):
        n = rng.randrange(1, 25)
        scores = {i: rng.randrange(1, 9) for i in range(n) if rng.random() < 0.4}
        line = [scores.get(i, -3) for i in range(n)]

        def best(lo, hi):
            spans = [(sum(line[a:b]), -(b - a), -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)]
            if not spans or max(spans)[0] <= 0:
                return []
            s, _, _, a, b = max(spans)
            return [*best(lo, a), (a, b, s), *best(b, hi)]

        found = segments(sorted(scores.items()), n)
        assert sum(s for *_, s in found) == sum(s for *_, s in best(0, n))
        assert all(sum(line[a:b]) == s for a, b, s in found)


@pytest.mark.parametrize("name,mark,held,least", [("op8_quality", "quality", 0.0, 0.93), ("op10_toxicity", "toxic", 0.0, 0.93)])
def test_classifiers(spark, name, mark, held, least):
    big = "/root/testdata/sf0.1"
    rows = queries.QUERIES[name](spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert len(rows) > 300 and (rows["predicted"] == rows[mark]).mean() > least and rows["score"].between(0, 1).all()


def test_classifiers_odd_rows(spark):
    from causalframe.llm import quality, toxicity

    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (7, 1, 0), (None, 1, 1), (8, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    rows = docs(spark, ODD).withColumn("score", F.lit("clash"))
    for module in (quality, toxicity):
        for some in (labels, labels.where("false")):
            model = module.fit(rows, some)
            got = module.scores(rows, model).collect()
            assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
        assert module.scores(rows.where("false"), model).count() == 0
    kept = toxicity.without_toxic(rows, labels.where("false"))
    assert kept.columns == rows.columns and kept.count() == len(ODD)


def test_pipeline(spark):
    import corpus_pipeline

    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, SMALL)
        assert out.columns == table.columns and 0 < out.count(), name
        if name != "mixing":
            assert out.count() <= table.count()
    got = corpus_pipeline.run(spark, SMALL)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 0
