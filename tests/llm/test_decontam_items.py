from pyspark.sql import functions as F

from causalframe.llm.decontam import contained, decontaminated

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def _text(mark, n=20):
    return " ".join(f"{mark}{i}" for i in range(n))


def test_each_row_is_an_item(spark):
    items = spark.createDataFrame([(1, _text("q")), (1, _text("a")), (None, _text("n")), (None, _text("m")), (2, "red green"), (3, "one two three four"), (3, _text("q").upper()), (1, _text("q", 20) + "!")], "item_id long, text string")
    texts = [_text("q"), "x y " + _text("a") + " z", _text("n"), _text("m"), "a red, green b", "red b green", "zero one two three four five", _text("q") + " " + _text("a"), "one two three", "Red green", _text("zz")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOC)
    rows = contained(docs, items).collect()
    got = sorted((r["doc_id"], str(r["item_id"]), r["n_shared"], r["n_item"]) for r in rows)
    want = [(0, "1", 16, 16), (0, "3", 16, 16), (1, "1", 16, 16), (2, "None", 16, 16), (3, "None", 16, 16), (4, "2", 1, 1), (6, "3", 1, 1), (7, "1", 16, 16), (7, "1", 16, 16), (7, "3", 16, 16), (9, "2", 1, 1)]
    assert got == want
    assert {r["doc_id"] for r in decontaminated(docs, items).collect()} == {5, 8, 10}
    assert contained(docs, items.withColumn("text", F.lit(None).cast("string"))).count() == 0
