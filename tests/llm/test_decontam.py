"""Edit matching of test items against the plain distance table."""

import random

from pyspark.sql import functions as F

from crosstide.llm import decontam


def nearest(item, text):
    last = list(range(len(item) + 1))
    best = last[-1]
    for c in text:
        now = [0]
        for i, a in enumerate(item, 1):
            now.append(min(last[i] + 1, now[-1] + 1, last[i - 1] + (a != c)))
        last = now
        best = min(best, now[-1])
    return best


def fixture():
    draw = random.Random(6)

    def prose(n):
        return " ".join("".join(draw.choice("aeioundtsrl") for _ in range(draw.randint(1, 7))) for _ in range(n))

    items = [(i, prose(draw.randint(3, 30)).capitalize()) for i in range(12)] + [(90, None), (91, "  "), (92, "Zq")]
    docs = []
    for n in range(90):
        _, text = items[n % 12]
        edited = list(text)
        for _ in range(draw.randint(0, len(text) // 8)):
            at = draw.randrange(len(edited))
            edited[at : at + 1] = draw.choice([[], ["x"], [edited[at], "y"]])
        docs.append((n, f"{prose(20)}\n {''.join(edited).upper() if n % 3 else ''.join(edited)}  {prose(15)}"))
    docs += [(100, None), (101, ""), (102, items[0][1]), (102, items[0][1]), (None, items[1][1] * 2), (103, "azqa"), (104, "x " * 30_000)]
    return items, docs


def test_every_match_within_budget(spark):
    items, docs = fixture()
    bench = spark.createDataFrame(items + items[:2], "item_id long, text string").withColumn("start", F.lit(1))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit("x")).withColumn("h", F.lit(1)).repartition(3)
    got = sorted((str(r["doc_id"]), r["item"], r["distance"]) for r in decontam.matches(df, bench).collect())
    want, dirty = [], []
    for key, text in docs:
        plain = decontam.normalised(text)
        own = [(str(key), str(i), d) for i, x in items if (p := decontam.normalised(x)) and (d := nearest(p, plain)) <= len(p) // 10]
        want += own
        dirty.append(bool(own))
    assert got == sorted(want) and len(want) > 40
    kept = decontam.clean(df, bench)
    assert kept.columns == df.columns
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect()) == sorted((str(k), t or "") for (k, t), d in zip(docs, dirty, strict=True) if not d)


def test_place_holds_the_match(spark):
    items, docs = fixture()
    table = {str(i): decontam.normalised(x) for i, x in items}
    texts = dict(docs)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for r in decontam.matches(df, bench).where("doc_id IS NOT NULL").collect():
        place = decontam.normalised(texts[r["doc_id"]])[r["start"] : r["end"]]
        assert nearest(table[r["item"]], place) == r["distance"] and abs(len(place) - len(table[r["item"]])) <= r["distance"]


def test_many_passes_find_the_same(spark, monkeypatch):
    items, docs = fixture()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    once = sorted(map(tuple, decontam.matches(df, bench).fillna(-1).collect()))
    size = decontam.passes.__defaults__
    monkeypatch.setattr(decontam.passes, "__defaults__", (200,))
    assert len(list(decontam.passes(bench, "item_id", "text"))) > 2 and size
    assert sorted(map(tuple, decontam.matches(df, bench).fillna(-1).collect())) == once


def test_empty_tables(spark):
    items, docs = fixture()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontam.matches(df, bench.limit(0)).count() == 0 and decontam.clean(df, bench.limit(0)).count() == len(docs)
    assert decontam.matches(df.limit(0), bench).count() == 0
