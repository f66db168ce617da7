"""Repeated passages against all-pairs similarity on a small fixture."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from crosstide.llm import paragraphs


def grams(line):
    words = line.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(docs, least=0.8, passage=50):
    places = []
    for row, (key, text) in enumerate(docs):
        for p, (start, end, words, _) in enumerate(paragraphs.paragraphs(text)):
            assert text[start:end].lower().split() == words
            places.append((row, p, start, end, key, " ".join(words)))
    name = list(range(len(places)))
    sets = [grams(x[5]) for x in places]
    for i in range(len(places)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= least and name[i] != name[j]:
                old, new = name[i], name[j]
                name = [new if x == old else x for x in name]
    rows = defaultdict(set)
    for x, c in zip(places, name, strict=True):
        rows[c].add(x[0])
    pairs = defaultdict(set)
    follow = {(x[0], x[1]): c for x, c in zip(places, name, strict=True)}
    shared = {k: c for k, c in follow.items() if len(rows[c]) > 1}
    for (row, p), c in shared.items():
        if (row, p + 1) in shared:
            pairs[c, shared[row, p + 1]].add(row)
    first = {}
    for x, c in zip(places, name, strict=True):
        place = ((x[4] is not None, x[4] or 0), x[0], x[1])
        first[c] = min(first.get(c, place), place)
    out = []
    for row, p, start, end, key, line in places:
        if (row, p) not in shared:
            continue
        before = (row, p - 1) in shared and len(pairs[shared[row, p - 1], shared[row, p]]) > 1
        stays = first[shared[row, p]][1:] == (row, p)
        if before:
            out[-1][2:] = end, out[-1][3] + len(line.split()), out[-1][4] and not stays
        else:
            out.append([key, start, end, len(line.split()), not stays])
    return sorted((str(k), *rest) for k, *rest in out if rest[2] >= passage // 2)


def fixture():
    draw = random.Random(12)

    def line(n):
        return " ".join("".join(draw.choice("aeioundtsr") for _ in range(draw.randint(2, 6))) for _ in range(n))

    shared, two, boiler = line(70), [line(30), line(31)], line(12)
    docs = []
    for i in range(60):
        parts = [line(draw.randint(3, 40)) for _ in range(4)]
        if i % 3 == 0:
            words = shared.split()
            for _ in range(i % 2):
                words[draw.choice([0, len(words) - 1])] = "edited"
            parts.insert(draw.randrange(4), " ".join(words).upper() if i % 9 == 0 else " ".join(words))
        if i % 5 == 0:
            parts[2:2] = two
        if i % 7 == 0:
            parts[1:1] = [two[1], boiler]
        docs.append((i, "\n".join(parts) + "\n \n"))
    inside = line(60)
    docs += [(70, f"{inside}\n{line(5)}\n{inside}"), (71, None), (72, ""), (73, " \n\n"), (74, line(9_000)), (75, docs[1][1]), (75, docs[1][1]), (None, shared)]
    return docs


@pytest.mark.parametrize("block", [500, 2])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(paragraphs, "BLOCK", block)
    docs = fixture()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit("x")).withColumn("cluster", F.lit(1)).repartition(5)
    got = paragraphs.repeats(df).collect()
    assert sorted((str(r["doc_id"]), r["start"], r["end"], r["n_words"], r["removed"]) for r in got) == brute(docs)
    assert 20 < len(got) and 2 < sum(not r["removed"] for r in got) < len(got) / 2
    assert not any(r["doc_id"] in (70, 71, 72, 73, 74) for r in got)


def test_bands_reach_the_recall():
    for noise in (0.02, 1e-3):
        bands, rows = paragraphs.tuned(0.8, 0.99, noise)
        assert 1 - (1 - 0.8**rows) ** bands >= 0.99 and 1 - (1 - 0.05**rows) ** bands <= noise


def test_empty_table(spark):
    assert paragraphs.repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_large_group_of_near_copies_is_one_cluster(spark):
    whole = lambda words: len(paragraphs.paragraphs(" ".join(words))) == 1
    base = [f"w1x{j}" for j in range(30)]
    texts = [(i, " ".join([f"n{i}", *base[1:]] if i % 2 else [*base[:-1], f"n{i}"])) for i in range(250)]
    assert all(whole(t.split()) for _, t in texts)
    out = paragraphs.repeats(spark.createDataFrame(texts, "doc_id long, text string").repartition(6)).collect()
    assert len(out) == 250 and len({r["cluster"] for r in out}) == 1 and sum(not r["removed"] for r in out) == 1


def test_paragraphs_do_not_depend_on_what_stands_round_them():
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("aeioundtsr") for _ in range(draw.randint(2, 6)))
    shared = [word() for _ in range(120)]
    a = " ".join([*(word() for _ in range(200)), *shared, *(word() for _ in range(90))])
    b = " ".join([*(word() for _ in range(33)), *shared[:70], "\n", *shared[70:], "\n", word()])
    mine = [{tuple(w) for _, _, w, _ in paragraphs.paragraphs(t)} for t in (a, b)]
    assert sum(len(w) for w in mine[0] & mine[1]) >= 40
    assert [x for t in (a, b) for _, _, w, _ in paragraphs.paragraphs(t) for x in w] == (a + " " + b).split()
