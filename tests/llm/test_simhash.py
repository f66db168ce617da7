"""SimHash near-duplicates against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from crosstide.llm import simhash
from crosstide.llm.common import components

SPACE = set(" \t\n\r\x0b\x0c")


def slow_fingerprint(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in SPACE:
            words += [word] if word else []
            word = ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    if not words:
        return 0
    n = min(4, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(keys, prints, bits):
    name = list(range(len(keys)))
    changed = True
    while changed:
        changed = False
        for i in range(len(keys)):
            for j in range(len(keys)):
                if (prints[i] ^ prints[j]).bit_count() <= bits and name[j] < name[i]:
                    name[i], changed = name[j], True
    lowest = {}
    for i, n in enumerate(name):
        if keys[i] is not None:
            lowest[n] = min(lowest.get(n, keys[i]), keys[i])
    return [lowest.get(n) for n in name]


def fixture():
    draw = random.Random(3)
    vocabulary = [draw.choice("bcdfg") + draw.choice("aeiou") + draw.choice("lmnr") for _ in range(60)]
    base = [[draw.choice(vocabulary) for _ in range(draw.randint(1, 400))] for _ in range(25)]
    texts = [None, "", " \t\n", "one", "ONE", "one two three four", "ÄB äb", "x" * 100_000, "a b c d e"]
    for words in base:
        texts += [" ".join(words), "\n".join(words).upper()]
        for _ in range(4):
            edited = list(words)
            edited[draw.randrange(len(edited))] = "zz"
            texts.append(" ".join(edited))
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [(None, texts[9]), (None, "nobody else says this"), (5, texts[5]), (5, "same key, other text")]


def test_near_duplicates(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit("x")).withColumn("p", F.lit(1)).repartition(5)
    out = simhash.near_duplicates(df)
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["fingerprint"] % (1 << 64), -1 if r["component_id"] is None else r["component_id"]) for r in out.collect())
    prints = [slow_fingerprint(t) for _, t in rows]
    names = slow_components([k for k, _ in rows], prints, 4)
    want = sorted(((k is not None, k or 0), p, -1 if n is None else n) for (k, _), p, n in zip(rows, prints, names, strict=True))
    assert got == want
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    mine = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in kept.collect())
    assert mine == sorted((-1 if k is None else k, t or "") for (k, t), n in zip(rows, names, strict=True) if k == n)
    shuffled = simhash.keep_first(df, sent=0)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in shuffled.collect()) == mine


@pytest.mark.parametrize("bits,count", [(4, 3), (0, 3), (3, 3), (6, 3), (4, 4), (5, 2)])
def test_links_are_complete(spark, bits, count):
    draw = np.random.default_rng(bits)
    centre = draw.integers(0, 1 << 63, size=8, dtype=np.uint64)
    prints = {int(c) for c in centre}
    for c in centre.tolist():
        for _ in range(25):
            x = c
            for b in draw.choice(64, size=draw.integers(1, 5), replace=False).tolist():
                x ^= 1 << b
            prints.add(x)
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "p long")
    got = [tuple(sorted(r)) for r in simhash.links(df, bits, count).collect()]
    want = {tuple(sorted((a, b))) for a in signed for b in signed if a < b and (a ^ b).bit_count() <= bits or a < b and ((a ^ b) % (1 << 64)).bit_count() <= bits}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("crowd", [1, 4, 30, 1000])
def test_crowded_values_give_the_same_components(spark, crowd):
    draw = np.random.default_rng(crowd)
    prints = set()
    for centre in draw.integers(0, 1 << 63, size=4, dtype=np.uint64).tolist():
        for _ in range(70):  # up to 3 bits from the centre, so a group holds pairs that are not linked
            x = centre
            for b in draw.choice(64, size=draw.integers(0, 4), replace=False).tolist():
                x ^= 1 << b
            prints.add(x)
    base = 0x5A5A5A << 42  # one segment value, all else at random: mostly unlinked
    prints |= {base | int(draw.integers(0, 1 << 42)) for _ in range(60)}
    chain = base | 0x3FF
    for b in range(0, 40, 3):
        chain ^= 7 << b
        prints.add(chain)
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "p long")
    got = {r["node"]: r["component"] for r in components(simhash.forest(df, crowd=crowd)).collect()}
    want = {r["node"]: r["component"] for r in components(simhash.links(df)).collect()}
    assert got == want and len(set(want.values())) >= 4


def test_segments_cover_the_budget():
    for bits in range(12):
        for count in range(1, 9):
            cut = simhash.segments(bits, count)
            assert sum(w for _, w, _ in cut) == 64 and sum(b + 1 for _, _, b in cut) == bits + 1 and min(b for *_, b in cut) >= 0


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_first(none).count() == 0


def test_components_of_a_chain_a_star_and_noise(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1001 + i) for i in range(300)]
    rows = chain + star + [(5, 5), (None, 3), (3, None), (7, 6), (-4, 2_000), (2_000, -9)]
    df = spark.createDataFrame(rows, "u long, v long").repartition(16)
    got = {r["node"]: r["component"] for r in components(df).collect()}
    want = {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1301)} | {-9: -9, -4: -9, 2_000: -9}
    assert got == want
