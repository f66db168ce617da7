"""Repeated passages against a brute force over raw words."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from crosstide.llm import paragraphs, passages
from crosstide.llm import words as arrays

draw = random.Random(31)


def words(n):
    return ["".join(draw.choice("aeioundtsr") for _ in range(draw.randint(6, 9))) for _ in range(n)]


def brute(docs, passage=50):
    """The words of each row that lie in ``passage`` words another row has too, as spans."""
    rows = defaultdict(set)
    texts = [(text or "").lower().split() for _, text in docs]
    for r, x in enumerate(texts):
        for i in range(len(x) - passage + 1):
            rows[tuple(x[i : i + passage])].add(r)
    out = []
    for (key, _), x in zip(docs, texts, strict=True):
        last = None
        for i in range(len(x) - passage + 1):
            if len(rows[tuple(x[i : i + passage])]) > 1:
                if last and i < last[1]:
                    last[1] = i + passage
                else:
                    out.append(last := [i, i + passage, key, x])
    return sorted((str(key), tuple(x[a:b])) for a, b, key, x in out)


def found(spark, docs):
    return passages.repeated(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()


def test_verbatim_passages_inside_lines(spark):
    docs = []
    for i in range(200):
        shared = words([50, 51, 60, 75, 100][i % 5])
        for side in (0, 1):
            parts = [*words(draw.randint(60, 90)), *shared, *words(draw.randint(60, 90))]
            if side and i % 3 == 0:
                parts[draw.randrange(len(parts))] += "\n"
            docs.append((2 * i + side, " ".join(parts).upper() if i % 7 == 0 else " ".join(parts)))
    docs += [(900, None), (901, ""), (902, " \n\n"), (904, " ".join(words(49))), (903, " ".join(words(5) * 100))]
    texts = dict(docs)
    got = found(spark, docs)
    assert sorted((str(r["doc_id"]), tuple(texts[r["doc_id"]][r["start"] : r["end"]].lower().split())) for r in got) == brute(docs)
    assert len(got) == 400 and all(r["removed"] == bool(r["doc_id"] % 2) and r["kept_in"] == r["doc_id"] // 2 * 2 for r in got)


def test_repeated_rows_null_keys_and_many_places(spark):
    a, b = words(70), words(55)
    docs = [(None, " ".join([*words(30), *a, *words(20)])), (7, " ".join([*a, *words(9), *b])), (7, " ".join([*a, *words(9), *b])), (8, " ".join([*b, *words(60), *b]))]
    got = found(spark, docs)
    assert sorted((str(r["doc_id"]), r["n_words"], r["removed"], str(r["kept_in"])) for r in got if r["doc_id"] != 7) == [("8", 55, True, "7"), ("8", 55, True, "7"), ("None", 70, False, "None")]
    assert sum(not r["removed"] for r in got) == 2
    assert passages.repeated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_copies_of_lines_with_edits_anywhere(spark):
    docs, whole = [], set()
    for i in range(200):
        n, edits = [(55, 1), (60, 1), (70, 1), (100, 2)][i % 4]
        line = words(n)
        copy = list(line)
        for at in draw.sample(range(n), edits):
            copy[at] = "edited" + words(1)[0]
        grams = [{tuple(x[j : j + 5]) for j in range(n - 4)} for x in (line, copy)]
        if len(grams[0] & grams[1]) >= 0.8 * len(grams[0] | grams[1]):
            whole |= {2 * i, 2 * i + 1}
        docs += [(2 * i, "\n".join([" ".join(words(9)), " ".join(line)])), (2 * i + 1, "\n".join([" ".join(copy), " ".join(words(12))]))]
    got = found(spark, docs)
    hit = {r["doc_id"] for r in got if r["n_words"] in (55, 60, 70, 100)}
    assert len(whole) > 250 and len(hit & whole) >= 0.97 * len(whole)
    assert all(r["removed"] == bool(r["doc_id"] % 2) for r in got if r["doc_id"] in hit & whole)


def test_shorter_notices_stay(spark):
    docs = []
    for n in (25, 40, 49, 50):
        notice = " ".join(words(n))
        docs += [(100 * n + i, "\n".join([" ".join(words(30)), notice, " ".join(words(30))]) if i % 2 else " ".join([*words(20), notice, *words(20)])) for i in range(40)]
    got = found(spark, docs)
    assert sorted(r["doc_id"] for r in got) == list(range(5000, 5040)) and sum(not r["removed"] for r in got) == 1


def test_windows_round_a_gram_are_one_row():
    text = " ".join(words(2_000))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["row", "x"])
    prints = pa.Table.from_batches(passages._prints(50)(iter([batch])))
    spots = pa.array([prints["at"].to_pylist()], pa.list_(pa.int32()))
    out = pa.Table.from_batches(passages._windows(50)(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text]), spots], ["place", "x", "spots"])])))
    assert out.num_rows < 2_000 / 5 and sum(len(g) for g in out["g"].to_pylist()) == 1_951


def test_words_of_several_texts_are_those_of_split():
    texts = ["", "İx ab ΣΣ\u0085c\xa0D \U0001f600", "\n \r\n", "ab x\u3000AB", *(" ".join(words(40)) for _ in range(20))]
    got = arrays.words(texts)
    seen = {}
    for i, text in enumerate(texts):
        at = range(got.first[i], got.first[i + 1])
        assert [text[got.start[j] - got.begin[i] : got.end[j] - got.begin[i]] for j in at] == text.split()
        assert all(seen.setdefault(x, got.hashes[j]) == got.hashes[j] for x, j in zip(text.lower().split(), at, strict=True))
    assert len(set(seen.values())) == len(seen)


def test_a_parts_smallest_hashes_are_those_of_its_own_shingles():
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), pa.array([" ".join(words(3_000))])], ["k", "row", "x"])
    parts = [x for x in pa.Table.from_batches(passages._split(5, 7, 3, 50)(iter([batch]))).to_pylist() if x["p"] >= passages.PARTS]
    alone = pa.RecordBatch.from_arrays([*[pa.array(range(len(parts)))] * 2, pa.array([x["line"] for x in parts])], ["k", "row", "x"])
    lines = {x["row"]: x for x in pa.Table.from_batches(passages._split(5, 7, 3, 50)(iter([alone]))).to_pylist() if x["p"] < passages.PARTS}
    assert len(parts) > 30 and all(lines[i]["bands"] == x["bands"] and lines[i]["h"] == x["h"] for i, x in enumerate(parts))


def test_common_shingles_in_any_number_of_columns(monkeypatch):
    sets = paragraphs._sets([" ".join(draw.choice("abcd") for _ in range(draw.randint(1, 40))) for _ in range(60)], 5)
    for held in (4_000_000, 300):
        monkeypatch.setattr(paragraphs, "HELD", held)
        both = paragraphs._common(sets)
        assert all(both[i, j] == len(sets[i] & sets[j]) for i in range(60) for j in range(i))
    assert np.all(both >= 0)


def test_overlapping_parts_of_one_text_are_no_link(spark):
    line = words(60)
    rows = [(1, 10, " ".join(line), [5]), (2, 10, " ".join(line[1:]), [5]), (3, 20, " ".join(words(60)), [5])]
    lines = spark.createDataFrame(rows, "h long, row long, line string, bands array<long>")
    assert paragraphs.similar(lines).count() == 0
    again = lines.unionAll(spark.createDataFrame([(2, 30, " ".join(line[1:]), [5])], lines.schema))
    assert sorted(r["h"] for r in paragraphs.similar(again).collect()) == [1, 2]


def plainly_merged(items, passage):
    """The spans of one row, (w, n_words, firsts or None, stays), merged one by one: first span, last span, words, removed."""
    near = [(w, w + n) for w, n, firsts, _ in items if firsts is None]
    exact = [(w, w + n, firsts) for w, n, firsts, _ in items if firsts is not None]
    out = []
    for x, (w, n, firsts, stays) in enumerate(items):
        if stays:
            over = [e for e in exact if e[0] <= w][-1:]
            stays = not over or over[0][1] < w + n or any(w <= f <= w + n - passage for f in over[0][2])
        stays = stays or any(not any(a <= f and f + passage <= b for a, b in near) for f in firsts or [])
        if out and w < out[-1][4]:
            if w + n > out[-1][4]:
                out[-1][1], out[-1][2], out[-1][4] = x, out[-1][2] + w + n - out[-1][4], w + n
            out[-1][3] = out[-1][3] and not stays
        else:
            out.append([x, x, n, not stays, w + n])
    return [tuple(x[:4]) for x in out]


def test_spans_of_many_rows_merge_together(monkeypatch):
    rows, want = [], []
    for row in range(3_000):
        items = []
        for _ in range(draw.randint(1, 6)):
            w, n = draw.randint(0, 60), draw.randint(5, 30)
            exact = draw.random() < 0.6
            items.append((w, n, sorted(draw.sample(range(w, w + n - 4), draw.randint(0, min(3, n - 4)))) if exact else None, not exact and draw.random() < 0.5))
        items.sort(key=lambda x: (x[0], -x[1]))
        rows += [(row, -row, w, n, 10 * w, 10 * (w + n), 7, 1, firsts, stays) for w, n, firsts, stays in items]
        want += [(-row, 10 * items[a][0], 10 * sum(items[b][:2]), n, 7, 1, removed) for a, b, n, removed in plainly_merged(items, 5)]
    names = ["row", "k", "w", "n_words", "start", "end", "cluster", "kept_in", "firsts", "stays"]
    i, q = pa.int32(), pa.int64()
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [q, q, i, q, i, i, q, q, pa.list_(i), pa.bool_()], strict=True)]
    batches = pa.Table.from_arrays(columns, names).to_batches(max_chunksize=2_500)
    made = []
    monkeypatch.setattr(pa, "Table", type("Table", (), {"from_batches": staticmethod(lambda x, f=pa.Table.from_batches: (made.append(1), f(x))[1])}))
    got = [tuple(r.values()) for b in passages._merged(5)(iter(batches)) for r in b.to_pylist()]
    assert got == want
    assert len(made) < 20  # tables of many rows, not one for each
