"""Decisions by row, bounds that hold for rows, and items of any length."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from crawlloom.llm import decontam, quality
from crawlloom.llm.common import Workspace, text_buffer
from tests.llm.test_dedup import words

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, text_key string, own string, kept string, selected string"


def documents(spark, rows):
    """documents with extra columns whose names the stages use themselves."""
    return spark.createDataFrame([(k, t, "en", s, len(t or ""), "k", "o", "x", "s") for k, t, s in rows], COLUMNS)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    r = random.Random(1)
    item = words(r, 40)
    spark.createDataFrame([(1, item), (None, "42 km x"), (3, ""), (4, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").where("false").write.parquet(f"{folder}/labels.parquet")
    return folder, item


def kept(out):
    assert out.columns == list(corpus_pipeline.COLUMNS)
    return sorted(((r.doc_id if r.doc_id is not None else -1, r.text) for r in out.collect()), key=lambda x: (x[0], x[1] or ""))


def test_decontamination_decides_by_row(spark, tables):
    folder, item = tables
    r = random.Random(2)
    clean = [words(r, 60) for _ in range(4)]
    rows = [(None, clean[0], "a"), (None, clean[1] + " " + item, "a"), (7, clean[2], "b"), (7, item, None), (8, "run 42\nKM  x!", "b"), (9, "142 km x and 42 km xy", "b"), (10, clean[3], "c"), (10, clean[3], "c"), (11, None, "c")]
    got = kept(corpus_pipeline.drop_contaminated(spark, documents(spark, rows), folder))
    assert got == sorted([(-1, clean[0]), (7, clean[2]), (9, rows[5][1]), (10, clean[3]), (10, clean[3]), (11, None)], key=lambda x: (x[0], x[1] or ""))


def test_near_copies_decide_by_row(spark, tables):
    r = random.Random(3)
    text, other = words(r, 200), words(r, 200)
    rows = [(None, text, "a"), (None, other, "a"), (5, text + " end", "b"), (5, words(r, 30), "b"), (4, other + " end", "c"), (4, other + " end", "d"), (6, None, "a"), (7, "", "a"), (None, " ", "a")]
    got = kept(corpus_pipeline.drop_near_copies(spark, documents(spark, rows), tables[0]))
    assert got == sorted([(4, other + " end"), (5, rows[3][1]), (5, text + " end"), (6, None)])


def test_exact_copies_decide_by_row(spark, tables):
    rows = [(None, "a", "x"), (None, "A", "x"), (3, "b", "x"), (3, "c", "x"), (2, "B", "x"), (3, "c", "y"), (None, None, "x")]
    got = kept(corpus_pipeline.drop_exact_copies(spark, documents(spark, rows), tables[0]))
    assert [(k, (t or "").lower()) for k, t in got] == [(-1, ""), (-1, "a"), (3, "b"), (3, "c")]


def test_stages_of_empty_tables(spark, tables):
    empty = documents(spark, [(1, "x", "a")]).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, tables[0]).count() == 0
    assert corpus_pipeline.keep_quality(spark, documents(spark, [(1, None, "a"), (None, "x", None)]), tables[0]).count() == 0  # without labels none is selected


def test_short_items_against_plain_search(spark):
    r = random.Random(4)
    texts = ["".join(r.choice("ab1é. \n") for _ in range(r.randrange(60))) for _ in range(120)] + [None, ""]
    items = [(k, "".join(r.choice("ab1é. ") for _ in range(r.randrange(1, 7)))) for k in range(60)] + [(None, "AB"), (99, "  ")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    fold = lambda t: re.sub(r"\s+", " ", (t or "").lower()).lstrip()
    want = set()
    for d, t in enumerate(texts):
        t = fold(t)
        for k, x in items:
            x = fold(x).strip()
            at = t.find(x) if x else -1
            while at >= 0:
                if not (t[at - 1 : at] if at else "").isalnum() and not t[at + len(x) : at + len(x) + 1].isalnum():
                    want.add((d, k))
                at = t.find(x, at + 1)
    rows = decontam.contaminated(docs, bench).collect()
    assert {(x.doc_id, x.item_id) for x in rows} == want and len(want) > 20
    for x in rows:  # from the first place to the last
        found, item = fold(texts[x.doc_id][x.start : x.end]).strip(), fold(dict(items)[x.item_id]).strip()
        assert found.startswith(item) and found.endswith(item)


def test_matches_in_parts_are_the_same(monkeypatch):
    """A q-gram that many items share, and an item that repeats itself, are walked in bounded parts."""
    r = random.Random(5)
    phrase = "the very same words in all of them, "
    items = [(k, phrase * 2 + "".join(r.choice("abcdefgh ") for _ in range(120))) for k in range(30)] + [(30, "ab" * 200)]
    text = decontam.folded(" ".join(phrase + "".join(r.choice("abcdefgh ") for _ in range(50)) for _ in range(40)) + items[7][1] + "x" * 50 + "ab" * 900 + items[3][1][40:130])[0]
    index = decontam.Index.of(items)

    def spans():
        out = {}
        for k, x, y, edits, a, b in decontam.matches(index, text):
            was = out.get(k, (x, y, edits, a, b))
            out[k] = (min(was[0], x), max(was[1], y), min(was[2], edits), min(was[3], a), max(was[4], b))
        return out

    whole = spans()
    assert {3, 7, 30} <= set(whole)
    for most in (5000, 300):
        monkeypatch.setattr(decontam, "MOST_HITS", most)
        got = spans()
        assert {k: x[2] for k, x in got.items()} == {k: x[2] for k, x in whole.items()}
        assert {k: x for k, x in got.items() if k != 30} == {k: x for k, x in whole.items() if k != 30}


def edits_within(a, b):
    """Least edits of a against any part of b."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [row[0] + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_long_items_against_every_window(spark):
    """Both ways: a text is found if and only if some window of the item is in it with few enough edits."""
    r = random.Random(6)
    letters = "abcdefghijklmnop "
    item = " ".join("".join(r.choice(letters) for _ in range(150)).split())
    w, e, _ = decontam.window_of(len(item))
    assert w == decontam.WINDOW < len(item)
    rows = []
    for k in range(70):
        at, n = r.randrange(len(item) - 60), r.randrange(60, 110)
        part = list(item[at : at + n])
        for _ in range(k % 8):
            p = r.randrange(len(part))
            kind = r.randrange(3)
            part[p : p + (kind != 1)] = [] if kind == 0 else [r.choice("xyzw")]
        pad = ["".join(r.choice("qrstuv ") for _ in range(40)) for _ in range(2)]
        rows.append((k, pad[0] + "".join(part) + pad[1]))
    got = {x.doc_id: x for x in decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    want = {}
    for k, t in rows:
        t = " ".join(t.split())
        best = min(edits_within(item[u : u + w], t) for u in range(len(item) - w + 1))
        if best <= e:
            want[k] = best
    assert set(got) == set(want) and 10 < len(want) < 65
    for k, x in got.items():
        text = " ".join(rows[k][1][max(0, x.start - e) : x.end + e].split())  # places are right to within the edits
        assert x.edits >= want[k] and x.item_end - x.item_start >= w and x.item_chars == len(item)
        assert edits_within(item[x.item_start : x.item_start + w], text) <= e or edits_within(item[x.item_end - w : x.item_end], text) <= e


def test_sample_is_bounded_by_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda b, o, g, n: seen.append(len(g)) or quality.Model(np.zeros(1 << quality.BITS, np.float32), np.zeros(n - 1)))
    docs = spark.range(4000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 3000).alias("text"))
    docs = docs.unionByName(spark.range(500).select(F.lit(2).cast("long").alias("doc_id"), F.lit("same").alias("text")))
    ratings = spark.createDataFrame([(1, 2), (2, 0)], "doc_id long, grade int")
    quality.fit_on(docs, ratings, 3, sample_rows=200)
    assert 100 < seen[0] < 320
    quality.fit_on(docs.where("doc_id = 2"), ratings, 3, sample_rows=200)
    assert seen[1] == 1


def test_scores_and_fit_against_plain_python():
    """Scores are plain sums and logits; the fit is where the penalised loss has no slope, by finite differences."""
    r = random.Random(7)
    texts = [" ".join(r.choice(["good", "fine"] if k % 3 else ["bad", "Worse!"]) + str(r.randrange(4)) for _ in range(r.randrange(1, 30))) for k in range(60)] + ["", "ALL CAPS", "1 2 3"]
    import pyarrow as pa

    buf, offs = text_buffer(pa.array(texts))
    buckets, o = quality.features(buf, offs)
    for k, t in enumerate(texts):  # texts don't see each other, nor the case of letters but for style
        own, _ = quality.features(*text_buffer(pa.array([t])))
        assert own.tolist() == buckets[o[k] : o[k + 1]].tolist() == sorted(set(own.tolist()))
    grades = np.array([2 if k % 3 else r.randrange(2) for k in range(60)] + [0, 1, 2])
    model = quality.fit(buckets, o, grades, 3, steps=3000, rate=0.1)
    rows = [buckets[a:b].tolist() for a, b in zip(o[:-1], o[1:])]
    scores = [sum(float(model.weights[x]) for x in row) for row in rows]
    assert np.allclose(model.scores(buckets, o), scores, atol=1e-4)
    assert np.allclose(model.tails(np.array(scores)), [[1 / (1 + np.exp(-(s - t))) for t in model.thresholds] for s in scores])
    used = sorted({x for row in rows for x in row if model.weights[x]})

    def loss(w, th):
        total = 0.0
        for row, g in zip(rows, grades):
            s = sum(w.get(x, 0.0) for x in row)
            total += sum(np.log1p(np.exp(-(s - t))) if g > j else np.log1p(np.exp(s - t)) for j, t in enumerate(th))
        return total / len(rows) + 4.0 / 2 / len(rows) * sum(x * x for x in w.values())

    w, th = {x: float(model.weights[x]) for x in used}, model.thresholds.tolist()
    for x in used[:15]:
        assert abs(loss(w | {x: w[x] + 1e-4}, th) - loss(w | {x: w[x] - 1e-4}, th)) / 2e-4 < 5e-3
    for j in range(2):
        up, down = ([t + (1e-4 if i == j else 0) * sign for i, t in enumerate(th)] for sign in (1, -1))
        assert abs(loss(w, up) - loss(w, down)) / 2e-4 < 5e-3
