import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from crawlloom.llm import decontam, packing, quality, queries, tokenbin
from crawlloom.llm.common import Workspace, text_buffer, tokenizer_path
from crawlloom.llm.encode import Encoder

TEXTS = ["", None, " a  b", "x \n y", "a<|endoftext|> b", "  z", "a\0b \0 c", "  ", "tail ", "it's don't", "a" * 5000, "é" * 300 + " ß", "one two three", "one two three", " x y", "x　 y", "😀 " * 50, "word " * 3000]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(tokenizer_path())


def ids_of(plain, text, end):
    return plain.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_agrees_with_the_library(plain, monkeypatch):
    from crawlloom.llm import encode

    monkeypatch.setattr(encode, "CACHE_WORDS", 50)  # so that words are forgotten, too
    code, r = Encoder(tokenizer_path()), random.Random(1)
    for _ in range(20):
        texts = [r.choice(TEXTS) for _ in range(5)] + [" ".join(r.choice(["ab", "Cd,", "e\n", "é.", "", "12", "|"]) + r.choice("abcdefgh") for _ in range(40))]
        ids, counts = code.encode(*text_buffer(pa.array(texts, pa.string())))
        ends = np.concatenate([[0], np.cumsum(counts)])
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_token_orc(spark, plain, monkeypatch):
    monkeypatch.setattr(tokenbin, "PIECE_IDS", 700)
    docs = spark.createDataFrame([(k * 3 % 19 - 2, t, 1) for k, t in enumerate(TEXTS)], "doc_id long, text string, part int")
    ws = Workspace(spark, "test")
    tokenbin.write_token_orc(docs, ws.at("orc"), tokenizer_path())
    got = sorted(tokenbin.document_index(spark, ws.at("orc")).collect(), key=lambda r: r.start)
    want, at = [], 0
    for k, t in sorted((k * 3 % 19 - 2, t) for k, t in enumerate(t or "" for t in TEXTS)):
        ids = ids_of(plain, t, 2)
        want.append((k, at, len(ids), crc(ids)))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    rows = tokenbin.lookup(spark, ws.at("orc"), [want[3][0]]).collect()
    assert crc([i for r in rows for i in r.ids]) == want[3][3]
    tokenbin.write_token_orc(docs.limit(0), ws.at("none"), tokenizer_path())
    assert tokenbin.document_index(spark, ws.at("none")).count() == 0


def pieces_are_right(rows, docs, plain, sequence=2048):
    """Each document's ids lie in exactly one piece, and the sequences are filled without a gap."""
    place = sorted((r.sequence_id * sequence + r.offset, r.length) for r in rows)
    at = 0
    for pos, n in place:
        assert pos == at and pos // sequence == (pos + n - 1) // sequence
        at += n
    own = defaultdict(list)
    for r in rows:
        own[r.doc_id].append(r)
    want = Counter()
    for k, t in docs:
        want[k, tuple(ids_of(plain, t, 1))] += 1
    for (k, ids), n in want.items():
        got = sorted((r.start, r.length, r.ids_crc32) for r in own[k] if r.doc_tokens == len(ids))
        if n == 1 and len([x for x in want if x[0] == k]) == 1:
            start = 0
            for a, size, c in got:
                assert a == start and c == crc(ids[a : a + size])
                start += size
            assert start == len(ids)
    assert at == sum(len(ids) * n for (_, ids), n in want.items())


def test_packing(spark, plain):
    r = random.Random(2)
    docs = [(k, t, r.choice(["a", "b", None])) for k, t in enumerate(TEXTS)] + [(100 + k, "w " * r.randrange(1, 900), "hot") for k in range(40)] + [(None, "null id", "a")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = packing.pack(frame, window=4096).withColumn("ids_crc32", F.crc32("ids")).collect()
    pieces_are_right(rows, [(k, t) for k, t, _ in docs], plain)
    assert packing.pack(frame.limit(0)).count() == 0
    share = Counter()
    for x in rows:
        share[x.window_id, x.queue] += x.length
    total = Counter()
    for (_, q), n in share.items():
        total[q] += n
    whole = sum(total.values())
    for w in range(whole // 4096):
        for q in total:
            assert abs(share[w, q] - 4096 * total[q] / whole) <= 1


def test_schedule_of_a_target_mixture():
    plan = packing.Schedule({"a": 100_000, "b": 100_000, "c": 500}, {"a": 3.0, "b": 1.0}, window=1000)
    assert abs(plan.sent(0, 10) - 7500) <= 1 and abs(plan.sent(1, 10) - 2500) <= 1
    assert [plan.sent(q, plan.n_windows) for q in range(3)] == [100_000, 100_000, 500]
    for q in range(3):
        sent = [plan.sent(q, k) for k in range(plan.n_windows + 1)]
        assert sent == sorted(sent)
        for token in (0, 1, 499):
            k = plan.window_of(q, token)
            assert plan.sent(q, k) <= token < plan.sent(q, k + 1)
    sizes = [sum(plan.sent(q, k + 1) - plan.sent(q, k) for q in range(3)) for k in range(plan.n_windows)]
    assert sum(abs(n - 1000) > 3 for n in sizes) <= 3 and max(sizes) <= 1003  # short only where a queue runs dry


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    train = labels.where("doc_id % 4 <> 0")
    model = quality.fit_on(docs.select("doc_id", "text"), quality.grades_of(train), 3)
    held = quality.score(docs.select("doc_id", "text"), model).join(labels.where("doc_id % 4 = 0"), "doc_id")
    rows = held.select("quality", "toxic", "tails", "expected_grade").collect()
    keep = [r.tails[-1] >= quality.LEAST_TAIL for r in rows]
    clean = [r.quality == 1 and r.toxic == 0 for r in rows]
    assert np.mean([k for k, c in zip(keep, clean) if c]) > 0.95
    assert np.mean([k == c for k, c in zip(keep, clean)]) > 0.92
    assert model.thresholds[0] <= model.thresholds[1] and all(r.tails[0] >= r.tails[1] for r in rows)


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 100_000), (None, "y"), (3, "z")], "doc_id long, text string").withColumn("tails", F.lit(1))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.selected(docs, none)
    assert out.count() == 5 and {tuple(r.tails) for r in out.collect()} == {(0.5, 0.5)}
    some = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (3, 1, 0), (8, 1, 1), (None, 1, 1), (2, None, 1)], "doc_id long, quality int, toxic int")
    assert quality.selected(docs, some).count() == 5 and quality.selected(docs.limit(0), some).count() == 0


def test_decontamination_against_verbatim_search(spark, sf_dir):
    got = {(r.doc_id, r.item_id) for r in queries.op9_decontam(spark, sf_dir).collect()}
    fold = lambda t: " ".join(t.lower().split())
    items = {r.item_id: fold(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    docs = {r.doc_id: fold(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    assert want and want <= got


def distance(a, b):
    """Least edits of a against any part of b."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [row[0] + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_decontamination_against_full_alignment(spark):
    r = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz     "
    item = "".join(r.choice(letters) for _ in range(70)).strip()
    item = " ".join(item.split())
    rows = [(0, None), (1, ""), (2, item), (3, item.upper().replace(" ", "\n\t ")), (4, "z" * 200_000 + item)]
    for k in range(60):
        t = list(item)
        for _ in range(k % 9):
            at = r.randrange(len(t))
            kind = r.randrange(3)
            t[at : at + (kind != 1)] = [] if kind == 0 else [r.choice("abcdefgh")]
        rows.append((10 + k, "".join(r.choice(letters) for _ in range(90)) + "".join(t) + "".join(r.choice(letters) for _ in range(90))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, "short"), (None, item)], "item_id long, text string")
    got = {x.doc_id for x in decontam.contaminated(docs, bench).collect()}
    w, e, _ = decontam.window_of(len(item))
    assert w == len(item)
    want = {k for k, t in rows if t and len(t) < 1000 and distance(item, " ".join(t.lower().split())) <= e} | {4}
    assert got == want
    assert decontam.contaminated(docs.limit(0), bench).count() == 0 and decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_texts_don_t_run_into_each_other(spark):
    item = "".join(random.Random(8).choice("abcdefghijklmnop ") for _ in range(80))
    docs = spark.createDataFrame([(1, item[:40]), (2, item[40:])], "doc_id long, text string").coalesce(1)
    assert decontam.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).count() == 0


def test_pipeline_stages_against_brute_force(spark, plain, sf_dir):
    from tests.llm.test_dedup import LOWER, plain_classes

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ws = Workspace(spark, "test-pipeline")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "decontam", "packing"]
    rows = lambda d: {r.doc_id: r.text for r in d.collect()}
    before = rows(docs)
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = ws.save(stage(spark, docs, sf_dir), name)
        if name == "packing":
            pieces_are_right(out.collect(), before.items(), plain)
            assert sorted((r.doc_id, r.start) for r in out.collect()) == sorted((r.doc_id, r.start) for r in corpus_pipeline.run(spark, sf_dir).collect())
            break
        assert tuple(out.columns) == corpus_pipeline.COLUMNS
        after = rows(out)
        assert out.count() == len(after) and after.items() <= before.items()
        if name == "quality":
            assert np.mean([k in after for k, x in labels.items() if x == (1, 0)]) > 0.95
        elif name == "exact_dedup":
            last = {}
            for k, t in sorted(before.items()):
                last[t.translate(LOWER)] = k
            assert set(after) == set(last.values())
        elif name == "near_dedup":
            assert set(after) == {c for _, _, c in plain_classes(sorted(before.items()))}
        elif name == "decontam":
            items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            assert not any(x in " ".join(t.lower().split()) for t in after.values() for x in items)
        docs, before = out, after
