import random
import re

import numpy as np

import corpus_pipeline
from crawlloom.llm import jaccard, simhash
from crawlloom.llm.common import Workspace
from tests.llm.test_dedup import LOWER, table, words


def plain_shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute_force(rows):
    """(doc_id, least doc_id of its class), every pair compared."""
    sets, up = [plain_shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), k), k)
    return sorted((k, least[root(i)]) for i, (k, _) in enumerate(rows))


def test_near_copies_against_all_pairs(spark, monkeypatch):
    r = random.Random(11)
    base = [words(r, 150) for _ in range(8)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE two"), (5, "ONE two"), (6, "x " * 5000), (7, "a b c d e"), (8, "a b c d e f")]
    for k in range(96):
        t = base[k % 8].split(" ")
        for _ in range(k // 8):
            t[r.randrange(len(t))] = "q" + str(r.randrange(9))
        rows.append((10 + k, " ".join(t)))
    for common in (jaccard.COMMON, 2, 10**6):
        monkeypatch.setattr(jaccard, "COMMON", common)
        assert sorted((x.doc_id, x.component_id) for x in simhash.near_copies(table(spark, rows)).collect()) == brute_force(rows)
    assert len({c for _, c in brute_force(rows)}) < len(rows) - 20
    assert simhash.near_copies(table(spark, rows).limit(0)).count() == 0


def test_stage_against_brute_force(spark, sf_dir):
    """Documents 1 and 177 are at 0.83, and 8 bits of SimHash apart."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").dropDuplicates(["doc_id"])
    rows = sorted((x.doc_id, x.text) for x in docs.collect())
    kept = {x.doc_id for x in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()}
    assert kept == {c for _, c in brute_force(rows)} and 1 in kept and 177 not in kept


def test_sets_too_far_apart_make_no_pairs():
    """A group that shares a third of its shingles, all in one tok, makes no pair; sets that are alike all do."""
    r = np.random.default_rng(5)
    for shared, pairs in ((30, 0), (97, 40 * 39 // 2)):
        sets = [np.unique(np.concatenate([np.arange(shared) * 7919, r.integers(1 << 20, 1 << jaccard.KEY_BITS, 100 - shared)])) for _ in range(40)]
        similar = sum(9 * len(np.intersect1d(x, y)) >= 4 * (len(x) + len(y)) for k, x in enumerate(sets) for y in sets[:k])
        odd = np.array([jaccard.odd_bits(x) for x in sets])
        made = jaccard.candidates(np.ones(40, np.int64), np.arange(40), np.full(40, 100), np.full(40, 100), np.arange(40), odd)
        assert sum(len(a) for a, _ in made) == similar == pairs


def test_common_shingles_are_counted_in_all_texts(spark):
    rows = [(k, f"{'abc'[k % 3]} b c d e x{k}") for k in range(36)]
    docs = table(spark, rows).select("doc_id", "text")
    ws = Workspace(spark, "test-common")
    known, place = jaccard.common_shingles(docs, 5, ws)
    want = {int(jaccard.keys(jaccard.hashes(f"{x} b c d e"))[0]) for x in "abc"}
    assert set(known.tolist()) == want and sorted(place.tolist()) == [0, 1, 2]
