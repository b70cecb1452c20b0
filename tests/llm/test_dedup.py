import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from crawlloom.llm import exact_dedup, queries, simhash, suffix_dedup

LOWER = {i: i + 32 for i in range(65, 91)}
WORDS = ["alpha", "beta", "gaémma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "lam", "mu"]
ROWS = "doc_id long, text string, fp string, digest string"


def table(spark, rows):
    """With extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "fp", "digest") for i, t in rows], ROWS)


def words(r, n):
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def repeats(rows, window=200):
    """Brute force: (doc_id, n_bytes, removed, spans, digest of the rest)."""
    seen = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[k : k + window] for k in range(len(b) - window + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - window + 1):
            if seen[b[k : k + window]] > 1:
                gone[k : k + window] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def removed(df):
    out = suffix_dedup.remove_repeats(df)
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return [tuple(r) for r in out.select("doc_id", "n_bytes", size, F.size("spans"), F.sha2("kept", 256)).collect()]


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_against_brute_force(spark, seed):
    r = random.Random(seed)
    p, q = words(r, 60), words(r, 30)[:150]
    rows = [
        (1, p), (2, words(r, 30) + p + words(r, 20)), (3, None), (4, ""), (5, "a" * 700), (6, "ab" * 300 + words(r, 10)), (7, words(r, 10) + q + words(r, 40)), (8, words(r, 40) + q + words(r, 60)),
        (8, words(r, 40) + q), (9, p), (9, p), (10, p[:199]), (11, p[:200]), (12, words(r, 20) + p[50:250] + words(r, 5) + p[100:310]), (13, "x" + "a" * 250 + "y"),
        (14, p[:150] + "Q" + p[151:]), (15, "é" * 500), (16, words(r, 300)), (17, words(r, 30) + "abcdefg" * 60), (18, "\0" * 300),
    ]
    key = lambda x: tuple(map(str, x))
    assert sorted(removed(table(spark, rows)), key=key) == sorted(repeats(rows), key=key)


def test_repeats_without_identifiers(spark):
    """Rows without an identifier, and ones with any identifier there is, keep what is theirs."""
    r = random.Random(8)
    p = words(r, 60)
    rows = [(None, p + words(r, 9)), (None, words(r, 50)), (0, p), (-(2**63), words(r, 50)), (None, None)]
    key = lambda x: tuple(map(str, x))
    assert sorted(removed(table(spark, rows)), key=key) == sorted(repeats(rows), key=key)


def test_equality_rests_on_cryptographic_digests(spark):
    """Rows whose names agree but whose bytes don't are not repeated; the digests are those of the bytes."""
    ws = suffix_dedup.Workspace(spark, "test")
    rows = spark.createDataFrame([(1, 1, 0, 1, 0, 5, 10, 11, 1), (2, 2, 0, 1, 0, 5, 10, 12, 1), (3, 3, 0, 1, 0, 5, 13, 11, 1), (4, 4, 0, 1, 0, 6, 1, 1, 1), (5, 5, 0, 1, 0, 6, 1, 1, 1)], suffix_dedup.ROWS)
    full, checks = suffix_dedup.decide(ws, rows, "t")
    assert sorted(x.doc_id for x in full.collect()) == [4, 5] and sorted(x.doc_id for x in checks.collect()) == [1, 2, 3]
    buf = np.random.default_rng(1).integers(0, 256, 5000).astype(np.uint8)
    text, first, n, d, m, c = suffix_dedup.runs(buf, np.array([0, 2000]), 200)
    s = suffix_dedup.sums(buf)
    cases = [(first, n, c)]
    for cut in (suffix_dedup.grid, suffix_dedup.single):
        run, at, count, far, m, digests = cut(s, buf, first, n, d, 200)
        cases.append((at, count, digests))
    for a, k, digests in cases:
        for x, y, got in zip(a, k, digests):
            assert got.tobytes() == hashlib.blake2b(buf[x : x + y + 199].tobytes(), digest_size=16).digest()


def test_repeats_of_empty_table_and_long_text(spark, monkeypatch):
    assert removed(table(spark, [(1, "x")]).limit(0)) == []
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1 << 20)
    r = random.Random(3)
    text = "".join(chr(r.randrange(97, 123)) for _ in range(1_300_000))
    rows = [(1, text), (2, text[1_048_300:1_049_000])]
    got = {x[0]: x[1:4] for x in removed(table(spark, rows))}
    assert got == {1: (1_300_000, 700, 1), 2: (700, 700, 1)}


def test_op1_on_the_small_table(spark, sf_dir):
    docs = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(tuple(x) for x in queries.op1_suffix_dedup(spark, sf_dir).collect()) == sorted(repeats(docs))


def plain_fingerprint(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[i : i + k]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(rows, budget=4):
    fps = [plain_fingerprint(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                up[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), k), k)
    return [(k, f"{fps[i]:016x}", least[root(i)]) for i, (k, _) in enumerate(rows)]


def test_near_duplicates_against_all_pairs(spark):
    r = random.Random(4)
    base = [words(r, 120) for _ in range(12)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE two"), (5, "ONE two"), (6, "x " * 5000)]
    for k in range(80):
        t = base[k % 12].split(" ")
        for _ in range(k // 12):
            t[r.randrange(len(t))] = "q" + str(r.randrange(9))
        rows.append((10 + k, " ".join(t)))
    got = [tuple(x) for x in simhash.near_duplicates(table(spark, rows)).collect()]
    assert sorted(got) == sorted(plain_classes(rows))
    assert simhash.near_duplicates(table(spark, rows).limit(0)).count() == 0


def test_near_duplicates_with_small_nodes(spark, monkeypatch):
    """Many nodes, and nodes of several blocks, give the same classes."""
    r = random.Random(5)
    near = "same words in every one of these texts again and again until there are enough of them to be alike".split(" ")
    rows = [(k, " ".join(near + [f"w{r.randrange(4)}"]) if k % 2 else words(r, 30)) for k in range(120)]
    monkeypatch.setattr(simhash, "NODE_KEYS", 4)
    got = [tuple(x) for x in simhash.near_duplicates(table(spark, rows)).collect()]
    assert sorted(got) == sorted(plain_classes(rows))


def test_links_of_random_keys_against_all_pairs():
    r = np.random.default_rng(6)
    keys = r.integers(0, 2**63, 400, np.uint64)
    keys = np.unique(np.concatenate([keys, keys[:200] ^ (np.uint64(1) << r.integers(0, 64, 200, np.uint64)), keys[:100] ^ np.uint64(0xF00), keys[:50] ^ np.uint64(0x1F00)]))
    got = {(int(a), int(b)) for i, j in simhash.links(keys, keys, 4, True) for a, b in zip(i, j)}
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.bitwise_count(keys[:, None] ^ keys[None, :]) <= 4)) if a < b}
    assert got == want and len(want) >= 300


def test_classes_of_a_dense_cluster():
    """Passing over pairs that lie in one class leaves the classes as they are."""
    r = np.random.default_rng(9)
    keys = np.full(1500, 0x123456789ABCDEF0, np.uint64)
    for k in range(3):
        keys[k * 300 :] ^= np.uint64(1) << r.integers(0, 64, 1500 - k * 300, np.uint64)
    keys = np.unique(np.concatenate([keys, r.integers(0, 2**63, 500, np.uint64)]))
    plain = fewer = np.arange(len(keys))
    n_plain = n_fewer = 0
    for i, j in simhash.links(keys, keys, 4, True):
        plain, n_plain = simhash.forest(i, j, plain), n_plain + len(i)
    for i, j in simhash.links(keys, keys, 4, True, lambda: (fewer, fewer)):
        fewer, n_fewer = simhash.forest(i, j, fewer), n_fewer + len(i)
    assert (plain == fewer).all() and n_fewer <= n_plain


def test_exact_dedup(spark):
    rows = [(1, "Abc"), (5, "aBC"), (3, "abc"), (2, None), (9, ""), (4, "ÄB"), (6, "äb"), (7, "x" * 300_000), (8, "X" * 300_000), (8, "X" * 300_000), (None, "abc"), (None, "only")]
    got = exact_dedup.exact_dedup(table(spark, rows)).collect()
    want = collections.defaultdict(list)
    for k, t in rows:
        want[(t or "").translate(LOWER)].append(k)
    assert len(got) == len(rows)
    by_text = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in want.items()}
    for x in got:
        ids = by_text[x.text_sha256]
        keep = max((i for i in ids if i is not None), default=None)
        assert (x.keep_id, x.group_size, x.kept) == (keep, len(ids), x.doc_id == keep)
    assert exact_dedup.exact_dedup(table(spark, rows).limit(0)).count() == 0


def test_exact_dedup_state_grows_over_batches(spark):
    from crawlloom.llm.common import Workspace

    dedup = exact_dedup.ExactDedup(Workspace(spark, "test"))
    dedup.feed(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"))
    dedup.feed(spark.createDataFrame([(7, "A"), (5, "c")], "doc_id long, text string"))
    state = {r.digest: (r.keep_id, r.group_size) for r in dedup.state().collect()}
    assert state == {hashlib.sha256(t.encode()).hexdigest(): x for t, x in {"a": (7, 2), "b": (2, 1), "c": (5, 1)}.items()}


def test_exact_dedup_is_taken_up_again(spark, tmp_path):
    """Another process goes on with the folder: the state grows, locators lead to files, and a feed counts once."""
    from crawlloom.llm.common import Workspace

    tables = []
    for k, rows in enumerate([[(1, "a"), (2, "b"), (4, "A")], [(7, "A"), (5, "c")], [(3, "B"), (6, "c"), (9, "d")]]):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / f"t{k}"))
        tables.append(spark.read.parquet(str(tmp_path / f"t{k}")))
    for k, t in enumerate(tables):
        dedup = exact_dedup.ExactDedup(Workspace(spark, "exact", f"file://{tmp_path}/state"), known=tables[:k])
        dedup.feed(t, f"t{k}")
    again = exact_dedup.ExactDedup(Workspace(spark, "exact", f"file://{tmp_path}/state"), known=tables)
    again.feed(tables[2], "t2")
    rows = {(r.id, r.keep_id, r.group_size) for r in again.groups().collect()}
    assert rows == {(1, 7, 3), (4, 7, 3), (7, 7, 3), (2, 3, 2), (3, 3, 2), (5, 6, 2), (6, 6, 2), (9, 9, 1)}
    held = again.state().join(again.files(), "place").collect()
    assert {r.keep_id: r.file.split("/")[-2] for r in held} == {7: "t1", 3: "t2", 6: "t2", 9: "t2"}


def test_exact_dedup_checks_bytes_against_earlier_feeds(spark, tmp_path, monkeypatch):
    from crawlloom.llm.common import Workspace

    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.substring(c, 1, 1))
    tables = []
    for k, rows in enumerate([[(1, "ax"), (2, "by")], [(7, "ay"), (5, "BY")], [(9, "az"), (8, "c")]]):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / f"t{k}"))
        tables.append(spark.read.parquet(str(tmp_path / f"t{k}")))
    for k in range(3):
        dedup = exact_dedup.ExactDedup(Workspace(spark, "exact", f"file://{tmp_path}/state"), known=tables[:k])
        dedup.feed(tables[k], f"t{k}")
    assert {(r.id, r.keep_id, r.group_size) for r in dedup.groups().collect()} == {(1, 1, 1), (7, 7, 1), (9, 9, 1), (2, 5, 2), (5, 5, 2), (8, 8, 1)}


def test_exact_dedup_parts_texts_that_share_a_digest(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.lit("same"))
    got = exact_dedup.exact_dedup(spark.createDataFrame([(1, "a"), (2, "b"), (3, "A"), (4, "b"), (5, "c")], "doc_id long, text string")).collect()
    assert {x.doc_id: (x.keep_id, x.group_size, x.kept) for x in got} == {1: (3, 2, False), 3: (3, 2, True), 2: (4, 2, False), 4: (4, 2, True), 5: (5, 1, True)}
