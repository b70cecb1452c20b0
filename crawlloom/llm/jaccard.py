"""Exact Jaccard similarity of word shingles for near copies: prefixes, exact pruning by them, comparison of whole sets.

Shingles are put in one order for all texts. Two sets of n shingles at similarity 4/5 or more share at least
ceil(4 n / 5) of each one's, so they share one of the first n - ceil(4 n / 5) + 1 of each: the prefix. Texts that share a
prefix shingle are candidates. What two prefixes share bounds what the sets can share, so most candidates are ruled out,
exactly, by the prefixes alone; only the whole sets of the rest are compared. Nothing is left out or estimated. Which
order is taken changes only the cost: common shingles, counted in all texts, come last, as they join many texts.

Pairs of one shingle are told apart before they are made. A pair is taken up at the first shingle that both have, where
either set goes on for as many shingles as both must share; later ones needn't name it again. And a set has a bit for each remainder of its keys that an odd
number of them has. Every shingle that only one of two sets has turns one bit, so sets whose bits differ in more than a
ninth of their sizes' sum can't reach 4/5.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, trimmed

#: A shingle is common if so many texts hold it.
COMMON = 12
#: Common shingles that are broadcast at most.
MOST_COMMON = 1 << 17
#: Words whose hashes a task keeps at most.
MOST_WORDS = 1 << 18
#: Bits of a shingle's key; common shingles have keys above.
KEY_BITS = 62
#: Words of 64 bits for the odd remainders of a set.
ODD = 8

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _WordHashes(dict):
    """word -> 64-bit hash, forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MOST_WORDS:
            self.clear()
        self[word] = own = xxhash.xxh3_64_intdigest(word)
        return own


_hashes = _WordHashes()


def hashes(text: str | None, shingle: int = 5) -> np.ndarray:
    """The shingles' 64-bit hashes, in order and with repeats. A-Z are lower-cased; a shorter text counts whole."""
    words = _WORDS.findall((text or "").encode().translate(_LOWER))
    own = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = len(own) - shingle + 1
    if n < 1:
        own, n, shingle = np.append(own, np.uint64(len(own))), 1, len(own) + 1
    out = own[:n].copy()
    for k in range(1, shingle):
        out ^= out >> np.uint64(32)
        out *= _C1
        out += own[k : k + n]
    out ^= out >> np.uint64(32)
    out *= _C2
    return out ^ (out >> np.uint64(29))


def keys(own: np.ndarray) -> np.ndarray:
    """The distinct shingles as keys, sorted."""
    return np.unique(own >> np.uint64(64 - KEY_BITS)).view(np.int64)


def name_of(own: np.ndarray) -> int:
    """A name for a set: equal sets are one node."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).view(np.int64))


def prefix_size(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def common_shingles(docs: DataFrame, shingle: int, ws: Workspace) -> tuple[np.ndarray, np.ndarray]:
    """(keys, sorted; the place of each in the order) of the shingles that are common in the texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(keys(hashes(t.as_py(), shingle)))], names=["tok"])

    counts = docs.select("text").mapInArrow(trimmed(run), "tok long").groupBy("tok").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    rows = ws.save(counts, "common").orderBy(F.desc("n"), "tok").limit(MOST_COMMON).collect()
    ws.drop("common")
    tok = np.array([r["tok"] for r in reversed(rows)], np.int64)  # the commonest last
    order = np.argsort(tok)
    return tok[order], order


def odd_bits(own: np.ndarray) -> np.ndarray:
    """A bit for each remainder of keys by 64 * ODD, set if an odd number of them has it."""
    counts = np.bincount(own & (64 * ODD - 1), minlength=64 * ODD)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.uint64)


def ordered(own: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Keys with the common ones moved to the end; as numbers they then ascend in the order of all texts."""
    known, place = common
    if not len(known):
        return own
    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
    return np.sort(np.where(known[at] == own, (1 << KEY_BITS) + place[at], own))


def prefixes(docs: DataFrame, shingle: int, fingerprint, ws: Workspace) -> DataFrame:
    """(doc_id, text_key, node, fp, n, last, prefix, odd) of docs (doc_id, text): a row's set by name and size, its
    SimHash, the first of its shingles in the order with the last of these, and its odd_bits. A set that a task meets
    again has no prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, shingle, ws))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            node, fp, size, last, first, odd = [], [], [], [], [], []
            for t in b.column("text"):
                every = hashes(t.as_py(), shingle)
                own = keys(every)
                node.append(name_of(own))
                fp.append(fingerprint(every))
                odd.append(odd_bits(own).tobytes())
                own = ordered(own, shared.value)
                own, n = own[: prefix_size(len(own))], len(own)
                size.append(n)
                last.append(int(own[-1]))
                first.append(None if node[-1] in seen else own)
                seen.add(node[-1])
            offs = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in first])]).astype(np.int32)
            flat = pa.array(np.concatenate([*(x for x in first if x is not None), np.zeros(0, np.int64)]))
            lists = pa.ListArray.from_arrays(pa.array(offs), flat, mask=pa.array([x is None for x in first], pa.bool_()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array(node, pa.int64()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(size, pa.int32()), pa.array(last, pa.int64()), lists, pa.array(odd, pa.binary())],
                names=["doc_id", "text_key", "node", "fp", "n", "last", "prefix", "odd"],
            )

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(trimmed(run), "doc_id long, text_key long, node long, fp long, n int, last long, prefix array<long>, odd binary")


def _words(bits: pa.Array) -> np.ndarray:
    """A row of ODD words for each value."""
    return np.frombuffer(b"".join(bits.to_pylist()), np.uint64).reshape(-1, ODD)


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of sorted batches, tok first, cut where no tok goes on."""
    held: list[np.ndarray] | None = None
    for b in batches:
        cols = [_words(c) if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False) for c in b.columns]
        cols = [np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)] if held else cols
        at = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0
        if at:
            yield [c[:at] for c in cols]
        held = [c[at:] for c in cols]
    if held and len(held[0]):
        yield held


def shared_by_two(posts: DataFrame) -> DataFrame:
    """Of (tok, node, n, rest), the distinct rows whose tok has others; pivot, pivot_n: the least node of the tok."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tok, node, n, rest in _groups(batches):
            new = np.ones(len(tok), bool)
            new[1:] = (tok[1:] != tok[:-1]) | (node[1:] != node[:-1])
            tok, node, n, rest = tok[new], node[new], n[new], rest[new]
            _, first, count = np.unique(tok, return_index=True, return_counts=True)
            head, many = np.repeat(first, count), np.repeat(count, count) > 1
            cols = [tok, node, n, rest, node[head], n[head]]
            yield pa.RecordBatch.from_arrays([pa.array(c[many]) for c in cols], names=["tok", "node", "n", "rest", "pivot", "pivot_n"])

    return posts.repartition("tok").sortWithinPartitions("tok", "node").mapInArrow(run, "tok long, node long, n int, rest int, pivot long, pivot_n int")


def candidates(tok: np.ndarray, node: np.ndarray, n: np.ndarray, rest: np.ndarray, comp: np.ndarray, odd: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of nodes of one tok in different classes whose sizes, places of the tok (rest: shingles from it on) and odd
    bits allow it, once for each tok. Sorted by tok and n."""
    _, first, count = np.unique(tok, return_index=True, return_counts=True)
    mixed = np.repeat(np.minimum.reduceat(comp, first) != np.maximum.reduceat(comp, first), count)
    tok, node, n, rest, comp, odd = (x[mixed] for x in (tok, node, n.astype(np.int64), rest.astype(np.int64), comp, odd))
    live, d = np.arange(len(tok)), 0
    while len(live):
        d += 1
        live = live[live + d < len(tok)]
        live = live[(tok[live + d] == tok[live]) & (5 * n[live] >= 4 * n[live + d])]
        i = live[comp[live] != comp[live + d]]
        i = i[9 * np.minimum(rest[i], rest[i + d]) >= 4 * (n[i] + n[i + d])]
        apart = np.bitwise_count(odd[i] ^ odd[i + d]).sum(axis=1, dtype=np.int64)
        i = i[9 * apart <= n[i] + n[i + d]]
        if len(i):
            yield np.minimum(node[i], node[i + d]), np.maximum(node[i], node[i + d])


def between_classes(posts: DataFrame) -> DataFrame:
    """The distinct (a, b) of (tok, node, n, rest, comp, odd): see candidates."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _groups(batches):
            for a, b in candidates(*cols):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return posts.repartition("tok").sortWithinPartitions("tok", "n").mapInArrow(trimmed(run), "a long, b long").distinct()


def by_prefixes(pairs: DataFrame, own: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """Those of the pairs (a, b) that can reach 4/5, by their prefixes."""
    ids = ws.save(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), f"{name}-nodes")
    known = own.where("prefix is not null").select("node", "n", "prefix").join(ids, "node", "left_semi")
    known = ws.save(known.dropDuplicates(["node"]), f"{name}-prefixes")
    x, y = (known.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("prefix").alias(f"p{k}")) for k in "ab")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for na, nb, pa_, pb in zip(b.column("na").to_pylist(), b.column("nb").to_pylist(), b.column("pa"), b.column("pb"), strict=True):
                u, v = pa_.values.to_numpy(), pb.values.to_numpy()
                end = min(u[-1], v[-1])
                cu, cv = np.searchsorted(u, end, "right"), np.searchsorted(v, end, "right")
                at = np.minimum(np.searchsorted(v, u), len(v) - 1)
                ok.append(bool(9 * (int((v[at] == u).sum()) + min(na - cu, nb - cv)) >= 4 * (na + nb)))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "pa", "pb").mapInArrow(run, "a long, b long")


def similar(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, ws: Workspace, name: str) -> DataFrame:
    """Those of the pairs (a, b) whose sets' similarity is 4/5 or more. nodes: (node, least) with a row of each set."""
    ids = ws.save(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes.select("node", F.col("least.doc_id").alias("id")), "node"), f"{name}-ids")
    texts = docs.join(ids.select("id").distinct(), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column("text"):
                own = keys(hashes(t.as_py(), shingle))
                yield pa.RecordBatch.from_arrays([pa.array([name_of(own)], pa.int64()), pa.array([own.tobytes()], pa.binary())], names=["node", "keys"])

    sets = texts.mapInArrow(trimmed(run), "node long, keys binary").join(ids.select("node"), "node", "left_semi")
    sets = ws.save(sets.dropDuplicates(["node"]), f"{name}-sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("keys").alias("left")), "a").join(sets.select(F.col("node").alias("b"), F.col("keys").alias("right")), "b")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("left"), b.column("right"), strict=True):
                x, y = (np.frombuffer(k.as_buffer(), np.int64) for k in (x, y))
                both = np.sort(np.concatenate([x, y]), kind="stable")
                ok.append(9 * int((both[1:] == both[:-1]).sum()) >= 4 * len(both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "left", "right").mapInArrow(compare, "a long, b long")


def least_row() -> Column:
    """Of rows (doc_id, text_key), the least, null identifiers last."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
