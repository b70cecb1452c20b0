"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked by a self-join of the binary trie over them.

The join walks pairs of trie nodes at once, adds up the bits in which their paths differ, and drops a pair as soon as
it has more than the allowed number. The top of the trie is cut, from a histogram over the first 16 bits, into nodes of
a bounded number of fingerprints; the driver walks pairs of those nodes, and each pair that survives is one row for the
executors, the fingerprints of both nodes, which go on with the same walk, level by level on arrays. From a pair of
nodes only a spanning forest of the links comes back (equal classes, fewer rows), and what already lies in one class is
passed over, so a cluster of n texts costs n rows and far fewer steps than n squared. The classes are the connected
components of these forests.

near_duplicates() links fingerprints by their differing bits alone. near_copies() asks for a similarity of 0.8 of the
sets of shingles, at which about 10 of 64 bits differ: too many for the trie to prune by. There the join proposes pairs,
whole sets decide, and a prefix filter (jaccard.py) finds the links that the bits don't show.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .common import Workspace, components
from .jaccard import _LOWER, _WORDS

#: Distinct fingerprints that a node at the cut should hold at most.
NODE_KEYS = 4096
#: Nodes at the cut, about; beyond NODE_KEYS times this many fingerprints the nodes grow, so that the driver's list of pairs doesn't.
MOST_NODES = 4096
#: Bits of the histogram that the cut is made from; 2**16 counts come to the driver at most.
CUT_BITS = 16
#: Node pairs whose fingerprints are compared one by one rather than going deeper.
LEAF_PAIRS = 24
#: Pairs of nodes that are walked at once.
FRONT = 1 << 18


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the 64-bit hashes have."""
    total, size = np.zeros(64, np.int64), 1 << 14
    for at in range(0, len(hashes), size):
        h = hashes[at : at + size].astype(">u8")
        total += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """A-Z are lower-cased; shingles of words, repeats included; a bit is set if over half of the hashes have it."""
    import xxhash

    words = (text or "").encode().translate(_LOWER)
    words = _WORDS.findall(words)
    n = len(words)
    if not n:
        return 0
    body = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if n > shingle:
        starts, ends = starts[: n - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    f = xxhash.xxh64_intdigest
    return majority(np.fromiter((f(body[i:j], seed) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts)))


def fingerprints(docs: DataFrame, shingle: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long. A null or empty text has fingerprint zero."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def cut(counts: dict[int, int], most: int, bits: int = CUT_BITS) -> list[tuple[int, int]]:
    """Nodes (depth, path) that part the trie so that each holds `most` fingerprints at most, or is at depth `bits`."""
    level = [counts]
    for _ in range(bits):
        up: dict[int, int] = {}
        for k, n in level[-1].items():
            up[k >> 1] = up.get(k >> 1, 0) + n
        level.append(up)
    out, todo = [], [(0, 0)]
    while todo:
        depth, path = todo.pop()
        n = level[bits - depth].get(path, 0)
        if n and (n <= most or depth == bits):
            out.append((depth, path))
        elif n:
            todo += [(depth + 1, path * 2 + 1), (depth + 1, path * 2)]
    return out


def node_pairs(nodes: list[tuple[int, int]], budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of nodes (each with itself, too) whose paths differ in `budget` bits at most, as far as both go."""
    depth = np.array([d for d, _ in nodes], np.int64)
    path = np.array([p << (CUT_BITS - d) for d, p in nodes], np.uint64)
    near = [np.zeros(0, np.int64)]
    for i in range(len(nodes)):
        common = np.uint64(CUT_BITS) - np.minimum(depth[i], depth[i:]).astype(np.uint64)
        near.append(i + np.flatnonzero(np.bitwise_count((path[i] ^ path[i:]) >> common) <= budget))
    return np.repeat(np.arange(len(nodes)), np.array([len(x) for x in near[1:]], np.int64)), np.concatenate(near)


def forest(a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Join the links a-b into the classes of root, each node's least member so far; gives the new root."""
    root = root.copy()
    while True:
        ra, rb = root[a], root[b]
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        live = lo < hi
        if not live.any():
            return root
        a, b = a[live], b[live]
        np.minimum.at(root, hi[live], lo[live])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _uniform_to(root: np.ndarray) -> np.ndarray:
    """For each place, the first place after it whose class is another."""
    turn = np.append(np.flatnonzero(root[1:] != root[:-1]) + 1, len(root))
    return turn[np.searchsorted(turn, np.arange(len(root)), "right")]


def links(left: np.ndarray, right: np.ndarray, budget: int, same: bool, classes: Callable[[], tuple[np.ndarray, np.ndarray]] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with left[i] and right[j] at `budget` or fewer differing bits; both sorted and distinct.
    same: right is left, and only i < j are given. Walks the trie in blocks, so the memory is bounded.

    classes: gives the classes of left and right as they are now; node pairs that lie in one class are then passed over,
    as their links would join nothing new."""
    todo = [(0, tuple(np.array([x], np.int64) for x in (0, len(left), 0, len(right), 0)))]
    while todo:
        depth, (al, ah, bl, bh, far) = todo.pop()
        if len(al) > FRONT:
            k = len(al) // 2
            todo += [(depth, tuple(x[k:] for x in (al, ah, bl, bh, far))), (depth, tuple(x[:k] for x in (al, ah, bl, bh, far)))]
            continue
        if classes is not None and len(al):
            of_left, of_right = classes()
            live = (of_left[al] != of_right[bl]) | (_uniform_to(of_left)[al] < ah) | (_uniform_to(of_right)[bl] < bh)
            al, ah, bl, bh, far = (x[live] for x in (al, ah, bl, bh, far))
        small = (ah - al) * (bh - bl) <= LEAF_PAIRS if depth < 64 else np.ones(len(al), bool)
        if small.any():
            na, nb = (ah - al)[small], (bh - bl)[small]
            size = na * nb
            ends = np.cumsum(size)
            k = np.arange(ends[-1]) - np.repeat(ends - size, size)
            width = np.repeat(nb, size)
            i, j = np.repeat(al[small], size) + k // width, np.repeat(bl[small], size) + k % width
            ok = np.bitwise_count(left[i] ^ right[j]) <= budget
            if same:
                ok &= i < j
            if ok.any():
                yield i[ok], j[ok]
            big = ~small
            al, ah, bl, bh, far = (x[big] for x in (al, ah, bl, bh, far))
        if not len(al):
            continue
        bit = np.uint64(1) << np.uint64(63 - depth)
        am, bm = (_middle(keys, lo, hi, bit) for keys, lo, hi in ((left, al, ah), (right, bl, bh)))
        own = (al == bl) & (ah == bh) & same
        parts = [(al, am, bl, bm, far), (am, ah, bm, bh, far), (al, am, bm, bh, far + 1)]
        other = (am, ah, bl, bm, far + 1)
        parts.append(tuple(x[~own] for x in other))  # of a node with itself, one order is enough
        kept = []
        for p in parts:
            live = (p[0] < p[1]) & (p[2] < p[3]) & (p[4] <= budget)
            kept.append(tuple(x[live] for x in p))
        todo.append((depth + 1, tuple(np.concatenate(x) for x in zip(*kept, strict=True))))


def _middle(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """Where in each sorted range the keys that have the bit begin; above it all keys of a range agree."""
    below = np.uint64(int(bit) * 2 - 1)
    first = (keys[lo] & ~below) | bit
    return np.clip(np.searchsorted(keys, first), lo, hi)


def linked(fps: DataFrame, ws: Workspace, budget: int = 4) -> DataFrame:
    """Forest edges (a, b) between distinct fingerprints (column fp) that differ in `budget` bits or fewer."""
    spark = fps.sparkSession
    top = F.shiftrightunsigned("fp", 64 - CUT_BITS).cast("int")
    counts = {r["top"]: r["n"] for r in fps.groupBy(top.alias("top")).agg(F.count(F.lit(1)).alias("n")).collect()}  # 2**16 rows at most
    most = max(NODE_KEYS, sum(counts.values()) // MOST_NODES)
    nodes = cut(counts, most)
    spans = sorted((p << (CUT_BITS - d), d, p) for d, p in nodes)
    starts, sizes = np.array([x[0] for x in spans]), [0] * len(spans)
    node_of = {path: int(np.searchsorted(starts, path, "right")) - 1 for path in counts}
    for path, node in node_of.items():
        sizes[node] += counts[path]
    parts = [-(-n // most) for n in sizes]  # a node at the cut's last level may hold more than one block
    first = (np.cumsum(parts) - parts).tolist()
    left, right = node_pairs([x[1:] for x in spans], budget)
    where = spark.createDataFrame([(path, n, first[n], parts[n]) for path, n in node_of.items()] or [(0, 0, 0, 1)], "top int, node long, first long, parts long")  # 2**16 rows at most
    pairs = spark.createDataFrame(pd.DataFrame({"i": left, "j": right}), "i long, j long")
    own = where.select("node", F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda k: F.col("first") + k).alias("blocks")).distinct()
    pairs = pairs.join(F.broadcast(own.withColumnsRenamed({"node": "i", "blocks": "l"})), "i").join(F.broadcast(own.withColumnsRenamed({"node": "j", "blocks": "r"})), "j")
    pairs = pairs.select("i", "j", F.explode("l").alias("left"), "r").select("i", "j", "left", F.explode("r").alias("right")).where("i <> j or left <= right").select("left", "right")
    block = (F.col("first") + F.pmod(F.xxhash64("fp"), F.col("parts"))).alias("block")
    blocks = fps.withColumn("top", top).join(F.broadcast(where), "top").select(block, "fp").groupBy("block").agg(F.collect_list("fp").alias("keys"))
    blocks = ws.save(blocks, "blocks")  # `most` fingerprints or so in each
    dealt = pairs.join(blocks.select(F.col("block").alias("left"), F.col("keys").alias("left_keys")), "left")
    dealt = dealt.join(blocks.select(F.col("block").alias("right"), F.col("keys").alias("right_keys")), "right")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                same = batch.column("left")[k].as_py() == batch.column("right")[k].as_py()
                left, right = (np.sort(batch.column(c)[k].values.to_numpy().view(np.uint64)) for c in ("left_keys", "right_keys"))
                every, shift = (left, 0) if same else (np.concatenate([left, right]), len(left))
                root = np.arange(len(every))
                for side, at in ((left, 0), (right, shift)):  # neighbours in order are mostly near: large clusters are one class early
                    i = np.flatnonzero(np.bitwise_count(side[1:] ^ side[:-1]) <= budget) + at
                    root = forest(i, i + 1, root)
                for i, j in links(left, right, budget, same, lambda: (root[: len(left)], root[shift:])):
                    root = forest(i, j + shift, root)
                held = np.flatnonzero(root != np.arange(len(every)))
                yield pa.RecordBatch.from_arrays([pa.array(every[root[held]].view(np.int64)), pa.array(every[held].view(np.int64))], names=["a", "b"])

    return dealt.select("left", "right", "left_keys", "right_keys").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 4, budget: int = 4, name: str = "simhash", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id, the least doc_id of its class.

    Texts whose fingerprints differ in `budget` bits or fewer are linked; a class is all that links reach. Texts without
    words (null, empty, white space) have fingerprint zero and are linked like any others; texts shorter than a shingle
    count whole. Repeated rows each get a row; a null identifier never names a class unless all of the class is null.
    """
    ws = Workspace(docs.sparkSession, name)
    own = ws.save(fingerprints(docs, shingle, id_column, text_column), "fingerprints")
    fps = ws.save(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    edges = ws.save(linked(fps.select("fp"), ws, budget), "links")
    ws.release()
    comps = components(ws, edges).withColumnRenamed("node", "fp")
    part = ws.save(fps.join(comps, "fp", "left").select("fp", "least", F.coalesce("comp", "fp").alias("comp")), "parts")
    best = ws.save(part.groupBy("comp").agg(F.min("least").alias("component_id")), "best")  # a table on either side of the join, so that Spark can split a large class
    classes = ws.save(part.join(best, "comp").select("fp", "component_id"), "classes")
    return own.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_copies(docs: DataFrame, shingle: int = 5, budget: int = 4, name: str = "near-copies", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, text_key (xxhash64 of its text), component_id, kept.

    Texts are linked if their sets of shingles have a Jaccard similarity of 0.8 or more; a class is all that links reach.
    Of each class the row with the least (doc_id, text_key) is kept and names it by its doc_id; rows that repeat both
    are all marked. Texts without words (null, empty, white space) are alike. Exact but for a collision of 62-bit
    hashes. A null identifier never names a class unless all of the class is null. An empty table gives no rows; other
    columns are ignored.

    Candidates come in two rounds, so that a large group of copies costs no square of its size: first those of the trie
    join (fingerprints at `budget` bits or fewer) and each text of a prefix shingle with one of them; then, when those
    links have made classes, the pairs that share a prefix shingle and lie in different classes.
    """
    ws = Workspace(docs.sparkSession, name)
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    own = ws.save(jaccard.prefixes(docs, shingle, majority, ws), "prefixes")
    posts = own.where("prefix is not null").select(F.posexplode("prefix").alias("pos", "tok"), "node", "n").select("tok", "node", "n", (F.col("n") - F.col("pos")).alias("rest"))
    posts = ws.save(jaccard.shared_by_two(posts), "posts")
    ws.release()
    nodes = ws.save(own.groupBy("node").agg(jaccard.least_row().alias("least"), F.min("n").alias("n"), F.min("last").alias("last"), F.min("fp").alias("fp"), F.min("odd").alias("odd")), "nodes")
    fps = ws.save(nodes.groupBy("fp").agg(F.min("node").alias("first")), "distinct")
    alike = (F.least("n", "pivot_n") * 5 >= F.greatest("n", "pivot_n") * 4) & (F.col("node") != F.col("pivot"))
    one = posts.where(alike).select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    one = one.union(nodes.join(fps, "fp").where("node <> first").select("first", "node"))
    near = ws.save(linked(fps.select("fp"), ws, budget), "links-0").select(F.col("a").alias("fa"), F.col("b").alias("fb"))
    near = near.join(fps.select(F.col("fp").alias("fa"), F.col("first").alias("a")), "fa").join(fps.select(F.col("fp").alias("fb"), F.col("first").alias("b")), "fb")
    one = one.union(near.select("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    one = ws.save(jaccard.by_prefixes(ws.save(one, "pairs-1"), own, ws, "1"), "likely-1")
    links_1 = ws.save(jaccard.similar(one, nodes, docs, shingle, ws, "1"), "links-1")
    ws.drop("blocks", "pairs-1", "1-nodes", "1-prefixes", "1-ids", "1-sets")
    classes = components(ws, links_1, "cc-1")
    classes = ws.save(nodes.join(classes, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), "odd"), "classes-1")
    posts = posts.select("tok", "node", "n", "rest").join(classes, "node").select("tok", "node", "n", "rest", "comp", "odd")
    two = ws.save(ws.save(jaccard.between_classes(posts), "pairs-2").join(one, ["a", "b"], "left_anti"), "new-2")
    two = ws.save(jaccard.by_prefixes(two, own, ws, "2"), "likely-2")
    ws.drop("posts", "pairs-2", "new-2", "classes-1", "2-nodes", "2-prefixes")
    links = ws.save(links_1.union(jaccard.similar(two, nodes, docs, shingle, ws, "2")), "links-2")
    ws.drop("2-ids", "2-sets")
    ws.release()
    part = ws.save(nodes.join(components(ws, links, "cc-2"), "node", "left").select("node", "least", F.coalesce("comp", "node").alias("comp")), "parts")
    best = ws.save(part.groupBy("comp").agg(F.min("least").alias("best")), "best")
    classes = ws.save(part.join(best, "comp").select("node", "best"), "classes")
    kept = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key"))
    return own.select("doc_id", "text_key", "node").join(classes, "node").select("doc_id", "text_key", F.col("best.doc_id").alias("component_id"), kept.alias("kept"))
