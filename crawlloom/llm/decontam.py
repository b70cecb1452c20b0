"""Benchmark decontamination by the q-gram lemma: shared q-grams in diagonal bands, then banded alignment.

A window of W characters of a benchmark item that occurs in a text with at most E edits shares at least
W + 1 - q - q * E of its q-grams with it, and all of these lie in a band of E + 1 neighbouring diagonals (place in the
text less place in the item). Bands of 2 * E diagonals at every E-th diagonal hold each such window in one band whole.
So, text by text: all q-grams are looked up in the index of the items, the hits are counted in the bands, stretches
that reach the bound are retained, and a banded alignment of every window of the item in them settles which match.

Items shorter than q have no q-gram; their whole strings are looked up, where they stand as words of their own.

The items are the stated query set; they are taken in blocks of a bounded number of characters, and each block's index
goes to the executors, which read every text whole, once for each block. Nothing is shuffled, so frequent passages make
no task larger, and the hits of a piece of text are walked item range by item range, so frequent q-grams don't either.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranges, slices

Q = 10
WINDOW = 80
#: One edit is allowed for so many characters of a window.
PER_EDIT = 16
#: Characters of items in one block, whose index takes about 40 bytes for each.
BLOCK_CHARS = 1 << 21
#: Hits (places of a text times places of items) that are counted together.
MOST_HITS = 1 << 21
#: Characters between texts that are looked at together: more than a window may have edits.
GAP = 2 * WINDOW // PER_EDIT + 6
_FILTER_BITS = 22
#: Stands between texts; no text or item has it.
_NONE = 0x7FFFFFFF
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _folding() -> np.ndarray:
    """Lower case and plain spaces for each character of the basic plane, where that is one character."""
    table = np.arange(1 << 16, dtype=np.uint32)
    for c in range(1 << 16):
        if not 0xD800 <= c < 0xE000:
            x = chr(c)
            table[c] = 32 if x.isspace() else ord(low) if len(low := x.lower()) == 1 else c
    return table


_fold: list[np.ndarray] = []


def folded(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(characters, places): lower-cased, white space as single spaces; and where each stood in the text."""
    if not _fold:
        _fold.append(_folding())
    raw = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    low = np.where(raw < 1 << 16, _fold[0][np.minimum(raw, (1 << 16) - 1)], raw)
    space = low == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    place = np.flatnonzero(keep)
    return low[place], place


def qgrams(chars: np.ndarray) -> np.ndarray:
    """A 64-bit key for the Q characters at each place."""
    n = len(chars) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = chars.astype(np.uint64)
    two = x[:-1] * _MIX ^ (x[1:] + (x[:-1] << np.uint64(21)))
    two *= _MIX
    four = (two[:-2] ^ (two[:-2] >> np.uint64(29))) * _MIX + two[2:]
    eight = (four[:-4] ^ (four[:-4] >> np.uint64(31))) * _MIX + four[4:]
    out = (eight[:n] ^ (eight[:n] >> np.uint64(30))) * _MIX + two[8 : 8 + n]
    return (out ^ (out >> np.uint64(32))) * _MIX


def short_keys(chars: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit key for the n characters at each place; n is less than Q."""
    size = max(0, len(chars) - n + 1)
    x, out = chars.astype(np.uint64), np.full(size, n, np.uint64)
    for k in range(n):
        out = (out ^ (out >> np.uint64(29))) * _MIX + x[k : k + size]
    return out


@dataclass
class Index:
    """The q-grams of some items: sorted keys, and for each the items and places that have it; short: for each length
    under Q, sorted keys of the items of that length and their numbers."""

    ids: list[int | None]
    items: list[np.ndarray]
    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    filter: np.ndarray
    sizes: np.ndarray
    rules: np.ndarray
    order: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def of(rows: list[tuple[int | None, str]]) -> Index:
        items = [folded(t)[0] for _, t in rows]
        items = [x if len(x) >= Q else folded(t.strip())[0] for x, (_, t) in zip(items, rows, strict=True)]
        every = [qgrams(x) for x in items]
        key = np.concatenate([*every, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(items)), [len(x) for x in every])
        place = np.concatenate([*[np.arange(len(x)) for x in every], np.zeros(0, np.int64)])
        order = np.argsort(key, kind="stable")
        keys, first = np.unique(key[order], return_index=True)
        held = np.zeros(1 << _FILTER_BITS, bool)
        held[(keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        sizes = np.array([len(x) for x in items], np.int64)
        rules = np.array([window_of(len(x)) for x in items], np.int64).reshape(-1, 3)
        short = {}
        for n in range(1, Q):
            own = np.flatnonzero(sizes == n)
            if len(own):
                named = np.concatenate([short_keys(items[k], n) for k in own])
                short[n] = (np.sort(named), own[np.argsort(named, kind="stable")])
        ranked = np.repeat(np.arange(len(keys)), np.diff(np.append(first, len(key)))) * max(1, len(items)) + item[order]
        return Index([i for i, _ in rows], items, keys, np.append(first, len(key)), item[order].astype(np.int32), place[order].astype(np.int32), held, sizes, rules, ranked, short)


def window_of(n: int) -> tuple[int, int, int]:
    """(window, edits, least shared q-grams) for an item of n characters."""
    w = min(n, WINDOW)
    e = w // PER_EDIT
    while e and w + 1 - Q - Q * e < 1:
        e -= 1
    return w, e, w + 1 - Q - Q * e


def align(item: np.ndarray, chars: np.ndarray, lo: int, hi: int, diagonal: int, w: int, e: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edits of each window item[u:u+w], u from lo to hi - 1, against the text near a band's middle diagonal.

    The alignment may begin and end at any of the band's diagonals. Gives (edits, where it ends in the text, u).
    """
    width = 4 * e + 3
    u = np.arange(lo, hi)
    shift = diagonal - 2 * e - 1 + np.arange(width)
    padded = np.concatenate([chars, np.zeros(1, chars.dtype)])
    cost = np.zeros((len(u), width), np.int32)
    step = np.arange(width, dtype=np.int32)
    for r in range(w):
        at = (u + r)[:, None] + shift[None, :]
        inside = (at >= 0) & (at < len(chars))
        differs = (padded[np.where(inside, at, -1)] != item[u + r][:, None]) | ~inside
        new = cost + differs
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)  # a character of the item is missing
        cost = np.minimum.accumulate(new - step, axis=1) + step  # the text has one more
    best = cost.argmin(axis=1)
    return cost[np.arange(len(u)), best], u + w + shift[best], u


def edits_of(item: np.ndarray, chars: np.ndarray, lo: int, hi: int, diagonals: np.ndarray, w: int, e: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As align(); windows that match along the commonest diagonal, place by place, need no alignment."""
    low = int(diagonals.min())
    main = low + int(np.bincount(diagonals - low).argmax())
    u = np.arange(lo, hi)
    at = np.arange(lo, hi + w - 1)
    inside = (at + main >= 0) & (at + main < len(chars))
    differs = ~inside
    differs[inside] = chars[at[inside] + main] != item[at[inside]]
    sums = np.concatenate([[0], np.cumsum(differs)])
    cost, end = sums[w:] - sums[:-w], u + w + main
    rest = np.flatnonzero(cost > e)
    if len(rest):
        middle = (low + int(diagonals.max())) // 2
        first, last = int(rest[0]), int(rest[-1]) + 1
        c, f, _ = align(item, chars, lo + first, lo + last, middle, w, e)
        better = c < cost[first:last]
        cost[first:last][better], end[first:last][better] = c[better], f[better]
    return cost, end, u


Match = tuple[int, int, int, int, int, int]


def short_matches(index: Index, chars: np.ndarray) -> Iterator[Match]:
    """As matches(), for the items shorter than Q: no edits, and no letter or digit on either side."""
    for n, (keys, items) in index.short.items():
        own = short_keys(chars, n)
        lo, hi = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
        for at in np.flatnonzero(lo < hi):
            sides = [int(chars[x]) for x in (at - 1, at + n) if 0 <= x < len(chars)]
            if any(x != _NONE and chr(x).isalnum() for x in sides):
                continue
            for k in items[lo[at] : hi[at]]:
                if (index.items[k] == chars[at : at + n]).all():
                    yield int(k), int(at), int(at) + n, 0, 0, n


def matches(index: Index, chars: np.ndarray) -> list[Match]:
    """(item number, from, to, least edits, item from, item to) for each place where a window of an item occurs.

    chars may hold several texts with GAP characters between them that no item has. One match may be given in parts.
    """
    found = list(short_matches(index, chars))
    keys = qgrams(chars)
    hit = np.flatnonzero(index.filter[(keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
    if not len(hit) or not len(index.keys):
        return found
    own = keys[hit]
    at = np.searchsorted(index.keys, own)
    at[at == len(index.keys)] = 0
    ok = index.keys[at] == own
    todo = [(hit[ok], at[ok], 0, len(index.items))]
    while todo:
        hit, at, low, high = todo.pop()
        first, last = (np.searchsorted(index.order, at * len(index.items) + x) for x in (low, high))
        n = last - first
        if not n.any():
            continue
        hit, at, first, n = (x[n > 0] for x in (hit, at, first, n))
        reach = 2 * (WINDOW + WINDOW // PER_EDIT)
        if n.sum() > MOST_HITS and high - low > 1:
            middle = (low + high) // 2
            todo += [(hit, at, low, middle), (hit, at, middle, high)]
        elif n.sum() > MOST_HITS and hit[-1] - hit[0] > 2 * reach:  # whatever lies across the middle lies in the left part whole
            middle = (int(hit[0]) + int(hit[-1])) // 2
            left, right = hit <= middle + reach // 2, hit > middle - reach // 2
            todo += [(hit[left], at[left], low, high), (hit[right], at[right], low, high)]
        else:
            found += counted(index, chars, hit, first, n)
    return found


def counted(index: Index, chars: np.ndarray, hit: np.ndarray, first: np.ndarray, n: np.ndarray) -> list[Match]:
    """The matches of hits (places in the text, and n postings from `first` on of each), counted in bands."""
    post = ranges(first, n)
    pos, item, place = np.repeat(hit, n), index.item[post].astype(np.int64), index.place[post].astype(np.int64)
    diag = pos - place + index.sizes[item]  # not negative
    step = np.maximum(index.rules[item, 1], 1)
    band = diag // step
    n_bands = len(chars) + WINDOW + int(index.sizes.max()) + 2
    found: list[tuple[int, int, int, int, int, int]] = []
    done: dict[int, list[tuple[int, int]]] = {}
    # Bands of two steps begin at every step: those that begin at even ones, then those at odd ones.
    for shift in (0, 1):
        group = item * n_bands + (band + shift) // 2
        order = np.argsort(group, kind="stable")  # pos ascends within a group
        g, p = group[order], pos[order]
        w, e, least = index.rules[item[order]].T
        # A stretch: `least` hits of one band within a window's reach.
        far = np.arange(len(g)) + least - 1
        ok = far < len(g)
        far = np.minimum(far, len(g) - 1)
        ok &= (g[far] == g) & (p[far] - p <= w - Q + e)
        start = np.flatnonzero(ok)
        if not len(start):
            continue
        stop = far[start]
        new = np.ones(len(start), bool)
        new[1:] = (g[start[1:]] != g[start[:-1]]) | (start[1:] > np.maximum.accumulate(stop)[:-1])
        heads = np.flatnonzero(new)
        for i, j in zip(heads, np.append(heads[1:], len(start)), strict=True):
            a, b = int(start[i]), int(stop[i:j].max())
            k = int(g[a] // n_bands)
            if any(x <= p[a] and p[b] + Q <= y for x, y in done.get(k, ())):
                continue  # the other bands have found all of it
            wide, edits, _ = (int(x) for x in index.rules[k])
            places = place[order[a : b + 1]]
            lo, hi = max(0, int(places.min()) - wide + Q), min(int(index.sizes[k]) - wide, int(places.max())) + 1
            if lo >= hi:
                continue
            cost, end, u = edits_of(index.items[k], chars, lo, hi, p[a : b + 1] - places, wide, edits)
            good = cost <= edits
            if good.any():
                x, y = max(0, int((end - wide)[good].min())), min(len(chars), int(end[good].max()))
                found.append((k, x, y, int(cost[good].min()), int(u[good].min()), int(u[good].max()) + wide))
                done.setdefault(k, []).append((x, y))
    return found


def blocks_of(benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text") -> Iterator[list[tuple[int | None, str]]]:
    """The items, a block at a time; repeated rows count once."""
    rows, size = [], 0
    items = benchmark.where(F.col(text_column).isNotNull()).select(F.col(id_column).cast("long"), text_column).distinct()
    for item, text in items.toLocalIterator():
        rows.append((item, text))
        size += len(text)
        if size >= BLOCK_CHARS:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


OUT = "doc_id long, item_id long, start long, end long, edits int, item_start int, item_end int, item_chars int, text_key long"


def contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each text and item of which a window occurs in the text; see OUT.

    Compared are lower-cased characters with white space as single spaces. A window has WINDOW characters, or the
    whole item where that is shorter, and matches with one edit for every PER_EDIT of them or fewer; start and end are
    the matching part's places in the text, in characters and to within the edits, from the first window to the last. An item shorter than Q
    characters matches without edits, where no letter or digit stands beside it. Null and empty items match nothing; an
    item without an id has a null item_id. A null text is empty; text_key is the xxhash64 of the text. Each repeated
    row gets its own rows; other columns are ignored. Without texts or items there are no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    out = spark.createDataFrame([], OUT)
    for block in blocks_of(benchmark):
        shared = spark.sparkContext.broadcast(Index.of(block))

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            names = [f.split()[0] for f in OUT.split(", ")]
            kinds = [pa.int64()] * 4 + [pa.int32()] * 4 + [pa.int64()]
            for batch in batches:
                found = []
                for some in slices(batch, "text", 1 << 19):
                    ids, named, parts = some.column("doc_id").to_pylist(), some.column("text_key").to_pylist(), [folded(t) for t in some.column("text").to_pylist()]
                    offs = np.concatenate([[0], np.cumsum([len(p[0]) + GAP for p in parts])])
                    every = np.full(offs[-1], _NONE, np.uint32)
                    for p, a in zip(parts, offs, strict=False):
                        every[a : a + len(p[0])] = p[0]
                    rows: dict[tuple[int, int], list[int]] = {}
                    for k, x, y, edits, a, b in matches(index, every):
                        row = int(np.searchsorted(offs, (x + y) // 2, "right")) - 1
                        x, y = max(0, x - int(offs[row])), min(len(parts[row][0]), y - int(offs[row]))
                        was = rows.get((row, k), [x, y, edits, a, b])
                        rows[row, k] = [min(was[0], x), max(was[1], y), min(was[2], edits), min(was[3], a), max(was[4], b)]
                    for (row, k), (x, y, edits, a, b) in rows.items():
                        place = parts[row][1]
                        found.append((ids[row], index.ids[k], int(place[x]), int(place[y - 1]) + 1, edits, a, b, int(index.sizes[k]), named[row]))
                cols = list(zip(*found, strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

        out = out.unionByName(rows.mapInArrow(run, OUT))
    return out
