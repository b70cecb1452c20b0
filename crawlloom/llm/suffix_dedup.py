"""Removal of byte strings that occur more than once, by prefix doubling over sparse positions.

Prefix doubling names the substrings of length L at all positions, then those of length 2L by pairs of names (at p and
at p + L), and lets go of positions whose name is unique, until the threshold is passed. Here

* the names are 64-bit mixes of pairs, made where the text is, for lengths 8, 16, 32, 64, 128 and 200: a pair of names
  needs no join, and equal strings have equal names wherever they are. Ranks by a global sort would serve the same end
  (telling equal from unequal), but cost a shuffle of every byte position for every doubling. Names only ever tell that
  strings differ; that they are equal is told by a cryptographic digest (BLAKE2b, 128 bits) of their bytes;
* the first shuffled round, at length 64, is held only at anchors: of each window of 200 bytes, the 64 bytes whose name
  is least (leftmost of equal ones). Equal windows have equal anchors at equal places, so a window whose anchor's name
  is unique in the corpus is unique too. Windows that follow each other and share an anchor are one row (a run), about
  one for 70 bytes, and go on together;
* the second round names whole runs: a run whose bytes occur again in full is repeated, all of it. Runs that share their
  anchor but not all their bytes are cut, at fixed distances from the anchor, into blocks of GRID windows;
* the third round names the bytes that all windows of a block share (unique: none of them is repeated) and those that
  any of them covers (again in full: all of them are). Only blocks between the two go on;
* the last round, at length 200, names each window of these.

Beside the runs and blocks that go on, one representative of each repeated one goes on with them, as what they may be
equal to.

Rows leave as soon as their name is unique or they are past the threshold. Counts are summed up before they are dealt,
and rows get their counts by joins that Spark can split, so a passage that a third of the documents hold makes no task
larger.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, ranges, text_buffer
from .encode import _VALUES as BYTE_VALUES
from .encode import Powers

ANCHOR = 64
#: Windows of a block in the third round.
GRID = 16
#: Bytes that are named at once; a longer text is cut into blocks that overlap by a window less a byte.
BLOCK = 1 << 20
#: Rows of a round: n windows from the byte a of a text, d their anchor's distance; m the name by which they are told
#: unique, c and e the halves of the digest of all their bytes; w is 2 for one that is known to be repeated.
ROWS = "doc_id long, tkey long, a long, n int, d int, m long, c long, e long, w int"
_PLACE = np.uint64(BLOCK - 1)
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_powers = Powers()


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A name for each pair of names."""
    x = a * _C1
    x += (b ^ (b >> np.uint64(31))) * _C2
    x ^= x >> np.uint64(29)
    x *= _C3
    x ^= x >> np.uint64(32)
    return x


def names(buf: np.ndarray, length: int) -> np.ndarray:
    """The name of the `length` bytes at each position where so many are left; length is 64 at least."""
    if len(buf) < length:
        return np.zeros(0, np.uint64)
    x = buf.astype(np.uint64)
    for size in (1, 2, 4):  # eight bytes are their own name
        x = x[:-size] | (x[size:] << np.uint64(8 * size))
    size = 8
    while size * 2 <= length:
        x, size = _pair(x[:-size], x[size:]), size * 2
    return _pair(x[: len(buf) - length + 1], x[length - size :][: len(buf) - length + 1]) if size < length else x


def blocks(offs: np.ndarray, window: int) -> Iterator[tuple[int, int, int, int]]:
    """(first text, end text, from byte, to byte): neighbouring texts of BLOCK bytes together, or a part of a long one."""
    k, n = 0, len(offs) - 1
    while k < n:
        if offs[k + 1] - offs[k] > BLOCK:
            at = int(offs[k])
            while at + window <= offs[k + 1]:
                yield k, k + 1, at, min(int(offs[k + 1]), at + BLOCK)
                at += BLOCK - window + 1
            k += 1
        else:
            j = max(k + 1, int(np.searchsorted(offs, offs[k] + BLOCK, "right")) - 1)
            yield k, j, int(offs[k]), int(offs[j])
            k = j


def sums(buf: np.ndarray) -> np.ndarray:
    up, _ = _powers.to(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[buf] * up[: len(buf)], out=out[1:])
    return out


def strong(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Cryptographic digests of the bytes start … end - 1, two integers each: equal ones mean equal bytes."""
    view, f = memoryview(np.ascontiguousarray(buf)), hashlib.blake2b
    found = b"".join([f(view[i:j], digest_size=16).digest() for i, j in zip(start.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(found, "<i8").reshape(-1, 2)


def digest(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A name of the bytes start … end - 1, from the sums of the whole: a polynomial, which tells strings apart in the main."""
    _, down = _powers.to(len(s))
    x = (s[end] - s[start]) * down[start] + (end - start).astype(np.uint64) * _C2
    x ^= x >> np.uint64(29)
    return x * _C1


def runs(buf: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that share an anchor, in a block of texts that begin at `starts`.

    Gives (text, first window, number of windows, how far on the anchor is, its name, digests of all bytes), by run.
    """
    n = len(buf)
    name = names(buf, ANCHOR)
    width = window - ANCHOR + 1
    if n < window:
        return *(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)
    least = (name & ~_PLACE) | np.arange(len(name), dtype=np.uint64)  # the place decides between equal names
    size = 1
    while size * 2 <= width:
        least, size = np.minimum(least[:-size], least[size:]), size * 2
    if size < width:
        least = np.minimum(least[: n - window + 1], least[width - size :][: n - window + 1])
    anchor = (least & _PLACE).astype(np.int64)
    ends = np.append(starts[1:], n)
    valid = np.zeros(n - window + 2, np.int8)
    long = ends - starts >= window
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - window + 1, -1)
    ok = np.cumsum(valid[:-1]) > 0
    new = ok.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~ok[:-1]
    new[starts[long]] = True
    first = np.flatnonzero(new)
    stop = np.flatnonzero(ok & np.append(new[1:] | ~ok[1:], True)) + 1
    text = np.searchsorted(starts, first, "right") - 1
    return text, first, stop - first, anchor[first] - first, name[anchor[first]], strong(buf, first, stop + window - 1)


def all_runs(docs: DataFrame, window: int) -> DataFrame:
    """ROWS for each run; tkey tells texts with one identifier apart."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = text_buffer(b.column("text"))
            for i, j, at, to in blocks(offs, window):
                starts = np.unique(np.clip(offs[i:j] - at, 0, None))
                which = i + np.searchsorted(np.clip(offs[i:j] - at, 0, None), starts, "right") - 1
                text, first, n, d, m, c = runs(buf[at:to], starts, window)
                row = which[text]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(row)), b.column("tkey").take(pa.array(row)), pa.array(first + at - offs[row]), pa.array(n.astype(np.int32)), pa.array(d.astype(np.int32)), pa.array(m.view(np.int64)), pa.array(c[:, 0]), pa.array(c[:, 1]), pa.array(np.ones(len(n), np.int32))],
                    names=["doc_id", "tkey", "a", "n", "d", "m", "c", "e", "w"],
                )

    return docs.mapInArrow(run, ROWS)


def grid(s: np.ndarray, part: np.ndarray, a: np.ndarray, n: np.ndarray, d: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Blocks of runs (a, n, d): which run, first window, number of windows, distance, name and digests."""
    low = d - n + 1  # the anchor's least place in a window
    size = d // GRID - low // GRID + 1
    run = np.repeat(np.arange(len(a)), size)
    k = ranges(low // GRID, size)
    p, hi, lo = (a + d)[run], np.minimum(d[run], k * GRID + GRID - 1), np.maximum(low[run], k * GRID)
    core = digest(s, p - k * GRID, p - k * GRID - GRID + 1 + window) ^ (k.astype(np.uint64) * _C3)
    return run, p - hi, hi - lo + 1, hi, core, strong(part, p - hi, p - lo + window)


def single(s: np.ndarray, part: np.ndarray, a: np.ndarray, n: np.ndarray, d: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """The windows of blocks, as grid() gives blocks of runs."""
    run = np.repeat(np.arange(len(a)), n)
    at = ranges(a, n)
    return run, at, np.ones(len(at), np.int64), np.zeros(len(at), np.int64), names(part, window)[at], strong(part, at, at + window)


def finer(texts: DataFrame, window: int, cut) -> DataFrame:
    """ROWS of the next round, from texts and the rows of the last one that go on (`checks`, by text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = text_buffer(b.column("text"))
            lists = b.column("checks")
            flat = lists.flatten()
            a, n, d, w = (flat.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("a", "n", "d", "w"))
            row = np.repeat(np.arange(b.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            begin = a + offs[row]  # place of each row's first window in buf
            order = np.argsort(begin, kind="stable")
            begin, n, d, w, row = begin[order], n[order], d[order], w[order], row[order]
            lo = 0
            while lo < len(begin):  # those that lie near each other
                hi = max(lo + 1, int(np.searchsorted(begin, begin[lo] + BLOCK)))
                at, to = int(begin[lo]), int((begin[lo:hi] + n[lo:hi]).max()) + window - 1
                part = buf[at:to]
                which, first, count, far, m, c = cut(sums(part), part, begin[lo:hi] - at, n[lo:hi], d[lo:hi], window)
                own = row[lo:hi][which]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").take(pa.array(own)), b.column("tkey").take(pa.array(own)), pa.array(first + at - offs[own]), pa.array(count.astype(np.int32)), pa.array(far.astype(np.int32)),
                        pa.array(m.view(np.int64)), pa.array(c[:, 0]), pa.array(c[:, 1]), pa.array(w[lo:hi][which].astype(np.int32)),
                    ],
                    names=["doc_id", "tkey", "a", "n", "d", "m", "c", "e", "w"],
                )
                lo = hi

    return texts.select("doc_id", "tkey", "text", "checks").mapInArrow(run, ROWS)


def decide(ws: Workspace, rows: DataFrame, name: str, last: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(full, checks) of a round's ROWS: those that are repeated in full, and those that go on to the next round.

    Rows whose m is unique go nowhere. Every join has a plain table on either side, so that Spark can split hot names.
    """
    every = ws.save(rows, f"{name}-rows")
    ws.release()
    if not last:
        again = ws.save(every.groupBy("m").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("m"), f"{name}-again")
        ws.release()
        shared = ws.save(every.join(again, "m"), f"{name}-shared")
        ws.drop(f"{name}-rows", f"{name}-again")
        ws.release()
    else:
        shared = every
    key = ["m", "c", "e", "n"]
    if last:
        twice = ws.save(shared.groupBy(*key).agg(F.sum("w").alias("rows")).where("rows > 1").select(*key), f"{name}-twice")
        ws.release()
    else:
        groups = ws.save(shared.groupBy(*key).agg(F.sum("w").alias("rows"), F.min(F.struct("doc_id", "tkey", "a", "d")).alias("one")), f"{name}-groups")
        ws.release()
        twice = groups.where("rows > 1").select(*key)
    full = ws.save(shared.where("w = 1").join(twice, key).select("doc_id", "tkey", "a", "n"), f"{name}-full")
    checks = None
    if not last:
        mixed = ws.save(groups.groupBy("m").agg(F.count(F.lit(1)).alias("kinds"), F.min("rows").alias("least")).where("kinds > 1 and least = 1").select("m"), f"{name}-mixed")
        checks = ws.save(groups.join(mixed, "m").select("one.*", "n", F.when(F.col("rows") > 1, 2).otherwise(1).alias("w")), f"{name}-checks")
    ws.drop(*(f"{name}-{x}" for x in ("rows", "shared", "twice", "groups", "mixed")))
    ws.release()
    return full, checks


def remove_repeats(docs: DataFrame, window: int = 200, name: str = "suffix", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, spans (start, length of each maximal removed run), kept (bytes).

    A byte is removed if a string of `window` bytes covers it that also starts anywhere else in the table, be it in
    the same text; the strings may overlap, don't cross texts, and are judged on the input. A null text is empty, and
    texts shorter than the window are kept whole. Two rows with the same identifier and text are two places: such
    texts, where long enough, are removed in both. Rows without an identifier are told apart by their texts. A kept text
    may be cut inside a character, so it is bytes. An empty table gives no rows; other columns are ignored.
    """
    if window < 2 * ANCHOR:
        raise ValueError(f"the window must be {2 * ANCHOR} bytes at least")
    ws = Workspace(docs.sparkSession, name)
    text = F.coalesce(F.col(text_column), F.lit(""))
    own = F.col(id_column).cast("long")
    rows = docs.select(F.coalesce(own, F.lit(0)).alias("doc_id"), F.xxhash64(text, own.isNull()).alias("tkey"), text.alias("text"), own.isNull().alias("none"))
    key = ["doc_id", "tkey"]

    def beside(texts: DataFrame, checks: DataFrame, number: str) -> DataFrame:
        lists = checks.groupBy(*key).agg(F.collect_list(F.struct("a", "n", "d", "w")).alias("checks"))  # of one text
        return texts.join(ws.save(lists, f"{number}-lists"), key)

    full, checks = decide(ws, all_runs(rows, window), "run")
    # A row that goes on is the only one of its kind, or stands for all of them: texts that are repeated as a whole
    # never bring one row twice.
    texts = ws.save(beside(rows, checks, "run"), "texts")
    ws.release()
    blocks_full, checks = decide(ws, finer(texts, window, grid), "block")
    singles_full, _ = decide(ws, finer(beside(texts.drop("checks"), checks, "block"), window, single), "window", last=True)
    ws.drop("texts", "run-lists", "block-lists", "run-checks", "block-checks")
    spans = full.unionByName(blocks_full).unionByName(singles_full).groupBy(*key).agg(F.collect_list(F.struct("a", "n")).alias("found"))
    spans = ws.save(spans, "spans")
    ws.drop("run-full", "block-full", "window-full")
    ws.release()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = text_buffer(b.column("text"))
            kept, spans = [], []
            for k, found in enumerate(b.column("found")):
                own = buf[offs[k] : offs[k + 1]]
                if not found.is_valid:
                    kept.append(own.tobytes())
                    spans.append([])
                    continue
                a, n = (found.values.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("a", "n"))
                edge = np.zeros(len(own) + 1, np.int64)
                np.add.at(edge, a, 1)
                np.add.at(edge, a + n - 1 + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                turns = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                kept.append(own[~gone].tobytes())
                spans.append([{"start": int(x), "length": int(y - x)} for x, y in zip(turns[::2], turns[1::2], strict=True)])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("none"), pa.array(np.diff(offs)), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "none", "n_bytes", "spans", "kept"])

    out = rows.join(spans, key, "left").mapInArrow(cut, "doc_id long, none boolean, n_bytes long, spans array<struct<start: long, length: long>>, kept binary")
    return out.select(F.when(~F.col("none"), F.col("doc_id")).alias("doc_id"), "n_bytes", "spans", "kept")
