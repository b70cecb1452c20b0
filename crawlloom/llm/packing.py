"""Mixture-controlled packing: deficit round-robin over source queues, into full sequences of token ids.

Each source is a queue of documents, ordered by identifier. In every window of WINDOW tokens each queue is served its
share: the credit of queue s after k windows is k * WINDOW * weight_s, the whole tokens of it are sent, and what is left
(less than a token) is carried as the queue's deficit into the next window. The state of the round-robin after any
window is therefore a closed form of k, so the queues need not be walked one after another: a document's tokens know
from their place in the queue in which windows they go and where in the stream, however documents are dealt over
partitions. When a queue runs dry, its share goes to the others in proportion from the next window on; these phases (as many as queues at most)
are worked out on the driver. With no target mixture the weights are the corpus's own proportions, so that all queues
last to the end. The stream is then cut into sequences of SEQUENCE tokens; only the last one is padded.

Documents are dealt by ranges of (queue, identifier): a hot source is split over as many ranges as its size asks for,
and the table of offsets has a row for each range and each queue in it, ranges + queues at most.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from fractions import Fraction
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, slices, text_buffer, tokenizer_path, trimmed
from .encode import encoder, with_end

SEQUENCE = 2048
#: Tokens of a window in which the mixture is held: 64 sequences, and one for each queue where there are more.
WINDOW = 64 * SEQUENCE
#: Sums of tokens, by window and queue, that a task keeps at most.
SUMS = 1 << 23
#: Documents longer than this are kept as several rows of ids.
PIECE_IDS = 1 << 20

OUT = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, queue string, window_id long, ids binary"


class Schedule:
    """Deficit round-robin over queues of given sizes: cumulative tokens sent, in closed form.

    sizes: tokens by queue. weights: positive target shares by queue, by default the sizes. Queues follow each other in
    the order of their names inside a window.
    """

    def __init__(self, sizes: dict[str, int], weights: dict[str, float] | None = None, window: int = WINDOW):
        self.names = sorted(k for k, n in sizes.items() if n > 0)
        self.sizes, self.window = [sizes[k] for k in self.names], window
        share = [Fraction(weights[k]).limit_denominator(10**9) if weights and k in weights else Fraction(0 if weights else sizes[k]) for k in self.names]
        least = min((x for x in share if x > 0), default=Fraction(1))
        share = [x if x > 0 else least / 10**6 for x in share]  # a source without a target trickles, and follows when the others are dry
        scale = lcm(*(x.denominator for x in share))
        self.shares = [int(x * scale) for x in share]
        # A queue's credit is its share times a sum that all queues have in common, up to its size.
        # Phases: first window, that sum before it, what a window adds to it.
        self.phases: list[tuple[int, Fraction, Fraction]] = []
        order = sorted(range(len(self.names)), key=lambda i: Fraction(self.sizes[i], self.shares[i]))  # as they run dry
        k, common, total, at = 0, Fraction(0), sum(self.shares), 0
        while at < len(order):
            rate = Fraction(window, total)
            self.phases.append((k, common, rate))
            lasts = -((common - Fraction(self.sizes[order[at]], self.shares[order[at]])) // rate)  # windows until the first queue is dry
            k, common = k + lasts, common + lasts * rate
            while at < len(order) and common * self.shares[order[at]] >= self.sizes[order[at]]:
                total -= self.shares[order[at]]
                at += 1
        self.n_windows, self.firsts = k, [p[0] for p in self.phases]
        self._sums: dict[int, np.ndarray] = {}

    def _common(self, k: int) -> Fraction:
        first, common, rate = self.phases[bisect_right(self.firsts, max(k, 0)) - 1]
        return common + (k - first) * rate

    def sent(self, queue: int, k: int) -> int:
        """Tokens of a queue in the first k windows."""
        common = self._common(k)
        return min(self.sizes[queue], self.shares[queue] * common.numerator // common.denominator)

    def _before(self, k: int) -> np.ndarray:
        """Tokens in the first k windows of the queues before each one, and of all."""
        if k not in self._sums:
            common = self._common(k)
            sent = np.minimum(np.array(self.shares, object) * common.numerator // common.denominator, np.array(self.sizes, object))
            while self._sums and (len(self._sums) + 1) * len(self.names) > SUMS:
                del self._sums[next(iter(self._sums))]
            self._sums[k] = np.concatenate([[0], np.cumsum(sent.astype(np.int64))])
        return self._sums[k]

    def place(self, queue: int, k: int) -> int:
        """Where in the stream window k's tokens of a queue begin."""
        now, then = self._before(k), self._before(k + 1)
        return int(then[queue] + now[-1] - now[queue])

    def window_of(self, queue: int, token: int) -> int:
        """The window that a token of a queue is in."""
        lo = bisect_right(range(self.n_windows + 1), token, key=lambda k: self.sent(queue, k)) - 1
        return lo


def tokenise(docs: DataFrame, tokenizer: str, end_id: int, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """(doc_id, queue, part, ordinal, start, doc_tokens, first, ids): each document's ids, with its place in its queue
    inside its part; ids are little-endian unsigned 32- or 16-bit integers, by the size of the vocabulary."""
    source = F.coalesce(F.col(source_column).cast("string"), F.lit("")) if source_column in docs.columns else F.lit("")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), source.alias("queue"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("queue", "doc_id").sortWithinPartitions("queue", "doc_id", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = encoder(tokenizer), TaskContext.get().partitionId()
        kind, ordinal, before = np.dtype("<u2" if code.n_vocab <= 1 << 16 else "<u4"), 0, ("", 0)
        for batch in batches:
            for some in slices(batch, "text"):
                ids, offs = with_end(*code.encode(*text_buffer(some.column("text"))), end_id)
                ids, queues, starts, out = ids.astype(kind), some.column("queue").to_pylist(), [], []
                for k, queue in enumerate(queues):
                    at = before[1] if queue == before[0] else 0
                    n = int(offs[k + 1] - offs[k])
                    starts.append(at)
                    before = (queue, at + n)
                    out += [(k, i, ids[offs[k] + i : min(offs[k] + i + PIECE_IDS, offs[k + 1])].tobytes()) for i in range(0, n, PIECE_IDS)]
                row = pa.array([x[0] for x in out])
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("doc_id").take(row), some.column("queue").take(row), pa.array([part] * len(out), pa.int32()), pa.array(ordinal + row.to_numpy(), pa.int64()),
                        pa.array(starts, pa.int64()).take(row), pa.array(np.diff(offs), pa.int64()).take(row), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary()),
                    ],
                    names=["doc_id", "queue", "part", "ordinal", "start", "doc_tokens", "first", "ids"],
                )
                ordinal += len(queues)

    return rows.mapInArrow(trimmed(run), "doc_id long, queue string, part int, ordinal long, start long, doc_tokens long, first long, ids binary")


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, sequence: int = SEQUENCE, window: int | None = None, weights: dict[str, float] | None = None, name: str = "packing", **columns: str) -> DataFrame:
    """One row for each piece of a document; see OUT. ids: the piece's, as little-endian unsigned 32-bit integers.

    A null or empty text is just end_id; a null source is a queue of its own, named ''. Repeated rows are packed as
    often as they come, in the order of their texts. An empty table gives no rows; other columns are ignored.
    sequence_id and offset are gapless. window: by default wide enough that a queue's share of it is a sequence in the
    mean, however many queues there are, so that documents aren't cut into scraps.
    """
    spark, path = docs.sparkSession, tokenizer or tokenizer_path()
    ws = Workspace(spark, name)
    tokens = ws.save(tokenise(docs, path, end_id, **columns), "tokens")
    ws.release()
    wide = encoder(path).n_vocab > 1 << 16
    parts = tokens.where("first = 0").groupBy("part", "queue").agg(F.sum("doc_tokens").alias("n")).orderBy("part").collect()  # ranges + queues rows at most
    base, sizes = {}, {}
    for r in parts:
        base[r["part"], r["queue"]] = sizes.get(r["queue"], 0)
        sizes[r["queue"]] = sizes.get(r["queue"], 0) + r["n"]
    plan = Schedule(sizes, weights, window or max(WINDOW, len(sizes) * sequence))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, kind = {q: i for i, q in enumerate(plan.names)}, np.dtype("<u4" if wide else "<u2")
        now = (None, 0, 0, 0)  # queue, window, its first token, where that is in the stream
        for batch in batches:
            out: list[tuple] = []
            cols = [batch.column(c).to_pylist() for c in ("doc_id", "queue", "part", "start", "doc_tokens", "first", "ids")]
            for doc, queue, part, start, n, first, raw in zip(*cols, strict=True):
                ids, q = np.frombuffer(raw, kind).astype("<u4"), number[queue]
                at, i = base[part, queue] + start + first, 0
                while i < len(ids):
                    if now[0] != q or not plan.sent(q, now[1]) <= at + i < plan.sent(q, now[1] + 1):
                        k = plan.window_of(q, at + i)
                        now = (q, k, plan.sent(q, k), plan.place(q, k))
                    pos = now[3] + at + i - now[2]
                    size = min(len(ids) - i, plan.sent(q, now[1] + 1) - at - i, sequence - pos % sequence)
                    piece = ids[i : i + size]
                    out.append((doc, first + i, size, n, pos // sequence, pos % sequence, queue, now[1], piece.tobytes()))
                    i += size
            kinds = [pa.int64()] * 6 + [pa.string(), pa.int64(), pa.binary()]
            cols = list(zip(*out, strict=True)) or [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "queue", "window_id", "ids"])

    return tokens.mapInArrow(trimmed(run), OUT)
