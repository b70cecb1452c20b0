"""Quality classifier: ordinal cumulative-link (proportional odds) regression on graded ratings, over hashed text.

P(grade > k) = sigmoid(w . x - threshold_k), with one weight vector for all grades and ordered thresholds. x is a set of
hashed features of the whole text: its words, and classes of its style (shares of capitals, of repeated words, of
punctuation, and so on). The model gives an expected grade and tail probabilities, and rows are selected by the latter.
Fitting takes a bounded sample of the rated rows, chosen by a hash of identifier and text; scoring covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, text_buffer, trimmed
from .encode import _VALUES as BYTE_VALUES
from .encode import Powers

#: Hash buckets of the features.
BITS = 20
#: Rated rows that the model is fitted on, at most about (a binomial sample of that mean).
SAMPLE_ROWS = 16_000
#: A bucket counts if one in so many rows of the sample has it, and LEAST_ROWS rows do.
ROWS_PER_BUCKET, LEAST_ROWS = 500, 5
#: Bytes of text that are looked at together.
BLOCK = 1 << 19

_powers = Powers()
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CLASS = np.zeros(256, np.uint8)  # 0 space, 1 punctuation, 2 letter, 3 digit; bytes above 127 count as letters
_CLASS[:] = 1
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 2
_CLASS[48:58] = 3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, offsets): the distinct feature buckets of each text, in ascending order."""
    n_texts, n = len(offs) - 1, len(buf)
    parts = []
    texts = np.arange(n_texts)
    if n:
        cls = _CLASS[buf]
        word = cls >= 2
        edge = np.flatnonzero(np.diff(word.astype(np.int8), prepend=0, append=0))
        s, e = edge[::2], edge[1::2]
        # A word ends with its text, too.
        inside = np.searchsorted(s, offs[1:-1], "left") - 1
        cuts = np.unique(offs[1:-1][(inside >= 0) & (offs[1:-1] < e[np.maximum(inside, 0)])]) if len(s) else offs[:0]
        s, e = np.sort(np.concatenate([s, cuts])), np.sort(np.concatenate([e, cuts]))
        up, down = _powers.to(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUES[_LOWER[buf]] * up[:n], out=total[1:])
        h = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _MIX
        h ^= h >> np.uint64(31)
        h *= _MIX
        text = np.searchsorted(offs, s, "right") - 1
        parts.append((text << BITS) | (h >> np.uint64(64 - BITS)).astype(np.int64))
        # Style: shares and means, in classes that are features like words.
        words = np.bincount(text, minlength=n_texts)
        ups = np.concatenate([[0], np.cumsum(_UPPER[buf])])
        caps = (ups[e] - ups[s] == e - s) & (e - s > 1)
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
        size = np.maximum(np.diff(offs), 1)
        count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offs])
        most = np.maximum(words, 1)
        distinct = np.bincount(np.unique(parts[0]) >> BITS, minlength=n_texts)
        style = [
            np.bincount(text, caps, n_texts) / most, np.bincount(text, again, n_texts) / most, distinct / np.sqrt(most), count(cls == 1) / size * 2, count(cls == 3) / size * 2,
            count(buf == 124) / most, count(buf == 33) / most, count(buf == 10) / most, np.bincount(text, e - s, n_texts) / most / 16, np.log1p(words) / 12, count(buf == 46) / most,
        ]
    else:
        style = [np.zeros(n_texts)] * 11
    for k, share in enumerate(style):
        step = np.minimum((np.sqrt(np.clip(share, 0, 4)) * 16).astype(np.int64), 40)
        code = (np.uint64(1 + k * 64) + step.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
        parts.append((texts << BITS) | ((code ^ (code >> np.uint64(29))) * _MIX >> np.uint64(64 - BITS)).astype(np.int64))
    both = np.unique(np.concatenate(parts))
    return both & ((1 << BITS) - 1), np.searchsorted(both, np.arange(n_texts + 1) << BITS)


def in_blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, offsets) of neighbouring texts."""
    buf, offs = text_buffer(batch.column("text"))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + BLOCK, "right")) - 1)
        yield at, to, buf[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


@dataclass
class Model:
    """weights by bucket, and ascending thresholds: P(grade > k) = sigmoid(score - thresholds[k])."""

    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, buckets: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0.0], np.cumsum(self.weights[buckets], dtype=np.float64)])[offs])

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k), a column for each threshold."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -40, 40)))


def fit(buckets: np.ndarray, offs: np.ndarray, grades: np.ndarray, n_grades: int, steps: int = 400, rate: float = 0.3, prior: float = 4.0) -> Model:
    """Adam on the mean log-loss of the cumulative links, with an L2 penalty of prior / 2 over all rows."""
    n = len(grades)
    seen = np.flatnonzero(np.bincount(buckets, minlength=1 << BITS) >= max(min(LEAST_ROWS, n), n // ROWS_PER_BUCKET))
    place = np.full(1 << BITS, -1)
    place[seen] = np.arange(len(seen))
    # Entries by row and by column, so that both sums of a step are sums of neighbours.
    known = place[buckets] >= 0
    col = place[buckets[known]].astype(np.int32)
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(offs))[known]
    full, row_starts = np.unique(row, return_index=True)
    by_col = row[np.argsort(col, kind="stable")]
    col_starts = np.cumsum(np.bincount(col, minlength=len(seen))) - np.bincount(col, minlength=len(seen))
    del row, known
    above = (grades[:, None] > np.arange(n_grades - 1)[None, :]).astype(float)
    share = np.clip(above.mean(axis=0), 1e-3, 1 - 1e-3)
    p = np.concatenate([np.zeros(len(seen)), -np.log(share / (1 - share))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        w, th = p[: len(seen)], p[len(seen) :]
        score = np.zeros(n)
        if len(col):
            score[full] = np.add.reduceat(w.astype(np.float32)[col], row_starts)
        gap = 1 / (1 + np.exp(-np.clip(score[:, None] - th[None, :], -40, 40))) - above
        slope = np.add.reduceat(gap.sum(axis=1)[by_col], col_starts) if len(col) else np.zeros(0)
        g = np.concatenate([slope / n + prior / n * w, -gap.sum(axis=0) / n])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * (1 - 0.9 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        p[len(seen) :] = np.sort(p[len(seen) :])
    weights = np.zeros(1 << BITS, np.float32)
    weights[seen] = p[: len(seen)]
    return Model(weights, p[len(seen) :].copy())


def fit_on(docs: DataFrame, ratings: DataFrame, n_grades: int, sample_rows: int = SAMPLE_ROWS, name: str = "quality") -> Model:
    """Fit on a sample of docs (doc_id, text) rated by ratings (doc_id, grade).

    sample_rows bounds rows, not only identifiers: first identifiers are chosen by a hash, each with the chance that
    makes sample_rows of them in the mean, then, should many rows share those, distinct (doc_id, text) in the same way.
    Rows that repeat both count once. An identifier with several ratings has the least of them; null ratings, and those
    without a document, are left out. Without any rated row, all weights are zero and every row gets the same tail
    probabilities.
    """
    ws = Workspace(docs.sparkSession, name)
    rated = ratings.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    share = lambda n: int(min(1.0, sample_rows / max(n, 1)) * 2**31)
    chosen = rated.where(F.pmod(F.xxhash64("doc_id"), F.lit(2**31)) < share(rated.count()))
    chosen = ws.save(chosen, "chosen")  # sample_rows rows or so, whatever the input
    rows = docs.select("doc_id", "text", F.xxhash64("text", "doc_id").alias("key")).join(F.broadcast(chosen), "doc_id")
    held = rows.select("doc_id", "key").distinct().count()
    if held > 2 * sample_rows:
        rows = rows.where(F.pmod(F.xxhash64("key"), F.lit(2**31)) < share(held))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, offs in in_blocks(b):
                f, o = features(buf, offs)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), b.column("key").slice(i, j - i), b.column("grade").slice(i, j - i).cast(pa.int32()), pa.array([f[x:y].astype("<i4").tobytes() for x, y in zip(o[:-1], o[1:], strict=True)], pa.binary())], names=["doc_id", "key", "grade", "features"])

    sample = rows.mapInArrow(trimmed(run), "doc_id long, key long, grade int, features binary").groupBy("doc_id", "key").agg(F.min("grade").alias("grade"), F.min("features").alias("features"))
    sample = ws.save(sample, "sample").toPandas().sort_values(["doc_id", "key"])
    ws.drop("chosen", "sample")
    if not len(sample):
        return Model(np.zeros(1 << BITS, np.float32), np.zeros(n_grades - 1))
    found = [np.frombuffer(x, "<i4") for x in sample["features"]]
    offs = np.concatenate([[0], np.cumsum([len(x) for x in found])])
    return fit(np.concatenate(found), offs, sample["grade"].to_numpy(), n_grades)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with expected_grade and tails (P(grade > k) for each k) added. A null text is empty; columns of docs with
    those names are replaced."""
    names = [c for c in docs.columns if c not in ("expected_grade", "tails")]
    rows = docs.select(*names)
    schema = T.StructType([*rows.schema.fields, T.StructField("expected_grade", T.DoubleType()), T.StructField("tails", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, offs in in_blocks(b):
                tails = model.tails(model.scores(*features(buf, offs)))
                yield pa.RecordBatch.from_arrays([*b.slice(i, j - i).columns, pa.array(tails.sum(axis=1)), pa.array(list(tails), pa.list_(pa.float64()))], names=[*b.schema.names, "expected_grade", "tails"])

    return rows.mapInArrow(trimmed(run), schema)


def grades_of(labels: DataFrame) -> DataFrame:
    """Grades of labels (doc_id, quality 0/1, toxic 0/1): 0 to 2, a step for being good and a step for not being toxic."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") + 1 - F.col("toxic")).cast("int").alias("grade"))


N_GRADES = 3
#: Rows are selected whose chance of the top grade is at least this.
LEAST_TAIL = 0.7


def selected(docs: DataFrame, labels: DataFrame, least_tail: float = LEAST_TAIL) -> DataFrame:
    """docs with expected_grade, tails and selected: whether P(top grade) is least_tail or more.

    Every row of docs comes back once, with its own columns (those of the three names are replaced); repeated rows and
    rows that share an identifier are scored each by its own text, and a null identifier needs none. A null text is
    empty. An empty table gives no rows; without labels every row has the same probabilities, 0.5, and none is selected.
    """
    docs = docs.drop("selected")
    model = fit_on(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), grades_of(labels), N_GRADES)
    return score(docs, model).withColumn("selected", F.element_at("tails", -1) >= least_tail)
