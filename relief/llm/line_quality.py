"""Document quality by a linear-chain conditional random field over lines (numpy).

Every line is good or bad.  Its features are shares of character classes, lengths and repetition, its own and its two
neighbours'.  Training takes each line's label from its document's; the transition weights carry evidence from line to line.
A document's quality is the mean of its lines' forward-backward marginals, weighted by their lengths, calibrated by a
logistic curve.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relief.llm.common import bounded_slices, mix64, text_bytes

# byte classes: upper-case and lower-case ASCII letters, digits, white space, sentence marks, other ASCII marks, beyond ASCII
_CLASS = np.full(256, 6, np.int64)
_CLASS[:128] = 5
for _chars, _k in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0), (b"abcdefghijklmnopqrstuvwxyz", 1), (b"0123456789", 2), (b" \t\r\x0b\x0c", 3), (b".,;:?'\"-()", 4)):
    _CLASS[np.frombuffer(_chars, np.uint8)] = _k
OWN = 14
FEATURES = 3 * OWN + 1
#: texts that a task works on at once; the arrays over their bytes take about 80 times as much
SLICE_BYTES = 1 << 18
#: tasks that describe the training sample
SAMPLE_TASKS = 12


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features per line, line lengths in bytes, offsets of lines by row); lines end at a line feed, blank lines don't count."""
    data, offsets = text_bytes(column)
    rows = len(offsets) - 1
    nothing = np.zeros((0, FEATURES)), np.zeros(0), np.zeros(rows + 1, np.int64)
    if not len(data):
        return nothing
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    cut[1:] |= data == 10
    starts = np.flatnonzero(cut[:-1])
    kind = _CLASS[data]
    kind[data == 10] = 3
    line = np.cumsum(cut[:-1]) - 1
    n = len(starts)
    counts = np.bincount(line * 7 + kind, minlength=7 * n).reshape(n, 7).astype(np.float64)
    size = np.diff(np.r_[starts, len(data)])
    solid = size - counts[:, 3]
    # words: how many, and how many equal the word before them
    word = kind != 3
    first = word.copy()
    first[1:] &= ~word[:-1] | cut[1:-1]
    at = np.flatnonzero(first)
    power = np.cumprod(np.r_[np.uint64(1), np.full(int(size.max()), np.uint64(0x100000001B3), np.uint64)])
    value = np.where(word, (data.astype(np.uint64) | np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15), np.uint64(0))
    if len(at):
        place = np.arange(len(data)) - at[np.maximum(np.cumsum(first) - 1, 0)]
        place[~word] = 0
        words = np.add.reduceat(value * power[np.minimum(place, len(power) - 1)], at)
        of = line[at]
        again = np.zeros(len(at), bool)
        again[1:] = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
        n_words, repeats = np.bincount(of, minlength=n), np.bincount(of, again, minlength=n)
    else:
        n_words, repeats = np.zeros(n), np.zeros(n)
    row = np.searchsorted(offsets, starts, side="right") - 1
    kept = np.flatnonzero(solid > 0)
    if not len(kept):
        return nothing
    text = np.add.reduceat(mix64(value + np.uint64(1)) * power[np.arange(len(data)) - starts[line]], starts)[kept]
    row = row[kept]
    _, inverse, times = np.unique(mix64(text + mix64(row.astype(np.uint64))), return_inverse=True, return_counts=True)
    twice = times[inverse] > 1
    c, size, solid, n_words, repeats = counts[kept], size[kept], solid[kept], np.maximum(n_words[kept], 1), repeats[kept]
    letters = np.maximum(c[:, 0] + c[:, 1], 1)
    own = np.stack(
        [
            np.ones(len(kept)),
            np.log1p(size) / 5,
            c[:, 0] / letters,
            c[:, 2] / solid,
            c[:, 4] / solid,
            c[:, 5] / solid,
            c[:, 6] / solid,
            np.minimum(1, 4 * c[:, 5] / n_words),
            (c[:, 5] > 0) * 1.0,
            repeats / n_words,
            twice * 1.0,
            solid / n_words / 10,
            (size < 40) * 1.0,
            n_words / (n_words + 10),
        ],
        axis=1,
    )
    same = np.r_[False, row[1:] == row[:-1], False][:, None]
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:] = own[:-1] * same[1:-1]
    after[:-1] = own[1:] * same[1:-1]
    return np.concatenate([own, before, after, np.log1p(size)[:, None] / 5], axis=1)[:, :FEATURES], size.astype(np.float64), np.searchsorted(row, np.arange(rows + 1))


def _padded(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line numbers of ``rows`` as a matrix (rows x longest), and which of its places are lines."""
    size = at[rows + 1] - at[rows]
    place = np.arange(int(size.max()))
    real = place < size[:, None]
    return np.where(real, at[rows][:, None] + place, 0), real


def _buckets(at: np.ndarray, rows: np.ndarray, most: int = 1 << 18) -> Iterator[np.ndarray]:
    """``rows`` in blocks of similar numbers of lines and at most about ``most`` places."""
    size = np.diff(at)
    order = rows[np.argsort(size[rows], kind="stable")]
    lo = 0
    while lo < len(order):
        least = int(size[order[lo]])
        hi = int(np.searchsorted(size[order], 2 * least, side="right"))
        hi = min(hi, lo + max(1, most // (2 * least)))
        yield order[lo:hi]
        lo = hi


#: rows of more lines go through ``_long_marginals``
LONG = 1 << 11


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of 2 x 2 matrices whose entries are logarithms."""
    return np.logaddexp(a[..., :, 0, None] + b[..., None, 0, :], a[..., :, 1, None] + b[..., None, 1, :])


def _long_marginals(score: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``marginals`` for one row: products of transition matrices inside blocks of about the square root of its lines, for
    all blocks at once, then from block to block."""
    n = len(score)
    width = int(np.ceil(np.sqrt(n)))
    blocks = -(-n // width)
    node = np.stack([np.zeros(n), score], axis=1)
    neutral = np.where(np.eye(2, dtype=bool), 0.0, -np.inf)
    step = np.broadcast_to(neutral, (blocks * width, 2, 2)).copy()
    step[1:n] = move + node[1:, None, :]
    step = step.reshape(blocks, width, 2, 2)
    ahead, behind = step.copy(), step.copy()  # products from the block's start to here, and from here to its end
    for k in range(1, width):
        ahead[:, k] = _times(ahead[:, k - 1], step[:, k])
        behind[:, -1 - k] = _times(step[:, -1 - k], behind[:, -k])
    enter, leave = np.zeros((blocks, 2)), np.zeros((blocks, 2))
    enter[0] = node[0]
    for k in range(1, blocks):
        enter[k] = np.logaddexp(enter[k - 1][0] + ahead[k - 1, -1][0], enter[k - 1][1] + ahead[k - 1, -1][1])
        back = behind[blocks - k, 0] + leave[blocks - k]
        leave[blocks - 1 - k] = np.logaddexp(back[:, 0], back[:, 1])
    forward = np.logaddexp(enter[:, None, 0, None] + ahead[:, :, 0], enter[:, None, 1, None] + ahead[:, :, 1]).reshape(-1, 2)[:n]
    # what follows a line: the products from the next line on
    after = np.logaddexp(behind[..., 0] + leave[:, None, 0, None], behind[..., 1] + leave[:, None, 1, None]).reshape(-1, 2)[1:n]
    after = np.concatenate([after, np.zeros((1, 2))])
    whole = np.logaddexp(forward[-1, 0], forward[-1, 1])
    good = np.exp(forward[:, 1] + after[:, 1] - whole)
    joint = np.exp(forward[:-1, :, None] + move + (node[1:] + after[1:])[:, None, :] - whole)
    return good, joint.sum(0)


def marginals(score: np.ndarray, at: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P(good) of every line, expected transition counts 2 x 2) under line scores for good and transition weights."""
    good, moves = np.zeros(len(score)), np.zeros((2, 2))
    size = np.diff(at)
    for row in np.flatnonzero(size > LONG).tolist():
        good[at[row] : at[row + 1]], own = _long_marginals(score[at[row] : at[row + 1]], move)
        moves += own
    for rows in _buckets(at, np.flatnonzero((size > 0) & (size <= LONG))):
        index, real = _padded(at, rows)
        node = np.stack([np.zeros(index.shape), score[index]], axis=2)
        steps = index.shape[1]
        forward, back = node.copy(), np.zeros_like(node)
        for t in range(1, steps):
            prior = forward[:, t - 1]
            for s in (0, 1):
                forward[:, t, s] += np.logaddexp(prior[:, 0] + move[0, s], prior[:, 1] + move[1, s])
            # rows that ended keep their last value
            forward[:, t] = np.where(real[:, t, None], forward[:, t], prior)
        whole = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        for t in range(steps - 2, -1, -1):
            ahead = node[:, t + 1] + back[:, t + 1]
            for s in (0, 1):
                back[:, t, s] = np.logaddexp(move[s, 0] + ahead[:, 0], move[s, 1] + ahead[:, 1])
            back[:, t] = np.where(real[:, t + 1, None], back[:, t], 0.0)
            joint = np.exp(forward[:, t, :, None] + move + ahead[:, None, :] - whole[:, None, None])
            moves += (joint * real[:, t + 1, None, None]).sum(0)
        p = np.exp(forward[:, :, 1] + back[:, :, 1] - whole[:, None])
        good[index[real]] = p[real]
    return good, moves


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    weight: np.ndarray
    move: np.ndarray
    slope: float
    offset: float
    empty: float = 0.0

    def lines(self, features: np.ndarray, at: np.ndarray) -> np.ndarray:
        return marginals((features - self.mean) / self.spread @ self.weight, at, self.move)[0]

    def raw(self, column: pa.Array) -> np.ndarray:
        """Length-weighted mean marginal of each row; NaN without lines."""
        features, size, at = line_features(column)
        if not len(features):
            return np.full(len(column), np.nan)
        return weighted_mean(self.lines(features, at), size, at)

    def score(self, column: pa.Array) -> np.ndarray:
        return calibrated(self.raw(column), self.slope, self.offset, self.empty)


def weighted_mean(p: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums, weights = np.r_[0, np.cumsum(p * size)], np.r_[0, np.cumsum(size)]
    with np.errstate(invalid="ignore", divide="ignore"):
        return (sums[at[1:]] - sums[at[:-1]]) / (weights[at[1:]] - weights[at[:-1]])


def _logit(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, 1e-4, 1 - 1e-4)
    return np.log(x / (1 - x))


def calibrated(raw: np.ndarray, slope: float, offset: float, empty: float) -> np.ndarray:
    return np.where(np.isnan(raw), empty, 1 / (1 + np.exp(-(slope * _logit(np.nan_to_num(raw, nan=0.5)) + offset))))


def fit(features: np.ndarray, size: np.ndarray, at: np.ndarray, label: np.ndarray, held: np.ndarray, rounds: int = 200, rate: float = 0.1, ridge: float = 1e-3) -> QualityModel:
    """Maximum likelihood by Adam on the documents that aren't ``held``; those calibrate the score."""
    width = features.shape[1]
    if not len(features) or len(set(label.tolist())) < 2:
        share = float(np.clip(label.mean(), 0.01, 0.99)) if len(label) else 0.5
        return QualityModel(np.zeros(width), np.ones(width), np.zeros(width), np.zeros((2, 2)), 0.0, float(_logit(np.array(share))))
    mean, spread = features.mean(0), features.std(0) + 1e-6
    mean[0], spread[0] = 0.0, 1.0  # the constant
    x = (features - mean) / spread
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    use = ~held[row]
    kept = np.where(held, 0, np.diff(at))
    train_at, xt, y = np.r_[0, np.cumsum(kept)], x[use], label[row][use].astype(np.float64)
    if not len(xt):
        xt, y, train_at = x, label[row].astype(np.float64), at
    of = np.repeat(np.arange(len(train_at) - 1), np.diff(train_at))
    next_same = np.flatnonzero(of[1:] == of[:-1])
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[next_same].astype(int), y[next_same + 1].astype(int)), 1)
    theta, m, v = np.zeros(width + 4), np.zeros(width + 4), np.zeros(width + 4)
    for k in range(1, rounds + 1):
        good, moves = marginals(xt @ theta[:width], train_at, theta[width:].reshape(2, 2))
        grad = np.r_[xt.T @ (y - good), (seen - moves).ravel()] / len(xt) - ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    model = QualityModel(mean, spread, theta[:width], theta[width:].reshape(2, 2), 1.0, 0.0)
    raw = weighted_mean(model.lines(features, at), size, at)
    sure = held & ~np.isnan(raw)
    if len(set(label[sure].tolist())) < 2:
        sure = ~np.isnan(raw)
    z, t = _logit(raw[sure]), label[sure].astype(np.float64)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps with a small ridge towards slope 1
        p = 1 / (1 + np.exp(-(a * z + b)))
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((t - p) * z).sum() - (a - 1), (t - p).sum() - 1e-3 * b])
        h = np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a + step[0], b + step[1]
    return QualityModel(mean, spread, theta[:width], theta[width:].reshape(2, 2), float(max(a, 1e-3)), float(b))


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 2048) -> QualityModel:
    """Fit on the ``max_rows`` labelled documents with the least hash of their id (whole texts), among those that ``may_learn``
    (a condition on ``id_col``).  Null ids, texts and labels don't teach; of several labels of an id the least counts, of
    several texts of an id the one with the least hash teaches.

    What reaches the driver are the lines' features of these at most ``max_rows`` texts.
    """
    rank = F.xxhash64(F.col("_id").cast("string"), F.lit("quality"))
    known = labels.where(F.coalesce(may_learn, F.lit(False)) & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y"))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    known = known.groupBy("_id").agg(F.min("_y").alias("_y")).join(texts.select("_id"), "_id", "left_semi")
    chosen = known.withColumn("_rank", rank).orderBy("_rank", "_id").limit(max_rows)
    one = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_rank", "_y").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))
    one = one.coalesce(SAMPLE_TASKS)  # few rows: not one Python task for each shuffle partition

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded_slices(batch, "_text", SLICE_BYTES):
                features, size, at = line_features(part.column("_text"))
                packed = [np.c_[features[lo:hi], size[lo:hi]].astype("<f4").tobytes() for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("_rank"), part.column("_y"), pa.array(packed, pa.binary())], ["rank", "y", "lines"])

    rows = one.select("_rank", F.col("_y").cast("int").alias("_y"), "_text").mapInArrow(describe, "rank long, y int, lines binary")
    got = sorted((r.rank, r.y, bytes(r.lines)) for r in rows.collect())
    blocks = [np.frombuffer(raw, "<f4").reshape(-1, FEATURES + 1).astype(np.float64) for _, _, raw in got]
    at = np.r_[0, np.cumsum([len(b) for b in blocks])].astype(np.int64)
    lines = np.concatenate(blocks) if blocks else np.zeros((0, FEATURES + 1))
    held = np.array([rank % 4 == 0 for rank, _, _ in got], bool)
    return fit(lines[:, :-1], lines[:, -1], at, np.array([y for _, y, _ in got], np.int64), held)


def predict(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col, score`` (0 to 1, likelihood of good).

    Null, empty and blank texts score 0.  Only the text decides; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded_slices(batch, "_text", SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(model.score(part.column("_text")))], [id_col, "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"`{id_col}` long, score double")


def accepted(docs: DataFrame, model: QualityModel, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with all their columns whatever their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded_slices(batch, text_col, SLICE_BYTES):
                yield part.filter(pa.array(model.score(part.column(text_col)) >= least))

    return docs.mapInArrow(run, docs.schema)
