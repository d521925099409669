"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

Subwords are runs of 1 to 4 characters (code points, lower-cased) inside words, word borders included, hashed to
``BUCKETS`` embeddings.  A text's vector is the mean of its subwords' embeddings over the whole text.  Since mean and
softmax input are linear, embeddings times softmax weights give one table (buckets x languages) that tasks look up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relief.llm.common import bounded_slices, mix64

BUCKETS = 1 << 14
GRAMS = (1, 2, 3, 4)
#: texts that a task works on at once; the arrays over their subwords take about 200 times as much
SLICE_BYTES = 1 << 18
#: tasks that count the subwords of the training sample
SAMPLE_TASKS = 12
UNKNOWN = "und"
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def subword_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every subword of every text, back to back, and the offsets by text."""
    spaced = [f" {(t or '').lower()} " for t in texts]
    sizes = np.array([len(s) for s in spaced], np.int64)
    code = np.frombuffer("".join(spaced).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[code]
    code = np.where(letter, code, 32).astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), sizes)
    found, of = [], []
    for n in GRAMS:
        m = len(code) - n + 1
        if m <= 0:
            continue
        # letters inside; at the ends a word border may stand, but not for single letters or on both sides of a pair
        ok = np.ones(m, bool)
        for j in range(1, n - 1):
            ok &= letter[j : j + m]
        ok &= letter[:m] if n == 1 else (letter[:m] | letter[1 : 1 + m] if n == 2 else True)
        at = np.flatnonzero(ok)
        total = np.full(len(at), n, np.uint64)
        for j in range(n):
            total = total * np.uint64(0x100000001B3) + code[at + j]
        found.append((mix64(total) & np.uint64(BUCKETS - 1)).astype(np.int32))
        of.append(row[at])
    buckets, rows = np.concatenate(found), np.concatenate(of)
    order = np.argsort(rows, kind="stable")
    return buckets[order], np.searchsorted(rows[order], np.arange(len(texts) + 1))


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    table: np.ndarray  # BUCKETS x languages: embeddings times softmax weights
    bias: np.ndarray
    temperature: float  # calibrates the softmax
    reject_below: float  # score under which a prediction is rejected

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [], np.zeros(len(texts))
        buckets, at = subword_counts(texts)
        for k in range(len(texts)):
            own = buckets[at[k] : at[k + 1]]
            if not len(own) or not self.languages:
                names.append(UNKNOWN)
                continue
            logits = np.bincount(own, minlength=BUCKETS) @ self.table / len(own) + self.bias
            p = np.exp((logits - logits.max()) / self.temperature)
            best = int(logits.argmax())
            names.append(self.languages[best])
            scores[k] = min(1.0, p[best] / p.sum())
        return names, scores

    def judge(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores, and which rows are rejected."""
        names, scores = self.predict(texts.to_pylist())
        return names, scores, np.array([n == UNKNOWN for n in names], bool) | (scores < self.reject_below)


def fit(samples: list[tuple[str, np.ndarray, np.ndarray, bool]], dim: int = 16, epochs: int = 12, rate: float = 4.0, batch: int = 16, seed: int = 7, lost: float = 0.002) -> LanguageModel:
    """From (language, distinct buckets, their counts, for calibration?) per labelled text.

    The temperature is the one of least log loss on the calibration texts.  The rejection score is the ``lost`` quantile
    of the scores of calibration texts that are predicted right, at most 0.5.
    """
    languages = tuple(sorted({s[0] for s in samples}))
    table, bias = np.zeros((BUCKETS, len(languages)), np.float32), np.zeros(len(languages))
    samples = [s for s in samples if len(s[1])]
    if len(languages) < 2 or not samples:
        return LanguageModel(languages, table, bias, 1.0, 0.0)
    label = {name: k for k, name in enumerate(languages)}
    train, held = [s for s in samples if not s[3]], [s for s in samples if s[3]]
    train, held = train or held, held or train
    rng = np.random.default_rng(seed)
    embed, weight = rng.normal(0, 1 / np.sqrt(dim), (BUCKETS, dim)), np.zeros((dim, len(languages)))
    steps, step = epochs * -(-len(train) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(train))
        for lo in range(0, len(train), batch):
            part = [train[k] for k in order[lo : lo + batch]]
            sizes = np.array([len(s[1]) for s in part])
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            index, row = np.concatenate([s[1] for s in part]), np.repeat(np.arange(len(part)), sizes)
            share = np.concatenate([s[2] / s[2].sum() for s in part])[:, None]
            hidden = np.add.reduceat(embed[index] * share, starts)
            logits = hidden @ weight + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), [label[s[0]] for s in part]] -= 1
            lr = rate * (1 - step / steps) / len(part)
            step += 1
            back = p @ weight.T
            weight -= lr * hidden.T @ p
            bias -= lr * p.sum(0)
            np.add.at(embed, index, -lr * share * back[row])
    table = (embed @ weight).astype(np.float32)
    logits = np.array([table[s[1]].T @ (s[2] / s[2].sum()) + bias for s in held])
    truth = np.array([label[s[0]] for s in held])

    def probabilities(t: float) -> np.ndarray:
        e = np.exp((logits - logits.max(1, keepdims=True)) / t)
        return e / e.sum(1, keepdims=True)

    grid = np.geomspace(0.02, 20, 61)
    loss = [-np.log(np.maximum(probabilities(t)[np.arange(len(held)), truth], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = probabilities(temperature)
    right = p.argmax(1) == truth
    reject = min(0.5, float(np.quantile(p.max(1)[right], lost))) if right.any() else 0.0
    return LanguageModel(languages, table, bias, temperature, reject)


def train(docs: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = 2048) -> LanguageModel:
    """Fit on at most ``max_rows`` labelled rows (whole texts), among those that ``may_learn``.

    Rows are drawn language by language in the order of their id's hash, the first of every language, then the second and
    so on, so that rare languages are learned too.  An id with several rows in a language teaches once, by the text with the
    least hash.  Rows with null id, text or language don't teach.  What reaches the driver is at most ``max_rows`` times
    ``BUCKETS`` counts.  With fewer than two languages, the model knows only that one.
    """
    rank = F.xxhash64(F.col(id_col).cast("string"), F.lit("language"))
    usable = F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.coalesce(may_learn, F.lit(False))
    labelled = docs.where(usable).select(F.col(id_col).alias("_id"), rank.alias("_rank"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    # a limited window: no task keeps more than max_rows rows of a language
    nth = F.row_number().over(Window.partitionBy("_lang").orderBy("_rank", "_id"))
    drawn = labelled.select("_id", "_lang", "_rank").distinct().withColumn("_nth", nth).where(F.col("_nth") <= max_rows)
    chosen = drawn.orderBy("_nth", "_rank", "_id", "_lang").limit(max_rows).select("_id", "_lang")
    rows = labelled.join(F.broadcast(chosen), ["_id", "_lang"])
    # few rows: not one Python task for each shuffle partition
    rows = rows.groupBy("_id", "_lang", "_rank").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text")).coalesce(SAMPLE_TASKS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded_slices(batch, "_text", SLICE_BYTES):
                buckets, at = subword_counts(part.column("_text").to_pylist())
                pairs = [np.unique(buckets[lo:hi], return_counts=True) for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                held = [r % 5 == 0 for r in part.column("_rank").to_pylist()]
                packed = [np.stack([b, c]).astype("<i4").tobytes() for b, c in pairs]
                yield pa.RecordBatch.from_arrays([part.column("_rank"), part.column("_lang"), pa.array(held), pa.array(packed, pa.binary())], ["rank", "lang", "held", "counts"])

    got = sorted((r.rank, r.lang, r.held, bytes(r.counts)) for r in rows.mapInArrow(count, "rank long, lang string, held boolean, counts binary").collect())
    samples = []
    for _, lang, held, raw in got:
        both = np.frombuffer(raw, "<i4").reshape(2, -1)
        samples.append((lang, both[0].astype(np.int64), both[1].astype(np.float64), held))
    return fit(samples)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col, lang_pred, score, rejected``.

    ``lang_pred`` is a learned language, or ``und`` with score 0 for texts that are null or have no letter; these are
    rejected, and so are scores under the model's rejection score.  Only the text decides; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded_slices(batch, "_text", SLICE_BYTES):
                names, scores, rejected = model.judge(part.column("_text"))
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(names, pa.string()), pa.array(scores), pa.array(rejected)], [id_col, "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"`{id_col}` long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with all their columns whatever their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded_slices(batch, text_col, SLICE_BYTES):
                yield part.filter(pa.array(~model.judge(part.column(text_col))[2]))

    return docs.mapInArrow(run, docs.schema)
