"""URL filter: rules by host and path, and for the rest the ratio of two character language models.

The models are smoothed variable-order Markov models over bytes, one of the URLs that rules allow and one of those that
rules block.  The probability of a byte after its longest context is interpolated down the shorter contexts:
``P_k = (count(context_k, byte) + strength * P_(k-1)) / (count(context_k) + strength)``.  Counts come from every URL
with a rule and are exact: a Spark table by (context, byte), which grows with the input.  To score, the URLs are dealt to
chunks; the distinct grams of a chunk are joined to the table, and their counts meet the chunk's URLs in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relief.llm.common import bounded_slices, shared_table, text_bytes

SLICE_BYTES = 1 << 18
STEPS = 1 << 14  # histogram cells per unit of log ratio
ORDER = 5
START, STOP = 256, 257  # symbols beside the bytes


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    at = F.locate("://", url)
    rest = F.substr(url, at + 3)
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.coalesce(at, F.lit(0)) > 0, low).otherwise(F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    at = F.locate("://", url)
    rest = F.substr(url, at + 3)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.when(F.coalesce(at, F.lit(0)) > 0, path).otherwise(F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, else null.  Of equally long rules, blocking ones and then names come first."""
    name = verdict = F.lit(None).cast("string")
    by_name = sorted(rules, key=lambda r: r.name, reverse=True)
    for rule in sorted(by_name, key=lambda r: (len(r.name), r.verdict == "block")):  # the last that fits holds
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def symbols(urls: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """START * ORDER, the URL's bytes, STOP for every row, back to back, and the offsets by row.  Null counts as empty."""
    data, offsets = text_bytes(urls)
    rows = len(offsets) - 1
    extra = np.arange(rows + 1) * (ORDER + 1)
    out = np.full(len(data) + rows * (ORDER + 1), START, np.int64)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    out[np.arange(len(data)) + extra[row] + ORDER] = data
    out[offsets[1:] + extra[1:] - 1] = STOP
    return out, offsets + extra


def _places(urls: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, at, row): ``symbols`` of the URLs, the places of every byte and STOP among them, and their rows."""
    code, offsets = symbols(urls)
    own = np.ones(len(code), bool)
    for k in range(ORDER):
        own[offsets[:-1] + k] = False
    at = np.flatnonzero(own)
    return code, at, np.searchsorted(offsets, at, side="right") - 1


def gram_keys(urls: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grams, contexts, row) of every byte and STOP of every URL: the gram of k context symbols and the symbol, and the context
    alone, for k from 0 to ORDER (arrays symbols x orders).  Each has a number of its own: nine bits a symbol, from 1, the
    last 0 for a context alone."""
    code, at, row = _places(urls)
    value = code + 1
    grams, contexts = np.zeros((len(at), ORDER + 1), np.int64), np.zeros((len(at), ORDER + 1), np.int64)
    for k in range(ORDER + 1):
        for j in range(k, 0, -1):
            contexts[:, k] = contexts[:, k] << 9 | value[at - j]
        contexts[:, k] <<= 9
        grams[:, k] = contexts[:, k] | value[at]
    return grams, contexts, row


def mean_log_ratio(seen, base, row: np.ndarray, rows: int, strength: float, less: np.ndarray | None) -> np.ndarray:
    """Per row, the mean over its symbols of log P(allow) - log P(block).  ``seen``, ``base``: counts of the grams and of the
    contexts by class and order; ``less``: the class (0 or 1) whose counts hold the row itself, which are then taken out."""
    total = np.zeros(len(row))
    for side, sign in ((0, -1.0), (1, 1.0)):
        out = np.zeros(len(row)) if less is None else (less[row] == side) * 1.0
        p = np.full(len(row), 1 / 257)
        for k in range(ORDER + 1):
            own = np.maximum(0, seen(side, k) - out)
            p = (own + strength * p) / (np.maximum(own, base(side, k) - out) + strength)
        total += sign * np.log(p)
    n = np.bincount(row, minlength=rows)
    return np.bincount(row, total, minlength=rows) / np.maximum(n, 1)


@dataclass(frozen=True)
class UrlCounts:
    """``table``: key, block, allow, the exact counts of each gram and context (``gram_keys``); the sums of both by class."""

    table: DataFrame
    grams: np.ndarray  # 2
    contexts: np.ndarray
    strength: float = 4.0


def train(urls: DataFrame) -> UrlCounts | None:
    """``urls``: ``page_id, url, verdict`` (allow, block or null).  Counts cover every URL with a verdict.  None if either class
    has no URL."""
    known = urls.where("verdict is not null and url is not null").select("url", (F.col("verdict") == "allow").cast("int").alias("allow"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded_slices(batch, "url", SLICE_BYTES):
                grams, contexts, row = gram_keys(part.column("url"))
                side = part.column("allow").to_numpy()[row]
                for s in (0, 1):
                    key, n = np.unique(np.concatenate([grams[side == s], contexts[side == s]]), return_counts=True)
                    both = [n, np.zeros_like(n)] if s == 0 else [np.zeros_like(n), n]
                    yield pa.RecordBatch.from_arrays([pa.array(key), *map(pa.array, both)], ["key", "block", "allow"])

    sums = F.sum("block").alias("block"), F.sum("allow").alias("allow")
    table = shared_table(known.mapInArrow(count, "key long, block long, allow long").groupBy("key").agg(*sums))
    totals = {r.context: (r.block, r.allow) for r in table.groupBy((F.col("key") % 512 == 0).alias("context")).agg(*sums).collect()}
    if not all(totals.get(False, (0, 0))):
        return None
    return UrlCounts(table, np.array(totals[False]), np.array(totals[True]))


def score(rows: DataFrame, model: UrlCounts) -> DataFrame:
    """``rows`` (with ``url, verdict``) and ``log_ratio``; ``own_ratio``: the same with the row's own counts taken out, null
    without a verdict."""
    strength, schema = model.strength, rows.schema

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in bounded_slices(batch, "url", SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(part.num_rows, chunk))], [*part.schema.names, "chunk"])
                chunk += 1

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunk = batch.column("chunk").to_numpy()
            cuts = np.r_[0, np.flatnonzero(np.diff(chunk)) + 1, len(chunk)] if len(chunk) else np.zeros(1, np.int64)
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                grams, contexts, _ = gram_keys(batch.column("url").slice(lo, hi - lo))
                key = np.unique(np.concatenate([grams, contexts]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), chunk[lo])), pa.array(key)], ["chunk", "key"])

    def run(part: pa.Table, counts: pa.Table) -> pa.Table:
        url, verdict = (part.column(c).combine_chunks() for c in ("url", "verdict"))
        url = pa.concat_arrays(url.chunks) if isinstance(url, pa.ChunkedArray) else url
        held = counts.sort_by("key")
        key = np.r_[held.column("key").to_numpy(), np.iinfo(np.int64).max]  # the last stands for all that aren't held
        n = [np.r_[held.column(c).to_numpy(), 0].astype(np.float64) for c in ("block", "allow")]
        grams, contexts, row = gram_keys(url)

        def place(wanted: np.ndarray) -> np.ndarray:
            at = np.searchsorted(key, wanted)
            return np.where(key[at] == wanted, at, len(key) - 1)

        grams, contexts = place(grams), place(contexts)
        seen, base = (lambda side, k: n[side][grams[:, k]]), (lambda side, k: n[side][contexts[:, k]])
        named = verdict.to_pylist()
        # a null URL has a verdict of no rule, and is not in the counts
        less = np.array([-1 if v is None else int(v == "allow") for v in named], np.int64)
        ratio, own = (mean_log_ratio(seen, base, row, part.num_rows, strength, x) for x in (None, less))
        own = pa.array(own, mask=less < 0)
        return part.drop_columns("chunk").append_column("log_ratio", pa.array(ratio)).append_column("own_ratio", own)

    # the chunks are written, so that both sides of the join see the same ones
    dealt = shared_table(rows.mapInArrow(deal, type(schema)([*schema.fields]).add("chunk", "long")))
    counts = dealt.select("url", "chunk").mapInArrow(keys, "chunk long, key long").distinct().join(model.table, "key")
    out = type(schema)([*schema.fields]).add("log_ratio", "double").add("own_ratio", "double")
    return dealt.groupBy("chunk").cogroup(counts.select("chunk", "key", "block", "allow").groupBy("chunk")).applyInArrow(run, out)


def calibrated(scored: DataFrame) -> float:
    """The threshold of least mean error rate over both classes, on every distinct URL with a verdict, each scored with its own
    counts taken out; a multiple of 1 / STEPS.  Log ratios grow with the logarithm of the counts only, so the histogram is small."""
    known = scored.where("own_ratio is not null").select("url", (F.col("verdict") == "allow").cast("int").alias("allow"), "own_ratio")
    cell = F.floor(F.col("own_ratio") * STEPS).cast("long").alias("cell")
    counts = known.dropDuplicates(["url", "allow"]).groupBy(cell).agg(F.sum(1 - F.col("allow")).alias("block"), F.sum("allow").alias("allow"))
    found = counts.orderBy("cell").toArrow()
    return best_threshold(*(found.column(c).to_numpy() for c in ("cell", "block", "allow")))


def best_threshold(cell: np.ndarray, block: np.ndarray, allow: np.ndarray) -> float:
    """Cut of least mean error rate of both classes, from their counts by ascending cell; ties to the cut nearest 0."""
    if not allow.sum() or not block.sum():
        return 0.0
    cuts = np.unique(np.r_[cell, cell[-1] + 1, 0])
    below = np.searchsorted(cell, cuts)  # cells under the cut
    error = np.r_[0, np.cumsum(allow)][below] / allow.sum() + 1 - np.r_[0, np.cumsum(block)][below] / block.sum()
    return float(cuts[np.lexsort((np.abs(cuts), error))[0]]) / STEPS


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: ``id_col, host, path, rule, verdict, log_ratio``.

    The verdict is the longest fitting rule's, else the models': allow from the threshold on.  Null and empty URLs have no
    host, path or rule and log ratio 0 or that of the empty string.  If no URL is allowed, or none is blocked, by a rule,
    there are no models and the rest is allowed (log ratio null).  Other columns are ignored.
    """
    url = F.col("url")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    rows = rows.withColumns({"host": url_host(url), "path": url_path(url)})
    name, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "verdict": verdict})
    model = train(rows)
    if model is None:
        out = rows.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("log_ratio"))
        return out.withColumnRenamed("page_id", id_col)
    scored = shared_table(score(rows, model))
    judged = F.when(F.col("log_ratio") >= F.lit(calibrated(scored)), "allow").otherwise("block")
    return scored.select(F.col("page_id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", judged).alias("verdict"), "log_ratio")
