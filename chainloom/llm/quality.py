"""Quality rules (operator 8): an isolation forest on rule statistics.

Each text gives fixed statistics (word characters, symbols, duplicate lines, words in repeated
windows). Two plain rules reject outright; the others are judged by an isolation forest over rates
that are derived from the statistics: each tree splits a random feature at a random place, and a
text that is parted from the sample after few splits is anomalous. The forest is grown from a
bounded sample of the documents, the bound a parameter, and its threshold is set from all labelled rows. Statistics and verdicts cover every text in whole.

Defined results: a null or empty text has no words, and fails the base rule. Repeated rows give
repeated, equal results. An empty table gives an empty result. With no labelled rows of both kinds
the threshold stands at `default_threshold`. Only doc_id and text are read of the documents, so
other columns and their names do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .runtime import map_batches, smallest, string_column, table, written

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATES = ("n_upper",)
SYMBOLS = b"#*$%&|<>"
#: Steps of the score in which labelled rows are counted.
LEVELS = 65_536


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _UPPER = _table(SYMBOLS), _table(bytes(range(65, 91)))
_HEAD = np.ones(256, bool)  # bytes that begin a code point
_HEAD[0x80:0xC0] = False


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[at])


def _duplicates(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Flags of values that occur before in the same text, in the order given."""
    order = np.lexsort((h, text))
    same = np.zeros(len(h), bool)
    same[1:] = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
    out = np.zeros(len(h), bool)
    out[order] = same
    return out


def _line_hashes(w: kernel.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash of the exact bytes and whether it has a word, of each \\n-split line."""
    breaks = np.flatnonzero(w.data == 0x0A)
    start = np.unique(np.concatenate((w.at[:-1], breaks + 1)))
    start = start[start < len(w.data)]
    text = np.searchsorted(w.at, start, "right") - 1
    end = np.minimum(np.append(breaks, len(w.data))[np.searchsorted(breaks, start)], w.at[text + 1])
    up, down = kernel.powers(len(w.data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(w.data) + 1, np.uint64)
        np.cumsum(kernel._BYTE[w.data] * up[: len(w.data)], out=total[1:])
        h = kernel.mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * kernel.U(0x2545F4914F6CDD1D))
    has = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    return text, h, has


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """The statistics of each text of a column."""
    out: dict[str, list[np.ndarray]] = {k: [] for k in STATS + RATES}
    for i, j, w in kernel.text_words(column, lower=False):
        n = j - i
        bounds = w.bounds()
        inside = _HEAD[w.data] & ~kernel._SPACE[w.data]
        text, h, has = _line_hashes(w)
        text, h = text[has], h[has]
        windows = kernel.grams(w.hash, 3)
        home = w.text[: len(windows)]
        whole = home == w.text[2:] if len(windows) else np.zeros(0, bool)
        windows = windows[whole]
        order = np.lexsort((windows, home[whole]))
        a, b = windows[order], home[whole][order]
        again = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        twice = np.zeros(len(a), bool)
        twice[1:] |= again
        twice[:-1] |= again
        places = np.flatnonzero(whole)[order[twice]]
        covered = np.zeros(len(w.text), bool)
        for k in range(3):
            covered[places + k] = True
        for name, values in (
            ("n_words", np.diff(bounds)),
            ("word_chars", _per_text(inside, w.at)),
            ("n_symbols", _per_text(_SYMBOL[w.data], w.at)),
            ("n_dup_lines", np.bincount(text[_duplicates(h, text)], minlength=n)),
            ("n_repeat_words", np.bincount(w.text[covered], minlength=n)),
            ("n_upper", _per_text(_UPPER[w.data], w.at)),
        ):
            out[name].append(values)
    return {k: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for k, v in out.items()}


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with all its statistics."""

    def run(batch: pa.RecordBatch) -> pa.Table:
        return pa.table({"doc_id": batch.column(0)} | statistics(batch.column(1)))

    schema = "doc_id long, " + ", ".join(f"{k} long" for k in STATS + RATES)
    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), string_column(docs, text_col).alias("text")), run, schema)


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """Rates in which a long text and a short one of the same kind agree. Duplicate lines are
    reported only: in short clean texts one repeated line is already an outlier."""
    n, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    return np.stack([s["n_symbols"] / n, s["n_upper"] / chars, s["n_repeat_words"] / n, chars / n], 1).astype(np.float64)


@dataclass
class Forest:
    """Trees as arrays by node; a leaf has feature -1 and its path length, with the usual
    correction for the rows it holds, in `value`."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    norm: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1; larger is more anomalous."""
        depth = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, value, left in zip(self.feature, self.value, self.left, strict=True):
            node = np.zeros(len(x), np.int64)
            while (open_ := feature[node] >= 0).any():
                f = np.where(open_, feature[node], 0)
                node = np.where(open_, left[node] + (x[rows, f] >= value[node]), node)
            depth += value[node]
        return np.exp2(-depth / len(self.feature) / self.norm)


def _expected(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows in a binary search tree."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def grow(x: np.ndarray, trees: int = 200, sample: int = 256, seed: int = 8) -> Forest:
    rng = np.random.default_rng(seed)
    size = min(sample, len(x))
    limit = int(np.ceil(np.log2(max(size, 2))))
    width = 2 ** (limit + 1) - 1
    feature, value, left = np.full((trees, width), -1), np.zeros((trees, width)), np.zeros((trees, width), np.int64)
    for t in range(trees):
        todo, used = [(0, x[rng.choice(len(x), size, replace=False)], 0)], 1
        while todo:
            node, rows, depth = todo.pop()
            wide = np.flatnonzero(np.ptp(rows, axis=0) > 0) if len(rows) > 1 else []
            if depth == limit or not len(wide):
                value[t, node] = depth + _expected(len(rows))
                continue
            f = int(rng.choice(wide))
            cut = rng.uniform(rows[:, f].min(), rows[:, f].max())
            high = rows[:, f] >= cut
            feature[t, node], value[t, node], left[t, node] = f, cut, used
            todo += [(used, rows[~high], depth + 1), (used + 1, rows[high], depth + 1)]
            used += 2
    return Forest(feature, value, left, max(_expected(size), 1e-9))


def calibrate(score: np.ndarray, good: np.ndarray, most_good: float = 0.005, default: float = 0.65) -> float:
    """The threshold with the best balance of found bad rows and lost good ones among those that
    lose no more than `most_good` of the good rows, midway to the next lower score."""
    levels, at = np.unique(score, return_inverse=True)
    return calibrate_counts(levels, np.bincount(at[good], minlength=len(levels)), np.bincount(at[~good], minlength=len(levels)), most_good, default)


def calibrate_counts(levels: np.ndarray, good: np.ndarray, bad: np.ndarray, most_good: float = 0.005, default: float = 0.65) -> float:
    """calibrate() over rising levels and the good and bad rows from each to the next."""
    if not good.sum() or not bad.sum():
        return default
    above = lambda n: np.cumsum(n[::-1])[::-1] / n.sum()
    lost, found = above(good), above(bad)
    fit = np.flatnonzero(lost <= most_good)
    if not len(fit):
        return default
    best = fit[np.argmax((found - lost)[fit])]
    return float((levels[best] + levels[best - 1]) / 2 if best else levels[best])


@dataclass
class QualityModel:
    forest: Forest
    threshold: float


def fit(stats: DataFrame, labels: DataFrame, sample_rows: int = 4096, seed: int = 8) -> QualityModel:
    """sample_rows bounds the documents the forest is grown from, taken by smallest seeded hash of doc_id and so alike
    in reruns. All labelled rows set the threshold: they are scored and counted by level where they are."""
    names = STATS + RATES
    order = F.xxhash64(F.col("doc_id"), F.lit(seed))
    fit_on = stats.where("n_words >= 50")
    rows = smallest(fit_on.withColumn("h", order), "h", sample_rows, *names).toPandas()
    marks = labels.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("quality").cast("int").alias("quality"),
    ).where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    take = lambda frame: features({k: frame[k].to_numpy(np.int64) for k in names})
    if len(rows) < 2:
        return QualityModel(Forest(np.full((1, 1), -1), np.ones((1, 1)), np.zeros((1, 1), np.int64), 1.0), 1.0)
    forest = grow(take(rows), seed=seed)

    def run(batch: pa.RecordBatch) -> pa.Table:
        return pa.table({"score": forest.score(features({k: batch.column(k).to_numpy() for k in names})), "quality": batch.column("quality")})

    scored = map_batches(fit_on.join(marks, "doc_id").select(*names, "quality"), run, "score double, quality int")
    good = F.col("quality") > 0
    counts = scored.groupBy(F.floor(F.col("score") * LEVELS).alias("level")).agg(F.min("score").alias("score"), F.count_if(good).alias("good"), F.count_if(~good).alias("bad"))
    c = counts.toPandas().sort_values("score")
    return QualityModel(forest, calibrate_counts(c["score"].to_numpy(), c["good"].to_numpy(np.int64), c["bad"].to_numpy(np.int64)))


def judge(stats: DataFrame, model: QualityModel) -> DataFrame:
    """Adds base_failed, score and kept to document_statistics()."""
    names = STATS + RATES

    def run(batch: pa.RecordBatch) -> pa.Table:
        s = {k: batch.column(k).to_numpy() for k in names}
        score = model.forest.score(features(s))
        failed = (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
        return pa.table(
            {"doc_id": batch.column("doc_id")} | {k: s[k] for k in STATS} | {
                "base_failed": failed,
                "kept": ~failed & (score < model.threshold),
                "score": score,
            }
        )

    return map_batches(stats, run, "doc_id long, " + ", ".join(f"{k} long" for k in STATS) + ", base_failed boolean, kept boolean, score double")


def quality_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = 4096) -> DataFrame:
    """Statistics, base rule and verdict of every document."""
    stats = written(document_statistics(docs), "quality")
    return judge(stats, fit(stats, labels, sample_rows))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def kept_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = 4096) -> DataFrame:
    """The rows of docs, with all their columns, that neither rule nor forest rejects. Without a column
    `text` no document has a word, and all are rejected."""
    model = fit(written(document_statistics(docs), "quality"), labels, sample_rows)
    names = docs.columns
    own = names.index("text") if dict(docs.dtypes).get("text") == "string" and names.count("text") == 1 else len(names)
    rows = docs if own < len(names) else docs.select("*", string_column(docs, "text").alias("_as_string"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = statistics(batch.column(own))
        failed = (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
        keep = pa.array(~failed & (model.forest.score(features(s)) < model.threshold))
        return pa.RecordBatch.from_arrays(batch.columns[: len(names)], names=names).filter(keep)

    return map_batches(rows, run, docs.schema)
