"""Benchmark decontamination (operator 10): greedy string tiling.

A document and a benchmark item that share a run of `min_match` words (the seeds, found by hash) are
tiled: running Karp-Rabin hashes of a search length find common runs of unmarked words, the longest
are marked first and never overlap, and the search length falls until it is `min_match`. An item's
coverage is the share of its words in tiles, wherever in the document these stand, so a passage whose
sentences were reordered is found. A document is contaminated when it covers `threshold` of an item.

Only items whose shared seeds lie over `threshold` of their words, or over more than the largest coverage
found so far, are tiled, which changes no result: a sentence that all items share is tiled once a document.
A document has one row of result for a block, however many items it meets.

The benchmark is a query set: it is worked in blocks of about BLOCK_CHARS characters, each broadcast
on its own, against all documents. Documents are never shuffled; of them only ids and digests are.

Words are runs outside {0x20, 0x09-0x0D} with A-Z lower-cased. Defined results: a null or empty text
is clean; an item of fewer than `min_match` words (null ones too) cannot be told from chance and is
not tested; a null item_id is reported as no id but counts; repeated rows and equal or null ids get
their own text's result; empty tables give an empty or a clean result; other columns are not read.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .runtime import map_batches, string_column, table, written

MIN_MATCH = 5
THRESHOLD = 0.5
FIRST_LENGTH = 20
BLOCK_CHARS = 32_000_000
#: Up to so many flags and item ids (some 60 bytes each) are broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def _rolled(h: np.ndarray, s: int) -> np.ndarray:
    """Karp-Rabin hash of every window of s values."""
    up, down = kernel.powers(len(h) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)))
        return kernel.mix((total[s:] - total[:-s]) * down[: len(h) - s + 1])


def _open_windows(marked: np.ndarray, s: int) -> np.ndarray:
    """Starts of windows of s values of which none is marked."""
    total = np.concatenate(([0], np.cumsum(marked)))
    return np.flatnonzero(total[s:] == total[:-s])


def tiles(text: np.ndarray, item: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """(length, place in text, place in item) of the tiles of two sequences of word hashes."""
    found: list[tuple[int, int, int]] = []
    marks = np.zeros(len(text), bool), np.zeros(len(item), bool)
    s = max(min_match, min(FIRST_LENGTH, len(item), len(text)))
    while len(text) >= s and len(item) >= s:
        a, b = _open_windows(marks[0], s), _open_windows(marks[1], s)
        matches = []
        if len(a) and len(b):
            ha, hb = _rolled(text, s)[a], _rolled(item, s)[b]
            order = np.argsort(hb, kind="stable")
            left, right = np.searchsorted(hb[order], ha, "left"), np.searchsorted(hb[order], ha, "right")
            hit = np.flatnonzero(right > left)
            x = np.repeat(a[hit], (right - left)[hit])
            y = np.concatenate([b[order[left[k] : right[k]]] for k in hit]) if len(hit) else np.zeros(0, np.int64)
            # consecutive windows of one diagonal make one run
            order = np.lexsort((x, x - y))
            x, y = x[order], y[order]
            first = np.concatenate(([True], (np.diff(x) != 1) | (np.diff(x - y) != 0))) if len(x) else np.zeros(0, bool)
            starts = np.flatnonzero(first)
            runs = np.diff(np.append(starts, len(x))) + s - 1
            matches = list(zip((-runs).tolist(), x[starts].tolist(), y[starts].tolist(), strict=True))
        longest = -min(matches, default=(0,))[0]
        if longest > 2 * s:
            s = longest
            continue
        heapify(matches)
        while matches:
            n, i, j = heappop(matches)
            n = -n
            taken = marks[0][i : i + n] | marks[1][j : j + n]
            if not taken.any():
                marks[0][i : i + n] = marks[1][j : j + n] = True
                found.append((n, i, j))
                continue
            # what is left of the run takes its turn among the others; pieces below s wait for a shorter search
            edge = np.flatnonzero(np.diff(np.concatenate(([1], taken.astype(np.int8), [1]))))
            for a, b in edge.reshape(-1, 2).tolist():
                if b - a >= s:
                    heappush(matches, (a - b, i + a, j + a))
        if s == min_match:
            break
        s = max(min_match, s // 2)
    return found


class Items:
    """Word hashes of a block of items, and their seeds by place: seed, item, place in the item."""

    def __init__(self, rows: list[tuple[int | None, str]], min_match: int):
        self.ids, self.words, seeds, home, place = [], [], [], [], []
        for item_id, text in rows:
            h = kernel.words(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])).hash
            if len(h) >= min_match:
                g = kernel.grams(h, min_match)
                seeds.append(g)
                home.append(np.full(len(g), len(self.ids)))
                place.append(np.arange(len(g)))
                self.ids.append(item_id)
                self.words.append(h)
        seeds, home, place = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((seeds, np.uint64), (home, np.int64), (place, np.int64)))
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.home, self.place = seeds[order], home[order], place[order]
        self.size = np.array([len(w) for w in self.words], np.int64)

    def judged(self, text: np.ndarray, seeds: np.ndarray, min_match: int, threshold: float) -> tuple[float, list[int | None]]:
        """The largest coverage of an item by a text with these seeds, and the ids of the items at the threshold. Tiles lie
        where seeds do, so the words under an item's shared seeds bound its coverage; an item whose bound
        is below the threshold and not above the largest coverage so far is not tiled."""
        left, right = np.searchsorted(self.seeds, seeds, "left"), np.searchsorted(self.seeds, seeds, "right")
        count = right - left
        at = np.repeat(left - np.cumsum(count) + count, count) + np.arange(count.sum())
        home, place = self.home[at], self.place[at]
        order = np.lexsort((place, home))
        home, place = home[order], place[order]
        begin = np.flatnonzero(np.concatenate(([True], home[1:] != home[:-1])))
        items = home[begin]
        step = np.minimum(np.diff(place, append=0), min_match)
        step[np.append(begin[1:], len(home)) - 1] = min_match  # the last seed of an item covers all its words
        bound = np.add.reduceat(step, begin) / self.size[items]
        best, hits = 0.0, []
        for k in np.argsort(-bound, kind="stable"):
            if bound[k] < threshold and bound[k] <= best:
                break
            n = sum(x[0] for x in tiles(text, self.words[items[k]], min_match))
            best = max(best, n / int(self.size[items[k]]))
            if n >= threshold * int(self.size[items[k]]):
                hits.append(self.ids[items[k]])
        return best, hits


def coverages(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, digest, coverage (the largest of any item), hit, items (ids at the threshold), one row for each block of items and
    each document that shares a seed with one of them."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), string_column(docs, "text").alias("text")).where("text is not null")
    rows = rows.withColumn("digest", F.md5(F.col("text").cast("binary")))
    items = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"),
        string_column(benchmark, "text").alias("text"),
    ).where("text is not null").distinct()
    chars = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n_blocks = -(-chars // BLOCK_CHARS) or 1
    out = None
    for block in range(n_blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block)
        held = spark.sparkContext.broadcast(Items([tuple(r) for r in own.collect()], min_match))  # about BLOCK_CHARS characters

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            items, at, best, hits = held.value, [], [], []
            for i, _, w in kernel.text_words(batch.column(1)):
                h, home = kernel.grams(w.hash, min_match), w.text
                if not len(h) or not len(items.seeds):
                    continue
                place = np.minimum(np.searchsorted(items.seeds, h), len(items.seeds) - 1)
                hit = np.flatnonzero((items.seeds[place] == h) & (home[: len(h)] == home[min_match - 1 :]))
                bounds = w.bounds()
                cut = np.searchsorted(home[hit], np.arange(len(bounds)))
                for t in np.unique(home[hit]):
                    one = items.judged(w.hash[bounds[t] : bounds[t + 1]], np.unique(h[hit[cut[t] : cut[t + 1]]]), min_match, threshold)
                    at.append(i + int(t))
                    best.append(one[0])
                    hits.append(one[1])
            at = pa.array(at, pa.int64())
            ids = [[k for k in x if k is not None] for x in hits]
            columns = [
                batch.column(0).take(at),
                batch.column(2).take(at),
                pa.array(best, pa.float64()),
                pa.array([bool(x) for x in hits], pa.bool_()),
                pa.array(ids, pa.list_(pa.int64())),
            ]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "coverage", "hit", "items"])

        part = map_batches(rows, run, "doc_id long, digest string, coverage double, hit boolean, items array<long>")
        part = written(part, "coverages")
        held.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def _flags(docs: DataFrame, benchmark: DataFrame, min_match: int, threshold: float) -> DataFrame:
    """One row for each text that shares a seed: equal texts of an id are one. Flags are broadcast up to a bound of their rows and of all their item ids."""
    found = coverages(docs, benchmark, min_match, threshold)
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_set("items"))))
    flags = found.groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).agg(
        F.max("coverage").alias("coverage"),
        ids.alias("items"),
        F.max("hit").alias("hit"),
    )
    flags = written(flags, "flags")
    size = flags.agg(F.count("*").alias("n"), F.sum(F.size("items")).alias("ids")).first()
    return F.broadcast(flags) if size.n + (size.ids or 0) <= BROADCAST_ROWS else flags


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, contaminated, coverage (the largest of any item), n_items and item_ids at the threshold."""
    flags = _flags(docs, benchmark, min_match, threshold)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce(string_column(docs, "text"), F.lit("")).cast("binary")).alias("digest"))
    out = rows.join(flags, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    items = F.coalesce("items", F.array().cast("array<bigint>"))
    return out.select(
        "doc_id",
        F.coalesce("hit", F.lit(False)).alias("contaminated"),
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
        F.size(items).cast("long").alias("n_items"),
        F.concat_ws(",", items.cast("array<string>")).alias("item_ids"),
    )


def clean_rows(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that are not contaminated."""
    flags = _flags(docs, benchmark, min_match, threshold).where("hit").select("_id", "_digest")
    digest = F.md5(F.coalesce(string_column(docs, "text"), F.lit("")).cast("binary"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("own_id"), digest.alias("own_digest"))
    return row.join(flags, F.col("own_id").eqNullSafe(F.col("_id")) & (F.col("own_digest") == F.col("_digest")), "left_anti").select("row.*")


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
