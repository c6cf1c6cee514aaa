import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from chainloom.llm import quality
from chainloom.llm.queries import op8_quality_rules

from .conftest import TEXTS


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_statistics_match_brute_force():
    real = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    texts = TEXTS + real
    got = quality.statistics(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert tuple(int(got[k][i]) for k in quality.STATS) == brute(text), i


def test_query_keeps_good_rows(spark, data):
    rows = {r.doc_id: r for r in op8_quality_rules(spark, data).collect()}
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{data}/documents.parquet").to_pylist()}
    assert rows.keys() == docs.keys()
    for i, r in rows.items():
        stats = brute(docs[i])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == stats
        assert r.base_failed == (stats[0] < 50 or 100 * stats[4] > 50 * stats[0])
        assert not (r.base_failed and r.kept)


def test_labelled_rows_are_told_apart(spark):
    data = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in op8_quality_rules(spark, data).collect()}
    labels = pq.read_table(f"{data}/labels.parquet").to_pylist()
    good = [rows[x["doc_id"]] for x in labels if x["quality"]]
    bad = [rows[x["doc_id"]] for x in labels if not x["quality"]]
    assert np.mean([r.kept or r.base_failed for r in good]) >= 0.99
    assert np.mean([r.kept for r in bad]) <= 0.05 and len(bad) > 50


def test_trees_by_a_naive_walk(spark, data):
    """Every score of the query: the mean path of a row down all trees, a node at a time."""
    from chainloom.llm.runtime import table

    stats = quality.document_statistics(table(spark, data, "documents"))
    model = quality.fit(stats, table(spark, data, "labels"))
    scores = {r.doc_id: (r.score, r.kept, r.base_failed) for r in op8_quality_rules(spark, data).collect()}
    f = model.forest
    for r in stats.collect():
        n, chars = max(r.n_words, 1), max(r.word_chars, 1)
        x = (r.n_symbols / n, r.n_upper / chars, r.n_repeat_words / n, chars / n)
        total = 0.0
        for t in range(len(f.feature)):
            node = 0
            while f.feature[t][node] >= 0:
                node = f.left[t][node] + (x[f.feature[t][node]] >= f.value[t][node])
            total += f.value[t][node]
        score, kept, failed = scores[r.doc_id]
        want = 2 ** (-total / len(f.feature) / f.norm)
        assert abs(score - want) < 1e-9 and kept == (not failed and score < model.threshold)


def test_edges(spark, odd_docs):
    labels = spark.createDataFrame([(1, None), (None, 1), (5, 0)], "doc_id long, quality int")
    rows = quality.quality_rules(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.base_failed and not r.kept for r in rows if r.doc_id in (0, 1, 2))
    assert quality.quality_rules(odd_docs.limit(0), labels.limit(0)).count() == 0
    assert quality.kept_rows(odd_docs.drop("text"), labels).count() == 0
    from pyspark.sql import functions as F

    typed = odd_docs.withColumn("text", F.col("text").cast("binary"))
    assert quality.kept_rows(typed, labels).schema == typed.schema and quality.kept_rows(typed, labels).count() == quality.kept_rows(odd_docs, labels).count()


def test_all_labelled_rows_set_the_threshold(spark):
    n = 10_000
    rows = spark.range(n).selectExpr("id AS doc_id", "100L AS n_words", "500L AS word_chars", "IF(id % 100 = 0, 90L, id % 7) AS n_symbols", "0L AS n_dup_lines", "0L AS n_repeat_words", "3L AS n_upper")
    labels = spark.range(n).selectExpr("id AS doc_id", "IF(id % 100 = 0, 0, 1) AS quality")
    model = quality.fit(rows, labels)
    frame = rows.toPandas()
    score = model.forest.score(quality.features({k: frame[k].to_numpy() for k in quality.STATS + quality.RATES}))
    assert abs(model.threshold - quality.calibrate(score, (frame["doc_id"] % 100 != 0).to_numpy())) < 2 / quality.LEVELS
    few = quality.fit(rows, labels.where("doc_id % 100 = 0 or xxhash64(doc_id, 8) > 9000000000000000000"))
    assert few.threshold != 0.65
    counted = quality.fit(rows, labels.withColumn("quality", (labels["quality"] * 0).cast("int")))
    assert counted.threshold == 0.65
