"""Every stage against a brute-force version over its own input, and the whole against its stages."""

from collections import Counter


import corpus_pipeline
from chainloom.llm import decontam, mixing, quality
from chainloom.llm.runtime import table, written

from .test_decontam import naive
from .test_near_dup import brute as components
from .test_token_store import expected


def test_stages(spark, data):
    docs = table(spark, data, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert [n.split()[0] for n in stages] == ["quality", "near-duplicate", "benchmark", "source", "token"]
    before = docs.collect()

    after = written(stages["quality rules"](spark, docs, data), "t")
    judged = {r.doc_id for r in quality.quality_rules(docs, table(spark, data, "labels")).where("kept").collect()}
    assert {r.doc_id for r in after.collect()} == judged and after.columns == docs.columns
    docs, before = after, after.collect()

    after = written(stages["near-duplicate removal"](spark, docs, data), "t")
    kept = [d for d, _, _, k in components([(r.doc_id, r.text) for r in before]) if k]
    assert sorted(r.doc_id for r in after.collect()) == sorted(kept)
    docs, before = after, after.collect()

    after = written(stages["benchmark decontamination"](spark, docs, data), "t")
    items = [r.text.lower().split() for r in table(spark, data, "benchmark").collect()]
    left = {r.doc_id for r in after.collect()}
    for r in before:
        words = r.text.lower().split()
        seen = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        near = [t for t in items if len(t) >= 5 and any(tuple(t[i : i + 5]) in seen for i in range(len(t) - 4))]
        assert (r.doc_id in left) == (not any(naive(words, t, 5) >= decontam.THRESHOLD * len(t) for t in near))
    docs = after

    after = written(stages["source mixing"](spark, docs, data), "t")
    report = {r.doc_id: r.taken // r.size if r.size else 0 for r in mixing.mix_report(docs).collect()}
    assert Counter(r.doc_id for r in after.collect()) == {d: n for d, n in report.items() if n}
    assert after.columns == docs.columns

    out = stages["token output"](spark, after, data).collect()
    assert sorted(tuple(r) for r in out) == expected(sorted((r.doc_id, r.text) for r in after.collect()))
    whole = corpus_pipeline.run(spark, data).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, out))


def test_empty_table_and_null_rows(spark, data):
    docs = table(spark, data, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, None, "s", 0), (1, "a b", "en", None, 3), (1, "a b", "en", None, 3)], docs.schema)
    for start in (docs.limit(0), odd):
        rows = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = written(stage(spark, rows, data), "t")
            assert rows.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, rows, data).count() == rows.count()


def test_clashing_columns_stay(spark, data):
    from pyspark.sql import functions as F

    docs = table(spark, data, "documents").where("doc_id < 40")
    names = ["row", "kept", "score", "label", "size", "node", "class", "digest", "_id", "coverage", "bucket"]
    rows = docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    want = {r.doc_id for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = written(stage(spark, rows, data), "t")
        assert rows.columns == [*docs.columns, *names]
        assert all([r[n] for n in names] == list(range(len(names))) and r.doc_id in want for r in rows.collect())
    assert rows.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, rows, data).count() == rows.count()
