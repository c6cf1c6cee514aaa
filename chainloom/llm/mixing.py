"""Mixing sources to target weights (operator 7): capped water-filling.

Every source has a weight and may give at most `max_epochs` times its words. The shared level at
which weight * level, stopped at each cap, adds up to all words is found in closed form over the
sources sorted by cap per weight. A source's target then is so many whole repetitions of all its
documents and a fraction of one more; the fraction goes to the first documents in the order of a
seeded digest, up to the one whose middle passes the wanted words. So the words taken miss the
target by half a document at most, and reruns agree.

The order within a source is resolved in two steps, so that no task sorts a whole source: sizes are
added up by source and digest bucket (with partial sums before the shuffle), and only the one
bucket of each source in which the fraction ends is sorted. DataFrame functions only.

Defined results: a null source is a source of its own, last in order; a null or empty text has size
0 and takes 0 words; repeated rows count each; rows with a null id are ordered by their texts' digests; an empty table
gives an empty result. The documents' columns are carried in one struct, so extra columns and their
names do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import string_column, table, written

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Sources up to this number are broadcast with their targets; beyond it the join shuffles.
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size -> also target. The windows have one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    by_level = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everywhere = Window.partitionBy()
    return (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("level", (F.sum("source_size").over(everywhere) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everywhere))
        .select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")).alias("target"))
    )


def text_digest(docs: DataFrame) -> Column:
    """What orders rows without an id, so that these do not share one place."""
    return F.when(string_column(docs, "doc_id").isNull(), F.md5(string_column(docs, "text").cast("binary")))


def _sized(docs: DataFrame, size: Column, digest: Column, seed: int) -> DataFrame:
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(string_column(docs, "doc_id"), digest, F.lit(""))).cast("binary"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(
        row.alias("row"),
        string_column(docs, "source").alias("source"),
        string_column(docs, "doc_id").alias("id"),
        size.alias("size"),
        key.alias("key"),
    ).withColumn("bucket", F.substring("key", 1, 4))


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: size, target, whole repetitions, and the bucket in which the fraction
    ends with the words that stand before it."""
    parts = written(sized.groupBy("source", "bucket").agg(F.sum("size").alias("size")), "mix-buckets")
    targets = water_fill(parts.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    targets = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    targets = targets.withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))
    if small := parts.select("source").distinct().count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        parts.withColumn("before", F.coalesce(F.sum("size").over(running), F.lit(0)))
        .join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        .groupBy("source", "source_size", "target", "whole", "part")
        .agg(F.max(F.when(F.col("before") < F.col("part"), F.struct("bucket", "before"))).alias("last"))
        .select(F.col("source").alias("_source"), "source_size", "target", "whole", "part", F.coalesce("last.bucket", F.lit("")).alias("end"), F.coalesce("last.before", F.lit(0)).alias("before"))
    )
    ends = written(ends, "mix-plan")
    return F.broadcast(ends) if small else ends


def with_copies(docs: DataFrame, size: Column, digest: Column, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 7) -> DataFrame:
    """row (the document's columns), size, source_size, target, copies (0 to max_epochs)."""
    sized = _sized(docs, size, digest, seed)
    dealt = sized.join(plan(sized.select("source", "bucket", "size"), weights, max_epochs), F.col("source").eqNullSafe(F.col("_source")))
    inner = Window.partitionBy("_source").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = dealt.where("bucket = end").withColumn("at", F.coalesce(F.sum("size").over(inner), F.lit(0)) + F.col("before"))
    last = last.withColumn("more", F.col("at") + F.col("size") / 2 < F.col("part"))
    rest = dealt.where("bucket <> end").withColumn("more", F.col("bucket") < F.col("end"))
    pick = lambda x: x.select("row", "size", "source_size", "target", (F.col("whole") + F.col("more").cast("long")).alias("copies"))
    return pick(rest).unionByName(pick(last))


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken. Word counts are taken once and written."""
    sizes = written(
        docs.select(
            F.col("doc_id"),
            string_column(docs, "source").alias("source"),
            n_words(string_column(docs, "text")).alias("n"),
            text_digest(docs).alias("digest"),
        ),
        "mix-sizes",
    )
    out = with_copies(sizes, F.col("n"), F.col("digest"))
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 7) -> DataFrame:
    """The mixed documents: each row as often as the mix takes it, with the columns of docs."""
    out = with_copies(docs, n_words(string_column(docs, "text")), text_digest(docs), weights, max_epochs, seed)
    return out.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('7:' || coalesce(doc_id::VARCHAR, md5(text), '')) AS key
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, source_size * 3 AS cap FROM src),
ranked AS (SELECT *, cap / weight AS ratio FROM weighed),
levels AS (
  SELECT *, ((sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE) AS level
  FROM ranked),
targets AS (
  SELECT source, source_size, least(cap::DOUBLE, weight * (SELECT max(level) FROM levels WHERE level <= ratio)) AS target FROM levels),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
placed AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS part,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id::VARCHAR NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begun
  FROM sized d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN begun + size / 2 < part THEN 1 ELSE 0 END))::BIGINT AS taken FROM placed
"""
