"""Ledgers: event tables in the engine's shape, and the written tables they live in.

A ledger has source, stream, seq, prev, hash, lamport, kind, event_id; its parents table has one row a
reference: child (hash), source, stream, seq, hash. `from_events` derives both from any table of
(event_id, user_id, event_type): a stream a user, ordered by event_id. `perturbed` breaks a derived
ledger in fixed places, so that every check has something to find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import settle, spread, table

ZERO = "0" * 64


def from_events(events: DataFrame) -> DataFrame:
    """The clean ledger: seq from 1 in each stream, prev the hash before, lamport = seq."""
    order = Window.partitionBy("stream").orderBy("seq")
    rows = events.select(
        "event_id",
        "user_id",
        F.concat(F.lit("src"), F.col("user_id") % 4).alias("source"),
        F.concat(F.lit("u"), "user_id").alias("stream"),
        F.col("event_type").alias("kind"),
    )
    rows = rows.withColumn("seq", F.row_number().over(Window.partitionBy("stream").orderBy("event_id")).cast("long"))
    rows = rows.withColumn("hash", F.sha2(F.concat_ws("/", "source", "stream", "seq", "kind", "event_id"), 256))
    return rows.withColumn("prev", F.coalesce(F.lag("hash").over(order), F.lit(ZERO))).withColumn("lamport", F.col("seq"))


def perturbed(clean: DataFrame) -> DataFrame:
    """Drops every 97th event, forks every 89th, cuts prev at every 83rd, shifts every 79th clock."""
    kept = clean.where("event_id % 97 <> 0")
    bent = kept.withColumn(
        "prev",
        F.when(F.col("event_id") % 83 == 0, ZERO).otherwise(F.col("prev")),
    ).withColumn("lamport", F.col("lamport") + (F.col("event_id") % 79 == 0).cast("long"))
    fork = kept.where("event_id % 89 = 0").withColumn("hash", F.sha2(F.concat("hash", F.lit("fork")), 256)).withColumn("kind", F.lit("altered"))
    columns = ["source", "stream", "seq", "prev", "hash", "lamport", "kind", "event_id"]
    return bent.select(columns).unionByName(fork.select(columns))


def parents_of(clean: DataFrame, ledger: DataFrame) -> DataFrame:
    """Every 5th event names the event before its place in the next user's stream; some such
    references are broken (every 35th) or point forward in the own stream (every 55th)."""
    to = clean.select(F.col("source").alias("p_source"), F.col("stream").alias("p_stream"), F.col("seq").alias("p_seq"), F.col("hash").alias("p_hash"))
    child = ledger.where("event_id % 5 = 0").select(F.col("hash").alias("child"), "event_id", "seq", "stream")
    forward = F.col("event_id") % 55 == 0
    child = child.withColumn(
        "p_stream",
        F.when(forward, F.col("stream")).otherwise(F.concat(F.lit("u"), F.substring("stream", 2, 30).cast("long") + 1)),
    ).withColumn("p_seq", F.col("seq") + F.when(forward, 1).otherwise(-1))
    out = child.join(to, ["p_stream", "p_seq"])
    hash_ = F.when(F.col("event_id") % 35 == 0, F.sha2("p_hash", 256)).otherwise(F.col("p_hash"))
    return out.select("child", F.col("p_source").alias("source"), F.col("p_stream").alias("stream"), F.col("p_seq").alias("seq"), hash_.alias("hash"))


def load(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The perturbed ledger of the events table, and its parents."""
    events = table(spark, sf_dir, "events")
    spread(events)
    clean = from_events(events)
    ledger = perturbed(clean)
    return ledger, parents_of(clean, ledger)


def settled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The perturbed ledger, its parents and the clean ledger, for what reads them more than once: the events are scanned and
    numbered once, and clean ledger and parents stand in written tables."""
    events = table(spark, sf_dir, "events")
    spread(events)
    clean = settle(from_events(events), "clean")
    ledger = perturbed(clean)
    return ledger, settle(parents_of(clean, ledger), "parents"), clean


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The perturbed ledger over written events, for what reads it more than once and needs no parents."""
    events = table(spark, sf_dir, "events")
    spread(events)
    return perturbed(settle(from_events(events), "clean"))
