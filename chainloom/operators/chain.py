"""Stream structure: slots, forks, cuts, predecessors, parents and logical clocks.

All operators take a ledger (see sources.ledger) and shuffle it on the stream's own keys at most; a
check is one equi-join with a grouped form of the ledger, so skewed streams are split at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.ledger import ZERO

KEY = ["source", "stream", "seq"]


def slots(ledger: DataFrame) -> DataFrame:
    """source, stream, seq, n, hashes (sorted): the candidates of every slot."""
    return ledger.groupBy(*KEY).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("hash")).alias("hashes"))


def slot_forks(ledger: DataFrame) -> DataFrame:
    return slots(ledger).where("n > 1")


def cuts(ledger: DataFrame) -> DataFrame:
    """source, stream, through, head: the head is zero where the last slot is forked."""
    top = ledger.groupBy("source", "stream").agg(F.max("seq").alias("through"))
    last = slots(ledger).select("source", "stream", F.col("seq").alias("through"), "n", "hashes")
    return top.join(last, ["source", "stream", "through"]).select(
        "source",
        "stream",
        "through",
        F.when(F.col("n") == 1, F.col("hashes")[0]).otherwise(ZERO).alias("head"),
    )


def prev_check(ledger: DataFrame) -> DataFrame:
    """The ledger with prev_code (OK, PREV_MISMATCH, PREFIX_MISSING) and prev_lamport (of the candidate
    that prev names; 0 at the start of a stream; null where unresolved)."""
    before = ledger.groupBy("source", "stream", (F.col("seq") + 1).alias("seq")).agg(F.array_sort(F.collect_set(F.struct("hash", "lamport"))).alias("before"))
    joined = ledger.join(before, KEY, "left")
    own = F.get(F.filter("before", lambda b: b["hash"] == F.col("prev")), F.lit(0))["lamport"]
    first = F.col("seq") == 1
    code = F.when(
        first,
        F.when(F.col("prev") == ZERO, "OK").otherwise("PREV_MISMATCH"),
    ).when(F.col("before").isNull(), "PREFIX_MISSING").when(own.isNull(), "PREV_MISMATCH").otherwise("OK")
    return joined.select(*ledger.columns, code.alias("prev_code"), F.when(first, F.lit(0)).otherwise(own).cast("long").alias("prev_lamport"))


def parent_check(ledger: DataFrame, parents: DataFrame, strict_source: bool = False) -> DataFrame:
    """Each parent reference with ok and the parent's lamport. A parent on a stream of the child's
    name with a number not below the child's never counts, whatever its source, unless strict_source
    asks that the sources agree too. Where parents say themselves where their child stands (c_source,
    c_stream, c_seq), it is not looked up."""
    child = ledger.select(F.col("hash").alias("child"), F.col("source").alias("c_source"), F.col("stream").alias("c_stream"), F.col("seq").alias("c_seq"))
    target = ledger.select(*KEY, "hash", F.col("lamport").alias("p_lamport")).dropDuplicates([*KEY, "hash"])
    placed = parents if "c_seq" in parents.columns else parents.join(child, "child")
    refs = placed.join(target, [*KEY, "hash"], "left")
    forward = (F.col("stream") == F.col("c_stream")) & (F.col("seq") >= F.col("c_seq"))
    if strict_source:
        forward &= F.col("source") == F.col("c_source")
    return refs.withColumn("ok", ~forward & F.col("p_lamport").isNotNull())


def lamport_check(ledger: DataFrame, parents: DataFrame) -> DataFrame:
    """The ledger with prev_code, n_missing (bad parents) and lamport_code: OK, LAMPORT_INVALID,
    COUNTER_EXHAUSTED, or SKIPPED where the predecessor or a parent is unresolved."""
    return _clocked(ledger, parent_check(ledger, parents))


def _clocked(ledger: DataFrame, refs: DataFrame) -> DataFrame:
    by_child = refs.groupBy("child").agg(F.count_if(~F.col("ok")).alias("n_missing"), F.max(F.when(F.col("ok"), F.col("p_lamport"))).alias("p_lamport"))
    rows = prev_check(ledger).join(by_child.withColumnRenamed("child", "hash"), "hash", "left")
    known = F.col("prev_lamport").isNotNull() & (F.coalesce("n_missing", F.lit(0)) == 0)
    top = F.greatest(F.col("prev_lamport"), F.coalesce("p_lamport", F.lit(0)))
    code = F.when(~known, "SKIPPED").when(top == 2**63 - 1, "COUNTER_EXHAUSTED").when(F.col("lamport") == top + 1, "OK").otherwise("LAMPORT_INVALID")
    return rows.select(*ledger.columns, "prev_code", F.coalesce("n_missing", F.lit(0)).alias("n_missing"), code.alias("lamport_code"))


def unnamed_refs(data_refs: DataFrame, parents: DataFrame) -> DataFrame:
    """The references in events' data (child, source, stream, seq, hash) that are not among the child's parents, which an optional
    boolean column `named` may say."""
    if "named" in data_refs.columns:
        return data_refs.where("not named")
    return data_refs.join(parents.select("child", *KEY, "hash").distinct(), ["child", *KEY, "hash"], "left_anti")


def findings(ledger: DataFrame, parents: DataFrame, data_refs: DataFrame | None = None) -> DataFrame:
    """code, subjects (arrays of references, sorted) of all findings, each once. data_refs: references in
    events' data, which have to be among their parents."""
    own = F.struct(*KEY, "hash")
    forks = ledger.groupBy(*KEY).agg(F.array_sort(F.collect_set(own)).alias("subjects")).where(F.size("subjects") > 1)
    refs = parent_check(ledger, parents)
    checked = _clocked(ledger, refs)
    codes = F.array_compact(
        F.array(
            F.when(F.col("prev_code") != "OK", F.col("prev_code")),
            F.when(F.col("lamport_code").isin("LAMPORT_INVALID", "COUNTER_EXHAUSTED"), F.col("lamport_code")),
        )
    )
    single = checked.select(F.explode(codes).alias("code"), F.array(own).alias("subjects"))
    child = F.struct(F.col("c_source").alias("source"), F.col("c_stream").alias("stream"), F.col("c_seq").alias("seq"), F.col("child").alias("hash"))
    missing = refs.where("not ok").select(child.alias("c"), own.alias("r"))
    if data_refs is not None:
        of = ledger.select(F.col("hash").alias("child"), F.col("source").alias("c_source"), F.col("stream").alias("c_stream"), F.col("seq").alias("c_seq"))
        unnamed = unnamed_refs(data_refs, parents)
        unnamed = unnamed if "c_seq" in unnamed.columns else unnamed.join(of, "child")
        missing = missing.unionByName(unnamed.select(child.alias("c"), own.alias("r")))
    missing = missing.select(F.lit("PARENT_MISSING").alias("code"), F.array_sort(F.array_distinct(F.array("c", "r"))).alias("subjects"))
    return forks.select(F.lit("SOURCE_FORK").alias("code"), "subjects").unionByName(single).unionByName(missing).distinct()


def chain_findings(ledger: DataFrame, parents: DataFrame, data_refs: DataFrame | None = None) -> DataFrame:
    """findings() with the subjects as texts (source/stream/seq/hash), sorted as texts and joined by `;`."""
    text = F.transform("subjects", lambda r: F.concat_ws("/", *[r[c] for c in (*KEY, "hash")]))
    return findings(ledger, parents, data_refs).select("code", F.concat_ws(";", F.array_sort(text)).alias("subjects"))


def first_violation(ledger: DataFrame, parents: DataFrame) -> DataFrame:
    """source, stream, seq, code: the first broken predecessor or clock of each stream."""
    checked = lamport_check(ledger, parents)
    code = F.when(F.col("prev_code") != "OK", F.col("prev_code")).when(F.col("lamport_code") == "LAMPORT_INVALID", F.col("lamport_code"))
    bad = checked.withColumn("code", code).where("code is not null")
    return bad.groupBy("source", "stream").agg(F.min(F.struct("seq", "code")).alias("v")).select("source", "stream", "v.seq", "v.code")


def hash_chain(rows: DataFrame, tag: str = "chain") -> DataFrame:
    """stream, n, head: each link is the hash of the link before and its body, in order of seq. rows:
    stream, seq, body. A chain is sequential by definition; streams run side by side."""
    from ..functions.canon import domain_hash

    ordered = F.array_sort(F.collect_list(F.struct("seq", "body")))
    head = F.aggregate(ordered, F.lit(ZERO), lambda h, x: domain_hash(tag, F.concat(h, F.lit("/"), x["body"])))
    return rows.groupBy("stream").agg(F.count("*").alias("n"), head.alias("head"))


def predecessor_lag(ledger: DataFrame) -> DataFrame:
    """The form of prev_check for ledgers without forks: one window and no join."""
    w = Window.partitionBy("source", "stream").orderBy("seq")
    hash_, seq = F.lag("hash").over(w), F.lag("seq").over(w)
    code = F.when(
        F.col("seq") == 1,
        F.when(F.col("prev") == ZERO, "OK").otherwise("PREV_MISMATCH"),
    ).when(F.coalesce(seq != F.col("seq") - 1, F.lit(True)), "PREFIX_MISSING").when(hash_ == F.col("prev"), "OK").otherwise("PREV_MISMATCH")
    return ledger.withColumn("prev_code", code)
