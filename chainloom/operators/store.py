"""Publishing: batches, revisions, idempotent requests and stages over Parquet tables.

Tables only grow; a revision publishes what is new in it (sources.tables), and membership is one number on an
event, the first revision that holds it, instead of a copy of all members with every revision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.ledger import ZERO
from .chain import KEY


def commit_tallies(retained: DataFrame, batch: DataFrame) -> DataFrame:
    """added, duplicates, conflicts of a batch: new hashes; hashes that are held already; and new
    events whose slot was taken, by a retained event or one earlier in the batch (so: new events less
    newly opened slots)."""
    known = retained.select("hash").distinct().withColumn("_held", F.lit(1))
    rows = batch.join(known, "hash", "left")
    new = rows.where("_held is null").dropDuplicates(["hash"])
    taken = retained.select(*KEY).distinct().withColumn("_taken", F.lit(1))
    opened = new.join(taken, KEY, "left").groupBy(*KEY).agg(F.count("*").alias("n"), F.max("_taken").alias("taken"))
    totals = opened.agg(F.sum("n").alias("added"), F.sum(F.col("n") - F.when(F.col("taken").isNull(), 1).otherwise(0)).alias("conflicts"))
    both = rows.agg(F.count("*").alias("rows")).crossJoin(totals)  # one row by one row
    added = F.coalesce("added", F.lit(0))
    return both.select(added.alias("added"), (F.col("rows") - added).alias("duplicates"), F.coalesce("conflicts", F.lit(0)).alias("conflicts"))


def retain(retained: DataFrame, batch: DataFrame, revision: int) -> DataFrame:
    """Retained events and the batch's new ones, with the first revision that holds each."""
    new = batch.dropDuplicates(["hash"]).join(retained.select("hash"), "hash", "left_anti").withColumn("first_revision", F.lit(revision).cast("long"))
    return retained.unionByName(new.select(retained.columns))


def members(events: DataFrame, revision: int | Column) -> DataFrame:
    """The events of a revision."""
    return events.where(F.col("first_revision") <= revision)


def revision_counts(events: DataFrame, revisions: DataFrame) -> DataFrame:
    """revision, n_events of every revision: counts by first revision, then a running sum."""
    from pyspark.sql import Window

    per = events.groupBy(F.col("first_revision").alias("revision")).agg(F.count("*").alias("n"))
    joined = revisions.select("revision").join(per, "revision", "left")
    return joined.select("revision", F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("revision")).alias("n_events"))


def idempotency(requests: DataFrame) -> DataFrame:
    """principal, request, n, code: requests under one id with one body replay, with two conflict."""
    return requests.groupBy("principal", "request").agg(F.count("*").alias("n"), F.count_distinct("body").alias("k")).select(
        "principal",
        "request",
        "n",
        F.when(F.col("k") > 1, "IDEMPOTENCY_CONFLICT").when(F.col("n") > 1, "REPLAYED").otherwise("NEW").alias("code"),
    )


def effective_clock(floor: Column, now: Column) -> Column:
    """The wall clock, never before the persisted floor."""
    return F.greatest(floor, now)


def stage_state(stages: DataFrame, events: DataFrame, ttl_ms: int) -> DataFrame:
    """stage, state: the first terminal event (COMMITTED, CANCELLED: stage, kind, at_ms) wins; without
    one a stage whose effective clock has passed its time is EXPIRED, any other STAGED. stages: stage,
    created_ms, floor_ms, now_ms."""
    end = events.groupBy("stage").agg(F.min_by("kind", F.struct("at_ms", "kind")).alias("end"))
    late = effective_clock(F.col("floor_ms"), F.col("now_ms")) - F.col("created_ms") >= ttl_ms
    return stages.join(end, "stage", "left").select("stage", F.coalesce("end", F.when(late, "EXPIRED").otherwise("STAGED")).alias("state"))


def admit(batch: DataFrame, keys: DataFrame, objects: DataFrame, refs: DataFrame, sources: DataFrame) -> DataFrame:
    """rule, n: what a batch breaks: events of unknown sources, without their key, keys that no event
    uses, blobs that no event refers to, hashes that come twice. refs: hash, digest."""
    count = lambda df, rule: df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
    out = count(batch.join(sources.select("source").distinct(), "source", "left_anti"), "unknown source")
    out = out.union(count(batch.join(keys.select("key").distinct(), "key", "left_anti"), "key missing"))
    out = out.union(count(keys.join(batch.select("key").distinct(), "key", "left_anti"), "key unused"))
    out = out.union(
        count(
            objects.join(refs.join(batch.select("hash"), "hash", "left_semi").select("digest").distinct(), "digest", "left_anti"),
            "blob unreferenced",
        )
    )
    out = out.union(count(batch.groupBy("hash").count().where("count > 1"), "hash repeated"))
    return out.where("n > 0")


def audit_head(entries: DataFrame) -> DataFrame:
    """workspace, seq, hash of each workspace's last entry."""
    return entries.groupBy("workspace").agg(F.max(F.struct("seq", "hash")).alias("h")).select("workspace", "h.seq", "h.hash")


def audit_prefix(entries: DataFrame, through: int) -> DataFrame:
    """The entries up to a number, which the scan prunes by."""
    return entries.where(F.col("seq") <= through)


def lookup(rows: DataFrame, **keys) -> DataFrame:
    """The rows with these values in these columns; nulls are values."""
    for column, value in keys.items():
        rows = rows.where(F.col(column).eqNullSafe(F.lit(value)))
    return rows


def exploded(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The bridges of new typed events: event_parents (child and the parent's reference) and event_objects (hash, digest, bytes, media)."""
    events = events.dropDuplicates(["hash"])
    parents = events.select(F.col("hash").alias("child"), F.explode("parents").alias("p")).select(
        "child",
        "p.source",
        "p.stream",
        F.col("p.seq").cast("long").alias("seq"),
        "p.hash",
    )
    objects = events.select("hash", F.explode("objects").alias("o")).select("hash", "o.digest", F.col("o.bytes").cast("long").alias("bytes"), "o.media")
    return parents, objects


def object_read(spark, path: str, events: DataFrame, digest: str) -> DataFrame:
    """digest, content, intact of an object that some of these events refer to; no row where none does."""
    from ..sources.tables import read_objects

    held = lookup(read_objects(spark, path), digest=digest)
    return held.join(exploded(events)[1].select("digest").distinct(), "digest", "left_semi")


def _publish(spark, root: str, workspace: str, signer: str, expected: int, request: str, data, events=None, source=None, keys=None) -> int:
    """Publishes what is new as the workspace's revision after `expected` (-1 before the first): events or a source, the revision's
    row (evidence root and projection digest over all events) and a signed audit entry that binds them. data: from
    revision and evidence root to the entry's data as canonical JSON (a column)."""
    from ..plans import verify as plan
    from ..session import settle
    from ..sources import histories, tables
    from . import evidence

    one = spark.createDataFrame([(workspace,)], "bundle string")
    named = lambda df: df.withColumn("bundle", F.lit(workspace))
    held = tables.published(spark, root, "events")
    every = events if held is None else held if events is None else held.unionByName(events)
    known = tables.published(spark, root, "sources")
    sources = source if known is None else known if source is None else known.unionByName(source)
    none = spark.createDataFrame([], "id string, namespace string, profile string")
    if every is None:
        every = histories._typed(spark.createDataFrame([], histories.SEALED), "event")
    keys = spark.createDataFrame([], "id string, public string") if keys is None else keys.select("id", "public")
    roots = evidence.evidence_roots(one, named(sources if sources is not None else none), every, named(keys), evidence.object_refs(every))
    found = roots.first().evidence
    projected = plan.declared_projections(one, every, settle(plan.qualified(every), "ledger")).first().projection
    log = tables.published(spark, root, "audit")
    last = None if log is None else audit_head(log.withColumn("workspace", F.lit(workspace))).first()
    seq, prev, revision = (last.seq + 1, last.hash, expected + 1) if last else (1, ZERO, expected + 1)
    key = histories.key_material(spark, [signer]).first()
    rest = f',"key":"{key.id}","prev":"{prev}","principal":"{signer}","request":"{request}","seq":"{seq}","v":1,"workspace":"{workspace}"}}'
    template = spark.range(1).select(
        F.lit(workspace).alias("bundle"),
        F.lit(seq).cast("long").alias("place"),
        F.concat(F.lit('{"data":'), data(revision, found), F.lit(rest)).alias("template"),
        F.lit(signer).alias("signer"),
        F.lit(False).alias("alters"),
    )
    entry = histories._typed(histories.sealed(template, "audit"), "audit")
    row = spark.createDataFrame([(revision, found, projected, every.count(), seq)], "revision long, evidence string, projection string, n_events long, audit_seq long")
    new = {"audit": entry, "revisions": row} | ({} if events is None else {"events": events}) | ({} if source is None else {"sources": source})
    return tables.publish(spark, root, expected + 1, **new) - 1


def _data(**fields: str):
    from ..functions.canon import canonical

    return canonical({k: F.lit(v) for k, v in fields.items()})


def init_workspace(spark, root: str, workspace: str, signer: str, config: str = ZERO, request: str = "init") -> int:
    """Publishes revision 0, which creates the workspace."""
    made = lambda revision, found: _data(kind="WorkspaceCreated", config=config, revision=str(revision), evidence=found)
    return _publish(spark, root, workspace, signer, -1, request, made)


def register_source(spark, root: str, workspace: str, signer: str, expected: int, source: dict[str, str], request: str = "register") -> int:
    """Publishes a source (id, namespace, profile) as the revision after `expected`; one that is registered just so is left as it is, and
    another under its id raises."""
    from ..functions.canon import canonical
    from ..sources import tables

    known = tables.published(spark, root, "sources")
    same = None if known is None else lookup(known, id=source["id"]).first()
    if same is not None:
        if same.asDict() != source:
            raise tables.ObjectConflict("SOURCE_CONFLICT")
        return tables.latest_revision(spark, root) - 1
    row = spark.createDataFrame([(source["id"], source["namespace"], source["profile"])], "id string, namespace string, profile string")

    def made(revision: int, found: str) -> Column:
        told = canonical({k: F.lit(v) for k, v in source.items()})
        return F.concat(F.lit(f'{{"evidence":"{found}","kind":"SourceRegistered","revision":"{revision}","source":'), told, F.lit("}"))

    return _publish(spark, root, workspace, signer, expected, request, made, source=row)


def commit_batch(
    spark, root: str, workspace: str, batch: DataFrame, keys: DataFrame, expected: int, signer: str, stage: str = "stage", request: str = "commit"
) -> tuple[int, dict[str, int]]:
    """Commits a batch of typed events (see sources.bundles) as the revision after `expected`, and gives the revision and its
    tallies. keys: id, public of all events; signer: name of the audit key (sources.histories). What stays out when
    this fails is invisible, and a retry may follow."""
    from ..functions.digests import digest
    from ..session import settle
    from ..sources import tables

    held = tables.published(spark, root, "events")
    own = batch.withColumn("bundle", F.lit(workspace))
    known = own.limit(0) if held is None else held
    tallies = commit_tallies(known, own).first().asDict()
    new = settle(own.dropDuplicates(["hash"]).join(known.select("hash"), "hash", "left_anti").select(own.columns), "new-events")
    content = own.groupBy().agg(F.array_join(F.array_sort(F.collect_set("hash")), ",").alias("text"))  # a batch is bounded as a bundle is
    batch_hash = content.select(digest("batch", F.col("text"))).first()[0]
    made = lambda revision, found: _data(kind="ImportCommitted", stage=stage, batch=batch_hash, revision=str(revision), evidence=found)
    return _publish(spark, root, workspace, signer, expected, request, made, events=new, keys=keys), tallies
