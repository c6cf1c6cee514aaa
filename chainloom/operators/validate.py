"""Schema rules as predicates: every rule gives rows that break it, never an exception."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canon import is_count, is_hash, is_id
from ..functions.digests import decoded_key, decoded_signature
from ..sources.ledger import ZERO

# The closed sets, bounds and fields of the schema.
OUTCOMES = ("SUCCEEDED", "FAILED", "UNKNOWN", "CANCELLED")
AVAILABILITY = ("INCLUDED", "WITHHELD", "UNAVAILABLE")
MEDIA = ("application/json", "application/octet-stream", "text/plain")
OPERATIONS = ("read", "write", "compute", "dispatch")
REASONS = ("SOURCE_ERROR", "DISPUTE")
METHODS = ("source.list", "revision.get", "lineage.get", "bundle.export", "object.get", "audit.export")
PROFILE, FORMAT = "proof-evidence/1", "proof-bundle/1"
# A foreign format is a name and a version; which of them a deployment takes is a parameter of event_rules().
FOREIGN = r"^[a-z][a-z0-9-]*/[0-9]+$"
MAX_PARENTS, MAX_OBJECTS, MAX_EVENT_BYTES, MAX_AUDIT_BYTES, MAX_OBJECT_BYTES, MAX_INVENTORY = 64, 16, 65_536, 4096, 1_048_576, 140_000
EVENT_FIELDS = {
    "v": "int",
    "workspace": "string",
    "source": "string",
    "stream": "string",
    "seq": "string",
    "prev": "string",
    "lamport": "string",
    "key": "string",
    "parents": "array",
    "data": "record",
}
AUDIT_FIELDS = {
    "v": "int",
    "workspace": "string",
    "seq": "string",
    "prev": "string",
    "key": "string",
    "principal": "string",
    "request": "string",
    "data": "record",
}
BUNDLE_FIELDS = {
    "v": "int", "format": "string", "workspace": "string", "revision": "string", "sources": "array", "actions": "array", "cuts": "array", "evidence": "string", "projection": "string",
    "inventory": "array", "disclosure": "string", "audit_through": "audit",
}
# By kind of event: the fields of its data beyond kind.
EVENT_DATA = {
    "RunOpened": {"run": "string", "intent": "object", "policy": "object|null", "hypothetical": "bool"},
    "StepOpened": {"run": "string", "step": "string", "operation": "string", "input": "object|null"},
    "ObservationRecorded": {"run": "string", "step": "string", "value": "object"},
    "StepClosed": {"run": "string", "step": "string", "outcome": "string", "observation": "event|null"},
    "DelegationOffered": {"run": "string", "delegation": "string", "child": "child", "scope": "string"},
    "DelegationAccepted": {"run": "string", "delegation": "string", "offer": "event", "scope": "string"},
    "EvidenceAttached": {"run": "string", "step": "string", "format": "string", "object": "object"},
    "RunClosed": {"run": "string", "outcome": "string"},
    "CorrectionNoted": {"target": "event", "replacement": "object", "reason": "string"},
}
# By kind of audit entry likewise.
AUDIT_DATA = {
    "WorkspaceCreated": {"config": "string", "revision": "string", "evidence": "string"},
    "SourceRegistered": {"source": "source", "revision": "string", "evidence": "string"},
    "ConfigActivated": {"previous": "string", "config": "string"},
    "ImportStaged": {"stage": "string", "batch": "string"},
    "ImportCommitted": {"stage": "string", "batch": "string", "revision": "string", "evidence": "string"},
    "ImportCancelled": {"stage": "string", "reason": "string"},
    "DisclosureRecorded": {"method": "string", "content": "string", "revision": "string|null"},
    "VerificationRecorded": {"bundle": "string", "trust": "string", "report": "string"},
    "KeyRotated": {"old": "string", "next": "key", "proof": "string"},
    "MigrationActivated": {"manifest": "string", "from_schema": "int", "to_schema": "int"},
}


def violations(df: DataFrame, rules: dict[str, Column], *keys: str) -> DataFrame:
    """keys and rule, one row for each broken rule. A rule whose value is null counts as broken."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return df.select(*keys, F.explode(F.array_compact(F.array(*broken))).alias("rule"))


def sorted_unique(items: Column) -> Column:
    """Whether an array stands in strictly rising order."""
    pairs = F.zip_with(
        F.slice(items, 1, F.greatest(F.size(items) - 1, F.lit(0))),
        F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))),
        lambda a, b: a < b,
    )
    return (F.size(items) < 2) | F.forall(pairs, lambda x: x)


def _enum(c: Column, values: tuple[str, ...]) -> Column:
    return F.coalesce(c.isin(*values), F.lit(False))


def has_fields(fields: Column, want: dict[str, str]) -> Column:
    """Whether a map from field to type (sources.bundles) is exactly what is wanted; `a|b` allows either type."""
    known = F.coalesce(F.size(F.map_keys(fields)) == len(want), F.lit(False))
    for name, types in want.items():
        known &= F.coalesce(fields[name].isin(*types.split("|")), F.lit(False))
    return known


def _by_kind(kind: Column, fields: Column, table: dict[str, dict[str, str]]) -> Column:
    rule = F.lit(False)
    for name, want in table.items():
        rule = F.when(kind == name, has_fields(fields, {"kind": "string"} | want)).otherwise(rule)
    return rule


def is_ref(r: Column) -> Column:
    return is_id(r["source"]) & is_id(r["stream"]) & is_count(r["seq"], 1) & is_hash(r["hash"])


def is_object(o: Column) -> Column:
    size = is_count(o["bytes"]) & (o["bytes"].try_cast("bigint") <= MAX_OBJECT_BYTES)
    return is_hash(o["digest"]) & size & _enum(o["media"], MEDIA)


def _optional(c: Column, ok: Column) -> Column:
    return c.isNull() | F.coalesce(ok, F.lit(False))


def event_rules(formats: tuple[str, ...] | None = None) -> dict[str, Column]:
    """Rules of typed events (sources.bundles.typed_events): fields and their types, identifiers, counts, the kind's own data,
    sorted parents, and bounds. Where the envelope's body is kept, counts are read from it as they were written."""
    written = lambda f: F.get_json_object("body", f"$.{f}")
    parents = F.transform(
        "parents",
        lambda p: F.struct(p["source"].alias("a"), p["stream"].alias("b"), p["seq"].try_cast("bigint").alias("c"), p["hash"].alias("d")),
    )
    kind = F.col("kind")
    return {
        "fields": has_fields(F.col("fields"), EVENT_FIELDS),
        "version": F.col("v") == 1,
        "workspace": is_id(F.col("workspace")),
        "source": is_id(F.col("source")),
        "stream": is_id(F.col("stream")),
        "seq": is_count(written("seq"), 1),
        "lamport": is_count(written("lamport"), 1),
        "prev": is_hash(F.col("prev")),
        "hash": is_hash(F.col("hash")),
        "key": is_hash(F.col("key")),
        "signature": decoded_signature(F.col("signature")).isNotNull(),
        "kind": _enum(kind, tuple(EVENT_DATA)),
        "data fields": ~_enum(kind, tuple(EVENT_DATA)) | _by_kind(kind, F.col("data_fields"), EVENT_DATA),
        "run": _optional(F.col("run"), is_id(F.col("run"))) & _optional(F.col("step"), is_id(F.col("step"))) & _optional(F.col("delegation"), is_id(F.col("delegation"))),
        "scope": _optional(F.col("scope"), is_hash(F.col("scope"))),
        "outcome": _optional(F.col("outcome"), _enum(F.col("outcome"), OUTCOMES)) & step_closed_rule(),
        "enums": _optional(F.col("operation"), _enum(F.col("operation"), OPERATIONS)) & _optional(F.col("format"), F.col("format").rlike(FOREIGN) if formats is None else _enum(F.col("format"), formats)) & _optional(F.col("reason"), _enum(F.col("reason"), REASONS)),
        "references": _optional(F.col("data_ref"), is_ref(F.col("data_ref"))) & F.forall("parents", is_ref),
        "objects": F.forall("objects", is_object) & (F.size("objects") <= MAX_OBJECTS),
        "parents": sorted_unique(parents) & (F.size("parents") <= MAX_PARENTS),
        "size": F.octet_length("body") <= MAX_EVENT_BYTES,
    }


def audit_rules() -> dict[str, Column]:
    """Rules of typed audit entries (sources.bundles.typed_audit)."""
    kind, optional = F.col("kind"), lambda c, rule: _optional(F.col(c), rule(F.col(c)))
    hashes = F.lit(True)
    for c in ("config", "previous", "evidence", "batch", "content", "old", "manifest", "verified_bundle", "trust", "report"):
        hashes &= optional(c, is_hash)
    revision = F.get_json_object("body", "$.data.revision")
    at_start = F.when(kind == "WorkspaceCreated", revision == "0").otherwise(_optional(revision, is_count(revision, 1)))
    proof = (kind != "KeyRotated") | (
        decoded_signature(F.col("proof")).isNotNull() & decoded_key(F.col("next.public")).isNotNull() & (
            F.sha2(decoded_key(F.col("next.public")), 256) == F.col("next.id")
        )
    )
    reason = (kind != "ImportCancelled") | _enum(F.col("reason"), ("USER", "EXPIRED"))
    return {
        "fields": has_fields(F.col("fields"), AUDIT_FIELDS),
        "version": F.col("v") == 1,
        "workspace": is_id(F.col("workspace")),
        "seq": is_count(F.get_json_object("body", "$.seq"), 1),
        "prev": is_hash(F.col("prev")),
        "hash": is_hash(F.col("hash")),
        "key": is_hash(F.col("key")),
        "principal": is_id(F.col("principal")) & is_id(F.col("request")),
        "signature": decoded_signature(F.col("signature")).isNotNull(),
        "kind": _enum(kind, tuple(AUDIT_DATA)),
        "data fields": ~_enum(kind, tuple(AUDIT_DATA)) | _by_kind(kind, F.col("data_fields"), AUDIT_DATA),
        "data": hashes & at_start & optional("stage", is_id) & reason & ((kind != "DisclosureRecorded") | _enum(F.col("method"), METHODS)),
        "registered": (kind != "SourceRegistered") | (is_id(F.col("source.id")) & is_id(F.col("source.namespace")) & (F.col("source.profile") == PROFILE)),
        "rotation": proof,
        "size": F.octet_length("body") <= MAX_AUDIT_BYTES,
    }


def bundle_rules() -> dict[str, Column]:
    """Rules of typed bundles (sources.bundles.typed_bundles)."""
    cut = lambda c: is_id(c["source"]) & is_id(c["stream"]) & is_count(c["through"]) & is_hash(c["head"]) & (
        (c["through"] == "0") == (c["head"] == ZERO)
    )
    item = lambda i: _enum(
        i["kind"],
        ("event", "audit", "key", "object"),
    ) & is_hash(i["digest"]) & is_count(i["bytes"]) & inventory_rule(i["kind"], i["availability"])
    return {
        "fields": has_fields(F.col("fields"), BUNDLE_FIELDS),
        "version": (F.col("v") == 1) & (F.col("format") == FORMAT),
        "workspace": is_id(F.col("workspace")) & is_count(F.col("revision")),
        "digests": is_hash(F.col("evidence")) & is_hash(F.col("projection")) & is_hash(F.col("hash")),
        "sources": F.forall("sources", lambda s: is_id(s["id"]) & is_id(s["namespace"]) & (s["profile"] == PROFILE)),
        "actions": (F.size("actions") > 0) & F.forall("actions", is_ref),
        "cuts": F.forall("cuts", cut),
        "inventory": F.forall("inventory", item) & (F.size("inventory") <= MAX_INVENTORY),
        "disclosure": _enum(F.col("disclosure"), ("FULL", "REDACTED", "HASHES_ONLY")),
        "audit_through": is_count(F.col("audit_through.seq")) & is_hash(F.col("audit_through.hash")),
    }


def pin_rules() -> dict[str, Column]:
    """Rules of key pins: role, source, stream, key, first, last, status."""
    scoped = F.col("source").isNotNull() & F.col("stream").isNotNull()
    bare = F.col("source").isNull() & F.col("stream").isNull()
    return {
        "role": _enum(F.col("role"), ("origin", "audit")),
        "scope": F.when(F.col("role") == "origin", scoped).otherwise(bare),
        "key": is_hash(F.col("key")),
        "interval": (F.col("first") >= 1) & (F.col("first") <= F.col("last")),
        "status": _enum(F.col("status"), ("ACTIVE", "RETIRED", "COMPROMISED")),
    }


def head_rules() -> dict[str, Column]:
    """Rules of head pins: role, source, stream, seq, hash."""
    return {
        "role": _enum(F.col("role"), ("origin", "audit")),
        "scope": pin_rules()["scope"],
        "hash": is_hash(F.col("hash")),
        "zero head": (F.col("seq") == 0) == (F.col("hash") == ZERO),
    }


def step_closed_rule() -> Column:
    """A step that succeeded or failed names an observation; any other names none."""
    return (F.col("kind") != "StepClosed") | (F.col("outcome").isin("SUCCEEDED", "FAILED") == F.col("observation").isNotNull())


def inventory_rule(kind: Column, availability: Column) -> Column:
    """Only objects may be missing."""
    return _enum(availability, AVAILABILITY) & ((kind == "object") | (availability == "INCLUDED"))


def inventory_rules() -> dict[str, Column]:
    return {"digest": is_hash(F.col("digest")), "availability": inventory_rule(F.col("kind"), F.col("availability"))}


def batch_repeats(events: DataFrame, keys: DataFrame, objects: DataFrame) -> DataFrame:
    """rule, n of what a batch holds twice: event hashes, key ids, object digests."""
    twice = lambda df, c, rule: df.groupBy(c).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
    out = twice(events, "hash", "event repeated").union(twice(keys, "id", "key repeated")).union(twice(objects, "digest", "object repeated"))
    return out.where("n > 0")


def backup_path_rule(path: Column) -> Column:
    """Relative ASCII paths without empty, `.` or `..` parts or backslashes."""
    parts = F.split(path, "/")
    return path.rlike(r"^[\x21-\x5B\x5D-\x7E]+$") & ~path.startswith("/") & ~F.exists(parts, lambda p: p.isin("", ".", ".."))


def lineage_request_rule(max_nodes: int, max_depth: int) -> bool:
    return 1 <= max_nodes <= 20_000 and 1 <= max_depth <= 4096


def within_limits(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """limit, most of the array columns that pass a bound."""
    sizes = df.agg(*[F.max(F.size(c)).alias(c) for c in limits])
    return sizes.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("limit"), F.col(c).alias("most"), F.lit(n).alias("bound")) for c, n in limits.items()])
        ).alias("x")
    ).select("x.*").where("most > bound")
