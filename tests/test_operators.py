import tempfile

import pytest
from pyspark.sql import functions as F

from chainloom.operators import audit, chain, graph, inventory, replay, store, trust, validate
from chainloom.plans.queries import run_events
from chainloom.sources import tables
from chainloom.sources.ledger import ZERO, from_events, table
from chainloom.streaming.ordered_replay import streaming_replay

DATA = "/root/testdata/sf0.001"
DIAMOND = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_diamond_closure_and_limits(spark):
    links = frame(spark, DIAMOND, "src string, dst string")
    got = {(r.node, r.depth) for r in graph.ancestors(links, frame(spark, [("d",)], "node string")).collect()}
    assert got == {("d", 0), ("b", 1), ("c", 1), ("a", 2)}
    with pytest.raises(graph.LimitError):
        graph.ancestors(links, frame(spark, [("d",)], "node string"), max_depth=1)
    with pytest.raises(graph.LimitError):
        graph.ancestors(links, frame(spark, [("d",)], "node string"), max_nodes=3)
    long = frame(spark, [(str(i), str(i + 1)) for i in range(30)] + [("0", "30")], "src string, dst string")
    depth = {r.node: r.depth for r in graph.ancestors(long, frame(spark, [("30",)], "node string")).collect()}
    assert depth["0"] == 1 and depth["1"] == 29 and len(depth) == 31


def test_segments_reach_what_single_steps_reach(spark):
    """reached() over segments against ancestors() over single links, in random histories with forks, gaps and cross links."""
    import random

    rng = random.Random(3)
    rows, refs = [], []
    for s in range(6):
        last = [ZERO]
        for seq in range(1, 15):
            if rng.random() < 0.1:
                last = ["gone"]
                continue
            own = [f"{s}-{seq}-{k}" for k in range(1 + (rng.random() < 0.15))]
            rows += [("src", f"m{s}", seq, rng.choice(last), h, seq) for h in own]
            last = own
    slots = {(r[1], r[2]): r for r in rows}
    for _, stream, seq, _, h, _ in rows:
        if rng.random() < 0.4:
            p = slots[rng.choice(sorted(slots))]
            if (p[1] != stream or p[2] < seq) and p[4] != h:
                refs.append((h, *p[:3], p[4]))
    ledger = frame(spark, rows, "source string, stream string, seq long, prev string, hash string, lamport long").withColumn("kind", F.lit("k")).cache()
    parents = frame(spark, refs, "child string, source string, stream string, seq long, hash string").cache()
    known = graph.edges(ledger, parents).join(ledger.select(F.col("hash").alias("src")), "src", "left_semi").collect()
    for actions in (["0-14-0"], [r[4] for r in rows if r[2] == 7], [rows[0][4]]):
        want, todo = set(), [a for a in actions if any(r[4] == a for r in rows)]
        while todo:
            h = todo.pop()
            if h not in want:
                want.add(h)
                todo += [e.src for e in known if e.dst == h]
        got = {r.node for r in graph.reached(ledger, parents, frame(spark, [(a,) for a in actions], "node string")).collect()}
        assert got == want


def test_topological_order_and_cycles(spark):
    nodes = frame(spark, [("g", x) for x in "abcdexy"], "component string, node string")
    links = frame(spark, [*DIAMOND, ("x", "y"), ("y", "x"), ("x", "e")], "src string, dst string")
    got = [r.node for r in graph.topological_order(nodes, links).orderBy("position").collect()]
    assert got == ["a", "b", "c", "d", "e", "x", "y"]
    assert {r.node for r in graph.cycle_members(links).collect()} == {"x", "y"}
    assert graph.cycle_members(frame(spark, DIAMOND, "src string, dst string")).count() == 0


def test_findings_of_a_small_history(spark):
    rows = [
        ("s", "m", 1, ZERO, "h1", 1),
        ("s", "m", 2, "h1", "h2", 2),
        ("s", "m", 2, "h1", "h2b", 2),
        ("s", "m", 4, "h3", "h4", 3),
        ("s", "n", 1, "h1", "n1", 2),
        ("t", "m", 3, "x", "t3", 9),
    ]
    ledger = frame(spark, rows, "source string, stream string, seq long, prev string, hash string, lamport long").withColumn("kind", F.lit("k"))
    parents = frame(
        spark,
        [("n1", "s", "m", 1, "h1"), ("h2", "t", "m", 3, "t3"), ("h4", "s", "m", 4, "h4")],
        "child string, source string, stream string, seq long, hash string",
    )
    codes = sorted(r.code for r in chain.chain_findings(ledger, parents).collect())
    assert codes == ["PARENT_MISSING", "PARENT_MISSING", "PREFIX_MISSING", "PREFIX_MISSING", "PREV_MISMATCH", "SOURCE_FORK"]
    strict = {r.child: r.ok for r in chain.parent_check(ledger, parents, strict_source=True).collect()}
    assert strict == {"n1": True, "h2": True, "h4": False}
    cuts = {(r.source, r.stream): (r.through, r.head) for r in chain.cuts(ledger).collect()}
    assert cuts == {("s", "m"): (4, "h4"), ("s", "n"): (1, "n1"), ("t", "m"): (3, "t3")}


def test_legal_outcomes():
    ok = replay.legal_outcome
    assert ok("SUCCEEDED", ["SUCCEEDED"]) and not ok("SUCCEEDED", []) and not ok("SUCCEEDED", ["SUCCEEDED", "FAILED"])
    assert ok("FAILED", ["FAILED", "UNKNOWN"]) and not ok("UNKNOWN", ["FAILED", "UNKNOWN"]) and ok(
        "CANCELLED",
        ["CANCELLED", "SUCCEEDED"],
    ) and not ok("CANCELLED", [None, "CANCELLED"])


def test_trust(spark):
    schema = "role string, source string, stream string, key string, first long, last long, status string"
    pins = frame(
        spark,
        [("origin", "s", "m", "k", 1, 9, "ACTIVE"), ("origin", "s", "m", "k", 20, 30, "ACTIVE"), ("audit", None, None, "a", 1, 5, "ACTIVE")],
        schema,
    )
    records = frame(
        spark,
        [("s", "m", 9, "k"), ("s", "m", 25, "k"), ("s", "m", 1, "z"), ("s", "q", 1, "k")],
        "source string, stream string, seq long, key string",
    )
    assert [
        r.key_code for r in trust.key_check(records, pins).orderBy("stream", "key", "seq").collect()
    ] == ["OK", "KEY_INTERVAL", "KEY_UNPINNED", "KEY_UNPINNED"]
    heads = frame(spark, [("origin", "s", "m", 3, "h"), ("origin", "s", "m", 3, "g")], "role string, source string, stream string, seq long, hash string")
    assert {r.problem for r in trust.trust_problems(pins, heads).collect()} == {"head conflict"}
    bad = pins.unionByName(frame(spark, [("origin", "s", "m", "a", 5, 6, "ACTIVE")], schema))
    assert {r.problem for r in trust.trust_problems(bad, heads.limit(1)).collect()} == {"interval overlap", "key in two roles"}
    checked = trust.audit_key_check(frame(spark, [(6, "a"), (2, "a")], "seq long, key string"), pins)
    assert {(r.seq, r.key_code) for r in checked.collect()} == {(6, "KEY_INTERVAL"), (2, "OK")}


def test_validation(spark):
    rows = [
        ("RunClosed", {"kind": "string", "run": "string", "outcome": "string"}, [1, 2]),
        ("StepOpened", {"kind": "string", "run": "string", "step": "string"}, [2, 1]),
        ("Other", {"kind": "string"}, [1, 1]),
    ]
    df = frame(spark, rows, "kind string, fields map<string,string>, items array<int>")
    fields = validate._by_kind(F.col("kind"), F.col("fields"), validate.EVENT_DATA)
    out = validate.violations(df, {"fields": fields, "order": validate.sorted_unique(F.col("items"))}, "kind")
    assert {(r.kind, r.rule) for r in out.collect()} == {("StepOpened", "fields"), ("StepOpened", "order"), ("Other", "fields"), ("Other", "order")}
    paths = frame(spark, [("a/b",), ("/a",), ("a/../b",), ("a\\b",), ("a//b",), ("é",)], "p string")
    assert [r[0] for r in paths.select(validate.backup_path_rule(F.col("p"))).collect()] == [True, False, False, False, False, False]
    assert validate.within_limits(df, {"items": 1}).count() == 1


def test_publishing_is_all_or_nothing(spark):
    root = tempfile.mkdtemp(prefix="chainloom-test-")
    clean = from_events(table(spark, DATA, "events")).drop("user_id")
    assert tables.latest_revision(spark, root) == 0 and tables.published(spark, root, "events") is None
    assert tables.publish(spark, root, 0, events=clean.where("seq <= 2"), notes=clean.select("hash").limit(1)) == 1
    assert tables.publish(spark, root, 1, events=clean.where("seq = 3")) == 2
    assert tables.latest_revision(spark, root) == 2
    assert tables.published(spark, root, "events", 1).count() == clean.where("seq <= 2").count()
    assert tables.published(spark, root, "events").count() == clean.where("seq <= 3").count()
    with pytest.raises(tables.RevisionConflict):
        tables.publish(spark, root, 1, events=clean)
    assert tables.publish(spark, root, 1, events=clean.where("seq = 3").repartition(3)) == 2  # the same content again
    clean.limit(1).write.parquet(f"{root}/data/half/events")  # a writer that ended before its commit
    assert tables.published(spark, root, "events").count() == clean.where("seq <= 3").count()
    assert tables.recover(spark, root) == 1 and tables.recover(spark, root) == 0
    assert tables.published(spark, root, "events").count() == clean.where("seq <= 3").count()


def test_two_writers_at_once(spark):
    from concurrent.futures import ThreadPoolExecutor

    root = tempfile.mkdtemp(prefix="chainloom-test-")

    def one(n):
        try:
            return tables.publish(spark, root, 0, events=spark.range(n))
        except tables.RevisionConflict:
            return None

    with ThreadPoolExecutor(4) as pool:
        assert sorted(map(str, pool.map(one, range(1, 5)))) == ["1", "None", "None", "None"]


def test_objects_are_adopted_or_refused(spark):
    root = tempfile.mkdtemp(prefix="chainloom-test-")
    docs = table(spark, DATA, "documents").select(F.col("text").cast("binary").alias("content"))
    n = docs.distinct().count()
    assert tables.write_objects(docs, f"{root}/objects") == n and tables.write_objects(docs, f"{root}/objects") == 0
    back = tables.read_objects(spark, f"{root}/objects")
    assert back.count() == n and back.where("not intact").count() == 0
    with pytest.raises(tables.ObjectConflict):
        tables.write_objects(docs.withColumn("digest", F.lit("0" * 64)), f"{root}/objects")
    first = back.first().digest
    spark.createDataFrame(
        [(first, bytearray(b"other"), first[:2])],
        "digest string, content binary, prefix string",
    ).write.partitionBy("prefix").mode("append").parquet(f"{root}/objects")
    with pytest.raises(tables.ObjectConflict):
        tables.write_objects(docs, f"{root}/objects")


def test_batches_commit_with_evidence_and_audit(spark):
    from chainloom.operators import evidence
    from chainloom.plans import verify
    from chainloom.sources import histories

    root = tempfile.mkdtemp(prefix="chainloom-test-")
    b = histories.bundles_of(spark.createDataFrame([(i, 35) for i in range(1, 9)], "event_id long, user_id long"))
    first, whole = b.events.where("seq <= 4"), b.events
    keys = b.keys.select("id", "public")
    commit = lambda events, expected: store.commit_batch(spark, root, "w1", events, keys, expected, "auditor")
    source = {"id": "src1", "namespace": "fixture", "profile": "proof-evidence/1"}
    assert store.init_workspace(spark, root, "w1", "auditor") == 0
    assert store.register_source(spark, root, "w1", "auditor", 0, source) == 1 and store.register_source(spark, root, "w1", "auditor", 0, source) == 1
    with pytest.raises(tables.ObjectConflict):
        store.register_source(spark, root, "w1", "auditor", 1, source | {"namespace": "other"})
    assert commit(first, 1) == (2, {"added": 4, "duplicates": 0, "conflicts": 0})
    assert commit(whole, 2) == (3, {"added": 4, "duplicates": 4, "conflicts": 0})
    with pytest.raises(tables.RevisionConflict):
        commit(first, 2)
    log = tables.published(spark, root, "audit").withColumn("workspace", F.lit("w1"))
    assert store.audit_head(log).first().seq == 4 and store.audit_prefix(log, 2).count() == 2
    assert audit.audit_chain(log).count() == 0
    assert {r.seq for r in audit.audit_semantics(log).collect()} == {3, 4}  # nothing was staged before these commits
    rows = tables.published(spark, root, "revisions").withColumn("workspace", F.lit("w1"))
    assert {r.code for r in audit.audit_binding(rows, log).collect()} == {"OK"}
    assert verify.signed(
        tables.published(spark, root, "audit"),
        keys.withColumn("bundle", F.lit("w1")),
        "audit",
        verify.digests.TAGS,
    ).where("signature_code <> 'OK'").count() == 0
    events = tables.published(spark, root, "events")
    assert events.count() == 8 and store.lookup(rows, revision=3).first().n_events == 8
    parents, objects = store.exploded(events.unionByName(events))
    assert parents.count() == events.select(F.explode("parents")).count() and objects.count() == events.select(F.explode("objects")).count() > 0
    assert evidence.used_keys(events, tables.published(spark, root, "audit")).count() == 2
    content = b.objects.select(F.unbase64(F.translate("content", "-_", "+/")).alias("content"))
    tables.write_objects(content, f"{root}/objects")
    named = objects.first().digest
    assert store.object_read(spark, f"{root}/objects", events, named).first().intact
    assert store.object_read(spark, f"{root}/objects", events.where("seq < 0"), named).count() == 0
    assert validate.batch_repeats(events.unionByName(events.limit(1)), keys, b.objects).collect() == [("event repeated", 1)]
    restored = tempfile.mkdtemp(prefix="chainloom-test-")
    inventory.backup(spark, root, f"{restored}/copy")
    assert inventory.restore(spark, f"{restored}/copy", f"{restored}/back") > 5
    assert tables.latest_revision(spark, f"{restored}/back") == 4 and tables.published(spark, f"{restored}/back", "events").count() == 8
    import pathlib

    damaged = next(p for p in pathlib.Path(f"{restored}/copy/files").rglob("*.parquet"))
    damaged.write_bytes(damaged.read_bytes()[:-1] + b"?")
    pathlib.Path(damaged.parent, f".{damaged.name}.crc").unlink(missing_ok=True)
    with pytest.raises(tables.ObjectConflict):
        inventory.restore(spark, f"{restored}/copy", f"{restored}/again")


def test_streaming_replay_equals_batch(spark):
    root = tempfile.mkdtemp(prefix="chainloom-test-")
    events = run_events(spark, DATA).where("stream in ('c1', 'c2', 'c4', 'c5', 'c7')").cache()
    parts = events.withColumn("part", F.pmod(F.xxhash64("hash"), F.lit(4)))
    for k in range(4):  # every part has holes that later parts fill
        parts.where(F.col("part") == k).drop("part").coalesce(1).write.parquet(f"{root}/in/part={k}")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in/part=*")
    q = streaming_replay(source).writeStream.format("parquet").option(
        "checkpointLocation",
        f"{root}/state",
    ).option("path", f"{root}/out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.stream, r.seq): r.code for r in spark.read.parquet(f"{root}/out").collect()}
    want = {(r.stream, r.seq): r.code for r in replay.replay(events).collect()}
    assert got == want and len(want) > 20


def test_a_fork_blocks_what_follows_in_a_stream(spark):
    root = tempfile.mkdtemp(prefix="chainloom-test-")
    event = lambda seq, h, kind: ("s", "m", seq, h, kind, "r", None, None, None, None)
    parts = [
        [event(1, "a", "RunOpened")],
        [event(3, "c", "StepOpened"), event(1, "a", "RunOpened")],
        [event(2, "b", "CorrectionNoted")],
        [event(2, "x", "CorrectionNoted"), event(4, "d", "CorrectionNoted")],
        [event(2, "x", "CorrectionNoted")],
    ]
    schema = "source string, stream string, seq long, hash string, kind string, run string, step string, outcome string, observation string, delegation string"
    for k, rows in enumerate(parts):
        frame(spark, rows, schema).coalesce(1).write.parquet(f"{root}/in/part={k}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in/part=*")
    q = streaming_replay(source).writeStream.format("parquet").option(
        "checkpointLocation",
        f"{root}/state",
    ).option("path", f"{root}/out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.seq, r.hash, r.code) for r in spark.read.parquet(f"{root}/out").collect())
    assert got == [(1, "a", "OK"), (2, "b", "OK"), (2, "x", "BLOCKED"), (3, "c", "OK"), (4, "d", "BLOCKED")]


def test_stages_expire_in_a_stream(spark):
    from chainloom.streaming.ordered_replay import stage_expiry_stream

    root = tempfile.mkdtemp(prefix="chainloom-test-")
    rows = [
        ("t1", "2024-01-01 00:00:00", "STAGED"),
        ("t1", "2024-01-01 00:05:00", "COMMITTED"),
        ("t2", "2024-01-01 00:01:00", "STAGED"),
        ("t9", "2024-01-01 03:00:00", "STAGED"),
        ("t9", "2024-01-01 06:00:00", "STAGED"),
    ]
    for k, r in enumerate(rows):
        frame(
            spark,
            [r],
            "stage string, at string, kind string",
        ).selectExpr("stage", "timestamp(at) AS ts", "kind").coalesce(1).write.parquet(f"{root}/in/part={k}")
    source = spark.readStream.schema("stage string, ts timestamp, kind string").option("maxFilesPerTrigger", 1).parquet(f"{root}/in/part=*")
    q = stage_expiry_stream(source).writeStream.format("parquet").option(
        "checkpointLocation",
        f"{root}/state",
    ).option("path", f"{root}/out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {r.stage for r in spark.read.parquet(f"{root}/out").collect()} == {"t2", "t9"}


def test_python_operators_from_another_folder(tmp_path):
    """Workers find the library wherever the driver runs."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from chainloom.functions import canon, ed25519
from chainloom.operators import graph
assert canon.parse_column(spark.createDataFrame([('{{"b":1,"a":2}}',)], "t string"), "t").first().canonical == '{{"a":2,"b":1}}'
nodes = spark.createDataFrame([("g", "a"), ("g", "b")], "component string, node string")
assert graph.topological_order(nodes, spark.createDataFrame([("b", "a")], "src string, dst string")).orderBy("position").first().node == "b"
key, s = ed25519.public_key(bytes(32)), ed25519.sign(bytes(32), b"m")
row = spark.createDataFrame([(bytearray(key), bytearray(b"m"), bytearray(s))], "k binary, m binary, s binary")
assert ed25519.verified(row, "k", "m", "s").first().signature_ok
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    from chainloom import session

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())


def test_audit_of_a_good_log(spark):
    rows = [
        ("w", 1, ZERO, "a", "WorkspaceCreated", 0, None, None),
        ("w", 2, "a", "b", "SourceRegistered", 1, None, "s"),
        ("w", 3, "b", "c", "ImportStaged", None, "t", None),
        ("w", 4, "c", "d", "ImportCommitted", 2, "t", None),
    ]
    log = frame(
        spark,
        rows,
        "workspace string, seq long, prev string, hash string, kind string, revision long, stage string, source_id string",
    ).withColumn("evidence", F.lit("e"))
    assert audit.audit_chain(log).count() == 0 and audit.audit_semantics(log).count() == 0
    twice = log.unionByName(log.where("seq = 4").withColumn("seq", F.lit(5).cast("long")))
    assert {r.reason for r in audit.audit_semantics(twice).collect()} == {"stage not open", "revision"}


def test_evidence_tree_deepens_with_its_digests(spark, monkeypatch):
    import hashlib

    digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(3000)]
    monkeypatch.setattr(inventory, "LEAF_DIGESTS", 1)  # 3,000 digests then need prefixes of four characters
    parts = frame(spark, [("object", d) for d in digests + digests[:5]], "kind string, digest string")
    level = {}
    for d in sorted(digests):
        level.setdefault(d[:4], []).append(f"object:{d}")
    hashed = lambda parts: hashlib.sha256(b"evidence-tree\0" + ",".join(parts).encode()).hexdigest()
    nodes = {p: hashed(x) for p, x in level.items()}
    for depth in (2, 0):
        up = {}
        for p in sorted(nodes):
            up.setdefault(p[:depth], []).append(nodes[p])
        nodes = {p: hashed(x) for p, x in up.items()}
    assert inventory.evidence_tree(parts).first().evidence == nodes[""]
