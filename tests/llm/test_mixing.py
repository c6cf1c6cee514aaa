import duckdb

from chainloom.llm import mixing


def water_fill(sizes, weights=(5, 2, 1), cap=3):
    """Clamp and reshare until no target stands above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    while open_:
        left = sum(sizes.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: cap * sizes[s] for s in over}
        open_ -= over
    return target


def test_targets_and_takes(spark, odd_docs):
    rows = mixing.mix_report(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    sources = {i: s for i, s in odd_docs.select("doc_id", "source").distinct().collect()}
    sizes, taken, target, most = {}, {}, {}, {}
    for r in rows:
        s = sources[r.doc_id]
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        target[s], most[s] = r.target, max(most.get(s, 0), r.size)
        assert r.taken <= 3 * r.size
    for s, t in water_fill(sizes).items():
        assert abs(target[s] - t) < 1e-6
        assert abs(taken[s] - t) <= most[s]
    again = mixing.mix_report(odd_docs.repartition(7)).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(rows, key=key) == sorted(again, key=key)


def test_mixed_rows_and_empty(spark, odd_docs):
    report = {(r.doc_id, r.size): r.taken // r.size for r in mixing.mix_report(odd_docs.where("doc_id is not null")).collect() if r.size}
    mixed = mixing.mix(odd_docs.where("doc_id is not null"))
    assert mixed.columns == odd_docs.columns
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert all(counts.get(i, 0) % max(n, 1) == 0 if n else True for (i, _), n in report.items())
    assert mixing.mix_report(odd_docs.limit(0)).count() == 0


def test_sql_agrees(spark, data):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = sorted(con.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.OP7_SQL})").fetchall())
    got = sorted(tuple(r) for r in mixing.op7_mixing(spark, data).select("doc_id", "size", "source_size", "target", "taken").collect())
    assert [x[:3] + x[4:] for x in got] == [x[:3] + x[4:] for x in want]
    assert all(abs(a[3] - b[3]) < 1e-6 for a, b in zip(got, want))
