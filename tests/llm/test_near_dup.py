import re

import numpy as np
import pytest

from chainloom.llm import near_dup


def brute(rows):
    """Components over all pairs of rows, by union-find on row numbers."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    first = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            first[find(i)] = min(d, first.get(find(i), d))
    return sorted(
        (d if d is not None else -1, len(sets[i]), first[find(i)] if d is not None else -1, d is None or d == first[find(i)]) for i,
        (d, _) in enumerate(rows)
    )


def got(spark, rows):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, component_id int, class string")
    return sorted(
        (
            r.doc_id if r.doc_id is not None else -1,
            r.n_shingles,
            r.component_id if r.component_id is not None else -1,
            r.kept,
        ) for r in near_dup.near_duplicates(df).collect()
    )


def test_edges(spark, odd_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    assert got(spark, rows) == brute(rows)
    assert near_dup.near_duplicates(odd_docs.limit(0)).count() == 0


@pytest.mark.parametrize(("small", "node_bytes"), [(25, 64_000_000), (200, 20_000)])
def test_large_group_of_near_copies_and_a_shared_passage(spark, monkeypatch, small, node_bytes):
    monkeypatch.setattr(near_dup, "SMALL", small)
    monkeypatch.setattr(near_dup, "NODE_BYTES", node_bytes)
    rng = np.random.default_rng(3)
    word = lambda: "w%d" % rng.integers(0, 10**6)
    base, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    rows = []
    for i in range(45):  # copies at different distances from one text
        text = list(base)
        for at in rng.choice(len(text), rng.integers(0, 6), replace=False):
            text[at] = word()
        rows.append((i, " ".join(text)))
    for i in range(30):  # a passage that many texts share
        rows.append((100 + i, " ".join([*[word() for _ in range(30)], *passage])))
    chain = [word() for _ in range(100)]
    for i in range(12):  # each similar to the next only
        chain[i * 8] = word()
        rows.append((200 + i, " ".join(chain)))
    assert got(spark, rows) == brute(rows)


def test_components_by_task_and_by_joins(spark, monkeypatch):
    rng = np.random.default_rng(7)
    key = lambda i: int(i).to_bytes(16, "big")
    pairs = [(key(a), key(b)) for a, b in rng.integers(0, 90, (60, 2))] + [(key(200 + i), key(201 + i)) for i in range(40)]
    links = spark.createDataFrame(pairs, "a binary, b binary")
    told = lambda: {bytes(r["class"]): bytes(r["root"]) for r in near_dup.components(links).collect()}
    one = told()
    monkeypatch.setattr(near_dup, "TASK_EDGES", 0)
    assert told() == one
    assert {one[key(200 + i)] for i in range(41)} == {key(200)}
