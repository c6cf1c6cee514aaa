import re

import numpy as np
import pyarrow.parquet as pq

from chainloom.llm import decontam


def naive(text, item, least):
    """Greedy string tiling by definition: mark the longest unmarked common run, again and again."""
    a, b, total = [True] * len(text), [True] * len(item), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(text)):
            for j in range(len(item)):
                n = 0
                while i + n < len(text) and j + n < len(item) and a[i + n] and b[j + n] and text[i + n] == item[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return total
        for k in range(n):
            a[i + k] = b[j + k] = False
        total += n


def test_tiles_match_naive_version():
    rng = np.random.default_rng(1)
    for size, letters in ((30, 3), (60, 8), (50, 2), (70, 40)):
        for _ in range(6):
            item = rng.integers(0, letters, size).astype(np.uint64)
            text = rng.integers(0, letters, size).astype(np.uint64)
            cut = rng.integers(5, size - 5)
            text = np.concatenate((text, item[cut:], text[:7], item[:cut]))
            found = decontam.tiles(text, item, 4)
            assert all(np.array_equal(text[i : i + n], item[j : j + n]) for n, i, j in found)
            covered = sum(n for n, _, _ in found)
            assert covered == naive(text.tolist(), item.tolist(), 4)
            assert len({j + k for n, _, j in found for k in range(n)}) == len({i + k for n, i, _ in found for k in range(n)}) == covered


def test_query_finds_passages(spark, data):
    got = {r.doc_id: r for r in decontam.op10_decontaminate(spark, data).collect()}
    low = lambda t: " ".join(re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()))
    items = {r["item_id"]: low(r["text"]) for r in pq.read_table(f"{data}/benchmark.parquet").to_pylist()}
    for r in pq.read_table(f"{data}/documents.parquet").to_pylist():
        whole = {i for i, t in items.items() if f" {t} " in f" {low(r['text'])} "}
        assert whole <= {int(x) for x in got[r["doc_id"]].item_ids.split(",") if x}
        assert got[r["doc_id"]].contaminated == (got[r["doc_id"]].coverage >= 0.5)


def test_every_document_against_every_item_by_the_naive_version(spark, data):
    """The whole query: largest coverage and items at the threshold, over all pairs."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    items = {r["item_id"]: words(r["text"]) for r in pq.read_table(f"{data}/benchmark.parquet").to_pylist()}
    docs = {r["doc_id"]: words(r["text"]) for r in pq.read_table(f"{data}/documents.parquet").to_pylist()}
    seeds = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in items.items()}
    some = 0
    for r in decontam.op10_decontaminate(spark, data).collect():
        text, best, hits = docs[r.doc_id], 0.0, []
        grams = {tuple(text[k : k + 5]) for k in range(len(text) - 4)}
        for i, item in items.items():
            if len(item) >= 5 and grams & seeds[i] and len(text) < 3000:
                share = naive(text, item, 5) / len(item)
                best = max(best, share)
                hits += [i] * (share >= 0.5)
        if len(text) < 3000:
            assert (r.coverage, r.item_ids) == (best, ",".join(map(str, sorted(hits))))
            some += bool(hits)
    assert some > 0


def test_a_sentence_that_all_share_is_tiled_once_a_document(spark, monkeypatch):
    shared = [f"s{i}" for i in range(12)]
    items = decontam.Items([(i, " ".join([*shared, *(f"i{i}w{k}" for k in range(100))])) for i in range(300)], 5)
    from chainloom.llm import kernel

    text = " ".join([*(f"d{k}" for k in range(50)), *shared])
    h = kernel.words(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])).hash
    calls = []
    real = decontam.tiles
    monkeypatch.setattr(decontam, "tiles", lambda *a: calls.append(1) or real(*a))
    assert items.judged(h, np.unique(kernel.grams(h, 5)), 5, 0.5) == (12 / 112, [])
    assert len(calls) == 1


def test_edges(spark, odd_docs):
    words = [f"q{i}" for i in range(40)]
    text = " ".join(words)
    turned = " ".join([*words[20:], "and", *words[:20]])
    docs = odd_docs.unionByName(
        spark.createDataFrame([(900, turned, None, None, 1, "k", 0.1), (901, " ".join(words[:15]), None, None, 1, "k", 0.1)], odd_docs.schema)
    )
    items = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "a a", "x"), (None, text, "y")], "item_id long, text string, coverage string")
    rows = decontam.decontaminate(docs, items).collect()
    assert len(rows) == docs.count()
    assert [(r.doc_id, r.n_items) for r in rows if r.contaminated] == [(900, 1)]
    assert next(r for r in rows if r.doc_id == 901).coverage == 15 / 40
    kept = decontam.clean_rows(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1
    assert decontam.decontaminate(docs.limit(0), items).count() == 0
    assert not any(r.contaminated for r in decontam.decontaminate(docs, items.limit(0)).collect())
