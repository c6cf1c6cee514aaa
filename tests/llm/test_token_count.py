import numpy as np
import pytest
from pyspark.sql import functions as F

from chainloom.llm import token_count
from chainloom.llm.token_store import Encoder, tokenizer_path

ENCODER = Encoder(tokenizer_path())


def whole(text):
    return len(ENCODER.raw(text)) // 4


@pytest.mark.parametrize("seed", range(4))
def test_edits_match_encoding_the_whole_text(seed, monkeypatch):
    monkeypatch.setattr(token_count, "LEAF", 12)
    rng = np.random.default_rng(seed)
    letters = ["a", "b", "é", " ", "\n", "  ", "'s", "12", "!!", "Long", "\xa0", "<|endoftext|>"]
    make = lambda n: "".join(rng.choice(letters, n))
    text = make(200)
    tree = token_count.CountTree(text, lambda t: len(ENCODER(t)) // 4)
    for _ in range(150):
        a, b = sorted(rng.integers(-3, len(text) + 4, 2).tolist())
        b = min(b, a + int(rng.integers(0, 30)))
        put = make(int(rng.integers(0, 12)))
        tree.edit(a, b, put)
        lo = min(max(a, 0), len(text))
        text = text[:lo] + put + text[min(max(b, lo), len(text)) :]
        assert tree.text == text
        assert tree.n_tokens == whole(text)


def test_query_matches_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = {}
    for r in docs.select("doc_id", "text", token_count.sample_edits().alias("e")).collect():
        text = r.text
        for e in r.e:
            text = text[: e.start] + (e.replacement or "") + text[max(e.end, e.start) :] if e.start <= len(text) else text + (e.replacement or "")
        want[r.doc_id] = (whole(r.text), whole(text), len(text))
    got = {r.doc_id: (r.n_tokens, r.n_tokens_edited, r.n_chars_edited) for r in token_count.op9_token_counts(spark, data).collect()}
    assert got == want


def test_edges(spark, odd_docs):
    edits = F.when(
        F.col("doc_id") > 5,
        F.array(F.struct(F.lit(0).alias("start"), F.lit(10**9).alias("end"), F.lit(None).cast("string").alias("replacement"))),
    ).otherwise(F.lit(None))
    rows = token_count.count_tokens(odd_docs, edits).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.n_tokens_edited == 0 for r in rows if r.doc_id and r.doc_id > 5)
    assert all(r.n_tokens == r.n_tokens_edited for r in rows if r.doc_id is not None and r.doc_id <= 5)
    assert token_count.count_tokens(odd_docs.limit(0), edits).count() == 0
