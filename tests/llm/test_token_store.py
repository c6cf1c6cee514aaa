import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from chainloom.llm import token_store as store


@pytest.mark.parametrize("unit", [1, 8])
@pytest.mark.parametrize("n", [0, 1, 7, 1000, 70_001])
def test_round_trip(unit, n):
    ids = np.random.default_rng(n).integers(0, 49_408, n).astype("<u4")
    assert np.array_equal(store.unpack(store.pack(ids, unit, 4096)), ids)
    big = np.array([0, 2**32 - 1, 5], "<u4")
    assert np.array_equal(store.unpack(store.pack(big, unit, 2)), big)


def expected(rows):
    t, out, start = Tokenizer.from_file(store.tokenizer_path()), [], 0
    for i, text in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query_matches_library(spark, data):
    rows = sorted((r["doc_id"], r["text"]) for r in pq.read_table(f"{data}/documents.parquet").to_pylist())
    assert sorted(tuple(r) for r in store.op5_token_output(spark, data).collect()) == expected(rows)


def test_edges(spark, odd_docs):
    got = [tuple(r) for r in store.token_output(odd_docs.where("doc_id is not null"), unit=1).collect()]
    rows = sorted((r.doc_id, r.text or "") for r in odd_docs.where("doc_id is not null").collect())
    assert sorted(got) == expected(rows)
    assert store.token_output(odd_docs).count() == odd_docs.count()
    assert store.token_output(odd_docs.limit(0)).count() == 0


def test_pieces_equal_whole_text():
    encoder = store.Encoder(store.tokenizer_path(), cache_words=3)
    for text in [
        "a b  c\td",
        "It's Ünḯcode  x\x85y",
        "<|endoftext|> q<|startoftext|>",
        "a\x1cb c\x1fd",
        "é ́e 12 345!!",
        "ΑΣ ΣΑΣ",
        "",
        "İ\u0130X ª² ½ n\u0149 I'LL can't ſtop",
        "a\xa0b",
    ]:
        assert encoder(text) == encoder.raw(text)


def test_random_texts_equal_the_library():
    import random

    encoder, rng = store.Encoder(store.tokenizer_path(), cache_words=50), random.Random(4)
    pools = [
        [chr(c) for c in range(0x20, 0x80)],
        [chr(c) for c in range(0x180)],
        [chr(c) for c in range(0x3000)],
        list(" 'stremld<|\u0130ſßÀé1²½\xa0\x85\xad\x7f\n\t"),
    ]
    for _ in range(5000):
        text = "".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(1, 25)))
        assert encoder(text) == encoder.raw(text), ascii(text)
