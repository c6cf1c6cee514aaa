"""Token-ID output (operator 5): bit-plane shuffled chunks.

Texts are encoded with a public tokenizer, in ascending doc_id order, each followed by an end id.
The stream of ids is cut into chunks of whole documents; a chunk's ids are cut into blocks of a fixed
number of ids, each block is transposed into byte planes (or bit planes), and every plane is
compressed with zstandard on its own. A chunk's payload begins with the index of its planes.

Payload, little-endian: magic "BPS1", unit (8: byte planes, 1: bit planes), planes a block, ids a
block (u32), number of ids (u32), then the compressed length of every plane (u32 each, block by
block), then the planes. Files are Parquet, one row a chunk: part, chunk, start (ids before it in its
part), n_ids, doc_ids, lengths, payload; parts are ranges of doc_id, in order. A failed task is
written anew by the usual commit of the writer.

Defined results: a null or empty text has the end id alone; rows with the same doc_id stand next to
each other, ordered by a hash of their texts; null ids come first; a text longer than a chunk makes a
chunk of its own; an empty table gives no files and an empty result; other columns are not read.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import held, let_go, string_column, table, workers, written

MAGIC = b"BPS1"
BLOCK_IDS = 1 << 16
CHUNK_IDS = 1 << 19
END_ID = 1
#: Distinct pre-tokens in each generation of a worker's memory.
CACHE_WORDS = 120_000
CHUNKS = "part int, chunk int, start long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts by a word tokenizer whose pre-tokens never contain white space, so that a text's ids are those
    of its pre-tokens, and each distinct one is encoded once while it is remembered. Only texts, or words between
    white space, whose characters all stand before U+0180, where case, kind and normal form are the same in every
    Unicode version, are cut here; any other word, or text with a control character on whose kind Python differs, goes to the
    tokenizer whole. Two generations of `cache_words` pre-tokens bound the memory and keep the frequent."""

    _ODD = re.compile("[\x1c-\x1f]")
    _PLAIN = re.compile("[\t-\r\x20-\u017f]*")

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a worker a core
        self.tokenizer = Tokenizer.from_file(path)
        of = lambda kind: "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c))[0] == kind)
        letters, numbers = of("L"), of("N")
        # the pre-tokens of the tokenizer file: some endings, runs of letters, single numbers, runs of anything else
        self.cut = re.compile(f"[{letters}]+|[{numbers}]|'(?:s|t|re|ve|m|ll|d)|[^\\s{letters}{numbers}]+").findall
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cache_words = cache_words
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        self.letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def raw(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, token: str) -> bytes:
        shown = token if token.isascii() and token.isprintable() else "".join(map(self.letter.__getitem__, token.encode()))
        return array("I", [x.id for x in self.tokenizer.model.tokenize(shown)]).tobytes()

    def plain(self, text: str) -> bytes:
        tokens = self.cut(text.lower())
        missing = set(tokens).difference(self.pieces)
        if missing and len(self.pieces) + len(missing) > self.cache_words:
            self.older, self.pieces = self.pieces, {}
            missing = set(tokens)
        for t in missing:
            known = self.older.get(t)
            self.pieces[t] = self.piece(t) if known is None else known
        return b"".join(map(self.pieces.__getitem__, tokens))

    def __call__(self, text: str) -> bytes:
        if self._ODD.search(text):
            return self.raw(text)
        if self._PLAIN.fullmatch(text) and "<|" not in text:
            return self.plain(text)
        return b"".join(self.plain(w) if self._PLAIN.fullmatch(w) and "<|" not in w else self.raw(w) for w in text.split())


def encoder_of(path: str) -> Encoder:
    """This process's encoder, kept from task to task of the operators that encode."""
    return held(f"encoder {path}", lambda: Encoder(path))


def pack(ids: np.ndarray, unit: int = 8, block_ids: int = BLOCK_IDS, level: int = 3) -> bytes:
    """The payload of a chunk of ids."""
    squeeze = zstandard.ZstdCompressor(level=level).compress
    bits = max(int(ids.max()).bit_length(), 1) if len(ids) else 1
    planes = -(-bits // unit)
    out = []
    for i in range(0, len(ids), block_ids):
        block = ids[i : i + block_ids].astype("<u4")
        if unit == 8:
            out += [squeeze(p.tobytes()) for p in np.ascontiguousarray(block.view(np.uint8).reshape(-1, 4).T[:planes])]
        else:
            out += [squeeze(np.packbits((block >> b & 1).astype(np.uint8)).tobytes()) for b in range(planes)]
    head = MAGIC + struct.pack("<BBxxII", unit, planes, block_ids, len(ids))
    return head + np.array([len(x) for x in out], "<u4").tobytes() + b"".join(out)


def unpack(payload: bytes) -> np.ndarray:
    """The ids of a chunk."""
    if payload[:4] != MAGIC:
        raise ValueError("not a chunk of this format")
    unit, planes, block_ids, n = struct.unpack_from("<BBxxII", payload, 4)
    count = -(-n // block_ids) * planes
    sizes = np.frombuffer(payload, "<u4", count, 16)
    ends = 16 + 4 * count + np.cumsum(sizes.astype(np.int64))
    open_ = zstandard.ZstdDecompressor().decompress
    out = np.zeros(n, "<u4")
    for k in range(count):
        at = k // planes * block_ids
        size = min(block_ids, n - at)
        raw = np.frombuffer(open_(payload[ends[k] - sizes[k] : ends[k]]), np.uint8)
        if unit == 8:
            out[at : at + size] |= raw.astype("<u4") << np.uint32(8 * (k % planes))
        else:
            out[at : at + size] |= np.unpackbits(raw, count=size).astype("<u4") << np.uint32(k % planes)
    return out


def encode(docs: DataFrame, path: str, end_id: int = END_ID, unit: int = 8, chunk_ids: int = CHUNK_IDS, block_ids: int = BLOCK_IDS) -> DataFrame:
    """The chunks of a table of documents (see CHUNKS), in ascending order of doc_id by part, chunk."""
    workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        let_go(f"encoder {path}")
        part, encoder = TaskContext.get().partitionId(), encoder_of(path)
        ids, lengths, parts, start, chunk, size = [], [], [], 0, 0, 0
        tail = struct.pack("<I", end_id)

        def close() -> pa.RecordBatch:
            data = np.frombuffer(b"".join(parts), "<u4")
            row = {
                "part": part,
                "chunk": chunk,
                "start": start,
                "n_ids": len(data),
                "doc_ids": list(ids),
                "lengths": list(lengths),
                "payload": pack(data, unit, block_ids),
            }
            return pa.RecordBatch.from_pylist([row], SCHEMA)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = encoder(text.as_py() or "") + tail
                ids.append(doc_id)
                lengths.append(len(data) // 4)
                parts.append(data)
                size += len(data) // 4
                if size >= chunk_ids:
                    yield close()
                    start, chunk, size = start + size, chunk + 1, 0
                    ids, lengths, parts = [], [], []
        if ids:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), string_column(docs, "text").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return rows.select("doc_id", "text").mapInArrow(run, CHUNKS)


SCHEMA = pa.schema(
    [
        ("part", pa.int32()),
        ("chunk", pa.int32()),
        ("start", pa.int64()),
        ("n_ids", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())),
        ("payload", pa.binary()),
    ]
)


def directory(chunks: DataFrame) -> DataFrame:
    """part, base: the ids before each part. One row a part, so no more than there are partitions."""
    parts = chunks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def read_back(chunks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the chunks alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                base, first, doc_ids, lengths, payload = (c[row].as_py() for c in batch.columns)
                data = unpack(payload).tobytes()
                ends = np.cumsum(lengths)
                begin = ends - lengths
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begin, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()),
                        pa.array(begin + base + first, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    workers(chunks.sparkSession)
    rows = chunks.join(F.broadcast(directory(chunks)), "part").select("base", "start", "doc_ids", "lengths", "payload")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, path: str | None = None, unit: int = 8) -> DataFrame:
    """Writes the chunks to the shared folder and reads every document back from the files."""
    return read_back(written(encode(docs, path or tokenizer_path(), unit=unit), "tokens"))


def op5_token_output(spark, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"))
