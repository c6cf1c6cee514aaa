"""Token counts (operator 9): edit-aware counting over pre-token segment trees.

A document's text is cut into leaves of about LEAF characters, each cut just after ASCII white space
and before a word, where no token crosses. A tree over the leaves holds the sums of characters and
tokens below every node. An edit replaces [start, end) by a text: the leaves it meets are found by
descending the character sums, joined with the replacement and, where the join no longer ends in white
space, with the next leaf (boundary context), and encoded again; all other leaves keep their counts
and only the sums above the changed leaves are updated. A leaf that outgrows its bound is cut anew.

Positions are code points of the text as it stands when the edit applies. Defined results: a null or
empty text has 0 tokens; edits outside the text are clipped to it, an end before its start counts as
the start, a null replacement is empty, null edits are skipped; repeated rows get equal results; an
empty table gives an empty result; only doc_id, text and the edits are read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import map_batches, string_column, table
from .token_store import encoder_of, tokenizer_path

LEAF = 256
#: Edits that the registered query makes in each document.
EDITS = 4
_GAP = re.compile("[ \t\n\r\f\v]+")
_SPACE = " \t\n\r\f\v"


def _leaves(text: str) -> list[str]:
    out, at = [], 0
    while at < len(text):
        m = _GAP.search(text, at + LEAF)
        end = m.end() if m else len(text)
        out.append(text[at:end])
        at = end
    return out


class CountTree:
    """A text under edits, with its number of tokens at the root."""

    def __init__(self, text: str, count):
        self.count = count
        self.encoded = 0  # characters encoded after the first build
        self._build([(t, count(t)) for t in _leaves(text)])

    def _build(self, leaves: list[tuple[str, int]]) -> None:
        self.width = 1 << max(len(leaves) - 1, 0).bit_length()
        self.leaf = leaves + [("", 0)] * (self.width - len(leaves))
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        self.chars[self.width :] = [len(t) for t, _ in self.leaf]
        self.tokens[self.width :] = [n for _, n in self.leaf]
        for node in range(self.width - 1, 0, -1):
            self._sum(node)

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def _set(self, i: int, text: str, tokens: int) -> None:
        self.leaf[i] = (text, tokens)
        node = self.width + i
        self.chars[node], self.tokens[node] = len(text), tokens
        while node := node // 2:
            self._sum(node)

    def _find(self, place: int) -> tuple[int, int]:
        """The leaf of a character and its place there; the end of the text is in its last leaf."""
        if place >= self.chars[1]:
            i = self.width - 1
            while i and not self.leaf[i][0]:
                i -= 1
            return i, len(self.leaf[i][0])
        node = 1
        while node < self.width:
            node *= 2
            if place >= self.chars[node]:
                place -= self.chars[node]
                node += 1
        return node - self.width, place

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(t for t, _ in self.leaf)

    def edit(self, start: int, end: int, replacement: str) -> None:
        start = min(max(start, 0), self.chars[1])
        end = min(max(end, start), self.chars[1])
        first, a = self._find(start)
        last, b = self._find(end)
        if first and a == 0:  # what stands before may now end inside a word
            first -= 1
            while first and not self.leaf[first][0]:
                first -= 1
            a = len(self.leaf[first][0])
        new = self.leaf[first][0][:a] + replacement + self.leaf[last][0][b:]
        while last + 1 < self.width and (not new or new[-1] not in _SPACE):
            last += 1
            new += self.leaf[last][0]
        parts = [(t, self.count(t)) for t in _leaves(new)]
        self.encoded += len(new)
        if len(parts) <= last - first + 1:
            for k in range(first, last + 1):
                self._set(k, *(parts[k - first] if k - first < len(parts) else ("", 0)))
        else:
            self._build([x for x in [*self.leaf[:first], *parts, *self.leaf[last + 1 :]] if x[0]])


def count_tokens(docs: DataFrame, edits: Column, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_tokens_edited, n_chars_edited, n_chars_encoded (for the edits). edits: an
    array of structs (start, end, replacement) for each row, applied in order."""
    path = path or tokenizer_path()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        string_column(docs, "text").alias("text"),
        edits.cast("array<struct<start:bigint,end:bigint,replacement:string>>").alias("edits"),
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder, out = encoder_of(path), []
        for k in range(batch.num_rows):
            tree = CountTree(batch.column(1)[k].as_py() or "", lambda t: len(encoder(t)) // 4)
            before = tree.n_tokens
            for e in batch.column(2)[k].as_py() or []:
                if e is not None and e["start"] is not None and e["end"] is not None:
                    tree.edit(e["start"], e["end"], e["replacement"] or "")
            out.append((before, tree.n_tokens, tree.chars[1], tree.encoded))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array([x[i] for x in out], pa.int64()) for i in range(4))],
            ["doc_id", "n_tokens", "n_tokens_edited", "n_chars_edited", "n_chars_encoded"],
        )

    return map_batches(rows, run, "doc_id long, n_tokens long, n_tokens_edited long, n_chars_edited long, n_chars_encoded long", f"encoder {path}")


def sample_edits(n: int = EDITS) -> Column:
    """For each document of `documents`: n replacements, insertions and deletions at hashed places,
    with text from the document itself."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.char_length(text)

    def one(k: int) -> Column:
        h = lambda i: F.xxhash64("doc_id", F.lit(10 * k + i))
        start = F.pmod(h(0), size + 1)
        put = F.substring(text, (F.pmod(h(2), size + 1) + 1).cast("int"), F.pmod(h(3), F.lit(40)).cast("int"))
        return F.struct(
            start.alias("start"),
            (start + F.pmod(h(1), F.lit(60))).alias("end"),
            F.when(F.pmod(h(4), F.lit(4)) > 0, put).otherwise("").alias("replacement"),
        )

    return F.array(*[one(k) for k in range(n)])


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), sample_edits())
