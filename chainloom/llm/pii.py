"""Personal data (operator 3): fixed patterns and a skip-chain conditional random field.

Base spans are leftmost non-overlapping matches of four patterns; they always stay. The field then
labels every candidate (a white-space separated token with a digit or an at sign; any other token is
clamped to "none"). Tokens of one base span are one candidate, and so are adjacent tokens without letters
whose digits together, GROUP_DIGITS at most (no card has more), are those of a base span, of another token
or of another whole row of such tokens in the text. Neighbouring candidates share chain potentials, and candidates that
repeat (same digits, however few and however grouped, or same letters around an at sign) share skip potentials with their last occurrence in
the document, however far away; loopy sum-product message passing makes labels of one entity agree.
A sweep takes the chains and then the skips from the first token to the last and back, so that evidence
crosses any number of repeats at once; a text is swept until no message moves by TOLERANCE. (Loops need not
settle: steps shrink after SETTLING sweeps, and a text that still moves after MAX_SWEEPS is warned of.)
A candidate that the field is sure of and that meets no base span gives an added span: forms that the
patterns miss (a card with a wrong digit, an address without its dots, a telephone number without its plus
sign), other forms of what stands plainly elsewhere, and secrets (keys and tokens), a kind of the method's own.

Weights are learned by pseudo-likelihood from lessons. A lesson is a snippet of a sampled text (`sample_rows` rows by
smallest seeded hash, SNIPPET characters each, which bounds what reaches the driver) with its base spans
and named secrets as labels, of which half are disturbed so that no pattern fits them, some are said again in another form, and plain
numbers and made-up secrets are put between its words. One half of the lessons teaches, and the other sets the probability
from which the field counts as sure: the least at which PRECISION of what it adds there is right. Every whole text is
labelled; work grows with the text, for every candidate has at most one chain and one skip edge back.

Positions are code points, ends exclusive. Defined results: a null or empty text has no spans;
repeated rows get equal results; an empty table gives an empty result; without any text to learn
from the field adds nothing; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
import warnings
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import map_batches, smallest, string_column, table

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = 4  # the first of them have patterns
N_LABELS = 1 + len(KINDS)
#: Without lessons to set it: from which probability on the field is sure.
SURE = 0.95
PRECISION = 0.995
TOLERANCE, SETTLING, MAX_SWEEPS = 1e-6, 20, 1000
SNIPPET = 400
GROUP_DIGITS = 19

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The patterns of the base rule. A digit run is entered at its start only, which finds the same matches.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Entered at the start of a token only and never given back, so that work is linear in any text.
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
_NAMED = re.compile(
    r"(?i)(?:token|secret|password|passwd|credential|(?:api|access|private)[ _-]?key)[\"']?[ \t]{0,4}[:=][ \t]{0,4}[\"']?([A-Za-z0-9+/_-]{12,128})"
)
_BEFORE = re.compile(r"([A-Za-z_-]{1,24})?[\"']?\s{0,4}([:=])?\s{0,4}[\"'(\[]?$")
_INSIDE = re.compile(r"[:=][\"']?([A-Za-z0-9+/_-]+)")
_SECRET_WORD = re.compile(r"(?i)token|secret|passw|credential|key$")
_HEX = frozenset("0123456789abcdefABCDEF")
_DIGITS = re.compile(r"[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end), in order."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) < 4 and int(p or "0") <= 255 for x in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 40 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.findall(m[0])) <= 15:
                out.append((3, *m.span()))
    return out


def _bucket(n: int, *steps: int) -> int:
    return bisect_right(steps, n)


def _features(text: str, start: int, end: int) -> list[int]:
    """Numbers of the features that a candidate has, one of each group."""
    token = text[start:end]
    digits = len(_DIGITS.findall(token))
    letters = sum(c.isalpha() for c in token)
    at, dot, dash, plus = token.count("@"), token.count("."), token.count("-"), token.startswith("+")
    inside = _INSIDE.search(token)
    core = inside[1] if inside else token.strip(".,;:!?()[]<>\"'#$%&*")
    head = core[:256]
    turns = sum(x.isdigit() != y.isdigit() for x, y in zip(head, head[1:], strict=False))
    mixed = bool(digits and letters and core.isascii() and all(c.isalnum() or c in "+/_-" for c in head))
    before = _BEFORE.search(text[max(0, start - 40) : start + (inside.start() + 1 if inside else 0)])
    word, mark = (before[1] or "", before[2] or "") if before else ("", "")
    parts = token.strip(".,;:!?()[]").split(".")
    octets = len(parts) == 4 and all(x.isdigit() and len(x) <= 3 for x in parts)
    return [
        0,
        1 + min(digits, 20),
        22 + min(letters, 9),
        32 + min(at, 2),
        35 + min(dot, 4),
        40 + min(dash, 4),
        45 + plus,
        47 + (at > 0 and dot > 0),
        49 + (dot == 3 and letters == 0),
        51 + (digits > 0 and letters == 0 and 13 <= digits <= 19),
        53 + ("(" in token or ")" in token),
        55 + (mixed and set(head) <= _HEX),
        57 + _bucket(len(core), 8, 12, 16, 24, 40, 64),
        64 + mixed,
        66 + ("", ":", "=").index(mark),
        69 + bool(mark and _SECRET_WORD.search(word)),
        71 + octets,
        73 + _bucket(turns, 1, 3, 6),
        77 + (letters == 0 and 9 <= digits <= 15 and (plus or token.startswith("00") or "(" in token or dash > 1)),
    ]


N_FEATURES = 79


@dataclass
class Graph:
    """Candidate tokens of some texts: place, feature numbers, and edges (a before b) by kind."""

    home: np.ndarray
    span: np.ndarray
    features: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def _candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, digits) of each candidate, in order: single tokens and joined ones."""
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    starts, ends = [a for a, _ in tokens], [b for _, b in tokens]
    digits = ["".join(_DIGITS.findall(text[a:b])) for a, b in tokens]
    until, keys = list(range(len(tokens))), digits.copy()  # last token of the candidate that begins here, its key
    taken = [False] * len(tokens)
    known = set()
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        first, last = bisect_right(ends, s), bisect_left(starts, e) - 1
        if kind > 0 and not any(taken[first : last + 1]):
            taken[first : last + 1] = [True] * (last + 1 - first)
            until[first], keys[first] = last, "".join(_DIGITS.findall(text[s:e]))
            known.add(keys[first])
    loose = [not t and "@" not in (x := text[a:b]) and not any(map(str.isalpha, x)) for t, (a, b) in zip(taken, tokens, strict=True)]
    joins = [i > 0 and loose[i] and loose[i - 1] and text[ends[i - 1] : starts[i]].isspace() for i in range(len(tokens))]
    known.update(d for d, t in zip(digits, taken, strict=True) if not t)
    rows, row_end, i = Counter(), {}, 0
    while i < len(tokens):
        j = i
        while j + 1 < len(tokens) and joins[j + 1]:
            j += 1
        if j > i and sum(map(len, digits[i : j + 1])) <= GROUP_DIGITS:
            rows["".join(digits[i : j + 1])] += 1
            row_end[i] = j
        i = j + 1
    out, i = [], 0
    while i < len(tokens):
        if loose[i]:
            key, j = digits[i], i
            while j + 1 < len(tokens) and joins[j + 1] and len(key) + len(digits[j + 1]) <= GROUP_DIGITS:
                j += 1
                key += digits[j]
                if key in known or rows[key] > (row_end.get(i) == j):
                    until[i], keys[i] = j, key
        out.append((starts[i], ends[until[i]], keys[i]))
        i = until[i] + 1
    return out


def graph(texts: list[str], spans: list[list[tuple[int, int, int]]] | None = None) -> Graph:
    """spans: the base spans of each text, where the caller has them."""
    home, span, feats, chain, skip = [], [], [], [], []
    for t, text in enumerate(texts):
        seen: dict[str, int] = {}
        before = None
        for start, end, key in _candidates(text, base_spans(text) if spans is None else spans[t]):
            node, token = len(home), text[start:end]
            home.append(t)
            span.append((start, end))
            feats.append(_features(text, start, end))
            if before is not None and text[before[1] : start].isspace():
                chain.append((before[0], node))
            before = (node, end)
            key = token.lower().strip(".,;:!?()[]<>\"'") if "@" in token else key
            if key:
                if key in seen:
                    skip.append((seen[key], node))
                seen[key] = node
    pairs = lambda x: np.array(x, np.int64).reshape(-1, 2)
    return Graph(np.array(home, np.int64), pairs(span), np.array(feats, np.int64).reshape(-1, 19), pairs(chain), pairs(skip))


@dataclass
class Field:
    unary: np.ndarray  # (features, labels), label 0 is none
    chain: np.ndarray  # (labels, labels)
    skip: np.ndarray
    sure: float = SURE


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def _levels(edges: np.ndarray, n: int) -> list[np.ndarray]:
    """The edges by their place on their path: each node has one edge back and one on at most."""
    depth = [0] * n
    for a, b in edges.tolist():
        depth[b] = depth[a] + 1
    place = np.array(depth)[edges[:, 1]]
    order = np.argsort(place, kind="stable")
    return np.split(edges[order], np.flatnonzero(np.diff(place[order])) + 1) if len(edges) else []


def infer(g: Graph, f: Field, rounds: int = MAX_SWEEPS) -> np.ndarray:
    """Label probabilities by loopy sum-product message passing, in sweeps over whole paths."""
    unary = f.unary[g.features].sum(1)
    n, labels = unary.shape
    told = np.zeros((2, 2, n, labels))  # into each node: by chain and skip, from before and after
    live = np.ones(n, bool)
    kinds = [(e, np.exp(p - p.max())) for e, p in ((g.chain, f.chain), (g.skip, f.skip))]
    paths = [_levels(e, n) for e, _ in kinds]
    for sweep in range(rounds):
        step, moved = 1 / (1 + max(0, sweep - SETTLING) / SETTLING), np.zeros(n)
        for k, (_, shared) in enumerate(kinds):
            if not paths[k]:
                continue
            rest = unary + told[1 - k].sum(0)
            for way, by in ((0, shared), (1, shared.T)):
                new = np.zeros((n, labels))
                for edges in paths[k] if way == 0 else reversed(paths[k]):
                    a, b = edges[:, way], edges[:, 1 - way]
                    x = rest[a] + new[a]
                    out = np.log(np.maximum(np.exp(x - x.max(1, keepdims=True)) @ by, 1e-300))
                    new[b] = out - out.max(1, keepdims=True)
                change = np.where(live[:, None], new - told[k, way], 0)
                moved = np.maximum(moved, np.abs(change).max(1))
                told[k, way] += step * change
        still = np.zeros(1 + g.home.max(initial=0), bool)
        still[g.home[moved >= TOLERANCE]] = True
        if not still.any():
            break
        if not still[g.home[live]].all():
            live = still[g.home]
            paths = [_levels(e[live[e[:, 0]]], n) for e, _ in kinds]
    else:
        if rounds == MAX_SWEEPS:
            warnings.warn(f"personal data: messages of {still.sum()} texts still move after {rounds} sweeps", stacklevel=2)
    return _softmax(unary + told.sum((0, 1)))


def _labels(g: Graph, spans: list[list[tuple[int, int, int]]]) -> np.ndarray:
    """1 + kind of the first base span that each token meets, else 0."""
    out = np.zeros(len(g.home), np.int64)
    for i, (t, (a, b)) in enumerate(zip(g.home, g.span, strict=True)):
        out[i] = next((1 + k for k, s, e in spans[t] if s < b and a < e), 0)
    return out


def _fails(kind: int, form: str) -> bool:
    return not any(k == kind for k, _, _ in base_spans(form))


def _disturbed(rng: np.random.Generator, kind: int, form: str) -> str:
    """Another form of an entity, which its pattern does not match (or the form itself, if none is found)."""
    digit = lambda: str(rng.integers(10))
    for _ in range(8):
        if kind == 0:
            name, host = form.split("@", 1)
            new = name + "@" + host.replace(".", "" if rng.random() < 0.5 else "_")
        elif kind == 1:
            parts = form.split(".")
            parts[rng.integers(4)] = str(rng.integers(256, 1000))
            new = ".".join(parts)
        elif kind == 2:
            i = int(rng.choice([i for i, c in enumerate(form) if c.isdigit()]))
            new = form[:i] + digit() + form[i + 1 :]
            if rng.random() < 0.3:
                d = re.sub("[^0-9]", "", form)
                new = rng.choice([".", "/", "_"]).join(d[k : k + 4] for k in range(0, len(d), 4))
        elif kind == 3:
            new = ("00" if rng.random() < 0.5 else "") + form[1:]
        else:
            new = _made_secret(rng)
        if _fails(kind, new):
            return new
    return form


def _made_secret(rng: np.random.Generator) -> str:
    letters = "0123456789abcdef" if rng.random() < 0.6 else "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"
    return "".join(rng.choice(list(letters), int(rng.choice([20, 24, 32, 40, 40, 64]))))


def _plain(rng: np.random.Generator) -> str:
    """A number, or a word with digits, that is nobody's."""
    n = lambda a, b: str(rng.integers(a, b))
    return str(
        rng.choice([
            n(0, 10), n(10, 100), n(1900, 2100), n(1000, 10**8), n(10**8, 10**10), f"{n(0, 100)}.{n(0, 100)}", f"{n(0, 10)}.{n(0, 20)}.{n(0, 50)}", f"v{n(0, 10)}.{n(0, 20)}", f"{n(1990, 2030)}-{n(10, 13)}-{n(10, 29)}",
            f"{n(10, 24)}:{n(10, 60)}", f"{n(10, 24)}:{n(10, 60)}:{n(10, 60)}", f"{n(1, 100)}%", f"${n(1, 10**4)}.{n(10, 100)}", f"#{n(1, 10**5)}", f"{n(2, 99)}th", f"x{n(1, 100)}", f"@{'abcdefghij'[: int(n(3, 9))]}", f"{n(1, 10)},{n(100, 1000)}",
            f"{n(1, 100)}-{n(1, 100)}", f"0x{n(1000, 10**6)}", f"ISO-{n(1000, 9999)}", f"{n(1, 30)}/{n(1, 13)}/{n(1990, 2030)}", f"mp{n(3, 5)}", f"{n(100, 1000)}-{n(1000, 10**4)}",
        ])
    )


def _doubtful(token: str) -> bool:
    """Whether a token that no pattern meets may be personal all the same, so that nothing is learned from it."""
    digits = len(_DIGITS.findall(token))
    return digits >= 9 or "@" in token or token.count(".") >= 3 or (digits > 2 and len(token) >= 16)


def lesson(text: str, rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """A text made of a snippet, and all its spans (kind, start, end)."""
    known = [*base_spans(text), *((4, *m.span(1)) for m in _NAMED.finditer(text))]
    out, spans, at, end = [], [], 0, 0

    def put(part: str, kind: int | None = None) -> None:
        nonlocal at
        if kind is not None:
            spans.append((kind, at, at + len(part)))
        out.append(part)
        at += len(part)

    def between(part: str) -> None:
        put(_TOKEN.sub(lambda m: "x" if _doubtful(m[0]) else m[0], part))
        for _ in range(int(rng.integers(3))):
            put(" ")
            if rng.random() < 0.2:
                put(str(rng.choice(["token = ", "key: ", "secret=", "password: ", "", "", "id "])))
                quote = str(rng.choice(["", '"', "'"]))
                put(quote)
                put(_made_secret(rng), 4)
                put(quote)
            else:
                put(_plain(rng))
            put(" ")

    for kind, a, b in sorted(known, key=lambda x: x[1]):
        if a < end:
            continue
        between(text[end:a])
        put(_disturbed(rng, kind, text[a:b]) if rng.random() < 0.5 else text[a:b], kind)
        if rng.random() < 0.3:
            put(" or ")
            put(_disturbed(rng, kind, text[a:b]), kind)
        end = b
    between(text[end:])
    return "".join(out), spans


def train(texts: list[str], rounds: int = 300, rate: float = 0.1, decay: float = 1e-3, seed: int = 3) -> Field | None:
    """A field from lessons that snippets give: even ones teach, odd ones set what counts as sure."""
    rng = np.random.default_rng(seed)
    lessons = [lesson(t, rng) for t in texts]
    field = _learn(lessons[::2], rounds, rate, decay)
    if field is not None:
        field.sure = _calibrated(field, lessons[1::2])
    return field


def _calibrated(field: Field, lessons: list[tuple[str, list[tuple[int, int, int]]]]) -> float:
    base = [base_spans(t) for t, _ in lessons]
    g = graph([t for t, _ in lessons], base)
    if not len(g.home):
        return SURE
    p, y = infer(g, field), _labels(g, [s for _, s in lessons])
    new = (_labels(g, base) == 0) & (p.argmax(1) > 0)
    best, right = p.max(1)[new], (p.argmax(1) == y)[new]
    order = np.argsort(-best)
    share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    fit = np.flatnonzero(share >= PRECISION)
    return float(min(max(best[order][fit[-1]], 0.5), 0.999)) if len(fit) else 0.999


def _learn(lessons: list[tuple[str, list[tuple[int, int, int]]]], rounds: int, rate: float, decay: float) -> Field | None:
    """Pseudo-likelihood: each candidate given its features and its neighbours' labels."""
    g = graph([t for t, _ in lessons])
    if not len(g.home):
        return None
    y = _labels(g, [s for _, s in lessons])
    n, k = len(y), N_LABELS
    near = np.zeros((4, n, k))  # counts of labels: chain before, after, skip before, after
    for m, (edges, i, j) in enumerate(((g.chain, 0, 1), (g.chain, 1, 0), (g.skip, 0, 1), (g.skip, 1, 0))):
        np.add.at(near[m], (edges[:, j], y[edges[:, i]]), 1)
    f = Field(np.zeros((N_FEATURES, k)), np.zeros((k, k)), np.eye(k))
    one = np.eye(k)[y]
    has = np.zeros((n, N_FEATURES))
    has[np.arange(n)[:, None], g.features] = 1
    weights = [f.unary, f.chain, f.skip]
    m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, rounds + 1):
        p = _softmax(has @ f.unary + near[0] @ f.chain + near[1] @ f.chain.T + near[2] @ f.skip + near[3] @ f.skip.T)
        d = (p - one) / n
        grads = [has.T @ d, near[0].T @ d + (near[1].T @ d).T, near[2].T @ d + (near[3].T @ d).T]
        for w, q, a, b in zip(weights, grads, m, v, strict=True):
            q = q + decay * w / n
            a += 0.1 * (q - a)
            b += 0.01 * (q * q - b)
            w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-10)
    return f


def all_spans(texts: list[str], field: Field | None) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Base spans and added spans of each text."""
    base = [base_spans(t) for t in texts]
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    g = graph(texts, base)
    if field is not None and len(g.home):
        p = infer(g, field)
        for i in np.flatnonzero((p.argmax(1) > 0) & (p.max(1) >= field.sure)):
            t, (a, b), kind = g.home[i], g.span[i].tolist(), int(p[i].argmax()) - 1
            if kind == 4 and (inside := _INSIDE.search(texts[t], a, b)):
                a, b = inside.span(1)
            while a < b and not (texts[t][a].isalnum() or texts[t][a] == "+"):
                a += 1
            while a < b and not texts[t][b - 1].isalnum():
                b -= 1
            if a < b and not any(s < b and a < e for _, s, e in base[t]):
                added[t].append((kind, a, b))
    return list(zip(base, added, strict=True))


def _told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(set(spans)))


def fit(docs: DataFrame, sample_rows: int = 3000, seed: int = 3) -> Field | None:
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), string_column(docs, "text").alias("text")).where(F.col("text").rlike("[0-9@]"))
    start = F.greatest(F.regexp_instr("text", F.lit("[0-9@]")) - SNIPPET // 4, F.lit(1))
    rows = rows.select("id", F.xxhash64("id", "text", F.lit(seed)).alias("h"), F.col("text").substr(start, F.lit(SNIPPET)).alias("snippet"))
    return train([r.snippet for r in smallest(rows, "h", sample_rows, "id", "snippet").collect()], seed=seed)


def find_personal_data(docs: DataFrame, sample_rows: int = 3000) -> DataFrame:
    """doc_id, base counts by kind, base_sha256, spans (base and added), n_added, personal (whether there is any span)."""
    field = fit(docs, sample_rows)
    text = string_column(docs, "text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(text.rlike("[0-9@]"), text).alias("text"))
    empty = hashlib.sha256(b"").hexdigest()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        counts, sha, told, more = np.zeros((BASE_KINDS, n), np.int64), [empty] * n, [""] * n, np.zeros(n, np.int64)
        some = np.flatnonzero(batch.column(1).is_valid().to_numpy(zero_copy_only=False))
        for at in range(0, len(some), 256):
            block = some[at : at + 256]
            for i, (base, added) in zip(block, all_spans([batch.column(1)[int(i)].as_py() for i in block], field), strict=True):
                for k, _, _ in base:
                    counts[k, i] += 1
                if base:
                    sha[i] = hashlib.sha256(_told(base).encode()).hexdigest()
                told[i], more[i] = _told(base + added), len(added)
        columns = [
            batch.column(0),
            *map(pa.array, counts),
            pa.array(sha, pa.string()),
            pa.array(told, pa.string()),
            pa.array(more),
            pa.array([x != "" for x in told], pa.bool_()),
        ]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in FOUND.split(", ")])

    return map_batches(rows, run, FOUND)


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, personal boolean"


def op3_personal_data(spark, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))
