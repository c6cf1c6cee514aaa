"""MinHash near-dedup (operator 4): chosen-path set similarity join.

A document's set is its distinct word shingles; its signature holds the minimum of the set under
`COORDS` hash functions, and the low byte of it under `BYTES` more. Equal sets form one class, and
classes are joined. Each of TREES independent trees begins with one node for each value of one
coordinate. At every level
  - a node with one class, or only classes that are linked already, is dropped;
  - in every other node one pivot is compared with all classes, which takes linear work and connects
    large groups of near copies without expanding them into pairs;
  - a node of at most SMALL classes, of which some are still not linked, is then compared exhaustively:
    by signature for the classes that have a likely partner with another label, then on the full sets
    of these, likeliest pairs first, where a pair that others already connect is passed over. So what
    leaves a node is fewer links than it has classes, never its pairs;
  - a larger one is branched: each class goes to the children named by its values at BRANCHES
    coordinates that the node's path chooses.
A pair of similarity s survives a branching with expectation s * BRANCHES > 1 above the threshold, and
pairs well below it die out. Comparison is by signature; likely pairs are confirmed on full shingle
sets, and confirmed links are merged into components, which prunes what follows. Pivots are taken from
the rarest labels, so a node that is all but one large component is done once its few others were
pivots. From level LAST_LEVEL on nodes are thinned by their pivots alone until they are small, so nothing is left out. A
pair at the threshold is missed by one tree with probability under 0.34, by all ten under 2e-5.

Classes, roots and what a level needs stand in written tables; a lost executor repeats tasks of written
inputs only, and a level's tables are deleted when the next one has its own.

Defined results: without words or text a document has an empty set, and is linked with nothing; a row
with a null doc_id is not linked (component_id null, kept); rows with one doc_id each have their own
set; repeated rows share a class; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernel
from .runtime import discard, map_batches, map_groups, string_column, table, workers
from .runtime import written as settled

WORDS = 5  # in a shingle
NUMERATOR, DENOMINATOR = 75, 100
TREES, COORDS, BYTES, BRANCHES = 10, 40, 96, 2
SMALL, PIVOTS = 2000, 32
#: Nodes have PIVOTS pivots from MAX_LEVELS on, and are no more branched from LAST_LEVEL on.
MAX_LEVELS, LAST_LEVEL = 6, 30
#: Equal coordinates from which a pair is confirmed on full sets, of the COORDS and of all. A pair at the threshold has
#: 30 and 102 in the mean, and fewer than these with probabilities of about 1e-6 and 3e-6.
LOOSE, LIKELY = 16, 79
#: Links that one task merges (32 bytes each); more are merged by joins, to the same result.
TASK_EDGES = 500_000
#: Sets of one node that stand side by side in a task; nodes with more are thinned by PIVOTS pivots at a time.
NODE_BYTES = 64_000_000
#: Up to so many ids or components are broadcast (16 or 24 bytes each); beyond it the join shuffles.
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(4)
_A = (_rng.integers(0, 1 << 63, COORDS + BYTES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, COORDS + BYTES, dtype=np.uint64)
_WIDTH = 4 * COORDS + BYTES


def _sets(column: pa.Array, k: int):
    """The distinct shingle hashes of each text, sorted."""
    for i, j, w in kernel.text_words(column):
        h, at = kernel.shingles(w, k)
        cut = np.searchsorted(at, np.arange(j - i + 1))
        for t in range(j - i):
            own = np.sort(h[cut[t] : cut[t + 1]])
            yield own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) else own


def _key(own: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        return np.array([kernel.mix(own ^ np.uint64(s)).sum(dtype=np.uint64) + np.uint64(len(own)) for s in (11, 13)], np.uint64).tobytes()


def _signature(own: np.ndarray) -> bytes:
    out = np.full(COORDS + BYTES, 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(own), 1024):
            x = own[i : i + 1024, None] * _A
            x += _B
            np.minimum(out, x.min(0), out=out)
    out >>= np.uint64(24)
    return (out[:COORDS] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + (out[COORDS:] & np.uint64(0xFF)).astype(np.uint8).tobytes()


def signatures(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, class (16 bytes that equal sets share), sig (null for an empty set)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, key, sig = [], [], []
        for own in _sets(batch.column(1), k):
            n.append(len(own))
            key.append(_key(own) if len(own) else None)
            sig.append(_signature(own) if len(own) else None)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())],
            ["doc_id", "n_shingles", "class", "sig"],
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), string_column(docs, "text").alias("text"))
    return map_batches(rows, run, "doc_id long, n_shingles long, class binary, sig binary")


def _split(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and bytes of signatures that stand one after another."""
    rows = data.reshape(-1, _WIDTH)
    return np.ascontiguousarray(rows[:, : 4 * COORDS]).view(np.uint32), rows[:, 4 * COORDS :]


def _column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, at = kernel.buffers(column)
    return _split(data[at[0] : at[-1]])


def _likely_pairs(node: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers a < b of likely pairs with different labels, their equal coordinates, and the labels
    as numbers. node: rows with label and sig."""
    labels = np.unique(np.array(node.column("label").to_pylist(), "S16"), return_inverse=True)[1]
    coords, low = _column(node.column("sig"))
    equal = np.zeros((len(labels), len(labels)), np.uint8)
    for c in range(COORDS):
        equal += coords[:, c, None] == coords[None, :, c]
    a, b = np.nonzero(np.triu(equal >= LOOSE, 1) & (labels[:, None] != labels[None, :]))
    score = np.zeros(len(a), np.int64)
    for i in range(0, len(a), 8192):
        x, y = a[i : i + 8192], b[i : i + 8192]
        score[i : i + 8192] = equal[x, y] + (low[x] == low[y]).sum(1)
    near = score >= LIKELY
    return a[near], b[near], score[near], labels


def _with_partner(rows: DataFrame) -> DataFrame:
    """node, class, label of the classes that have a likely partner with another label in their node.
    rows: node, class, label, sig."""

    def partners(node: pa.RecordBatch) -> tuple[list, list, list]:
        a, b, _, _ = _likely_pairs(node)
        some = node.take(pa.array(np.union1d(a, b)))
        return tuple(some.column(c).to_pylist() for c in ("node", "class", "label"))

    return map_groups(rows, "node", partners, "node long, class binary, label binary")


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough."""
    if NUMERATOR * max(len(x), len(y)) > DENOMINATOR * min(len(x), len(y)):
        return False
    place = np.searchsorted(x, y)
    both = int((x[np.minimum(place, len(x) - 1)] == y).sum())
    return DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both)


def _links_in_nodes(rows: DataFrame) -> DataFrame:
    """Confirmed links a < b that connect whatever is connected within each node, and no more of them
    than it takes. rows: node, class, label, sig, items (the full sets)."""

    def links(node: pa.RecordBatch) -> tuple[list, list]:
        left, right = [], []
        a, b, score, label = _likely_pairs(node)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in node.column("items")]
        keys = node.column("class").to_pylist()
        find, root = _finder(int(label.max(initial=0)) + 1)
        for k in np.argsort(-score, kind="stable"):
            x, y = int(a[k]), int(b[k])
            p, q = find(label[x]), find(label[y])
            if p != q and _similar(sets[x], sets[y]):
                root[p] = q
                left.append(min(keys[x], keys[y]))
                right.append(max(keys[x], keys[y]))
        return left, right

    return map_groups(rows, "node", links, "a binary, b binary")


def _finder(n: int):
    """find(i) over n single members, and the list of roots that it reads."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    return find, root


def _likely(pairs: DataFrame) -> DataFrame:
    """The likely ones of pairs (a, b, x, y), x and y their signatures."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        (p, x), (q, y) = _column(batch.column(2)), _column(batch.column(3))
        near = (p == q).sum(1) + (x == y).sum(1) >= LIKELY
        return batch.select(["a", "b"]).filter(pa.array(near))

    return map_batches(pairs, run, "a binary, b binary")


def full_sets(wanted: DataFrame, docs: DataFrame, classes: DataFrame, k: int = WORDS) -> DataFrame:
    """class, items: the full sets of the wanted classes, made anew from the text of one document each."""
    wanted = settled(classes.join(wanted.select("class").distinct(), "class", "left_semi").select("class", "first_id"), "near-wanted")
    few = wanted.count() <= BROADCAST_IDS
    rows = docs.select(F.col("doc_id").cast("long").alias("first_id"), string_column(docs, "text").alias("text"))
    rows = rows.join(F.broadcast(wanted) if few else wanted, "first_id").select("class", "text")

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, data = [], []
        for key, own in zip(batch.column(0).to_pylist(), _sets(batch.column(1), k), strict=True):
            if len(own) and _key(own) == key:  # another row of this doc_id may have another text
                keys.append(key)
                data.append(own.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(data, pa.binary())], ["class", "items"])

    out = settled(map_batches(rows, sets, "class binary, items binary").dropDuplicates(["class"]), "near-sets")
    discard(wanted)
    return out


def confirm(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough."""

    def similar(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [[np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(c)] for c in (2, 3)]
        return batch.select(["a", "b"]).filter(pa.array([_similar(x, y) for x, y in zip(*sets, strict=True)], pa.bool_()))

    full = pairs.join(items.select(F.col("class").alias("a"), F.col("items").alias("left")), "a").join(
        items.select(F.col("class").alias("b"), F.col("items").alias("right")),
        "b",
    )
    return map_batches(full.select("a", "b", "left", "right"), similar, "a binary, b binary")


def _components_of_few(edges: DataFrame) -> DataFrame:
    """components() by union-find over one table of at most TASK_EDGES links."""

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        ends = [np.frombuffer(b"".join(t.column(c).to_pylist()), "V16") for c in (0, 1)]
        both = np.concatenate(ends).view(np.uint8).reshape(-1, 16)
        keys, number = np.unique(both, axis=0, return_inverse=True)  # in byte order
        find, root = _finder(len(keys))
        number = number.reshape(2, -1)
        for x, y in zip(number[0].tolist(), number[1].tolist(), strict=True):
            p, q = find(x), find(y)
            root[max(p, q)] = min(p, q)
        names = [k.tobytes() for k in keys]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([names[find(i)] for i in range(len(names))], pa.binary())], ["class", "root"])

    workers(edges.sparkSession)
    return edges.coalesce(1).mapInArrow(run, "class binary, root binary")


def components(links: DataFrame) -> DataFrame:
    """class, root: the smallest class reachable, for the classes in some link. Up to TASK_EDGES links
    are merged in one task; of more, stars are alternately made large (neighbours of a class that stand
    above it move to its smallest) and small, until nothing moves."""
    edges = settled(links.select("a", "b").where("a <> b").distinct(), "near-edges")
    if edges.count() <= TASK_EDGES:
        return _components_of_few(edges)
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(small_low, "u").select(
            F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e")
        )
        after = settled(small.select(F.col("e.u").alias("b"), F.col("e.v").alias("a")).where("a <> b").distinct().select("a", "b"), "near-edges")
        sides = lambda x: x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if sides(after) == sides(edges):
            roots = after.select(F.col("b").alias("class"), F.col("a").alias("root"))
            return roots.union(after.select(F.col("a").alias("class"), F.col("a").alias("root")).distinct())
        edges = after


def _coordinate(c: Column) -> Column:
    return F.substring(F.col("sig"), c * 4 + 1, F.lit(4))


class _Links:
    """The root of every class that is linked so far."""

    def __init__(self, docs: DataFrame, classes: DataFrame, k: int):
        self.docs, self.classes, self.k = docs, classes, k
        self.roots, self.empty = settled(docs.sparkSession.createDataFrame([], "class binary, root binary"), "near-roots"), True

    def add(self, likely: DataFrame) -> None:
        """Confirms likely pairs and merges the links."""
        pairs = settled(likely.distinct(), "near-pairs")
        if pairs.head(1):
            items = full_sets(pairs.select(F.col("a").alias("class")).union(pairs.select("b")), self.docs, self.classes, self.k)
            self._merge(confirm(pairs, items))
            discard(items)
        discard(pairs)

    def add_from_nodes(self, open_: DataFrame) -> None:
        """Merges the links within nodes of at most SMALL classes (node, class, label, sig)."""
        some = settled(_with_partner(open_.select("node", "class", "label", "sig")), "near-partners")
        if some.head(1):
            items = full_sets(some, self.docs, self.classes, self.k)
            fits = F.sum(F.col("n_shingles") * 8).over(Window.partitionBy("node")) <= NODE_BYTES
            rows = settled(some.join(self.classes.select("class", "sig", "n_shingles"), "class").withColumn("fits", fits), "near-sized")
            self._merge(_links_in_nodes(rows.where("fits").join(items, "class").select("node", "class", "label", "sig", "items")))
            self._thin(rows.where("not fits").select("node", "class", "label", "sig"))
            discard(rows, items)
        discard(some)

    def _thin(self, rows: DataFrame) -> None:
        """Links within nodes whose sets are too long to stand side by side: every class with every pivot, some pivots at a time."""
        while rows.head(1):
            pivots = self.pivots(rows, PIVOTS)
            self.add(self.stars(rows.select("node", "class", "sig"), pivots))
            left = rows.select("node", "class", "sig").join(pivots.select("node", F.col("pivot").alias("class")), ["node", "class"], "left_anti")
            before, rows = rows, settled(self.label(left).select("node", "class", "label", "sig"), "near-large")
            discard(before, pivots)

    def pivots(self, rows: DataFrame, n: int) -> DataFrame:
        """node, pivot, pivot_sig: n classes of each node (node, class, label, sig), the first of its rarest labels before
        others: when all classes but the pivots share one label, the node is done."""
        one = F.struct(F.xxhash64("node", "class").alias("h"), F.col("class").alias("pivot"), F.col("sig").alias("pivot_sig"))
        if n == 1 and self.empty:
            some = rows.groupBy("node").agg(F.min(one).alias("p"))
        elif n == 1:
            own = rows.groupBy("node", "label").agg(F.count("*").alias("m"), F.min(one).alias("p"))
            some = own.groupBy("node").agg(F.min(F.struct("m", "p")).alias("x")).select("node", "x.p")
        else:
            rare = rows.groupBy("node", "label").agg(F.count("*").alias("m"))
            rank = F.row_number().over(Window.partitionBy("node").orderBy("m", F.xxhash64("node", "class"), "class"))
            some = rows.join(rare, ["node", "label"]).withColumn("rank", rank).where(F.col("rank") <= n).select("node", one.alias("p"))
        return settled(some.select("node", "p.pivot", "p.pivot_sig"), "near-pivots")

    def stars(self, rows: DataFrame, pivots: DataFrame) -> DataFrame:
        """The likely pairs (a < b) of the classes of nodes (node, class, sig) with their pivots."""
        star = rows.select("node", "class", "sig").join(pivots, "node").where("class <> pivot")
        lower = F.col("class") < F.col("pivot")
        x, y = F.when(lower, F.col("sig")).otherwise(F.col("pivot_sig")), F.when(lower, F.col("pivot_sig")).otherwise(F.col("sig"))
        return _likely(star.select(F.least("class", "pivot").alias("a"), F.greatest("class", "pivot").alias("b"), x.alias("x"), y.alias("y")))

    def _merge(self, links: DataFrame) -> None:
        """New links are taken between the roots of their ends, so that what is merged already is not merged again."""
        root_of = lambda c: self.roots.select(F.col("class").alias(c), F.col("root").alias(f"root_{c}"))
        ends = links.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left")
        ends = ends.select(F.coalesce("root_a", "a").alias("x"), F.coalesce("root_b", "b").alias("y")).where("x <> y")
        found = settled(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "near-links")
        if found.head(1):
            moved = settled(components(found), "near-moved")
            to = moved.select(F.col("class").alias("root"), F.col("root").alias("to"))
            old = self.roots.join(to, "root", "left").select("class", F.coalesce("to", "root").alias("root"))
            new = moved.join(self.roots.select("class"), "class", "left_anti")
            before, self.roots, self.empty = self.roots, settled(old.unionByName(new), "near-roots"), False
            discard(before, moved)
        discard(found)

    def label(self, rows: DataFrame) -> DataFrame:
        """rows with the root of their class as label, of nodes with more than one label; n: their size."""
        rows = rows.join(self.roots, "class", "left").withColumn("label", F.coalesce("root", "class")).drop("root")
        size = rows.groupBy("node").agg(
            F.count("*").alias("n"),
            F.min("label").alias("low"),
            F.max("label").alias("high"),
        ).where("low <> high").select("node", "n")
        return rows.join(size, "node")


def similar_classes(docs: DataFrame, classes: DataFrame, k: int = WORDS) -> DataFrame:
    """class, root for the classes that are linked with another. classes: class, first_id, sig, n_shingles."""
    known, level, rest = _Links(docs, classes, k), 0, None
    signed = classes.select("class", "sig")
    roots = [F.xxhash64(F.lit(t), _coordinate(F.lit(t))) for t in range(TREES)]
    nodes = classes.select("class", F.explode(F.array(*roots)).alias("node"))
    while True:
        live = settled(known.label(nodes).select("node", "class", "label").join(signed, "class"), "near-nodes")
        discard(rest)
        pivots = known.pivots(live, PIVOTS if level >= MAX_LEVELS else 1)
        known.add(known.stars(live, pivots))
        open_ = known.label(live.drop("label"))
        known.add_from_nodes(open_.where(F.col("n") <= SMALL))
        rest = known.label(live.drop("label")).where(F.col("n") > SMALL).join(
            pivots.select("node", F.col("pivot").alias("class")),
            ["node", "class"],
            "left_anti",
        )
        rest = settled(rest.select("node", "class", "sig"), "near-rest")
        discard(live, pivots)
        if not rest.head(1):
            return known.roots
        level += 1
        if level < LAST_LEVEL:
            at = [F.pmod(F.xxhash64("node", F.lit(j)), F.lit(COORDS - TREES)).cast("int") + TREES for j in range(BRANCHES)]
            child = F.array_distinct(F.array(*[F.xxhash64("node", c, _coordinate(c)) for c in at]))
            nodes = rest.select("class", F.explode(child).alias("node"))
        else:
            nodes = rest.select("class", "node")


def near_duplicates(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    signed = settled(signatures(docs, k), "near-signatures")
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("class").agg(
        F.min("doc_id").alias("first_id"),
        F.max("sig").alias("sig"),
        F.max("n_shingles").alias("n_shingles"),
    )
    classes = settled(classes, "near-classes")
    roots = similar_classes(docs, classes, k)
    # only classes that are linked have another component than their own first id
    linked = classes.select("class", "first_id").join(roots, "class")
    first = settled(linked.groupBy("root").agg(F.min("first_id").alias("component")), "near-components")
    few = first.count() <= BROADCAST_IDS
    member = linked.join(F.broadcast(first) if few else first, "root").select("class", "component")
    alone = classes.join(roots, "class", "left_anti").select("class", F.col("first_id").alias("component"))
    member = member.unionByName(alone)
    out = signed.select("doc_id", "n_shingles", "class").join(member, "class", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op4_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE told AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM told),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM items a JOIN items b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs WHERE 100 * c >= 75 * (n + m - c)),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(r.low, s.doc_id)) AS component_id, s.doc_id <= coalesce(r.low, s.doc_id) AS kept
FROM sets s LEFT JOIN (SELECT x, min(y) AS low FROM reach GROUP BY x) r ON s.doc_id = r.x
"""


def kept_rows(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """The rows of docs, with all their columns, that stay when one document of each component does.
    Decisions go by doc_id: an id goes when none of its rows is kept, and where a row occurs again
    with the same id and text, one of them stays. Rows with a null doc_id stay. Without a column `text` no
    document is linked."""
    told = settled(near_duplicates(docs, k), "near-decisions")
    ids = told.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    gone = settled(ids.where("not kept").select("_id"), "near-gone")
    few = gone.count() <= BROADCAST_IDS
    row = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").cast("long").alias("own_id"),
        string_column(docs, "text").alias("own_text"),
    )
    out = row.join(F.broadcast(gone) if few else gone, F.col("own_id") == F.col("_id"), "left_anti")
    if ids.where("kept and n > 1").head(1):
        once = out.where("own_id is not null").select(
            "row",
            "own_id",
            F.md5(F.coalesce(F.col("own_text"), F.lit("")).cast("binary")).alias("digest"),
        ).dropDuplicates(["own_id", "digest"])
        out = once.select("row").unionByName(out.where("own_id is null").select("row"))
    return out.select("row.*")
