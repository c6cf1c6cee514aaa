"""Reading and writing the engine's tables, content-addressed objects and bundles."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, settle


class RevisionConflict(ValueError):
    """Someone else published first."""


class ObjectConflict(ValueError):
    """Content under a digest that is not its own, or one digest with two sizes."""


def _files(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _commits(spark: SparkSession, root: str) -> dict[int, dict]:
    """The commits under root by revision: small files, one a revision."""
    files, place = _files(spark, f"{root}/commits")
    if not files.exists(place):
        return {}
    rows = spark.read.option("wholetext", True).text(f"{root}/commits").collect()
    return {c["revision"]: c for c in (json.loads(r.value) for r in rows)}


def latest_revision(spark: SparkSession, root: str) -> int:
    """The last published revision under root; 0 before the first."""
    return max(_commits(spark, root), default=0)


def _content(spark: SparkSession, path: str) -> list:
    """Count and order-free hash of a staged table."""
    df = spark.read.parquet(path)
    parts = [F.array_sort(F.map_entries(c)) if t.startswith("map") else F.col(c) for c, t in df.dtypes]
    one = df.select(F.xxhash64(*parts).alias("h")).agg(F.count("*").alias("n"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("h")).first()
    return [one.n, one.h]


def publish(spark: SparkSession, root: str, expected: int, **tables: DataFrame) -> int:
    """Publishes tables together as the revision after `expected`. They are staged in a folder of their own, which nobody reads,
    and become visible all at once by one exclusive create of the revision's commit file. Who comes
    second raises RevisionConflict, but for a retry of the same content, which adopts what is there."""
    stage = f"data/{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{root}/{stage}/{name}")
    content = {name: _content(spark, f"{root}/{stage}/{name}") for name in tables}
    known, revision = _commits(spark, root), expected + 1
    if max(known, default=0) == expected:
        files, place = _files(spark, f"{root}/commits/{revision:020d}.json")
        text = json.dumps({"revision": revision, "data": stage, "content": content})
        try:
            out = files.create(place, False)
        except Py4JJavaError:  # someone was faster
            known = _commits(spark, root)
        else:
            out.write(bytearray(text.encode()))
            out.close()
            return revision
    files, place = _files(spark, f"{root}/{stage}")
    files.delete(place, True)
    if known.get(revision, {}).get("content") != content:
        raise RevisionConflict("REVISION_CONFLICT")
    return revision


def published(spark: SparkSession, root: str, name: str, revision: int | None = None) -> DataFrame | None:
    """What the revisions up to one (all of them) have published of a table; None before it has any."""
    commits = _commits(spark, root)
    own = [f"{root}/{c['data']}/{name}" for r, c in sorted(commits.items()) if name in c["content"] and (revision is None or r <= revision)]
    return spark.read.parquet(*own) if own else None


def recover(spark: SparkSession, root: str) -> int:
    """Deletes staged folders that no commit names, left by writers that ended before they published; their number. To be run
    while nobody publishes."""
    files, place = _files(spark, f"{root}/data")
    if not files.exists(place):
        return 0
    named = {c["data"].split("/")[1] for c in _commits(spark, root).values()}
    lost = [s.getPath() for s in files.listStatus(place) if s.getPath().getName() not in named]
    for path in lost:
        files.delete(path, True)
    return len(lost)


def read_json_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole JSON files; functions.canon.parse_column() reads them strictly."""
    return spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("text"))


def write_objects(objects: DataFrame, path: str) -> int:
    """Stores content (binary) under its digest, partitioned by the digest's first two characters, and returns how many were new. What
    is held already is adopted after a look at its content; content that is not intact, or is given under
    another `digest`, raises ObjectConflict."""
    spark = objects.sparkSession
    rows = objects.withColumn("_own", F.sha2("content", 256))
    if "digest" in objects.columns and rows.where("digest <> _own").head(1):
        raise ObjectConflict("OBJECT_CONFLICT")
    rows = rows.select(F.col("_own").alias("digest"), "content").dropDuplicates(["digest"])
    files, place = _files(spark, path)
    if files.exists(place):
        held = read_objects(spark, path).join(rows.select("digest"), "digest", "left_semi")
        if held.where("not intact").head(1):
            raise ObjectConflict("OBJECT_CONFLICT")
        rows = rows.join(held.select("digest"), "digest", "left_anti")
    new = settle(rows.withColumn("prefix", F.substring("digest", 1, 2)), "objects")
    new.write.partitionBy("prefix").mode("append").parquet(path)
    n = new.count()
    discard(new)
    return n


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """digest, content, intact (whether the content still has its digest)."""
    rows = spark.read.parquet(path)
    return rows.select("digest", "content", (F.sha2("content", 256) == F.col("digest")).alias("intact"))
