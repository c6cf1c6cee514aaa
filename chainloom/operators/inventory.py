"""Objects and inventories: references, reconciliation, disclosure and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_refs(refs: DataFrame) -> DataFrame:
    """digest, bytes, media, once a digest (of differing descriptors the largest)."""
    return refs.groupBy("digest").agg(F.max(F.struct("bytes", "media")).alias("d")).select("digest", "d.bytes", "d.media")


def object_conflicts(refs: DataFrame) -> DataFrame:
    """digest, n: digests under which different sizes or media are declared."""
    return refs.groupBy("digest").agg(F.count_distinct(F.struct("bytes", "media")).alias("n")).where("n > 1")


def merge_availability(refs: DataFrame) -> DataFrame:
    """digest, available: once stored, an object stays available."""
    return refs.groupBy("digest").agg(F.max("available").alias("available"))


def availability(objects: DataFrame) -> DataFrame:
    """digest, availability: INCLUDED when stored and asked for, WITHHELD when stored only, else UNAVAILABLE."""
    return objects.select("digest", F.when(~F.col("stored"), "UNAVAILABLE").when(F.col("requested"), "INCLUDED").otherwise("WITHHELD").alias("availability"))


def disclosure(objects: DataFrame, by: str) -> DataFrame:
    """by, n_refs, n_included, label: FULL without references or with all bodies, HASHES_ONLY with none, else REDACTED."""
    counts = objects.groupBy(by).agg(F.count("digest").alias("n_refs"), F.count_if(F.col("availability") == "INCLUDED").alias("n_included"))
    label = F.when(
        (F.col("n_refs") == 0) | (F.col("n_included") == F.col("n_refs")),
        "FULL",
    ).when(F.col("n_included") == 0, "HASHES_ONLY").otherwise("REDACTED")
    return counts.withColumn("label", label)


def disclose(objects: DataFrame, include: DataFrame) -> DataFrame:
    """Keeps the bodies of the chosen digests; the others that were included become WITHHELD."""
    chosen = include.select("digest").distinct().withColumn("_in", F.lit(True))
    keep = F.coalesce("_in", F.lit(False)) | (F.col("availability") != "INCLUDED")
    return objects.join(chosen, "digest", "left").withColumn("availability", F.when(keep, F.col("availability")).otherwise("WITHHELD")).drop("_in")


def reconcile(expected: DataFrame, declared: DataFrame) -> DataFrame:
    """kind, digest, reason of every mismatch between what an inventory should hold (kind, digest,
    bytes) and what it declares (also availability, has_body): one full outer join."""
    left = expected.select("kind", "digest", F.col("bytes").alias("e_bytes")).distinct().withColumn("_e", F.lit(1))
    right = declared.groupBy("kind", "digest").agg(
        F.count("*").alias("n"),
        F.min("bytes").alias("bytes"),
        F.min("availability").alias("availability"),
        F.max("has_body").alias("has_body"),
    )
    reason = (
        F.when(F.col("n").isNull(), "MISSING")
        .when(F.col("_e").isNull(), "EXTRA")
        .when(F.col("n") > 1, "DUPLICATE")
        .when(F.col("bytes") != F.col("e_bytes"), "BYTES")
        .when((F.col("kind") != "object") & (F.col("availability") != "INCLUDED"), "NOT_INCLUDED")
        .when((F.col("kind") == "object") & (F.col("availability") == "INCLUDED") & ~F.col("has_body"), "NO_BODY")
        .when((F.col("availability") != "INCLUDED") & F.col("has_body"), "UNEXPECTED_BODY")
    )
    return left.join(right, ["kind", "digest"], "full").select("kind", "digest", reason.alias("reason")).where("reason is not null")


def evidence_root(parts: DataFrame, tag: str = "evidence") -> DataFrame:
    """evidence: one hash over all (kind, digest) in order. As a single ordered hash it is bounded by
    what one row can hold; evidence_tree() is the form for larger sets, under another name."""
    from ..functions.canon import domain_hash

    lines = F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "kind", "digest"))), ",")
    return parts.agg(domain_hash(tag, lines).alias("evidence"))


#: Digests that one leaf of evidence_tree() holds in the mean at most.
LEAF_DIGESTS = 4096


def evidence_tree(parts: DataFrame, tag: str = "evidence-tree") -> DataFrame:
    """evidence: hashes of the sets with each digest prefix, then of these by shorter prefixes, two characters at a time, up to one. The
    first prefix grows with the number of digests, so no leaf and no node grows with the data."""
    from ..functions.canon import domain_hash

    rows, depth = parts.select("kind", "digest").distinct(), 2
    n = rows.count()
    while n > LEAF_DIGESTS * 16**depth:
        depth += 2
    leaf = rows.groupBy(F.substring("digest", 1, depth).alias("prefix")).agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "kind", "digest"))), ",").alias("x")
    )
    node = leaf.select("prefix", domain_hash(tag, F.col("x")).alias("h"))
    while depth:
        depth -= 2
        hashes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("prefix", "h"))), lambda x: x["h"]), ",")
        up = node.groupBy(F.substring("prefix", 1, depth).alias("up")) if depth else node.groupBy()
        node = up.agg(domain_hash(tag, hashes).alias("h")).select(*([F.col("up").alias("prefix")] if depth else []), "h")
    return node.select(F.col("h").alias("evidence"))


def manifest(files: DataFrame) -> DataFrame:
    """path, bytes, digest of binary rows (path, content), as a backup's manifest."""
    return files.select("path", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("digest"))


def manifest_check(manifest_rows: DataFrame, files: DataFrame) -> DataFrame:
    """path, code of files that are missing, extra or changed against a manifest."""
    now = manifest(files).select("path", F.col("digest").alias("now"))
    code = F.when(F.col("now").isNull(), "MISSING").when(F.col("digest").isNull(), "EXTRA").when(F.col("now") != F.col("digest"), "CHANGED")
    return manifest_rows.select("path", "digest").join(now, "path", "full").select("path", code.alias("code")).where("code is not null")


def _files_under(spark, path: str) -> DataFrame:
    """path (relative), content of all files under a folder."""
    from urllib.parse import unquote, urlparse

    root = unquote(urlparse(path).path).rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "[!.]*").load(path)
    return rows.select(F.substring_index("path", f"{root}/", -1).alias("path"), "content")


def _copied(rows: DataFrame, to: str) -> DataFrame:
    """Writes files (path, content) under a folder, each by the task that holds it; path, bytes, digest of what was written."""
    from ..session import workers

    def write(batches):
        import hashlib
        import os

        import pandas as pd

        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                place = f"{to}/{path}"
                os.makedirs(os.path.dirname(place), exist_ok=True)
                with open(place, "xb") as f:
                    f.write(content)
                out.append((path, len(content), hashlib.sha256(content).hexdigest()))
            yield pd.DataFrame(out, columns=["path", "bytes", "digest"])

    workers(rows.sparkSession)
    return rows.mapInPandas(write, "path string, bytes long, digest string")


def backup(spark, root: str, to: str) -> None:
    """Copies a store's files to `to`/files and their manifest to `to`/manifest, on folders that all executors mount."""
    _copied(_files_under(spark, root), f"{to}/files").write.mode("errorifexists").parquet(f"{to}/manifest")


def restore(spark, backup_path: str, to: str) -> int:
    """Copies a backup's files back when every one is as its manifest says, and returns their number; else raises."""
    from ..sources.tables import ObjectConflict
    from .validate import backup_path_rule

    rows, told = _files_under(spark, f"{backup_path}/files"), spark.read.parquet(f"{backup_path}/manifest")
    if manifest_check(told, rows).head(1) or told.where(~backup_path_rule(F.col("path"))).head(1):
        raise ObjectConflict("BACKUP_INVALID")
    return _copied(rows, to).count()


def dependencies(required: DataFrame, available: DataFrame) -> DataFrame:
    """owner, n_missing: required (owner, digest) that are not among the available digests."""
    have = available.select("digest").distinct().withColumn("_have", F.lit(1))
    return required.join(have, "digest", "left").groupBy("owner").agg(F.count_if(F.col("_have").isNull()).alias("n_missing"))
