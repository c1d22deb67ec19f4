"""Change detection and versions of files; snapshots in, snapshots out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def current(doc: DataFrame, knowledge_ext: DataFrame) -> DataFrame:
    """Active knowledge; documents without a version are current."""
    active = doc.where((F.col("type") == "knowledge") & (F.col("status") == "active"))
    return active.join(knowledge_ext, "id", "left").where(F.coalesce("is_current", F.lit(True)))


def classify(existing: DataFrame, scanned: DataFrame) -> DataFrame:
    """path and change (same, changed, new, missing), by hashes of the contents, so that texts don't meet in the join."""
    old = existing.select(F.col("source_path").alias("path"), "id", F.sha2("content", 256).alias("old_hash"))
    new = scanned.select("path", F.sha2("content", 256).alias("new_hash"))
    change = F.when(F.col("old_hash").isNull(), "new").when(F.col("new_hash").isNull(), "missing").when(F.col("old_hash") == F.col("new_hash"), "same").otherwise("changed")
    return old.join(new, "path", "full_outer").select("path", "id", change.alias("change"))


def reindex(existing: DataFrame, knowledge_ext: DataFrame, scanned: DataFrame, now: Column) -> DataFrame:
    """The rows after a scan, with their dates: same ones stay and are bumped, changed ones are archived and get a successor that keeps created_at, new ones begin, missing ones are deleted.

    ``existing``: id, source_path, content, created_at; ``scanned``: path, content. The join meets hashes, not contents.
    """
    known = existing.join(knowledge_ext, "id", "left").select("id", F.col("source_path").alias("path"), F.coalesce("version", F.lit(1)).alias("version"), "created_at", F.sha2("content", 256).alias("old_hash"))
    both = known.join(scanned.select("path", F.sha2("content", 256).alias("new_hash")), "path", "full_outer")
    same, old = F.col("old_hash") == F.col("new_hash"), F.col("old_hash")
    kind = "id:string,version:bigint,status:string,is_current:boolean,content_hash:string,created_at:timestamp_ntz,updated_at:timestamp_ntz"
    row = lambda id_, version, status, current_, hash_, born: F.struct(
        id_.alias("id"), version.cast("long").alias("version"), F.lit(status).alias("status"), F.lit(current_).alias("is_current"), hash_.alias("content_hash"), born.cast("timestamp_ntz").alias("created_at"), now.cast("timestamp_ntz").alias("updated_at")
    )
    born, following = F.coalesce("created_at", now), F.coalesce("version", F.lit(0)) + 1
    successor = row(F.sha2(F.concat_ws(":", "path", following.cast("string")), 256), following, "active", True, F.col("new_hash"), born)
    kept = lambda status, current_: row(F.col("id"), F.col("version"), status, current_, old, F.col("created_at"))
    rows = (
        F.when(old.isNull(), F.array(successor)).when(F.col("new_hash").isNull(), F.array(kept("deleted", False)))
        .when(same, F.array(kept("active", True))).when(~same, F.array(kept("archived", False), successor)).otherwise(F.array().cast(f"array<struct<{kind}>>"))
    )
    return both.select("path", F.explode(rows).alias("row")).select("path", "row.*")


def to_read(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, mtime, length of the files whose entry in the manifest of the last scan is missing or another one; only these have to be read."""
    return listing.select("path", "mtime", "length").join(manifest.select("path", "mtime", "length"), ["path", "mtime", "length"], "left_anti")


def vanished(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """path of the files that the last scan had and this one hasn't."""
    return manifest.select("path").join(listing.select("path"), "path", "left_anti")


def missing(existing: DataFrame, scanned: DataFrame) -> DataFrame:
    """The existing rows whose path the scan doesn't have."""
    return existing.join(scanned.select(F.col("path").alias("source_path")), "source_path", "left_anti")


def history(changes: DataFrame) -> DataFrame:
    """path, seq, content to version numbers; only a content that differs from the one before makes a version."""
    order = Window.partitionBy("path").orderBy("seq")
    fresh = changes.withColumn("before", F.lag("content_hash").over(order)).where(F.col("before").isNull() | (F.col("before") != F.col("content_hash")))
    return fresh.select("path", "seq", "content_hash", F.row_number().over(order).cast("long").alias("version"), F.lead("seq").over(order).isNull().alias("is_current"))


def orphans(doc: DataFrame, knowledge_ext: DataFrame) -> DataFrame:
    return doc.where("type = 'knowledge'").join(knowledge_ext.where("id IS NOT NULL"), "id", "left_anti")


def cleanup_old_versions(doc: DataFrame, knowledge_ext: DataFrame) -> DataFrame:
    """Without rows of old versions, and without knowledge that then has no version."""
    kept = knowledge_ext.where("is_current")
    return doc.join(kept.select("id", F.lit(True).alias("has_version")), "id", "left").where((F.col("type") != "knowledge") | F.col("has_version")).drop("has_version")
