"""Incremental refresh when vulnerability feed files land or are published again.

* :func:`feeds_changed` -- which yearly feeds must be re-read: a manifest row
  (year, sha256) that is new or differs from the stored one (anti-join);
  :func:`scan_feed_meta` reads the feeds' metadata text into such a manifest, and
  the catalogue is re-read when older than ``max_age_days``.
* :func:`refresh` -- digests every feed in the landing folder by its content, puts
  each new or changed version into an inbox under a name made of feed and digest,
  and runs a Structured Streaming file source with ``trigger(availableNow=True)``
  over the inbox. Each micro-batch replaces the state of the feeds it holds, so
  entries that a feed has lost are gone; entries without products or CVSS stay in
  the state as tombstones, because the newest version of an entry counts whatever
  it holds. The worst case is recomputed only for the products that the batch
  touched. A re-published feed has a new digest and is therefore read again.

State tables are split into parts (feeds; hash buckets of products); a batch
writes new versions of the parts it touches and keeps the version before, so a
repeated batch after a failure starts from the same input and rewrites the same
version. The stream's checkpoint records which inbox files were consumed.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import clean as C
from ..operators import rollup as RU
from ..sources import files as S

WORST_BUCKETS = 32
_NAME_SEP = "~"


def feeds_changed(new_manifest: DataFrame, stored_manifest: DataFrame) -> DataFrame:
    """Years whose (year, sha256) is not in the stored manifest."""
    return new_manifest.join(stored_manifest.select("year", "sha256"), ["year", "sha256"], "left_anti")


def scan_feed_meta(spark: SparkSession, path: str) -> DataFrame:
    """(feed, lastModifiedDate, size, sha256): one row per metadata file of ``key:value`` lines."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        F.input_file_name().alias("file"),
        F.split(F.regexp_replace("value", "\r$", ""), ":", 2).alias("kv"))

    def field(name: str):
        return F.max(F.when(F.col("kv")[0] == name, F.col("kv")[1])).alias(name)

    return (lines.where(F.size("kv") == 2).groupBy("file").agg(field("lastModifiedDate"), field("size"), field("sha256"))
            .select(F.regexp_extract("file", r"([^/]*)$", 1).alias("feed"), "lastModifiedDate",
                    F.col("size").cast("long").alias("size"), F.lower("sha256").alias("sha256")))


def catalogue_stale(manifest: DataFrame, now_col: str = "now", ts_col: str = "fetched",
                    max_age_days: int = K.CPE_MAX_AGE_DAYS) -> DataFrame:
    """Rows whose fetch time is older than ``max_age_days`` (or unknown)."""
    age = F.datediff(F.col(now_col), F.col(ts_col))
    return manifest.where(F.col(ts_col).isNull() | (age > max_age_days))


# --- versioned parts ------------------------------------------------------------------

class _Folder:
    """The few file operations the state needs, through Spark's file system layer."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def fs(self, p: str):
        return self.path(p).getFileSystem(self.conf)

    def names(self, p: str) -> list[str]:
        fs = self.fs(p)
        return [x.getPath().getName() for x in fs.listStatus(self.path(p))] if fs.exists(self.path(p)) else []

    def exists(self, p: str) -> bool:
        return self.fs(p).exists(self.path(p))

    def delete(self, p: str) -> None:
        self.fs(p).delete(self.path(p), True)

    def make(self, p: str) -> None:
        self.fs(p).mkdirs(self.path(p))

    def copy(self, source: str, target: str) -> None:
        """Complete or absent under the target name."""
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs(source), self.path(source), self.fs(target),
                                                    self.path(target), False, True, self.conf)


def _newest(folder: _Folder, table_dir: str, before: int | None) -> dict[str, list[int]]:
    """Part -> the committed versions (older than ``before``) that wrote it, newest first."""
    held = [int(n[1:]) for n in folder.names(table_dir) if n.startswith("v") and n[1:].isdigit()]
    found: dict[str, list[int]] = {}
    for v in sorted(held, reverse=True):
        if (before is None or v < before) and folder.exists(os.path.join(table_dir, f"v{v}", "_SUCCESS")):
            for part in folder.names(os.path.join(table_dir, "_touched", f"v{v}")):
                found.setdefault(part, []).append(v)
    return found


def _part_path(table_dir: str, part: str, version: int) -> str:
    return os.path.join(table_dir, f"v{version}", f"part={part}")


def read_parts(spark: SparkSession, table_dir: str, before: int | None = None,
               only: list[str] | None = None) -> DataFrame | None:
    """The newest committed version of each part (older than version ``before``)."""
    folder = _Folder(spark)
    newest = {p: v[0] for p, v in _newest(folder, table_dir, before).items() if only is None or p in only}
    # a part whose rows have all gone has a version without a folder
    paths = [x for p, v in sorted(newest.items()) if folder.exists(x := _part_path(table_dir, p, v))]
    return spark.read.parquet(*paths) if paths else None


def _write_parts(df: DataFrame, part, table_dir: str, parts: list[str], version: int) -> None:
    """Writes a new version of the given parts in one job and keeps the version before it of each."""
    folder = _Folder(df.sparkSession)
    for p in parts:
        folder.make(os.path.join(table_dir, "_touched", f"v{version}", p))
    df.withColumn("part", part).write.mode("overwrite").partitionBy("part").parquet(os.path.join(table_dir, f"v{version}"))
    for p, held in _newest(folder, table_dir, version + 1).items():
        for old in held[2:] if p in parts else []:
            folder.delete(_part_path(table_dir, p, old))


# --- refresh --------------------------------------------------------------------------

def feed_digests(spark: SparkSession, landing_dir: str, prefix: str = K.CVE_FILE_PREFIX) -> DataFrame:
    """(feed, digest): each feed file or folder of the landing folder with a digest of its lines.

    The digest sums line hashes, so it combines map-side and does not depend on
    how a feed is split over files.
    """
    name = F.regexp_extract(F.input_file_name(), rf"/({prefix}[^/]*)(?:/[^/]*)?$", 1)
    lines = spark.read.text(os.path.join(landing_dir, f"{prefix}*")).select(name.alias("feed"), "value")

    def total(column):
        return F.sum(column.cast("decimal(38,0)")).cast("string")

    text = F.concat_ws(":", F.count(F.lit(1)).cast("string"), total(F.xxhash64("value")),
                       total(F.xxhash64(F.lit(1), F.col("value"))))
    return lines.groupBy("feed").agg(F.md5(text).alias("digest"))


def merge_batch(spark: SparkSession, batch_xml: DataFrame, state_dir: str, epoch: int) -> None:
    """Replace the state of the feeds in one micro-batch and the worst case of the products they touch."""
    cve_dir, worst_dir = os.path.join(state_dir, "cve"), os.path.join(state_dir, "worst_case")
    named = batch_xml.select("*", F.input_file_name().alias("__file"))
    versioned = rf"/([^/{_NAME_SEP}]*){_NAME_SEP}([0-9]+){_NAME_SEP}[^/]*(?:/[^/]*)?$"
    tag, order = F.regexp_extract("__file", versioned, 1), F.regexp_extract("__file", versioned, 2)
    entries = named.select(tag.alias("feed"), order.cast("long").alias("turn"), *C.entry_columns()).persist()
    # two versions of a feed in one batch (a stream that had stopped): the later one counts
    turns = {r["feed"]: r["turn"] for r in entries.groupBy("feed").agg(F.max("turn").alias("turn")).collect()}
    old = read_parts(spark, cve_dir, before=epoch, only=list(turns))
    if not turns:
        entries.unpersist()
        return
    latest = F.create_map(*[F.lit(x) for kv in sorted(turns.items()) for x in kv])
    mine = C.dedup_latest(entries.where(F.col("turn") == latest[F.col("feed")]).drop("turn"), ["feed", "cve_id"], "modified")
    _write_parts(mine, F.col("feed"), cve_dir, list(turns), epoch)
    entries.unpersist()
    now = read_parts(spark, cve_dir, before=epoch + 1)
    if now is None:
        now = mine.limit(0)
    # products named by any old or new version of the entries that these feeds hold or held
    changed = now.where(F.col("feed").isin(list(turns))).select("cve_id")
    if old is not None:
        changed = changed.union(old.select("cve_id"))
    changed = changed.distinct()
    versions = now.select("cve_id", "products") if old is None else \
        now.select("cve_id", "products").union(old.select("cve_id", "products"))
    touched = versions.join(changed, "cve_id", "left_semi").select(F.explode("products").alias("product")).distinct()
    current = C.cve_products(now.drop("feed"))
    fresh = RU.worst_case(current.join(touched, "product", "left_semi"))
    bucket = F.pmod(F.xxhash64("cpe_prod"), F.lit(WORST_BUCKETS)).cast("string")
    hit = [r[0] for r in touched.select(F.col("product").alias("cpe_prod")).select(bucket.alias("b")).distinct().collect()]
    kept = read_parts(spark, worst_dir, before=epoch, only=hit)
    worst = fresh if kept is None else kept.join(
        touched.withColumnRenamed("product", "cpe_prod"), "cpe_prod", "left_anti").unionByName(fresh)
    _write_parts(worst, bucket, worst_dir, hit, epoch)


def refresh(spark: SparkSession, landing_dir: str, state_dir: str, checkpoint_dir: str,
            prefix: str = K.CVE_FILE_PREFIX) -> DataFrame:
    """Take in all new and changed feeds of ``landing_dir`` and return the updated worst-case table."""
    folder, inbox = _Folder(spark), os.path.join(state_dir, "inbox")
    seen = folder.names(inbox)
    latest: dict[str, tuple[int, str]] = {}
    for name in seen:
        if name.count(_NAME_SEP) == 2:
            feed, turn, digest = name.removesuffix(".xml").split(_NAME_SEP)
            latest[feed] = max(latest.get(feed, (-1, "")), (int(turn), digest))
    for r in feed_digests(spark, landing_dir, prefix).collect():  # one row per feed file
        turn, digest = latest.get(r["feed"], (-1, ""))
        if digest != r["digest"]:
            folder.copy(os.path.join(landing_dir, r["feed"]),
                        os.path.join(inbox, _NAME_SEP.join((r["feed"], str(turn + 1), r["digest"])) + ".xml"))
    if folder.names(inbox):
        stream = (spark.readStream.format("xml").option("rowTag", "entry").schema(S.CVE_XML_SCHEMA)
                  .option("maxFileAge", "36500d").load(os.path.join(inbox, f"{prefix}*")))
        q = (stream.writeStream.foreachBatch(lambda df, epoch: merge_batch(spark, df, state_dir, epoch))
             .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
        q.awaitTermination()
    worst = read_parts(spark, os.path.join(state_dir, "worst_case"))
    if worst is None:
        return spark.createDataFrame([], RU.worst_case(spark.createDataFrame(
            [], "cve_id string, product string, score string, complexity string, vector string")).schema)
    return worst
