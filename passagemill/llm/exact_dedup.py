"""Exact dedup of a new batch against immutable snapshots, screened by binary fuse filters."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.llm import fuse
from passagemill.session import persist_table, scratch_dir

KEYS_PER_FILTER = 500_000


def normalised(text: str) -> Column:
    """Nulls count as empty; each run of ``[\\x20\\x09-\\x0D]`` is one space."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per distinct normalised text, grouped by its digest *and* its bytes, combined before the shuffle."""
    plain = docs.select(F.col(id_col).alias("_id"), normalised(text_col).alias("plain"))
    plain = plain.withColumn("sha256", F.unhex(F.sha2(F.col("plain").cast("binary"), 256)))
    return plain.groupBy("sha256", "plain").agg(F.min("_id").alias("keep_id"), F.count("*").alias("members"))


def write_groups(docs: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """``grouped``, written once, so that the texts are shuffled once whatever reads them."""
    grouped(docs, id_col, text_col).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def _key(digest: str = "sha256") -> Column:
    """64 bits of the digest."""
    return F.conv(F.hex(F.substring(digest, 1, 8)), 16, -10).cast("bigint")


class Snapshot:
    """A set of kept texts that never changes: ``texts`` in buckets of their digest, and one fuse filter per bucket."""

    def __init__(self, spark: SparkSession, path: str):
        self.texts = spark.read.parquet(f"{path}/texts")
        self.filters = spark.read.parquet(f"{path}/filters")
        row = spark.read.parquet(f"{path}/shape").first()
        self.buckets = row["buckets"]

    @staticmethod
    def write(docs: DataFrame, id_col: str, text_col: str, path: str | None = None) -> Snapshot:
        """Groups ``docs`` and writes them as a snapshot; the number of buckets follows the number of rows."""
        spark = docs.sparkSession
        path = path or f"{scratch_dir(spark)}/snapshot-{uuid.uuid4().hex}"
        write_groups(docs, id_col, text_col, f"{path}/texts")
        texts = spark.read.parquet(f"{path}/texts")
        buckets = max(256, -(-texts.count() // KEYS_PER_FILTER))
        keys = texts.select(_key().alias("key")).withColumn("bucket", F.pmod("key", F.lit(buckets)))
        keys.groupBy("bucket").applyInPandas(_build, "bucket bigint, filter binary").write.parquet(f"{path}/filters")
        spark.range(1).select(F.lit(buckets).cast("bigint").alias("buckets")).write.parquet(f"{path}/shape")
        return Snapshot(spark, path)

    def screen(self, digests: DataFrame) -> DataFrame:
        """Those of ``digests`` (``sha256``, distinct) that the filters pass: all that the snapshot holds, and few others."""
        keyed = digests.select("sha256", _key().alias("key")).withColumn("bucket", F.pmod("key", F.lit(self.buckets)))
        return keyed.groupBy("bucket").cogroup(self.filters.groupBy("bucket")).applyInPandas(_probe, "sha256 binary")

    def known(self, batch: DataFrame) -> DataFrame:
        """``sha256``, ``plain`` and the snapshot's ``old_id``, ``old_members`` of those texts of ``batch`` that it holds byte for byte."""
        positive = batch.join(self.screen(batch.select("sha256")), "sha256", "left_semi").select("sha256", "plain")
        old = self.texts.select("sha256", "plain", F.col("keep_id").alias("old_id"), F.col("members").alias("old_members"))
        return positive.join(old, ["sha256", "plain"])


def _build(group: pd.DataFrame) -> pd.DataFrame:
    keys = group["key"].to_numpy().view(np.uint64)
    return pd.DataFrame({"bucket": group["bucket"].iloc[:1].to_numpy(), "filter": [fuse.build(keys)]})


def _probe(digests: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    if digests.empty or filters.empty:
        return pd.DataFrame({"sha256": pd.Series([], dtype=object)})
    passed = fuse.contains(filters["filter"].iloc[0], digests["key"].to_numpy().view(np.uint64))
    return digests.loc[passed, ["sha256"]]


def exact_dedup(batch: DataFrame, snapshot: Snapshot, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct text of ``batch`` and of the snapshot together: ``sha256``, ``keep_id``, ``members``.

    Duplicates inside the batch are grouped first; the filters then drop the digests that the snapshot cannot hold, and the
    rest are joined with the exact texts. Null and empty texts are equal; of equal texts the smallest id stays (nulls count
    only if there is no other). Rows that repeat count as members. An empty table on either side leaves the other side's
    groups; other columns are ignored.
    """
    new = write_groups(batch, id_col, text_col, f"{scratch_dir(batch.sparkSession)}/batch-{uuid.uuid4().hex}")
    known = persist_table(snapshot.known(new).select("sha256", "old_id", "old_members"), "known")
    admitted = new.select("sha256", "keep_id", "members").join(known, "sha256", "left").select(
        "sha256", F.least("keep_id", "old_id").alias("keep_id"), (F.col("members") + F.coalesce("old_members", F.lit(0))).alias("members")
    )
    untouched = snapshot.texts.select("sha256", "keep_id", "members").join(known.select("sha256"), "sha256", "left_anti")
    return admitted.unionByName(untouched)


def deduplicated(snapshot_docs: DataFrame, batch: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of both tables with its group: id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    ``kept`` is true for the rows whose id is ``keep_id``: rows that share that id stay together, and rows without an id stay
    only if no equal text has one.
    """
    groups = exact_dedup(batch, Snapshot.write(snapshot_docs, id_col, text_col), id_col, text_col)
    rows = snapshot_docs.select(id_col, text_col).unionByName(batch.select(id_col, text_col))
    rows = rows.select(F.col(id_col).alias("_id"), F.unhex(F.sha2(normalised(text_col).cast("binary"), 256)).alias("sha256"))
    return rows.join(groups, "sha256").select(
        F.col("_id").alias(id_col), "keep_id", F.col("members").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha256")).alias("text_sha256"),
    )
