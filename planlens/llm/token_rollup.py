"""Token counts as rollups that batches of changes keep up to date.

Totals by source, language and tokenizer version are sums, so a change only
adds signed rows: an insert adds a document's count, a delete takes away what
the ledger holds for it, a revision does both.  A batch writes its signed rows,
then their sums per group, then its commit; what is read are committed batches
only.  A batch that died halfway is written anew from the start, and one whose
commit is there is not applied again, so delivering it twice changes nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

GROUP = ("source", "lang", "version")


class TokenRollup:
    """Ledger, batch sums and commits in one folder that all machines share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _exists(self, path: str) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)

    def _path(self, batch: str, what: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_-]+", batch):
            raise ValueError(f"batch id {batch!r} is no plain name")
        return f"{self.folder}/{what}/batch={batch}"

    def committed(self, batch: str) -> bool:
        return self._exists(f"{self._path(batch, 'commits')}/_SUCCESS")

    def _read(self, what: str) -> DataFrame | None:
        """Rows of committed batches; the list of batches joins them, so an unfinished one is left out."""
        if not (self._exists(f"{self.folder}/commits") and self._exists(f"{self.folder}/{what}")):
            return None
        done = self.spark.read.schema("at long, batch string").parquet(f"{self.folder}/commits").select("batch").distinct()
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.folder}/{what}").join(done, "batch", "left_semi")

    def current(self) -> DataFrame | None:
        """What the ledger holds: doc_id, source, lang, version, n_docs, n_tokens."""
        ledger = self._read("ledger")
        if ledger is None:
            return None
        held = ledger.groupBy("doc_id", *GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return held.where("n_docs <> 0 or n_tokens <> 0")

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Apply ``changes`` (op, doc_id, source, lang, version, n_tokens) once; False if the batch was there already.

        op is insert, delete or revise; others are ignored.  A delete or
        revision takes away all that is held for the doc_id (missing ids are
        one id), however often the batch names it; unknown ids take nothing
        away.  Missing sources, languages and versions are groups; a missing
        count is 0.  Rows with the same id are added up.
        """
        if self.committed(batch):
            return False
        added = changes.where(F.col("op").isin("insert", "revise")).select(
            "doc_id", *GROUP, F.lit(1).cast("long").alias("n_docs"), F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens")
        )
        held = self.current()
        if held is not None:
            touched = changes.where(F.col("op").isin("delete", "revise")).select(F.col("doc_id").alias("_id")).distinct()
            gone = held.join(touched, held.doc_id.eqNullSafe(touched._id), "left_semi")
            added = added.unionByName(gone.withColumns({"n_docs": -F.col("n_docs"), "n_tokens": -F.col("n_tokens")}))
        ledger = self._path(batch, "ledger")
        added.write.mode("overwrite").parquet(ledger)
        sums = self.spark.read.schema(added.schema).parquet(ledger).groupBy(*GROUP)
        sums.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).write.mode("overwrite").parquet(
            self._path(batch, "sums")
        )
        self.spark.range(1).select(F.col("id").alias("at")).write.mode("overwrite").parquet(self._path(batch, "commits"))
        return True

    def totals(self) -> DataFrame | None:
        """source, lang, version, n_docs, n_tokens from the batches' sums; groups without documents are gone."""
        sums = self._read("sums")
        if sums is None:
            return None
        total = sums.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return total.where("n_docs <> 0 or n_tokens <> 0")
