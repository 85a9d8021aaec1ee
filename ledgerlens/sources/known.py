"""De-duplication of a new batch against all that is published, without moving what is published.

Keys that were published are kept as a table of fingerprints, bucketed by their hash: buckets of the table are read where
they lie, and only the batch is moved, to its keys' buckets. Keys are compared in full beside their hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KnownKeys:
    """The keys published so far, as a bucketed table of the session's catalog.

    buckets is fixed when the table is made: some 100 MB of keys a bucket at the size to come. path: where the table's
    files are (default: the warehouse).
    """

    def __init__(self, spark: SparkSession, table: str, key: str, *, buckets: int = 64, path: str | None = None) -> None:
        self.spark, self.table, self.key, self.buckets, self.path = spark, table, key, buckets, path

    def _exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def _fingerprints(self, df: DataFrame) -> DataFrame:
        return df.select(F.xxhash64(self.key).alias("_h"), F.col(self.key).alias("_key"))

    def fresh(self, batch: DataFrame, order: list | None = None) -> DataFrame:
        """The batch's rows whose keys are not known yet, one a key: the first in `order`, or else any of them. Null is one key."""
        order = order or [F.lit(0)]
        names = batch.columns
        ranked = batch.groupBy(self.key).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("_row"))  # combined before it moves
        rows = ranked.select("_row.*")
        if not self._exists():
            return rows
        known = self.spark.table(self.table)
        # the second half is no join key: partitioned by the hash alone, the table stays where it is
        same = F.coalesce(rows[self.key] == known["_key"], rows[self.key].isNull() & known["_key"].isNull())
        hit = (F.xxhash64(rows[self.key]) == known["_h"]) & same
        return rows.join(known.hint("merge"), hit, "left_anti")

    def add(self, rows: DataFrame) -> None:
        """Remember the keys of rows that are published now; call it after their publication, with rows that fresh() gave."""
        w = self._fingerprints(rows).repartition(self.buckets, "_h").write.bucketBy(self.buckets, "_h").sortBy("_h").mode("append")
        (w.option("path", self.path) if self.path else w).saveAsTable(self.table)

    def drop(self) -> None:
        """Forget the table; files under a path of the caller's stay."""
        self.spark.sql(f"drop table if exists {self.table}")
