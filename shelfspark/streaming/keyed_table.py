"""A table of merged rows per key that streaming batches add to.

Each batch writes one run: its rows, merged per key, in directories by key bucket. Every
``fan`` runs are merged into one that covers their batches, and ``fan`` of those again, so
that a batch costs its own rows times a logarithm, the folder holds a logarithmic number of
runs, and no run has more rows than there are keys. Readers merge the runs that together
cover all batches.

A run counts once its writer has finished. A batch that comes again replaces its run, or is
skipped where a merged run already covers it; covered runs are removed after the merged one
is complete, so an interruption at any point loses and doubles nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 16
FAN = 4
_RUN = re.compile(r"run-(\d+)-(\d+)$")


class KeyedTable:
    """``merge`` maps rows of ``schema`` to one row per key and must give the same result in any grouping of its input."""

    def __init__(
        self, spark: SparkSession, folder: str, schema: T.StructType, keys: list[str], merge: Callable[[DataFrame], DataFrame],
        buckets: int = BUCKETS, fan: int = FAN,
    ) -> None:
        self.spark, self.folder, self.schema, self.keys, self.merge = spark, folder.rstrip("/"), schema, keys, merge
        self.buckets, self.fan = buckets, fan
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def runs(self) -> list[tuple[int, int]]:
        """Complete runs as (first batch, last batch), none inside another, in order."""
        if not self._files.exists(self._path(self.folder)):
            return []
        found = []
        for entry in self._files.listStatus(self._path(self.folder)):
            named = _RUN.search(entry.getPath().toString())
            if named and self._files.exists(self._path(entry.getPath(), "_SUCCESS")):
                found.append((int(named[1]), int(named[2])))
        return sorted(r for r in found if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in found))

    def has(self, batch: int) -> bool:
        """Whether the batch is in the table."""
        return any(low <= batch <= high for low, high in self.runs())

    def _place(self, run: tuple[int, int]) -> str:
        return f"{self.folder}/run-{run[0]:09d}-{run[1]:09d}"

    def _write(self, rows: DataFrame, run: tuple[int, int]) -> None:
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets))
        rows.select(*self.schema.names, bucket.alias("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(self._place(run))

    def _rows(self, runs: list[tuple[int, int]], bucket: int | None = None) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
        parts = [self.spark.read.schema(schema).parquet(self._place(r)) for r in runs]
        rows = parts[0] if parts else self.spark.createDataFrame([], schema)
        for part in parts[1:]:
            rows = rows.unionAll(part)
        return (rows if bucket is None else rows.where(F.col("bucket") == bucket)).drop("bucket")

    def add(self, rows: DataFrame, batch: int) -> None:
        """The rows of one batch; batches are numbered from 0."""
        if any(low <= batch <= high and low < high for low, high in self.runs()):
            return  # came before, and is merged already
        self._write(self.merge(rows.select(*self.schema.names)), (batch, batch))
        self.compact(batch)

    def compact(self, batch: int) -> None:
        """Merge what the batch completes: the last ``fan`` runs, then the last ``fan`` of those, and so on."""
        width = self.fan
        while (batch + 1) % width == 0:
            span = (batch + 1 - width, batch)
            inside = [r for r in self.runs() if span[0] <= r[0] and r[1] <= span[1]]
            if inside != [span]:
                self._write(self.merge(self._rows(inside)), span)
            for run in self._covered():
                self._files.delete(self._path(self._place(run)), True)
            width *= self.fan

    def _covered(self) -> list[tuple[int, int]]:
        """Runs, complete or not, whose batches a complete wider run holds."""
        complete, found = self.runs(), []
        for entry in self._files.listStatus(self._path(self.folder)):
            named = _RUN.search(entry.getPath().toString())
            if named:
                run = (int(named[1]), int(named[2]))
                if any(o != run and o[0] <= run[0] and run[1] <= o[1] for o in complete):
                    found.append(run)
        return found

    def read(self) -> DataFrame:
        """One row per key, over all batches."""
        return self.merge(self._rows(self.runs()))

    def lookup(self, *key) -> DataFrame:
        """The row of one key; only its bucket is read."""
        named = {k: F.lit(v).cast(self.schema[k].dataType) for k, v in zip(self.keys, key, strict=True)}
        bucket = self.spark.range(1).select(F.pmod(F.xxhash64(*named.values()), F.lit(self.buckets)).alias("b")).first().b
        rows = self._rows(self.runs(), bucket)
        for name, value in named.items():
            rows = rows.where(F.col(name).eqNullSafe(value))
        return self.merge(rows)
