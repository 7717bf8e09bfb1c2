"""Where results and states are kept: generations of a snapshot, result folders and price histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.scratch import delete


class SnapshotStore:
    """Snapshots by generation under one folder; a row in ``commits`` makes a generation count.

    A generation is written whole before its commit is appended, so a lost driver or a failed write leaves
    the last committed one in force. A committed generation whose files are missing is an error.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _commits(self) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema("generation long, settings string, n_rows long").parquet(f"{self.path}/commits")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def current(self) -> tuple[int, str | None]:
        """(generation, settings) in force; (0, None) before the first."""
        commits = self._commits()
        row = commits.agg(F.max(F.struct("generation", "settings")).alias("x")).first()["x"] if commits is not None else None
        return (row["generation"], row["settings"]) if row else (0, None)

    def load(self, settings: str | None = None) -> DataFrame | None:
        """The snapshot in force; None before the first and where the settings differ (a new baseline)."""
        generation, known = self.current()
        if generation == 0 or (settings is not None and known != settings):
            return None
        return self.spark.read.parquet(f"{self.path}/generation={generation}")

    def save(self, rows: DataFrame, settings: str | None = None) -> int:
        """The rows as the next generation. Rows may be derived from ``load()``: no folder is overwritten in use."""
        generation = self.current()[0] + 1
        target = f"{self.path}/generation={generation}"
        rows.write.mode("overwrite").parquet(target)
        self.commit(generation, settings, self.spark.read.parquet(target).count())
        return generation

    def commit(self, generation: int, settings: str | None, n_rows: int) -> None:
        row = self.spark.createDataFrame([(generation, settings, n_rows)], "generation long, settings string, n_rows long")
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")


class SnapshotTable:
    """Snapshots laid out for the next comparison: a table a generation, in sorted buckets of the key.

    Rows are those of ``diff.prepared``. Joined with the next crawl on ``_key``, the stored side is read bucket by bucket
    without an exchange or a sort, and only the new side is dealt to its buckets. A table counts once the commits of
    the store name it; older generations but one go then. ``buckets`` should be about the cores of the cluster.
    """

    def __init__(self, spark: SparkSession, path: str, name: str, buckets: int = 64):
        self.spark, self.path, self.name, self.buckets = spark, path.rstrip("/"), name, buckets
        self.commits = SnapshotStore(spark, f"{self.path}/commits-of-{name}")

    def _table(self, generation: int) -> str:
        return f"{self.name}_{generation}"

    def load(self, settings: str | None = None) -> DataFrame | None:
        """The snapshot in force; None before the first and where the settings differ."""
        generation, known = self.commits.current()
        if generation == 0 or (settings is not None and known != settings):
            return None
        return self.spark.table(self._table(generation))

    def save(self, rows: DataFrame, settings: str | None = None) -> int:
        """The rows (_key, _hash, ...) as the next generation; they may be derived from ``load()``."""
        generation = self.commits.current()[0] + 1
        table = self._table(generation)
        self.spark.sql(f"drop table if exists {table}")
        delete(self.spark, f"{self.path}/{table}")  # what a save that failed has left
        dealt = rows.repartition(self.buckets, "_key")  # one file a bucket
        dealt.write.bucketBy(self.buckets, "_key").sortBy("_key").option("path", f"{self.path}/{table}").format("parquet").saveAsTable(table)
        self.commits.commit(generation, settings, self.spark.table(table).count())
        if generation > 2:
            self.spark.sql(f"drop table if exists {self._table(generation - 2)}")
            delete(self.spark, f"{self.path}/{self._table(generation - 2)}")
        return generation


def write_results(results: DataFrame, errors: DataFrame | None, path: str, columns: list[str], form: str = "parquet") -> None:
    """Results and error rows in one folder with fixed columns; form is parquet, json or csv."""
    both = results if errors is None else results.select("*").unionByName(errors, allowMissingColumns=True)
    missing = [F.lit(None).cast("string").alias(c) for c in columns if c not in both.columns]
    out = both.select("*", *missing).select(columns)
    getattr(out.write.mode("overwrite"), form)(path, **({"header": True} if form == "csv" else {}))


def append_history(checks: DataFrame, path: str, day: str) -> None:
    """One row an entity a check, missing prices kept as nulls, partitioned by the day of the check."""
    checks.write.mode("append").partitionBy(day).parquet(path)
