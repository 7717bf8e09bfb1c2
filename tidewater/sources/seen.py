"""The set of keys that a monitor has seen, as a store that grows by what each batch adds.

Keys lie in folders by part (a hash of the key), in generations: a batch appends one generation of its own keys, and
looks its keys up in the parts that they fall in. From time to time small generations are merged into one, and all into
one once the small ones together weigh half as much as the large one: a key is rewritten a number of times that grows with
the logarithm of the store. A generation counts from the moment a manifest names it; manifests are small tables, one a
commit, of which the newest counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidewater.scratch import delete

MANIFEST = "version long, folder string, n_rows long, settings string"


class SeenStore:
    """Keys with the batch and time that they were first seen in; ``parts`` stays as it was when the store was made."""

    def __init__(self, spark: SparkSession, path: str, parts: int = 64, merge_every: int = 16):
        self.spark, self.path, self.parts, self.merge_every = spark, path.rstrip("/"), parts, merge_every

    def _manifest(self) -> tuple[int, list[Row]]:
        """(version, rows of the newest manifest): at most a row for each of the live generations."""
        from pyspark.errors import AnalysisException

        try:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return 0, []
            raise
        last = rows.agg(F.max("version").alias("v")).first()["v"]
        return (0, []) if last is None else (last, [r for r in rows.where(F.col("version") == last).collect()])

    def _commit(self, version: int, live: list[tuple[str, int]], settings: str | None) -> None:
        rows = [(version, folder, n, settings) for folder, n in live] or [(version, None, 0, settings)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={version:012d}")
        delete(self.spark, f"{self.path}/manifest/v={version - 2:012d}")  # the last but one stays for readers that have begun

    def known(self, settings: str | None = None) -> bool:
        """Whether a baseline with these settings exists (any, if None)."""
        rows = self._manifest()[1]
        return bool(rows) and settings in (None, rows[0]["settings"])

    def _part(self, key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(self.parts)).cast("int")

    def _rows(self, folders: list[str], key: str, kind: str) -> DataFrame:
        schema = f"`{key}` {kind}, batch long, seen timestamp, gen string, part int"
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*[f"{self.path}/{f}" for f in folders]).drop("gen")

    def load(self, key: str, kind: str = "string", settings: str | None = None) -> DataFrame:
        """(key, batch, seen) of all keys in force; ``kind``: the SQL type of the key."""
        live = [r["folder"] for r in self._manifest()[1] if r["n_rows"] and settings in (None, r["settings"])]
        if not live:
            return self.spark.createDataFrame([], f"`{key}` {kind}, batch long, seen timestamp")
        return self._rows(live, key, kind).drop("part")

    def unseen(self, rows: DataFrame, key: str, batch: int | None = None, settings: str | None = None) -> DataFrame:
        """The rows whose key no batch before ``batch`` has seen; only the parts that these rows fall in are read.

        Rows with a null key are never seen. Keys of the batch itself do not count, so that it can be run again.
        """
        live = [r["folder"] for r in self._manifest()[1] if r["n_rows"] and settings in (None, r["settings"])]
        if not live:
            return rows
        kind = rows.schema[key].dataType.simpleString()
        asked = [r[0] for r in rows.where(F.col(key).isNotNull()).select(self._part(key).alias("p")).distinct().collect()]  # at most ``parts`` numbers
        seen = self._rows(live, key, kind).where(F.col("part").isin(asked))
        if batch is not None:
            seen = seen.where(F.col("batch") < batch)
        return rows.join(seen.select(key), key, "left_anti")

    def add(self, rows: DataFrame, key: str, batch: int, seen: Column | None = None, settings: str | None = None) -> None:
        """The keys of a batch as a generation; a batch that is run again replaces its own. Other settings begin anew."""
        version, old = self._manifest()
        live = [(r["folder"], r["n_rows"]) for r in old if r["folder"] and r["n_rows"] and settings in (None, r["settings"])]
        gone = [r["folder"] for r in old if r["folder"] and not (settings in (None, r["settings"]))]
        settings = settings if settings is not None or not old else old[0]["settings"]
        folder = f"gen=batch-{batch:012d}"
        new = rows.where(F.col(key).isNotNull()).select(key, F.lit(batch).cast("long").alias("batch"), (F.current_timestamp() if seen is None else seen).alias("seen"), self._part(key).alias("part"))
        new = new.groupBy(key, "batch", "part").agg(F.min("seen").alias("seen"))
        new.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/{folder}")
        n = self._rows([folder], key, rows.schema[key].dataType.simpleString()).count()
        live = [x for x in live if x[0] != folder] + [(folder, n)]
        self._commit(version + 1, live, settings)
        for f in gone:
            delete(self.spark, f"{self.path}/{f}")
        if len(live) > self.merge_every:
            self.merge(key, rows.schema[key].dataType.simpleString())

    def merge(self, key: str, kind: str, since: Column | None = None) -> None:
        """Small generations as one; all, without keys seen before ``since``, once the small ones weigh half as much as the largest.

        With ``since`` all are merged. The generations that were merged go after the commit; a merge that fails before
        it leaves a folder that nothing names and that the next merge overwrites.
        """
        version, rows = self._manifest()
        live = sorted(((r["folder"], r["n_rows"]) for r in rows if r["folder"] and r["n_rows"]), key=lambda x: -x[1])
        if not live:
            return
        whole = since is not None or 2 * sum(n for _, n in live[1:]) >= live[0][1]
        stay, merged = ([], live) if whole else (live[:1], live[1:])
        if since is None and len(merged) < 2:
            return
        folder = f"gen=merged-{version + 1:012d}"
        out = self._rows([f for f, _ in merged], key, kind)
        out = (out if since is None else out.where(F.col("seen") >= since)).groupBy(key, "part").agg(F.min("batch").alias("batch"), F.min("seen").alias("seen"))
        out.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/{folder}")
        n = self._rows([folder], key, kind).count()
        self._commit(version + 1, [*stay, (folder, n)], rows[0]["settings"])
        for f, _ in merged:
            delete(self.spark, f"{self.path}/{f}")
