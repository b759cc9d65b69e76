"""Drafts over observed metadata: overlays, differences, splits, versioned upserts, bounded caches, commit checks.

Records are long: one row for each path and field with a list of values, so absent, set and cleared are told apart and every
operation is a join or a window on (path, field). Parquet has no MERGE, so a table is a sequence of versions: a
commit writes the next one and then moves the pointer (``Versions``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: The key that preferences are stored under, and the keys that held some of them before.
PREFERENCES, RETIRED = "preferences", ["google_books_api_key", "last_folder"]


def with_setting(settings: DataFrame, key: str, value: str) -> DataFrame:
    """The settings (key, value) with one set; storing the preferences drops the retired keys, in the same version of the table."""
    gone = [key, *RETIRED] if key == PREFERENCES else [key]
    new = settings.sparkSession.range(1).select(F.lit(key).alias("key"), F.lit(value).alias("value"))
    return settings.where(~F.col("key").isin(gone)).select("key", "value").unionByName(new)


def setting(settings: DataFrame, key: str) -> DataFrame:
    """value: that of a setting, empty if it was never stored."""
    return settings.where(F.col("key") == key).agg(F.coalesce(F.max("value"), F.lit("")).alias("value"))


def meaningful(values: Column) -> Column:
    """Null, the empty list and one blank scalar are one value: the empty list; scalars count trimmed."""
    plain = F.coalesce(values, F.array().cast("array<string>"))
    one = F.when((F.size(plain) == 1) & (F.trim(plain[0]) == ""), F.array().cast("array<string>"))
    return F.coalesce(one, F.when(F.size(plain) == 1, F.array(F.trim(plain[0]))), plain)


def overlay(current: DataFrame, draft: DataFrame, keys: list[str]) -> DataFrame:
    """The current rows with the draft's values over them, and the draft's rows that current lacks."""
    d = draft.select(*keys, F.col("values").alias("_new"), F.lit(True).alias("_set"))
    return current.join(d, keys, "full").select(*keys, F.when(F.col("_set"), F.col("_new")).otherwise(F.col("values")).alias("values"), F.coalesce("_set", F.lit(False)).alias("staged"))


def changes(current: DataFrame, working: DataFrame, keys: list[str]) -> DataFrame:
    """The working rows whose values differ from the current ones."""
    c = current.select(*keys, F.col("values").alias("_old"))
    return working.join(c, keys, "left").where(~meaningful(F.col("values")).eqNullSafe(meaningful(F.col("_old")))).select(*keys, "values")


def split(draft: DataFrame, selected: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The selected rows of a draft, and the rest."""
    chosen = selected.select(*keys).distinct()
    return draft.join(chosen, keys, "left_semi"), draft.join(chosen, keys, "left_anti")


def latest(log: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of every key by the order given (rising): the upsert of a log of changes."""
    newest = [c.desc() for c in order]
    return log.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))).where("_n = 1").drop("_n")


def drafts(state: DataFrame) -> DataFrame:
    """The rows with a draft, by path without regard to the case of ASCII letters."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return state.where("staged is not null").orderBy(F.translate("path", upper, lower), "path")


def fresh(cache: DataFrame, key: Column | None, now: int, max_age: int) -> DataFrame:
    """Entries not older than ``max_age`` seconds; none if that is 0 or less."""
    if max_age <= 0:
        return cache.limit(0)
    kept = cache.where(F.col("updated_at") >= now - max_age)
    return kept if key is None else kept.where(F.col("cache_key") == key)


def prune(cache: DataFrame, keep: int, key: str = "cache_key", updated: str = "updated_at") -> DataFrame:
    """The ``keep`` newest entries, ties by key; a bounded top-k, no global sort."""
    return cache.orderBy(F.col(updated).desc(), F.col(key)).limit(keep)


def preflight(selection: DataFrame, state: DataFrame) -> DataFrame:
    """Why each selected book may not be committed: repeated, missing, stale or an empty string for none.

    selection: path, fingerprint, version; state: the same with the values of now.
    """
    often = selection.groupBy("path").agg(F.count(F.lit(1)).alias("_times"))
    now = state.select("path", F.col("fingerprint").alias("_fingerprint"), F.col("version").alias("_version"))
    found = selection.join(often, "path").join(now, "path", "left")
    why = (
        F.when(F.col("_times") > 1, "repeated")
        .when(F.col("_version").isNull(), "missing")
        .when((F.col("_fingerprint") != F.col("fingerprint")) | (F.col("_version") != F.col("version")), "stale")
        .otherwise("")
    )
    return found.select("path", "fingerprint", "version", why.alias("reason"))


def allowed(checked: DataFrame) -> Column:
    """Whether a commit goes ahead, as a scalar subquery: something is selected and nothing is wrong with any of it."""
    return checked.agg(((F.count(F.lit(1)) > 0) & (F.count_if(F.col("reason") != "") == 0)).alias("ok")).scalar()


def gated(checked: DataFrame) -> DataFrame:
    """The rows of a checked selection if nothing is wrong with any; else reading any of them fails, with how many are refused.

    The whole batch is decided in the plan, before its first row comes out; nothing runs until the rows are read. An empty selection has no rows.
    """
    refused = checked.agg(F.count_if(F.col("reason") != "").alias("n")).scalar()
    why = F.concat(F.lit("the commit is refused: "), refused.cast("string"), F.lit(" of its books are repeated, missing or stale"))
    return checked.where(F.when(refused == 0, F.lit(True)).otherwise(F.raise_error(why).cast("boolean")))


def discard(state: DataFrame, selected: DataFrame) -> DataFrame:
    """The state with the drafts of the selected paths cleared."""
    chosen = selected.select("path", F.lit(True).alias("_gone")).distinct()
    kinds = dict(state.dtypes)
    return state.join(chosen, "path", "left").withColumn("staged", F.when(F.col("_gone"), F.lit(None).cast(kinds["staged"])).otherwise(F.col("staged"))).drop("_gone").select(*state.columns)


def staged_count(state: DataFrame) -> DataFrame:
    """staged: how many books have a draft."""
    return state.agg(F.count("staged").alias("staged"))


def row_of(state: DataFrame, path: Column | str) -> DataFrame:
    """The state row of one path; reading it fails where there is none."""
    asked = state.sparkSession.range(1).select((F.lit(path) if isinstance(path, str) else path).alias("path"))
    found = asked.join(state.withColumn("_found", F.lit(True)), "path", "left")
    return found.where(F.when(F.col("_found").isNull(), F.raise_error(F.concat(F.lit("no such book: "), F.col("path"))).cast("boolean")).otherwise(F.lit(True))).drop("_found")


class Versions:
    """A table as numbered versions in one folder: readers follow a pointer that a commit moves last.

    A pointer also holds the number of the schema that the version was written with; a newer one than ``schema`` is refused.
    """

    def __init__(self, spark: SparkSession, path: str, schema: int = 1):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def current(self) -> int:
        """Number of the current version, 0 if there is none."""
        folder = self._path(f"{self.path}/pointers")
        if not self._fs.exists(folder):
            return 0
        return max((int(s.getPath().getName()[1:]) for s in self._fs.listStatus(folder) if s.getPath().getName().startswith("v")), default=0)

    def read(self) -> DataFrame | None:
        n = self.current()
        if not n:
            return None
        source = self._fs.open(self._path(f"{self.path}/pointers/v{n}"))
        try:
            name, _, schema = self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8").partition("\n")
        finally:
            source.close()
        if int(schema or 1) > self.schema:
            raise RuntimeError(f"written with schema {schema}, newer than {self.schema}")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def commit(self, table: DataFrame, seen: int) -> int:
        """Write the version after ``seen``; fails if another commit was first."""
        name = f"data-{uuid.uuid4().hex}"
        table.write.parquet(f"{self.path}/{name}")
        if self.current() != seen:
            raise RuntimeError("another version was committed meanwhile")
        out = self._fs.create(self._path(f"{self.path}/pointers/v{seen + 1}"), False)  # fails if it exists
        try:
            out.write(bytearray(f"{name}\n{self.schema}".encode()))
        finally:
            out.close()
        return seen + 1
