"""Tables out: exports, snapshots, guarded writes."""

from __future__ import annotations

from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from noticegrid import vocab
from noticegrid.operators import directory, feed
from noticegrid.operators.common import subtract_keys, upsert
from noticegrid.session import stage

# Parts of a snapshot that is resumed and rechecked.
SNAPSHOT_PARTS = 64


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def export_bids_csv(rows: DataFrame, path: str) -> None:
    write_csv(feed.bids_export(rows), path)


def export_saved_csv(rows: DataFrame, path: str, choice: str = "All") -> None:
    write_csv(feed.saved_export(rows, choice), path)


def export_leads_csv(rows: DataFrame, path: str) -> None:
    write_csv(feed.leads_export(rows), path)


def export_tables(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write each table as JSON; rows (table, rows, error) say what became of each one. Rows are counted as they are written."""
    spark = next(iter(tables.values())).sparkSession
    report = []
    for name, df in tables.items():
        try:
            counted = Observation(f"rows of {name}")
            df.observe(counted, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").json(f"{path}/{name}")
            report.append((name, counted.get["n"], ""))
        except (PySparkException, Py4JJavaError) as error:  # one table that Spark can not read must not cost the others
            report.append((name, 0, f"{type(error).__name__}: {str(error).splitlines()[0][:200]}"))
    return spark.createDataFrame(report, "table string, rows long, error string")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def refresh_registry(raw: DataFrame, path: str, min_rows: int = vocab.REGISTRY_MIN_ROWS) -> int:
    """Write the registry unless it looks cut short; returns the number of rows."""
    rows = stage(directory.refreshed_registry(raw), "registry")
    n = rows.count()
    if n < min_rows:
        raise ValueError(f"refusing to write: only {n} rows, expected at least {min_rows}")
    write_csv(rows.orderBy("state", F.lower("city"), "domain"), path)
    return n


def resume_work(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is left of the input after an earlier run."""
    return subtract_keys(work, done, keys)


def _dealt(rows: DataFrame, keys: list[str], parts: int) -> DataFrame:
    return rows.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))


def append_rows(rows: DataFrame, path: str, keys: list[str], parts: int = SNAPSHOT_PARTS) -> None:
    """Rows of a resumed run, as further files of a snapshot in parts by the hash of its keys."""
    _dealt(rows, keys, parts).repartition("part").write.mode("append").partitionBy("part").parquet(path)


def rewrite_rows(changed: DataFrame, path: str, keys: list[str], parts: int = SNAPSHOT_PARTS) -> None:
    """Changed rows of a recheck in place of the old ones of the same key; only parts that hold such keys are read and rewritten.

    The snapshot stays where it is: its readers see the old files of a part or the new ones.
    """
    spark = changed.sparkSession
    new = stage(_dealt(changed, keys, parts), "changed")
    touched = [r["part"] for r in new.select("part").distinct().collect()]  # at most as many as there are parts
    if not touched:
        return
    shape = StructType([f for f in new.schema if f.name != "part"]).add("part", IntegerType())
    old = spark.read.schema(shape).parquet(path).where(F.col("part").isin(touched))
    whole = stage(upsert(old, new, keys), "rewritten")
    whole.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("part")


def write_same_day(results: DataFrame, path: str, as_of: Column) -> None:
    """Today's partition of a result cache; other days are left alone."""
    (results.withColumn("run_date", as_of.cast("date")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(path))
