"""Sinks: JSON lines, validated lines, packed arrays, atomic replacement, file housekeeping, metric tables."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, *, append: bool = False, by: list[str] | None = None) -> None:
    """K1: JSON lines, partitioned by columns if wanted, so that later reads prune."""
    w = df.write.mode("append" if append else "overwrite")
    (w.partitionBy(*by) if by else w).json(path)


def validated(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """K2: each line parsed and written anew; a line that isn't JSON of the schema raises when the result is computed."""
    return lines.select(F.to_json(F.from_json(column, schema, {"mode": "FAILFAST"})).alias("value"))


def write_packed(groups: DataFrame, path: str, pack: str = "pack_id") -> None:
    """K3: part files that are each one JSON array of packs, a pack being an array of its rows."""
    rows = groups.groupBy(pack).agg(F.collect_list(F.struct(*(c for c in groups.columns if c != pack))).alias("rows"))

    def run(batches):
        first = True
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                out.append(("[" if first else ",") + text)
                first = False
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})
        if not first:
            yield pa.RecordBatch.from_pydict({"value": ["]"]})

    rows.select(F.to_json("rows").alias("value")).mapInArrow(run, "value string").write.mode("overwrite").text(path)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def replace_parquet(df: DataFrame, path: str, backup: str | None = None, backup_columns: list[str] | None = None) -> None:
    """K4: writes beside the target, renames the old table aside, the new one in, and deletes the old one last, so that a failure at any step
    leaves a whole table; with the old rows' columns kept as JSON first if wanted."""
    spark = df.sparkSession
    fs, target = _fs(spark, path)
    if backup and fs.exists(target):
        old = spark.read.parquet(path)
        old.select(*(backup_columns or old.columns)).write.mode("overwrite").json(backup)
    passing = f"{path}.{uuid.uuid4().hex}"
    df.write.option("compression", "snappy").parquet(passing)
    (_, source), (_, aside) = _fs(spark, passing), _fs(spark, f"{passing}.old")
    if (there := fs.exists(target)) and not fs.rename(target, aside):
        raise OSError(f"could not move {path} aside")
    if not fs.rename(source, target):
        if there:
            fs.rename(aside, target)
        raise OSError(f"could not rename {passing} to {path}")
    if there:
        fs.delete(aside, True)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob, on any file system."""
    fs, p = _fs(spark, pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(p) or ())


def move_matching(spark: SparkSession, pattern: str, to: str, *, copy: bool = False) -> list[str]:
    """K5: archives (or recovers) the files that match: moves or copies them into a folder."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    fs, folder = _fs(spark, to)
    fs.mkdirs(folder)
    for path in matching(spark, pattern):
        source_fs, source = _fs(spark, path)
        target = jvm.org.apache.hadoop.fs.Path(f"{to}/{path.rsplit('/', 1)[1]}")
        if not jvm.org.apache.hadoop.fs.FileUtil.copy(source_fs, source, fs, target, not copy, True, conf):
            raise OSError(f"could not {'copy' if copy else 'move'} {path}")
        out.append(target.toString())
    return out


def remove_matching(spark: SparkSession, pattern: str) -> list[str]:
    """K5: removes the files that match."""
    paths = matching(spark, pattern)
    for path in paths:
        fs, p = _fs(spark, path)
        fs.delete(p, True)
    return paths


def append_metrics(metrics: DataFrame, path: str, run: str, step: int = 0) -> None:
    """K6: metric, value rows appended to a table with the run's name and step."""
    metrics.select(F.lit(run).alias("run"), F.lit(step).alias("step"), "metric", "value").write.mode("append").parquet(path)
