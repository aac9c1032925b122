"""What the corpus operators share: intermediate tables, Arrow batches, words."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.sources.shared import drop_stored, shared_dir, stored  # noqa: F401
from taskloom.sources.tables import bounded, estimated_bytes

#: A word is a run of anything but ASCII white space; the same set that bytes.split() cuts at.
WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches bounded by bytes as well as rows, so that long texts don't add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


#: Bytes of input for a task where the number of tasks is chosen here.
TASK_BYTES = 64 << 20


def tasks_for(df: DataFrame, task_bytes: int = TASK_BYTES, most: int = 100_000) -> int:
    """Tasks for a shuffle of df: the session's number, more if the estimated size asks for more.  An estimate of a petabyte
    or more is that of a source that doesn't know its size, and tells nothing."""
    own, size = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), estimated_bytes(df)
    return own if size >= 1 << 50 else max(own, min(-(-size // task_bytes), most))


def with_facts(rows: DataFrame, facts: DataFrame, keys: list[str], hot: int) -> DataFrame:
    """rows with the facts of their keys (a stored table, one row a key, n: the key's rows).

    Rows of a key with more than `hot` ones get theirs by a broadcast and stay where they are, if the facts of all such keys pass the check of size; there are
    fewer of them than rows / hot.  The other rows are joined by shuffle.  The input is read twice, so it should be a stored table or a plain scan."""
    frequent = facts.where(F.col("n") > hot)
    rest = rows.join(bounded(frequent.select(*keys)), keys, "left_anti")
    return rows.join(bounded(frequent), keys).unionByName(rest.join(facts.where(F.col("n") <= hot), keys))


def texts_of(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = "th") -> DataFrame:
    """id, text and a 64-bit hash of the text; (id, hash) tells apart rows that repeat an id."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias(key))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)
