"""The corpus pipeline: documents through five stages, each a Parquet table that the next one reads.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Rows: null texts fail the quality rules; null ids are kept by near-dedup and decontamination unless their text is contaminated;
an empty table passes through; extra columns are carried along until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.llm import common, decontaminate, near_dedup, pieces, quality, secrets
from taskloom.llm.queries import PIECES


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of policy v1 rejects."""
    rows = quality.apply_policy(quality.ledger(docs, carry=True), quality.POLICIES["v1"])
    return rows.where("kept").select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id."""
    judged = common.stored(near_dedup.near_duplicates(docs), "near-duplicates")
    gone = judged.where("not kept").select("doc_id").distinct()
    left = docs.join(common.stored(gone, "gone"), "doc_id", "left_anti")
    twice = common.stored(judged.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        return left.select(docs.columns)
    # rows that repeat an id and its text are copies, too
    once = left.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(twice, "doc_id", "left_anti").unionByName(once).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item; the verdict is on the text of a row, whatever rows share its id."""
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), hash_col="th")
    ids = common.stored(found.select("doc_id", "th").distinct(), "contaminated")
    same = docs["doc_id"].eqNullSafe(ids["doc_id"]) & (F.xxhash64(docs["text"].cast("string")) == ids["th"])
    return docs.join(ids, same, "left_anti").select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each secret replaced by a mark; others as they are."""
    rows = secrets.scan(docs, out="_secret_spans")
    rows = rows.withColumn("_redacted", secrets.redacted(F.col("text"), F.col("_secret_spans")))
    own = {"text": F.col("_redacted")}
    if "n_chars" in docs.columns:
        length = F.length("_redacted").cast(docs.schema["n_chars"].dataType)
        own["n_chars"] = F.when(F.size("_secret_spans") > 0, length).otherwise(F.col("n_chars"))
    return rows.select(*(own[c].alias(c) if c in own else F.col(f"`{c}`") for c in docs.columns))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32, decoded_sha256, exact, ids."""
    return pieces.encode_documents(docs, PIECES, memo=MEMO)


#: Chunks that a worker of the last stage remembers: the workers live on beside those of the other stages.
MEMO = 150_000
STAGES = [
    ("quality_rules", keep_quality),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("sentencepiece", encode_pieces),
]
#: SentencePiece ids are beyond SQL; tests/llm compares the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
