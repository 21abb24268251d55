"""From documents to packed training sequences in five stages, each over all rows that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import _common, near_docs, packing, quality, secrets, tiling

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes of a batch to Python workers: five stages in one session leave little of an executor beside its heap.
BATCH = 2 << 20


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number of their own, stored: doc_id may be null or repeated."""
    _common.small_batches(docs.sparkSession, BATCH)
    return _common.stage(docs.select(COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more; the model learns from the labelled ones among them that are not held out.

    Rows are judged one by one by their text, so repeated ones fare alike; null and empty texts are scored as a passage of
    zeros. An empty table stays empty. A text takes about seventeen times its bytes in a task.
    """
    _common.small_batches(spark, BATCH)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs.select(COLUMNS), model).where("quality_score >= 0.7").select(COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate rows one: that of the least doc_id (null last), of equal ones the first stored.

    Rows are compared, not ids: of repeated rows one stays, rows that share a doc_id and differ in text both do. Rows
    without words are no duplicates of each other. An empty table stays empty. A text takes about thirteen times its bytes
    in a task.
    """
    rows = _numbered(docs)
    found = near_docs.near_documents(rows.select(F.col("row").alias("doc_id"), "text")).where("n_shingles > 0")
    found = found.select(F.col("doc_id").alias("row"), "component_id")
    found = _common.stage(found.join(rows.select("row", "doc_id"), "row"), "groups")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    first = found.groupBy("component_id").agg(least.alias("x"), F.count("*").alias("n")).where("n > 1")
    gone = _common.spread_join(found, first.select("component_id", F.col("x.row").alias("stays")), ["component_id"], F.xxhash64("row"), "inner")
    gone = _common.stage(gone.where("row <> stays").select("row"), "gone")
    return rows.join(_common.bounded(gone, 8), "row", "left_anti").select(COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text covers no benchmark item; another row with the doc_id of one that does stays.

    Null and empty texts stay, as does every row where the benchmark is empty; an empty table stays empty. A text takes
    about eight times its bytes in a task.
    """
    rows = _numbered(docs)
    found = tiling.contaminated(rows.select(F.col("row").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = _common.stage(found.select(F.col("doc_id").alias("row")).distinct(), "gone")
    return rows.join(_common.bounded(gone, 8), "row", "left_anti").select(COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets replaced in their texts; a null text stays null, an empty table empty.

    A text takes about twice its bytes in a task.
    """
    _common.small_batches(spark, BATCH)
    return secrets.redact(docs.select(COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: its place in a sequence of at most 2048 tokens; null and empty texts have one too."""
    _common.small_batches(spark, BATCH)
    pieces = packing.pieces_of(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]
#: SQL has no model, tiling or tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; each one's rows are stored in the shared folder for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = _common.stage(docs, f"stage{k + 1}")
    return docs
