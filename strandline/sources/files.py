"""Files: JSON lines, CSV, folder inventories and blobs, through Spark's readers and writers.

Spark's commit protocol takes the place of lock files and renames: a record is there whole or not at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, DoubleType, FloatType, MapType, StructType

from strandline.functions.documents import matches
from strandline.session import table, work_dir


def _safe(x: Column, kind: DataType, depth: int) -> Column:
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(~(F.isnan(x) | (F.abs(x) == float("inf"))), x)
    if depth <= 0 and isinstance(kind, (StructType, ArrayType, MapType)):
        return F.to_json(x)  # deeper than a reader should go: as text
    if isinstance(kind, StructType):
        return F.when(x.isNotNull(), F.struct(*[_safe(x[f.name], f.dataType, depth - 1).alias(f.name) for f in kind.fields]))
    if isinstance(kind, ArrayType):
        return F.transform(x, lambda v: _safe(v, kind.elementType, depth - 1))
    if isinstance(kind, MapType):
        return F.transform_values(x, lambda _, v: _safe(v, kind.valueType, depth - 1))
    return F.base64(x) if isinstance(kind, BinaryType) else x


def _has_odd(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return any(_has_odd(f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return _has_odd(kind.elementType)
    if isinstance(kind, MapType):
        return _has_odd(kind.valueType)
    return isinstance(kind, (DoubleType, FloatType, BinaryType))


def finite(df: DataFrame, depth: int = 8) -> DataFrame:
    """What JSON has no form for is replaced, at any depth: doubles that are not finite by null, bytes by base64.

    Structures more than ``depth`` levels down become JSON texts. Columns without such values are left as they are.
    """
    return df.withColumns({f.name: _safe(F.col(f"`{f.name}`"), f.dataType, depth) for f in df.schema.fields if _has_odd(f.dataType)})


def csv_text(df: DataFrame, columns: list[str], out: str = "line") -> DataFrame:
    """``df`` and a column with the named columns as one CSV line, quoted where it must be; null is empty."""
    return df.withColumn(out, F.to_csv(F.struct(*columns)))


def append_jsonl(df: DataFrame, path: str) -> None:
    finite(df).write.mode("append").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Records by a fixed schema; a line that is no JSON goes to _corrupt with nulls beside it."""
    fields = schema if isinstance(schema, str) else ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    return spark.read.schema(f"{fields}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def stream_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_new(df: DataFrame, path: str) -> None:
    """Fails where the path exists."""
    df.write.mode("errorifexists").parquet(path)


def inventory(spark: SparkSession, root: str, pattern: str = "*", include: list[str] | None = None, exclude: list[str] | None = None, depth: int | None = None) -> DataFrame:
    """path, length and modificationTime of files below a folder, in path order without regard to case; no content is read.

    ``include`` and ``exclude`` are globs on the path below ``root`` (``**`` crosses folders), ``depth`` is how many
    folders down a file may lie.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    files = files.select("path", "length", "modificationTime")
    if include or exclude or depth is not None:
        whole = spark._jvm.org.apache.hadoop.fs.Path(root)
        whole = whole.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(whole).toString().rstrip("/")
        below = F.col("path").substr(F.lit(len(whole) + 2), F.length("path"))
        files = files.where(matches(below, include or ["**"], exclude, depth))
    return files.orderBy(F.lower("path"))


def with_fallback(files: DataFrame, folder: Column, first: str, second: str, exclude: str = "^$") -> DataFrame:
    """Per folder files that match ``first``, or ``second`` where a folder has none (regular expressions on the path)."""
    own = files.where(~F.col("path").rlike(exclude)).withColumn("_f", folder).withColumn("_first", F.col("path").rlike(first))
    own = own.withColumn("_n", F.count_if("_first").over(Window.partitionBy("_f")))
    return own.where(F.when(F.col("_n") > 0, F.col("_first")).otherwise(F.col("path").rlike(second))).drop("_f", "_first", "_n")


def numbered_files(files: DataFrame, prefix: str) -> DataFrame:
    """Files named prefix_number.ext with their numbers, in number order."""
    number = F.regexp_extract("path", rf"/{prefix}_(\d+)\.[a-z0-9]+$", 1)
    return files.withColumn("number", F.when(number != "", number).cast("int")).where("number is not null").orderBy("number")


def missing_outputs(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Inputs that no output names yet."""
    return inputs.join(outputs.select(key).distinct(), key, "left_anti")


# queries


def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines in two appends, read back by schema."""
    path = work_dir(spark, "jsonl")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.when(F.pmod("event_id", F.lit(10)) == 0, float("nan")).otherwise(F.col("value")).alias("value"))
    append_jsonl(e.where("event_id % 2 = 0"), path)
    append_jsonl(e.where("event_id % 2 = 1"), path)
    back = read_jsonl(spark, path, "event_id long, user_id long, event_type string, value double")
    return back.groupBy("event_type").agg(F.count("*").alias("n"), F.count("value").alias("finite"), F.round(F.sum("value"), 2).alias("sum"), F.count("_corrupt").alias("corrupt"))


JSONL = """
select event_type, count(*) n, count_if(event_id % 10 <> 0) as finite, round(sum(value) filter (where event_id % 10 <> 0), 2) as sum, 0 as corrupt from events group by 1
"""


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run timings as CSV with a header, read back by schema."""
    path = work_dir(spark, "csv")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    append_csv(o, path)
    back = read_csv(spark, path, "o_orderkey long, o_orderstatus string, o_totalprice double")
    return back.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 1).alias("sum"))


CSV = "select o_orderstatus, count(*) n, round(sum(o_totalprice), 1) as sum from orders group by 1"

QUERIES = {"jsonl_round_trip": (jsonl_round_trip, JSONL), "csv_round_trip": (csv_round_trip, CSV)}
