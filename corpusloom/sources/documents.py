"""Reading parse results, JSON lines and logs; writing manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Files that a parsed document needs, by suffix.
PARTS = {"md": ".md", "content_list": "_content_list.json", "middle": "_middle.json", "model": "_model.json"}

_ITEM = "array<struct<type:string,content:string>>"
CONTENT = f"struct<title_content:{_ITEM},paragraph_content:{_ITEM},list_type:string,list_items:array<struct<item_type:string,item_content:{_ITEM}>>,table_caption:{_ITEM},table_footnote:{_ITEM},html:string,table_type:string,chart_caption:{_ITEM},chart_footnote:{_ITEM},image_caption:{_ITEM},image_footnote:{_ITEM},content:string,math_content:string,image_source:struct<path:string>>"
BLOCK = f"struct<type:string,sub_type:string,bbox:array<double>,content:{CONTENT}>"


def load_parsed_documents(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Documents whose four files are all there (folder, one column for each, pages), and the folders that lack some."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.decode("content", "UTF-8").alias("body"))
    part = F.lit(None).cast("string")
    for name, suffix in PARTS.items():
        part = F.when(F.endswith(F.col("path"), F.lit(suffix)), name).otherwise(part)
    rows = files.withColumn("part", part).where("part is not null").withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
    pick = [F.max(F.when(F.col("part") == name, F.col("body"))).alias(name) for name in PARTS]
    return with_pages(rows.groupBy("folder").agg(*pick))


def with_missing(whole: DataFrame) -> DataFrame:
    """Rows with the parts that they lack, and with pages read from the content list if they lack none."""
    missing = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in PARTS]))
    pages = F.from_json("content_list", f"array<array<{BLOCK}>>")
    return whole.withColumn("missing", missing).withColumn("pages", F.when(F.size("missing") == 0, pages))


def with_pages(whole: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with all parts, and pages read from the content list; the folders that lack parts, and which."""
    whole = with_missing(whole)
    return whole.where(F.size("missing") == 0).drop("missing"), whole.where(F.size("missing") > 0).select("folder", "missing")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with status ok, other rows, and corrupt lines."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = spark.read.text(path).where(F.trim("value") != "")
    full = T.StructType([*kind.fields, T.StructField("_bad", T.StringType())])
    parsed = rows.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")
    bad = parsed.where("_bad is not null").select(F.col("_bad").alias("line"))
    fine = parsed.where("_bad is null").drop("_bad")
    return fine.where("status = 'ok'"), fine.where("status is null or status <> 'ok'"), bad


def write_manifest(df: DataFrame, path: str, by: str = "book_dir", fmt: str = "json") -> None:
    df.repartition(by).write.mode("overwrite").partitionBy(by).format(fmt).save(path)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """A stream of raw log lines."""
    return spark.readStream.schema("value string").text(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the provided tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
