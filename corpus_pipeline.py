"""A corpus pipeline: language ID, near-dedup, passage dedup, decontamination, mixing.

Each stage takes the documents that the one before it kept, decides by one
operator, and returns the columns of ``documents``; the last returns the mix.
Empty tables, nulls, empty and very long texts, repeated rows and extra columns
pass through every stage as its operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.llm import staging
from lectern.llm.bwt_dedup import dedup
from lectern.llm.decontaminate import decontaminate
from lectern.llm.langid import REJECT, identify, train
from lectern.llm.mixing import mix
from lectern.llm.neardup import near_duplicates

_began = [0]


def _next_stage(first: bool = False) -> None:
    """Delete what earlier stages of this run staged; their results have been written by now."""
    if first:
        _began[0] = staging.mark()
    else:
        staging.release(_began[0])


def _free(name: str, taken: list[str]) -> str:
    """``name``, or with underscores before it one that no column has, case aside."""
    while name.lower() in {c.lower() for c in taken}:
        name = "_" + name
    return name


def _columns(docs: DataFrame) -> list[F.Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def _without(docs: DataFrame, dropped: DataFrame, key: F.Column) -> DataFrame:
    """Rows of ``docs`` whose key is not among the dropped ones, in their one column."""
    name = _free("__key", docs.columns)
    dropped = staging.stage(dropped.distinct().withColumnRenamed(dropped.columns[0], name), "dropped")
    few = dropped.limit(100_001).count() <= 100_000
    return docs.withColumn(name, key).join(F.broadcast(dropped) if few else dropped, name, "left_anti").select(*_columns(docs))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language: not ``und``, pooled probability ``REJECT`` at least."""
    _next_stage(first=True)
    # The operator's own names are kept off the table's.
    own = {c: f"c{n}" for n, c in enumerate(docs.columns) if c != "text"}
    told = identify(docs.select(*[F.col(f"`{c}`").alias(own.get(c, c)) for c in docs.columns]), train(docs))
    kept = told.where((F.col("lang_pred") != "und") & (F.col("score") >= REJECT))
    return kept.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that with the smallest doc_id; of repeated rows one."""
    _next_stage()
    classes = staging.stage(near_duplicates(docs).select("doc_id", "node", "kept"), "classes")
    node = F.coalesce(F.md5("text"), F.concat(F.lit("null "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    key = F.struct("doc_id", node.alias("node"))
    kept = _without(docs, classes.where(~F.col("kept")).select(F.struct("doc_id", "node").alias("__key")), key)
    repeated = classes.where("kept").groupBy(F.struct("doc_id", "node").alias("__key")).count().where("count > 1").select("__key")
    repeated = staging.stage(repeated, "repeated")
    if not repeated.take(1):
        return kept
    name = _free("__key", docs.columns)
    both = kept.withColumn(name, key)
    one = both.join(repeated.withColumnRenamed("__key", name), name).dropDuplicates([name]).select(*_columns(docs))
    return _without(kept, repeated, key).unionByName(one)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that repeat across or within them; no row goes."""
    _next_stage()
    others = [c for c in docs.columns if c != "text"]
    renamed = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(others)])
    cut = dedup(renamed, columns=tuple(f"c{n}" for n in range(len(others))), with_text=True)
    value = {c: F.col(f"c{n}") for n, c in enumerate(others)} | {"text": F.col("kept_text")}
    if "n_chars" in value:
        value["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(value["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return cut.select(*[value[c].alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    _next_stage()
    told = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), with_key=True)
    key = F.struct("doc_id", F.xxhash64("text").alias("text_hash"))
    return _without(docs, told.where("contaminated").select(F.col("key").alias("__key")), key)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes from each document; see ``lectern.llm.mixing.mix``."""
    _next_stage()
    return mix(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: SQL can express neither the recurrent network nor the sampling; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        path = staging.new_path(spark, f"pipeline-{name}", own=True)
        made.write.parquet(path)
        if folder:
            staging.delete(spark, folder)
        docs, folder = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
