"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Each stage is one operator of ``fieldloom.llm`` over what the stage before it kept, written as Parquet and read again.
Columns beside those of documents are carried, whatever their names; repeated rows are judged alike; an empty table goes
through all stages and gives no pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import op1_minhash, op4_decontam, op7_packing, op8_lines, op9_langid, state
from fieldloom.ship import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that some language explains.  Rows without a text, a language, a source or an id stay."""
    ship(spark)
    return op9_langid.keep_known(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one holds; n_chars follows the text.  Those that lose lines and have
    nothing left go; empty and null texts stay as they are, and so do rows without an id."""
    ship(spark)
    out = op8_lines.dedup_lines(docs, keep_emptied=False)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates; every row of its id.  Rows without words or without an id stay."""
    ship(spark)
    return op1_minhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item; rows are judged each, those without an id too."""
    ship(spark)
    return op4_decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences; a null text is an empty one."""
    ship(spark)
    return op7_packing.pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: SQL can't express the fitted models and the tokenizer; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents.  What a stage kept goes when the next one's result is written."""
    before, docs = None, spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with state.steps(spark) as outlives:
            following = state.keep(stage(spark, docs, sf_dir), name)
            outlives(following)
        if before is not None:
            state.release(spark, before)
        before = docs = following
    return STAGES[-1][1](spark, docs, sf_dir)
