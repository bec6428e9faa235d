"""From raw documents to packed sequences: quality, near copies, repeated passages, packing.

Each stage takes what the one before kept and gives documents again; the last gives the
pieces of packed sequences with their ids. ``run`` writes every stage's result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.minhash import near_duplicates
from cairn.llm.packing import pack_documents, word_bpe
from cairn.llm.quality import clean_lines
from cairn.llm.substrings import remove_repeats, text_key
from cairn.plans.durable import durable


def _others(docs: DataFrame) -> dict[str, str]:
    """Columns that a stage hands on as they are."""
    return {f"other{i}": c for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "n_chars")}


def _as_documents(docs: DataFrame, done: DataFrame, text: str) -> DataFrame:
    """The columns of ``docs``, with a new text and its length."""
    back = {c: new for new, c in _others(docs).items()}
    length = F.length(text).cast("long")
    new = {"doc_id": F.col("doc_id"), "text": F.col(text), "n_chars": length}
    return done.select(*[(new[c] if c in new else F.col(back[c])).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that fail, and documents that fail or lose too much."""
    done = clean_lines(docs, carry=_others(docs)).filter("kept")
    return _as_documents(docs, done, "clean_text")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the least id, then the least text key; of equal rows one."""
    stay = near_duplicates(docs, leads=True).filter("first").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    keyed = docs.withColumn("__text_key", text_key(F.coalesce(F.col("text"), F.lit(""))))
    same = keyed["doc_id"].eqNullSafe(stay["__id"]) & (keyed["__text_key"] == stay["__key"])
    return keyed.join(stay, same, "left_semi").dropDuplicates(["doc_id", "__text_key"]).drop("__text_key")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 35 words and more that stand anywhere else."""
    return _as_documents(docs, remove_repeats(docs, layout=True, carry=_others(docs)), "kept_text")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, with their ids."""
    return pack_documents(docs, word_bpe(), with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", one_of_each_group),
    ("repeated substrings", repeated_passages),
    ("packing", packed),
]

#: SQL has no tokenizer, so the whole is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
