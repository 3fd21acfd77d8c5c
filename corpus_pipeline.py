"""From raw documents to packed sequences: quality rules, line dedup, near-dedup, mixing, packing.

Each stage reads all that the one before it kept and returns the columns of ``documents``; the last returns pieces.
A document whose lines are all dropped has nothing left and goes. ``n_chars``, where there is one, is that of the text
that is left.

Nulls and odd input: quality rules reject rows of fewer than ten words, so null, empty and blank texts end there. A later
stage on its own keeps them: they have no lines to drop, are linked with nothing (equal rows of them all stay), count nothing in a mix,
and are packed as an end mark each. Equal rows with words are one group of near duplicates, of which one stays; rows
of one number that differ are documents of their own. A null number is kept like any other, and a null source is a source.
Texts of any length are processed whole. Extra columns, whatever their names, ride along up to the packing, which has columns of its
own. An empty table gives an empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotbook.llm import linedup, mixing, neardup, packing, quality
from lotbook.llm.queries import query, table, word_bpe_path
from lotbook.session import staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the trees accept."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, model).where("kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line repeats."""
    found = linedup.dedup_lines(docs).where((F.size("dropped") == 0) | (F.trim("text") != ""))
    columns = {"text": F.col("text"), "n_chars": F.when(F.size("dropped") > 0, F.length("text")).otherwise(F.col("row.n_chars"))} \
        if "n_chars" in docs.columns else {"text": F.col("text")}
    return found.select(*[columns.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    mixed = mixing.mix(docs).where("copies > 0")
    return mixed.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return packing.pack(packing.pieces(docs, word_bpe_path()))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: Trees, signatures, draws and tokens are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs


query("pipeline", ORACLE_SQL)(run)
