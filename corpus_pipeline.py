"""A corpus made ready for training: language ID, toxicity, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns the rows that the next one gets; all but the last return the columns of docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gevel.llm import language, toxicity
from gevel.llm.ngram_join import jaccard_groups, without
from gevel.llm.packing import pack
from gevel.llm.pii import redact_pii
from gevel.llm.stages import in_small_batches, written
from gevel.llm.tokenizer_files import path

#: By how many spreads a text's letters may be rarer than usual in the learned languages. Labelled texts that the model has not seen stay below 7 (of 51,282; all but one in 10,000 below 5.4); words of random letters and of languages that were not learned lie above 9.
MOST_STRANGE = 8.0


def _unused(columns: list[str], *names: str) -> list[str]:
    """Each name with as many underscores before it as keep it apart from the columns."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts in the languages that docs names, also those that mix them. Null and empty texts, texts without a letter, and those whose words are like none of the languages (junk, other languages) go; if docs names no language at all, nothing can be told apart and all rows stay."""
    in_small_batches(spark)
    model = language.train(docs)
    if not model.languages:
        return docs
    kind, share, strange = _unused(docs.columns, "lang_pred", "lang_share", "lang_strange")
    found = language.identify(docs, model, names=(kind, share, strange))
    return found.where((F.col(kind) != language.UNKNOWN) & (F.col(strange) <= MOST_STRANGE)).drop(kind, share, strange)


def by_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts that are not toxic by a model of the labelled ones among docs. Null and empty texts stay."""
    in_small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    parts, out = 5, 0
    model = toxicity.train(docs, labels.where(toxicity.fold(F.col("doc_id"), parts) != out), "doc_id", "text", "toxic")
    share, mark = _unused(docs.columns, "toxic_score", "toxic_mark")
    return toxicity.score(docs, model, names=(share, mark)).where(F.col(mark) == 0).drop(share, mark)


def by_nearness(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near duplicates: five-word n-grams, similarity of 0.8 or more. Rows that repeat an id are documents of their own, of which one stays if their texts are near duplicates. Rows with a null id, and texts without a word, stay."""
    in_small_batches(spark)
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        groups = written(jaccard_groups(docs, width=5, percent=80).where("doc_id != component_id").select("doc_id"), "gone")
        return without(docs, "doc_id", groups)
    (row,) = _unused(docs.columns, "row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = jaccard_groups(rows.where("doc_id is not null"), id_col=row, width=5, percent=80).where("n_shingles > 0").select(row, "component_id")
    groups = written(groups.join(rows.select(row, "doc_id"), row), "groups")
    stays = groups.groupBy("component_id").agg(F.min(F.struct("doc_id", row)).alias("best")).select(F.col(f"best.{row}").alias(row))
    return without(rows, row, written(groups.join(stays, row, "left_anti").select(row), "gone")).select(docs.columns)


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind in brackets; n_chars, if there, is that of the new text. Null texts stay null."""
    in_small_batches(spark)
    clean = redact_pii(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts in sequences of 1024 tokens, with their ids."""
    in_small_batches(spark)
    return pack(docs, path("byte_bpe_50k.tiktoken"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", by_language),
    ("toxicity", by_toxicity),
    ("near_duplicates", by_nearness),
    ("pii", without_pii),
    ("packing", packed),
]

#: Language ID, toxicity and tokens are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what each returns is written as Parquet and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
