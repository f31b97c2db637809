"""One query for each operator, over the whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gevel.llm import lexical, licenses
from gevel.llm.ann import nearest
from gevel.llm.bpe import encode_decode
from gevel.llm.html_text import html_text
from gevel.llm.language import languages
from gevel.llm.media import media_columns
from gevel.llm.ngram_join import jaccard_groups
from gevel.llm.packing import pack
from gevel.llm.pii import find_pii
from gevel.llm.token_count import token_counts
from gevel.llm.tokenizer_files import path
from gevel.llm.toxicity import toxicity
from gevel.llm.whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 3-word shingles have a Jaccard similarity of at least 0.9, and how many others each links with."""
    return jaccard_groups(_table(spark, sf_dir, "documents"), width=3, percent=90, links=True)


def op2_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens, each window holding every source in its share."""
    return pack(_table(spark, sf_dir, "documents"), path("byte_bpe_50k.tiktoken")).drop("ids")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licences among all documents' texts and lines."""
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest neighbours of each hundredth embedding."""
    return nearest(_table(spark, sf_dir, "embeddings"), k=10, every=100)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents under the 32k piece model."""
    return token_counts(_table(spark, sf_dir, "documents"), path("piece_bpe_32k.model"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of all documents under the 49k word vocabulary, and of the texts decoded from them."""
    return encode_decode(_table(spark, sf_dir, "documents"), path("word_bpe_49k.json"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents' texts, learned from two thirds of the documents."""
    return languages(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of all documents' texts, learned from four fifths of the labels."""
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain and disguised personal data in all documents."""
    return find_pii(_table(spark, sf_dir, "documents"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as stored media, with columns read back from them."""
    out = media_columns(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bits")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings along their 32 principal components, each with variance 1."""
    return whiten(_table(spark, sf_dir, "embeddings"), most=32)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each item of the benchmark."""
    return lexical.ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=20)


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return html_text(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_mixture_packing, op3_license_scan, op4_nearest_neighbours, op5_token_counts, op6_bpe, op7_language, op8_toxicity, op9_pii, op10_media_columns, op11_embedding_whitening, op12_ranked_search, op13_html_text)}
ORACLE: dict[str, str] = {"op3_license_scan": licenses.oracle_sql(), "op12_ranked_search": lexical.oracle_sql()}
