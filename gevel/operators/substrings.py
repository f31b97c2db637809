"""Joins by substrings, through indexes of parts of texts, so that no text meets all others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gevel.operators.kept import kept

#: Length of the parts that texts are indexed by.
Q = 3
#: Characters of texts, each with its rarest part, that may be sent to all tasks.
SENT = 16_000_000


def grams(text: Column, length: int | Column) -> Column:
    """The different parts of a text of a length; none if it is shorter."""
    k = F.lit(length) if isinstance(length, int) else length
    last = F.char_length(text) - k + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, k)))).otherwise(F.array().cast("array<string>"))


def first_holding(asked: DataFrame, text: str, docs: DataFrame, doc_text: str, ident: str) -> DataFrame:
    """(text, ident): for each different text, the smallest ident of the docs that hold it as a part. Texts without such a doc give no row.

    A text of Q characters or more meets only the docs that hold its rarest part of that length; shorter ones meet the smallest ident of each part of their length, of which there are few. The texts with their parts are written and looked at: up to SENT characters of them go to the docs, else both are dealt by part; the docs never go to all tasks. Runs jobs when called.
    """
    texts = asked.select(F.col(text).alias("_t")).where("_t is not null").distinct()
    some = docs.select(F.col(doc_text).alias("_d"), F.col(ident).alias("_i")).where("_d is not null")
    index = some.select("_i", "_d", F.explode(grams(F.col("_d"), Q)).alias("_g"))
    count = index.groupBy("_g").agg(F.count("*").alias("_n"))
    rarest = texts.select("_t", F.explode(grams(F.col("_t"), Q)).alias("_g")).join(count.hint("merge"), "_g", "left").groupBy("_t").agg(F.min_by("_g", F.struct(F.coalesce("_n", F.lit(0)), "_g")).alias("_g"))
    rarest = kept(rarest.where("_g is not null"), "rarest")
    size = rarest.agg(F.sum(F.char_length("_t") + Q + 50)).first()[0] or 0
    # An index is many times the docs that its size is estimated by, so the choice isn't left to the estimate.
    rarest = F.broadcast(rarest) if size <= SENT else rarest.hint("merge")
    long = rarest.join(index, "_g").where(F.contains("_d", "_t")).groupBy("_t").agg(F.min("_i").alias("_i"))
    lengths = F.array(*(F.lit(k) for k in range(Q)))
    parts = some.select("_i", F.explode(F.flatten(F.transform(lengths, lambda k: F.when(k == 0, F.array(F.lit(""))).otherwise(grams(F.col("_d"), k))))).alias("_t")).groupBy("_t").agg(F.min("_i").alias("_i"))
    short = texts.where(F.char_length("_t") < Q).join(parts.hint("merge"), "_t")
    return long.unionByName(short.select("_t", "_i")).select(F.col("_t").alias(text), F.col("_i").alias(ident))


def first_held(asked: DataFrame, text: str, parts: DataFrame, part: str, ident: str) -> DataFrame:
    """(text, ident): for each different text, the smallest ident of the parts that it holds. Parts have few different lengths, so a text is cut into all its parts of these lengths, which meet theirs by equality."""
    some = parts.select(F.col(part).alias("_p"), F.col(ident).alias("_i")).where("_p is not null").groupBy("_p").agg(F.min("_i").alias("_i"))
    lengths = some.select(F.sort_array(F.collect_set(F.char_length("_p")))).scalar()
    texts = asked.select(F.col(text).alias("_t")).where("_t is not null").distinct().withColumn("_k", F.coalesce(lengths, F.array().cast("array<int>")))
    cut = texts.select("_t", F.explode(F.flatten(F.transform("_k", lambda k: F.when(k == 0, F.array(F.lit(""))).otherwise(grams(F.col("_t"), k))))).alias("_p"))
    return cut.join(some.hint("merge"), "_p").groupBy("_t").agg(F.min("_i").alias("_i")).select(F.col("_t").alias(text), F.col("_i").alias(ident))
