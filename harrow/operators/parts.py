"""Joins by a part of a text, through an index of its three-letter pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a piece; a shorter part is looked up as it is.
PIECE = 3


def _pieces(letters: str, shortest: int) -> Column:
    """The distinct pieces of ``shortest`` to three letters of a column of letters; an empty one too, if none is the shortest."""
    size, each = F.size(letters), F.col(letters)
    none = F.array().cast("array<int>")
    of = lambda n: F.transform(F.when(size >= n, F.sequence(F.lit(0), size - n)).otherwise(none), lambda i: F.concat(*(F.get(each, i + k) for k in range(n))))
    sizes = [of(n) for n in range(max(shortest, 1), PIECE + 1)]
    return F.array_distinct(F.concat(*sizes, F.array(F.lit(""))) if shortest == 0 else F.concat(*sizes))


def holding(texts: DataFrame, text: str, parts: DataFrame, part: str) -> DataFrame:
    """``text``, ``part``: the distinct pairs of which the first holds the second, case counting.

    A part meets only the texts that have its rarest piece of three letters; one of up to two letters those that have it. So
    parts that nothing holds meet nothing, and no text is compared with all parts. An empty part is held by every text; null texts and
    parts are in no pair. The pieces of a text are as many as three times its letters: this is for names and codes.
    """
    letters = lambda c: F.regexp_extract_all(F.col(c), F.lit("(?s)."), F.lit(0))
    held = texts.select(F.col(text).alias("__text")).where("__text IS NOT NULL").distinct().withColumn("__letters", letters("__text"))
    index = held.select("__text", F.explode(_pieces("__letters", 0)).alias("__piece"))
    counts = index.groupBy("__piece").agg(F.count(F.lit(1)).alias("n"))
    sought = parts.select(F.col(part).alias("__part")).where("__part IS NOT NULL").distinct().withColumn("__letters", letters("__part"))
    keys = F.when(F.length("__part") < PIECE, F.array("__part")).otherwise(_pieces("__letters", PIECE))
    of = sought.select("__part", F.explode(keys).alias("__piece")).join(counts, "__piece", "left")
    rarest = of.groupBy("__part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("__piece").alias("piece"))).alias("least")).where("least.n > 0")
    met = rarest.select("__part", F.col("least.piece").alias("__piece")).join(index, "__piece").where(F.contains("__text", "__part"))
    return met.select(F.col("__text").alias(text), F.col("__part").alias(part))
