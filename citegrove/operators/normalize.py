"""Normalisation jobs over whole tables."""
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from citegrove.functions.classes import repair_word
from citegrove.functions.laws import alias_exact, clean_law_name
from citegrove.rules import LAW_ALIASES, LAW_NAME_MIN_CHARS, LAW_SIMILARITY

_GRAM = 3


def repair_words(df: DataFrame, word: str, vocabulary: list[str] | None = None) -> DataFrame:
    """Adds `repaired`: the vocabulary word behind an OCR-damaged one.  A row-local expression over a fixed
    vocabulary, so frequent words need no join and cause no skew."""
    return df.withColumn("repaired", repair_word(F.col(word), vocabulary))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the letters in matching blocks over all letters; blocks are the longest common stretch, then those on its left and right."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def _grams(name: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(name) - (_GRAM - 1)), lambda i: F.substring(name, i, F.lit(_GRAM))))


def law_codes_by_ratio(df: DataFrame, name: str, threshold: float = LAW_SIMILARITY) -> DataFrame:
    """Adds `law_code`: that of the law name or alias that equals the name, else of the long one of as many words with the largest sequence ratio of at
    least `threshold`, the first of the table on ties; NULL without one, for short names and for NULL.

    Distinct names are compared once.  Only pairs are compared that share as many letter triples as the ratio allows to be lost: letters outside
    matching blocks are at most (1 - threshold) of both names together, and each takes at most three triples with it."""
    cleaned = clean_law_name(F.col(name))
    exact = alias_exact(cleaned)
    asked = df.select(cleaned.alias("c"), exact.alias("code")).filter(F.col("code").isNull() & (F.length("c") >= LAW_NAME_MIN_CHARS)).select("c").distinct()
    asked = asked.select("c", F.size(F.split("c", " ")).alias("words"), _grams(F.col("c")).alias("grams"))
    known = df.sparkSession.createDataFrame([(n.replace("rn", "m"), len(n.split()), i, code) for i, (n, code) in enumerate(LAW_ALIASES.items())
                                             if len(n) >= LAW_NAME_MIN_CHARS], "alias string, words int, seq int, code string")
    left = asked.select("c", "words", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    right = known.select("alias", "words", "seq", "code", F.explode(_grams(F.col("alias"))).alias("gram"))
    shared = left.join(F.broadcast(right), ["words", "gram"]).groupBy("c", "n", "alias", "seq", "code").agg(F.count("*").alias("shared"))
    enough = F.col("n") - _GRAM * (1 - threshold) * (F.length("c") + F.length("alias"))
    near = shared.filter(F.col("shared") >= enough).withColumn("ratio", sequence_ratio("c", "alias")).filter(F.col("ratio") >= threshold)
    best = near.groupBy(F.col("c").alias("_c")).agg(F.max_by("code", F.struct("ratio", -F.col("seq"))).alias("_near"))
    return df.join(best, cleaned == F.col("_c"), "left").withColumn("law_code", F.coalesce(exact, "_near")).drop("_c", "_near")
