"""Label mining: quantities from key and value rows, numbers and times from free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tielace.functions.fixed import LABEL_ALIASES

NUMBER = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"
TIME_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss", "yyyy-DDD'T'HH:mm:ss", "yyyy-MM-dd")


def number_in(text: Column) -> Column:
    """The first number in a text, or null."""
    return F.nullif(F.regexp_extract(text, NUMBER, 0), F.lit("")).try_cast("double")


def parsed_time(text: Column) -> Column:
    """A timestamp by the first format that fits, without a closing Z; null if none does."""
    plain = F.regexp_replace(F.trim(text), "Z$", "")
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in TIME_FORMATS])


def aliases(spark) -> DataFrame:
    """quantity, alias, rank: fixed rows."""
    return spark.createDataFrame([(q, a, i) for q, names in LABEL_ALIASES for i, a in enumerate(names)], "quantity string, alias string, rank int")


def quantities(entries: DataFrame) -> DataFrame:
    """label, quantity, value, number from label, key, value, place rows: keys match by their last dotted part."""
    tail = F.lower(F.substring_index("key", ".", -1))
    named = entries.withColumn("alias", tail).join(F.broadcast(aliases(entries.sparkSession)), "alias")
    best = named.groupBy("label", "quantity").agg(F.min_by("value", F.struct("rank", "place")).alias("value"))
    return best.withColumn("number", number_in(F.col("value")))
