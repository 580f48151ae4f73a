"""Exactly-once delivery: keep the first delivery of every message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pieces into which the rows of one identifier are cut before they are ranked.
SALTS = 64


def uuid_key(col: Column | str) -> Column:
    """The 16 bytes of a UUID however it is written, else null.

    Case, hyphens, braces, blanks and a ``urn:uuid:`` prefix do not matter.
    Null, empty, malformed and the nil UUID give null.
    """
    c = F.col(col) if isinstance(col, str) else col
    bare = F.regexp_replace(F.lower(c), r"[\s ​﻿{}()\[\]\"'-]", "")
    bare = F.regexp_replace(bare, r"^(urn:)?(uuid:)?", "")
    ok = bare.rlike("^[0-9a-f]{32}$") & (bare != "0" * 32)
    return F.when(ok, F.unhex(bare))


def repeated_deliveries(df: DataFrame, key: Column, order: list[str], keep: list[str]) -> DataFrame:
    """Rows whose key came before, by ``order`` (which must be a total order).

    Ranking is done in two steps so that no key is too hot: first within
    (key, salt) pieces, where every row but the first is a repeat for sure,
    then among the at most ``SALTS`` first rows of each key. Rows with a null
    key are never repeats.
    """
    salt = F.pmod(F.xxhash64(*order), F.lit(SALTS)).cast("int")
    cols = list(dict.fromkeys([*keep, *order]))
    rows = df.select(*cols, key.alias("__k"), salt.alias("__s")).filter(F.col("__k").isNotNull())
    first = Window.partitionBy("__k", "__s").orderBy(*order)
    rows = rows.withColumn("__r", F.row_number().over(first))
    again = Window.partitionBy("__k").orderBy(*order)
    heads = rows.filter("__r = 1").withColumn("__r2", F.row_number().over(again)).filter("__r2 > 1")
    return rows.filter("__r > 1").select(*keep).unionByName(heads.select(*keep))


def first_deliveries(df: DataFrame, key: Column, order: list[str], id_col: str) -> DataFrame:
    """One row per message: ``df`` without its repeated deliveries.

    Rows with a null key cannot be told to be repeats and all stay.
    ``id_col`` is unique per row; the anti-join on it is free of skew.
    """
    return df.join(repeated_deliveries(df, key, order, [id_col]), id_col, "left_anti")


def admit_batch(batch: DataFrame, stored_keys: DataFrame, key: Column, order: list[str], id_col: str) -> DataFrame:
    """Rows of a new batch to append: first of their key in it and not stored yet.

    ``stored_keys`` has one binary column ``key``. After the ranking a key has
    one row in the batch, so the anti-join sees no hot key.
    """
    fresh = first_deliveries(batch, key, order, id_col).withColumn("__k", key)
    stored = stored_keys.select(F.col("key").alias("__k")).filter(F.col("__k").isNotNull())
    return fresh.join(stored, "__k", "left_anti").drop("__k")


def instant(col: Column | str) -> Column:
    """ISO-8601 text with any offset as a UTC timestamp; unreadable gives null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.try_to_timestamp(F.trim(c))
