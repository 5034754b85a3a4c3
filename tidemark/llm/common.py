"""Words, stored tables and attribute access shared by the operators of this subpackage."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_dir

#: The white space that separates words, as a class for Java and for DuckDB patterns.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

# What str.split() takes for white space although it belongs to a word here.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_ASCII_ODD = re.compile("[\x1c-\x1f]")
_WORD = re.compile("[^\x20\x09-\x0d]+")


def words_of(text: str | None) -> list[str]:
    """Words of a whole text in Python; the same words as ``WORD`` finds."""
    if not text:
        return []
    if (_ASCII_ODD if text.isascii() else _ODD).search(text):
        return _WORD.findall(text)
    return text.split()


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Later jobs reread the files, so the plan below is computed once, and a lost executor costs no more
    than its own tasks. Row numbers made below are settled by the write.
    """
    spark = df.sparkSession
    path = stored_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def uniform(key: Column, *salt: object) -> Column:
    """A number in (0, 1) that depends on the key and the salt alone: 52 bits of an MD5 digest."""
    text = F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("null")), *[F.lit(str(s)) for s in salt])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(2**52))


def fold(key: Column) -> Column:
    """crc32 of the key as text, modulo 4; rows of remainder 2 are held out from training."""
    return F.crc32(key.cast("string").cast("binary")) % 4


#: Rows up to which a table of ids is broadcast, some tens of MB; larger ones are joined by shuffle.
SMALL = 300_000


def sized(ids: DataFrame) -> DataFrame:
    """Hint a broadcast of a stored table of ids if its counted rows allow it."""
    return F.broadcast(ids) if ids.count() <= SMALL else ids
