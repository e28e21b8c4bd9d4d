"""Reading the given tables and keeping intermediate ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packsift.session import settle

__all__ = ["documents", "fold", "fresh", "pick", "row_hashes", "settle", "table", "two_hashes"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*columns)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under internal names, so that no further column of the
    input can clash: ``pick(docs, id="doc_id", text="text")``."""
    return df.select(*[df[source].alias(name) for name, source in columns.items()])


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to be no column of
    ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def row_hashes(id_column: str, text_column: str) -> list[Column]:
    """Two hashes of id and text, which name a row but for its exact repetitions; a null
    text is the empty one."""
    return two_hashes(F.col(id_column), F.coalesce(F.col(text_column), F.lit("")))


def two_hashes(*values: Column) -> list[Column]:
    """Two hashes that differ independently: each value is the seed of the next one, so a number
    in front changes them, and one behind would only hash the first hash again."""
    return [F.xxhash64(*values), F.xxhash64(F.lit(1), *values)]
