"""Small helpers of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsift.session import checkpoint_path

# Words of the contracts: runs of anything but space, tab, LF, VT, FF and CR.
SPACE_CHARS = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once into the shared checkpoint folder and read it back.

    Used where several later steps need the same rows: the lineage is cut and a lost executor costs
    nothing but the tasks it was running.
    """
    spark = df.sparkSession
    path = checkpoint_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once a row, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def space_words(text: Column) -> Column:
    """Array of the words of a text (``[^\\x20\\x09-\\x0D]+``); null and empty texts have none."""
    parts = F.split(F.coalesce(text, F.lit("")), f"[{SPACE_CHARS}]+")
    return F.filter(parts, lambda w: w != "")
