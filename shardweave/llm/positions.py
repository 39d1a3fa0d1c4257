"""Positions of rows in an order, without one task for all rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardweave.llm.shared import stored


def with_positions(df: DataFrame, key: str, order: list[Column], label: str) -> DataFrame:
    """The rows with ``pos`` (from 0 within ``key``, along ``order``) and ``size`` (rows of the key).

    Range partitions of (key, order) are sorted and numbered once, in a stored table; a small table with one
    row for each key of a partition then says how many rows of the key lie in partitions before it.  A hot key
    spans many partitions.  Rows that are equal in everything but place are told apart by their place in the
    input, so even a row that makes up a third of the table is dealt to several tasks.
    """
    by = [F.col(key).asc_nulls_first(), *order, F.col("__tie").asc()]
    ranged = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    rows = stored(ranged.drop("__tie").withColumn("__at", F.monotonically_increasing_id()), label)
    part = F.shiftright("__at", 33)
    counts = rows.groupBy(F.col(key).alias("__key"), part.alias("__part")).agg(
        F.min("__at").alias("__low"), F.count(F.lit(1)).alias("__rows")
    )
    whole = Window.partitionBy("__key")
    earlier = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "__key", "__part",
        (F.coalesce(F.sum("__rows").over(earlier), F.lit(0)) - F.col("__low")).alias("__shift"),
        F.sum("__rows").over(whole).alias("size"),
    )
    joined = rows.join(starts, F.col(key).eqNullSafe(F.col("__key")) & (part == F.col("__part")))
    return joined.select(*df.columns, (F.col("__at") + F.col("__shift")).alias("pos"), "size")
