"""Numbers for rows in a given order, without gathering them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treelens.session import cut

#: The low bits of monotonically_increasing_id: the place of a row in its partition.
IN_PARTITION = (1 << 33) - 1


def ordinals(rows: DataFrame, order: list[str | Column], name: str = "ordinal") -> DataFrame:
    """``rows`` with their number from 0 in ``order`` (nulls first): the same however the rows are dealt out.

    Rows are dealt by ranges of the order and sorted within them; a range's
    offset is the sum of the sizes of those before it (one row for each
    partition). Rows that are equal in the whole order are numbered in any
    order, so it should tell rows apart wherever it matters. What a range
    holds is written once, so that a lost executor does not deal anew.
    """
    at = F.col("_at")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = cut(dealt.withColumns({"_part": F.shiftright(at, 33), "_row": at.bitwiseAND(F.lit(IN_PARTITION))}).drop("_at"))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    return dealt.join(offsets, "_part").withColumn(name, F.col("_before") + F.col("_row")).drop("_part", "_row", "_before")


def carry_forward(rows: DataFrame, order: list[str | Column], value: str, name: str, by: str) -> DataFrame:
    """The last value that is not null at or before each row, in ``order`` within ``by``: what a section's lines stand below.

    A key (``by``) may be larger than a partition: rows are dealt by ranges of
    the key and the order, each range carries its own values forward, and what
    is still open at the beginning of a range comes from the ones before
    it (one row for each partition). Null before the first value.
    """
    full = [by, *order]
    at = F.col("_at")
    dealt = rows.repartitionByRange(*full).sortWithinPartitions(*full).withColumn("_at", F.monotonically_increasing_id())
    dealt = cut(dealt.withColumn("_part", F.shiftright(at, 33)))
    own = F.last(value, ignorenulls=True).over(Window.partitionBy("_part", by).orderBy("_at"))
    # of a range only its last key can go on in the next one
    ends = dealt.groupBy("_part").agg(F.max_by(F.col(by), "_at").alias("_key"), F.max_by(F.col(by), F.when(F.col(value).isNotNull(), at)).alias("_set_key"), F.max_by(F.col(value), F.when(F.col(value).isNotNull(), at)).alias("_set"))
    ends = ends.select("_part", F.col("_key"), F.when(F.col("_key") == F.col("_set_key"), F.col("_set")).alias("_set"))
    # a key that goes on over several ranges: the last of them that set a value
    goes_on = Window.partitionBy("_key").orderBy("_part")
    open_ = ends.select("_part", "_key", F.last("_set", ignorenulls=True).over(goes_on).alias("_open"))
    # ranges without a row end nothing; the next one that has rows takes over
    parts = ends.select("_part").withColumn("_prior", F.lag("_part").over(Window.orderBy("_part")))
    before = parts.join(open_.withColumnsRenamed({"_part": "_prior"}), "_prior").select("_part", F.col("_key").alias(by), "_open")
    out = dealt.withColumn("_own", own).join(before, ["_part", by], "left")
    return out.withColumn(name, F.coalesce("_own", "_open")).drop("_part", "_at", "_own", "_open")
