"""Row images: pairing the two halves of an update, and columns that an image does not hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Operation codes of change tables.
DELETE, INSERT, UPDATE_BEFORE, UPDATE_AFTER = 1, 2, 3, 4
CHANGE_OPS = {DELETE: "d", INSERT: "c", UPDATE_AFTER: "u"}


def pair_updates(changes: DataFrame, key: Sequence[str], images: Sequence[str], operation: str = "operation") -> DataFrame:
    """Change-table rows to changes: ``op``, ``serial``, and struct columns ``before`` and ``after``.

    The before and after rows of an update meet by ``key`` in one aggregate (two rows a
    group). ``orphan`` marks an update without its before row, which a reader must refuse.
    """
    image = F.struct(*images)
    at = F.col(operation)
    # an update's two rows share a group; inserts and deletes keep one each, so that a delete and an insert of one position stay apart
    group = F.when(at.isin(UPDATE_BEFORE, UPDATE_AFTER), UPDATE_AFTER).otherwise(at)
    paired = changes.groupBy(*key, group.alias("_kind")).agg(
        F.max(F.when(at.isin(DELETE, UPDATE_BEFORE), image)).alias("before"),
        F.max(F.when(at.isin(INSERT, UPDATE_AFTER), image)).alias("after"),
        F.max(F.when(at == UPDATE_AFTER, 1).otherwise(0)).alias("_whole"),
    )
    op = F.when(F.col("_kind") == DELETE, "d").when(F.col("_kind") == INSERT, "c").when(F.col("_kind") == UPDATE_AFTER, "u")
    paired = paired.filter((F.col("_kind") != UPDATE_AFTER) | (F.col("_whole") == 1))
    return paired.select(*key, op.alias("op"), F.col("_kind").cast("bigint").alias("serial"), "before", "after", ((F.col("_kind") == UPDATE_AFTER) & F.col("before").isNull()).alias("orphan"))


def fill_unavailable(after: Column, present: Column, before: Column, has_before: Column) -> tuple[Column, Column]:
    """(value, unavailable) of an after-image's column: its own value, else that of the before-image, else unavailable."""
    return F.when(present, after).when(has_before, before), ~present & ~has_before


def render(value: Column, unavailable: Column, placeholder: str) -> Column:
    """An image's column as text, with the placeholder where it is unavailable."""
    return F.when(unavailable, F.lit(placeholder)).otherwise(value.cast("string"))
