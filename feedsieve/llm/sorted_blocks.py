"""Positions and running values in groups that may hold most of a table.

A window over a group runs in one task.  Here the table is sorted by ranges first, and
each range is a block: a group that is too large for a task then lies in several blocks,
in order.  Values are worked out per (block, group), and what the earlier blocks of a
group add up to, one row per (block, group), is added to them.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import write_shared

BLOCK, ROW = "_block", "_row"


def sorted_blocks(df, order, name):
    """``df`` sorted and written, with ``_block`` and ``_row``, which rise with the order.

    Rows that are equal in the order are kept apart by where they were read, so that
    they can fall into several blocks.
    """
    tie = F.monotonically_increasing_id()
    placed = df.withColumn("_tie", tie).orderBy(*order, "_tie").drop("_tie")
    placed = placed.withColumn(BLOCK, F.spark_partition_id())
    return write_shared(placed.withColumn(ROW, F.monotonically_increasing_id()), name)


def inside(group):
    """Window over the rows of a group in a block."""
    return Window.partitionBy(BLOCK, group).orderBy(ROW)


def before(group):
    """Window over the earlier blocks of a group, for a table of one row per (block, group)."""
    return Window.partitionBy(group).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
