"""Two-dimensional as-of lookup: the nearest earlier position that also arrived earlier.

For a row at position ``p`` that arrived at ``a`` it finds, under the same key, the largest
position below ``p`` whose row arrived before ``a``. A window can't tell, since the two
orders differ, and a fold over a key runs on one core. Here positions form a fixed tree
of ``2^BITS`` children a node; a node lists its children with the earliest arrival below
each. A row climbs until some earlier sibling of its branch has an earlier arrival, and
descends from there, to the last child that has one, down to a position. Each step is
an equi-join on (key, node), so a key's rows spread over as many tasks as it has nodes,
and nothing holds more than ``2^BITS`` entries at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyman.session import written

#: Children of a node, as a power of two.
BITS = 5


def _last_before(arrival: str, below: Column | None = None) -> Column:
    """The last listed child that began before the row's arrival (and lies below ``below``)."""

    def fits(child: Column) -> Column:
        earlier = child["arrival"] < F.col(arrival)
        return earlier if below is None else earlier & (child["at"] < below)

    return F.try_element_at(F.filter("_children", fits), F.lit(-1))["at"]


def earlier_in_both(rows: DataFrame, by: Sequence[str], position: str, arrival: str, out: str) -> DataFrame:
    """Add ``out``: the position found, or NULL. ``position`` is an integer, unique within
    ``by`` (whose columns aren't null); ``arrival`` is any comparable column."""
    by = list(by)
    rows = written(rows, "asof-rows")  # read by every level
    low, high = (x or 0 for x in rows.agg(F.min(position), F.max(position)).first())
    place = F.col(position).cast("bigint") - low  # from 0, so that one node lies above all
    levels = max(1, -(-(high - low).bit_length() // BITS))
    nodes, children = [], rows.select(*by, place.alias("at"), F.col(arrival).alias("arrival"))
    for _ in range(levels):
        node = children.groupBy(*by, F.shiftright("at", BITS).alias("_node")).agg(
            F.array_sort(F.collect_list(F.struct("at", "arrival"))).alias("_children"), F.min("arrival").alias("arrival"))
        nodes.append(node.select(*by, "_node", "_children"))
        children = node.select(*by, F.col("_node").alias("at"), "arrival")

    def met(d: DataFrame, node: Column, level: int) -> DataFrame:
        return d.withColumn("_node", node).join(nodes[level], [*by, "_node"], "left")

    own = lambda level: F.shiftright(place, BITS * level)
    d = rows.withColumn("_level", F.lit(None).cast("int")).withColumn("_at", F.lit(None).cast("bigint"))
    for level in range(levels):
        d = met(d, own(level + 1), level)
        found = F.when(F.col("_level").isNull(), _last_before(arrival, own(level)))
        d = d.withColumn("_found", found).withColumn("_level", F.when(F.col("_found").isNotNull(), F.lit(level)).otherwise(F.col("_level")))
        d = d.withColumn("_at", F.coalesce("_at", "_found")).drop("_found", "_children", "_node")
    for level in range(levels - 1, 0, -1):
        here = F.col("_level") == level
        d = met(d, F.when(here, F.col("_at")).otherwise(own(level)), level - 1)  # others meet their own node, unused
        d = d.withColumn("_at", F.when(here, _last_before(arrival)).otherwise(F.col("_at"))).withColumn("_level", F.when(here, F.lit(level - 1)).otherwise(F.col("_level")))
        d = d.drop("_children", "_node")
    return d.select(*rows.columns, (F.col("_at") + low).alias(out))
