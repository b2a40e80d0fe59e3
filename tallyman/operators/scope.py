"""Row scope: which rows each user may see.

An admin sees every row, an attendant only their own branch's. Unlike the
reference (where an absent branch argument lets everything through), the
scope is always applied.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Tables = Mapping[str, DataFrame]


def visible_rows(rows: DataFrame, role: str, branch_id: int | None, branch_col: str = "branch_id") -> DataFrame:
    """The rows one user may see: a filter that reaches the scan. An attendant
    without a branch sees nothing."""
    if role == "admin":
        return rows
    return rows.where(F.col(branch_col) == F.lit(branch_id).cast("bigint"))


def row_audience(users: DataFrame, rows: DataFrame, row_id: str = "id", branch_col: str = "branch_id") -> DataFrame:
    """Who may see each row, one row for each: how many attendants of its branch and
    the first of them (NULL if none), and whether there is an admin, who sees all."""
    staff = (users.where((F.col("role") == "attendant") & F.col("branch_id").isNotNull()).groupBy(F.col("branch_id").alias(branch_col))
             .agg(F.count(F.lit(1)).alias("n_attendants"), F.min("id").alias("first_attendant_id")))
    has_admin = users.where(F.col("role") == "admin").agg(F.count(F.lit(1)) > 0).scalar()  # one boolean
    return (rows.select(F.col(row_id).alias("row_id"), branch_col).join(staff, branch_col, "left")
            .select("row_id", branch_col, F.coalesce("n_attendants", F.lit(0)).alias("n_attendants"), "first_attendant_id",
                    has_admin.alias("admin_sees")))


def branch_scope(t: Tables) -> DataFrame:
    """X1 over sales: the audience of every sale."""
    return row_audience(t["users"], t["sales"])
