"""Row visibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: table -> (owner's column, whether approved rows are public, operations that owners have); others see no rows.
POLICIES = {
    "profiles": ("id", False, {"select", "insert", "update"}),
    "favorites": ("user_id", False, {"select", "insert", "delete"}),
    "community_orgs": ("submitted_by", True, {"select", "insert"}),
    "community_categories": ("user_id", True, {"select", "insert"}),
    "job_cache": (None, True, {"select"}),
    "cv_uploads": ("user_id", False, {"select", "insert", "update", "delete"}),
    "search_logs": ("user_id", False, {"insert"}),
}


def visible_if(table: str, uid: Column, operation: str = "select") -> Column:
    """The condition under which ``uid`` may do ``operation`` with a row; unknown (null) counts as no."""
    owner, public, allowed = POLICIES[table]
    if operation not in allowed:
        return F.lit(False)
    if owner is None:
        return F.lit(True)
    own = F.col(owner) == uid
    if table == "search_logs":
        own = own | F.col(owner).isNull()
    if public and operation == "select":
        own = (F.col("approved") == F.lit(True)) | own
    return F.coalesce(own, F.lit(False))


def visible(df: DataFrame, table: str, uid: str | None, operation: str = "select") -> DataFrame:
    return df.filter(visible_if(table, F.lit(uid).cast("string"), operation))
