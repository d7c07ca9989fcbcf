"""Who may do what in a workspace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What only an owner may do.
OWNER_ONLY = ("delete-document", "export-provenance")


def decide(requests: DataFrame, members: DataFrame, workspaces: DataFrame) -> DataFrame:
    """``requests`` (user_id, workspace_id, roles: array of the roles that may) with ``answer``: 200, 403 for users
    without such a role, 404 for workspaces that don't exist.  A member may have several roles."""
    known = workspaces.select("workspace_id", F.lit(True).alias("__known")).distinct()
    roles = members.groupBy("user_id", "workspace_id").agg(F.collect_set("role").alias("__role"))
    joined = requests.join(known, "workspace_id", "left").join(roles, ["user_id", "workspace_id"], "left")
    answer = F.when(F.col("__known").isNull(), 404).when(F.coalesce(F.arrays_overlap("roles", F.col("__role")), F.lit(False)), 200).otherwise(403)
    return joined.withColumn("answer", answer).select(*requests.columns, "answer")


def visible_graph(role: Column, asked: Column) -> Column:
    """The graph that a query runs on: an owner's choice, and the data graph for everyone else."""
    return F.when(role == "owner", F.coalesce(asked, F.lit("data"))).otherwise(F.lit("data"))


def may(role: Column, action: Column) -> Column:
    return (role == "owner") | ~action.isin(*OWNER_ONLY)
