"""Data-quality checks: null, uniqueness, format, range and orphan checks of a table, and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"


def failing(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """check, failed, total: all row-wise checks of a table in one pass. A check counts rows where its expression holds; null does not."""
    row = df.agg(F.count("*").alias("_total"), *[F.count_if(c).alias(name) for name, c in checks.items()])
    return row.unpivot("_total", [F.col(f"`{c}`") for c in checks], "check", "failed").select("check", "failed", F.col("_total").alias("total"))


def duplicates(df: DataFrame, column: str) -> DataFrame:
    """value and rows of the values that occur more than once."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("rows")).where("rows > 1")


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Rows whose key has no parent; null keys are no orphans."""
    return child.where(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")


def scores(checks: DataFrame) -> DataFrame:
    """section, passed, total, score from (section, failed): 100 for a section without checks is left to the caller."""
    return checks.groupBy("section").agg(F.count_if(F.col("failed") == 0).alias("passed"), F.count("*").alias("checks")).withColumn("score", F.col("passed") / F.col("checks") * 100)


def allowed(users: DataFrame, role_permissions: DataFrame, permission: str, condition: Column | None = None) -> DataFrame:
    """user_id, allowed: a user who is enabled and has the permission by a role or personally, where the condition, if any, holds.

    users: user_id, enabled, roles, permissions (arrays). role_permissions: role, permission; whether it is broadcast is left to Spark's size check.
    """
    granting = role_permissions.where(F.col("permission") == permission).select("role").distinct()
    by_role = users.select("user_id", F.explode("roles").alias("role")).join(granting, "role", "left_semi").select("user_id").distinct().withColumn("_role", F.lit(True))
    own = F.array_contains(F.coalesce("permissions", F.array().cast("array<string>")), permission)
    holds = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
    return users.join(by_role, "user_id", "left").select("user_id", (F.coalesce("enabled", F.lit(False)) & (F.coalesce("_role", F.lit(False)) | own) & holds).alias("allowed"))


def worst_status(df: DataFrame, keys: list[str], status: str) -> DataFrame:
    """keys, status: unhealthy before degraded before healthy before anything else."""
    rank = F.when(F.col(status) == "unhealthy", 3).when(F.col(status) == "degraded", 2).when(F.col(status) == "healthy", 1).otherwise(0)
    worst = F.max(rank)
    return df.groupBy(*keys).agg(F.element_at(F.array(*map(F.lit, ("unknown", "healthy", "degraded", "unhealthy"))), worst + 1).alias("status"))


def grade(score: Column) -> Column:
    """A to F by tens from 90."""
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def security_points(high: Column, vulnerable: Column, frontend: Column) -> Column:
    """Points of 100: 40 for no serious finding in code, 20 for none in dependencies, 40 for none in the front end."""
    code = F.when(high == 0, 40).when(high == 1, 30).otherwise(0)
    packages = F.when(vulnerable == 0, 20).when(vulnerable == 1, 15).when(vulnerable == 2, 10).otherwise(5)
    return code + packages + F.when(frontend == 0, 40).when(frontend == 1, 20).when(frontend == 2, 10).otherwise(0)
