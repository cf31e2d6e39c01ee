"""Data-quality operators: each returns the rows or counts that break a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_counts(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """One row for each column with its nulls, all counted in one pass."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in columns])).alias("r")).select("r.*")


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that stand more than once; keys with a null are left out."""
    present = F.lit(True)
    for c in key:
        present = present & F.col(c).isNotNull()
    return df.filter(present).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows of the child whose value, if there is one, is missing in the parent."""
    known = parent.select(F.col(key).alias("__known")).distinct()
    return child.filter(F.col(column).isNotNull()).join(known, F.col(column) == F.col("__known"), "left_anti")


def set_diff(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that stand on one side alone, with the side."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    only = lambda x, y, side: x.join(y, key, "left_anti").withColumn("side", F.lit(side))
    return only(a, b, "left").unionByName(only(b, a, "right"))


def row_rules(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(right rows, rejected rows with the names of the rules that they break), from one pass over each."""
    broken = F.array_compact(F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()]))
    judged = df.withColumn("broken", broken if rules else F.array().cast("array<string>"))
    return judged.filter(F.size("broken") == 0).drop("broken"), judged.filter(F.size("broken") > 0)


def rule_counts(df: DataFrame, rules: dict[str, Column], name: str) -> DataFrame:
    """One row for each rule with the number of rows that break it."""
    counted = df.agg(*[F.count_if(~rule).alias(rule_name) for rule_name, rule in rules.items()])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(name).alias("table_name"), F.lit(r).alias("rule"), F.col(r).alias("violations")) for r in rules])).alias("r")).select("r.*")


def reconcile_totals(left: DataFrame, right: DataFrame, measures: dict[str, tuple[str, str]], name: str, tolerance: float = 0.0) -> DataFrame:
    """One row for each measure: both totals, and whether they agree."""
    a = left.agg(*[F.sum(x).cast("double").alias(f"a_{m}") for m, (x, _) in measures.items()])
    b = right.agg(*[F.sum(y).cast("double").alias(f"b_{m}") for m, (_, y) in measures.items()])
    rows = [
        F.struct(F.lit(f"{name}.{m}").alias("check_name"), F.col(f"a_{m}").alias("left_total"), F.col(f"b_{m}").alias("right_total"), (F.abs(F.col(f"a_{m}") - F.col(f"b_{m}")) <= tolerance).alias("agrees"))
        for m in measures
    ]
    return a.join(F.broadcast(b)).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def not_one_current(versions: DataFrame, key: str) -> DataFrame:
    """Keys with no or several current versions."""
    return versions.groupBy(key).agg(F.count_if("is_current").alias("current_versions")).filter("current_versions <> 1")


def date_gaps(days: DataFrame, date: str) -> DataFrame:
    """Days whose predecessor is not the day before; for a calendar."""
    before = F.lag(date).over(Window.orderBy(date))
    return days.withColumn("before", before).filter(F.datediff(date, "before") > 1).select(date, "before")
