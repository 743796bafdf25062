"""Aggregates of evaluation runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def judge_summary(records: DataFrame) -> DataFrame:
    """Correct answers per category and in all (null category): category, total, correct, score (percent, two decimals)."""
    g = records.groupingSets([[F.col("category")], []], "category").agg(F.count("*").alias("total"), F.count_if("correct").alias("correct"))
    return g.withColumn("score", F.round(F.coalesce(F.try_divide(100.0 * F.col("correct"), F.col("total")), F.lit(0.0)), 2))


def answer_stats(records: DataFrame) -> DataFrame:
    """Tri-state grades: category, n_correct, n_wrong, n_none, accuracy (of the graded), share (of all), mean_time, tokens."""
    right, wrong = F.count_if(F.col("correct")), F.count_if(~F.col("correct"))
    return records.groupBy("category").agg(
        right.alias("n_correct"),
        wrong.alias("n_wrong"),
        F.count_if(F.col("correct").isNull()).alias("n_none"),
        F.round(F.coalesce(F.try_divide(right, right + wrong), F.lit(0.0)), 6).alias("accuracy"),
        F.round(right / F.count("*"), 6).alias("share"),
        F.round(F.avg("seconds"), 6).alias("mean_time"),
        F.sum("tokens").alias("tokens"),
    )
