"""Customer segmentation: percentile (A16, A17) and RFM (A18), on the global rankings of
:mod:`tillroll.operators.ranking` (no single-partition window).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.exprs import days_between
from tillroll.operators.ranking import Key, global_ntile, percentile_above

# Percentile thresholds (strictly above) and segment names of the reference.
REVENUE_SEGMENTS = [(90, "Premium"), (70, "Gold"), (40, "Silver")]
REVENUE_DEFAULT = "Standard"
PROFIT_SEGMENTS = [(90, "Platinum"), (70, "Gold"), (40, "Silver")]
PROFIT_DEFAULT = "Bronze"
# RFM: total score at least …
RFM_SEGMENTS = [(11, "Premium"), (10, "Gold"), (9, "Silver")]
RFM_DEFAULT = "Bronze"


def _case(conditions: list[Column], names: list[str], default: str) -> Column:
    """The name of the first condition that holds."""
    return F.coalesce(*[F.when(c, n) for c, n in zip(conditions, names)], F.lit(default))


def percentile_segments(c360: DataFrame, measure: str, bands, default: str, count_name: str, sum_name: str,
                        num_partitions: int | None = None) -> DataFrame:
    """Segment customers by ``PERCENT_RANK() OVER (ORDER BY measure) * 100`` and sum per segment."""
    df = c360.select("customer_id", measure)
    above = percentile_above(df, Key(measure), [t for t, _ in bands], ["customer_id"], num_partitions)
    return (df.withColumn("segment", _case(above, [n for _, n in bands], default))
            .groupBy("segment")
            .agg(F.count(F.lit(1)).alias(count_name), F.sum(measure).alias(sum_name))
            .orderBy(F.col(sum_name).desc(), "segment"))


def revenue_segments(c360: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """A16 — Premium / Gold / Silver / Standard by revenue percentile."""
    return percentile_segments(c360, "total_revenue", REVENUE_SEGMENTS, REVENUE_DEFAULT,
                               "no_of_customers", "total_revenue", num_partitions)


def profit_segments(c360: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """A17 — Platinum / Gold / Silver / Bronze by profit percentile."""
    return percentile_segments(c360, "profit", PROFIT_SEGMENTS, PROFIT_DEFAULT,
                               "no_of_customers", "total_profit", num_partitions)


def rfm_base(fact: DataFrame) -> DataFrame:
    """Recency (days from the customer's last purchase to the last purchase of all), frequency
    (distinct orders) and monetary value (revenue) per customer."""
    last = fact.select(F.max("bill_date_timestamp")).scalar()
    return fact.groupBy("customer_id").agg(
        days_between(F.max("bill_date_timestamp"), last).alias("recency"),
        F.countDistinct("order_id").alias("frequency"),
        F.sum("total_amount").alias("monetary"),
    )


def rfm_scores(base: DataFrame, corrected: bool = False, num_partitions: int | None = None) -> DataFrame:
    """Per customer of :func:`rfm_base`: recency, frequency, monetary, their NTILE(4) scores and the
    total. The base is read once for each ranking and once for the result: give a written one.

    Faithful: tile 1 = most recent / most frequent / highest spend, yet the total is read as
    "higher is better". ``corrected=True`` scores 5 − tile so that the best
    quartile scores 4.
    """
    scores = {"recency_score": Key("recency"), "frequency_score": Key("frequency", ascending=False),
              "monetary_score": Key("monetary", ascending=False)}
    df = base
    for score, key in scores.items():
        df = global_ntile(df, 4, [key, Key("customer_id")], score, num_partitions)
        if corrected:
            df = df.withColumn(score, 5 - F.col(score))
    return df.withColumn("total_rfm_score", sum((F.col(c) for c in scores), F.lit(0)))


def rfm_segments(base: DataFrame, corrected: bool = False, num_partitions: int | None = None) -> DataFrame:
    """A18 — customers and revenue per RFM segment (total score ≥ 11 Premium, ≥ 10 Gold,
    ≥ 9 Silver, else Bronze), of :func:`rfm_base`."""
    score = F.col("total_rfm_score")
    seg = _case([score >= t for t, _ in RFM_SEGMENTS], [n for _, n in RFM_SEGMENTS], RFM_DEFAULT)
    return (rfm_scores(base, corrected, num_partitions)
            .withColumn("segment", seg)
            .groupBy("segment")
            .agg(F.count(F.lit(1)).alias("customer_count"), F.sum("monetary").alias("total_revenue"))
            .orderBy(F.col("total_revenue").desc(), "segment"))
