"""Column-expression helpers (dates, ratios, conditional counts)."""

from tillroll.functions.exprs import (  # noqa: F401
    as_double, ci_equals, count_when, days_between, is_weekend, mean, month_name, percent, ratio, sum_when,
)
