"""Column expressions shared by the operators."""

from goldpan.functions.calendar import month_boundaries, year_month
from goldpan.functions.exact import half_up, mean, percent
from goldpan.functions.person import age, age_group, full_name
from goldpan.functions.shape import result_types

__all__ = [
    "age",
    "age_group",
    "full_name",
    "half_up",
    "mean",
    "month_boundaries",
    "percent",
    "result_types",
    "year_month",
]
