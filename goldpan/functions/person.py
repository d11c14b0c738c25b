"""Derived columns of a person."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

# The age groups by their first age.
AGE_GROUPS = {20: "20-29", 30: "30-39", 40: "40-49", 50: "50-59", 60: "60+"}
YOUNGEST, UNKNOWN = "Under 20", "Unknown"


def full_name(first: Column, last: Column) -> Column:
    """Both names with a space between; the one that is known, NULL if neither is."""
    name = F.concat_ws(" ", first, last)
    return F.when(first.isNull() & last.isNull(), None).otherwise(name)


def age(birthdate: Column, as_of: date) -> Column:
    """Completed years at a fixed date; NULL for those not yet born then.

    A birthday on 29 February is reached on 1 March of other years.
    """
    day = F.lit(as_of)
    turned = (F.month(birthdate) * 100 + F.dayofmonth(birthdate)) <= as_of.month * 100 + as_of.day
    years = F.lit(as_of.year) - F.year(birthdate) - F.when(turned, 0).otherwise(1)
    return F.when(birthdate <= day, years.cast("int"))


def age_group(years: Column) -> Column:
    """The ten-year band of an age; 'Unknown' for NULL."""
    band = F.when(years.isNull(), UNKNOWN).when(years < min(AGE_GROUPS), YOUNGEST)
    starts = sorted(AGE_GROUPS)
    for first, following in zip(starts, starts[1:]):
        band = band.when(years < following, AGE_GROUPS[first])
    return band.otherwise(AGE_GROUPS[starts[-1]])
