"""Facts rolled up to dimension attributes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Columns that operators add; dimensions and facts have none of these names.
COPIES, VALUE, SEEN = "copies__", "value__", "seen__"


@dataclass(frozen=True)
class Metric:
    """A fact metric by SQL expression: ``count`` or ``sum`` of it, or its ``distinct`` count.

    Counts and sums add up over partial groups; distinct counts do not.
    """

    name: str
    kind: str
    expression: str

    def over_rows(self) -> Column:
        inner = f"distinct {self.expression}" if self.kind == "distinct" else self.expression
        function = "sum" if self.kind == "sum" else "count"
        return F.expr(f"{function}({inner}) as {self.name}")

    def over_partials(self, copies: str = "1") -> Column:
        """From partial groups, each standing for ``copies`` groups like it."""
        if self.kind == "distinct":
            return self.over_rows()
        total = f"sum({self.name})" if copies == "1" else f"sum({self.name} * {copies})"
        if self.kind == "count":
            total = f"coalesce({total}, 0)"
        return F.expr(f"{total} as {self.name}")


def by_attributes(fact: DataFrame, by: Sequence[str], metrics: Sequence[Metric]) -> DataFrame:
    """Metrics per combination of the fact's own attributes; the combinations if none."""
    if not metrics:
        return fact.select(*by).distinct()
    return fact.groupBy(*by).agg(*[m.over_rows() for m in metrics])


def by_dimension(
    fact: DataFrame,
    dim: DataFrame,
    key: str,
    by: Sequence[str],
    metrics: Sequence[Metric],
    how: str = "inner",
    members: Metric | None = None,
) -> DataFrame:
    """Metrics per combination of dimension attributes.

    ``how="inner"`` drops facts without a member; ``how="left"`` keeps members without
    facts. ``members`` counts the members themselves.

    Facts are summed before the join, so however they are spread over keys, one row per
    key is joined. Distinct counts have a way of their own, ``_distinct``.
    """
    if any(m.kind == "distinct" for m in metrics):
        return _distinct(fact, dim, key, by, metrics, how, members)
    facts = by_attributes(fact, [key], metrics)
    attributes = dim.select(*dict.fromkeys([key, *by]))
    totals = [m.over_partials() for m in metrics]
    if members:
        totals.insert(0, members.over_rows())
    if how == "left":
        joined = attributes.join(facts, key, "left")  # a row per key
    else:
        joined = facts.join(attributes, key)
    return joined.groupBy(*by).agg(*totals)


def by_groupings(
    fact: DataFrame,
    dim: DataFrame,
    key: str,
    groupings: Mapping[str, Sequence[str]],
    metrics: Sequence[Metric],
    members: Metric,
    active: str,
    label: str = "grouping",
) -> DataFrame:
    """``by_dimension`` for several groupings of one dimension at once, from one scan of the fact.

    Rows are led by the grouping's name, then every attribute, NULL where the grouping has
    none. All members are counted, and under the name ``active`` those with facts. The fact is
    reduced to a row per key, which holds what adds up; grouping sets roll these rows up. What
    does not add up over keys (a distinct count) cannot come from them: then each grouping
    is calculated on its own.
    """
    columns = list(dict.fromkeys(c for by in groupings.values() for c in by))
    found = Metric(active, "count", f"case when {SEEN} then {key} end")
    kinds = {c: dim.schema[c].dataType for c in columns}
    if any(m.kind == "distinct" for m in [*metrics, members]):
        parts = []
        for name, by in groupings.items():
            own = by_dimension(fact, dim, key, by, metrics, "left", members)
            having = by_dimension(fact, dim, key, by, [], "inner", replace(members, name=active))
            renamed = having.select(*(F.col(c).alias(f"of_{i}") for i, c in enumerate(by)), active)
            same = [F.col(c).eqNullSafe(F.col(f"of_{i}")) for i, c in enumerate(by)]
            count = F.coalesce(F.col(active), F.lit(0)).alias(active)
            attributes = [
                F.col(c) if c in by else F.lit(None).cast(kinds[c]).alias(c) for c in columns
            ]
            totals = [members.name, count, *(m.name for m in metrics)]
            parts.append(
                own.join(renamed, same, "left").select(F.lit(name).alias(label), *attributes, *totals)
            )
        return reduce(DataFrame.unionByName, parts)
    facts = by_attributes(fact, [key], metrics).withColumn(SEEN, F.lit(True))
    joined = dim.select(*dict.fromkeys([key, *columns])).join(facts, key, "left")
    totals = [members.over_rows(), found.over_rows(), *(m.over_partials() for m in metrics)]
    sets = [[F.col(c) for c in by] for by in groupings.values()]
    rolled = joined.groupingSets(sets, *columns).agg(F.grouping_id().alias(SEEN), *totals)
    # A set's id has a bit for each column it leaves out, the first column's the highest.
    named = F.lit(None).cast("string")
    for name, by in groupings.items():
        bits = sum(1 << i for i, c in enumerate(reversed(columns)) if c not in by)
        named = F.when(F.col(SEEN) == bits, name).otherwise(named)
    return rolled.select(named.alias(label), *columns, members.name, active, *(m.name for m in metrics))


def _distinct(
    fact: DataFrame,
    dim: DataFrame,
    key: str,
    by: Sequence[str],
    metrics: Sequence[Metric],
    how: str,
    members: Metric | None,
) -> DataFrame:
    """``by_dimension`` with distinct counts, each from groupings of its own.

    A distinct count is the number of rows after grouping by group and value: no row is
    copied per count. Facts are grouped by value and key first. Where they are bucketed by
    the value, all rows of a value lie in one task, so neither that grouping nor, if
    the members are few enough to be broadcast, the one by group and value moves a fact.
    Members alike in every attribute are joined once and weighted by their number: a key
    repeated on both sides never pairs each fact with each copy of the member. Facts are
    the left side of an inner join, which adaptive execution can split where a key has many.
    Members are counted without the facts, but for which keys these have at all.
    """
    attributes = dim.groupBy(*dict.fromkeys([key, *by])).agg(F.count("*").alias(COPIES))
    distinct = [m for m in metrics if m.kind == "distinct"]
    others = [m for m in metrics if m.kind != "distinct"]
    branches = []
    for i, metric in enumerate(distinct):
        sums = others if i == 0 else []  # once are enough
        values = fact.withColumn(VALUE, F.expr(metric.expression))
        facts = by_attributes(values, [VALUE, key], sums)
        joined = facts.join(attributes, key)
        totals = [m.over_partials(COPIES) for m in sums] or [F.lit(None).alias("none_")]
        per_value = joined.groupBy(*by, VALUE).agg(*totals)
        counted = F.count(VALUE).alias(metric.name)
        again = [F.sum(m.name).alias(m.name) for m in sums]
        branches.append(per_value.groupBy(*by).agg(counted, *again))
    if members:
        seen = attributes
        if how != "left":
            seen = attributes.join(fact.select(key).distinct(), key, "left_semi")
        branches.append(seen.groupBy(*by).agg(F.count(key).alias(members.name)))
    elif how == "left":
        branches.append(attributes.select(*by).distinct())
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), branches)
    named = ([members] if members else []) + list(metrics)
    totals = [
        F.sum(m.name).alias(m.name)
        if m.kind == "sum"
        else F.coalesce(F.sum(m.name), F.lit(0)).alias(m.name)
        for m in named
    ]
    return every.groupBy(*by).agg(*totals)
