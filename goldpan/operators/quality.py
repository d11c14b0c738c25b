"""Quality checks: keys, references, coverage, sanity, and the gate over them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldpan.functions import month_boundaries, year_month


def orphans(
    fact: DataFrame, key: str, dim: DataFrame, dim_key: str, name: str, unique: bool = False
) -> DataFrame:
    """Fact rows whose key has no match; a NULL key is an orphan.

    Fact rows are counted per key first, so the anti-join sees each key once and a
    key holding a third of the rows costs no more than any other. The keys looked up
    are made distinct too, unless ``unique`` says they are.
    """
    per_key = fact.groupBy(F.col(key).alias("fk")).agg(F.count(F.lit(1)).alias("n"))
    keys = dim.select(F.col(dim_key).alias("pk"))
    keys = keys if unique else keys.distinct()
    lost = per_key.join(keys, per_key.fk == keys.pk, "left_anti")
    return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias(name))


def orphans_alike(
    fact: DataFrame, key: str, dim: DataFrame, dim_key: str, name: str, collation: str
) -> DataFrame:
    """``orphans`` of text keys that need only compare equal under a collation.

    Spellings are made distinct on either side before keys are compared, so the collation is
    applied once per spelling, not once per row.
    """
    per_key = fact.groupBy(quoted(key).alias("fk")).agg(F.count(F.lit(1)).alias("n"))
    known = dim.select(quoted(dim_key).alias("pk")).distinct()
    alike = per_key.select(F.collate("fk", collation).alias("fk"), "n").groupBy("fk").agg(F.sum("n").alias("n"))
    keys = known.select(F.collate("pk", collation).alias("pk")).distinct()
    lost = alike.join(keys, alike.fk == keys.pk, "left_anti")
    return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias(name))


def references(
    fact: DataFrame, checks: Mapping[str, tuple[str, DataFrame, str]]
) -> DataFrame:
    """One row: fact rows without a match, per reference, from one scan of the fact.

    ``checks`` names a reference and gives the fact's key, the dimension and its key. A NULL
    key is an orphan. Each row becomes a row per reference, counted per key before anything is
    shuffled; then the different keys of all references meet those of all dimensions in
    one anti-join, where a key that holds a third of the rows is one row.
    """
    kinds = {n: fact.select(quoted(key)).schema[0].dataType for n, (key, _, _) in checks.items()}
    # Keys of one type are compared as they are, others as texts.
    text = len({kind.simpleString() for kind in kinds.values()}) > 1
    cast = "string" if text else next(iter(kinds.values())).simpleString()
    pairs = [
        F.struct(F.lit(i).alias("which_"), quoted(key).cast(cast).alias("fk_"))
        for i, (key, _, _) in enumerate(checks.values())
    ]
    per_key = (
        fact.select(F.inline(F.array(*pairs)))
        .groupBy("which_", "fk_")
        .agg(F.count(F.lit(1)).alias("n_"))
    )
    keys = []
    for i, (name, (_, dim, dim_key)) in enumerate(checks.items()):
        # As the fact's type first: 1 and 1.0 are one key, whatever their texts are.
        own = quoted(dim_key).cast(kinds[name]).cast(cast)
        keys.append(dim.select(F.lit(i).alias("of_"), own.alias("pk_")))
    known = reduce(DataFrame.unionByName, keys).distinct()
    same = (F.col("which_") == F.col("of_")) & (F.col("fk_") == F.col("pk_"))
    lost = per_key.join(known, same, "left_anti")
    return lost.agg(
        *(
            F.coalesce(F.sum(F.when(F.col("which_") == i, F.col("n_"))), F.lit(0))
            .cast("bigint")
            .alias(name)
            for i, name in enumerate(checks)
        )
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """Key values that occur more than once, most frequent first.

    Only the repeated keys are shuffled for sorting. Where the table is bucketed by the
    key, they are all that is: sorting samples its input, and without this shuffle
    the sample would read and group the table once more.
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences"))
    names = [c for c in counted.columns if c != "occurrences"]
    repeated = counted.where(F.col("occurrences") > 1).hint("rebalance", *names)
    return repeated.orderBy(F.desc("occurrences"), *names)


def coverage(df: DataFrame, date: str, first: str, last: str) -> DataFrame:
    """First and last date, months spanned, and how many years and months occur.

    Rows collapse to one per calendar month before anything distinct is counted.
    """
    months = df.groupBy(year_month(date).alias("month")).agg(
        F.min(date).alias("low"), F.max(date).alias("high")
    )
    return months.agg(
        F.min("low").alias(first),
        F.max("high").alias(last),
        month_boundaries("min(low)", "max(high)").alias("span_months"),
        F.countDistinct(F.year("month")).alias("years_covered"),
        F.count("month").alias("distinct_year_months"),
    )


def flag_count(condition: str) -> Column:
    """Rows where the condition holds; NULL when there are no rows at all."""
    return F.expr(f"sum(case when {condition} then 1 else 0 end)")


def quoted(column: str) -> Column:
    """A column by its exact name, whatever characters that has."""
    return F.col("`" + column.replace("`", "``") + "`")


def not_among(column: str, allowed: Sequence) -> Column:
    """Whether a value is missing or none of those allowed."""
    value = quoted(column)
    return value.isNull() | ~value.isin(list(allowed))


def not_between(column: str, low: object, high: object) -> Column:
    """Whether a value is missing or outside of the bounds, which are allowed themselves."""
    value = quoted(column)
    return value.isNull() | (value < F.lit(low)) | (value > F.lit(high))


def violations(
    df: DataFrame, rules: Mapping[str, Column], key: str, label: str, unique: bool = False
) -> DataFrame:
    """Rows breaking each rule, keys that repeat and rows without one, from one scan.

    Rows are ``(check_name, violations)``. Keys are counted unless ``unique`` says that
    they are proven not to repeat.
    """
    flags = [F.count_if(rule).alias(f"v{i}") for i, rule in enumerate(rules.values())]
    names = [*rules, f"{label} unique", f"{label} present"]
    own = quoted(key)
    if unique:
        missing = F.count_if(own.isNull()).alias("missing")
        wide = df.agg(*flags, F.lit(0).cast("bigint").alias("surplus"), missing)
    else:
        per_key = df.groupBy(own.alias("key_")).agg(*flags, F.count(F.lit(1)).alias("n_"))
        keyed = F.col("key_").isNotNull()
        sums = [F.sum(f"v{i}").alias(f"v{i}") for i in range(len(flags))]
        surplus = F.sum(F.when(keyed, F.col("n_") - 1)).alias("surplus")
        wide = per_key.agg(*sums, surplus, F.sum(F.when(~keyed, F.col("n_"))).alias("missing"))
    found = [F.coalesce(quoted(c), F.lit(0)).cast("bigint") for c in wide.columns]
    pairs = [
        F.struct(F.lit(name).alias("check_name"), value.alias("violations"))
        for name, value in zip(names, found, strict=True)
    ]
    return wide.select(F.inline(F.array(*pairs)))


def expectations(df: DataFrame, checks: Mapping[str, tuple[Column, float, float]]) -> DataFrame:
    """``(check_name, violations)`` of aggregates that should lie within bounds: 0 or 1 each.

    An aggregate without a value, as the variation of nothing, is a violation.
    """
    wide = df.agg(*(found.alias(f"a{i}") for i, (found, _, _) in enumerate(checks.values())))
    pairs = [
        F.struct(
            F.lit(name).alias("check_name"),
            not_between(f"a{i}", low, high).cast("bigint").alias("violations"),
        )
        for i, (name, (_, low, high)) in enumerate(checks.items())
    ]
    return wide.select(F.inline(F.array(*pairs)))


def gate(parts: Sequence[DataFrame]) -> DataFrame:
    """All checks with a verdict, failures first."""
    every = reduce(DataFrame.unionByName, parts)
    verdict = F.when(F.col("violations") == 0, "pass").otherwise("fail")
    return every.withColumn("verdict", verdict).orderBy(F.desc("violations"), "check_name")
