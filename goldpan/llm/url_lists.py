"""URL filters by lists that change over time.

Dated events (an entry is listed or delisted under a category) become validity intervals.
Every capture is judged by the entries that were active when it was fetched: its host, the
domains above, and its path prefixes are joined with the intervals as of that date. Only
DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"
ALLOW = "allow"
FOREVER = "9999-12-31"


def host(url: Column) -> Column:
    """The host in lower case; empty for NULL and for what is no URL."""
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def segments(url: Column) -> Column:
    """The parts of the path between slashes."""
    path = F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))
    return F.filter(F.split(path, "/"), lambda part: part != "")


def intervals(events: DataFrame) -> DataFrame:
    """(entry, category, valid_from, valid_to) of events (entry, category, on_date, listed).

    An entry is active from the date of an event that lists it to the date of its next
    event, that date excluded. Of several events of a day listing wins. Events with a NULL
    in any column say nothing.
    """
    daily = (
        events.select("entry", "category", F.col("on_date").cast("date").alias("on_date"), "listed")
        .dropna()
        .groupBy("entry", "category", "on_date")
        .agg(F.max("listed").alias("listed"))
    )
    following = Window.partitionBy("entry", "category").orderBy("on_date")
    ends = F.lead("on_date", 1, None).over(following)
    return (
        daily.withColumn("valid_to", F.coalesce(ends, F.lit(FOREVER).cast("date")))
        .where("listed")
        .select("entry", "category", F.col("on_date").alias("valid_from"), "valid_to")
    )


def keys(url: Column, depth: int) -> Column:
    """Entries that cover a URL: its host, the domains above, path prefixes to a depth.

    Of a name its last two labels are the shortest domain; an address has none above.
    """
    name = host(url)
    labels = F.split(name, r"\.")
    levels = F.greatest(F.size(labels) - 1, F.lit(1))
    above = F.transform(
        F.sequence(F.lit(1), levels),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    domains = F.when(name.rlike(r"^[0-9.]+$"), F.array(name)).otherwise(above)
    parts = segments(url)
    count = F.least(F.size(parts), F.lit(depth))
    prefixes = F.transform(
        F.sequence(F.lit(1), count),
        lambda i: F.concat(name, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")),
    )
    every = F.concat(domains, F.when(count > 0, prefixes).otherwise(F.array().cast("array<string>")))
    return F.when(name != "", every).otherwise(F.array().cast("array<string>"))


def judge(
    captures: DataFrame, events: DataFrame, url: str = "url", fetched: str = "fetched_on"
) -> DataFrame:
    """(url, fetched_on, n_active, categories, entry, listed_on, blocked) of the captures.

    A row for each distinct URL and date of ``captures`` on which some entry covers it; a
    capture without a row is not blocked. ``n_active`` counts active (entry, category)
    pairs, ``categories`` lists them, comma-separated, in order. The longest entry
    decides: listed under "allow" alone it lets the capture pass. A NULL URL or date, and
    what is no URL, is covered by nothing.
    """
    active = intervals(events)
    # No listed path is deeper: longer prefixes could not match.
    depth = active.agg(F.max(F.size(F.split("entry", "/"))) - 1).first()[0] or 0
    seen = captures.select(
        captures[url].alias("url"), captures[fetched].cast("date").alias("fetched_on")
    ).distinct()
    # Narrow rows; adaptive execution splits the captures of a domain that many share.
    covering = seen.withColumn("entry", F.explode(keys(F.col("url"), depth)))
    as_of = (F.col("valid_from") <= F.col("fetched_on")) & (F.col("fetched_on") < F.col("valid_to"))
    hits = covering.join(active, "entry").where(as_of)
    blocks = F.col("category") != ALLOW
    first = F.struct(F.length("entry").alias("n"), blocks.alias("blocks"), "entry", "valid_from")
    return (
        hits.groupBy("url", "fetched_on")
        .agg(
            F.count(F.lit(1)).alias("n_active"),
            F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"),
            F.max(first).alias("first"),
        )
        .select(
            "url",
            "fetched_on",
            "n_active",
            "categories",
            F.col("first.entry").alias("entry"),
            F.col("first.valid_from").alias("listed_on"),
            F.col("first.blocks").alias("blocked"),
        )
    )


def filtered(
    captures: DataFrame, events: DataFrame, url: str = "url", fetched: str = "fetched_on"
) -> DataFrame:
    """Every row of ``captures`` (its key columns only) with its verdict; none is dropped."""
    verdicts = judge(captures, events, url, fetched)
    rows = captures.withColumn("_url", captures[url]).withColumn(
        "_fetched", captures[fetched].cast("date")
    )
    same = (rows["_url"] == verdicts["url"]) & (rows["_fetched"] == verdicts["fetched_on"])
    return rows.join(verdicts, same, "left").select(
        *(rows[c] for c in captures.columns if c not in VERDICT),
        F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        F.coalesce("categories", F.lit("")).alias("categories"),
        verdicts["entry"].alias("entry"),
        verdicts["listed_on"].alias("listed_on"),
        F.coalesce("blocked", F.lit(False)).alias("blocked"),
    )


# Columns that the verdict sets; a column of captures with such a name gives way.
VERDICT = ("n_active", "categories", "entry", "listed_on", "blocked")
