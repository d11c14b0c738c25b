"""Fetch dates and list history for the pages table, which has neither.

The fetch date of a page follows from its number; the history of the lists follows from
the hosts, domains and language folders that occur, by digits of their MD5 sums: it
grows with the pages, and SQL derives the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldpan.llm.url_lists import ALLOW, host, segments

EPOCH = "2024-01-01"
DAYS = 366


def _number(name: Column, part: int) -> Column:
    """Four hexadecimal digits of the name's sum."""
    return F.conv(F.substring(F.md5(name.cast("binary")), 4 * part + 1, 4), 16, 10).cast("int")


def captures(pages: DataFrame) -> DataFrame:
    """(page_id, url, fetched_on): captures spread over a year."""
    day = F.pmod(F.col("page_id") * 37, F.lit(DAYS)).cast("int")
    return pages.select("page_id", "url", F.date_add(F.lit(EPOCH).cast("date"), day).alias("fetched_on"))


def history(pages: DataFrame) -> DataFrame:
    """(entry, category, on_date, listed) of a list publisher who saw these hosts."""
    places = pages.select(host(F.col("url")).alias("host"), segments(F.col("url"))[0].alias("folder"))
    hosts = places.select("host").where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    domains = (
        hosts.where(F.size(labels) > 3)
        .select(F.array_join(F.slice(labels, 2, F.size(labels)), ".").alias("entry"))
        .distinct()
        .where(F.pmod(_number(F.col("entry"), 0), F.lit(5)) == 0)
        .select("entry", F.lit("adult").alias("category"))
    )
    kind = F.pmod(_number(F.col("host"), 0), F.lit(4))
    named = hosts.select(
        F.col("host").alias("entry"),
        F.when(F.col("host").contains("casino"), "gambling")
        .when(F.col("host").contains("pills"), "pharma")
        .when(kind == 0, "malware")
        .when(kind == 1, "tracker")
        .alias("category"),
    ).where("category IS NOT NULL")
    folders = (
        places.where("host <> '' AND folder IS NOT NULL")
        .select(F.concat_ws("/", "host", "folder").alias("entry"))
        .distinct()
        .where(F.pmod(_number(F.col("entry"), 0), F.lit(6)) == 0)
        .select("entry", F.lit(ALLOW).alias("category"))
    )
    entries = named.unionByName(domains).unionByName(folders)
    start = F.pmod(_number(F.col("entry"), 1), F.lit(200))
    length = 20 + F.pmod(_number(F.col("entry"), 2), F.lit(100))
    events = F.array(
        F.struct(start.alias("day"), F.lit(True).alias("listed")),
        F.struct((start + length).alias("day"), F.lit(False).alias("listed")),
        # Half of them come back.
        F.struct((start + length + 30).alias("day"), (length % 2 == 0).alias("listed")),
    )
    return entries.withColumn("event", F.explode(events)).select(
        "entry",
        "category",
        F.date_add(F.lit(EPOCH).cast("date"), F.col("event.day")).alias("on_date"),
        F.col("event.listed").alias("listed"),
    )


SQL = r"""
WITH places AS (
    SELECT page_id, url,
        DATE '2024-01-01' + CAST(((page_id * 37) % 366 + 366) % 366 AS INTEGER) AS fetched_on,
        lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '')) AS host,
        list_filter(
            string_split(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), ''), '/'),
            lambda x: x <> ''
        ) AS parts
    FROM pages
), hosts AS (
    SELECT DISTINCT host, string_split(host, '.') AS labels FROM places WHERE host <> ''
), named AS (
    SELECT host AS entry,
        CASE WHEN contains(host, 'casino') THEN 'gambling'
             WHEN contains(host, 'pills') THEN 'pharma'
             WHEN CAST('0x' || substr(md5(host), 1, 4) AS INTEGER) % 4 = 0 THEN 'malware'
             WHEN CAST('0x' || substr(md5(host), 1, 4) AS INTEGER) % 4 = 1 THEN 'tracker' END AS category
    FROM hosts
    UNION ALL
    SELECT entry, 'adult' FROM (
        SELECT DISTINCT array_to_string(labels[2:], '.') AS entry FROM hosts WHERE len(labels) > 3
    ) WHERE CAST('0x' || substr(md5(entry), 1, 4) AS INTEGER) % 5 = 0
    UNION ALL
    SELECT entry, 'allow' FROM (
        SELECT DISTINCT host || '/' || parts[1] AS entry FROM places WHERE host <> '' AND len(parts) > 0
    ) WHERE CAST('0x' || substr(md5(entry), 1, 4) AS INTEGER) % 6 = 0
), spans AS (
    SELECT entry, category,
        CAST('0x' || substr(md5(entry), 5, 4) AS INTEGER) % 200 AS start,
        20 + CAST('0x' || substr(md5(entry), 9, 4) AS INTEGER) % 100 AS length
    FROM named WHERE category IS NOT NULL
), events AS (
    SELECT entry, category, DATE '2024-01-01' + start AS on_date, TRUE AS listed FROM spans
    UNION ALL
    SELECT entry, category, DATE '2024-01-01' + start + length, FALSE FROM spans
    UNION ALL
    SELECT entry, category, DATE '2024-01-01' + start + length + 30, length % 2 = 0 FROM spans
), periods AS (
    SELECT entry, category, on_date AS valid_from, listed,
        lead(on_date, 1, DATE '9999-12-31') OVER (PARTITION BY entry, category ORDER BY on_date) AS valid_to
    FROM (
        SELECT entry, category, on_date, bool_or(listed) AS listed FROM events
        GROUP BY entry, category, on_date
    )
), covering AS (
    SELECT url, fetched_on,
        unnest(list_concat(
            CASE WHEN regexp_full_match(host, '[0-9.]+') THEN [host]
                 ELSE list_transform(range(1, greatest(len(string_split(host, '.')), 2)),
                     lambda i: array_to_string(string_split(host, '.')[i:], '.')) END,
            list_transform(range(1, len(parts) + 1), lambda i: host || '/' || array_to_string(parts[:i], '/'))
        )) AS entry
    FROM (SELECT DISTINCT url, fetched_on, host, parts FROM places WHERE host <> '')
), hits AS (
    SELECT c.url, c.fetched_on, p.entry, p.category, p.valid_from
    FROM covering c JOIN periods p
        ON c.entry = p.entry AND p.listed AND p.valid_from <= c.fetched_on AND c.fetched_on < p.valid_to
), verdicts AS (
    SELECT url, fetched_on, count(*) AS n_active,
        array_to_string(list_sort(list(DISTINCT category)), ',') AS categories,
        max(struct_pack(n := length(entry), blocks := category <> 'allow', entry := entry, valid_from := valid_from)) AS first
    FROM hits GROUP BY url, fetched_on
)
SELECT p.page_id, p.url, p.fetched_on, coalesce(v.n_active, 0) AS n_active,
    coalesce(v.categories, '') AS categories, v.first.entry AS entry,
    v.first.valid_from AS listed_on, coalesce(v.first.blocks, FALSE) AS blocked
FROM places p LEFT JOIN verdicts v ON p.url = v.url AND p.fetched_on = v.fetched_on
"""
