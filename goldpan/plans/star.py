"""The star schema the statements run on, and the columns that play each role."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Business key of each gold object.
KEYS = {
    "dim_customer": "customer_id",
    "dim_product": "product_id",
    "dim_store": "store_id",
    "fact_sales": "order_number",
    "fact_returns": "return_id",
}

# The domains and ranges a retail warehouse is expected to keep to.
RETAIL_DOMAINS = {
    "dim_customer": {
        "gender": ("Male", "Female", "Unknown"),
        "marital_status": ("Married", "Single", "Divorced"),
        "age_group": ("Under 20", "20-29", "30-39", "40-49", "50-59", "60+", "Unknown"),
        "continent": ("Europe", "North America", "Asia", "Latin America", "Oceania"),
    },
    "dim_product": {"category": ("Bikes", "Accessories", "Clothing", "Components")},
    "dim_store": {"store_type": ("Flagship", "Retail", "Online", "Outlet")},
    "fact_sales": {"delivery_status": ("On Time", "Late", "Unknown")},
    "fact_returns": {"return_reason": ("Defective", "Size Mismatch", "Unsatisfied", "Wrong Item")},
}
RETAIL_RANGES = {
    "dim_customer": {"age": (18, 100)},
    "fact_sales": {"order_date": (date(2023, 1, 1), date(2024, 12, 31))},
    "fact_returns": {"return_date": (date(2023, 1, 1), date(2024, 12, 31))},
}


# What the retail warehouse documents of its own size and columns. Pass them
# to Roles(row_counts=..., value_counts=...) to have the gate check them.
RETAIL_ROW_COUNTS = {
    "dim_customer": (25_000, 25_000),
    "dim_product": (5_000, 5_000),
    "dim_store": (100, 100),
    "fact_sales": (30_000, 30_000),
    "fact_returns": (26_967, 26_967),
}
RETAIL_VALUE_COUNTS = {
    "dim_customer": {
        "gender": (2, 3),
        "marital_status": (3, 3),
        "age_group": (6, 7),
        "continent": (5, 5),
        "country": (17, 17),
    },
    "dim_product": {"category": (4, 4)},
    "dim_store": {"store_type": (4, 4)},
    "fact_sales": {"delivery_status": (2, 3)},
    "fact_returns": {"return_reason": (4, 4)},
}


@dataclass(frozen=True)
class Roles:
    """Which column answers which question. The defaults are a retail warehouse's own names."""

    gender: str = "gender"
    marital_status: str = "marital_status"
    age_group: str = "age_group"
    customer_categories: tuple[str, ...] = (
        "gender",
        "marital_status",
        "age_group",
        "city",
        "country",
        "continent",
    )
    customer_audit: tuple[str, ...] = (
        "customer_id",
        "first_name",
        "last_name",
        "gender",
        "marital_status",
        "birthdate",
        "age",
        "city",
        "country",
        "continent",
    )
    product_audit: tuple[str, ...] = (
        "product_id",
        "product_name",
        "cost",
        "category",
        "subcategory",
        "product_line",
        "maintenance_required",
    )
    sales_audit: tuple[str, ...] = (
        "order_number",
        "product_id",
        "customer_id",
        "store_id",
        "order_date",
        "shipping_date",
        "due_date",
        "quantity",
        "price",
        "sales_amount",
    )
    returns_audit: tuple[str, ...] = (
        "return_id",
        "order_number",
        "return_date",
        "return_reason",
        "return_amount",
    )
    sanity_column: str = "age"
    sanity_low: int = 18
    sanity_high: int = 100
    sanity_lowest: str = "youngest_customer"
    sanity_highest: str = "oldest_customer"
    domains: Mapping[str, Mapping[str, tuple[str, ...]]] = field(
        default_factory=lambda: RETAIL_DOMAINS
    )
    ranges: Mapping[str, Mapping[str, tuple]] = field(default_factory=lambda: RETAIL_RANGES)
    # Optional expectations of the gate, as (lowest, highest): rows of an object, distinct
    # values of a column, its coefficient of variation in percent.
    row_counts: Mapping[str, tuple[int, int]] = field(default_factory=dict)
    value_counts: Mapping[str, Mapping[str, tuple[int, int]]] = field(default_factory=dict)
    variations: Mapping[str, Mapping[str, tuple[float, float]]] = field(default_factory=dict)


@dataclass(frozen=True)
class Entry:
    """One object of the inventory."""

    layer: str
    name: str
    kind: str
    df: DataFrame


@dataclass(frozen=True)
class Proof:
    """Whether no non-NULL key repeats, and whether no key is NULL."""

    unique: bool
    complete: bool


@dataclass
class Star:
    """Five gold objects, the inventory around them, and facts proven about their keys.

    Row counts and proofs are kept: make a new star once the tables behind it change.
    """

    dim_customer: DataFrame
    dim_product: DataFrame
    dim_store: DataFrame
    fact_sales: DataFrame
    fact_returns: DataFrame
    roles: Roles = field(default_factory=Roles)
    upstream: tuple[Entry, ...] = ()
    kinds: Mapping[str, str] = field(default_factory=dict)
    # Objects whose key cannot repeat because it is what their rows were grouped by.
    grouped_by_key: frozenset[str] = frozenset()
    _proofs: dict[str, Proof] = field(default_factory=dict, repr=False)
    _rows: dict[str, int] = field(default_factory=dict, repr=False)

    @property
    def gold(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in KEYS}

    @cached_property
    def inventory(self) -> list[Entry]:
        gold = [Entry("gold", n, self.kinds.get(n, "VIEW"), df) for n, df in self.gold.items()]
        return [*self.upstream, *gold]

    def source(self, name: str) -> DataFrame:
        """An upstream object by name."""
        return next(entry.df for entry in self.upstream if entry.name == name)

    def proof(self, name: str) -> Proof:
        """What one pass over an object's keys shows; each object is read once."""
        if name not in self._proofs:
            key, df = KEYS[name], self.gold[name]
            if name in self.grouped_by_key:
                counts = ["count(*) as rows", f"count_if({key} is null) as unkeyed"]
                found = df.selectExpr(*counts).first()
                unique = True
            else:
                per_key = df.groupBy(key).agg(F.count("*").alias("n"))
                found = per_key.selectExpr(
                    "coalesce(sum(n), 0) as rows",
                    f"coalesce(max(n) filter (where {key} is not null), 0) as most",
                    f"count_if({key} is null) as unkeyed",
                ).first()
                unique = found["most"] <= 1
            self._rows[name] = found["rows"]
            self._proofs[name] = Proof(unique, found["unkeyed"] == 0)
        return self._proofs[name]

    def rows(self, name: str) -> int:
        """Row count of a gold object."""
        if name not in self._rows:
            self._rows[name] = self.gold[name].count()
        return self._rows[name]

    def unique(self, *names: str) -> bool:
        """Whether no business key of the named objects occurs twice."""
        return all(self.proof(name).unique for name in names)

    def register(self) -> None:
        """Expose the gold objects to ``spark.sql`` as temporary views."""
        for name, df in self.gold.items():
            df.createOrReplaceTempView(name)
