"""Saved searches and catalogue searches: dynamic filters, sorts, pages."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlens.functions import predicates as P
from lotlens.functions.scalars import first_filled, pages
from lotlens.sources.constants import REGION_KEYWORDS, WHOLE_COUNTRY


@dataclass(frozen=True)
class SearchSpec:
    """A saved search. Absent, zero and empty entries set no condition; mileage is stored but not applied."""

    brand: str | None = None
    model: str | None = None
    year_from: int | None = None
    year_to: int | None = None
    price_from: int | None = None
    price_to: int | None = None
    mileage_from: int | None = None
    mileage_to: int | None = None
    fuel: list[str] = field(default_factory=list)
    transmission: list[str] = field(default_factory=list)
    region: str | None = None
    sources: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, stored: dict | None) -> SearchSpec:
        names = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in (stored or {}).items() if k in names and v is not None})

    def predicate(self) -> Column:
        return P.conjunction(
            [
                P.contains_text("brand", self.brand), P.contains_text("model", self.model),
                P.at_least("year", self.year_from), P.at_most("year", self.year_to),
                P.at_least("price", self.price_from), P.at_most("price", self.price_to),
                P.contains_text("region", self.region),
                P.one_of("fuel", self.fuel), P.one_of("transmission", self.transmission), P.one_of("source", self.sources),
            ],
            P.is_false("is_duplicate"),
        )


@dataclass(frozen=True)
class CatalogFilter:
    """A client-side filter: exact names, all bounds (0 counts), rows without fuel or gearbox pass, regions by keyword."""

    brand: str = ""
    model: str = ""
    region: str = ""
    year_from: int | None = None
    year_to: int | None = None
    price_from: int | None = None
    price_to: int | None = None
    mileage_from: int | None = None
    mileage_to: int | None = None
    fuels: tuple[str, ...] = ()
    transmissions: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()

    def predicate(self) -> Column:
        bounds = [f(c, getattr(self, f"{c}_{end}"), falsy_is_absent=False) for c in ("year", "price", "mileage") for f, end in ((P.at_least, "from"), (P.at_most, "to"))]
        return P.conjunction([
            P.equals_or_any("brand", self.brand), P.equals_or_any("model", self.model),
            P.region_matches("region", self.region, REGION_KEYWORDS, WHOLE_COUNTRY), *bounds,
            P.one_of_or_unset("fuel", self.fuels), P.one_of_or_unset("trans", self.transmissions), P.one_of("src", self.sources),
        ])


def server_order(sort: str, unique: str = "id") -> list[Column]:
    """``price_asc``, or newest first for anything else; ties by the unique key."""
    return [F.col("price").asc_nulls_first() if sort == "price_asc" else F.col("found_at").desc_nulls_last(), F.col(unique).asc()]


def catalog_order(sort: str, position: str = "pos") -> list[Column]:
    """The four client sorts; ties keep the input order, as does an unknown sort."""
    key = {"price_asc": F.asc("price"), "price_desc": F.desc("price"), "year_desc": F.desc("year"), "mileage_asc": F.asc("mileage")}.get(sort)
    return [*([key] if key is not None else []), F.asc(position)]


def page(df: DataFrame, order: list[Column], number: int = 1, per_page: int = 20) -> DataFrame:
    """One page of a sorted result: a top-k, never a full sort."""
    offset, limit = P.page_arguments(number, per_page)
    return df.orderBy(*order).offset(offset).limit(limit)


def envelope(df: DataFrame, number: int = 1, per_page: int = 20) -> DataFrame:
    """One row: total, page, per_page, pages."""
    P.page_arguments(number, per_page)
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return total.select("total", F.lit(number).alias("page"), F.lit(per_page).alias("per_page"), pages(F.col("total"), per_page).alias("pages"))


def page_envelope(df: DataFrame, order: list[Column], number: int = 1, per_page: int = 20, unread: Column | None = None) -> DataFrame:
    """One row: items (the page's rows, in order), total, unread (rows that pass the test), page, per_page, pages.

    Only the page, bounded by ``per_page``, is gathered; the counts are one aggregation over all rows.
    """
    rows = page(df, order, number, per_page).withColumn("__at", F.monotonically_increasing_id())
    listed = F.sort_array(F.collect_list(F.struct("__at", F.struct(*df.columns).alias("row"))))
    items = rows.agg(F.transform(listed, lambda x: x["row"]).alias("items"))
    counts = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(unread if unread is not None else F.lit(False)).alias("unread"))
    return items.crossJoin(counts).select("items", "total", "unread", F.lit(number).alias("page"), F.lit(per_page).alias("per_page"), pages(F.col("total"), per_page).alias("pages"))


def any_one(df: DataFrame, *unique: str) -> DataFrame:
    """One row where any would do: always the first by a unique key."""
    return df.orderBy(*unique).limit(1)


def described(parts: list[Column], empty: str, separator: str = " · ") -> Column:
    """The parts that are set (a condition's text, or null) in one line; ``empty`` if none is."""
    return first_filled(F.concat_ws(separator, *parts), F.lit(empty))


def owned(df: DataFrame, user_id: str) -> DataFrame:
    """Rows of one user; another's are as good as missing."""
    return df.where(F.col("user_id") == user_id)


def search_for(searches: DataFrame, user_id: str, search_id: str) -> SearchSpec | None:
    """A user's saved search by its key; None if it isn't theirs."""
    row = owned(searches, user_id).where(F.col("id") == search_id).select("filters").first()
    return SearchSpec.of(row["filters"].asDict() if row and row["filters"] else {}) if row else None
