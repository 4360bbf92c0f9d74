"""The catalog: nesting, search, filters, sorts, pages, taxonomy lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merrow.operators.order import numbered
from merrow.scratch import written

# The sort orders of a catalog page.
SORTS = ("popularity", "rating", "release", "title")


def sort_columns(sort: str) -> list[Column]:
    """The order of a page; ids break ties."""
    if sort == "rating":
        return [F.desc_nulls_last("average_rating"), F.desc("rating_count"), F.asc("id")]
    if sort == "release":
        return [F.desc_nulls_last("release_date"), F.asc("id")]
    if sort == "title":
        return [F.asc(F.lower("title")), F.asc("id")]
    if sort == "popularity":
        return [F.desc("popularity_score"), F.asc("id")]
    raise ValueError(f"sort is one of {', '.join(SORTS)}, not {sort!r}")


def search_title(items: DataFrame, query: str | None) -> DataFrame:
    """Items whose title contains the query, ignoring case; every character stands for itself."""
    return items.where(F.contains(F.lower("title"), F.lower(F.lit(query)))) if query else items


def with_taxonomy(items: DataFrame, bridge: DataFrame, slug: str | None) -> DataFrame:
    """Items that the bridge (id, slug, name) connects with a slug."""
    return items.join(bridge.where(F.col("slug") == slug).select("id"), "id", "left_semi") if slug else items


def filtered(items: DataFrame, query: str | None = None, genre: tuple[DataFrame, str] | None = None, tag: tuple[DataFrame, str] | None = None, platform: tuple[DataFrame, str] | None = None) -> DataFrame:
    """All filters of a page, which must all hold. A taxonomy filter is (bridge, slug)."""
    out = search_title(items, query)
    for part in (genre, tag, platform):
        if part:
            out = with_taxonomy(out, *part)
    return out


def page_of(rows: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page, numbered from 1; empty beyond the last one."""
    if page < 1 or size < 1:
        raise ValueError("pages and sizes start at 1")
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)


def page_index(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with their place from 1 in an order, as a table written in that order, for callers
    who turn many pages of it: a page is then a range of places, and its files and row groups are
    found by their bounds, however deep it is."""
    return written(numbered(rows, order), "page-index")


def indexed_page(index: DataFrame, page: int, size: int) -> DataFrame:
    """One page of a ``page_index``, numbered from 1; empty beyond the last one."""
    if page < 1 or size < 1:
        raise ValueError("pages and sizes start at 1")
    return index.where(F.col("place").between((page - 1) * size + 1, page * size)).orderBy("place")


def totals(rows: DataFrame, size: int) -> DataFrame:
    """One row: total rows, and total_pages of a size (0 without rows)."""
    return rows.agg(F.count("*").alias("total")).withColumn("total_pages", F.ceil(F.col("total") / size).cast("long"))


def catalog_page(items: DataFrame, sort: str = "popularity", page: int = 1, size: int = 20, **filters) -> tuple[DataFrame, DataFrame]:
    """A page of the filtered items and its totals, both from the same filters."""
    rows = filtered(items, **filters)
    return page_of(rows, sort_columns(sort), page, size), totals(rows, size)


def nested_list(bridge: DataFrame, name: str) -> DataFrame:
    """Per id the bridge's values as an array ordered by name. Bridges are aggregated before any
    join, so that several of them don't multiply each other's rows."""
    ordered = F.array_sort(F.collect_list(F.struct("name", "slug")))
    return bridge.groupBy("id").agg(F.transform(ordered, lambda x: F.struct(x["slug"], x["name"])).alias(name))


def nest(items: DataFrame, genres: DataFrame, tags: DataFrame, platforms: DataFrame) -> DataFrame:
    """Items with their three taxonomy lists, empty where an item has none."""
    out = items
    for name, bridge in (("genres", genres), ("tags", tags), ("platforms", platforms)):
        none = F.array().cast("array<struct<slug:string,name:string>>")
        out = out.join(nested_list(bridge, name), "id", "left").withColumn(name, F.coalesce(name, none))
    return out


def catalog_scan(items: DataFrame, genres: DataFrame, tags: DataFrame, platforms: DataFrame) -> DataFrame:
    """Every item nested, decimals as doubles, lists ordered by slug: the rows that models are built from."""
    out = nest(items, genres, tags, platforms)
    doubles = {c: F.col(c).cast("double") for c in ("average_rating", "popularity_score") if c in out.columns}
    return out.withColumns(doubles | {k: F.array_sort(k) for k in ("genres", "tags", "platforms")})


def item_by_id(items: DataFrame, id_: int, genres: DataFrame, tags: DataFrame, platforms: DataFrame) -> DataFrame:
    """One nested item, or no row."""
    own = items.where(F.col("id") == id_)
    return nest(own, *[b.where(F.col("id") == id_) for b in (genres, tags, platforms)])


def items_by_ids(items: DataFrame, requested: DataFrame, genres: DataFrame, tags: DataFrame, platforms: DataFrame) -> DataFrame:
    """The nested items of the requested ids (a table with id), each once; unknown ids have no row."""
    ids = requested.select("id").distinct()
    return nest(*[t.join(ids, "id", "left_semi") for t in (items, genres, tags, platforms)])


def taxonomy_list(bridge: DataFrame) -> DataFrame:
    """The distinct values of a bridge by lower-cased name, with the items that have each."""
    return bridge.groupBy("slug", "name").agg(F.countDistinct("id").alias("items")).orderBy(F.lower("name"), "slug")


def resolve_ids(requested: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (request_id, place, id) as (request_id, place, id, slug), and those of unknown ids."""
    known = items.select("id", "slug")
    return requested.join(known, "id"), requested.join(known, "id", "left_anti").orderBy("request_id", "place")


def unknown_values(requested: DataFrame, known: DataFrame) -> DataFrame:
    """Requested (request_id, family, slug) that ``known`` (family, slug) lacks."""
    return requested.join(known.select("family", "slug").distinct(), ["family", "slug"], "left_anti")
