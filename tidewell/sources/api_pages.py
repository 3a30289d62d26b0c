"""Landed API response pages: items, next-page tokens, crawl checks.

A page table has one row per fetched page, by default with the columns
`crawl_id, page_no (from 0), status, link_header, body`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidewell.frame import col
from tidewell.functions.jsons import cursor_text, is_json_array, is_json_object, json_array_size, json_path
from tidewell.sources.files import item_columns, variant_rows

# Page limits of a crawl and the page size assumed when unset.
DEFAULT_MAX_PAGES = 20
HARD_MAX_PAGES = 500
DEFAULT_PAGE_SIZE = 50
STRATEGIES = ("offset", "page", "cursor", "link", "relay")


def _documents(pages: DataFrame, body: str, status: str | None) -> DataFrame:
    text = F.nullif(col(body), F.lit(""))
    if status:
        message = F.concat(F.lit("upstream returned status "), col(status).cast("string"))
        text = F.when(col(status) >= 400, F.raise_error(message)).otherwise(text)
    return pages.withColumn("__document", F.parse_json(text))


def _typed(rows: DataFrame, keep: Sequence[str], schema: T.StructType | str | None) -> DataFrame:
    if schema is None:
        return rows
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    return rows.select(*[col(k) for k in keep], "pos", *item_columns(F.col("item"), schema))


def api_items(
    pages: DataFrame,
    items_path: str = "",
    schema: T.StructType | str | None = None,
    keep: Sequence[str] = ("crawl_id", "page_no"),
    body: str = "body",
    status: str | None = "status",
) -> DataFrame:
    """Items of landed pages.

    At the path an array gives its items, an object or scalar one row, null or
    nothing no row. A page with an error status fails the job; filter such pages
    out first to keep the rest. Row order is (crawl, page_no, pos).
    """
    documents = _documents(pages, body, status).withColumn("__node", json_path(F.col("__document"), items_path))
    return _typed(variant_rows(documents, "__node", keep), keep, schema)


def graphql_rows(
    pages: DataFrame,
    data_path: str = "",
    schema: T.StructType | str | None = None,
    keep: Sequence[str] = ("crawl_id", "page_no"),
    body: str = "body",
    status: str | None = "status",
    fail: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(rows, refused pages) of landed GraphQL pages.

    A connection object is unwrapped: each edge gives its node, or itself when
    it has none. Pages whose response lists errors are returned apart, with
    the first message in `error`; with `fail` such a page fails the read of the rows.
    """
    documents = _documents(pages, body, status)
    errors = json_path(F.col("__document"), "errors")
    failed = F.coalesce(json_array_size(errors) > 0, F.lit(False))
    message = cursor_text(json_path(errors, "0.message"))
    refused = documents.where(failed).select(*[col(k) for k in keep], message.alias("error"))

    node = json_path(F.col("__document"), data_path)
    edges = json_path(node, "edges")
    source = F.when(is_json_array(edges) & is_json_object(node), edges).otherwise(node)
    if fail:
        text = F.concat(F.lit("the response lists errors: "), F.coalesce(message, F.lit("")))
        failed = F.when(failed, F.raise_error(text).cast("boolean")).otherwise(F.lit(False))
    usable = documents.where(~failed).withColumn("__from_edges", is_json_array(edges)).withColumn("__node", source)
    rows = variant_rows(usable, "__node", [*keep, "__from_edges"])
    inner = json_path(F.col("item"), "node")
    item = F.when(F.col("__from_edges") & inner.isNotNull(), inner).otherwise(F.col("item"))
    rows = rows.withColumn("item", item).drop("__from_edges")
    return _typed(rows, keep, schema), refused


def link_header_next(header: Column) -> Column:
    """The rel="next" address of a Link header; an address may hold commas."""
    link = r'<([^>]*)>(?:[^<>,"]|"[^"]*")*?;[\x20\t]*rel=(?:"next"|next(?![A-Za-z0-9-]))'
    return F.regexp_extract(header, link, 1)


def next_page(
    pages: DataFrame,
    strategy: str,
    path: str = "",
    page_size: int = DEFAULT_PAGE_SIZE,
    start_page: int = 1,
    page_no: str = "page_no",
    body: str = "body",
    link_header: str = "link_header",
) -> DataFrame:
    """Adds `next_token`: what fetches the page after each page, null at the end; and `broken`.

    A page whose body is there but is no JSON is `broken`: it has no next token, yet is not the end.
    The link strategy does not read bodies, so no page is broken there.

    offset: the next offset, unless the page is short. page: the next page
    number, unless the page is empty. cursor: the scalar at `path`. link: the
    rel="next" address. relay: `pageInfo.endCursor` below `path` while
    `hasNextPage` holds.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown pagination strategy {strategy!r}; known: {', '.join(STRATEGIES)}")
    document = F.try_parse_json(col(body))
    size = page_size if page_size > 0 else DEFAULT_PAGE_SIZE
    if strategy == "offset":
        count = json_array_size(json_path(document, path))
        token = F.when((count > 0) & (count >= size), ((col(page_no) + 1) * size).cast("string"))
    elif strategy == "page":
        count = json_array_size(json_path(document, path))
        token = F.when(count > 0, (col(page_no) + 1 + max(start_page, 1)).cast("string"))
    elif strategy == "cursor":
        token = cursor_text(json_path(document, path))
    elif strategy == "link":
        token = F.nullif(link_header_next(col(link_header)), F.lit(""))
    else:
        info = json_path(document, f"{path}.pageInfo" if path else "pageInfo")
        more = F.try_variant_get(json_path(info, "hasNextPage"), "$", "boolean")
        token = F.when(more, cursor_text(json_path(info, "endCursor")))
    text = F.nullif(F.trim(col(body)), F.lit(""))
    broken = F.lit(False) if strategy == "link" else F.coalesce(text.isNotNull() & document.isNull(), F.lit(False))
    return pages.withColumn("next_token", token).withColumn("broken", broken)


def crawl_audit(
    pages_with_next: DataFrame,
    max_pages: int = DEFAULT_MAX_PAGES,
    crawl: str = "crawl_id",
    page_no: str = "page_no",
    status: str = "status",
    broken: str = "broken",
) -> DataFrame:
    """Per crawl: pages, gaps, failures, whether the page limit cut it short, and whether it is `complete`.

    Takes the output of `next_page`. A page with an error status or a
    broken body is a failed one; of a page that landed more than once the best copy counts, and `repeated_pages`
    says how many such copies there are. A crawl is complete without gaps and failures if its last page is the end.
    """
    limit = min(max_pages, HARD_MAX_PAGES) if max_pages > 0 else DEFAULT_MAX_PAGES
    failed = F.coalesce(col(status) >= 400, F.lit(False)) | F.coalesce(col(broken), F.lit(False))
    # As a struct, since a null token must not make way for an earlier page's.
    copy = F.struct(failed.alias("failed"), F.col("next_token").isNull().alias("end"), F.col("next_token").alias("token"))
    landed = pages_with_next.groupBy(col(crawl), col(page_no)).agg(F.min(copy).alias("copy"), F.count(F.lit(1)).alias("copies"))
    grouped = landed.groupBy(col(crawl)).agg(
        F.count(F.lit(1)).alias("pages"),
        (F.max(col(page_no)) + 1 - F.count(F.lit(1))).alias("missing_pages"),
        F.count_if("copy.failed").alias("failed_pages"),
        F.sum(F.col("copies") - 1).alias("repeated_pages"),
        F.max_by("copy", col(page_no)).alias("last"),
    )
    cut = (F.col("pages") >= limit) & F.col("last.token").isNotNull() & ~F.col("last.failed")
    whole = (F.col("missing_pages") == 0) & (F.col("failed_pages") == 0) & F.col("last.token").isNull()
    return grouped.select(
        crawl, "pages", "missing_pages", "failed_pages", "repeated_pages", F.col("last.token").alias("last_token"), cut.alias("truncated"),
        whole.alias("complete"),
    )


def crawl_gaps(pages: DataFrame, crawl: str = "crawl_id", page_no: str = "page_no") -> DataFrame:
    """The missing ranges of pages of each crawl, the one before its first page included: `<crawl>, first, last, missing`.

    A page that landed twice changes nothing. What is missing behind the last page nobody can tell; see `complete` of `crawl_audit`.
    """
    landed = pages.select(col(crawl), col(page_no).cast("long").alias("last")).where("last >= 0").distinct()
    # A crawl has `HARD_MAX_PAGES` pages at most.
    before = F.coalesce(F.lag("last").over(Window.partitionBy(col(crawl)).orderBy("last")), F.lit(-1))
    gaps = landed.select(col(crawl), (before + 1).alias("first"), (F.col("last") - 1).alias("last"))
    return gaps.where("first <= last").withColumn("missing", F.col("last") - F.col("first") + 1)
