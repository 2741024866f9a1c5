"""Services as requests and parsers around a transport (see paged): time series, filtered entities, searches, posts, site maps, pages."""

from __future__ import annotations

import datetime as dt
import html
import json
import re
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .paged import DAILY_YEARS, MONTHLY_YEARS, Transport, descending, in_smaller_pages, pages, windows


def series_requests(code: int | str, first: dt.date, end: dt.date, daily: bool) -> list[dict]:
    """A request for each window that the service answers at once: DAILY_YEARS of a daily series, MONTHLY_YEARS of others."""
    return [{"code": code, "first": a.isoformat(), "end": b.isoformat()} for a, b in windows(first, end, DAILY_YEARS if daily else MONTHLY_YEARS)]


def entity_query(entity: str, where: dict[str, object], columns: list[str], order: str | None = None, since: tuple[str, str] | None = None) -> str:
    """The path and query of a filtered entity ($filter, $select, $orderby), spaces as %20; texts in single quotes, their own doubled."""
    show = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
    parts = [f"{k} eq {show(v)}" for k, v in where.items()] + ([f"{since[0]} ge {show(since[1])}"] if since else [])
    options = {"$filter": " and ".join(parts), "$select": ",".join(columns), "$orderby": order, "$format": "json"}
    return entity + "?" + "&".join(f"{k}={quote(v, safe=',')}" for k, v in options.items() if v)


def entity_rows(transport: Transport, query: str, size: int = 10_000) -> Iterator[dict]:
    """All records of an entity query, page by page."""
    for page in pages(transport, {"query": query}, size):
        yield from page


def expectations(rows: DataFrame, indicator: str, smoothed: bool = True, base: int = 0) -> DataFrame:
    """(day, median, mean, sd, low, high, n) of one indicator's twelve-month expectations, by day; other bases and smoothings fall out."""
    names = {"Data": "day", "Mediana": "median", "Media": "mean", "DesvioPadrao": "sd", "Minimo": "low", "Maximo": "high", "numeroRespondentes": "n"}
    kept = rows.where((F.col("Indicador") == indicator) & (F.col("Suavizada") == ("S" if smoothed else "N")) & (F.col("baseCalculo") == base))
    return kept.select(*(F.col(a).alias(b) for a, b in names.items())).withColumn("day", F.to_date("day"))


def expectations_by_meeting(rows: DataFrame, base: int = 0) -> DataFrame:
    """(day, meeting, number, year, median): the expected rate for each meeting, named R<number>/<year>."""
    code = lambda k: F.regexp_extract("Reuniao", r"^R(\d+)/(\d{4})$", k).try_cast("int")
    return rows.where((F.col("baseCalculo") == base) & code(2).isNotNull()).select(F.to_date("Data").alias("day"), F.col("Reuniao").alias("meeting"), code(1).alias("number"), code(2).alias("year"), F.col("Mediana").alias("median"))


def search_scan(transport: Transport, query: str, outlet: str, first: str, end: str, size: int = 25, most: int = 10_000, kinds: tuple = (None, "Matéria"), ordered: bool = True) -> Iterator[dict]:
    """Hits of a search within [first, end) of an allowed kind, with their outlet and query. If hits come by descending day, the scan ends
    early; never beyond `most` hits, where the caller has to split the window (paged.split_until)."""
    found = pages(transport, {"query": query, "outlet": outlet, "first": first, "end": end}, size, most)
    hits = descending(found, "day", first, end) if ordered else (h for page in found for h in page if first <= h["day"] < end)
    yield from (h | {"outlet": outlet, "query": query} for h in hits if h.get("kind") in kinds)


def posts_of_year(transport: Transport, outlet: str, year: int, first: dt.date, end: dt.date, total: int, size: int = 100) -> tuple[list[dict], list[dict], str]:
    """(posts, gaps, unit) of the part of a year that lies in [first, end): pages of `size`, smaller ones where one fails. The unit's key
    has the window unless it is the whole year, so that a later, longer window is another unit."""
    a, b = max(first, dt.date(year, 1, 1)), min(end, dt.date(year + 1, 1, 1))
    whole = (a, b) == (dt.date(year, 1, 1), dt.date(year + 1, 1, 1))
    posts, gaps = [], []
    for skip in range(0, total, size):
        some, failed = in_smaller_pages(transport, {"outlet": outlet, "first": a.isoformat(), "end": b.isoformat(), "$skip": skip, "$top": size}, (size, max(1, size // 10), 1))
        posts += some
        gaps += failed
    return posts, gaps, f"{outlet}|{year}" + ("" if whole else f"|{a}|{b}")


def site_map_days(index: str, first: str, end: str) -> list[tuple[str, str]]:
    """(day, url) of the daily site maps of an index whose day is in [first, end)."""
    found = [(m[1], html.unescape(u)) for u in re.findall(r"<loc>\s*([^<]+?)\s*</loc>", index) if (m := re.search(r"/(\d{4}-\d{2}-\d{2})/", u))]
    return sorted((d, u) for d, u in found if first <= d < end)


def site_map_urls(day_map: str) -> list[str]:
    return [html.unescape(u) for u in re.findall(r"<loc>\s*([^<]+?)\s*</loc>", day_map)]


def listed_links(col: Column, pattern: str) -> Column:
    """The distinct targets of links in a page that match a pattern, in order."""
    return F.array_distinct(F.filter(F.regexp_extract_all(col, F.lit(r"""(?is)<a\b[^>]*\bhref\s*=\s*["']([^"']+)"""), 1), lambda u: u.rlike(pattern)))


def script_object(page: str, name: str) -> dict | None:
    """The object that a script of the page assigns to a name; None if there is none or it isn't JSON."""
    at = re.search(rf"\b{re.escape(name)}\s*=\s*(?=\{{)", page)
    try:
        return json.JSONDecoder().raw_decode(page, at.end())[0] if at else None
    except ValueError:
        return None


def story(found: dict, outlet: str, url: str, least: int = 60) -> dict | None:
    """A story's record from a page's object (elements of text, headlines, days, section); None without a paragraph."""
    plain = lambda h: re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", h or ""))).strip()
    paragraphs = [p for e in found.get("content_elements", []) if e.get("type") == "text" and len(p := plain(e.get("content"))) >= least]
    if not paragraphs:
        return None
    title, lead = plain(found.get("headlines", {}).get("basic")), plain(found.get("subheadlines", {}).get("basic")) or None
    section = (found.get("taxonomy", {}).get("primary_section") or {}).get("name")
    rest = [*paragraphs, None, None]
    return {"outlet": outlet, "url": url, "day": found.get("first_publish_date") or found.get("display_date"), "title": title, "subtitle": lead, "p1": rest[0], "p2": rest[1], "section": section, "n_paragraphs": len(paragraphs)}


def relevant_urls(urls: DataFrame, column: str, parts: list[str], tokens: list[str]) -> DataFrame:
    """Urls whose last part is relevant by its words, before their pages are fetched."""
    slug = F.regexp_extract(F.rtrim(F.col(column), F.lit("/")), r"([^/]*)$", 1)
    return urls.where(text.slug_relevant(text.norm(slug), parts, tokens))
