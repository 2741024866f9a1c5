"""Sources that come in pages: plans of windows and queries, paging that ends early, and a Spark data source over a transport.

A transport is a function or an object that can be pickled: transport(request: dict) -> list of records (dict). It may call a server or
read recorded answers; the data source runs it in the tasks, one for each part of the plan.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThan

Transport = Callable[[dict], list]
# Years that one request of a daily and of a monthly series may span; the share of a page before the window at which a
# descending scan ends; the most hits that a search pages through.
DAILY_YEARS, MONTHLY_YEARS, ENOUGH_BEFORE, MOST_HITS = 9, 30, 0.8, 10_000


def windows(first: dt.date, end: dt.date, years: int) -> list[tuple[dt.date, dt.date]]:
    """[first, end) cut into windows of some years, the last shorter."""
    out = []
    while first < end:
        to = min(end, dt.date(first.year + years, first.month, min(first.day, 28)))
        out.append((first, to))
        first = to
    return out


def pages(transport: Transport, request: dict, size: int, most: int | None = None) -> Iterator[list]:
    """Pages of a request ($top, $skip) until one isn't full, or the next would begin beyond `most`."""
    skip = 0
    while most is None or skip < most:
        page = transport(request | {"$top": size, "$skip": skip})
        yield page
        if len(page) < size:
            return
        skip += size


def descending(found: Iterator[list], day: str, first: str, end: str, enough: float = ENOUGH_BEFORE) -> Iterator[dict]:
    """Records of [first, end) from pages of descending days; no further page is asked for once `enough` of one is before the window."""
    for page in found:
        yield from (r for r in page if first <= r[day] < end)
        if page and sum(r[day] < first for r in page) >= enough * len(page):
            return


def in_smaller_pages(transport: Transport, request: dict, sizes: Sequence[int] = (100, 10, 1)) -> tuple[list, list]:
    """(records, gaps) of one page: if it fails, the same stretch is asked for in smaller pages; what fails alone is a gap.

    request has $top = sizes[0] and $skip. An OSError (the connection) isn't a gap: it is raised, so that the work is tried again."""
    try:
        return transport(request), []
    except OSError:
        raise
    except Exception as e:  # noqa: BLE001
        if len(sizes) == 1:
            return [], [{"skip": request["$skip"], "error": f"{type(e).__name__}: {e}"}]
    records, gaps = [], []
    for skip in range(request["$skip"], request["$skip"] + sizes[0], sizes[1]):
        some, failed = in_smaller_pages(transport, request | {"$top": sizes[1], "$skip": skip}, sizes[1:])
        records += some
        gaps += failed
    return records, gaps


def split_until(count: Callable[[dt.date, dt.date], int], first: dt.date, end: dt.date, most: int = MOST_HITS) -> list[tuple[dt.date, dt.date]]:
    """Windows of [first, end) that each have at most `most` hits; a single day is never split."""
    if (end - first).days <= 1 or count(first, end) <= most:
        return [(first, end)]
    middle = first + (end - first) / 2
    return split_until(count, first, middle, most) + split_until(count, middle, end, most)


def query_plan(spark: SparkSession, terms: list[str], divisors: list[str]) -> DataFrame:
    """(term, divisor, query), each query once: every term alone and with every divisor. For searches that can't be ordered by day."""
    t = spark.createDataFrame([(x,) for x in terms], "term string")
    d = spark.createDataFrame([("",), *((x,) for x in divisors)], "divisor string")
    return t.crossJoin(F.broadcast(d)).withColumn("query", F.trim(F.concat_ws(" ", "term", "divisor"))).dropDuplicates(["query"])


class _Part(InputPartition):
    def __init__(self, request: dict):
        super().__init__(json.dumps(request, sort_keys=True))


class _Reader(DataSourceReader):
    def __init__(self, transport: Transport, requests: list[dict], names: list[str], size: int, day: str | None):
        self.transport, self.requests, self.names, self.size, self.day = transport, requests, names, size, day
        self.where: dict = {}

    def partitions(self):
        a, b = self.where.get("first", ""), self.where.get("end", "9999-12-31")
        wanted = [r for r in self.requests if r.get("end", "9999-12-31") > a and r.get("first", "") < b]
        return [_Part(r | {k: v for k, v in self.where.items() if k not in ("first", "end")}) for r in wanted] or [_Part({"none": True})]

    def read(self, partition):
        request = json.loads(partition.value)
        if request.pop("none", False):
            return
        equal = {k: v for k, v in request.items() if k in self.names}
        for page in pages(self.transport, request | {"$select": self.names}, self.size):
            for r in page:
                if all(r.get(k) == v for k, v in equal.items()):
                    yield tuple(r.get(n) for n in self.names)


class _PushingReader(_Reader):
    def pushFilters(self, filters: list[Filter]):
        """Equalities, and bounds of the day, go into the requests; all but equalities are still applied by Spark."""
        for f in filters:
            name = getattr(f, "attribute", (None,))[0]
            if isinstance(f, EqualTo) and name != self.day:
                self.where[name] = f.value
            else:
                if name == self.day and isinstance(f, GreaterThanOrEqual):
                    self.where["first"] = max(str(f.value), self.where.get("first", ""))
                elif name == self.day and isinstance(f, LessThan):
                    self.where["end"] = min(str(f.value), self.where.get("end", "9999-12-31"))
                yield f


def source_class(source_name: str, schema_: str, transport: Transport, requests: list[dict], size: int = 100, day: str | None = None) -> type[DataSource]:
    """A data source to register: one task for each request (a window, a query), paged. Filters are pushed into the requests where
    the session has spark.sql.python.filterPushdown.enabled."""
    names = [c.split()[0] for c in schema_.split(",")]
    session = SparkSession.getActiveSession()
    kind = _PushingReader if session and session.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true" else _Reader

    class Paged(DataSource):
        @classmethod
        def name(cls):
            return source_name

        def schema(self):
            return schema_

        def reader(self, schema):
            return kind(transport, requests, names, size, day)

    return Paged
