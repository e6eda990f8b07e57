"""A data source over pages of records at rest, such as saved responses of a listing interface.

``spark.read.format("paged").option("path", folder)`` reads ``<folder>/page-<n>.json``, n from 1, each a JSON list of
``{"id", "title", "category", "updated"}``.  One partition covers a range of pages.  Reading ends at the first empty or
missing page or, with ``stop=short``, after the first one with fewer records than ``size``; that page is looked for before the
ranges are dealt out, a few files at a time.  The stream form takes one page per offset.

With ``pushdown=true`` comparisons, lists of values, prefixes and null tests are tested while reading (Spark has no way to tell a Python
source which columns it needs).  ``index_pages`` writes the least and greatest values of each page beside the pages; pages that can't
hold a wanted row by these are not opened, unless their size has changed since.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    SimpleDataSourceStreamReader,
    StringStartsWith,
)

SCHEMA = "page int, id long, title string, category string, updated string"


NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


class Pages(InputPartition):
    def __init__(self, pages: Iterable[int]):
        self.pages = pages


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")


def load_page(path: str, page: int) -> list[tuple] | None:
    """Records of a page; None where there is no such page."""
    system, root = _file_system(path)
    name = f"{root}/page-{page}.json"
    if system.get_file_info(name).type == pafs.FileType.NotFound:
        return None
    with system.open_input_stream(name) as file:
        found = json.loads(file.read() or b"[]")
    return [(page, int(r["id"]), r.get("title"), r.get("category"), r.get("updated")) for r in found]


def index_pages(spark: SparkSession, path: str) -> None:
    """Writes ``<path>/_index``: per page its size, and the least, greatest and missing values of each column."""
    system, root = _file_system(path)
    sizes = [(int(f.base_name[5:-5]), f.size) for f in system.get_file_info(pafs.FileSelector(root)) if re.fullmatch(r"page-[0-9]+\.json", f.base_name)]
    spark.dataSource.register(PagedSource)
    rows = spark.read.format("paged").option("path", path).load()
    extremes = [f(c).alias(f"{c}_{n}") for c in NAMES[1:] for n, f in (("low", F.min), ("high", F.max), ("nulls", lambda c: F.count_if(F.col(c).isNull())))]
    found = rows.groupBy("page").agg(*extremes).join(spark.createDataFrame(sizes, "page int, size long"), "page")
    found.repartition(1).write.mode("overwrite").parquet(f"{path}/_index")


def highest(exists: Callable[[int], bool], first: int = 1) -> int:
    """The greatest key of those that exist without a gap from ``first`` on; ``first - 1`` if there is none.

    Steps double until one misses, and the gap is halved then: at most ``2 * log2(n) + 2`` probes for n keys.
    """
    if not exists(first):
        return first - 1
    low, step = first, 1
    while exists(low + step):
        low, step = low + step, step * 2
    high = low + step
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if exists(middle) else (low, middle)
    return low


def highest_page(path: str) -> int:
    """The last page of a folder of pages, by probing for files."""
    system, root = _file_system(path)
    return highest(lambda k: system.get_file_info(f"{root}/page-{k}.json").type != pafs.FileType.NotFound)


@dataclass(frozen=True)
class Condition:
    """A filter on one column that can be tested on a row, and on what is known of a page."""

    column: str
    kind: str
    value: object = None

    def holds(self, value: object) -> bool:
        if self.kind == "null":
            return (value is None) == self.value
        if value is None:
            return False
        match self.kind:
            case "in":
                return value in self.value
            case "prefix":
                return value.startswith(self.value)
            case ">":
                return value > self.value
            case ">=":
                return value >= self.value
            case "<":
                return value < self.value
            case _:
                return value <= self.value

    def may_hold(self, low: object, high: object, nulls: int) -> bool:
        """Can a page with these extremes have a row for which the condition holds?"""
        if self.kind == "null":
            return nulls > 0 if self.value else low is not None
        if low is None:
            return False
        match self.kind:
            case "in":
                return any(low <= v <= high for v in self.value)
            case "prefix":
                return low[: len(self.value)] <= self.value <= high[: len(self.value)]
            case ">" | ">=":
                return self.holds(high)
            case _:
                return self.holds(low)


def condition(f: Filter) -> Condition | None:
    """Spark's filter as a condition; None for those that Spark has to test itself."""
    column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
    if column not in NAMES:
        return None
    comparisons = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
    match f:
        case EqualTo() | EqualNullSafe() if f.value is not None:
            return Condition(column, "in", (f.value,))
        case In():
            return Condition(column, "in", tuple(v for v in f.value if v is not None))
        case StringStartsWith():
            return Condition(column, "prefix", f.value)
        case IsNull() | IsNotNull():
            return Condition(column, "null", isinstance(f, IsNull))
        case _ if type(f) in comparisons and f.value is not None:
            return Condition(column, comparisons[type(f)], f.value)
    return None


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.size, self.step = int(options.get("size", 100)), int(options.get("pagesPerPartition", 16))
        self.short, self.first = options.get("stop", "empty") == "short", int(options.get("startPage", 1))
        self.conditions: list[Condition] = []

    def _last(self) -> int:
        """The last page to read."""
        system, root = _file_system(self.path)
        sizes = {int(f.base_name[5:-5]): f.size for f in system.get_file_info(pafs.FileSelector(root)) if re.fullmatch(r"page-[0-9]+\.json", f.base_name)}
        page = self.first
        with ThreadPoolExecutor(16) as pool:
            while True:
                ahead = range(page, page + 64)
                # A file's size tells an empty page; how many records another one has is only in the file.
                counts = pool.map(lambda k: 0 if sizes.get(k, 0) < 8 else len(load_page(self.path, k) or []) if self.short else 1, ahead)
                for k, n in zip(ahead, counts, strict=True):
                    if n == 0:
                        return k - 1
                    if self.short and n < self.size:
                        return k
                page += 64

    def partitions(self) -> list[InputPartition]:
        last = self._last()
        # One empty range stands for none.
        return [Pages(range(k, min(k + self.step, last + 1))) for k in range(self.first, max(last + 1, self.first + 1), self.step)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        tests = [(NAMES.index(c.column), c) for c in self.conditions]
        for page in partition.pages:
            yield from (r for r in load_page(self.path, page) or [] if all(c.holds(r[k]) for k, c in tests))


class FilteringReader(PagedReader):
    """Tests conditions while reading; Spark allows this where ``spark.sql.python.filterPushdown.enabled`` is set."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Spark tests what is given back; a condition on the page's number also says which pages to open."""
        for f in filters:
            found = condition(f)
            if found is None:
                yield f
            else:
                self.conditions.append(found)

    def partitions(self) -> list[InputPartition]:
        last, known = self._last(), self._index()
        system, root = _file_system(self.path)
        sizes = {int(f.base_name[5:-5]): f.size for f in system.get_file_info(pafs.FileSelector(root)) if re.fullmatch(r"page-[0-9]+\.json", f.base_name)}

        def wanted(page: int) -> bool:
            row = known.get(page)
            for c in self.conditions:
                if c.column == "page":
                    if not c.holds(page):
                        return False
                elif row and row["size"] == sizes.get(page) and not c.may_hold(*(row[f"{c.column}_{n}"] for n in ("low", "high", "nulls"))):
                    return False
            return True

        pages = [k for k in range(self.first, last + 1) if wanted(k)]
        # One empty list stands for none.
        return [Pages(pages[k : k + self.step]) for k in range(0, max(len(pages), 1), self.step)]

    def _index(self) -> dict[int, dict]:
        system, root = _file_system(self.path)
        if system.get_file_info(f"{root}/_index").type == pafs.FileType.NotFound:
            return {}
        return {r["page"]: r for r in pq.read_table(f"{root}/_index", filesystem=system).to_pylist()}


class PagedStream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.first = options["path"], int(options.get("startPage", 1))

    def initialOffset(self) -> dict:
        return {"page": self.first}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = load_page(self.path, start["page"])
        if not rows:
            return iter([]), start
        return iter(rows), {"page": start["page"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for page in range(start["page"], end["page"]):
            yield from load_page(self.path, page) or []


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (FilteringReader if self.options.get("pushdown") == "true" else PagedReader)(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return PagedStream(self.options)
