"""Cached pages of a monthly harvest as a source that Spark reads by name, in batch and as a stream.

Pages lie in ``<path>/month=YYYY-MM-01/page=N/`` (one XML file a folder, as ``write_pages`` lays them out). A batch has a partition
a month; the options ``since`` and ``until`` leave other months unlisted. A stream has as its offset the page at which each month goes on, so a restart reads what came since and no page again.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator
from dataclasses import dataclass
from xml.parsers import expat

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .readers import AUTHORS

NAME = "harvest_pages"
SCHEMA = "month date, page int, arxiv_id string, title string, abstract string, created date, categories string, authors array<string>"
_ARROW = pa.schema([("month", pa.date32()), ("page", pa.int32()), *((n, pa.string()) for n in ("arxiv_id", "title", "abstract")), ("created", pa.date32()), ("categories", pa.string()), ("authors", pa.list_(pa.string()))])
_MONTH = re.compile(r"month=(\d{4}-\d{2}-\d{2})$")
_PAGE = re.compile(r"page=(\d+)$")


def write_pages(pages: DataFrame, path: str) -> None:
    """Pages (month date, page int, xml) in the layout that the source reads; a page that is there already must not come again."""
    pages.repartition("month", "page").write.mode("append").partitionBy("month", "page").text(path)


def _open(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path)


def _folders(path: str, pattern: re.Pattern) -> list[str]:
    files, place = _open(path)
    found = files.get_file_info(arrow_fs.FileSelector(place, allow_not_found=True))
    return sorted(m[1] for f in found if f.type == arrow_fs.FileType.Directory and (m := pattern.search(f.path)))


def months_at(path: str) -> list[str]:
    return _folders(path, _MONTH)


def pages_at(path: str, month: str) -> list[int]:
    return sorted(map(int, _folders(f"{path}/month={month}", _PAGE)))


def _date(text: str | None) -> datetime.date | None:
    try:
        return datetime.date.fromisoformat((text or "").strip())
    except ValueError:
        return None


def records(xml: bytes | str) -> list[dict]:
    """Records of one OAI-PMH page, whatever its prefixes and whether they are declared; a page that is no XML has none.

    Of an element that a record holds more than once the first counts, but for names of authors.
    """
    found: list[dict] = []
    texts: dict[str, list[str]] = {}  # element: its texts in the record that is open
    inside: list[str] = []

    def start(name: str, _: dict) -> None:
        inside.append(name.rpartition(":")[2])
        if inside[-1] == "record":
            texts.clear()
        texts.setdefault(inside[-1], []).append("")

    def data(text: str) -> None:
        if inside and inside[-1] in texts:  # text around records is not kept
            texts[inside[-1]][-1] += text

    def end(_: str) -> None:
        if inside.pop() == "record":
            one = lambda name: " ".join(texts.get(name, [""])[0].split()) or None
            authors = [a.strip() for a in texts.get("keyname", ())][:AUTHORS]
            found.append({"arxiv_id": one("id"), "title": one("title"), "abstract": one("abstract"), "created": _date(one("created")), "categories": one("categories"), "authors": authors})

    reader = expat.ParserCreate()
    reader.buffer_text = True
    reader.StartElementHandler, reader.CharacterDataHandler, reader.EndElementHandler = start, data, end
    try:
        reader.Parse(xml, True)
    except expat.ExpatError:
        return []
    return found


def _read(path: str, month: str, pages: list[int]) -> Iterator[pa.RecordBatch]:
    """An Arrow batch a page."""
    files, place = _open(path)
    for page in pages:
        folder = arrow_fs.FileSelector(f"{place}/month={month}/page={page}")
        for f in files.get_file_info(folder):
            if f.type != arrow_fs.FileType.File or f.base_name.startswith(("_", ".")):
                continue
            with files.open_input_stream(f.path) as stream:
                rows = records(stream.read())
            if rows:
                yield pa.RecordBatch.from_pylist([{"month": datetime.date.fromisoformat(month), "page": page, **r} for r in rows], schema=_ARROW)


@dataclass
class MonthPages(InputPartition):
    """Pages [first, until) of a month; all of them where ``until`` is None."""

    month: str
    first: int = 0
    until: int | None = None

    def chosen(self, path: str) -> list[int]:
        if self.until == 0:
            return []
        return [p for p in pages_at(path, self.month) if p >= self.first and (self.until is None or p < self.until)]


class _Batch(DataSourceReader):
    """Months that ``since`` and ``until`` (dates, both included) leave; others are not listed.

    They are options, not pushed filters: Spark 4.1 keeps what is pushed into a Python source with the loaded table, so a second
    filter on the same DataFrame would silently read the months of the first.
    """

    def __init__(self, path: str, since: str | None, until: str | None) -> None:
        self.path = path
        self.since, self.until = (datetime.date.fromisoformat(d) if d else None for d in (since, until))

    def partitions(self) -> list[MonthPages]:
        months = [m for m in months_at(self.path) if (not self.since or datetime.date.fromisoformat(m) >= self.since) and (not self.until or datetime.date.fromisoformat(m) <= self.until)]
        return [MonthPages(m) for m in months] or [MonthPages("none", 0, 0)]

    def read(self, partition: MonthPages) -> Iterator[pa.RecordBatch]:
        yield from _read(self.path, partition.month, partition.chosen(self.path))


class _Stream(DataSourceStreamReader):
    """The offset is {month: page at which it goes on}. Pages of a month come in order; one behind a gap waits until the gap is filled."""

    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        reached = {}
        for month in months_at(self.path):
            there = pages_at(self.path, month)
            reached[month] = next((i for i, p in enumerate(there) if p != i), len(there))
        return reached

    def partitions(self, start: dict, end: dict) -> list[MonthPages]:
        return [MonthPages(m, start.get(m, 0), until) for m, until in sorted(end.items()) if until > start.get(m, 0)]

    def read(self, partition: MonthPages) -> Iterator[pa.RecordBatch]:
        yield from _read(self.path, partition.month, partition.chosen(self.path))


class HarvestPages(DataSource):
    """``spark.read.format("harvest_pages").option("path", folder)`` and the same with ``readStream``; a batch takes
    ``since`` and ``until`` too. Pages of a month count from 0."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def _path(self) -> str:
        if not self.options.get("path"):
            raise ValueError(f"{NAME} needs the option 'path'")
        return self.options["path"].rstrip("/")

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self._path(), self.options.get("since"), self.options.get("until"))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self._path())


def register(spark: SparkSession) -> None:
    """Make the source known to a session."""
    spark.dataSource.register(HarvestPages)
