"""A data source for landed pages of paged feeds.

Feeds are fetched by other tools into folders of JSON files, one file per page and
one folder per window, market or day. ``spark.read.format("pages")`` reads them with
one task per folder, in page order, under the feed's own rules: it stops at an empty
or a short page, retries reads that fail, skips a window that the feed refused, and logs
folders that it gives up on.

``spark.readStream.format("pages")`` follows folders to which pages are still added; see
``PageStreamReader``.

Options: ``path``; ``columns`` (DDL); ``stop`` = ``empty`` or ``short``; ``page_size``;
``pages`` (most pages of a folder, 0 for all); ``cursor`` (a column: pages must move it
forward, else the folder ends there); ``after`` (skip rows up to this cursor value);
``tries``; ``failures`` (a folder: a page that stays unreadable ends its market or window
there, with a line in this log; without it, it ends the job). Paths are those of the
cluster's file system, with their scheme.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tidemark.functions.parsing import CANDLE_SECONDS, slug_start
from tidemark.operators.upsert import exists
from tidemark.sources.folders import filesystem, qualified

#: Longest wait between two tries, in seconds.
LONGEST_WAIT = 4.0


def backoff(tries: int, first: float = 0.1, longest: float = LONGEST_WAIT) -> list[float]:
    """Waits between tries: doubling, up to ``longest``."""
    return [min(longest, first * 2**i) for i in range(max(0, tries - 1))]


def with_retry(action, tries: int, errors=(OSError, ValueError), sleep=time.sleep):
    waits = [*backoff(tries), None]
    for wait in waits:
        try:
            return action()
        except errors:
            if wait is None:
                raise
            sleep(wait)


class Refused(Exception):
    """A page that says that the feed has nothing for its window."""


class Folder(InputPartition):
    def __init__(self, path: str, name: str):
        self.path, self.name = path, name


class PageReader(DataSourceReader):
    def __init__(self, columns: StructType, options):
        self.columns = columns
        self.path = options["path"]
        self.stop = options.get("stop", "empty")
        self.size = int(options.get("page_size", 0))
        self.most = int(options.get("pages", 0))
        self.cursor = options.get("cursor")
        self.after = options.get("after")
        self.tries = int(options.get("tries", 3))
        self.failures = options.get("failures")

    def partitions(self) -> list[Folder]:
        folders = sorted(name for name, is_folder in self._entries(self.path) if is_folder)
        return [Folder(f"{self.path.rstrip('/')}/{f}", f) for f in folders] or [Folder(self.path, "")]

    @staticmethod
    def _entries(path: str) -> list[tuple[str, bool]]:
        from pyarrow import fs

        files, root = filesystem(path)
        return [(i.base_name, i.type == fs.FileType.Directory) for i in files.get_file_info(fs.FileSelector(root))]

    def _give_up(self, partition: Folder, page: str, error: Exception) -> None:
        files, root = filesystem(self.failures)
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/{partition.name or 'all'}.json") as f:
            f.write(json.dumps({"folder": partition.name, "page": page, "error_msg": f"{type(error).__name__}: {error}"}).encode())

    def read(self, partition: Folder) -> Iterator[tuple]:
        names = self.columns.names
        kinds = [f.dataType.simpleString() for f in self.columns]
        pages = sorted((n for n, is_folder in self._entries(partition.path) if n.endswith(".json") and not is_folder), key=lambda n: (len(n), n))
        # rows up to here are known: those asked to be skipped, then those of earlier pages
        floor = float("-inf") if self.after is None else float(self.after)
        last = None
        for number, page in enumerate(pages):
            if self.most and number >= self.most:
                return
            try:
                rows = with_retry(lambda: self._load(f"{partition.path}/{page}"), self.tries)  # noqa: B023
            except Refused:
                return
            except (OSError, ValueError) as e:
                if not self.failures:
                    raise
                self._give_up(partition, page, e)
                return
            if not rows:
                return
            furthest = last
            for row in rows:
                values = row if isinstance(row, list) else [row.get(n) for n in names]
                found = _convert(values, kinds)
                if found is None:
                    continue  # a row that does not parse is no reason to lose the page
                if self.cursor:
                    at = found[names.index(self.cursor)]
                    if at is None:
                        continue
                    furthest = at if furthest is None else max(furthest, at)
                    if at <= floor:
                        continue
                yield tuple(found)
            if self.cursor and furthest == last:
                return  # a page that does not move on repeats for ever
            if furthest is not None:
                last, floor = furthest, max(floor, furthest)
            if self.stop == "short" and self.size and len(rows) < self.size:
                return

    @staticmethod
    def _load(path: str) -> list:
        files, where = filesystem(path)
        with files.open_input_stream(where) as f:
            found = json.loads(f.read())
        if isinstance(found, list):
            return found
        if found.get("status") == 400:
            raise Refused(path)
        return found.get("data", [])


class Range(InputPartition):
    """Pages ``[start, end)`` of a folder."""

    def __init__(self, path: str, name: str, start: int, end: int):
        self.path, self.name, self.start, self.end = path, name, start, end


class PageStreamReader(DataSourceStreamReader):
    """Landed pages as a stream: a task per folder that has new ones, each row once.

    Pages of a folder are numbered from 0 (``0.json``, ``1.json``, ...) and never change once
    they are there. An offset is the number of pages read of each folder, so any planned
    range can be read again; a batch takes at most ``batch_pages`` of each. The feed's own
    cursor follows from them: rows up to the greatest cursor of the pages before are known
    and left out, as pages overlap at their ends.

    ``forming`` is the length of a row's bar in the cursor's unit. A bar is given out by the
    first page that was fetched after its end (``fetched_at`` in the page, in that unit);
    where a page does not say, its last row is still forming. Such a row is held back, does
    not move the cursor, and comes with a later page. Refused pages give nothing. A page
    that stays unreadable ends the query or, with ``failures``, is logged there and passed
    over. The rules of when a folder ends do not apply, as it may go on. ``name_column`` names
    a column that gets the folder's name.
    """

    def __init__(self, columns: StructType, options):
        self.columns, self.path = columns, options["path"]
        self.cursor, self.after = options.get("cursor"), options.get("after")
        self.forming = float(options["forming"]) if "forming" in options else None
        self.most = int(options.get("batch_pages", 4))
        self.tries, self.failures = int(options.get("tries", 3)), options.get("failures")
        self.name_column = options.get("name_column")
        self.at: dict[str, int] | None = None

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        at, found = self.at or {}, {}
        folders = [n for n, is_folder in PageReader._entries(self.path) if is_folder] or [""]
        for name in sorted(folders):
            known = at.get(name, 0)
            there = {n for n, is_folder in PageReader._entries(f"{self.path}/{name}" if name else self.path) if not is_folder}
            end = known
            while end < known + self.most and f"{end}.json" in there:
                end += 1
            if end:
                found[name] = end
        self.at = {**at, **found}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Range]:
        # a restarted query plans its last batch again before it asks for more
        self.at = self.at or dict(end)
        return [Range(f"{self.path}/{n}" if n else self.path, n, start.get(n, 0), stop) for n, stop in sorted(end.items()) if stop > start.get(n, 0)]

    def _rows(self, partition: Range, page: int) -> tuple[list[list], float | None]:
        """A page's rows that parse, and when it was fetched."""
        files, where = filesystem(f"{partition.path}/{page}.json")

        def load():
            with files.open_input_stream(where) as f:
                return json.loads(f.read())

        try:
            found = with_retry(load, self.tries)
        except (OSError, ValueError) as e:
            if not self.failures:
                raise
            PageReader._give_up(self, partition, f"{page}.json", e)
            return [], None
        fetched = found.get("fetched_at") if isinstance(found, dict) else None
        rows = found if isinstance(found, list) else [] if found.get("status") == 400 else found.get("data", [])
        fields = [f for f in self.columns if f.name != self.name_column]
        parsed = [_convert(r if isinstance(r, list) else [r.get(f.name) for f in fields], [f.dataType.simpleString() for f in fields]) for r in rows]
        if self.name_column:
            at = self.columns.names.index(self.name_column)
            parsed = [r and [*r[:at], partition.name, *r[at:]] for r in parsed]
        return [r for r in parsed if r is not None], fetched

    def _closed(self, partition: Range, page: int) -> list[list]:
        """A page's rows but for those whose bar is still forming."""
        rows, fetched = self._rows(partition, page)
        if not self.cursor:
            return rows
        place = self.columns.names.index(self.cursor)
        rows = [r for r in rows if r[place] is not None]
        if self.forming is not None and rows:
            last = max(r[place] for r in rows)
            rows = [r for r in rows if (r[place] < last if fetched is None else r[place] + self.forming <= float(fetched))]
        return rows

    def read(self, partition: Range) -> Iterator[tuple]:
        place = self.columns.names.index(self.cursor) if self.cursor else None
        floor = float("-inf") if self.after is None else float(self.after)
        if place is not None:  # the cursor as the pages before leave it; most often the last of them says
            for page in range(partition.start - 1, -1, -1):
                if known := self._closed(partition, page):
                    floor = max(floor, max(r[place] for r in known))
                    break
        for page in range(partition.start, partition.end):
            rows = self._closed(partition, page)
            yield from (tuple(r) for r in rows if place is None or r[place] > floor)
            if place is not None and rows:
                floor = max(floor, max(r[place] for r in rows))


def _convert(values: list, kinds: list[str]) -> list | None:
    if len(values) < len(kinds):
        return None
    out = []
    for value, kind in zip(values, kinds, strict=False):
        try:
            if value is None:
                out.append(None)
            elif kind in ("bigint", "int"):
                out.append(int(value))
            elif kind == "double":
                out.append(float(value))
            else:
                out.append(value if isinstance(value, str) else json.dumps(value))
        except (TypeError, ValueError):
            return None
    return out


class Pages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return self.options["columns"]

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(schema, self.options)

    def streamReader(self, schema: StructType) -> PageStreamReader:
        return PageStreamReader(schema, self.options)


# the feeds' paging rules; columns as stored
FEEDS = {
    "bars": {"stop": "short", "page_size": "1000", "cursor": "open_ts_ms"},
    "funding": {"stop": "short", "page_size": "500", "cursor": "funding_ts_ms"},
    "open_interest": {"stop": "short", "page_size": "500", "cursor": "ts_ms"},
    "open_interest_5m": {"stop": "short", "page_size": "500", "cursor": "ts_ms"},
    "top_account_ratio": {"stop": "short", "page_size": "500", "cursor": "ts_ms"},
    "top_position_ratio": {"stop": "short", "page_size": "500", "cursor": "ts_ms"},
    "global_account_ratio": {"stop": "short", "page_size": "500", "cursor": "ts_ms"},
    "events": {"stop": "empty"},
    "trades": {"stop": "short", "page_size": "1000", "pages": "4"},
}


#: Days of a window of the windowed feeds; the five-minute feed keeps no more than its span.
WINDOW_DAYS = {"funding": 25, "open_interest": 25, "top_account_ratio": 25, "top_position_ratio": 25, "global_account_ratio": 25, "open_interest_5m": 29, "events": 1}


def windows(feed: str, start: int, end: int) -> list[tuple[int, int]]:
    """The windows ``[from, to)`` in seconds that the pages of a feed are fetched by, and its folders named after."""
    step = WINDOW_DAYS[feed] * 86_400
    return [(at, min(end, at + step)) for at in range(start, end, step)]


def read_feed(spark: SparkSession, feed: str, path: str, stored: str | None = None, **options: str) -> DataFrame:
    """The landed pages of a feed as its stored columns; with ``stored``, a table, only what lies beyond its last cursor."""
    from tidemark.sources.tables import SCHEMAS

    rules = {**FEEDS[feed], **options}
    if stored is not None and "after" not in rules and exists(spark, stored):
        last = spark.read.parquet(stored).agg(F.max(rules["cursor"])).first()[0]
        if last is not None:
            rules["after"] = str(last)
    if "failures" in rules:
        rules["failures"] = qualified(spark, rules["failures"])
    spark.dataSource.register(Pages)
    return spark.read.format("pages").options(path=qualified(spark, path), columns=SCHEMAS[feed], **rules).load()


#: Length of a bar of the live feeds, in the unit of their cursors.
FORMING = {"bars": "60000"}


def follow_feed(spark: SparkSession, feed: str, path: str, **options: str) -> DataFrame:
    """The pages that are being landed of a feed, as a stream of its stored columns, each row once and complete."""
    from tidemark.sources.tables import SCHEMAS

    rules = {"columns": SCHEMAS[feed]} | {k: v for k, v in FEEDS[feed].items() if k == "cursor"} | ({"forming": FORMING[feed]} if feed in FORMING else {}) | options
    spark.dataSource.register(Pages)
    return spark.readStream.format("pages").options(path=qualified(spark, path), **rules).load()


def failures(spark: SparkSession, folder: str) -> DataFrame:
    """``folder, page, error_msg``: the markets and windows that a read gave up on."""
    kind = "folder string, page string, error_msg string"
    return spark.read.schema(kind).json(folder) if exists(spark, folder) else spark.createDataFrame([], kind)


def candle_markets(events: DataFrame, prefix: str, seconds: int = CANDLE_SECONDS) -> DataFrame:
    """Of discovered events the candles: those whose slug has the prefix and ends in a candle's start."""
    return events.where(F.col("slug").startswith(prefix) & (slug_start(F.col("slug")) % seconds == 0))
