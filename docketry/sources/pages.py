"""A Spark data source of pages: large files are read by ranges of pages, and a filter on pages reads few of them.

What opens a file is injected: an object with `files(path)`, giving names and numbers of pages, and
`read(name, first, last)`, giving (page, text, blocks) for these pages, blocks being (bbox, text).
It is pickled into the tasks. Where it also has `offsets(name, pages)`, giving where pages begin, it is told so by
`begin(name, page, at)` before the task reads.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

TEXTS = "path string, page int, text string"
BLOCKS = "path string, page int, bbox array<double>, text string"
#: Pages that one task reads.
PAGES_A_TASK = 64
#: Tasks that a read makes at most, unless filters leave more runs of pages: beyond, a task reads more pages.
MOST_TASKS = 4096


class Opener(Protocol):
    def files(self, path: str) -> Iterable[tuple[str, int]]: ...

    def read(self, name: str, first: int, last: int) -> Iterable[tuple[int, str, list[tuple[list[float], str]]]]: ...


@dataclass
class PageRange(InputPartition):
    name: str
    first: int
    last: int
    at: int | None = None


class PageReader(DataSourceReader):
    def __init__(self, opener: Opener, path: str, blocks: bool, step: int):
        self._opener, self._path, self._blocks, self._step = opener, path, blocks, step
        self._first, self._last = 1, None
        self._pages: set[int] | None = None
        self._names: set[str] | None = None

    def _within(self, first: int | None = None, last: int | None = None) -> None:
        if first is not None:
            self._first = max(self._first, first)
        if last is not None:
            self._last = last if self._last is None else min(self._last, last)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Conditions on a page's number or a file's name are met here; all others are left to Spark."""
        for f in filters:
            on, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if on == ("page",) and isinstance(f, EqualTo):
                self._within(value, value)
            elif on == ("page",) and isinstance(f, GreaterThan):
                self._within(first=value + 1)
            elif on == ("page",) and isinstance(f, GreaterThanOrEqual):
                self._within(first=value)
            elif on == ("page",) and isinstance(f, LessThan):
                self._within(last=value - 1)
            elif on == ("page",) and isinstance(f, LessThanOrEqual):
                self._within(last=value)
            elif on == ("page",) and isinstance(f, In):
                self._pages = {v for v in value if v is not None} & (self._pages if self._pages is not None else {*value})
            elif on == ("path",) and isinstance(f, EqualTo):
                self._names = {value} & (self._names if self._names is not None else {value})
            else:
                yield f

    def _wanted(self, n_pages: int, step: int) -> Iterator[tuple[int, int]]:
        """The ranges of pages that tasks read of a file."""
        last = n_pages if self._last is None else min(n_pages, self._last)
        if self._pages is None:
            runs = [(self._first, last)]
        else:
            runs = []
            for p in sorted(p for p in self._pages if self._first <= p <= last):
                if runs and runs[-1][1] == p - 1:
                    runs[-1] = (runs[-1][0], p)
                else:
                    runs.append((p, p))
        for first, end in runs:
            for a in range(first, end + 1, step):
                yield a, min(end, a + step - 1)

    def partitions(self) -> list[PageRange]:
        found = [(name, n) for name, n in self._opener.files(self._path) if self._names is None or name in self._names]
        step = max(self._step, -(-sum(n for _, n in found) // MOST_TASKS))
        offsets, out = getattr(self._opener, "offsets", None), []
        for name, n in found:
            wanted = list(self._wanted(n, step))
            starts = offsets(name, [a for a, _ in wanted]) if offsets and wanted else [None] * len(wanted)
            out += [PageRange(name, a, b, at) for (a, b), at in zip(wanted, starts, strict=True)]
        return out

    def read(self, partition: PageRange) -> Iterator[tuple[Any, ...]]:
        if not isinstance(partition, PageRange):  # Spark reads an empty list of partitions as one without any
            return
        if partition.at is not None:
            self._opener.begin(partition.name, partition.first, partition.at)
        for page, text, blocks in self._opener.read(partition.name, partition.first, partition.last):
            if self._blocks:
                yield from ((partition.name, page, [float(x) for x in box], t.strip()) for box, t in blocks if t.strip())
            else:
                yield partition.name, page, text


def page_source(opener: Opener, name: str = "judgment_pages") -> type[DataSource]:
    """The data source class that reads by `opener`; options: path, `blocks` (true: rows of BLOCKS, else TEXTS), `pagesPerTask`."""

    class Pages(DataSource):
        def _is_blocks(self) -> bool:
            return str(self.options.get("blocks", "false")).lower() == "true"

        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return BLOCKS if self._is_blocks() else TEXTS

        def reader(self, schema) -> PageReader:
            return PageReader(opener, self.options["path"], self._is_blocks(), int(self.options.get("pagesPerTask", PAGES_A_TASK)))

    return Pages


def read_pages(spark: SparkSession, opener: Opener, path: str, blocks: bool = False, pages_per_task: int = PAGES_A_TASK, name: str = "judgment_pages") -> DataFrame:
    """Pages, or blocks, of the files under a path; registers the source under `name` and lets Spark push filters into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(page_source(opener, name))
    return spark.read.format(name).option("blocks", str(blocks).lower()).option("pagesPerTask", pages_per_task).load(path)


@dataclass
class FormFeedFiles:
    """Opens text files whose pages end in a form feed, in a folder that driver and executors share.

    Blocks are the lines that are not blank, each one unit high.
    """

    suffix: str = ".txt"

    def offsets(self, name: str, pages: list[int]) -> list[int]:
        """The bytes at which pages, in ascending order, begin: a task goes there and passes over none before."""
        ends, wanted, out, base = 0, list(pages), [], 0
        out += [0 for p in wanted if p <= 1]
        with open(name, "rb") as f:
            while len(out) < len(wanted) and (data := f.read(1 << 20)):
                at = np.flatnonzero(np.frombuffer(data, np.uint8) == 12)
                while len(out) < len(wanted) and wanted[len(out)] - 1 <= ends + len(at):
                    out.append(base + int(at[wanted[len(out)] - 2 - ends]) + 1)
                ends, base = ends + len(at), base + len(data)
        return out

    def begin(self, name: str, page: int, at: int) -> None:
        """Tell `read` where a page begins."""
        self._known = {(name, page): at}

    def files(self, path: str) -> Iterator[tuple[str, int]]:
        for name in sorted(glob.glob(f"{path.removeprefix('file://')}/**/*{self.suffix}", recursive=True)):
            pages = 0
            with open(name, "rb") as f:
                while data := f.read(1 << 20):
                    pages += data.count(b"\f")
            if os.path.getsize(name):
                yield name, pages

    def read(self, name: str, first: int, last: int) -> Iterator[tuple[int, str, list[tuple[list[float], str]]]]:
        at = getattr(self, "_known", {}).get((name, first))
        page, kept = (1 if at is None else first), []
        with open(name, "rb") as f:
            f.seek(at or 0)
            while page <= last and (data := f.read(1 << 20)):
                *ends, rest = data.split(b"\f")
                for piece in ends:
                    if first <= page <= last:
                        text = b"".join([*kept, piece]).decode()
                        yield page, text, [([0.0, float(i), float(len(x)), i + 1.0], x) for i, x in enumerate(text.split("\n"))]
                    kept, page = [], page + 1
                if first <= page <= last:
                    kept.append(rest)
