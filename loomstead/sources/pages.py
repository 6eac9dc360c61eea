"""Landed pages of REST listings as a data source: `spark.read.format("landed_pages").load(folder)`.

A listing is a chain of pages, each of which names the next. Pages lie in `owner=<owner>/page=<page>`, as `land` writes
them: a JSON object with `next` (null at the end) and an array of items (option `field`, "items" if not given). Each
chain is read by one task from the page `first` ("1" if not given) to its end, so pages that no other one leads to are
not read; a page at a time is in memory, and the names of the chain's pages. A filter for owners (= or IN) leaves their chains alone to be read.

- A row for each item: owner, page, position (from 0 in its page) and item as JSON, which Spark parses (`from_json`).
- A missing page, a page without the array and a chain that comes back to a page are errors: the listing is not whole.
- Of a page that was landed again the newest file counts, of its lines the last. A folder without chains gives no rows;
  a chain without items none. A null owner is written and read as null.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "owner string, page string, position int, item string"
_NULL = "__HIVE_DEFAULT_PARTITION__"


class Chain(InputPartition):
    def __init__(self, owner: str | None, folder: str):
        self.owner, self.folder = owner, folder


class LandedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("field", "items"), self.options.get("first", "1"))


class _Reader(DataSourceReader):
    def __init__(self, path: str, field: str, first: str):
        self.path, self.field, self.first, self.owners = path, field, first, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what asks for owners; the rest is left to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("owner",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.owners = asked if self.owners is None else self.owners & asked
            else:
                yield f

    def partitions(self) -> list[Chain]:
        chains = [Chain(None if owner == _NULL else owner, folder) for owner, folder in _named(*_opened(self.path), "owner=").items()]
        return [c for c in chains if self.owners is None or (c.owner is not None and c.owner in self.owners)]

    def read(self, chain: Chain | None) -> Iterator[tuple]:
        if chain is None:  # Spark's one partition where there is none
            return
        files, _ = _opened(self.path)
        landed = _named(files, chain.folder, "page=")
        page, seen = self.first, set()
        while page is not None:
            if page in seen:
                raise ValueError(f"{chain.folder}: page {page} leads back to itself")
            seen.add(page)
            if page not in landed:
                raise FileNotFoundError(f"{chain.folder}: no page {page}")
            answer = _page(files, landed[page])
            items = answer.get(self.field)
            if not isinstance(items, list):
                raise ValueError(f"{chain.folder}: page {page} has no {self.field}")
            for position, item in enumerate(items):
                yield chain.owner, page, position, json.dumps(item, ensure_ascii=False)
            page = None if answer.get("next") is None else str(answer["next"])


def _opened(path: str) -> tuple:
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def _named(files, folder: str, prefix: str) -> dict[str, str]:
    """Folders by what follows the prefix; Spark escapes characters that paths can't hold."""
    from pyarrow import fs

    inside = files.get_file_info(fs.FileSelector(folder))
    return {unquote(f.base_name.removeprefix(prefix)): f.path for f in inside if f.base_name.startswith(prefix)}


def _page(files, folder: str) -> dict:
    from pyarrow import fs

    landed = [f for f in files.get_file_info(fs.FileSelector(folder)) if f.is_file and not f.base_name.startswith(("_", "."))]
    if not landed:
        raise FileNotFoundError(folder)
    with files.open_input_stream(max(landed, key=lambda f: (f.mtime_ns, f.path)).path) as stream:
        return json.loads(stream.read().decode().strip().rsplit("\n", 1)[-1])


def land(answers: DataFrame, folder: str) -> None:
    """Write answers (owner, page, body: JSON in one line) to where the source finds them."""
    answers.select("owner", "page", "body").write.mode("append").partitionBy("owner", "page").text(folder)


def pages(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """Items of all chains; filters for owners reach the source."""
    spark.dataSource.register(LandedPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("landed_pages").options(**options).load(folder)
