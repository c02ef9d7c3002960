"""Wiki dumps (MediaWiki XML, plain or bz2) as tables of pages.

``read_pages`` uses Spark's XML reader: distributed, on any store, also over the splits of one large dump; its page_ord
follows the files' and splits' order but has gaps. ``read_pages_in_order`` is a Python data source that streams each
file in one task and numbers its pages exactly as the dump has them.
"""

from __future__ import annotations

import bz2
import glob
import os
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lumenlex.functions.text import not_blank, strip

PAGE = "title string, ns string, redirect struct<_title:string>, revision array<struct<text:struct<_VALUE:string>>>"


def articles(pages: DataFrame) -> DataFrame:
    """Articles only: namespace 0, no redirect, a text that is not blank."""
    return pages.filter((strip(F.col("ns")) == "0") & F.col("redirect").isNull() & not_blank(F.col("text")))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_ord, title, text of the articles of the dump(s) at ``path``; a damaged dump fails the job.

    Of a page with several revisions the last text counts.
    """
    reader = spark.read.format("xml").option("rowTag", "page").option("ignoreSurroundingSpaces", "false").option("mode", "FAILFAST")
    pages = reader.schema(PAGE).load(path).select(F.coalesce("title", F.lit("")).alias("title"), "ns", "redirect", F.get(F.reverse("revision"), 0)["text"]["_VALUE"].alias("text"))
    return articles(pages).select(F.monotonically_increasing_id().alias("page_ord"), "title", "text")


def iter_pages(path: str) -> Iterator[tuple[str, str]]:
    """(title, text) of every article of one dump in its order; one page at a time is in memory.

    FileNotFoundError if there is no such file, ValueError if it is not well-formed.
    """
    with (bz2.open if str(path).endswith(".bz2") else open)(path, "rb") as dump:
        page: dict[str, str] = {}
        try:
            for _, element in ET.iterparse(dump, events=("end",)):
                name = element.tag.rpartition("}")[2]
                if name in ("title", "ns", "text"):
                    page[name] = element.text or ""
                elif name == "redirect":
                    page[name] = "yes"
                elif name == "page":
                    if page.get("ns", "").strip() == "0" and "redirect" not in page and page.get("text", "").strip():
                        yield page.get("title", ""), page["text"]
                    page = {}
                    element.clear()
        except ET.ParseError as error:
            raise ValueError(f"{path} is not well-formed XML: {error}") from error


class _File(InputPartition):
    def __init__(self, path: str, place: int):
        self.path, self.place = path, place


class _WikiReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        found = sorted(glob.glob(os.path.join(self.path, "*.xml*")) if os.path.isdir(self.path) else glob.glob(self.path))
        if not found:
            raise FileNotFoundError(self.path)
        return [_File(path, place) for place, path in enumerate(found)]

    def read(self, partition: _File) -> Iterator[tuple[int, str, str]]:
        for n, (title, text) in enumerate(iter_pages(partition.path)):
            yield (partition.place << 40) + n, title, text


class WikiDataSource(DataSource):
    """format("mediawiki"): a dump, a folder of dumps or a pattern, at a path that every executor sees."""

    @classmethod
    def name(cls) -> str:
        return "mediawiki"

    def schema(self) -> str:
        return "page_ord bigint, title string, text string"

    def reader(self, schema) -> DataSourceReader:
        return _WikiReader(self.options["path"])


def read_pages_in_order(spark: SparkSession, path: str) -> DataFrame:
    """page_ord, title, text of the articles in dump order; page_ord counts from 0 in every file (plus file << 40)."""
    spark.dataSource.register(WikiDataSource)
    return spark.read.format("mediawiki").load(path)
