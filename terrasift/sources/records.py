"""Sources of open-data records: landed JSON and CSV, catalogues, paged datasets."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROW = "map<string,string>"


def json_arrays(spark: SparkSession, path: str) -> DataFrame:
    """``source, ix, row``: the objects of JSON array files. What is no object, or a file that is no array, has a null row."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), F.regexp_replace("value", "^﻿", "").alias("value"))
    items = files.select("source", F.posexplode_outer(F.from_json("value", "array<string>")).alias("ix", "item"))
    return items.select("source", "ix", F.from_json("item", ROW).alias("row"))


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """``source, row`` of CSV files with a header; every value is text."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    pairs = F.create_map(*[x for c in df.columns for x in (F.lit(c.lstrip("﻿")), F.col(f"`{c}`"))]) if df.columns else F.create_map()
    return df.select(F.input_file_name().alias("source"), pairs.alias("row"))


def missing_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per source how many rows lack a required key or are no object (0 means the source is good)."""
    bad = F.col("row").isNull()
    for k in keys:
        bad = bad | ~F.coalesce(F.map_contains_key("row", k), F.lit(False))
    return rows.groupBy("source").agg(F.count("*").alias("n_rows"), F.count_if(bad).alias("n_bad"))


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """``dataset_id, name, description`` of the dataset paths of an OpenAPI document."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "paths map<string, struct<get: struct<summary: string, description: string>>>").alias("d"))
    paths = doc.select(F.explode(F.map_entries("d.paths")).alias("p"))
    ident = F.regexp_extract("p.key", r"/datasets/([0-9a-fA-F-]{36})(?:/|$)", 1)
    return paths.select(ident.alias("dataset_id"), F.col("p.value.get.summary").alias("name"), F.col("p.value.get.description").alias("description")).where("dataset_id <> ''").distinct()


def keyword_filter(entries: DataFrame, keywords: list[str]) -> DataFrame:
    """Catalogue entries whose name or description holds all keywords, whatever their case."""
    text = F.lower(F.concat_ws(" ", "name", "description"))
    for k in keywords:
        entries = entries.where(text.contains(k.lower()))
    return entries


class PagedDataset(DataSource):
    """Reads a dataset landed page by page: ``<path>/page=<n>.json``, each an array of objects.

    Pages are read in parallel, one partition each, from 0 to the first empty page; a
    short page does not end the dataset. No empty page within ``max_pages`` is an error.
    Repeated pages are found by ``repeated_pages`` on the result.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_dataset"

    def schema(self) -> str:
        return "page int, ix int, row map<string,string>"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self.options)


class _Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class _PagedReader(DataSourceReader):
    def __init__(self, options):
        path = options["path"]
        # any file system that has a scheme, so that workers see the same folder as the driver
        self.files, self.path = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        self.max_pages = int(options.get("max_pages", "500"))

    def _rows(self, page: int) -> list:
        with self.files.open_input_stream(f"{self.path}/page={page}.json") as f:
            rows = json.loads(f.read().decode("utf-8-sig"))
        if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
            raise ValueError(f"page {page} is no array of objects")
        return rows

    def partitions(self) -> list[InputPartition]:
        for n in range(self.max_pages):
            if self.files.get_file_info(f"{self.path}/page={n}.json").size < 64 and not self._rows(n):
                return [_Page(i) for i in range(n)]
        raise ValueError(f"no empty page among the first {self.max_pages}")

    def read(self, partition) -> Iterator[tuple]:
        text = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
        for i, r in enumerate(self._rows(partition.number)):
            yield partition.number, i, {k: text(v) for k, v in r.items()}
