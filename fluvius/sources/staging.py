"""Staged answers and mosaics: tables under a shared root by source and key, written once and read again.

A table is written beside its place and moved there when complete, with a JSON document of what it holds, so a job that is lost
leaves nothing that looks finished. Counters tell how much a session has written.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from fluvius.operators.history import key_for

COUNTERS = {"tables": 0, "bytes": 0}


def reset() -> None:
    COUNTERS.update(tables=0, bytes=0)


class Stage:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, text: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(text)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def place(self, source: str, request: dict) -> str:
        return f"{self.root}/{source}/{key_for(request)}"

    def get(self, source: str, request: dict) -> DataFrame | None:
        """The table of a request, None where it is not staged or has no files."""
        fs, path = self._path(f"{self.place(source, request)}/_SUCCESS")
        return self.spark.read.parquet(self.place(source, request)) if fs.exists(path) else None

    def put(self, df: DataFrame, source: str, request: dict, by: list[str] | None = None) -> DataFrame:
        """Write a request's table (in folders by the columns ``by``, such as a raster's row of tiles) and read it again."""
        place = self.place(source, request)
        part = f"{place}.part-{uuid.uuid4().hex}"
        (df.write.partitionBy(*by) if by else df.write).parquet(part)
        fs, done = self._path(place)
        _, made = self._path(part)
        size = fs.getContentSummary(made).getLength()
        fs.delete(done, True)
        fs.mkdirs(done.getParent())
        if not fs.rename(made, done):
            raise OSError(f"could not move {part} to {place}")
        _, beside = self._path(f"{place}.meta.json")
        out = fs.create(beside, True)
        out.write(bytearray(json.dumps({**request, "bytes": size, "cached_at": time.strftime("%Y-%m-%dT%H:%M:%S")}, indent=1, default=str).encode()))
        out.close()
        COUNTERS["tables"] += 1
        COUNTERS["bytes"] += size
        return self.spark.read.parquet(place)

    def through(self, source: str, request: dict, make) -> DataFrame:
        """The staged table, made first where there is none."""
        found = self.get(source, request)
        return found if found is not None else self.put(make(), source, request)
