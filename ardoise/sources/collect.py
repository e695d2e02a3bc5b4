"""Collecting raw files: lookup tables, JSON lines, the latest of dated files, paged APIs, manifest, fingerprints."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

LOOKUP = "code string, libelle string, libelle_court string"
MANIFEST = "jour string, source string, fichier string, octets long, sha256 string, lignes long, url string, collecte_a string"
PAGE_SIZE = 100
RETRY_STATUS = frozenset({429, 500, 502, 503, 504})


def lookup(spark: SparkSession, path: str) -> DataFrame:
    """SRC-4: a CSV dimension with header; raises if it is absent or empty of rows."""
    df = spark.read.csv(path, header=True, schema=LOOKUP, enforceSchema=False)
    if df.isEmpty():
        raise FileNotFoundError(path)
    return df


def json_lines(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """One document a line; without a schema the raw text, so that nothing is inferred or lost."""
    return spark.read.schema(schema).json(path) if schema is not None else spark.read.text(path).withColumnRenamed("value", "document")


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """SRC-14: words of a text file, one a line; lines beginning with # are comments."""
    return spark.read.text(path).select(F.trim("value").alias("mot")).filter((F.col("mot") != "") & ~F.startswith(F.col("mot"), F.lit("#")))


def latest(spark: SparkSession, pattern: str) -> str:
    """SRC-5: the last file of a glob by name; raises if there is none."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    names = sorted(str(f.getPath()) for f in found or [])
    if not names:
        raise FileNotFoundError(pattern)
    return names[-1]


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(fichier, octets, sha256) of files, read on the executors."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("fichier"), F.col("length").alias("octets"), F.sha2("content", 256).alias("sha256"))


def upsert_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """One entry per day and source, the new one replacing the old."""
    return old.join(new.select("jour", "source"), ["jour", "source"], "left_anti").unionByName(new).orderBy("jour", "source")


def resource(catalogue: DataFrame, title: str) -> str:
    """SRC-9: the address of the resource of a catalogue (titre, url) with exactly this title; raises if there is none."""
    found = catalogue.filter(F.col("titre") == title).agg(F.min("url")).first()[0]
    if found is None:
        raise LookupError(title)
    return found


def verify(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """Manifest entries with ``intact``: whether the file is there with the same fingerprint."""
    seen = actual.select("fichier", F.col("sha256").alias("_vu"))
    return manifest.join(seen, "fichier", "left").withColumn("intact", F.coalesce(F.col("_vu") == F.col("sha256"), F.lit(False))).drop("_vu")


def with_retry(call: Callable[[], object], attempts: int = 4, wait: Callable[[float], None] = time.sleep) -> object:
    """Call again after 1, 2, 4 ... seconds on errors that may pass (a ``status`` in RETRY_STATUS, or no status); never on others."""
    for k in range(attempts):
        try:
            return call()
        except Exception as e:
            status = getattr(e, "status", getattr(e, "code", None))
            if k == attempts - 1 or (status is not None and status not in RETRY_STATUS):
                raise
            wait(2.0**k)
    raise AssertionError("unreachable")


def pages(fetch: Callable[[int, int], list[dict]], most: int | None = None, size: int = PAGE_SIZE) -> Iterator[dict]:
    """Rows of a paged API until the first empty page or ``most`` rows."""
    offset = 0
    while most is None or offset < most:
        rows = with_retry(lambda: fetch(offset, size))
        if not rows:
            return
        for r in rows[: None if most is None else most - offset]:
            yield r
        offset += size


class _Lane(InputPartition):
    def __init__(self, first: int):
        self.first = first


class _PageReader(DataSourceReader):
    def __init__(self, fetch: Callable[[int, int], list[dict]], lanes: int, size: int):
        self.fetch, self.lanes, self.size = fetch, lanes, size

    def partitions(self) -> list[InputPartition]:
        return [_Lane(k) for k in range(self.lanes)]

    def read(self, partition: _Lane) -> Iterator[tuple]:
        page = partition.first
        while rows := with_retry(lambda: self.fetch(page * self.size, self.size)):
            for r in rows:
                yield (json.dumps(r, ensure_ascii=False, default=str),)
            page += self.lanes


def paged_source(name: str, fetch: Callable[[int, int], list[dict]], lanes: int = 4, size: int = PAGE_SIZE) -> type[DataSource]:
    """A Spark data source over a paged API whose number of rows is not known.

    The executors fetch in ``lanes``: lane k takes pages k, k + lanes, ... until its first empty page.
    What the service is to filter, ``fetch(offset, size)`` asks of it.  Register with
    ``spark.dataSource.register(...)``, then ``spark.read.format(name).load()``.
    """

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "document string"

        def reader(self, schema: StructType) -> DataSourceReader:
            return _PageReader(fetch, lanes, size)

    return Paged
