"""Writing results: layers, small reports, tables that must not exist yet, statistics that replace themselves."""

from __future__ import annotations

import json
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def layer(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """A materialised layer, overwritten as a whole; partitioned if asked."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def publish(df: DataFrame, path: str, columns: list[str]) -> None:
    """SNK-5: load a table in a stated column order; refuses one that is already there."""
    df.select(*columns).write.mode("errorifexists").parquet(path)


def bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """A table bucketed and sorted by its join key, so that later joins on it do not shuffle it."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def report_csv(df: DataFrame, path: str, most: int = 100_000) -> None:
    """SNK-2, SNK-6: a small result as one CSV file with header and plain line ends; raises beyond ``most`` rows."""
    rows = df.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write it as a layer")
    part = Path(path).with_suffix(".partiel")
    rows.to_csv(part, index=False, lineterminator="\n")
    part.replace(path)


def report_json(context: dict, measures: dict[str, tuple[str, DataFrame]], path: str, most: int = 1_000) -> None:
    """SNK-3: a nested report {contexte, mesures: {name: {question, duree_s, lignes: [rows]}}} of small results, and beside it
    the same as one flat CSV (mesure, ligne, colonne, valeur); raises beyond ``most`` rows of a measure."""
    out: dict = {"contexte": context, "mesures": {}}
    flat = ["mesure,ligne,colonne,valeur"]
    for n, (question, df) in measures.items():
        began = time.perf_counter()
        rows = [r.asDict(recursive=True) for r in df.limit(most + 1).collect()]
        if len(rows) > most:
            raise ValueError(f"more than {most} rows in {n}: write it as a layer")
        out["mesures"][n] = {"question": question, "duree_s": round(time.perf_counter() - began, 4), "lignes": rows}
        flat += [",".join(_field(x) for x in (n, k, c, v)) for k, r in enumerate(rows) for c, v in r.items()]
    for target, text in ((Path(path), json.dumps(out, ensure_ascii=False, indent=2, default=str) + "\n"), (Path(path).with_suffix(".csv"), "\n".join(flat) + "\n")):
        part = target.with_suffix(target.suffix + ".partiel")
        part.write_text(text, encoding="utf-8")
        part.replace(target)


def _field(x: object) -> str:
    t = "" if x is None else str(x)
    return '"' + t.replace('"', '""') + '"' if any(c in t for c in ',"\n') else t


def replace_rows(spark: SparkSession, path: str, rows: DataFrame, key: list[str]) -> None:
    """SNK-8: rows with a key that is there replace it, the others are added; readers see the old table or the new one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new = f"{path}.nouvelle-{uuid.uuid4().hex}"
    target, fresh, gone = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, new, f"{new}.ancienne"))
    fs = target.getFileSystem(conf)
    if fs.exists(target):
        rows = spark.read.schema(rows.schema).parquet(path).join(rows.select(*key), key, "left_anti").unionByName(rows)
    rows.write.parquet(new)
    if fs.exists(target):
        fs.rename(target, gone)
    fs.rename(fresh, target)
    fs.delete(gone, True)


def reload(df: DataFrame, path: str) -> None:
    """SNK-9: empties a table and fills it again."""
    df.write.mode("overwrite").parquet(path)


# ---- row stores ------------------------------------------------------------------------------

BATCH_ROWS = 50_000


def jdbc_read(spark: SparkSession, url: str, table: str, properties: dict[str, str] | None = None, split: tuple[str, int, int, int] | None = None) -> DataFrame:
    """SRC-12: a table of a row store; filters and columns go to the store.  split: (column, lowest, highest, partitions) reads in ranges."""
    if split is None:
        return spark.read.jdbc(url, table, properties=properties or {})
    column, low, high, parts = split
    return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=properties or {})


def jdbc_publish(df: DataFrame, url: str, table: str, columns: list[str], properties: dict[str, str] | None = None, writers: int = 8) -> None:
    """SNK-5: rows sent in batches of BATCH_ROWS in a stated column order; refuses a table that has rows."""
    try:
        filled = not jdbc_read(df.sparkSession, url, table, properties).isEmpty()
    except Exception:  # no such table yet
        filled = False
    if filled:
        raise ValueError(f"{table} has rows already")
    df.select(*columns).coalesce(writers).write.option("batchsize", BATCH_ROWS).jdbc(url, table, mode="append", properties=properties or {})
