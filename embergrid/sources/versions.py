"""Published tables as versions with a commit log, so readers never see a half-written one.

A publish writes a folder of its own, ``data/version=<id>``, which no reader knows yet. Only when all
its files are there does one small file in ``commits`` name it, for all its layers at once. Readers take
the last commit of each layer. A write that breaks off, a lost executor or a repeated attempt leaves a
folder that no commit names; the old version stays readable, also to a frame that is being read from
the table while it is published again.

The log is a table of its own, written by Spark's commit protocol, which shows a file whole or not at
all. One publisher per layer at a time is meant; of two at once, the last commit counts as a whole.
Old versions stay until they are removed; ``superseded`` lists them.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from embergrid.schemas import COMMITS

_PLACED = "layer"


def commits(spark: SparkSession, path: str) -> DataFrame:
    """All commits of a published table: ``layer, seq, version, ok, error, rows``."""
    log = spark.read.schema(COMMITS).option("pathGlobFilter", "*.json")
    return log.json(_log(spark, path))


def _log(spark: SparkSession, path: str) -> str:
    """Folder of the log, which a first commit without a layer opens."""
    log = f"{path}/commits"
    try:
        spark.read.schema(COMMITS).json(log)
    except Exception as error:
        if getattr(error, "getCondition", lambda: None)() != "PATH_NOT_FOUND":
            raise
        spark.createDataFrame([], COMMITS).coalesce(1).write.mode("append").json(log)
    return log


def _latest(commits_of_layer: DataFrame) -> DataFrame:
    names = [name for name in commits_of_layer.columns if name != "layer"]
    newest = F.max_by(F.struct(*names), F.struct("seq", "version")).alias("newest")
    return commits_of_layer.groupBy("layer").agg(newest).select("layer", "newest.*")


def current(spark: SparkSession, path: str) -> DataFrame:
    """The commit that counts, for each layer."""
    return _latest(commits(spark, path))


def superseded(spark: SparkSession, path: str, keep: int = 2) -> DataFrame:
    """Folders ``version`` of which no layer is among its ``keep`` newest commits, to be removed."""
    log = commits(spark, path)
    newer = log.groupBy("layer").agg(F.sort_array(F.collect_set("seq"), asc=False).alias("seqs"))
    kept = F.get("seqs", F.lit(keep - 1))
    used = F.max(kept.isNull() | (F.col("seq") >= kept)).alias("used")
    return log.join(newer, "layer").groupBy("version").agg(used).where(~F.col("used")).select("version")


def new_version() -> str:
    return uuid.uuid4().hex


def data_folder(path: str, version: str) -> str:
    return f"{path}/data/version={version}"


def commit(spark: SparkSession, path: str, version: str, states: Sequence[tuple[str, bool, str | None, int]]) -> None:
    """Names a whole version as the current one of its layers: ``layer, ok, error, rows`` each.

    One row per layer passes the driver, and one file is written.
    """
    log = _log(spark, path)
    layers = [state[0] for state in states]
    last = commits(spark, path).where(F.col("layer").isin(layers)).agg(F.max("seq")).first()[0]
    seq = (last or 0) + 1
    rows = [(layer, seq, version, ok, error, count) for layer, ok, error, count in states]
    spark.createDataFrame(rows, COMMITS).coalesce(1).write.mode("append").json(log)


def publish(df: DataFrame, path: str, layers: Sequence[str], text: bool = False) -> None:
    """Writes rows with a ``layer`` column as a new version and makes it the current one of ``layers``.

    A layer without rows ends empty, and layers that are not named stay as they are. The counts come
    from the write itself, so ``df`` runs once.
    """
    spark, version = df.sparkSession, new_version()
    seen = Observation()
    metrics: list[Column] = [F.count_if(F.col(_PLACED) == layer).alias(f"n{at}") for at, layer in enumerate(layers)]
    writer = df.where(F.col(_PLACED).isin(*layers)).observe(seen, *metrics).write.partitionBy(_PLACED)
    folder = data_folder(path, version)
    writer.text(folder) if text else writer.parquet(folder)
    counts = seen.get
    commit(spark, path, version, [(layer, True, None, counts[f"n{at}"]) for at, layer in enumerate(layers)])


def read(spark: SparkSession, path: str, schema: str, text: bool = False) -> DataFrame:
    """All current layers of a table written by ``publish``, as one scan of their folders.

    ``layer`` is a partition column, so filters on it choose folders, and others reach the files.
    """
    # One row per layer.
    rows = current(spark, path).where("rows > 0").select("layer", "version").collect()
    folders = [f"{data_folder(path, row['version'])}/layer={row['layer']}" for row in rows]
    if not folders:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema).option("basePath", f"{path}/data")
    return reader.text(folders) if text else reader.parquet(*folders)
