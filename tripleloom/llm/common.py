"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
ROOT = str(Path(__file__).resolve().parents[2])


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary one if everything runs in one process (master ``local[...]``, as in tests); on a cluster an error, for no folder of one machine would do."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        where = _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="tripleloom-"))
    return where.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lost executors cost no recomputation beyond it, and it is computed once."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df with a number for each row, written once so that the numbers hold, and the name of their column. Rows are told apart by it where ids are null or shared."""
    number = fresh("number", df.columns)
    return cut(df.withColumn(number, F.monotonically_increasing_id()), name), number


def forget(df: DataFrame) -> None:
    """Delete a table that cut() wrote, once nothing will read it again."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and keep Arrow batches of long texts small."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    for name, value in (("OMP_NUM_THREADS", "1"), ("RAYON_NUM_THREADS", "1"), ("TOKENIZERS_PARALLELISM", "false")):  # one task, one core
        env.setdefault(name, value)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(name: str, taken: list[str]) -> str:
    """name, with underscores before it until no column in taken has it."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def words(text: str | None) -> list[str]:
    """Lower-case word tokens; none for null."""
    return WORD.findall(text.lower()) if text else []
