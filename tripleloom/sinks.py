"""Where statements go: N-Triples and N-Quads files, a folder per mapping group, Kafka, tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import FORMATS
from .engine import Engine


def _lines(df: DataFrame, quads: bool) -> DataFrame:
    return df.select(F.concat(F.concat_ws(" ", "s", "p", "o", *(["g"] if quads else [])), F.lit(" .")).alias("value"))


def _fs(engine: Engine, path: str):
    jvm = engine.spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(engine.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def write_folder(engine: Engine, path: str, compression: str = "none") -> None:
    """Part files written by all tasks at once; the way to write large graphs."""
    quads = engine.config.output_format == "N-QUADS"
    df = engine.quads() if quads else engine.triples().withColumn("g", F.lit(None).cast("string"))
    _lines(df, quads).write.mode("overwrite").option("compression", compression).text(path)


def write_file(engine: Engine, path: str | None = None) -> str:
    """One file. Tasks write parts, which are then put together by the file system, so no task or driver holds the graph."""
    path = path or engine.config.output_path
    parts = f"{path}._parts"
    write_folder(engine, parts)
    target, fs, of = _fs(engine, path)
    out = fs.create(target, True)
    jvm = engine.spark.sparkContext._jvm
    try:
        for s in sorted(fs.listStatus(of(parts)), key=lambda s: s.getPath().getName()):
            if s.getPath().getName().startswith("part-"):
                src = fs.open(s.getPath())
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(src, out, 1 << 16, False)
                finally:
                    src.close()
    finally:
        out.close()
    fs.delete(of(parts), True)
    return path


def write_groups(engine: Engine, path: str | None = None, at_once: int = 4) -> list[str]:
    """A folder of files for each mapping group below path, which is emptied first; several groups are written at a time."""
    path = (path or engine.config.output_dir).rstrip("/")
    target, fs, _ = _fs(engine, path)
    fs.delete(target, True)
    quads = engine.config.output_format == "N-QUADS"

    def write(item) -> str:
        name, df = item
        if not quads:
            df = df.select("s", "p", "o").dropDuplicates().withColumn("g", F.lit(None).cast("string"))
        to = f"{path}/{name}{FORMATS[engine.config.output_format]}"
        _lines(df, quads).write.mode("overwrite").text(to)
        return to

    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(write, list(engine.by_group())))


def kafka_rows(engine: Engine) -> DataFrame:
    """(key, value): a message per statement, keyed by subject so that an entity's statements keep their order."""
    quads = engine.config.output_format == "N-QUADS"
    df = engine.quads() if quads else engine.triples().withColumn("g", F.lit(None).cast("string"))
    return df.select(F.col("s").alias("key"), F.concat(F.concat_ws(" ", "s", "p", "o", *(["g"] if quads else [])), F.lit(" .")).alias("value"))


def write_kafka(engine: Engine) -> None:
    c = engine.config
    if not c.output_kafka_server or not c.output_kafka_topic:
        raise ValueError("output_kafka_server and output_kafka_topic are needed")
    kafka_rows(engine).write.format("kafka").option("kafka.bootstrap.servers", c.output_kafka_server).option("topic", c.output_kafka_topic).save()


def write(engine: Engine) -> None:
    """By the configuration: to Kafka, a folder of groups, or a file."""
    if engine.config.output_kafka_server:
        write_kafka(engine)
    elif engine.config.output_dir:
        write_groups(engine)
    else:
        write_file(engine)
