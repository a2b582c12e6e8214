"""Written intermediate tables for iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_place(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir`` (a local one only where that is unset)."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        place = "file://" + tempfile.mkdtemp(prefix="docweft-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, by the session's compression or the given one."""
    path = f"{shared_place(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def listed(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files of a table: another text once the table is written anew."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
    return repr(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


def discard(table: DataFrame) -> None:
    """Removes the files of a written table that nothing will read again."""
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        remove(table.sparkSession, folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Removes a folder with all that is in it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
