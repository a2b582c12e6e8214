"""Helpers that several training-data operators share: the shared folder, written tables, size checks and ordered ranges."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A table is broadcast only when its checked size is at most this many rows.
BROADCAST_ROWS = 100_000


#: Bytes of rows handed to a Python worker at once, at most: texts and word lists vary too much in size to be counted in rows.
BATCH_BYTES = 1 << 21
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, which worker and executor hold several times over, unless they are smaller yet."""
    held = re.fullmatch(r"(\d+)b?", spark.conf.get(_BATCH))
    if not held or not 0 < int(held[1]) <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The session's ``spark.checkpoint.dir`` names it; a local temporary folder is taken (and set) only
    where that setting is absent and Spark runs in one process, as in tests. What is written there is left for the
    cluster's own clearing of that folder, as results may be read from it later.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        place = "file://" + tempfile.mkdtemp(prefix="docweft-shared-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Removes the files of a ``written`` table that nothing will read again."""
    spark = table.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of ``df`` has, whatever the case of letters."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in wanted:
        while (name := f"_{name}").lower() in taken:
            pass
        taken.add(name.lower())
        found.append(name)
    return found


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than that many and one."""
    return df.limit(rows + 1).count() <= rows


def hint(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its checked size allows, otherwise as it is (Spark then shuffles)."""
    return F.broadcast(df) if small(df, rows) else df


def counted_join(rows: DataFrame, table: DataFrame, key: str, count: str = "n") -> DataFrame:
    """``rows`` joined with a ``table`` that has one row for each ``key`` and tells how many of ``rows`` have it.

    Keys of many rows are handed out by broadcast, so that no task gets all rows of one; the least number that makes
    a key such a one is raised until its checked size allows the broadcast.
    """
    for most in (1_000, 100_000, 10_000_000):
        often = table.filter(F.col(count) > most)
        if small(often):
            if often.isEmpty():
                break
            seldom = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(table.filter(F.col(count) <= most), key)
            return seldom.unionByName(rows.join(F.broadcast(often), key))
    return rows.join(table, key)


def crc_part(doc_id: str = "doc_id", parts: int = 4) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % F.lit(parts)


def ranges(df: DataFrame, key: str, parts: int) -> Column:
    """A column with the ordered range (0, 1, ...) of ``key``; quantiles of the keys are the range bounds.

    Only the at most ``parts`` bounds reach the driver. Equal keys share a range; null keys are in range 0.
    A binary search over the bounds, about log2(parts) steps a row, finds the range.
    """
    at = [i / parts for i in range(1, parts)]
    bounds = sorted(set(df.approxQuantile(key, at, 0.25 / parts) if at else []))
    if not bounds:
        return F.lit(0)
    kind = dict(df.dtypes)[key]
    cuts = F.array(*[F.lit(b).cast(kind) for b in bounds])
    steps = F.sequence(F.lit(0), F.lit(len(bounds).bit_length() - 1))
    low = F.lit(0)
    high = F.lit(len(bounds))
    found = F.aggregate(
        steps,
        F.struct(low.alias("low"), high.alias("high")),
        lambda at, _: F.struct(
            F.when((at.low < at.high) & (F.col(key) >= F.try_element_at(cuts, _mid(at) + 1)), _mid(at) + 1).otherwise(at.low).alias("low"),
            F.when((at.low < at.high) & ~(F.col(key) >= F.try_element_at(cuts, _mid(at) + 1)), _mid(at)).otherwise(at.high).alias("high"),
        ),
    ).low
    return F.when(F.col(key).isNull(), F.lit(0)).otherwise(found)


def _mid(at: Column) -> Column:
    return F.floor((at.low + at.high) / 2).cast("int")


def with_next(df: DataFrame, key: str, columns: list[str], parts: int) -> DataFrame:
    """Adds ``next_<column>`` from the following row in ascending order of ``key``; after the last row comes the first.

    Rows are dealt to ``parts`` ordered ranges, so no window spans the whole table. The first row of each
    range, at most ``parts`` rows in all, is handed to the range before it. Rows with equal keys follow one
    another in the order of a hash of the columns.
    """
    df = df.withColumn("_range", ranges(df, key, parts))
    order = [F.col(key).asc_nulls_first(), *[F.xxhash64(F.col(c)) for c in columns]]
    within = Window.partitionBy("_range").orderBy(*order)
    packed = F.struct(*columns)
    dealt = df.withColumn("_following", F.lead(packed).over(within)).withColumn("_first", F.row_number().over(within) == 1)
    first = dealt.filter("_first").select(F.col("_range"), packed.alias("_head"))
    # one row a range: this window is over at most `parts` rows
    links = first.select("_range").withColumn("_before", F.lag("_range").over(Window.orderBy("_range")))
    last = first.agg(F.max("_range").alias("_last"))
    links = links.join(F.broadcast(last)).select("_range", F.coalesce("_before", "_last").alias("_before"))
    heads = first.join(links, "_range").select(F.col("_before").alias("_range"), "_head")
    joined = dealt.join(heads, "_range", "left")
    following = F.when(F.col("_following").isNotNull(), F.col("_following")).otherwise(F.col("_head"))
    return joined.select(*df.drop("_range").columns, *[following[c].alias(f"next_{c}") for c in columns])
