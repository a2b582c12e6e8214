"""Exact deduplication by a stateful stream.

Documents arrive as rows (digest, id, length, where the content lies). A streaming aggregation keeps one entry for each
digest in state on disk that never expires: the stable identifier of the row that stays, the locator of the content that
came first and how many rows had the digest. Each micro-batch is combined on the map side before it meets the state, so a digest with a
third of all rows costs a row a task. Where a digest is hit again, the full normalised bytes decide: texts with one digest
but other bytes are told apart by their bytes.

The folder of a store holds arrivals, the stream's checkpoint (with the state's files) and the entries as they changed, batch by
batch. With the same folder later documents are compared with all earlier ones, also after a restart.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.llm.shared import counted_join, hint, shared_dir, written

#: Characters that do not count when texts are compared.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes of arrivals that one micro-batch reads.
BATCH_BYTES = 64 << 30
#: Digests that more rows have are compared in parts first.
OFTEN = 1_000
PARTS = 256

#: The state is kept by RocksDB, whose stores reserve no disk ahead and are closed once a batch is committed.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
#: ``run`` names the call that brought a row and ``number`` the row within it; both together name the row.
_ARRIVALS = "doc_id long, digest binary, n_chars long, run string, number long, file string, row long"
_BEST = "struct<n_chars: long, named: boolean, low_id: long, doc_id: long, run: string, number: long>"
_FIRST = "struct<run: string, number: long, file: string, row: long>"

Digest = Callable[[Column], Column]


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def normalised(text: Column) -> Column:
    """The text without blanks; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def _located(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and where the row lies: the file and the row in it. Rows that lie in no Parquet file are written first."""
    wanted = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    try:
        place = docs.metadataColumn("_metadata")
        return docs.select(*wanted, place["file_path"].alias("file"), place["row_index"].alias("row"))
    except AnalysisException:
        return _located(written(docs.select(*wanted), "contents"))


def _best() -> Column:
    """Orders rows of a digest: most code points, then an id before none, the least id, and any one of what is left."""
    return F.struct("n_chars", F.col("doc_id").isNotNull().alias("named"), F.bitwise_not("doc_id").alias("low_id"), "doc_id", "run", "number")


def arrive(docs: DataFrame, folder: str, digest: Digest = sha256) -> tuple[DataFrame, str]:
    """Appends the rows of ``docs`` to the store's arrivals; returns their normalised texts with digests, and the run."""
    texts = _located(docs).withColumn("normal", normalised(F.col("text"))).withColumn("digest", digest(F.col("normal")))
    run = f"{time.time_ns():020d}-{uuid.uuid4().hex}"  # later runs have greater names
    n_chars = F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars")
    rows = texts.select("doc_id", "digest", n_chars, F.lit(run).alias("run"), F.monotonically_increasing_id().alias("number"), "file", "row")
    rows.write.mode("append").parquet(f"{folder}/arrivals")
    return texts.select("digest", "normal"), run


def remember(spark: SparkSession, folder: str) -> None:
    """Streams the arrivals that were not read yet through the keyed state; every changed entry is written under its batch.

    A batch that runs again after a failure overwrites what it wrote before.
    """
    stream = spark.readStream.schema(_ARRIVALS).option("maxBytesPerTrigger", str(BATCH_BYTES)).parquet(f"{folder}/arrivals")
    state = stream.groupBy("digest").agg(F.max(_best()).alias("best"), F.min(F.struct("run", "number", "file", "row")).alias("first"), F.count("*").alias("n"))

    def changed(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/entries/batch={batch}")

    held = {name: spark.conf.get(name, None) for name in _STATE}
    try:
        for name, value in _STATE.items():
            spark.conf.set(name, value)
        writer = state.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint")
        writer.trigger(availableNow=True).foreachBatch(changed).start().awaitTermination()
    finally:
        for name, value in held.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """The state's entries: ``digest``, ``best`` (the row that stays), ``first`` (where the first content lies), ``n`` rows."""
    rows = spark.read.schema(f"digest binary, best {_BEST}, first {_FIRST}, n long, batch long").parquet(f"{folder}/entries")
    return rows.groupBy("digest").agg(F.max(F.struct("batch", "best", "first", "n")).alias("last")).select("digest", "last.best", "last.first", "last.n")


def contents(places: DataFrame) -> DataFrame:
    """``places`` (with ``file`` and ``row``) and the normalised texts that lie there; only files that are named are read."""
    spark = places.sparkSession
    files = [r["file"] for r in places.select("file").distinct().toLocalIterator()]
    if not files:
        return places.withColumn("normal", F.lit(None).cast("string"))
    held = spark.read.parquet(*files)
    meta = held.metadataColumn("_metadata")
    texts = held.select(meta["file_path"].alias("file"), meta["row_index"].alias("row"), normalised(F.col("text")).alias("normal"))
    return texts.join(hint(places), ["file", "row"])


def unequal(texts: DataFrame, hits: DataFrame) -> DataFrame:
    """The digests of ``hits`` (``digest``, ``n`` rows) whose ``texts`` (``digest``, ``normal``) are not all the same bytes.

    Texts are the same if the least and the greatest of them are. Each task compares what it has read, so of a
    digest one pair a task is shuffled; digests that many rows have are first compared in parts.
    """
    many = F.col("n") > OFTEN
    part = F.when(many, F.pmod(F.spark_partition_id(), F.lit(PARTS))).otherwise(F.lit(0))
    pairs = texts.join(hint(hits), "digest").select("digest", "normal", many.alias("many"), part.alias("part"))
    pairs = pairs.groupBy("digest", "many", "part").agg(F.min("normal").alias("low"), F.max("normal").alias("high"))
    # of parts that are all one text, nothing has to be kept but for digests that have several parts
    pairs = written(pairs.filter(F.col("many") | (F.col("low") < F.col("high"))), "compared")
    whole = pairs.filter("many").groupBy("digest").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return pairs.select("digest", "low", "high").unionByName(whole).filter("low < high").select("digest").distinct()


def deduplicate(docs: DataFrame, folder: str | None = None, digest: Digest = sha256) -> DataFrame:
    """One row for every row that has arrived in the store of ``folder``, ``docs`` included.

    Texts are equal if they are identical without ``BLANKS``. Of equal texts the row with the most code points stays,
    then the one with the least ``doc_id``. ``keep_id`` is its id, ``group_size`` the number of rows with that text,
    ``kept`` whether the row is the one that stays, ``digest`` the digest of the normalised text.

    Null texts are empty, and texts of blanks equal them. Rows without an id stay only if no row of their text and
    length has one; of rows equal in text, length and id exactly one stays. Texts of any length are compared whole.
    Further columns are ignored, whatever their names. An empty table adds nothing. Without ``folder`` the store is a
    new one. Rows count as often as they are handed over; what a failed call has written stays in the store.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    texts, run = arrive(docs, folder, digest)
    remember(spark, folder)
    arrivals, found = spark.read.schema(_ARRIVALS).parquet(f"{folder}/arrivals"), written(entries(spark, folder), "entries")
    hits = found.filter("n > 1")
    # content of earlier runs is read where its locator says
    earlier = hits.filter(F.col("first.run") < run).join(arrivals.filter(F.col("run") == run), "digest", "left_semi")
    earlier = written(earlier.select("digest", "first.file", "first.row"), "earlier")
    if not earlier.isEmpty():
        texts = texts.unionByName(contents(earlier).select("digest", "normal"))
    unequal(texts, hits.select("digest", "n")).write.mode("append").parquet(f"{folder}/unequal")
    odd = spark.read.schema("digest binary").parquet(f"{folder}/unequal").distinct()
    table = found.select("digest", "best", "n")
    if odd.isEmpty():
        rows = counted_join(arrivals, table, "digest")
    else:
        # their bytes tell these texts apart, not their digests
        apart = written(contents(arrivals.join(odd, "digest")), "apart")
        groups = written(apart.groupBy("normal").agg(F.max(_best()).alias("best"), F.count("*").alias("n")), "groups")
        rows = counted_join(arrivals.join(odd, "digest", "left_anti"), table, "digest").unionByName(counted_join(apart, groups, "normal").drop("normal"), allowMissingColumns=True)
    kept = (F.col("run") == F.col("best.run")) & (F.col("number") == F.col("best.number"))
    return rows.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), "digest")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """The decisions on all rows of ``docs``, with the SHA-256 of each normalised text as hex text."""
    return deduplicate(docs).withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


ORACLE_SQL = r"""
WITH normal AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
ranked AS (
    SELECT *, row_number() OVER best AS place, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
    FROM normal WINDOW best AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM ranked
"""
