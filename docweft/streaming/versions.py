"""A keyword index that follows documents as they change: postings by batch, marks of documents, compaction.

A stateful stream holds the number of each document's last version. A newer version gives its postings and a mark of
its document, a deleted document a mark alone (a tombstone). Postings hold as long as no later batch has a mark of
their document, so the index is that of a full build, whatever came twice, late or changed. ``compact`` writes what
holds into a base, after which the batches before are not read any more.

Below a folder lie ``deltas/batch=N`` (a batch that runs again overwrites its own), ``base/upto=N`` and the stream's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docweft.functions import text
from docweft.operators.keyword_index import Index
from docweft.operators.storage import listed, written

#: A posting; the one without a term marks the document itself, so that documents without terms count, too. Marks with sign -1 are tombstones.
POSTING = "doc_id long, term string, dl int, sign int"
_STATE = "version long, mark long"
#: Marks of replaced versions that are broadcast at most.
BROADCAST_MARKS = 1_000_000
_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def _latest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keeps the number of a document's newest version, and gives its text; of several with one number that with the greatest mark."""
    best = tuple(state.get) if state.exists else None
    found = None
    for rows in batches:
        for version, mark, content in zip(rows["version"], rows["mark"], rows["text"], strict=True):
            if best is None or (version, mark) > best:
                best, found = (int(version), int(mark)), (content,)
    if found is not None:
        state.update(best)
        yield pd.DataFrame([(int(key[0]), found[0])], columns=["doc_id", "text"])


def signed_postings(versions: DataFrame) -> DataFrame:
    """The changes that a stream of versions (``doc_id``, ``version``, ``text``) brings.

    A null text deletes its document; a version that is not newer than what is held changes nothing, and brings no
    deleted document back. Rows without id or version are no versions.
    """
    given = versions.filter("doc_id IS NOT NULL AND version IS NOT NULL")
    given = given.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("version").cast("long").alias("version"), F.xxhash64("text").alias("mark"), "text")
    newest = given.groupBy("doc_id").applyInPandasWithState(_latest, "doc_id long, text string", _STATE, "Append", GroupStateTimeout.NoTimeout)
    # texts are cut into terms behind the shuffle; null texts have none, and a tombstone
    terms = F.coalesce(text.index_keywords(F.col("text")), F.array().cast("array<string>"))
    rows = newest.select("doc_id", terms.alias("terms"), F.when(F.col("text").isNull(), -1).otherwise(1).alias("sign"))
    return rows.select("doc_id", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.col("terms"))).alias("term"), F.size("terms").alias("dl"), "sign")


def follow(stream: DataFrame, folder: str) -> StreamingQuery:
    """Takes what has arrived of a stream of versions into the index of a folder; called again, it goes on from there."""
    spark = stream.sparkSession

    def write(rows: DataFrame, batch: int) -> None:
        rows.sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{folder}/deltas/batch={batch}", compression="zstd")

    held = {name: spark.conf.get(name, None) for name in _CONF}
    try:
        for name, value in _CONF.items():
            spark.conf.set(name, value)
        writer = signed_postings(stream).writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint")
        query = writer.trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
        return query
    finally:
        for name, value in held.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _upto(spark: SparkSession, folder: str) -> int | None:
    """The last batch that a whole base holds."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/base")
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return None
    whole = [f.getPath() for f in files.listStatus(place) if "_SUCCESS" in listed(spark, f.getPath().toString())]
    return max((int(p.getName().split("=")[1]) for p in whole), default=None)


def live(spark: SparkSession, folder: str) -> DataFrame:
    """The postings that hold now (``doc_id``, ``term``, ``dl``), the documents' own without a term among them."""
    upto = _upto(spark, folder)
    deltas = spark.read.schema(f"{POSTING}, batch long").parquet(f"{folder}/deltas")
    rows = deltas.filter(F.col("batch") > (-1 if upto is None else upto))
    if upto is not None:
        rows = rows.unionByName(spark.read.schema(POSTING).parquet(f"{folder}/base/upto={upto}").withColumn("batch", F.lit(upto).cast("long")))
    marks = rows.filter("term IS NULL").select("doc_id", "batch")
    last = marks.groupBy("doc_id").agg(F.max("batch").alias("last"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # few against postings: only documents that came again
    gone = written(marks.join(last, "doc_id").filter("batch < last").select("doc_id", "batch"), "replaced")
    gone = F.broadcast(gone) if gone.limit(BROADCAST_MARKS + 1).count() <= BROADCAST_MARKS else gone
    return rows.join(gone, ["doc_id", "batch"], "left_anti").filter("sign > 0").select("doc_id", "term", "dl")


def compact(spark: SparkSession, folder: str) -> int | None:
    """Writes all that holds into a new base; the older one and the deltas stay until the caller removes them."""
    last = spark.read.schema(f"{POSTING}, batch long").parquet(f"{folder}/deltas").agg(F.max("batch")).first()[0]
    if last is None or last == _upto(spark, folder):
        return last
    whole = live(spark, folder).withColumn("sign", F.lit(1)).select("doc_id", "term", "dl", "sign").sortWithinPartitions("term", "doc_id")
    whole.write.mode("overwrite").parquet(f"{folder}/base/upto={last}", compression="zstd")
    return last


def document_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return live(spark, folder).filter("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df"))


def index(spark: SparkSession, folder: str) -> Index:
    """The keyword index as it stands, for ``keyword_index.bm25``."""
    now = live(spark, folder)
    stored = now.filter("term IS NOT NULL").select("term", "doc_id", "dl").sortWithinPartitions("term", "doc_id")
    totals = now.filter("term IS NULL").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl"))
    return Index("doc_id", written(stored, "versions-index", "zstd"), written(totals, "versions-totals"))
