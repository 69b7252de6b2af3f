"""The daily batch as a stream of files, with the keys of all stored articles as its state.

A row is known if its URL or its content hash is that of a stored row. Both keys are looked up
in keyed state (RocksDB), so a micro-batch touches the keys that it brings and never reads the
store. Only keys of rows that were stored count, and which rows those are is settled after the
look-up; so every batch puts the keys it stored into a folder that the stream reads as its
second source, and the next run has them in its state.

Rows, run and batch number are one commit of the store: a batch that failed is done again from
its own files, and one that was committed is not stored twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.articles import keyword_pass, normalize
from ..operators.dedup import drop_reposts, new_articles
from ..plans.versions import Store

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Known(StatefulProcessor):
    """Whether a key is stored. Rows with kept set say so; all others ask, and get the answer."""

    def init(self, handle) -> None:
        self._kept = handle.getValueState("kept", "kept boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rows = list(rows)
        known = self._kept.exists()
        if not known and any(r.kept for r in rows):
            self._kept.update((True,))
            known = True
        for r in rows:
            if not r.kept:
                yield Row(row=r.row, known=known)

    def close(self) -> None:
        pass


def _new(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose URL and hash neither the stored table nor an earlier row that stays has; a null is nobody else's."""
    own = lambda c: F.coalesce(F.col(c), F.concat(F.lit("\0"), F.col("ord").cast("string")))
    keys = rows.select("ord", own("url").alias("url"), own("content_hash").alias("content_hash"))
    return rows.join(new_articles(keys, stored).select("ord"), "ord", "left_semi")


def fresh_only(batch: DataFrame) -> DataFrame:
    """Rows (with ord, url, content_hash) that neither the store (`known`) nor an earlier row of the batch has."""
    return _new(batch.filter("NOT known"), batch.limit(0).select("url", "content_hash"))


def ingest(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """New articles of a batch (with ord) against a stored table, marked with kw_pass."""
    return _marked(_new(_prepared(batch), stored))


def _prepared(batch: DataFrame) -> DataFrame:
    return drop_reposts(normalize(batch)).drop("title_hash")


def _marked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("kw_pass", keyword_pass(F.col("title_original"), F.col("text_original")))


def run(spark: SparkSession, source: str, schema: str, root: str, checkpoint: str, table: str = "articles", step: Callable[[DataFrame], DataFrame] | None = None) -> Store:
    """Take all new files of `source` (JSON, rows with an ord of their own), append what is new to a table of the store at `root`, and stop.

    step: what is done to a batch that says which of its rows are known (default: reposts go,
    then known rows, then later ones of equal URL or hash; kw_pass is marked). Rows without a
    URL or a hash are never known by it. An empty file changes nothing.
    """
    store = Store(spark, root)
    keys = f"{root}/keys"
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path
    fs = jpath(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(jpath(f"{keys}/none"))
    step = step or (lambda batch: _marked(fresh_only(drop_reposts(batch).drop("title_hash"))))

    rows = normalize(spark.readStream.schema(schema).json(source))
    packed = F.struct(*rows.columns)
    none = F.concat(F.lit("o:"), F.col("ord").cast("string"))
    both = F.array(F.coalesce(F.concat(F.lit("u:"), "url"), none), F.coalesce(F.concat(F.lit("h:"), "content_hash"), none))
    asked = rows.select(F.explode(both).alias("key"), packed.alias("row"), F.lit(False).alias("kept"))
    told = spark.readStream.schema("key string").parquet(f"{keys}/*").select("key", F.lit(None).cast(asked.schema["row"].dataType).alias("row"), F.lit(True).alias("kept"))
    answers = asked.unionByName(told).groupBy("key").transformWithState(Known(), f"row {asked.schema['row'].dataType.simpleString()}, known boolean", "append", "None")

    def one(answered: DataFrame, batch_id: int) -> None:
        s = answered.sparkSession
        name = f"b{batch_id:010d}"
        staged, final = jpath(f"{root}/keys-staged/{name}"), jpath(f"{keys}/{name}")
        if fs.exists(final):
            return
        if store.entry()["notes"].get("batch", -1) < batch_id:
            # the batch before this one may have been done again by this run, after its sources were listed
            late = [p for p in (f"{keys}/b{batch_id - i:010d}" for i in (1, 2)) if fs.exists(jpath(p))]
            recent = s.read.schema("key string").parquet(*late) if late else s.createDataFrame([], "key string")
            seen = answered.groupBy("row.ord").agg(F.first("row").alias("row"), F.max("known").alias("known")).select("row.*", "known")
            for prefix, column in (("u:", "url"), ("h:", "content_hash")):
                own = recent.select(F.col("key").alias("_k"), F.lit(True).alias("_late")).filter(F.col("_k").startswith(prefix)).distinct()
                seen = seen.join(own, F.concat(F.lit(prefix), F.col(column)) == F.col("_k"), "left").withColumn("known", F.col("known") | F.coalesce("_late", F.lit(False))).drop("_k", "_late")
            path = f"{root}/fresh/{name}"
            step(seen).drop("known").write.mode("overwrite").parquet(path)  # the answers are taken from the state once
            new = s.read.parquet(path)
            new.select(F.explode(F.array(F.concat(F.lit("u:"), "url"), F.concat(F.lit("h:"), "content_hash"))).alias("key")).filter("key IS NOT NULL").distinct().write.mode("overwrite").parquet(staged.toString())
            store.commit(append={table: new}, notes={"batch": batch_id})
        if not fs.rename(staged, final):
            raise OSError(f"the keys of batch {batch_id} could not be put in place")

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        answers.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return store
