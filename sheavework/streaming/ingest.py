"""Structured Streaming jobs that write into folders with one sub-folder per micro-batch.

A batch always writes to ``<table>/run_no=<r>/batch_no=<n>`` and overwrites that folder, so a batch that is run again
after a failure leaves the same rows as one that ran once, and no batch of another run is touched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.chunks import text_chunks
from ..operators.spread import latest_per_key

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of a table folder, or None while nothing has been written."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" in str(problem) or "UNABLE_TO_INFER_SCHEMA" in str(problem):
            return None
        raise


def _write_batch(df: DataFrame, table: str, run_no: int, number: int) -> None:
    df.write.mode("overwrite").parquet(f"{table}/run_no={run_no}/batch_no={number}")


def _run(stream: DataFrame, table: str, checkpoint: str, each: Callable[[DataFrame, int], None], once: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


class FirstChunks(StatefulProcessor):
    """Lets the first chunk of every id through. State: the ids that have passed."""

    def __init__(self, columns: list[str]) -> None:
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "chunk_id string", "known boolean")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for chunk_id in initialState["chunk_id"]:
            self.seen.updateValue((chunk_id,), (True,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for frame in rows:  # of rows that share an id within a batch the first by text counts, in whatever order they come
            both = frame if best is None else pd.concat([best, frame])
            best = both.sort_values(["chunk_id", "text"], kind="stable").drop_duplicates("chunk_id")
        new = [not self.seen.containsKey((chunk_id,)) for chunk_id in best["chunk_id"]]
        fresh = best[new]
        for chunk_id in fresh["chunk_id"]:
            self.seen.updateValue((chunk_id,), (True,))
        yield fresh[self.columns]

    def close(self) -> None:
        pass


def _id_group(groups: int) -> Column:
    return F.pmod(F.xxhash64("chunk_id"), F.lit(groups)).cast("int").alias("id_group")


def stream_ingest(docs: DataFrame, table: str, checkpoint: str, run_no: int = 0, size: int = 300, once: bool = True, groups: int = 256) -> StreamingQuery:
    """Documents (source, kind, page, text) to chunks; a chunk id that is stored already is ignored.

    The ids that have passed are keyed state, on local disk and in the checkpoint, in ``groups`` groups by hash. A batch looks
    up its own ids there and never reads the stored chunks, so its time depends on its own size alone. ``run_no`` keeps the batches of
    separate runs with separate checkpoints apart; a run that starts takes the ids that earlier runs have stored into its
    state once. Runs that write to one table at the same time do not see each other's ids.
    """
    spark = docs.sparkSession
    chunks = text_chunks(docs, size)
    stored = read_stored(spark, table)
    known = spark.createDataFrame([], "chunk_id string") if stored is None else stored.where(F.col("run_no") != run_no).select("chunk_id")
    fresh = (
        chunks.select("*", _id_group(groups)).groupBy("id_group")
        .transformWithStateInPandas(FirstChunks(chunks.columns), chunks.schema, "Append", "None", known.select("*", _id_group(groups)).groupBy("id_group"))
    )
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS)
    try:  # the query keeps the settings that it is started with
        return _run(fresh, table, checkpoint, lambda batch, number: _write_batch(batch, table, run_no, number), once)
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)


def stream_append_messages(messages: DataFrame, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Messages are appended as they come; batch operators read the table."""
    writer = messages.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_catalog_upsert(entries: DataFrame, table: str, checkpoint: str, keys: Sequence[str], order: Sequence[Column],
                          run_no: int = 0, once: bool = True) -> StreamingQuery:
    """Keep every batch's last entry per key; ``current_catalog`` gives the last over all batches."""

    def each(batch: DataFrame, number: int) -> None:
        _write_batch(latest_per_key(batch, keys, order), table, run_no, number)

    return _run(entries, table, checkpoint, each, once)


def current_catalog(spark: SparkSession, table: str, keys: Sequence[str]) -> DataFrame:
    return latest_per_key(spark.read.parquet(table), keys, [F.col("run_no").desc(), F.col("batch_no").desc()]).drop("run_no", "batch_no")


def compact_catalog(spark: SparkSession, table: str, target: str, keys: Sequence[str]) -> DataFrame:
    """Write the current entries to a new folder and return it; readers move over when it is complete."""
    current_catalog(spark, table, keys).write.mode("errorifexists").parquet(f"{target}/run_no=0/batch_no=0")
    return spark.read.parquet(target)
