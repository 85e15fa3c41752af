"""Structured Streaming forms of page watching and of the forward filter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from weft.functions.text import strip_tags
from weft.operators.hmm import Model, scaled, unit
from weft.session import scratch_path
from weft.sources.html import contains_text_watch


def file_stream(spark: SparkSession, folder: str, schema, glob: str = "*.parquet", files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as they appear, a bounded number per micro-batch."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    )


def page_watch_stream(pages: DataFrame, key: str, url: str, html: str, term: str, seen: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Alerts for pages that contain a term, one per URL.

    With an event-time column ``seen`` a URL is remembered for ``delay``, so the state stays
    bounded; without it URLs are kept for the life of the stream.
    """
    if seen is None:
        return contains_text_watch(pages, key, url, html, term).dropDuplicates([url])
    hits = pages.withWatermark(seen, delay).filter(F.contains(strip_tags(F.col(html)), F.lit(term)))
    return hits.select(key, url, seen, F.lit(term).alias("term")).dropDuplicatesWithinWatermark([url])


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything there is, write parquet, stop.

    State goes to RocksDB, so keys may outgrow executor memory; the session's own setting of
    the provider is put back once the query has started.
    """
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKSDB)
    try:
        query = (
            stream.writeStream.outputMode(mode).format("parquet").option("path", out)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        try:
            query.awaitTermination()
        finally:
            query.stop()
    finally:
        conf.unset(PROVIDER) if before is None else conf.set(PROVIDER, before)


def run_to_table(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    out, checkpoint = scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")
    run_available(stream, out, checkpoint)
    return spark.read.schema(stream.schema).parquet(out)


def closing(spark: SparkSession, schema) -> tuple[DataFrame, str]:
    """A stream of ``schema`` that is empty until ``run_closed`` writes its one row, and its folder."""
    folder = scratch_path(spark, "closing")
    spark.createDataFrame([], schema).write.parquet(folder)
    return file_stream(spark, folder, schema), folder


def run_closed(spark: SparkSession, stream: DataFrame, name: str, folder: str, last: DataFrame) -> DataFrame:
    """The stream's result over a finite input: run, write ``last`` (a late time) to the closing ``folder``, run on from the checkpoint.

    The second run's watermark passes all event times, so the state gives out what it holds.
    """
    out, checkpoint = scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")
    run_available(stream, out, checkpoint)
    last.coalesce(1).write.mode("append").parquet(folder)
    run_available(stream, out, checkpoint)
    return spark.read.schema(stream.schema).parquet(out)


class ForwardFilter(StatefulProcessor):
    """State per key: the last probability vector and the number of steps so far."""

    def __init__(self, model: Model, key: str, order: list[str], symbol: str):
        self.model, self.key, self.order, self.symbol = model, key, order, symbol

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState(
            "forward", StructType([StructField("v", ArrayType(DoubleType())), StructField("n", LongType())])
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        init, t, e = self.model.arrays()
        v, n = (init, 0)
        if self.state.exists():
            stored = self.state.get()
            v, n = np.array(stored[0], float), int(stored[1])
        batch = pd.concat(list(rows)).sort_values(self.order)
        steps, out = [], []
        for sym in batch[self.symbol]:
            v = unit((v if n == 0 else v @ t) * e[:, int(sym)])
            steps.append(n)
            out.append([float(x) for x in v])
            n += 1
        self.state.update((out[-1], n))
        yield pd.DataFrame({self.key: [key[0]] * len(steps), "step": steps, "f": out})

    def close(self) -> None:
        pass


def forward_steps(v: np.ndarray, steps: np.ndarray, width: int = 64) -> np.ndarray:
    """The vectors v·m₀, v·m₀·m₁, … (each of sum 1) of a stack of matrices.

    Blocks of ``width`` matrices are multiplied side by side; then one vector enters each block.
    """
    n, k = len(steps), len(v)
    blocks = np.broadcast_to(np.eye(k), (-(-n // width) * width, k, k)).copy()
    blocks[:n] = steps
    blocks = blocks.reshape(-1, width, k, k)
    for j in range(1, width):
        blocks[:, j] = scaled(blocks[:, j - 1] @ blocks[:, j])
    entering = [v]
    for last in blocks[:-1, -1]:
        entering.append(unit(entering[-1] @ last))
    return scaled((np.stack(entering)[:, None, None, :] @ blocks).reshape(-1, k))[:n]


SLOT, CHUNK = "slot_of_time", 8192  # a name that pandas rows can have as an attribute


class OrderedFilter(StatefulProcessor):
    """State per key: the last vector, the number of steps, and what waits for the watermark.

    Rows wait in runs of at most ``CHUNK`` rows under (slot of event time, number of the run). One timer
    stands at the end of the earliest slot that waits; when the watermark has passed it, the slots it has passed are
    put in order, one after another, and go through the filter in chunks.
    """

    def __init__(self, model: Model, key: str, order: list[str], symbol: str, width: int):
        self.model, self.key, self.order, self.symbol, self.width = model, key, order, symbol, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("forward", "v array<double>, n bigint, runs bigint")
        self.waiting = handle.getMapState("waiting", "slot bigint, run bigint", "rows binary")

    def known(self) -> tuple[np.ndarray, int, int]:
        if not self.state.exists():
            return self.model.arrays()[0], 0, 0
        v, n, runs = self.state.get()
        return np.array(v, float), int(n), int(runs)

    def set_timer(self, slot: int) -> None:
        """One timer, at the end of the earliest waiting slot."""
        at, there = (slot + 1) * self.width, [int(t) for t in self.handle.listTimers()]
        if not there or at < min(there):
            for t in there:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        v, n, runs = self.known()
        first = None
        for frame in rows:
            frame = frame[frame[self.symbol].notna()]
            for slot, part in frame.groupby(SLOT, sort=False):
                for at in range(0, len(part), CHUNK):
                    batch = pa.RecordBatch.from_pandas(part.iloc[at : at + CHUNK][[*self.order, self.symbol]], preserve_index=False)
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, batch.schema) as writer:
                        writer.write_batch(batch)
                    self.waiting.updateValue((int(slot), runs), (sink.getvalue().to_pybytes(),))
                    runs += 1
                first = int(slot) if first is None else min(first, int(slot))
        if first is not None:
            self.state.update(([float(x) for x in v], n, runs))
            self.set_timer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = int(timerValues.getCurrentWatermarkInMs())
        slots: dict[int, list[int]] = {}
        for slot, run in self.waiting.keys():
            slots.setdefault(int(slot), []).append(int(run))
        v, n, runs = self.known()
        _, trans, emit = self.model.arrays()
        for slot in sorted(slots):
            if (slot + 1) * self.width > until:
                self.handle.registerTimer((slot + 1) * self.width)
                break
            tables = []
            for run in slots[slot]:
                with pa.ipc.open_stream(self.waiting.getValue((slot, run))[0]) as reader:
                    tables.append(reader.read_all())
                self.waiting.removeKey((slot, run))
            syms = pa.concat_tables(tables, promote_options="permissive").sort_by([(c, "ascending") for c in self.order]).column(self.symbol).to_numpy().astype(int)
            for at in range(0, len(syms), CHUNK):
                part = syms[at : at + CHUNK]
                steps = trans[None] * emit[:, part].T[:, None, :]
                if n == 0:  # no transition leads into the first step
                    steps[0] = np.diag(emit[:, part[0]])
                found = forward_steps(v, steps)
                v, n = found[-1], n + len(part)
                yield pd.DataFrame({self.key: [key[0]] * len(part), "step": np.arange(n - len(part), n), "f": found.tolist()})
        self.state.update(([float(x) for x in v], n, runs))

    def close(self) -> None:
        pass


def hmm_filter_stream(events: DataFrame, key: str, order: list[str], symbol: str, model: Model, delay: str | None = None, slot_seconds: int = 86_400) -> DataFrame:
    """Forward probabilities per key as observations arrive: (key, step, f).

    With a ``delay`` the first column of ``order`` is event time, and rows may arrive in any order that the delay allows:
    they wait in the state until the watermark has passed their slot of ``slot_seconds``, and slots leave in order. A task
    holds the rows of one key and slot, never a key's whole micro-batch. What waits at the end of the input leaves when a later time arrives
    (see ``run_closed``). Rows without event time, and those behind the watermark, are left out.

    Without a ``delay`` the state of a key is one short vector; the rows of a micro-batch, which
    ``maxFilesPerTrigger`` bounds, are put in order per key, and batches must arrive in order. Symbols outside the model, and
    NULL, are left out.
    """
    if delay is not None:
        millis, width = F.unix_millis(order[0]), 1000 * slot_seconds
        kind = events.schema[key].dataType.simpleString()
        # a row without symbol still moves the watermark
        sym = F.when(F.col(symbol).between(0, len(model.emit[0]) - 1), F.col(symbol)).alias(symbol)
        timed = events.select(key, F.col(order[0]).cast("timestamp").alias(order[0]), *order[1:], sym).withWatermark(order[0], delay).withColumn(SLOT, F.floor(millis / width).cast("bigint"))
        return timed.groupBy(key).transformWithStateInPandas(
            statefulProcessor=OrderedFilter(model, key, order, symbol, width),
            outputStructType=f"{key} {kind}, step bigint, f array<double>",
            outputMode="Append",
            timeMode="EventTime",
        )
    kind = events.schema[key].dataType.simpleString()
    known = events.filter(F.col(symbol).between(0, len(model.emit[0]) - 1))
    return known.select(key, *order, symbol).groupBy(key).transformWithStateInPandas(
        statefulProcessor=ForwardFilter(model, key, order, symbol),
        outputStructType=f"{key} {kind}, step bigint, f array<double>",
        outputMode="Append",
        timeMode="None",
    )
