"""Helpers shared by the corpus operators."""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.session import cut, scratch_path, shared_dir  # noqa: F401  (re-used by the operators)

#: The bytes of [\x20\x09-\x0D]; ``bytes.split()`` without argument splits at just these.
SPACES = " \t\n\v\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col(f"`{name}`")


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only (doc_id, text): no other column can clash with what an operator adds. NULL text is empty."""
    return df.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))


def texts_of(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


#: Bytes of text handled at a time within a batch (a batch holds up to 64 MB).
SLICE = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str | int, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``limit`` bytes in one column (at least a row each), without copies."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // limit
        starts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
        for start, stop in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(start, stop - start)


#: Bytes of an Arrow batch between Spark and Python. Texts are long, and every batch under way is held
#: a few times over on both sides; the session's default of 64 MB is too much for small executors.
BATCH = 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after lowering the session's bound on Arrow batches to ``BATCH`` where it is higher."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    bound = re.match(r"\d+", conf.get(key, str(8 * BATCH)))
    if not bound or int(bound[0]) > BATCH:
        conf.set(key, str(BATCH))
    return df


def per_batch(df: DataFrame, fn: Callable[[list, list[str]], dict], schema: str) -> DataFrame:
    """Run ``fn(doc_ids, texts) -> columns`` over Arrow batches of (doc_id, text)."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = fn(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return small_batches(df).mapInArrow(run, fields)


def extended(df: DataFrame, text_col: str, fn: Callable[[pa.RecordBatch], dict], added: dict[str, str], replaced: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the columns that ``fn`` makes of each Arrow batch: ``added`` (name: type) at the end, ``replaced`` in place.

    The batch has the columns of ``df`` in their order; names are put aside meanwhile, so that no
    name (dots, clashes) matters.
    """
    names = df.columns
    inner = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema.fields)])
    for i, kind in enumerate(added.values()):
        inner.add(f"a{i}", kind)
    extra = arrow_schema(T.StructType(inner.fields[len(names):])) if added else pa.schema([])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, names.index(text_col)):
            out = fn(batch)
            columns = [pa.array(out[n], batch.column(i).type) if n in replaced else batch.column(i) for i, n in enumerate(names)]
            columns += [pa.array(out[n], f.type) for n, f in zip(added, extra)]
            yield pa.RecordBatch.from_arrays(columns, names=inner.names)

    return small_batches(df).toDF(*inner.names[: len(names)]).mapInArrow(run, inner).toDF(*names, *added)


def arrow_schema(fields: T.StructType) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([pa.field(f.name, kinds[f.dataType.simpleString()]) for f in fields])


def open_shared(name: str):
    """A binary stream of a file in the shared folder (a URI as Spark lists it), read as it comes."""
    system, path = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", name))
    return io.BufferedReader(system.open_input_stream(unquote(path) if system.type_name == "local" else path, compression=None), 1 << 20)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start+1, … of every (start, length), one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    kind = np.int32 if max(total, int(starts.max()) + int(lengths.max())) < 1 << 31 else np.int64
    shift = (starts - (np.cumsum(lengths) - lengths)).astype(kind)
    out = np.repeat(shift, lengths)
    out += np.arange(total, dtype=kind)
    return out
