"""Shared folders, Arrow maps over text columns and small helpers of the text operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text handed to a function at once; one longer text goes alone.
CHUNK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one made here in a local session only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidepanel-llm-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: computed once, safe when executors are lost."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[pa.Array]:
    """Slices of at most ``most`` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield texts.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < len(texts):
        yield texts.slice(start)


def laid_out(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all words (none null), and the bounds of the words in them."""
    if not len(words):
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int32)
    _, offsets, data = words.cast(pa.binary()).buffers()
    bounds = np.frombuffer(offsets, dtype=np.int32)[words.offset : words.offset + len(words) + 1]
    return np.frombuffer(data or b"", dtype=np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def map_texts(
    df: DataFrame,
    text: str,
    fields: T.StructType,
    prepare: Callable[[], Callable[[list], list]],
    carry: list[str] | None = None,
    most: int = CHUNK_BYTES,
) -> DataFrame:
    """Carried columns and ``fields``, computed from whole texts in Arrow batches.

    ``prepare()`` runs once per task and returns a function from a list of texts (None for null) to
    one list of values per field. ``carry`` must not repeat a name of ``fields``.
    """
    names = df.columns if carry is None else carry
    if clash := set(names) & set(fields.names):
        raise ValueError(f"carried columns repeat result columns: {sorted(clash)}")
    kept = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([*kept.schema.fields[:-1], *fields.fields])
    n_carry = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        new, work = list(to_arrow_schema(fields)), prepare()
        for batch in batches:
            target, done = pa.schema([*list(batch.schema)[:n_carry], *new]), 0
            for part in chunks(batch.column(n_carry), most):
                made = [pa.array(v, type=f.type) for v, f in zip(work(part.to_pylist()), new)]
                held = [c.slice(done, len(part)) for c in batch.columns[:n_carry]]
                yield pa.RecordBatch.from_arrays([*held, *made], schema=target)
                done += len(part)

    return kept.mapInArrow(run, schema)


_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType(), "binary": T.BinaryType()}


def fields(**kinds: str) -> T.StructType:
    """``fields(n="long", ids="array<int>")``: a schema from keyword arguments, without a session."""
    kind = lambda v: T.ArrayType(_KINDS[v[6:-1]]) if v.startswith("array<") else _KINDS[v]
    return T.StructType([T.StructField(k, kind(v)) for k, v in kinds.items()])
