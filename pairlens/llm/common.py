"""Helpers shared by the corpus operators."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship

#: Rows that a group or bucket is cut to; numbers of groups follow from counts.
GROUP_ROWS = 4096
#: Bytes of the batches that go to Python.
BATCH_BYTES = 4 << 20
#: Rows of an Arrow batch that a Python function holds at once.
ROWS_AT_ONCE = 512


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(col: str = "text") -> Column:
    """The text in UTF-8; null is empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def text_key(col: str = "text") -> Column:
    """With ``doc_id``, tells rows apart whose ids are repeated; null is empty."""
    return F.xxhash64(F.coalesce(F.col(col), F.lit("")))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def arrow(df: DataFrame, run: Callable, schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with this package on the workers, in batches bounded by bytes: rows hold whole texts."""
    spark = df.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, fn: Callable[..., tuple], inputs: list[str], outputs: str) -> DataFrame:
    """``fn`` over the ``inputs`` of every row, one tuple of ``outputs`` back.

    Arrow batches are taken apart row by row, so that a task holds one batch
    however long the texts are. The other columns of ``df`` are carried along;
    those named in ``inputs`` are dropped.
    """
    return _map(df, lambda columns: [fn(*(x.as_py() for x in row)) for row in zip(*columns)], inputs, outputs)


def map_blocks(df: DataFrame, fn: Callable[..., list[tuple]], inputs: list[str], outputs: str) -> DataFrame:
    """Like ``map_rows`` for ``fn`` that takes the lists of the inputs of some hundred rows at once."""
    return _map(df, lambda columns: fn(*(c.to_pylist() for c in columns)), inputs, outputs)


def _map(df: DataFrame, fn: Callable[[list], list[tuple]], inputs: list[str], outputs: str) -> DataFrame:
    made = T.StructType.fromDDL(outputs)
    keep = [f for f in df.schema.fields if f.name not in inputs]
    names = [f.name for f in made.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in made.fields]
        for batch in (b.slice(k, ROWS_AT_ONCE) for b in batches for k in range(0, b.num_rows, ROWS_AT_ONCE)):
            columns = [batch.column(batch.schema.get_field_index(c)) for c in inputs]
            rows = fn(columns)
            parts = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(f.name)) for f in keep]
                + [pa.array(list(p), type=k) for p, k in zip(parts, kinds)],
                names=[f.name for f in keep] + names)

    return arrow(df, run, T.StructType(keep + made.fields))


def map_lists(df: DataFrame, fn: Callable[..., Iterator[tuple]], inputs: list[str], outputs: str) -> DataFrame:
    """Like ``map_rows`` for ``fn`` that gives any number of tuples per row; only ``outputs`` come back."""
    made = T.StructType.fromDDL(outputs)
    names = [f.name for f in made.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in made.fields]

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(p), type=k) for p, k in zip(zip(*rows), kinds)], names=names)

        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(batch.schema.get_field_index(c)) for c in inputs)):
                rows.extend(fn(*(x.as_py() for x in row)))
                if len(rows) >= 20_000:
                    yield flush(rows)
                    rows = []
        if rows:
            yield flush(rows)

    return arrow(df, run, made)


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One row of ``docs`` for each (doc_id, tkey) of ``kept``, with all columns of ``docs``.

    Ids are compared null-safe. Rows that agree in id and text are one document.
    """
    own, key, ident = "row__", "tkey__", "id__"
    packed = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias(own),
                         F.col("doc_id").alias(ident), text_key().alias(key))
    wanted = kept.select("doc_id", "tkey").distinct()
    found = packed.join(wanted, packed[ident].eqNullSafe(wanted["doc_id"]) & (packed[key] == wanted["tkey"]), "left_semi")
    return found.dropDuplicates([ident, key]).select(f"{own}.*")
