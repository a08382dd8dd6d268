"""Shared helpers of the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructType

#: Text handed to a batch function at once; a longer single text makes a batch of its own.
CHUNK_BYTES = 2 << 20
#: Rows travel to Python tasks in batches of so many bytes, where the session does not say otherwise. Spark's
#: own limit of 64 MB is held several times over by a task and its worker.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(col: str) -> Column:
    """A text as its UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b""))


def fresh(columns: Sequence[str], name: str) -> str:
    """``name`` with underscores in front until no column is called so; letter case does not count."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def schema_of(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def map_texts(
    df: DataFrame,
    passed: Sequence[str],
    text: str,
    out: str,
    fn: Callable[..., Sequence[Sequence]],
    setup: Callable[[], object] | None = None,
    as_str: bool = False,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Columns ``passed`` as they are, followed by the columns ``out`` that ``fn`` makes of the texts.

    ``fn(texts[, state])`` gets a list of UTF-8 bytes (or of str with ``as_str``) and returns one
    sequence per column of ``out``. ``setup()`` runs once per task. The texts of a call are limited
    in bytes, whatever the number of rows of an Arrow batch, so that long texts do not pile up.
    A text column that is passed is sent once. What Arrow has freed goes back when a task ends.
    Passed columns never leave Arrow: nulls and 64-bit numbers stay what they are.
    """
    if df.sparkSession.conf.get(BATCH_KEY, None) is None:
        df.sparkSession.conf.set(BATCH_KEY, BATCH_BYTES)
    kept = df.select(*passed)
    made = schema_of(out)
    schema = StructType([*kept.schema.fields, *made.fields])
    arrow = to_arrow_schema(schema)
    n_kept = len(passed)
    sent = text in passed and isinstance(kept.schema[text].dataType, StringType)
    at = list(passed).index(text) if sent else n_kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for b in batches:
            start = 0
            sizes = b.column(at).nbytes
            rows = b.num_rows
            if rows == 0:
                continue
            step = max(1, min(rows, int(rows * chunk_bytes / max(1, sizes))))
            while start < rows:
                part = b.slice(start, step)
                start += step
                raw = [x or b"" for x in part.column(at).cast(pa.binary()).to_pylist()]
                if as_str:
                    raw = [x.decode("utf-8", "replace") for x in raw]
                cols = fn(raw, state) if setup else fn(raw)
                arrays = [part.column(i).cast(arrow.field(i).type) for i in range(n_kept)]
                arrays += [c if isinstance(c, pa.Array) else pa.array(c, arrow.field(n_kept + k).type) for k, c in enumerate(cols)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
        pa.default_memory_pool().release_unused()

    if sent:
        return kept.mapInArrow(run, schema)
    return df.select(*passed, utf8(text).alias(fresh(passed, "_utf8"))).mapInArrow(run, schema)


def ship(spark: SparkSession) -> None:
    from terravox.session import ship_package

    ship_package(spark)
