"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but the six ASCII white-space characters.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (unset in a single local process, as in tests) one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lodestack-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends in files that outlive executors."""
    return cut_in_turn(name, df)


def cut_in_turn(name: str, *tables: DataFrame) -> DataFrame:
    """Write tables of the same columns one after the other into one Parquet table, and read that back."""
    spark = tables[0].sparkSession
    path = f"{shared_dir(spark)}/lodestack/{name}-{uuid.uuid4().hex}"
    for table in tables:
        table.write.mode("append").parquet(path)
    return spark.read.schema(tables[0].schema).parquet(path)


def merged(left: DataFrame, right: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """A join by sorted shuffles on small tables as on large ones.

    Of small tables Spark broadcasts one side, for which the driver collects it and builds a hash table of a few MB, whatever its
    rows need, that stays until garbage is collected: dozens of such joins fill the driver's memory on the smallest input.
    """
    return left.join(right.hint("merge"), on, how)


_ARROW = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}


def computed(df: DataFrame, text_col: str, keep: tuple[str, ...], fields: dict[str, str], make: Callable[[], Callable[[list], dict]]) -> DataFrame:
    """The ``keep`` columns and ``fields`` (name to type), which the function made once a task by ``make`` computes from lists of texts.

    Batches stay in Arrow: ids and other kept columns pass as they are, so a null beside a large id changes neither. Narrow.
    """
    kept = df.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(keep)), F.col(text_col).alias("_text"))
    kinds = [f.dataType.simpleString() for f in kept.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            made = work(batch.column(batch.num_columns - 1).to_pylist())
            columns = [*batch.columns[:-1], *(pa.array(made[name], _ARROW[kind]) for name, kind in fields.items())]
            yield pa.RecordBatch.from_arrays(columns, names=[f"_{i}" for i in range(len(columns))])

    every = [*zip(keep, kinds), *fields.items()]
    out = kept.mapInArrow(run, ", ".join(f"_{i} {kind}" for i, (_, kind) in enumerate(every)))
    return out.select(*(F.col(f"_{i}").alias(name) for i, (name, _) in enumerate(every)))


def crc_fold(column: Column, folds: int) -> Column:
    """crc32 of a value as text, modulo ``folds``; a null value counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def ascii_lower_words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split into the words of the contracts; null counts as empty."""
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_ASCII_LOWER))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on unsigned 64-bit integers."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def crc32(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))
