"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudspark.session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once as a table in the shared folder: lineage ends here, and nothing is computed twice."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer's file, in the package installed with the interpreter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def whole_text(name: str = "text") -> Column:
    """The text, null as the empty one."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold(held: str, divisor: int, remainder: int) -> Column:
    """Whether crc32 of the id, written as text, leaves this remainder."""
    return F.coalesce(F.crc32(F.col(held).cast("string")) % divisor == remainder, F.lit(False))


def set_apart(docs: DataFrame, *needed: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with its other columns in one struct, and a function that brings them back, in their old order.

    So a stage may name columns of its own as it likes, whatever columns the documents bring along.
    """
    own = [c for c in docs.columns if c in needed]
    rest = [c for c in docs.columns if c not in needed]
    named = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)]
    packed = docs.select(*own, F.struct(F.lit(0).alias("none"), *named).alias("_rest"))

    def restore(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c) if c in own else F.col(f"_rest.c{rest.index(c)}").alias(c) for c in docs.columns])

    return packed, restore


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch], rows: int = 500) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fn`` over each batch, ``rows`` rows at a time so that little is held besides the batch itself."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield fn(batch.slice(at, rows))

    return run
