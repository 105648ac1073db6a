"""Helpers shared by the text operators of this subpackage."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: maximal runs of anything but these six characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any file system will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; only where none is set and all runs on one machine, a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint"))
    return context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``checkpoint()`` into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def tidy(spark: SparkSession) -> None:
    """Lets the driver's collector find the shuffles of finished steps, whose files Spark then deletes; else they stay until its heap fills up."""
    spark.sparkContext._jvm.System.gc()


def slices(batch: pa.RecordBatch, weigh: int | None, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that end once their column ``weigh`` holds over ``most`` bytes."""
    import pyarrow.compute

    start, n = 0, batch.num_rows
    ends = [n] if n else []
    if weigh is not None and n:
        ends, size = [], 0
        for i, length in enumerate(pyarrow.compute.binary_length(batch.column(weigh)).fill_null(0).to_pylist()):
            size += length
            if size > most:
                ends.append(i + 1)
                size = 0
        if not ends or ends[-1] < n:
            ends.append(n)
    for end in ends:
        yield batch.slice(start, end - start)
        start = end


def in_blocks(
    work: Callable[[list[pa.Array]], list], schema: pa.Schema, weigh: int | None = None, most: int = 4_000_000
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow: ``work`` gets the columns of a block of rows, returns those of the result.

    A block ends once its column ``weigh`` holds over ``most`` bytes, so that memory is bounded by the
    longest text and not by the number of rows in an Arrow batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, weigh, most):
                out = work(part.columns)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    return run


def held_out(doc_id: str = "doc_id") -> Column:
    """The rows whose labels are never learned from: crc32 of the id as text leaves 1 when divided by 3.

    A null id counts as the empty text, and so isn't held out.
    """
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def filtered(docs: DataFrame, text_col: str, keep: Callable[[list[str]], list[bool]]) -> DataFrame:
    """The rows of ``docs`` whose text ``keep`` says yes to, with all columns, whatever their names.

    A null text is an empty one; repeated rows are judged alike; no rows give none. Blocks of texts are bounded in bytes.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                yield part.filter(pa.array(keep([x or "" for x in part.column(at).to_pylist()]), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def free_name(columns: list[str], name: str) -> str:
    """``name``, with as many underscores before it as it takes not to be one of ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
