"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage as cut, shared_folder

__all__ = ["BitFilter", "ascii_lower", "cut", "kept_rows", "shared_folder", "streamed_sha256", "table", "texts"]


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """Only doc_id, text and the named columns; a null text is an empty one."""
    return docs.select(
        docs["doc_id"].cast("bigint").alias("doc_id"),
        F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"),
        *[docs[c] for c in more],
    )


def ascii_lower(x: Column) -> Column:
    """A to Z lower-cased, all other letters as they are."""
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept_rows(docs: DataFrame, own: Column, keep: DataFrame) -> DataFrame:
    """One row of ``docs`` for each (doc_id, own) of ``keep``, all columns as they are.

    Whole rows are shuffled once; the helper columns have names that no table has.
    """
    tag = f"__{uuid4().hex}"
    names = [f"{tag}_{n}" for n in ("null", "id", "own")]

    def key(doc_id: Column, value: Column) -> list[Column]:
        return [doc_id.isNull(), F.coalesce(doc_id.cast("bigint"), F.lit(0)), value]

    marked = docs.withColumns(dict(zip(names, key(docs["doc_id"], own))))
    wanted = keep.select(*[c.alias(n) for c, n in zip(key(keep["doc_id"], keep["own"]), names)]).distinct()
    return marked.join(wanted, names, "left_semi").dropDuplicates(names).drop(*names)


def streamed_sha256(parts: DataFrame, key: str, order: str, data: str, between: str) -> DataFrame:
    """``key, sha256``: lowercase hex of the UTF-8 digest of a key's parts in order, with ``between`` between them.

    Rows of a key pass one task in sorted order and only the digest's state is held.
    """
    kind = parts.schema[key].dataType

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = state = None
        for batch in batches:
            keys, digests = [], []
            for k, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if state is not None and k == now:
                    state.update(between.encode())
                else:
                    if state is not None:
                        keys.append(now)
                        digests.append(state.hexdigest())
                    now, state = k, sha256()
                state.update(d.encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(digests, pa.string())], [key, "sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], batch.schema.field(0).type), pa.array([state.hexdigest()])], [key, "sha256"])

    sorted_parts = parts.select(key, order, data).repartition(key).sortWithinPartitions(key, order).select(key, data)
    return sorted_parts.mapInArrow(rows, f"{key} {kind.simpleString()}, sha256 string")


class BitFilter:
    """A fixed-size bitmap of 64-bit hashes: cheap to test, and wrong only by letting a stranger pass.

    It keeps rows that cannot join out of a shuffle. Its size does not depend on the data, so it may stand in
    the plan as a constant; with more hashes it only lets more rows pass.
    """

    def __init__(self, hashes: DataFrame, column: str, words: int):
        self.words = words
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), self._bit(F.col(column)))
        slots = hashes.groupBy(self._slot(F.col(column)).alias("slot")).agg(F.bit_or(bit).alias("bits"))
        found = dict(slots.collect())  # at most ``words`` rows
        self.map = F.split(F.lit(",".join(str(found.get(i, 0)) for i in range(words))), ",").cast("array<bigint>")

    def _slot(self, x: Column) -> Column:
        return F.shiftrightunsigned(x, 6).bitwiseAND(F.lit(self.words - 1)).cast("int")

    def _bit(self, x: Column) -> Column:
        return x.bitwiseAND(F.lit(63)).cast("int")

    def may_hold(self, x: Column) -> Column:
        return F.getbit(F.get(self.map, self._slot(x)), self._bit(x)) == 1
