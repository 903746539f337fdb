"""Operator 7: best-fit packing by sums of squares."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.llm.scratch import Scratch, small_batches
from concordia.llm.tokens import encoder, gathered, release

#: Rounds join the tasks' leftovers in so many times fewer tasks.
FAN = 16
#: Bytes of text that are encoded at once: numbers of their pieces take some twenty times as much.
GATHERED = 3 << 20
#: One task packs about so many rows at most, in any round.
ROUND_ROWS = 1_000_000


class Packer:
    """Sum-of-squares packing: N[g] open bins have a gap of g; a piece goes into the open bin
    after which the sum of N[g]^2 is smallest, ties to the smallest gap left.  A bin is
    opened only for a piece that fits none: as all pieces are known, a bin less counts more."""

    def __init__(self, size: int):
        self.size = size
        self.count = np.zeros(size + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]
        self.bins: list[list[int]] = []

    def place(self, item: int, length: int) -> None:
        size, count = self.size, self.count
        # change[g]: change of the sum (halved, less a constant) if a bin with gap g takes it.
        change = count[: size - length + 1] - count[length:] + 1.0
        change[0] = 0.5 - count[length]
        change[count[length:] == 0] = np.inf
        left = int(change.argmin())
        gap = left + length
        if change[left] == np.inf:
            left = size - length
            self.bins.append([item])
            at = len(self.bins) - 1
        else:
            at = self.open[gap].pop()
            count[gap] -= 1
            self.bins[at].append(item)
        if left:
            self.open[left].append(at)
            count[left] += 1


def pack(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins of item numbers.  Long pieces come first: they leave gaps that short ones fill."""
    packer = Packer(size)
    for item in np.argsort(-lengths, kind="stable").tolist():
        packer.place(item, int(lengths[item]))
    return packer.bins


PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_PIECE = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
_PLACE = ["sequence_id", "offset"]


def _cutter(tokenizer: str, end_id: int, size: int, memory: int | None):
    """Pieces of every document; what a batch took is given back before the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for batch in gathered(batches, GATHERED):
            rows = []
            for d, got in zip(batch.column(0).to_pylist(), encoder(tokenizer, memory).encode(batch.column(1)), strict=True):
                ids = memoryview(got + end)
                n, at, k = len(ids) // 4, 0, 0
                while at < n:
                    length = (n - at) % size or size
                    rows.append((d, k, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)])))
                    at, k = at + length, k + 1
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PIECE, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
            release()

    return run


def cut(docs: DataFrame, tokenizer: str, end_id: int, size: int, memory: int | None = None) -> DataFrame:
    """Encoded documents in pieces: only those longer than ``size`` are cut, into pieces of
    ``size`` ids, the first of which takes what is over."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cutter(tokenizer, end_id, size, memory), PIECE)


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 2, memory: int | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    ``memory`` bounds the pieces of text whose ids a worker remembers, for time only.

    Each task packs the pieces it has by sums of squares.  Bins that are full stay; the
    pieces of all others go on to a round of FAN times fewer tasks, down to one, while a
    task's share stays below ROUND_ROWS, so memory is bounded and the waste of many
    half-filled bins is not multiplied by the tasks.

    A null or empty text is the end id alone; texts of any length are encoded as a whole; equal
    documents are packed as often as they occur, pieces of equal length in any order; of bins
    that serve equally well the one with the smallest gap left takes a piece; a null id stays
    null; other columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "packing")
    pieces = scratch.keep(cut(docs, tokenizer, end_id, size, memory), "pieces")

    def round_of(number: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if not held:
                return
            table = pa.Table.from_batches(held).combine_chunks()
            lengths = table.column("length").to_numpy()
            prefix = number << 56 | TaskContext.get().partitionId() << 32
            ids, offsets = np.full(len(lengths), -1, np.int64), np.zeros(len(lengths), np.int64)
            for k, items in enumerate(pack(lengths, size)):
                ends = np.cumsum(lengths[items])
                if last or ends[-1] == size:
                    ids[items] = prefix | k
                    offsets[items] = ends - lengths[items]
            table = table.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))
            yield from table.to_batches()

        return run

    kind = PIECE + ", sequence_id bigint, offset bigint"
    rest, done, number = pieces, [], 0
    n = rest.count()
    tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 20_000), -(-n // ROUND_ROWS))
    while True:
        number += 1
        last = tasks == 1 or number > 6
        spread = rest.repartition(tasks, F.xxhash64("doc_id", "piece", F.lit(number))) if tasks > 1 else rest.coalesce(1)
        packed = scratch.keep(spread.mapInArrow(round_of(number, last), kind), f"round{number}")
        done.append(packed.where("sequence_id >= 0"))
        if last:
            break
        rest = packed.where("sequence_id < 0").select(*pieces.columns)
        tasks = max(-(-tasks // FAN), -(-rest.count() // ROUND_ROWS))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
