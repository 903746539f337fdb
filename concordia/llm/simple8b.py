"""Operator 6: token ids in Simple-8b, 64-bit words with a selector and a varying count of ids.

A segment is one binary value, little-endian:

    header   4 bytes "S8B1", then u32 n_docs, u32 n_blocks, u32 n_words, u32 n_escapes, u64 n_ids
    docs     i64 doc ids[n_docs], u8 is-null[n_docs padded to 8], u64 ids per document[n_docs]
    offsets  u64 first word of each block[n_blocks]; a block is BLOCK ids
    words    u64[n_words]: 4 bits of selector over 60 bits of ids, lowest first
    escapes  u64 places[n_escapes], u64 values[n_escapes]: ids beyond 60 bits, 0 in their word

A word never crosses a block, so the offsets let all blocks be decoded at once.  Segments
are the rows of a Parquet table (file, segment, n_docs, n_ids, payload), written and
committed by Spark; files ascend in doc_id, and segments ascend within a file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concordia.llm.scratch import Scratch, small_batches
from concordia.llm.tokens import encoder, gathered

#: Fixed values of the format: ids per word by selector, and the bits of each id.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK = 240
#: Zeros after each block that the last word of the block may reach over.
_PAD = 60
SEGMENT_IDS = 1 << 20
_MAGIC = b"S8B1"
#: Selectors for more than four ids are tried while they fit at one of so many places.
SELDOM = 200


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block, places of escapes, their values) of unsigned ids.

    The longest selector that fits is found for every position by sliding maxima; then all
    blocks walk their positions together.
    """
    ids = ids.astype(np.uint64)
    places = np.flatnonzero(ids >> np.uint64(60))
    values = ids[places]
    n = len(ids)
    n_blocks = -(-n // BLOCK)
    # Each block is followed by zeros, so the last word of a block may reach past it.
    wide = BLOCK + _PAD
    flat = np.zeros(n_blocks * BLOCK, np.uint64)
    flat[:n] = ids
    flat[places] = 0
    top = int(flat.max()) if n else 0
    kind = np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64
    grid = np.zeros((n_blocks, wide), kind)
    grid[:, :BLOCK] = flat.reshape(n_blocks, BLOCK)
    most = {1: grid}

    def window(k: int) -> np.ndarray:
        """Maxima of k ids from each place; those of shorter windows are reused."""
        if k not in most:
            half = (k + 1) // 2
            low = window(half)
            most[k] = np.maximum(low[:, : wide - k + 1], low[:, k - half : wide - half + 1])
        return most[k]

    best = np.full((n_blocks, BLOCK), 15, np.uint8)
    for s in range(14, -1, -1):
        k = int(COUNTS[s])
        fits = window(k)[:, :BLOCK] <= min((1 << int(BITS[s])) - 1, np.iinfo(kind).max)
        if np.count_nonzero(fits) * SELDOM <= fits.size * (s < 12):
            break  # longer windows of fewer bits fit even less often
        np.copyto(best[:, : fits.shape[1]], np.uint8(s), where=fits)
    ends = np.full(n_blocks, BLOCK)
    if n_blocks:
        ends[-1] = n - BLOCK * (n_blocks - 1)
    at, live, step = np.zeros(n_blocks, np.int64), np.arange(n_blocks), 0
    rows, starts, steps = [], [], []
    while len(live):
        rows.append(live)
        starts.append(at[live])
        steps.append(np.full(len(live), step))
        at[live] += COUNTS[best[live, at[live]]]
        live = live[at[live] < ends[live]]
        step += 1
    if not rows:
        empty = np.empty(0, np.uint64)
        return empty, empty, empty, empty
    row, start, order = map(np.concatenate, (rows, starts, steps))
    # The j-th word of a block comes j places after the block's first.
    held = np.bincount(row, minlength=n_blocks)
    offsets = np.cumsum(held) - held
    place = offsets[row] + order
    row[place], start[place] = row.copy(), start.copy()
    sel = best[row, start]
    words = sel.astype(np.uint64) << np.uint64(60)
    cells, at = grid.ravel(), row * wide + start
    for s in np.unique(sel):
        if not BITS[s]:
            continue
        of = np.flatnonzero(sel == s)
        own, first = words[of], at[of]
        for k in range(int(COUNTS[s])):
            own |= cells[first + k].astype(np.uint64) << np.uint64(k * int(BITS[s]))
        words[of] = own
    return words, offsets.astype(np.uint64), places.astype(np.uint64), values


def unpack(words: np.ndarray, offsets: np.ndarray, places: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The ids that pack() took, all blocks at once."""
    n_blocks, wide = len(offsets), BLOCK + COUNTS[0]
    # Words may reach over the end of their block, into cells that are left out.
    out = np.zeros(n_blocks * wide, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[sel]
    first = offsets.astype(np.int64)
    block = np.repeat(np.arange(n_blocks), np.diff(np.append(first, len(words))))
    before = np.cumsum(count) - count
    start = before - before[first][block] + block * wide
    for s in np.unique(sel):
        if not BITS[s]:
            continue
        of = np.flatnonzero(sel == s)
        mask, own, at = np.uint64((1 << int(BITS[s])) - 1), words[of], start[of]
        for k in range(int(COUNTS[s])):
            out[at + k] = (own >> np.uint64(k * int(BITS[s]))) & mask
    out = out.reshape(n_blocks, wide)[:, :BLOCK].ravel()[:n]
    out[places.astype(np.int64)] = values
    return out


def write_segment(docs: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    words, offsets, places, values = pack(ids)
    head = np.array([len(docs), len(offsets), len(words), len(places)], "<u4").tobytes() + np.array([len(ids)], "<u8").tobytes()
    nulls = bytes(d is None for d in docs)
    parts = [
        _MAGIC, head, np.array([d or 0 for d in docs], "<i8").tobytes(), nulls + bytes(-len(nulls) % 8),
        np.array(lengths, "<u8").tobytes(), *(x.astype("<u8").tobytes() for x in (offsets, words, places, values)),
    ]
    return b"".join(parts)


def read_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, ids per document, all ids)."""
    if data[:4] != _MAGIC:
        raise ValueError("not a segment")
    n_docs, n_blocks, n_words, n_escapes = map(int, np.frombuffer(data, "<u4", 4, 4))
    n = int(np.frombuffer(data, "<u8", 1, 20)[0])
    at = 28

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(data, kind, count, at)
        at += got.nbytes
        return got

    docs = take("<i8", n_docs)
    nulls = take("u1", n_docs + -n_docs % 8)
    lengths, offsets, words = take("<u8", n_docs), take("<u8", n_blocks), take("<u8", n_words)
    places, values = take("<u8", n_escapes), take("<u8", n_escapes)
    ids = unpack(words, offsets, places, values, n)
    return [None if z else int(d) for d, z in zip(docs, nulls, strict=False)], lengths.astype(np.int64), ids


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, n_files: int | None = None) -> None:
    """Encode every whole text, append ``end_id`` to each, and write segments to ``path``.

    Rows are dealt by ranges of doc_id and sorted within them (equal ids by text), so that the
    files are in ascending order.  Rows without an id come first, by a hash of their text, in
    as many files of their own as their share of the rows makes.  A null or empty text has the
    end id only; texts of any length are encoded as a whole; repeated rows are written as often
    as they occur; other columns are ignored; an empty table writes no segment.
    """
    small_batches(docs.sparkSession)
    n_files = n_files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, segment, ids, lengths, parts, total = TaskContext.get().partitionId(), 0, [], [], [], 0
        end = np.array([end_id], "<u4").tobytes()

        def flush() -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(parts), "<u4")
            row = [[file], [segment], [len(ids)], [len(flat)], [write_segment(ids, lengths, flat)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["file", "segment", "n_docs", "n_ids", "payload"])

        for batch in gathered(batches):
            for d, got in zip(batch.column(0).to_pylist(), encoder(tokenizer).encode(batch.column(1)), strict=True):
                ids.append(d)
                lengths.append(len(got) // 4 + 1)
                parts += (got, end)
                total += lengths[-1]
                if total >= SEGMENT_IDS:
                    yield flush()
                    segment, ids, lengths, parts, total = segment + 1, [], [], [], 0
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Bounds come from the ids alone, so no text is read to find them.
    quantiles = F.percentile_approx("doc_id", [i / n_files for i in range(1, n_files)] or [0.5], 10_000)
    cuts, n, n_ids = rows.select("doc_id").agg(quantiles, F.count("*"), F.count("doc_id")).first()
    no_id = -(-n_files * (n - n_ids) // max(n, 1))
    rows = rows.withColumn("hash", F.when(F.col("doc_id").isNull(), F.coalesce(F.xxhash64("text"), F.lit(0).cast("long"))))
    # least() passes over nulls, so only rows without an id may ask for it.
    place = F.when(F.col("hash").isNotNull(), F.least(F.floor((F.col("hash") / 2.0**64 + 0.5) * no_id), F.lit(max(no_id - 1, 0))))
    after = F.size(F.filter(F.array(*map(F.lit, cuts or [])).cast("array<bigint>"), lambda c: c < F.col("doc_id")))
    file = F.coalesce(place, after + no_id).cast("int")
    rows = rows.repartitionById(n_files + no_id, file).sortWithinPartitions("doc_id", "hash", "text")
    made = rows.drop("hash").mapInArrow(run, "file int, segment int, n_docs bigint, n_ids bigint, payload binary")
    made.write.mode("overwrite").option("compression", "uncompressed").parquet(path)


def read_ids(spark, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32; null ids, repeated rows and
    empty texts as they were written, and no rows where no segment was."""
    table = spark.read.schema("file int, segment int, n_docs bigint, n_ids bigint, payload binary").parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "segment", "doc_id", "inside", "n_tokens", "ids_crc32"]
        for batch in batches:
            for file, segment, payload in zip(*(batch.column(i) for i in range(3)), strict=True):
                docs, lengths, ids = read_segment(payload.as_py())
                raw, stop = memoryview(ids.astype("<u4").tobytes()), np.cumsum(lengths)
                crc = [zlib.crc32(raw[4 * (s - n) : 4 * s]) for s, n in zip(stop.tolist(), lengths.tolist(), strict=True)]
                n = len(docs)
                columns = [[file.as_py()] * n, [segment.as_py()] * n, docs, stop - lengths, lengths, crc]
                kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    rows = table.select("file", "segment", "payload").mapInArrow(run, "file int, segment int, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint")
    files = table.groupBy("file").agg(F.sum("n_ids").alias("n"))
    files = files.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before_file"))
    inside = Window.partitionBy("file").orderBy("segment")
    starts = table.select("file", "segment", (F.sum("n_ids").over(inside) - F.col("n_ids")).alias("before")).join(files, "file")
    return rows.join(starts, ["file", "segment"]).select(
        "doc_id", (F.col("before_file") + F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write to the shared folder, then read back; odd rows as in write_ids and read_ids."""
    path = f"{Scratch(docs.sparkSession, 'ids').path}/ids"
    write_ids(docs, tokenizer, path)
    return read_ids(docs.sparkSession, path)
