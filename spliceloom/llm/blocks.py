"""Texts in blocks of one row each, and sorted hashes dealt to buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame


def planes(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, which compresses well."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unplanes(data: bytes, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(width, -1).T).view(dtype).ravel()


def pack_blocks(rows: DataFrame, block_bytes: int) -> DataFrame:
    """One row per block: (block, ids, flags, texts compressed); ``rows`` is (id, flag, text)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            whole = table.slice(0).to_batches()[0]
            sink = pa.BufferOutputStream()
            texts = pa.RecordBatch.from_arrays([whole.column(2)], ["text"])
            with pa.ipc.new_stream(sink, texts.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(texts)
            n = pa.array([0, len(whole)], pa.int32())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([block], pa.int64()),
                    pa.ListArray.from_arrays(n, whole.column(0)),
                    pa.ListArray.from_arrays(n, whole.column(1)),
                    pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                ],
                ["block", "ids", "flags", "texts"],
            )

        for batch in batches:
            at = 0
            lengths = np.diff(np.frombuffer(batch.column(2).buffers()[1], dtype=np.int32)[batch.column(2).offset :][: len(batch) + 1])
            for i, length in enumerate(lengths):
                size += int(length)
                if size >= block_bytes:
                    held.append(batch.slice(at, i + 1 - at))
                    yield flush()
                    block, held, size, at = block + 1, [], 0, i + 1
            if at < len(batch):
                held.append(batch.slice(at))
        if held:
            yield flush()

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(pack, f"block long, ids array<{kind}>, flags array<boolean>, texts binary")


def cuts(grams: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket of leading bits begins in sorted hashes, and the end."""
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.append(np.searchsorted(grams, edges), len(grams))


def block_texts(data: bytes) -> pa.Array:
    return pa.ipc.open_stream(data).read_next_batch().column(0)


def bucket_bits(blocks: DataFrame, least: int) -> int:
    """Leading bits that make at least as many buckets as blocks: a bucket then stays about as large as a block."""
    return max(least, int(blocks.select("block").count() - 1).bit_length())


def distinct_pairs(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, and the place of each pair among them."""
    if len(first) and max(first.max(), second.max()) >= 1 << 32:
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        place = np.empty(len(a), dtype=np.int64)
        place[order] = np.cumsum(new) - 1
        return a[new], b[new], place
    both, place = np.unique(first << np.uint64(32) | second, return_inverse=True)
    return both >> np.uint64(32), both & np.uint64((1 << 32) - 1), place
