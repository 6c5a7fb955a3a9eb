"""Bitmaps of hashes, built on the executors and bounded in size: filters that let through all members and some others."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.llm.store import tidy
from corvane.llm.words import U

BLOCK = 1 << 13  # bytes of a bitmap in a block


def marking(bits: int):
    def run(batches):
        bitmap = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            spot = (batch.column(0).to_numpy().view(np.uint64) >> U(64 - bits)).astype(np.int64)
            np.bitwise_or.at(bitmap, spot >> 3, (1 << (spot & 7)).astype(np.uint8))
        block = [i for i in range(len(bitmap) // BLOCK) if bitmap[i * BLOCK : (i + 1) * BLOCK].any()]
        yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array([zlib.compress(bitmap[i * BLOCK : (i + 1) * BLOCK].tobytes(), 1) for i in block], pa.binary())], names=["block", "data"])

    return run


def joined(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BLOCK, np.uint8)
    for batch in batches:
        for data in batch.column(1).to_pylist():
            total |= np.frombuffer(zlib.decompress(data), np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["block", "data"])


def bitmap_of(hashes: DataFrame, bits: int) -> bytes:
    """The compressed bitmap of a table's one column of 64-bit hashes; 2 ** (bits - 3) bytes at most, whatever the input."""
    with tidy(hashes.sparkSession):
        blocks = hashes.mapInArrow(marking(bits), "block int, data binary").groupBy("block").applyInArrow(joined, "block int, data binary").collect()
    bitmap = np.zeros(1 << (bits - 3), np.uint8)
    for r in blocks:
        bitmap[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(zlib.decompress(r["data"]), np.uint8)
    return zlib.compress(bitmap.tobytes(), 1)


def opened(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


def members(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Mask of the hashes (unsigned) that may be in the bitmap."""
    spot = (hashes >> U(64 - (len(bitmap) * 8).bit_length() + 1)).astype(np.int64)
    return (bitmap[spot >> 3] >> (spot & 7).astype(np.uint8) & 1).astype(bool)
