"""Tables of bits of a fixed size, made in the executors: bounded filters of unbounded sets of keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The table travels in blocks of 2**BLOCK_BITS bits; empty blocks stay away.
BLOCK_BITS = 19


def bit_table(df: DataFrame, places: Callable[[], Callable[[pa.RecordBatch], np.ndarray]], bits: int) -> np.ndarray:
    """2**bits packed bits, those set that ``places()(batch)`` names; at most that many reach the driver."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, of = np.zeros(2**bits, dtype=bool), places()
        for b in batches:
            seen[of(b)] = True
        for i, block in enumerate(seen.reshape(-1, 2**BLOCK_BITS)):
            if block.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.packbits(block).tobytes()], pa.binary())], names=["block", "bits"])

    def merge(t: pa.Table) -> pa.Table:
        got = np.zeros(2**BLOCK_BITS // 8, dtype=np.uint8)
        for x in t.column("bits").to_pylist():
            got |= np.frombuffer(x, dtype=np.uint8)
        return pa.table({"block": pa.array([t.column("block")[0].as_py()], pa.int32()), "bits": pa.array([got.tobytes()], pa.binary())})

    schema = "block int, bits binary"
    out = np.zeros((2 ** (bits - BLOCK_BITS), 2**BLOCK_BITS // 8), dtype=np.uint8)
    for r in df.mapInArrow(pack, schema).groupBy("block").applyInArrow(merge, schema).collect():
        out[r["block"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out.ravel()


def is_set(table: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (table[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1
