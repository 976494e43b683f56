"""Counters and flags of fixed size, over fingerprints of any number of things, for the driver to hand to all tasks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyscope.llm.words import text_pieces

BLOCK = 4096
_U = np.uint64


def cell_scale(docs: DataFrame, text: str, cells: int, prints: Callable[[list[bytes]], np.ndarray]) -> np.ndarray:
    """For each cell a byte that grows with the logarithm of the number of fingerprints that fall into it.

    ``prints`` gives the fingerprints of some texts; ``cells`` is a power of two, 4096 or more. Tasks count all their
    texts, cells are added up in blocks, and the driver receives ``cells`` bytes, whatever the input.
    """
    def count(batches):
        total, held, size = np.zeros(cells, np.int64), [], 0
        for _, raw in text_pieces(batches, text):
            held.append((prints(raw) & _U(cells - 1)).view(np.int64))
            size += len(held[-1])
            if size > cells:
                total += np.bincount(np.concatenate(held), minlength=cells)
                held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=cells)
        # A byte a cell; the few larger counts follow with their cells.
        small, large = np.minimum(total, 255).astype(np.uint8).reshape(-1, BLOCK), np.flatnonzero(total > 255)
        more, cut = total[large] - 255, np.searchsorted(large, np.arange(len(small) + 1) * BLOCK).tolist()
        blocks = np.flatnonzero(small.any(1)).tolist()
        for begin in range(0, len(blocks), 256):
            some = blocks[begin:begin + 256]
            rest = [(large[cut[b]:cut[b + 1]] - b * BLOCK).tobytes() + more[cut[b]:cut[b + 1]].tobytes() for b in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([small[b].tobytes() for b in some], pa.binary()), pa.array(rest, pa.binary())],
                                             names=["block", "n", "rest"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, n, rest in zip(*(c.to_pylist() for c in batch.columns)):
                total = sums.setdefault(block, np.zeros(BLOCK, np.int64))
                total += np.frombuffer(n, np.uint8)
                cell, more = np.frombuffer(rest, np.int64).reshape(2, -1)
                total[cell] += more
        for block, total in sums.items():
            scale = np.minimum(np.log2(total + 1.0) * 6, 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([scale.tobytes()], pa.binary())], names=["block", "scale"])

    parts = docs.select(text).mapInArrow(count, "block long, n binary, rest binary").repartition("block").mapInArrow(add, "block long, scale binary")
    scale = np.zeros((cells // BLOCK, BLOCK), np.uint8)
    for row in parts.collect():
        scale[row.block] = np.frombuffer(row.scale, np.uint8)
    return scale.ravel()


def flagged(flags: np.ndarray, value: np.ndarray) -> np.ndarray:
    bit = (value.view(_U) % _U(len(flags) * 8)).astype(np.int64)
    return (flags[bit >> 3] >> (bit & 7) & 1).astype(bool)


def bit_blocks(frame: DataFrame, bits: int) -> np.ndarray:
    """One bit for the values of a frame's first (long) column that fall on it; fixed size, for scans that may pass a few rows too many.

    Tasks add their bits up by block in one job, and only blocks are collected: the driver receives ``bits`` / 8 bytes,
    whatever the number of rows or partitions.
    """
    size = BLOCK * 8

    def mark(batches):
        held = np.zeros(bits, bool)
        for batch in batches:
            held[(batch.column(0).to_numpy().view(_U) % _U(bits)).astype(np.int64)] = True
        rows = held.reshape(-1, size)
        for block in np.flatnonzero(rows.any(1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([np.packbits(rows[block], bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

    def join(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, packed in zip(*(c.to_pylist() for c in batch.columns)):
                sums.setdefault(block, np.zeros(size // 8, np.uint8))[:] |= np.frombuffer(packed, np.uint8)
        for block, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([total.tobytes()], pa.binary())], names=["block", "bits"])

    out = np.zeros((bits // size, size // 8), np.uint8)
    for row in frame.mapInArrow(mark, "block long, bits binary").repartition("block").mapInArrow(join, "block long, bits binary").collect():
        out[row.block] = np.frombuffer(row.bits, np.uint8)
    return out.ravel()
