"""Blocked Bloom filters of bounded size: built by Spark jobs, kept as one bit table with a part for each unit.

A key's probes all fall into one block of 512 bits of its unit's part. Whoever plans a filter bounds
its blocks; a part that is too small for its keys lets more strangers pass, and never loses a key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import mix

BLOCK_BITS = 512
PROBES = 6
BITS_A_KEY = 16


def blocks_for(keys: int) -> int:
    return max(1, -(-keys * BITS_A_KEY // BLOCK_BITS))


def probes(keys: np.ndarray, first: np.ndarray | int, blocks: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Where each key's block begins among the table's 64-bit words, and the bits that pick places in it."""
    at = np.asarray(first, np.uint64) + (((keys >> np.uint64(32)) * np.asarray(blocks, np.uint64)) >> np.uint64(32))
    return (at * np.uint64(BLOCK_BITS // 64)).astype(np.int64), mix(keys ^ np.uint64(0xA24BAED4963EE407))


def contained(table: np.ndarray, keys: np.ndarray, first: np.ndarray | int, blocks: np.ndarray | int) -> np.ndarray:
    """Places of the keys that the filter may hold."""
    alive = np.arange(len(keys))
    at, bits = probes(keys, first, blocks)
    for k in range(PROBES):
        place = (bits >> np.uint64(9 * k)) & np.uint64(511)
        word = table[at + (place >> np.uint64(6)).astype(np.int64)]
        hit = ((word >> (place & np.uint64(63))) & np.uint64(1)).astype(bool)
        alive, at, bits = alive[hit], at[hit], bits[hit]
    return alive


@dataclass(frozen=True)
class Filter:
    """``first`` and ``blocks`` say, by unit, where its part begins and how large it is (0: not in this filter)."""

    table: np.ndarray
    first: np.ndarray
    blocks: np.ndarray

    def places(self, keys: np.ndarray, units: np.ndarray | int = 0) -> np.ndarray:
        return contained(self.table, keys, self.first[units], self.blocks[units])


def build(keys: DataFrame, first: np.ndarray, blocks: np.ndarray) -> Filter:
    """The filter of (unit int, key long); units without blocks are left out.

    Tasks OR their keys' bits by 64-bit word, Spark ORs those by word; what comes to the driver is the
    table itself, at most eight words a block.
    """

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = batch.column("unit").to_numpy(zero_copy_only=False).astype(np.int64)
            key = batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            in_it = blocks[unit] > 0
            unit, key = unit[in_it], key[in_it]
            at, rest = probes(key, first[unit], blocks[unit])
            places = [(rest >> np.uint64(9 * k)) & np.uint64(511) for k in range(PROBES)]
            word = np.concatenate([at + (p >> np.uint64(6)).astype(np.int64) for p in places])
            mask = np.concatenate([np.uint64(1) << (p & np.uint64(63)) for p in places])
            order = np.argsort(word, kind="stable")
            word, mask = word[order], mask[order]
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
            ored = np.bitwise_or.reduceat(mask, starts) if len(word) else mask
            yield pa.RecordBatch.from_arrays([pa.array(word[starts]), pa.array(ored.view(np.int64))], ["word", "mask"])

    words = keys.mapInArrow(bits, "word long, mask long").groupBy("word").agg(F.expr("bit_or(mask)").alias("mask")).toArrow()
    table = np.zeros(int(blocks.sum()) * BLOCK_BITS // 64, np.uint64)
    table[words.column("word").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
    return Filter(table, first, blocks)
