"""Castagnoli checksums of many byte strings at once.

Without start value the checksum is linear, so a string may be cut into lanes of 64
bytes: all lanes of all strings advance together, then each lane's value is moved past
the lanes behind it and the values of a string are xored. Zeros in front change nothing.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

POLYNOMIAL = 0x82F63B78
LANE = 64
MASK_DELTA = 0xA282EAD8  # fixed value of the record format


@lru_cache(maxsize=1)
def byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), t >> np.uint32(1))
    return t


@lru_cache(maxsize=1)
def pair_table() -> np.ndarray:
    t, pairs = byte_table(), np.arange(65536, dtype=np.uint32)
    once = t[pairs & 255] ^ (pairs >> np.uint32(8))
    return t[once & 255] ^ (once >> np.uint32(8))


def moved(values: np.ndarray, tables: np.ndarray) -> np.ndarray:
    out = tables[0][values & 255]
    for k in (1, 2, 3):
        out = out ^ tables[k][(values >> np.uint32(8 * k)) & 255]
    return out


@lru_cache(maxsize=40)
def mover(level: int) -> np.ndarray:
    """Tables that move a value past 2**level lanes of zeros."""
    if level:
        return np.stack([moved(row, mover(level - 1)) for row in mover(level - 1)])
    rows = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for _ in range(LANE // 2):
        rows = pair_table()[rows & 65535] ^ (rows >> np.uint32(16))
    return rows


def crc32c_many(parts: list[bytes]) -> np.ndarray:
    """Checksums of the strings; the start value is xored into their first four bytes."""
    if not parts:
        return np.zeros(0, np.uint32)
    sizes = np.array([max(4, len(x)) for x in parts], np.int64)
    lanes = -(-sizes // LANE)
    ends = np.cumsum(lanes)
    flat = np.zeros(int(ends[-1]) * LANE, np.uint8)
    for part, end in zip(parts, ends * LANE, strict=True):
        if part:
            flat[end - len(part) : end] = np.frombuffer(part, np.uint8)
    long = np.flatnonzero(sizes == [len(x) for x in parts])
    for k in range(4):
        flat[ends[long] * LANE - sizes[long] + k] ^= 255
    state, steps = np.zeros(int(ends[-1]), np.uint32), flat.view("<u2").reshape(-1, LANE // 2).T.copy()
    table = pair_table()
    for step in steps:
        state = table[(state ^ step) & 65535] ^ (state >> np.uint32(16))
    behind = np.repeat(ends, lanes) - 1 - np.arange(int(ends[-1]))
    for level in range(int(behind.max()).bit_length()):
        at = np.flatnonzero((behind >> level) & 1)
        state[at] = moved(state[at], mover(level))
    out = np.bitwise_xor.reduceat(state, ends - lanes) ^ np.uint32(0xFFFFFFFF)
    for i in set(range(len(parts))).difference(long.tolist()):
        value = 0xFFFFFFFF
        for b in parts[i]:
            value = int(byte_table()[(value ^ b) & 255]) ^ (value >> 8)
        out[i] = value ^ 0xFFFFFFFF
    return out


def masked(values: np.ndarray) -> np.ndarray:
    turned = (values >> np.uint32(15)) | (values << np.uint32(17))
    return turned + np.uint32(MASK_DELTA)
