"""CRC-32 of any span of a buffer from two running CRCs.

The CRC register is linear over GF(2): with M the step of one zero byte, the
register of a span (start value 0) is ``R_end ^ M^length R_start``, where R are the
running registers of the whole buffer.  So one scan serves every span; ``shift``
applies M^length with four table look-ups for each base-256 digit of the length.

The scan itself is vectorised in blocks of 256 bytes: byte b at place r of its
block enters as M^-(r + 1) T[b] (one look-up), a prefix XOR sums the block, and
the register after r bytes is M^r of that sum and the carry of earlier blocks.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BLOCK = 256
#: Bytes scanned at a time; it bounds the temporaries (a multiple of BLOCK).
PIECE = 1 << 20
ONES = np.uint32(0xFFFFFFFF)


def _byte_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> np.uint32(1)) ^ np.uint32(0xEDB88320), x >> np.uint32(1))
    return x


BYTE = _byte_table()


def _unstep(x: np.ndarray) -> np.ndarray:
    """M^-1: the top byte of a table entry tells the byte that was shifted out."""
    low = np.argsort(BYTE >> np.uint32(24))[x >> np.uint32(24)].astype(np.uint32)
    return ((x ^ BYTE[low]) << np.uint32(8)) | low


@lru_cache(maxsize=1)
def _places() -> np.ndarray:
    """(place in the block, byte) -> M^-(place + 1) T[byte]."""
    out = np.empty((BLOCK, 256), dtype=np.uint32)
    x = BYTE
    for r in range(BLOCK):
        x = out[r] = _unstep(x)
    return out


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (tables[0][x & np.uint32(255)] ^ tables[1][(x >> np.uint32(8)) & np.uint32(255)]
            ^ tables[2][(x >> np.uint32(16)) & np.uint32(255)] ^ tables[3][x >> np.uint32(24)])


@lru_cache(maxsize=8)
def _shifts(digit: int) -> np.ndarray:
    """Tables of M^(i * 256^digit), i = 0..255: shape (256, 4, 256)."""
    unit = (np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    if digit:
        before = _shifts(digit - 1)
        step = _apply(before[1], before[255])  # M^255 then M, in units of the digit before
    else:
        step = (unit >> np.uint32(8)) ^ BYTE[unit & np.uint32(255)]
    out = np.empty((256, 4, 256), dtype=np.uint32)
    out[0] = unit
    for i in range(1, 256):
        out[i] = _apply(step, out[i - 1])
    return out


def shift(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """M^n x, element by element: the registers after n more zero bytes."""
    x, n = np.broadcast_arrays(np.asarray(x, dtype=np.uint32), np.asarray(n, dtype=np.int64))
    out, digit = x.copy(), 0
    while len(n) and int(n.max()) >> (8 * digit):
        d = (n >> (8 * digit)) & 255
        at = np.flatnonzero(d) if digit else slice(None)
        flat, y, base = _shifts(digit).reshape(-1), out[at], d[at] << 10
        out[at] = (flat[base + (y & np.uint32(255))] ^ flat[base + 256 + ((y >> np.uint32(8)) & np.uint32(255))]
                   ^ flat[base + 512 + ((y >> np.uint32(16)) & np.uint32(255))] ^ flat[base + 768 + (y >> np.uint32(24))])
        digit += 1
    return out


def running(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Registers (start value 0) after the first ``at[i]`` bytes; ``at`` ascends."""
    out = np.empty(len(at), dtype=np.uint32)
    whole = [t.tolist() for t in _shifts(1)[1]]  # M^256
    carry = 0
    for lo in range(0, len(data) + 1, PIECE):
        part = data[lo:lo + PIECE]
        m = len(part) // BLOCK + 1
        x = np.zeros(m * BLOCK, dtype=np.uint8)
        x[:len(part)] = part
        x = _places()[np.arange(BLOCK), x.reshape(m, BLOCK)]
        np.bitwise_xor.accumulate(x, axis=1, out=x)
        before = []
        for last in x[:, -1].tolist():
            before.append(carry)
            carry ^= last
            carry = (whole[0][carry & 255] ^ whole[1][(carry >> 8) & 255]
                     ^ whole[2][(carry >> 16) & 255] ^ whole[3][carry >> 24])
        first, stop = np.searchsorted(at, [lo, lo + PIECE])
        p = at[first:stop] - lo
        k, r = p // BLOCK, p % BLOCK
        u = np.array(before, dtype=np.uint32)[k] ^ np.where(r > 0, x[k, r - 1], 0)
        out[first:stop] = shift(u, r)
        carry = before[-1] if len(part) == PIECE else carry
    return out


def of_spans(start: np.ndarray, end: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of spans from the running registers at their start and end."""
    return shift(start ^ ONES, length) ^ end ^ ONES


def combine(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of a concatenation from the parts' CRCs and the second's length."""
    return shift(first, length) ^ second
