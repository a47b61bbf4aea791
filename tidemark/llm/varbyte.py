"""Byte-aligned variable-length coding with separate control bytes.

A value takes 1 to 4 data bytes, little end first. A control byte holds four 2-bit lengths (less 1), the first
value in its low bits. Decoding looks each control byte up in a table of 256 rows, so numpy decodes all values at
once. Small values take one byte, which is why ids are ranked by frequency first.
"""

from __future__ import annotations

import numpy as np

#: Lengths of the four values of each control byte.
LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit ``values``."""
    v = np.ascontiguousarray(values, "<u4")
    n = (1 + (v > 0xFF) + (v > 0xFFFF) + (v > 0xFFFFFF)).astype(np.uint8)
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = n - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) < n[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The ``count`` values of :func:`pack`."""
    if not count:
        return np.zeros(0, np.uint32)
    n = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    start = np.cumsum(n, dtype=np.int64) - n
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    v = raw[start].astype(np.uint32)
    for k in (1, 2, 3):
        if (more := n > k).any():
            v[more] |= raw[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return v
