"""Arrays of small integers and word lists as compact byte strings (byte planes, zstd)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

#: Made once: a new one for every array costs more than a short array's compression.
_SQUEEZE, _OPEN = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers below 2^64: count, used byte planes, planes one after the other."""
    v = np.ascontiguousarray(values, dtype="<u8")
    planes = (int(v.max()).bit_length() + 7) // 8 if len(v) else 0
    body = v.view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()
    return len(v).to_bytes(8, "little") + bytes([planes]) + _SQUEEZE.compress(body)


def unpack(blob: bytes) -> np.ndarray:
    n, planes = int.from_bytes(blob[:8], "little"), blob[8]
    body = _OPEN.decompress(blob[9:], max_output_size=max(1, n * planes))
    out = np.zeros((n, 8), dtype=np.uint8)
    if n and planes:
        out[:, :planes] = np.frombuffer(body, np.uint8).reshape(planes, n).T
    return out.reshape(-1).view("<u8")


def pack_words(words: list[str]) -> bytes:
    raw = [w.encode() for w in words]
    sizes = pack(np.fromiter(map(len, raw), np.int64, len(raw)))
    return len(sizes).to_bytes(4, "little") + sizes + _SQUEEZE.compress(b"".join(raw))


def unpack_words(blob: bytes) -> pa.StringArray:
    k = int.from_bytes(blob[:4], "little")
    sizes = unpack(blob[4:4 + k])
    off = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    data = _OPEN.decompress(blob[4 + k:], max_output_size=max(1, int(off[-1])))
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(off.tobytes()), pa.py_buffer(data))
