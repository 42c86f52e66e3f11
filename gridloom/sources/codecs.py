"""Chunk decoding: raw, zlib, gzip, zstd, lz4, and Blosc frames of published version 2."""

from __future__ import annotations

import gzip
import struct
import zlib

import numpy as np
import pyarrow as pa

#: Compressor ids that ``decode`` reads.
KNOWN = (None, "zlib", "gzip", "zstd", "lz4", "blosc")
# The frame's codec numbers (bits 5 to 7 of its flags) and flag bits.
CODECS = {1: "lz4_raw", 2: "snappy", 3: "zlib", 4: "zstd"}
SHUFFLED, COPIED, BITS_SHUFFLED, WHOLE_BLOCKS = 1, 2, 4, 16
#: A block is cut into one stream a byte of the type if each of them has so many bytes.
LEAST_STREAM, MOST_STREAMS = 128, 16


def _unpack(codec: str, data: bytes, size: int) -> bytes:
    if codec == "zlib":
        return zlib.decompress(data)
    return pa.Codec(codec).decompress(data, size).to_pybytes()


def _restore(block: bytes, width: int, flags: int) -> bytes:
    """Undoes the reordering of a block; bytes beyond whole elements (groups of 8 for bits) are as they were."""
    n = len(block) // width
    if flags & SHUFFLED and width > 1:
        head = np.frombuffer(block, np.uint8, n * width).reshape(width, n).T.tobytes()
        return head + block[n * width :]
    if flags & BITS_SHUFFLED:
        n -= n % 8
        rows = np.frombuffer(block, np.uint8, n * width).reshape(width * 8, n // 8)
        bits = np.unpackbits(rows, axis=1, bitorder="little")  # row: bit of the element, column: element
        return np.packbits(bits.T, axis=1, bitorder="little").tobytes() + block[n * width :]
    return block


def unblosc(frame: bytes) -> bytes:
    version, _, flags, width, size, block_size, length = struct.unpack_from("<BBBBIII", frame)
    if version != 2 or length != len(frame):
        raise ValueError("not a whole Blosc frame of version 2")
    if flags & COPIED:
        return frame[16 : 16 + size]
    if not size:
        return b""
    if (codec := CODECS.get(flags >> 5)) is None:
        raise ValueError("blosclz frames aren't supported")
    count = -(-size // block_size)
    out = []
    for k, at in enumerate(struct.unpack_from(f"<{count}i", frame, 16)):
        want = min(block_size, size - k * block_size)
        whole = flags & WHOLE_BLOCKS or want < block_size or width > MOST_STREAMS or block_size // width < LEAST_STREAM
        streams, parts = 1 if whole else width, []
        for _ in range(streams):
            (n,) = struct.unpack_from("<i", frame, at)
            data, each = frame[at + 4 : at + 4 + n], want // streams
            parts.append(data if n == each else _unpack(codec, data, each))
            at += 4 + n
        out.append(_restore(b"".join(parts), width, flags))
    return b"".join(out)


def decode(data: bytes, kind: str | None) -> bytes:
    match kind:
        case None:
            return data
        case "zlib":
            return zlib.decompress(data)
        case "gzip":
            return gzip.decompress(data)
        case "zstd":
            import zstandard

            return zstandard.ZstdDecompressor().decompressobj().decompress(data)
        case "lz4":  # its length goes before the block
            return _unpack("lz4_raw", data[4:], struct.unpack_from("<i", data)[0])
        case "blosc":
            return unblosc(data)
    raise ValueError(f"unknown compressor {kind!r}")
