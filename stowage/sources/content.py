"""Reading files inside tasks with bounded memory."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import BinaryIO

from pyarrow import fs

from ..functions.keys import PARTIAL_HEX, SAMPLE_BYTES, check_strategy

CHUNK_BYTES = 1 << 20


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """File system and inner path of a local path or URI."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def _chunks(stream: BinaryIO) -> Iterator[bytes]:
    while block := stream.read(CHUNK_BYTES):
        yield block


def stream_key(stream: BinaryIO, size: int, strategy: str, sample: int = SAMPLE_BYTES) -> str:
    """Content key of a seekable stream; equal to the column expressions.

    ``size_partial`` reads three samples at most; the others read once in chunks.
    """
    check_strategy(strategy)
    if strategy == "size_crc":
        crc = 0
        for block in _chunks(stream):
            crc = zlib.crc32(block, crc)
        return f"{size}_{crc:08x}"
    digest = hashlib.sha256()
    if strategy == "full":
        for block in _chunks(stream):
            digest.update(block)
        return f"{size}_{digest.hexdigest()}"
    offsets = [0]
    if size > 2 * sample:
        offsets.append(size // 2)
    if size > sample:
        offsets.append(size - sample)
    for offset in offsets:
        stream.seek(offset)
        digest.update(stream.read(sample))
    return f"{size}_{digest.hexdigest()[:PARTIAL_HEX]}"
