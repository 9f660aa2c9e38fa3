"""Token-id shards: independent zstandard frames, a document index, and a trailing seek table with checksums.

A shard is a plain zstandard stream.  Each document is a frame of its own (with zstandard's own content checksum), so
a reader decompresses the documents it asks for and nothing else.  Two skippable frames follow, which ordinary
decoders pass over:

1. the document index: `LFDI`, version, bytes a token, number of documents, then a zstandard frame of the ids (int64),
   null flags (uint8) and token counts (uint32);
2. the seek table of the published zstandard seekable format: for each frame its compressed size, decompressed size
   and the lower 32 bits of the XXH64 of its content; then the number of frames, a descriptor and a magic number.

Cases: a document without tokens is an empty frame; ids may repeat and may be null; a shard without documents has both
tables, empty.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
import zstandard

#: Fixed values of the format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEKABLE_MAGIC, CHECKSUMS = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1, 0x80
_HEAD = struct.Struct("<II")
_INDEX = struct.Struct("<4sBBxxQ")
_FOOT = struct.Struct("<IBI")
ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])


def _check(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class ShardWriter:
    """add() documents in order, then close().  `out` needs write() only."""

    def __init__(self, out, width: int = 4, level: int = 3):
        self.out, self.width = out, width
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.entries: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.counts: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        ids = np.asarray(ids)
        if len(ids) and int(ids.max()) >> (8 * self.width):
            raise ValueError(f"id {int(ids.max())} does not fit into {self.width} bytes")
        raw = np.ascontiguousarray(ids, dtype=f"<u{self.width}").tobytes()
        frame = self.zstd.compress(raw)
        self.out.write(frame)
        self.entries.append((len(frame), len(raw), _check(raw)))
        self.ids.append(doc_id)
        self.counts.append(len(ids))

    def close(self) -> None:
        null = np.array([x is None for x in self.ids], dtype="u1")
        ids = np.array([x or 0 for x in self.ids], dtype="<i8")
        index = self.zstd.compress(ids.tobytes() + null.tobytes() + np.array(self.counts, dtype="<u4").tobytes())
        index = _INDEX.pack(b"LFDI", 1, self.width, len(self.ids)) + index
        self.out.write(_HEAD.pack(SKIPPABLE_INDEX, len(index)) + index)
        table = np.array(self.entries, dtype=ENTRY).tobytes()
        self.out.write(_HEAD.pack(SKIPPABLE_SEEK, len(table) + _FOOT.size) + table + _FOOT.pack(len(self.entries), CHECKSUMS, SEEKABLE_MAGIC))


class ShardReader:
    """Reads a shard from a seekable file; decompresses only the documents asked for and verifies each."""

    def __init__(self, file):
        self.file = file
        end = file.seek(0, 2)
        if end < _FOOT.size:
            raise ValueError("not a token shard: too short")
        file.seek(end - _FOOT.size)
        n, flags, magic = _FOOT.unpack(file.read(_FOOT.size))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUMS:
            raise ValueError("not a token shard: no seek table with checksums at its end")
        at = end - _FOOT.size - n * ENTRY.itemsize
        file.seek(at)
        self.entries = np.frombuffer(file.read(n * ENTRY.itemsize), dtype=ENTRY)
        self.starts = np.concatenate([[0], np.cumsum(self.entries["packed"], dtype=np.int64)])
        file.seek(int(self.starts[-1]))
        kind, size = _HEAD.unpack(file.read(_HEAD.size))
        if kind != SKIPPABLE_INDEX:
            raise ValueError("token shard without document index")
        index = file.read(size)
        name, version, self.width, docs = _INDEX.unpack(index[: _INDEX.size])
        if (name, version, docs) != (b"LFDI", 1, n):
            raise ValueError("token shard with a damaged document index")
        self.zstd = zstandard.ZstdDecompressor()
        body = self.zstd.decompress(index[_INDEX.size :])
        ids, null = np.frombuffer(body, "<i8", n), np.frombuffer(body, "u1", n, 8 * n)
        self.ids = [None if z else int(i) for i, z in zip(ids, null, strict=True)]
        self.counts = np.frombuffer(body, "<u4", n, 9 * n)

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document."""
        self.file.seek(int(self.starts[k]))
        packed, size, check = (int(x) for x in self.entries[k])
        frame = self.file.read(packed)
        raw = self.zstd.decompress(frame, max_output_size=max(size, 1)) if size else b""
        if len(raw) != size or _check(raw) != check:
            raise ValueError(f"frame {k} fails its checksum")
        return np.frombuffer(raw, dtype=f"<u{self.width}")

    def find(self, doc_ids: Iterable[int | None]) -> Iterator[tuple[int | None, np.ndarray]]:
        wanted = set(doc_ids)
        for k, i in enumerate(self.ids):
            if i in wanted:
                yield i, self.document(k)
