"""Header of the native binary container: magic, version, length of the metadata, compression, five spare bytes."""

import struct
from dataclasses import dataclass

MAGIC, VERSION = b"VORN", 1
_LAYOUT = struct.Struct("<4sHIB5x")


@dataclass(frozen=True)
class Header:
    metadata_length: int
    compression: int = 0
    version: int = VERSION

    def encode(self) -> bytes:
        return _LAYOUT.pack(MAGIC, self.version, self.metadata_length, self.compression)


def decode(data: bytes) -> Header:
    if len(data) < _LAYOUT.size:
        raise ValueError("the header is cut short")
    magic, version, length, compression = _LAYOUT.unpack(data[: _LAYOUT.size])
    if magic != MAGIC:
        raise ValueError(f"bad magic {magic!r}")
    if version != VERSION:
        raise ValueError(f"version {version} is not known")
    return Header(length, compression, version)
