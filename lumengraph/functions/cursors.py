"""Offset cursors: base64url over a MessagePack map of one small integer."""

from __future__ import annotations

import base64
import struct


def encode(offset: int) -> str:
    if offset < 0:
        raise ValueError("an offset is not negative")
    if offset < 128:
        number = bytes([offset])
    elif offset < 1 << 8:
        number = b"\xcc" + bytes([offset])
    elif offset < 1 << 16:
        number = b"\xcd" + struct.pack(">H", offset)
    elif offset < 1 << 32:
        number = b"\xce" + struct.pack(">I", offset)
    else:
        number = b"\xcf" + struct.pack(">Q", offset)
    return base64.urlsafe_b64encode(b"\x81\xa1o" + number).decode()


def decode(cursor: str | None) -> int:
    """The offset; 0 for none, and for one that can't be read."""
    try:
        data = base64.urlsafe_b64decode((cursor or "") + "=" * (-len(cursor or "") % 4))
    except ValueError:
        return 0
    if data[:3] != b"\x81\xa1o":
        return 0
    kind, rest = data[3:4], data[4:]
    if kind and kind[0] < 128 and not rest:
        return kind[0]
    sizes = {b"\xcc": 1, b"\xcd": 2, b"\xce": 4, b"\xcf": 8}
    return int.from_bytes(rest, "big") if sizes.get(kind) == len(rest) else 0
