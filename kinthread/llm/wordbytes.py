"""Words of UTF-8 texts by byte tables: bytes are folded, then split at white space."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Bytes of a text that are split into words at once.
SLICE = 1 << 20


def byte_table(spaces: Iterable[int], breaks: Iterable[int] = ()) -> bytes:
    """A translation of bytes: A-Z lower-cased, ``spaces`` to a space, ``breaks`` to a line feed."""
    table = bytearray(range(256))
    table[0x41:0x5B] = range(0x61, 0x7B)
    for i in spaces:
        table[i] = 0x20
    for i in breaks:
        table[i] = 0x0A
    return bytes(table)


def slices(data: bytes, size: int = SLICE) -> Iterator[bytes]:
    """``data`` in runs of about ``size`` bytes that begin at a space or line feed; words stay whole."""
    at = 0
    while len(data) - at > size:
        cut = max(data.rfind(b" ", at + 1, at + size), data.rfind(b"\n", at + 1, at + size))
        if cut < 0:
            found = [i for i in (data.find(b" ", at + size), data.find(b"\n", at + size)) if i >= 0]
            if not found:
                break
            cut = min(found)
        yield data[at:cut]
        at = cut
    yield data[at:]


def utf8(texts: pa.Array) -> Iterator[bytes]:
    """The bytes of each text; of a null, none."""
    for x in texts.cast(pa.binary()) if not pa.types.is_binary(texts.type) else texts:
        yield x.as_py() or b""
