"""Hashed byte n-grams of whole texts, vectorised over a batch."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: White space and control bytes become a space.
_FOLD = bytes(0x20 if i < 0x20 else i for i in range(256))


def folded(text: str | None) -> bytes:
    """Lower-cased UTF-8 with single spaces, one at either end."""
    return b" " + b" ".join((text or "").lower().encode("utf-8", "replace").translate(_FOLD).split()) + b" "


def gram_ids(data: bytes, sizes: Sequence[int], bits: int) -> np.ndarray:
    """The hashed n-grams of ``data``, all sizes one after the other; n is part of the hash."""
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    out = []
    for n in sizes:
        m = len(b) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, dtype=np.uint32)
        for j in range(n):
            h *= np.uint32(0x01000193)
            h ^= b[j : j + m]
        h *= np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA77)
        out.append(h >> np.uint32(32 - bits))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


#: Bytes of letters and digits; beyond ASCII all bytes count as such.
_LETTER = np.array([chr(i).isalnum() or i >= 0x80 for i in range(256)])
#: First bytes of characters of scripts without spaces (U+3000 to U+D7FF, and from U+10000): each is a word of its own.
_ALONE = np.array([0xE3 <= i <= 0xED or i >= 0xF0 for i in range(256)])


def word_starts(data: bytes, sizes: Sequence[int], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the first ``size - 1`` bytes of each word, for all sizes.

    A word begins at a letter or digit behind anything else, and at every
    character of scripts without spaces. position is that of the byte before.
    ``data`` must begin with a space and end with max(sizes) of them.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    letter = _LETTER[raw]
    at = np.flatnonzero(letter[1:] & (~letter[:-1] | _ALONE[raw[1:]]))
    b = raw.astype(np.uint32)
    h = np.full(len(at), 0x20 * 0x01000193 & 0xFFFFFFFF, dtype=np.uint32)
    out = []
    for j in range(max(sizes)):
        if j:
            h = (h ^ b[at + j]) * np.uint32(0x01000193)
        if j + 1 in sizes:
            g = (h ^ np.uint32(j)) * np.uint32(0x9E3779B1)
            g ^= g >> np.uint32(15)
            out.append((g * np.uint32(0x85EBCA77)) >> np.uint32(32 - bits))
    return np.tile(at, len(out)), np.concatenate(out)


def groups(texts: Sequence[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about ``most`` bytes, one at least."""
    begin = size = 0
    for i, text in enumerate(texts):
        if i > begin and size + len(text) > most:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def word_starts_by_part(data: bytes, sizes: Sequence[int], bits: int, size: int = 1 << 22) -> Iterator[np.ndarray]:
    """The hashes of ``word_starts`` for a folded text, about ``size`` bytes at a time."""
    data += b" " * max(sizes)
    for low in range(0, len(data), size):
        # a part begins with the byte before its first position, as a whole text does
        at, grams = word_starts(data[low : low + size + max(sizes)] + b" " * max(sizes), sizes, bits)
        yield grams[at < size]
