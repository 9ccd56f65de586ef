"""Words and word shingles of whole columns of texts in numpy."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from tessel.llm.common import ONLY, distinct, eights, strings

#: Words are runs of ASCII letters (lower-cased), digits and non-ASCII bytes.
SMALL = np.array([c + 32 if 65 <= c < 91 else c for c in range(256)], np.uint8)
WORD = np.array([48 <= c < 58 or 97 <= c < 123 or c >= 128 for c in range(256)])
#: Words of another kind: runs of anything but a blank or one of the five bytes from tab on.
SOLID = np.array([c != 32 and not 9 <= c < 14 for c in range(256)])
_BASE = 0xD1342543DE82EF95
_KEY = b"tessel words"


def mix(x: np.ndarray) -> np.ndarray:
    """A well-spread permutation of unsigned 64-bit integers."""
    x = np.asarray(x, np.uint64)
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow column of strings without nulls, and the n + 1 offsets of its texts."""
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data and len(column) else np.zeros(0, np.uint8)
    return raw, offsets - offsets[:1]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of ``inside``; no run crosses from one text into the next."""
    inside = np.append(inside, False)
    opens = np.zeros(len(inside), bool)
    opens[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | opens[1:]
    return np.flatnonzero(first), np.flatnonzero(inside[:-1] & (~inside[1:] | first[1:])) + 1


def hashes(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit names of the byte strings between ``begins`` and ``ends``, which don't overlap.

    The strings are told apart byte for byte. Up to seven bytes and their number are a name as they
    are, mixed; up to 64 bytes are mixed in eight by eight; longer strings have a keyed BLAKE2b.
    """
    which, short, long = distinct(raw, begins, ends)
    size = np.fromiter(map(len, long), np.int64, len(long))
    full = np.frombuffer(b"".join(long), np.uint8)
    at, name = np.cumsum(size) - size, mix(size.astype(np.uint64) ^ np.uint64(_BASE))
    for k in range(8):
        more = np.flatnonzero((size > 8 * k) & (size <= 64))
        chunk = eights(full, at[more] + 8 * k) & ONLY[np.minimum(size[more] - 8 * k, 8)]
        name[more] = mix(name[more] ^ mix(chunk + np.uint64(k + 1)))
    for k in np.flatnonzero(size > 64).tolist():
        name[k] = int.from_bytes(hashlib.blake2b(long[k], digest_size=8, key=_KEY).digest(), "little")
    return np.concatenate([mix(short), name])[which]


def words(column: pa.Array, kind: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray]:
    """Names of all words (runs of bytes of a ``kind``) in order, and the n + 1 bounds of each text among them."""
    raw, offsets = texts_of(column)
    raw = SMALL[raw]
    begins, ends = spans(kind[raw], offsets)
    return hashes(raw, begins, ends), np.searchsorted(begins, offsets)


def digests(column: pa.Array, kind: np.ndarray = WORD) -> list[bytes]:
    """BLAKE2b (256 bits) of the words of each text with a blank behind each; of the text itself if it has none."""
    raw, offsets = texts_of(column)
    small = SMALL[raw]
    begins, ends = spans(kind[small], offsets)
    after = np.cumsum(ends - begins)
    body = np.insert(np.frombuffer(strings(small, begins, ends).buffers()[2], np.uint8), after, 32).tobytes()
    at = np.append(0, after + np.arange(1, len(after) + 1))[np.searchsorted(begins, offsets)].tolist()
    whole, offsets = raw.tobytes(), offsets.tolist()
    out = []
    for k in range(len(column)):
        own, key = (body[at[k] : at[k + 1]], b"words") if at[k + 1] > at[k] else (whole[offsets[k] : offsets[k + 1]], b"text")
        out.append(hashlib.blake2b(own, digest_size=32, key=key).digest())
    return out


def shingles(word: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different shingles of each text as (text number, 64-bit name, count), by text, then name.

    A text of fewer words than ``width`` has one shingle of them all, one without words has none.
    There may be 65,536 texts (``portions`` gives half of that).
    """
    n = np.diff(bounds)
    rolled = np.zeros(len(word), np.uint64)
    for k in range(min(width, len(word))):
        rolled[: len(word) - k] = rolled[: len(word) - k] * np.uint64(_BASE) + word[k:]
    text = np.repeat(np.arange(len(n)).astype(np.uint16), n)
    whole = np.arange(len(word)) + width <= np.repeat(bounds[1:], n)
    text, rolled = text[whole], rolled[whole]
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        only = np.array([int(np.bitwise_xor.reduce(mix(word[bounds[k] : bounds[k + 1]] + np.arange(n[k]).astype(np.uint64)))) for k in short], np.uint64)
        text, rolled = np.r_[text, short.astype(np.uint16)], np.r_[rolled, only]
    item = mix(rolled)
    order = np.argsort(item)
    order = order[np.argsort(text[order], kind="stable")]
    text, item = text[order], item[order]
    first = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (item[1:] != item[:-1])]) if len(item) else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, len(item)])
    return text[first].astype(np.int64), item[first], count
