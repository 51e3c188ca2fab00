"""Vectorised word scanning over Arrow string batches.

Texts stay in their UTF-8 buffer; words are found, lower-cased (A-Z only) and hashed
with numpy, so no Python object is made per word. Null texts count as empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Words of up to so many bytes are hashed in vectorised steps of eight bytes, longer ones by a digest.
_STEPPED = 32
_COEFS = np.random.Generator(np.random.PCG64(20240517)).integers(1, 1 << 63, size=16, dtype=np.uint64) | _U(1)
#: Of eight bytes read from a word's place, those that belong to its last n.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(in_word) -> np.ndarray:
    """A table of 256 flags; bytes from 0x80 on belong to words when 0x80 does."""
    return np.array([bool(in_word(b)) for b in range(256)])


#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z: digits, letters, all non-ASCII.
ALNUM = byte_class(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
#: `[^\x20\x09-\x0D]+`: all but ASCII white space.
NON_SPACE = byte_class(lambda b: not (b == 32 or 9 <= b <= 13))


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def row_blocks(column: pa.Array, target: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole rows of about ``target`` bytes; a longer row stands alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + column.offset + 1)[column.offset :]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + target, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def padded(data: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """A copy, mapped by ``table``, with eight zero bytes behind it, so that eight bytes can be read from any place."""
    out = np.zeros(len(data) + 8, dtype=np.uint8)
    if table is None:
        out[:-8] = data
    else:
        np.take(table, data, out=out[:-8])
    return out


def _eight(data: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number, without those beyond the ``left`` ones of its word."""
    view = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    return view[at] & _MASKS[np.minimum(left, 8)]


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words ``data[starts:ends]`` of padded data.

    Up to seven bytes it is one-to-one. Longer words are mixed eight bytes at a time, those above
    32 bytes are digested; so no structure of a word, but chance alone, gives two words one hash.
    """
    size = ends - starts
    total = mix(_eight(data, starts, size) + (np.minimum(size, 8).astype(np.uint64) << _U(56)))
    some = np.flatnonzero(size > 7)
    if len(some):
        at, left, h = starts[some], size[some], total[some]
        h = mix(_eight(data, at, left) + _COEFS[15])
        for step in range(8, _STEPPED, 8):
            more = np.flatnonzero(left > step)
            if not len(more):
                break
            h[more] = mix(mix(h[more] * _COEFS[14]) ^ _eight(data, at[more] + step, left[more] - step))
        total[some] = mix(h ^ left.astype(np.uint64) * _COEFS[13])
        for k in np.flatnonzero(size > _STEPPED).tolist():
            total[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return total


def same_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, others: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether the k-th words of two lists hold the same bytes; both data are padded."""
    size = ends - starts
    same = size == other_ends - others
    left = np.flatnonzero(same)
    for step in range(0, 256, 8):
        left = left[size[left] > step]
        if not len(left):
            return same
        equal = _eight(data, starts[left] + step, size[left] - step) == _eight(other, others[left] + step, size[left] - step)
        same[left[~equal]] = False
        left = left[equal]
    for k in left[size[left] > 256].tolist():
        same[k] = np.array_equal(data[starts[k] : ends[k]], other[others[k] : other_ends[k]])
    return same


class Words:
    """Words of a block of texts: byte ``starts`` and ``ends``, ``hashes``, the padded and folded ``data``, and, for row i, the slice ``first[i]:first[i+1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, fold: bool = True):
        inside = np.zeros(len(data) + 2, dtype=bool)
        np.take(table, data, out=inside[1:-1])
        change = inside[1:] != inside[:-1]  # change[i]: a word begins or ends before byte i
        edges = np.unique(offsets)
        edges = edges[(edges > 0) & (edges < len(data))]
        joined = edges[inside[edges] & inside[edges + 1]]  # one text's last word touches the next one's first
        change[joined] = True
        points = np.flatnonzero(change)
        if len(joined):
            points = np.sort(np.concatenate([points, joined]))
        self.starts, self.ends = points[::2], points[1::2]
        self.first = np.searchsorted(self.starts, offsets)
        self.data = padded(data, LOWER if fold else None)
        self.hashes = hashed(self.data, self.starts, self.ends)


def hash_words(words: list[str], table: np.ndarray) -> np.ndarray:
    """Hashes of single words, equal to those that Words gives."""
    raw = [w.encode() for w in words]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return Words(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets, table).hashes


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted, without repeats."""
    values = np.sort(values)
    if len(values) > 1:
        keep = np.empty(len(values), dtype=bool)
        keep[0] = True
        np.not_equal(values[1:], values[:-1], out=keep[1:])
        values = values[keep]
    return values


def shingle_sets(words: Words, size: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its shingles; a shorter text is one shingle, no words give none."""
    hashes, first = words.hashes, words.first
    total = np.zeros(max(0, len(hashes) - size + 1), dtype=np.uint64)
    for j in range(size):
        total += hashes[j : len(total) + j] * _COEFS[j]
    total = mix(total)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= size:
            yield distinct(total[a : b - size + 1])
        elif b > a:
            yield mix((hashes[a:b] * _COEFS[: b - a]).sum(keepdims=True, dtype=np.uint64) + _U(int(b - a) * int(_COEFS[14]) % (1 << 64)))
        else:
            yield hashes[a:b]
