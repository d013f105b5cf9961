"""Terms of many texts at once: bytes are looked up in a table of 256 classes, so a batch is cut without a loop over its words.

All code points beyond ASCII belong to terms, so cuts at ASCII bytes never part a code point.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def alphabet(*breaks: tuple[int, int], lower: bool = True) -> np.ndarray:
    """What each byte becomes: 0 for bytes in the given ranges, which part terms; A-Z in lower case."""
    out = np.arange(256, dtype=np.uint8)
    if lower:
        out[65:91] += 32
    for a, b in breaks:
        out[a : b + 1] = 0
    return out


#: Runs of letters, digits and code points beyond ASCII.
WORDS = alphabet((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: The same without digits.
LETTERS = alphabet((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def data_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each row's begin and the last's end); null rows are empty."""
    texts = texts.fill_null("") if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else texts.fill_null(b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def cut(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(row of each term, the terms) of rows that lie one behind the other."""
    if not len(data):
        return np.zeros(0, np.int64), pa.array([], pa.binary())
    made = table[data]
    inside = made != 0
    new = np.zeros(len(data) + 1, bool)
    new[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | new[1:-1]
    begin = np.flatnonzero(begin)
    kept = np.flatnonzero(inside)
    bounds = np.append(np.searchsorted(kept, begin), len(kept)).astype(np.int32)
    terms = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(made[inside])])
    return np.searchsorted(offsets, begin, "right") - 1, terms


def counted(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, number of the term, occurrences) of each pair of a text and a term, ordered by term and row, and the terms by number in byte order."""
    return pairs(*cut(*data_of(texts), table))


def pairs(rows: np.ndarray, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    coded = terms.dictionary_encode()
    names = coded.dictionary
    order = pa.compute.sort_indices(names).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    n = int(rows.max()) + 1 if len(rows) else 1
    both, times = np.unique(rank[coded.indices.to_numpy()] * n + rows, return_counts=True)
    return both % n, both // n, times, names.take(pa.array(order))
