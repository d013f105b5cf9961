"""Token ids of whole texts by a public tokenizer file, at the speed of a dictionary look-up.

The byte-level BPE splits a text into pre-tokens before it merges, and a single space before a non-space, as well as a
single line feed between non-spaces, always begins a pre-token. So a text is cut there, Arrow reduces the pieces of a
batch to distinct ones, and the tokenizers library sees only pieces that this worker has not met. Texts with other
white space or with runs of it go to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from codecs import charmap_decode

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import keep

# Anything beyond single spaces and single line feeds.
_ODD = (
    r"[ \n][ \n]|[\x00-\x09\x0b-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
)

#: Letters of Latin scripts (in UTF-8, up to U+024F), after a space or not, then up to three punctuation marks: these are one pre-token after a letter.
_LATIN = re.compile(rb"( ?(?:[A-Za-z]++|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf]|\xc9[\x80-\x8f]|\xc2[\xaa\xb5\xba])++)([.,;:!?#$%&*]{0,3})\Z")
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_REST = [b for b in range(256) if b not in _PLAIN]
#: The byte-level alphabet by byte: printable Latin-1 stands for itself, the other bytes for code points from 256 on.
_ALPHABET = "".join(chr(b if b in _PLAIN else 256 + _REST.index(b)) for b in range(256))


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces of large strings without nulls, and how many there are up to the begin of each text and in all. A piece begins with a text, at a space, at a line feed and after one, so some are empty."""
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset)
    data = data or pa.py_buffer(b"")
    seen = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
    spaces, feeds = (np.flatnonzero(seen == c) + bounds[0] for c in (32, 10))
    starts = np.concatenate((bounds[:-1], spaces, feeds, feeds + 1, bounds[-1:]))
    starts.sort(kind="stable")  # merges the parts
    counts = np.arange(len(bounds)) + np.searchsorted(spaces, bounds) + 2 * np.searchsorted(feeds, bounds)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), data]), counts


class Encoder:
    """encode(texts): an array of uint32 ids for each text; null counts as empty. Two generations of pieces are kept, `most` of them in all; those met again move to the younger one."""

    def __init__(self, path: str, most: int = 1_200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.most = most
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.marks: dict[bytes, bytes] = {b"": b""}

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, _ODD)
        out: list = [None] * len(texts)
        at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(at):
            for i, ids in zip(at, self.whole(texts.filter(odd).to_pylist()), strict=True):
                out[i] = ids
        plain = texts.filter(pc.invert(odd)) if len(at) else texts
        rest = np.flatnonzero(~odd.to_numpy(zero_copy_only=False)) if len(at) else np.arange(len(texts))
        if len(rest):
            for i, ids in zip(rest, self._pieces(plain), strict=True):
                out[i] = ids
        return out

    def _token(self, pre: bytes) -> bytes:
        """Ids of one pre-token."""
        return array("I", [t.id for t in self.library.model.tokenize(charmap_decode(pre, "strict", _ALPHABET)[0])]).tobytes()

    def _learn(self, words: list[bytes]) -> None:
        """Ids of new pieces. A Latin word, alone or with punctuation marks, is one or two pre-tokens: the library's BPE model takes these as they are; the rest go through the whole library."""
        known, older, marks, token, others = self.known, self.older, self.marks, self._token, []
        for w in words:
            if m := _LATIN.match(w):
                stem, mark = m.groups()
                if not mark:
                    known[w] = token(w)
                    continue
                if mark not in marks:
                    marks[mark] = token(mark)
                known[w] = (known.get(stem) or older.get(stem) or token(stem)) + marks[mark]
            else:
                others.append(w)
        for at in range(0, len(others), 20_000):
            part = others[at : at + 20_000]
            for w, e in zip(part, self.library.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                known[w] = array("I", e.ids).tobytes()

    def _look_up(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces. When the younger generation is full, it becomes the older one."""
        blobs = list(map(self.known.get, words))
        if at := [i for i, ids in enumerate(blobs) if ids is None]:
            missed = [words[i] for i in at]
            met = list(map(self.older.get, missed))
            if len(self.known) + len(missed) > self.most // 2:
                self.older, self.known = self.known, {}
            self.known.update((w, ids) for w, ids in zip(missed, met, strict=True) if ids is not None)
            self._learn([w for w, ids in zip(missed, met, strict=True) if ids is None])
            for i, w in zip(at, missed, strict=True):
                blobs[i] = self.known[w]
        return blobs

    def _pieces(self, texts: pa.Array) -> list[np.ndarray]:
        pieces, counts = cut(texts)
        coded = pieces.dictionary_encode()
        codes = coded.indices.to_numpy()
        blobs = self._look_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        pool = np.frombuffer(b"".join(blobs), "<u4")
        first = np.cumsum(sizes) - sizes
        each = sizes[codes]
        ends = np.concatenate(([0], np.cumsum(each)))
        ids = pool[np.repeat(first[codes] - ends[:-1], each) + np.arange(ends[-1])]
        bounds = ends[counts]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def encoder(path: str, spare: bool = False) -> Encoder:
    """The worker's encoder for a file; what it has learnt stays for the worker's later tasks of this kind. spare: a third of the pieces, beside other operators."""
    return keep(("encoder", path, spare), lambda: Encoder(path, 400_000) if spare else Encoder(path))


def at_once(spare: bool = False) -> int:
    """Bytes of text to encode at once: the more, the fewer pieces are looked up twice."""
    return 2 << 20 if spare else 8 << 20


def tokenizer_path(path: str | None) -> str:
    """The vocabulary file; by default the public byte-level BPE of 50k ids, looked up where the code runs."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
