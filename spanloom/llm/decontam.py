"""Benchmark decontamination by a generalised suffix automaton of the test items' words.

The items' normalised words form one automaton over all items (no match runs from one item into the next). Documents are
streamed through it word by word; the state holds the longest suffix read so far that lies inside some item, so every
place where `window` item words in a row end is seen, and every place where a whole shorter item ends. Cost: one step a
word, whatever the number of items. Items are taken in blocks of at most `block_words` words, each block an automaton of
bounded size that is broadcast; further blocks are further passes, staged in between.

Cases: null or wordless texts have no hits. Items that are null or wordless match nothing. Repeated items count once by
id; a null id counts as an item written as the empty string. Repeated rows are judged one by one. Columns beyond the
named ones are carried through untouched; in mark() columns named like its results give way to these, clean() adds none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free_name, release, slices, stage

_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters and digits and of everything beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton of word sequences, with what each state says about windows and short items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.names = [name for name, _ in items]
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [[self.ids.setdefault(w, len(self.ids)) for w in item] for _, item in items]
        for seq in coded:
            last = 0
            for c in seq:
                last = self._add(last, c)
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        #: For each state the state of its suffix of `window` words, or -1.
        self.at_window = [-1] * len(self.link)
        for v in order:
            if self.length[v] >= window:
                up = self.link[v]
                self.at_window[v] = v if self.length[up] < window else self.at_window[up]
        self.inside: dict[int, set[int]] = {}
        whole: dict[int, list[tuple[int, int]]] = {}
        for k, seq in enumerate(coded):
            v = 0
            for c in seq:  # an item's own prefixes never leave the automaton
                v = self.next[v][c]
                if self.at_window[v] >= 0:
                    self.inside.setdefault(self.at_window[v], set()).add(k)
            if 0 < len(seq) < window:
                whole.setdefault(v, []).append((len(seq), k))
        #: For each state the short items that end where it ends: (words, item).
        self.short: dict[int, list[tuple[int, int]]] = {}
        for v in order:
            if own := whole.get(v, []) + self.short.get(self.link[v], []):
                self.short[v] = own

    def _add(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if (q := nxt[last].get(c)) is not None:
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        cur = self._state(length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return cur

    def _state(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.next.append(nxt)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def scan(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of words [begin, end) that lie in an occurrence of a window, disjoint and in order; items whose windows occur."""
        nxt, link, length, at_window, short, w = self.next, self.link, self.length, self.at_window, self.short, self.window
        spans: list[tuple[int, int]] = []
        states: set[int] = set()
        found: set[int] = set()
        v = n = 0
        for i, c in enumerate(map(self.ids.get, text)):
            if c is None:
                v = n = 0
                continue
            while (to := nxt[v].get(c)) is None and v:
                v = link[v]
                n = length[v]
            if to is None:
                n = 0
                continue
            v = to
            n += 1
            begin = i
            if n >= w:
                states.add(at_window[v])
                begin = i + 1 - w
            if v in short:
                for m, k in short[v]:
                    if m <= n:
                        found.add(k)
                        begin = min(begin, i + 1 - m)
            elif n < w:
                continue
            if n >= w or begin < i or any(m == 1 for m, _ in short.get(v, ())):
                while spans and spans[-1][1] >= begin:
                    begin = min(begin, spans.pop()[0])
                spans.append((begin, i + 1))
        for s in states:
            found |= self.inside[s]
        return spans, found


def _blocks(items: DataFrame, id_col: str, text_col: str, window: int, most: int) -> Iterator[Automaton]:
    """Automata of some `most` words each; items come to the driver one partition at a time and only a block is held. A longer item goes in stretches that overlap by a window less one word, so that each of its windows is in one."""
    block: list[tuple[str, list[bytes]]] = []
    size = 0
    for row in items.select(F.col(id_col).cast("string"), F.col(text_col)).toLocalIterator():
        seq = words(row[1])
        for at in range(0, max(1, len(seq) - window + 1), most):
            part = seq[at : at + most + window - 1]
            if not part:
                continue
            if block and size + len(part) > most:
                yield Automaton(block, window)
                block, size = [], 0
            block.append((row[0] or "", part))
            size += len(part)
    yield Automaton(block, window)


_SPANS, _ITEMS = T.ArrayType(T.ArrayType(T.LongType())), T.ArrayType(T.StringType())


def _merge(spans: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(map(tuple, spans)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def mark(
    docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = 10, block_words: int = 100_000,
) -> DataFrame:
    """docs with n_words, hit_spans (word positions [begin, end) inside occurrences of windows, merged) and hit_items (sorted ids)."""
    names = ("n_words", "hit_spans", "hit_items")
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c == text_col or c.lower() not in names])
    sc = docs.sparkSession.sparkContext
    return _marked(rows, (sc.broadcast(a) for a in _blocks(items, item_id, item_text, window, block_words)), text_col, names)


def _marked(docs: DataFrame, blocks: Iterable, text_col: str, named: tuple[str, str, str]) -> DataFrame:
    """docs with the three columns of marks, joined over all blocks."""
    at = docs.columns.index(text_col)
    out, first = docs, True
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, t) for n, t in zip(named, (T.LongType(), _SPANS, _ITEMS), strict=True)]])
    arrow_marks = [pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string())]
    for shared in blocks:
        if not first:
            out = stage(out, "decontam")

        def run(batches, shared=shared, first=first):
            release()
            auto = shared.value
            for batch in batches:
                for part in slices(batch, at):
                    n_words, spans, names = [], [], []
                    for text in part.column(at).to_pylist():
                        seq = words(text)
                        s, k = auto.scan(seq)
                        n_words.append(len(seq))
                        spans.append(s)
                        names.append({auto.names[x] for x in k})
                    cols = part.columns
                    if not first:
                        spans = [_merge(x + y) for x, y in zip(spans, cols[-2].to_pylist(), strict=True)]
                        names = [x | set(y) for x, y in zip(names, cols[-1].to_pylist(), strict=True)]
                        cols = cols[:-3]
                    marks = (n_words, [list(map(list, s)) for s in spans], [sorted(k) for k in names])
                    arrays = [pa.array(x, t) for x, t in zip(marks, arrow_marks, strict=True)]
                    yield pa.RecordBatch.from_arrays([*cols, *arrays], names=schema.names)

        out, first = out.mapInArrow(run, schema), False
    return out


def report(marked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per row of mark()'s result: word and hit counts, number and digest of the items found."""
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return marked.select(
        F.col(id_col), "n_words", hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"),
    )


def without(text: str, spans: list) -> str:
    """text without spans of its words, cut from first to last word and joined by a line feed."""
    places = [m.span() for m in _WORD.finditer(text)]
    keep, begin = [], 0
    for a, b in spans:
        keep.append(text[begin : places[a][0]])
        begin = places[b - 1][1]
    keep.append(text[begin:])
    return "\n".join(x.strip() for x in keep if x.strip())


def cut(text: str, auto: Automaton, coverage: float) -> str | None:
    """text without its hit spans, until nothing hits; None if more than `coverage` of its words are hit."""
    first = True
    while True:
        seq = words(text)
        spans, _ = auto.scan(seq)
        if not spans:
            return text
        if first and sum(b - a for a, b in spans) > coverage * len(seq):
            return None
        first, text = False, without(text, spans)


def clean(
    docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = 10, coverage: float = 0.5, block_words: int = 100_000,
) -> DataFrame:
    """docs, same columns, with hit spans removed from the texts; documents of which more than `coverage` is hit go. Clean rows keep their exact text.

    What is hit is judged over all blocks together, then cut, and what was cut is judged again over all blocks until nothing hits, so the outcome doesn't depend on the blocks.
    """
    sc = docs.sparkSession.sparkContext
    at = docs.columns.index(text_col)
    blocks = [sc.broadcast(a) for a in _blocks(items, item_id, item_text, window, block_words)]
    if len(blocks) == 1:  # the rounds of a text are one call
        (shared,) = blocks

        def once(batches):
            release()
            for batch in batches:
                for part in slices(batch, at):
                    old = part.column(at).to_pylist()
                    new = [x and cut(x, shared.value, coverage) for x in old]
                    keep = [x is None or y is not None for x, y in zip(old, new, strict=True)]
                    cols = part.columns
                    cols[at] = pa.array(new, part.column(at).type)
                    yield pa.RecordBatch.from_arrays(cols, names=part.schema.names).filter(pa.array(keep))

        return docs.mapInArrow(once, docs.schema)
    named = tuple(free_name(docs, n) for n in ("n_words", "hit_spans", "hit_items"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    left, out, first = docs, [], True

    def apart(batches):
        for batch in batches:
            for part in slices(batch, at):
                cols = part.columns[: len(part.columns) - 3]
                cols[at] = pa.array([without(t, s) for t, s in zip(cols[at].to_pylist(), part.column(len(cols) + 1).to_pylist(), strict=True)], cols[at].type)
                yield pa.RecordBatch.from_arrays(cols, names=part.schema.names[: len(cols)])

    while True:
        marked = stage(_marked(left, blocks, text_col, named), "decontam")
        hit = F.aggregate(named[1], F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
        out.append(marked.filter(F.size(named[1]) == 0).select(*columns))
        some = marked.filter(F.size(named[1]) > 0)
        if first:
            some = some.filter(hit <= F.lit(coverage) * F.col(named[0]))
        if some.isEmpty():
            return reduce(DataFrame.union, out)
        left, first = stage(some.mapInArrow(apart, docs.schema), "decontam-cut"), False


def digest(names: list[str]) -> str:
    """The digest that report() gives, in Python."""
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
