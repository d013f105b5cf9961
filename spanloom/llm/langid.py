"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities for all pieces of a fixed public vocabulary. A word's probability is the sum over all
ways to cut it into pieces, by the forward algorithm, so no single segmentation decides. A text's score is the sum of its
words' log probabilities. Words are met again and again, so a worker keeps the log probabilities of words it has seen,
for all languages at once, and only new ones go through the forward pass, many at a time in numpy. Pieces are found by a
trie over the whole vocabulary; the forward variables are rescaled as they go, so words may have any length. Words of
over `WORD` bytes are first cut where no piece reaches across, which leaves the sum as it is.

Training: pieces are counted in `rows` labelled documents at most (a documented bound; about as many from each language,
those of the smallest hashes of their ids), by expectation-maximisation over all segmentations of the stretches that no
piece leaves, however long. Nothing but text enters a prediction.

Cases: null texts and texts without a letter are `und` with score 0. Ties go to the alphabetically first language. Null
labels and null ids teach nothing. Without any labelled row everything is `und`. Repeated rows are predicted one by one.
Columns of the documents that are named like the results (`lang_pred`, `score`) give way to these in predict() and are
kept as they are by accept().
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free_name, release, slices
from .tokens import tokenizer_path

#: Words of more bytes are cut where no piece reaches across, and are not remembered.
WORD = 64
#: Positions after which forward and backward variables are rescaled; 32 bytes of the least likely pieces stay far from underflow.
STRIDE = 16
UNKNOWN = "und"


def vocabulary(path: str) -> list[bytes]:
    """The byte strings of a byte-level vocabulary, sorted: printable Latin-1 stands for itself, other bytes for code points from 256 on. Every single byte is among them, so every text has a segmentation."""
    from tokenizers import Tokenizer

    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    out = {bytes([b]) for b in range(256)}
    for piece in Tokenizer.from_file(path).get_vocab():
        if piece and all(c in back for c in piece):
            out.add(bytes(back[c] for c in piece))
    return sorted(out)


class Trie:
    """A double-array trie of pieces: the child of node v by byte b is base[v] + b if check says that it is v's; piece: a node's piece, or -1."""

    def __init__(self, pieces: list[bytes]):
        self.sizes = np.array([len(p) for p in pieces])
        children: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        for k, p in enumerate(pieces):
            v = 0
            for b in p:
                to = children[v].get(b)
                if to is None:
                    to = children[v][b] = len(children)
                    children.append({})
                    ends.append(-1)
                v = to
            ends[v] = k
        room = len(children) + 1024
        taken = bytearray(room)
        taken[0] = 1
        base, place = [0] * len(children), [0] * len(children)
        free = further = 1  # the first free slot, and where the last node with several children went: nodes with one fill the holes
        for v in sorted(range(len(children)), key=lambda v: -len(children[v])):
            if not (kids := sorted(children[v])):
                continue
            while taken[free]:
                free += 1
            at = free if len(kids) == 1 else further  # the first child's slot
            while True:
                if at + 256 >= len(taken):
                    taken.extend(bytes(len(taken)))
                if not any(taken[at + b - kids[0]] for b in kids):
                    break
                at += 1
            if len(kids) > 1:
                further = at
            base[v] = at - kids[0]
            for b in kids:
                taken[base[v] + b] = 1
                place[children[v][b]] = base[v] + b
        n = len(taken) + 512
        self.base, self.check, self.piece = np.zeros(n, np.int32), np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        for v in range(len(children)):
            self.base[place[v]], self.piece[place[v]] = base[v], ends[v]
            for to in children[v].values():
                self.check[place[to]] = place[v]

    def step(self, nodes: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Children by letters, and which of them there are."""
        to = self.base[nodes] + letters
        return to, self.check[to] == nodes


def occurrences(words: list[bytes], trie: Trie):
    """For each start from 0: (length, words, pieces) of all pieces that begin there; words of one length."""
    n = len(words[0])
    letters = np.frombuffer(b"".join(words), np.uint8).reshape(-1, n)
    for start in range(n):
        alive = np.arange(len(words))
        nodes = np.zeros(len(words), np.int32)
        found = []
        for k in range(1, n - start + 1):
            nodes, ok = trie.step(nodes, letters[alive, start + k - 1] if k > 1 else letters[:, start])
            if k > 1:
                alive, nodes = alive[ok], nodes[ok]
            if not len(alive):
                break
            piece = trie.piece[nodes]
            hit = np.flatnonzero(piece >= 0)
            if len(hit):
                found.append((k, alive[hit], piece[hit]))
        yield start, found


def spans(word: bytes, trie: Trie) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, pieces) of all pieces in one word, by start; all starts at once."""
    letters = np.frombuffer(word, np.uint8)
    alive, nodes, k = np.arange(len(word)), np.zeros(len(word), np.int32), 0
    out = []
    while len(alive):
        nodes, ok = trie.step(nodes, letters[alive + k])
        alive, nodes, k = alive[ok], nodes[ok], k + 1
        piece = trie.piece[nodes]
        hit = piece >= 0
        out.append((alive[hit], np.full(hit.sum(), k), piece[hit]))
        inside = alive + k < len(word)
        alive, nodes = alive[inside], nodes[inside]
    starts, sizes, pieces = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(starts, kind="stable")
    return starts[order], sizes[order], pieces[order]


def stretches(word: bytes, trie: Trie) -> list[bytes]:
    """The word cut wherever no piece reaches across: its sum over segmentations is the product of theirs."""
    starts, sizes, _ = spans(word, trie)
    across = np.zeros(len(word) + 1, np.int64)
    long = sizes > 1
    np.add.at(across, starts[long] + 1, 1)
    np.add.at(across, starts[long] + sizes[long], -1)
    cuts = np.flatnonzero(np.cumsum(across)[1:-1] == 0) + 1
    bounds = [0, *cuts.tolist(), len(word)]
    return [word[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _rescale(values: np.ndarray, logs: np.ndarray) -> None:
    """Divides a window of variables (positions x words x languages) by its largest, and notes the logarithms."""
    top = values.max(0)
    top[top <= 0] = 1
    values /= top
    logs += np.log(top)


def forward(words: list[bytes], trie: Trie, probs: np.ndarray) -> np.ndarray:
    """Log probability of each word (all of one length) in each language, summed over all segmentations. probs: pieces x languages."""
    n = len(words[0])
    alpha = np.zeros((n + 1, len(words), probs.shape[1]))
    alpha[0] = 1
    logs = np.zeros(alpha.shape[1:])
    for start, found in occurrences(words, trie):
        if start and start % STRIDE == 0:
            _rescale(alpha[start:], logs)
        for k, hit, piece in found:
            alpha[start + k, hit] += alpha[start, hit] * probs[piece]
    return np.log(np.maximum(alpha[-1], 1e-300)) + logs


def forward_long(word: bytes, trie: Trie, probs: np.ndarray) -> np.ndarray:
    """forward for one word of any length: a window of variables moves along it."""
    starts, sizes, pieces = spans(word, trie)
    reach = int(sizes.max())
    bounds = np.searchsorted(starts, np.arange(len(word) + 1)).tolist()
    window = np.zeros((reach + STRIDE + 1, 1, probs.shape[1]))  # from the last multiple of STRIDE on
    window[0] = 1
    logs = np.zeros((1, probs.shape[1]))
    for start in range(len(word)):
        at = start % STRIDE
        if start and not at:
            window[:-STRIDE] = window[STRIDE:].copy()
            window[-STRIDE:] = 0
            _rescale(window, logs)
        a, b = bounds[start], bounds[start + 1]
        window[at + sizes[a:b], 0] += window[at, 0] * probs[pieces[a:b]]
    last = len(word) % STRIDE or STRIDE
    return (np.log(np.maximum(window[last], 1e-300)) + logs)[0]


def expected(words: list[bytes], trie: Trie, probs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expected counts of pieces, by forward and backward passes; counts: words x languages."""
    n = len(words[0])
    found = list(occurrences(words, trie))
    alpha, beta = np.zeros((n + 1, len(words), probs.shape[1])), np.zeros((n + 1, len(words), probs.shape[1]))
    a_logs, b_logs = np.zeros_like(alpha), np.zeros_like(beta)  # a variable times the exponential of its number here is its true value
    alpha[0] = beta[n] = 1
    for start, pieces in found:
        if start and start % STRIDE == 0:
            top = alpha[start:].max(0)
            top[top <= 0] = 1
            alpha[start:] /= top
            a_logs[start:] += np.log(top)
        for k, hit, piece in pieces:
            alpha[start + k, hit] += alpha[start, hit] * probs[piece]
    for start, pieces in reversed(found):
        b_logs[start] = b_logs[start + 1]
        for k, hit, piece in pieces:
            beta[start, hit] += beta[start + k, hit] * probs[piece] * np.exp(b_logs[start + k, hit] - b_logs[start, hit])
        if start and start % STRIDE == 0:
            b_logs[start] += np.log(beta[start])
            beta[start] = 1
    out = np.zeros_like(probs)
    whole = np.log(np.maximum(alpha[n], 1e-300)) + a_logs[n]
    for start, pieces in found:
        for k, hit, piece in pieces:
            share = np.exp(np.minimum(a_logs[start, hit] + b_logs[start + k, hit] - whole[hit], 700))
            np.add.at(out, piece, alpha[start, hit] * probs[piece] * beta[start + k, hit] * share * counts[hit])
    return out


def expected_long(word: bytes, trie: Trie, probs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """expected for one word of any length, with logarithms, in time and memory linear in its length; counts: languages."""
    starts, sizes, pieces = spans(word, trie)
    ends, logs, n = starts + sizes, np.log(probs), len(word)

    def sums(at: np.ndarray, other: np.ndarray, order: np.ndarray, first: int, steps) -> np.ndarray:
        """Log sums over segmentations from `first` to each position; at: a piece's end that is asked for, other: its other end."""
        out = np.zeros((n + 1, probs.shape[1]))
        bounds = np.searchsorted(at[order], np.arange(n + 2)).tolist()
        for pos in steps:
            here = order[bounds[pos] : bounds[pos + 1]]
            if pos != first:
                x = logs[pieces[here]] + out[other[here]]
                top = x.max(0)
                out[pos] = top + np.log(np.exp(x - top).sum(0))
        return out

    alpha = sums(ends, starts, np.argsort(ends, kind="stable"), 0, range(n + 1))
    beta = sums(starts, ends, np.arange(len(starts)), n, range(n, -1, -1))
    out = np.zeros_like(probs)
    for k in range(0, len(pieces), 1 << 16):
        p = pieces[k : k + (1 << 16)]
        share = np.exp(alpha[starts[k : k + (1 << 16)]] + logs[p] + beta[ends[k : k + (1 << 16)]] - alpha[n])
        np.add.at(out, p, share * counts)
    return out


def by_length(words) -> dict[int, list[bytes]]:
    out: dict[int, list[bytes]] = {}
    for w in words:
        out.setdefault(len(w), []).append(w)
    return out


def _parts(words: list[bytes], languages: int):
    """Lists of words of one length whose variables take some 8 MB."""
    most = max(1, (1 << 20) // ((len(words[0]) + 1) * max(1, languages)))
    for at in range(0, len(words), most):
        yield words[at : at + most]


def log_probs(words: list[bytes], trie: Trie, probs: np.ndarray) -> np.ndarray:
    """Log probabilities of words of any lengths, words x languages."""
    out = np.zeros((len(words), probs.shape[1]))
    pieces: dict[bytes, list[tuple[int, int]]] = {}
    for i, w in enumerate(words):
        if len(w) <= WORD:
            if w:
                pieces.setdefault(w, []).append((i, 1))
        else:
            seen: dict[bytes, int] = {}
            for s in stretches(w, trie):
                seen[s] = seen.get(s, 0) + 1
            for s, times in seen.items():
                pieces.setdefault(s, []).append((i, times))
    for n, group in by_length(pieces).items():
        for part in _parts(group, probs.shape[1]) if n <= 4 * WORD else ([w] for w in group):
            got = forward(part, trie, probs) if n <= 4 * WORD else forward_long(part[0], trie, probs)[None]
            for w, row in zip(part, got, strict=True):
                for i, times in pieces[w]:
                    out[i] += times * row
    return out


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Whole texts as words: bounds of each text's words, codes of words, distinct words (with a leading space, lower-cased)."""
    flat = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    lists = pc.split_pattern(pc.replace_substring(flat, "\n", " "), " ")
    coded = lists.flatten().dictionary_encode()
    bounds = lists.offsets.to_numpy()
    words = [b" " + w if w else w for w in coded.dictionary.cast(pa.large_binary()).to_pylist()]
    return bounds - bounds[0], coded.indices.to_numpy(), words


class Model:
    """Piece probabilities by language. A worker remembers the log probabilities of up to `most` short words; when these are full it begins anew."""

    def __init__(self, languages: list[str], trie: Trie | None, probs: np.ndarray, most: int = 200_000):
        self.languages, self.trie, self.probs, self.most = languages, trie, probs, most
        self.known: dict[bytes, int] = {}
        self.table = np.zeros((0, len(languages)), np.float32)

    def __getstate__(self):
        return (self.languages, self.trie, self.probs, self.most)

    def __setstate__(self, state):
        self.__init__(*state)

    def rows(self, words: list[bytes]) -> np.ndarray:
        """Log probabilities of distinct words."""
        at = np.fromiter((self.known.get(w, -1) for w in words), np.int64, len(words))
        unknown = np.flatnonzero(at < 0)
        out = np.empty((len(words), len(self.languages)), np.float32)
        known = at >= 0
        out[known] = self.table[at[known]]
        if len(unknown):
            new = [words[i] for i in unknown.tolist()]
            out[unknown] = got = log_probs(new, self.trie, self.probs).astype(np.float32)
            self._remember(new, got)
        return out

    def _remember(self, words: list[bytes], got: np.ndarray) -> None:
        if not len(self.table):
            self.table = np.zeros((self.most, len(self.languages)), np.float32)
        if len(self.known) + len(words) > self.most:
            self.known = {}
        for w, row in zip(words, got, strict=True):
            if len(w) <= WORD and (n := len(self.known)) < self.most:
                self.known[w] = n
                self.table[n] = row

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Log probability of each text in each language."""
        bounds, codes, words = split(texts)
        rows = self.rows(words)
        out = np.zeros((len(bounds) - 1, len(self.languages)))
        for k in range(len(self.languages)):
            total = np.concatenate(([0.0], np.cumsum(rows[codes, k].astype(np.float64))))
            out[:, k] = total[bounds[1:]] - total[bounds[:-1]]
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        if not self.languages:
            return [UNKNOWN] * n, np.zeros(n)
        logs = self.scores(texts)
        best = logs.argmax(1)
        odds = np.exp(np.minimum(logs - logs.max(1, keepdims=True), 0))
        score = odds[np.arange(n), best] / odds.sum(1)
        letter = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, letter, strict=True)], np.where(letter, score, 0.0)


def _word_counts(batches):
    """Counts of the words of each language's texts."""
    for batch in batches:
        for part in slices(batch, 1):
            langs = part.column(0)
            for lang in pc.unique(langs).to_pylist():
                _, codes, words = split(part.column(1).filter(pc.equal(langs, lang)))
                counts = np.bincount(codes, minlength=len(words)).tolist()
                out = [(w, c) for w, c in zip(words, counts, strict=True) if w]
                if out:
                    cols = [pa.array([lang] * len(out)), pa.array([w for w, _ in out], pa.binary()), pa.array([c for _, c in out], pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, names=["lang", "word", "n"])


def _sample(labelled: DataFrame, have: dict[str, int], each: int) -> DataFrame:
    """Of each language the rows of the smallest hashes of their ids, `each` at most; the same rows however the table is dealt."""
    dice = F.xxhash64("doc_id")
    share = F.lit(0.0)
    for lang, n in have.items():  # a first cut by value, half as large again as wanted
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, (1.5 * each + 100) / n))).otherwise(share)
    first = labelled.filter((F.pmod(dice, F.lit(1_000_000)) / 1_000_000) < share)
    listed = first.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(dice)), 1, each + 1).alias("h")).collect()  # numbers of a bounded share
    last = F.lit(-(1 << 63)).cast("bigint")
    for r in listed:
        last = F.when(F.col("lang") == r["lang"], F.lit(r["h"][each] if len(r["h"]) > each else (1 << 63) - 1)).otherwise(last)
    return first.filter(dice < last).select("lang", "text")


def train(labelled: DataFrame, *, rows: int = 4000, rounds: int = 3, tokenizer: str | None = None) -> Model:
    """A model from (doc_id, text, lang): `rows` rows at most (whole texts); only counts of their distinct words reach the driver."""
    labelled = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
    have = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()}  # one row a language
    languages = list(have)
    if not languages:
        return Model([], None, np.zeros((0, 0)))
    trie = Trie(vocabulary(tokenizer_path(tokenizer)))
    sample = _sample(labelled, have, max(1, rows // len(languages)))
    place = {x: k for k, x in enumerate(languages)}
    words = sample.mapInArrow(_word_counts, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    number: dict[bytes, int] = {}
    at, which, much = array("q"), array("q"), array("d")  # word, language and count: numbers on end, as there are many words
    for lang, word, n in words.toLocalIterator():  # distinct words of the sample
        for part in [bytes(word)] if len(word) <= WORD else stretches(bytes(word), trie):
            at.append(number.setdefault(part, len(number)))
            which.append(place[lang])
            much.append(n)
    counts = np.zeros((len(number), len(languages)))
    np.add.at(counts, (np.array(at, np.int64), np.array(which, np.int64)), np.array(much, float))
    start = 0.02 ** trie.sizes.astype(float)  # long pieces begin as unlikely as random bytes
    probs = np.repeat((start / start.sum())[:, None], len(languages), 1)
    groups = by_length(number)
    for _ in range(rounds):
        total = np.full_like(probs, 0.01)  # what is never met in a language keeps a small probability
        for length, group in groups.items():
            if length > 4 * WORD:
                for word in group:
                    total += expected_long(word, trie, probs, counts[number[word]])
                continue
            for part in _parts(group, len(languages)):
                total += expected(part, trie, probs, counts[[number[w] for w in part]])
        probs = total / total.sum(0)
    return Model(languages, trie, probs)


def predict(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (the posterior of the predicted language, all languages taken as equally likely)."""
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c == text_col or c.lower() not in ("lang_pred", "score")])
    return _predicted(rows, model, text_col, "lang_pred", "score")


def _predicted(docs: DataFrame, model: Model, text_col: str, lang: str, score: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x pieces of the fixed vocabulary
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches):
        release()
        for batch in batches:
            for part in slices(batch, at):
                langs, scores = shared.value.predict(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)


def learning_rows(docs: DataFrame) -> DataFrame:
    """The documents that may teach: crc32 of the id as text, modulo 3, is not 1."""
    return docs.select("doc_id", "text", "lang").filter(~held_out())


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def accept(docs: DataFrame, model: Model, *, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """docs, same columns, without those of no recognisable language or a posterior under `least`."""
    lang, score = free_name(docs, "lang_pred"), free_name(docs, "score")
    out = _predicted(docs, model, text_col, lang, score)
    return out.filter((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])
