"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

Features are rates and counts of a whole text: words of a lexicon that labelled rows teach and of a small fixed one, how many
of them stand near the second person, obfuscated ones (look-alike characters, symbols inside, stretched or spaced letters),
capitals and punctuation. The trees and the isotonic regression are Spark's own (`pyspark.ml`), fitted on at most `rows`
labelled rows, those of the smallest hashes of their ids, without repeated texts.

A learned word is one whose count in toxic texts is so far above its share that fewer than one such word is expected by
chance (likelihood ratio against the number of words tried). Rows are in folds: what a row's features know of the lexicon
comes from the other folds, so trees don't learn to trust words that only their own row taught. The trees learn from all
folds but one, which the calibration keeps for itself.

Cases: null and empty texts have features of 0 and get a score like all others; ids that are null or have no label never
teach, labels other than 0 and 1 don't count, of repeated labels the largest counts; with labels of one class or none the
score is the smoothed rate of toxic rows (0.5 without any). Repeated rows are scored one by one, long texts in pieces of
Arrow batches as a whole. Columns other than id, text and label are never read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .langid import held_out
from .shared import release, slices, stage, unstage
from .terms import WORDS, alphabet, counted, cut, data_of

FOLDS = 4

# Insults and pronouns of the second person in four languages.
INSULTS = {
    "asshole", "bastard", "bitch", "clown", "coward", "creep", "cretin", "disgusting", "dumb", "dumbass", "fool", "freak", "garbage", "idiot", "imbecile",
    "jerk", "liar", "loser", "moron", "pathetic", "pig", "psycho", "retard", "scum", "shit", "stupid", "trash", "vermin", "worthless",
    "abschaum", "arschloch", "depp", "dreckig", "dumm", "dummkopf", "ekelhaft", "hurensohn", "schwein", "trottel", "vollidiot", "wertlos",
    "abruti", "connard", "connasse", "crétin", "débile", "minable", "ordure", "pourriture", "salaud", "salope", "stupide",
    "asqueroso", "basura", "cabrón", "estúpido", "estúpida", "gilipollas", "idiota", "imbécil", "inútil", "mierda", "patético", "tonto",
}
SECOND_PERSON = {
    "you", "your", "yours", "yourself", "yourselves", "youre", "u", "ur", "du", "dich", "dir", "dein", "deine", "deiner", "ihr", "euch", "euer", "eure",
    "tu", "te", "toi", "ton", "tes", "vous", "votre", "vos", "ti", "tus", "tú", "usted", "ustedes", "vosotros",
}
LOOK_ALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"})

NAMES = (
    "words", "chars", "strongest", "hits", "hit_rate", "kinds", "weight_rate", "insults", "insult_rate", "hidden", "hidden_rate", "second_person",
    "near", "near_rate", "capitals", "shouted", "exclamations", "questions", "symbols", "runs", "broken_words", "mixed_words", "stretched_words",
)
NEAR = 5

_SPACED = alphabet((0x00, 0x20), (0x7F, 0x7F), lower=False)
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_EDGES = ".,;:!?\"'()[]{}*%&$#-_/\\|~<>"
_STRETCHED = re.compile(r"(.)\1\1")
_LETTER = re.compile(r"[^\W\d_]")
_HIT, _INSULT, _HIDDEN, _SECOND, _SHOUTED, _BROKEN, _MIXED, _STRETCH = (1 << k for k in range(8))


_CLASSES = [np.isin(np.arange(256), list(x)) for x in (range(65, 91), [*range(65, 91), *range(97, 123), *range(0xC0, 256)], b"!", b"?", b"#$%&*+<=>@^_`{|}~\\")]


class Lexicon:
    """Weights of words; what a spelling means is kept for the next time."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.squeezed = {squeezed(w): x for w, x in weights.items()}
        self.plain = {squeezed(w) for w in INSULTS}
        self.known: dict[bytes, tuple[float, int]] = {}

    def meaning(self, spelling: bytes) -> tuple[float, int]:
        """(weight, flags) of a run of bytes between spaces."""
        got = self.known.get(spelling)
        if got is None:
            if len(self.known) > 300_000:
                self.known.clear()
            got = self.known[spelling] = self._meaning(spelling.decode("utf-8", "replace"))
        return got

    def _meaning(self, spelling: str) -> tuple[float, int]:
        small = spelling.lower()
        inner = small.strip(_EDGES)
        if inner.isalpha():  # most spellings are one word
            stretched = _STRETCHED.search(inner) is not None
            weight = self.weights.get(inner, 0.0)
            flags = _HIT * (weight > 0) | _INSULT * (inner in INSULTS) | _SECOND * (inner in SECOND_PERSON) | _SHOUTED * (len(small) > 2 and spelling.isupper()) | _STRETCH * stretched
            return (weight, flags) if not stretched or flags & (_HIT | _INSULT) else self._seen_through(small, inner, weight, flags)
        terms = _TERM.findall(small)
        if not terms:
            return 0.0, 0
        flags = 0
        weight = max((self.weights.get(t, 0.0) for t in terms), default=0.0)
        if weight > 0:
            flags |= _HIT
        if any(t in INSULTS for t in terms):
            flags |= _INSULT
        if any(t in SECOND_PERSON for t in terms):
            flags |= _SECOND
        if len(small) > 2 and spelling.isupper():
            flags |= _SHOUTED
        broken = not inner.isalnum() and len(inner) > 2
        mixed = any(c.isdigit() for c in small) and _LETTER.search(small) is not None
        stretched = _STRETCHED.search(inner) is not None
        flags |= _BROKEN * broken | _MIXED * mixed | _STRETCH * stretched
        return (weight, flags) if flags & (_HIT | _INSULT) or not (broken or mixed or stretched) else self._seen_through(small, inner, weight, flags)

    def _seen_through(self, small: str, inner: str, weight: float, flags: int) -> tuple[float, int]:
        """What a disguised spelling means: look-alikes read as letters, symbols left out, runs of a letter as one."""
        for form in (small, inner):
            for read in (form.translate(LOOK_ALIKE), form):
                x = squeezed("".join(_LETTER.findall(read)))
                if len(x) > 2 and (x in self.squeezed or x in self.plain):
                    return max(weight, self.squeezed.get(x, 0.0)), flags | _HIDDEN
        return weight, flags

    def joined(self, letters: str) -> tuple[float, int]:
        """Letters that stood apart, read as one word."""
        x = squeezed(letters.lower().translate(LOOK_ALIKE))
        return (self.squeezed.get(x, 0.0), _HIDDEN) if x in self.squeezed or x in self.plain else (0.0, 0)


def squeezed(word: str) -> str:
    """Each run of equal letters as one."""
    return re.sub(r"(.)\1+", r"\1", word)


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """A row of NAMES' values for each text."""
    data, offsets = data_of(texts)
    n = len(texts)
    rows, spelled = cut(data, offsets, _SPACED)
    coded = spelled.dictionary_encode()
    codes = coded.indices.to_numpy()
    meant = [lexicon.meaning(s) for s in coded.dictionary.to_pylist()]
    weight = np.fromiter((m[0] for m in meant), float, len(meant))[codes]
    flags = np.fromiter((m[1] for m in meant), np.int64, len(meant))[codes]
    sizes = pa.compute.binary_length(coded.dictionary).to_numpy()[codes]
    _spaced(rows, spelled, sizes, weight, flags, lexicon)
    per = lambda mask: np.bincount(rows[mask], minlength=n).astype(float)
    words = np.bincount(rows, minlength=n).astype(float)
    hit = (flags & (_HIT | _HIDDEN)) != 0
    bad = hit | ((flags & _INSULT) != 0)
    strongest = np.zeros(n)
    np.maximum.at(strongest, rows[weight > 0], weight[weight > 0])
    kinds = np.unique(rows[bad] * max(1, len(meant)) + codes[bad]) // max(1, len(meant))
    near = _near(rows, np.flatnonzero(bad), np.flatnonzero(flags & _SECOND))
    class_of = lambda mask: _sums(mask, offsets)
    upper, letters, bang, ask, symbol = (table[data] for table in _CLASSES)
    again = np.zeros(len(data), bool)
    again[1:] = (data[1:] == data[:-1]) & (bang | ask | symbol)[1:]
    chars = (offsets[1:] - offsets[:-1]).astype(float)
    w, c = np.maximum(words, 1), np.maximum(chars, 1)
    hits, insults, hidden = per(hit), per((flags & _INSULT) != 0), per((flags & _HIDDEN) != 0)
    close = np.bincount(rows[near], minlength=n).astype(float)
    return np.column_stack([
        np.log1p(words), np.log1p(chars), strongest, np.log1p(hits), hits / w, np.log1p(np.bincount(kinds, minlength=n)), np.bincount(rows, weights=weight, minlength=n) / w,
        np.log1p(insults), insults / w, np.log1p(hidden), hidden / w, per((flags & _SECOND) != 0) / w, np.log1p(close), close / w,
        class_of(upper) / np.maximum(class_of(letters), 1), per((flags & _SHOUTED) != 0) / w, class_of(bang) / c, class_of(ask) / c, class_of(symbol) / c, class_of(again) / c,
        per((flags & _BROKEN) != 0) / w, per((flags & _MIXED) != 0) / w, per((flags & _STRETCH) != 0) / w,
    ])


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each row are in a class."""
    if len(offsets) < 2:
        return np.zeros(0)
    out = np.add.reduceat(np.append(mask, False), offsets[:-1], dtype=np.int64).astype(float)
    out[offsets[1:] == offsets[:-1]] = 0
    return out


def _near(rows: np.ndarray, bad: np.ndarray, you: np.ndarray) -> np.ndarray:
    """Those places of `bad` that have one of `you` within NEAR words of the same row."""
    if not len(bad) or not len(you):
        return bad[:0]
    after = np.searchsorted(you, bad)
    ok = np.zeros(len(bad), bool)
    for at in (np.maximum(after - 1, 0), np.minimum(after, len(you) - 1)):
        ok |= (np.abs(you[at] - bad) <= NEAR) & (rows[you[at]] == rows[bad])
    return bad[ok]


def _spaced(rows: np.ndarray, spelled: pa.Array, sizes: np.ndarray, weight: np.ndarray, flags: np.ndarray, lexicon: Lexicon) -> None:
    """Marks words whose letters stand apart, in runs of three letters and more."""
    alone = np.flatnonzero(sizes == 1)
    if len(alone) < 3:
        return
    parts = np.split(alone, np.flatnonzero((np.diff(alone) != 1) | (np.diff(rows[alone]) != 0)) + 1)
    for run in parts:
        if len(run) >= 3:
            got = lexicon.joined(b"".join(spelled.take(pa.array(run)).to_pylist()).decode("ascii", "ignore"))
            if got[1]:
                weight[run[0]], flags[run[0]] = got[0], flags[run[0]] | got[1]


# --- learning ---


@dataclass
class Model:
    weights: dict[str, float]
    trees: Any = None
    scale: Any = None
    rate: float = 0.5


def _fold(key: str = "_id") -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), F.col(key)), F.lit(FOLDS)).cast("int")


def learning_rows(docs: DataFrame, labels: DataFrame, *, rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(_text, _fold, _toxic) of at most `rows` labelled rows that may teach, without repeated texts."""
    may = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("_toxic")).filter("_toxic in (0, 1) and doc_id is not null").filter(~held_out())
    told = may.groupBy("doc_id").agg(F.max("_toxic").cast("int").alias("_toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    mine = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    joined = mine.join(F.broadcast(told), F.col("_id") == F.col("doc_id"))  # `rows` ids and labels at most
    return joined.groupBy(F.xxhash64("_text").alias("_same")).agg(F.first("_text").alias("_text"), F.max("_toxic").alias("_toxic"), F.min("_id").alias("_id")).select("_text", _fold().alias("_fold"), "_toxic")


def lexicons(sample: DataFrame) -> list[dict[str, float]]:
    """For each fold the words that the other folds teach, then those that all teach: log ratios of their shares among toxic and other texts."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, 8 << 20):
                who, term, _, names = counted(part.column(0), WORDS)
                cell = np.array(part.column(1).to_numpy() * 2 + part.column(2).to_numpy(), np.int64)[who]
                both, n = np.unique(term * 2 * FOLDS + cell, return_counts=True)
                yield pa.record_batch({"term": names.take(pa.array(both // (2 * FOLDS))).cast(pa.string()), "cell": pa.array((both % (2 * FOLDS)).astype(np.int32)), "n": pa.array(n.astype(np.int64))})

    cells = sample.mapInArrow(seen, "term string, cell int, n bigint")
    at = [F.sum(F.when(F.col("cell") == k, F.col("n")).otherwise(0)).alias(f"c{k}") for k in range(2 * FOLDS)]
    by = cells.groupBy("term").agg(*at)
    size = {(r[0], r[1]): r[2] for r in sample.groupBy("_fold", "_toxic").count().collect()}
    tried = by.count()
    out = []
    for left_out in (*range(FOLDS), None):
        folds = [f for f in range(FOLDS) if f != left_out]
        good, bad = (sum(size.get((f, y), 0) for f in folds) for y in (0, 1))
        if not good or not bad:
            out.append({})
            continue
        x, n = (sum((F.col(f"c{2 * f + y}") for f in folds), F.lit(0)).cast("double") for y in (1, 0))
        share = F.lit(bad / (good + bad))
        log = lambda v, e: F.when(v > 0, v * F.log(v / e)).otherwise(0.0)
        ratio = 2 * (log(x, (x + n) * share) + log(n, (x + n) * (1 - share)))
        told = by.filter((x > (x + n) * share) & (ratio > 2 * math.log(max(2, tried)))).select("term", F.log((x + 0.5) / (bad + 1) / ((n + 0.5) / (good + 1))).alias("w"))
        out.append({r[0]: r[1] for r in told.collect()})  # fewer words than a bounded sample's texts can teach
    return out


def _with_features(df: DataFrame, text: str, fold: str | None, books: list[dict[str, float]], keep: list[str]) -> DataFrame:
    """keep's columns and `features`; rows of a fold by that fold's lexicon."""
    kinds = [df.schema[c] for c in keep]
    schema = ", ".join(f"`{k.name}` {k.dataType.simpleString()}" for k in kinds) + ", features array<double>"
    cols = [*keep, *([fold] if fold else []), text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        made: dict[int, Lexicon] = {}
        for batch in batches:
            for part in slices(batch, len(cols) - 1, 8 << 20):
                texts = part.column(len(cols) - 1)
                which = part.column(len(keep)).to_numpy() if fold else np.zeros(part.num_rows, np.int64)
                values = np.zeros((part.num_rows, len(NAMES)))
                for k in np.unique(which).tolist():
                    here = np.flatnonzero(which == k)
                    values[here] = features(texts.take(pa.array(here)) if fold else texts, made.setdefault(k, Lexicon(books[k])))
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, len(NAMES)), pa.int32()), pa.array(values.ravel()))
                yield pa.record_batch([*[part.column(i) for i in range(len(keep))], listed], [*keep, "features"])

    return df.select(*cols).mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, *, rows: int = 16_000, trees: int = 40, depth: int = 3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    sample = stage(learning_rows(docs, labels, rows=rows, id_col=id_col, text_col=text_col, label_col=label_col), "labelled").repartition(16)
    size = dict(map(tuple, sample.groupBy("_toxic").count().collect()))
    rate = (size.get(1, 0) + 1) / (size.get(0, 0) + size.get(1, 0) + 2)
    if len(size) < 2:
        return Model({}, rate=rate)
    books = lexicons(sample)
    made = stage(_with_features(sample, "_text", "_fold", books, ["_toxic", "_fold"]).repartition(4), "features")
    ready = made.select(F.col("_toxic").cast("double").alias("label"), "_fold", array_to_vector("features").alias("features"))
    own, apart = ready.filter("_fold > 0"), ready.filter("_fold = 0")
    if own.select("label").distinct().count() < 2:
        own = ready
    boosted = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, minInstancesPerNode=5 if sum(size.values()) > 500 else 1, seed=7).fit(own)
    if apart.select("label").distinct().count() < 2:
        apart = ready
    scale = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="score").fit(boosted.transform(apart).select(_margin(), "label"))
    unstage(made)
    return Model(books[-1], boosted, scale, rate)


def _margin() -> Column:
    return F.get(vector_to_array("rawPrediction"), F.lit(1)).alias("margin")


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    if model.trees is None:
        out = rows.select("doc_id", F.lit(float(model.rate)).alias("score"))
    else:
        made = _with_features(rows, "_text", None, [model.weights], ["doc_id"])
        grown = model.trees.transform(made.withColumn("features", array_to_vector("features"))).select("doc_id", _margin())
        out = model.scale.transform(grown).select("doc_id", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= least).cast("int"))
