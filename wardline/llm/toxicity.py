"""Toxicity of texts that hide their words, by a noisy channel.

What a writer means is letters in words; what stands there may have gone through a channel that puts look-alikes for letters
(``LOOK_ALIKES``), pulls words apart by separators or spaces, and repeats letters. A token that the channel may have
touched is a lattice: each run of one character offers the letters it may stand for, a separator offers nothing or a word
break, each with a cost. The Viterbi path through it under a trigram language model of characters, counted over all documents, is
the restored token. Everything else has one path and stays as it is, lower-cased and without punctuation.

Restored texts are scored by a logistic regression over the words, and word beginnings of ``STEMS`` letters, that occur in
them. It is fitted, with a lasso that selects, a weaker one that weighs what is left, and weights of 0 or more, to at most ``ROWS`` different labelled texts of each class (those
whose least id hashes least), over at most ``FEATURES`` features that are found in two toxic texts or more and relatively oftener
there than in clean ones.

Defined results: null, empty and wordless texts get the score of a text that holds no feature; very long texts are read in pieces
of ``PIECE`` characters, which end after a word of two letters or more where there is one; rows that repeat an id are scored each; a repeated
label counts as toxic if one of them is; a row without id is neither held out nor learnt from; with no labels of
one class every score is that of the other; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.shared import broadcast_checked, cut

ROWS = 5_000
FEATURES = 5_000
CANDIDATES = 50_000
PENALTY = 2.0
STEMS = (4, 5, 6)
PIECE = 1 << 20
LABEL_ROWS = 2_000_000  # two numbers each
REMEMBERED = 200_000

# Characters that stand for letters.
LOOK_ALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
               "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
SEPARATORS = " .*_~-"
ORNAMENT = ".,;:?\"'()[]{}<>#%&*-_~`^=/\\«»¿¡…"

# Natural logarithms of what the channel does.
LOOK_ALIKE, NOT_A_LETTER, DOUBLED, ONCE, UNDOUBLED = -1.0, -9.0, -1.5, -1.0, -3.0
LIKELY, UNLIKELY = -0.2, -4.0  # that a separator beside a single letter joins, that another one breaks; the other way round

# Character classes of the language model: word break, a-z, the letters of Latin-1 from ß on, any other letter.
CLASSES = 60
_OTHER = CLASSES - 1
_CLASS = np.zeros(0x110000, np.uint8)
_CLASS[[c for c in range(0x110000) if c > 0xFF and not 0xD800 <= c < 0xE000 and chr(c).isalpha()]] = _OTHER
_CLASS[ord("a"):ord("z") + 1] = np.arange(1, 27)
_CLASS[0xDF:0x100] = np.arange(27, 60)
_CLASS[0xF7] = 0

_RUN = re.compile(r"(.)\1*", re.DOTALL)
_LONG_RUN = re.compile(r"(.)\1\1")
_DOUBLE = re.compile(r"(.)\1")
_SPACED = re.compile(r" \S(?: \S){2,}(?!\S)")
_SINGLE = re.compile(r"(?:^|[ .*_~-])[\w@$!|+€]$")  # a single letter before a place (or, reversed, after it)
_LETTER = re.compile(r"[^\W\d_]")
_SAFE_END = re.compile(r"\S\S\s")


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """``text`` in parts of some ``size`` characters that end between words, and not among single letters."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            found = _SAFE_END.search(text, end - 2)
            end = found.end() if found else len(text)
        yield text[at:end]
        at = end


def trigrams(text: str) -> np.ndarray:
    """The places, in a table of ``CLASSES`` cubed, of the text's character trigrams; a word starts after two breaks."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    held = np.concatenate([[0], _CLASS[codes], [0]]).astype(np.int32)
    held = held[np.concatenate([[True], (held[1:] > 0) | (held[:-1] > 0)])]
    last, here = held[:-1], held[1:]
    before = np.concatenate([[0], held[:-2]])
    return (np.where(last == 0, 0, before) * CLASSES + last) * CLASSES + here


def character_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How often each trigram occurs in all documents; ``CLASSES`` cubed numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            for held in batch["text"]:
                for piece in pieces(held.as_py() or ""):
                    found = trigrams(piece)
                    if len(found) < CLASSES**2:
                        place, times = np.unique(found, return_counts=True)
                        counts[place] += times
                    else:
                        counts += np.bincount(found, minlength=len(counts))
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], ["place", "times"])

    found = docs.select(F.col(text).alias("text")).mapInArrow(run, "place long, times long").groupBy("place").agg(F.sum("times").alias("times"))
    counts = np.zeros(CLASSES**3, np.int64)
    held = found.toArrow()
    counts[held["place"].to_numpy()] = held["times"].to_numpy()
    return counts


class Letters:
    """Log-probabilities of a character class after two others: trigrams over bigrams over single ones."""

    def __init__(self, counts: np.ndarray, weight: float = 5.0):
        three = counts.reshape((CLASSES,) * 3).astype(float)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        single = (one + 1) / (one.sum() + CLASSES)
        double = (two + weight * single) / (two.sum(axis=1, keepdims=True) + weight)
        triple = (three + weight * double) / (three.sum(axis=2, keepdims=True) + weight)
        self.log = np.log(triple).astype(np.float32)
        self._rows = self.log.tolist()

    def best(self, lattice: list[list[tuple[str, float]]]) -> str:
        """The likeliest text through a lattice of (letters, log-probability) choices; a space is a word break."""
        rows, paths = self._rows, {(0, 0): (0.0, None)}
        for choices in [*lattice, [(" ", 0.0)]]:
            reached: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, way) in paths.items():
                for letters, cost in choices:
                    x, y, total = a, b, score + cost
                    for letter in letters:
                        c = int(_CLASS[ord(letter)])
                        if c or y:  # breaks in a row count once
                            total += rows[x][y][c]
                            x, y = (y, c) if c else (0, 0)
                    if (x, y) not in reached or reached[x, y][0] < total:
                        reached[x, y] = total, (letters, way)
            paths = reached
        way, out = max(paths.values(), key=lambda held: held[0])[1], []
        while way:
            out.append(way[0])
            way = way[1]
        return "".join(reversed(out))


def _all_doubled(token: str) -> bool:
    doubles = sum(len(x.group(0)) for x in _DOUBLE.finditer(token))
    return doubles >= 4 and 5 * doubles > 4 * len(token)


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """What each run of one character may stand for."""
    out, undoubled = [], ONCE if _all_doubled(token) else 2 * UNDOUBLED
    for run in _RUN.finditer(token):
        char, times = run.group(1), len(run.group(0))
        if char in LOOK_ALIKES:
            choices = [(" ", NOT_A_LETTER)]
            for letter in LOOK_ALIKES[char]:
                if times == 1:
                    choices.append((letter, LOOK_ALIKE))
                else:
                    choices += [(letter, LOOK_ALIKE + (undoubled if times == 2 else ONCE)),
                                (letter * 2, LOOK_ALIKE + (0 if times == 2 else DOUBLED))]
        elif char in SEPARATORS:
            single = _SINGLE.match(token[max(0, run.start() - 2):run.start()]) or _SINGLE.match(token[run.end():run.end() + 2][::-1])
            choices = [("", LIKELY if single else UNLIKELY), (" ", UNLIKELY if single else LIKELY)]
        elif not char.isalpha():
            choices = [(" ", 0.0)]
        elif times == 1:
            choices = [(char, 0.0)]
        else:
            choices = [(char, undoubled if times == 2 else ONCE), (char * 2, 0.0 if times == 2 else DOUBLED)]
        out.append(choices)
    return out


class Restorer:
    """Restores tokens and texts, and remembers what recent tokens became."""

    def __init__(self, letters: Letters):
        self.letters, self.known = letters, {}

    def words(self, token: str) -> tuple[str, ...]:
        """The words that a lower-cased token without white space stands for."""
        if token.isalpha() and not _DOUBLE.search(token):
            return (token,)
        held = self.known.get(token)
        if held is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            held = self.known[token] = self._words(token)
        return held

    def _words(self, token: str) -> tuple[str, ...]:
        core = token.strip(ORNAMENT).rstrip("!+")
        last = _RUN.match(core[::-1])
        if last and len(last.group(0)) > 2 and not last.group(1).isalnum():
            core = core[:-len(last.group(0))]
        core = core.strip(ORNAMENT)
        if core.isalpha():
            if not _LONG_RUN.search(core) and not _all_doubled(core):
                return (core,)
        elif not _LETTER.search(core):
            return ()
        return tuple(self.letters.best(lattice(core)).split())

    def _spaced(self, low: str) -> Iterator[str]:
        """The words of single letters that stand apart."""
        for run in _SPACED.findall(" " + low.replace("\n", " ").replace("\t", " ")):
            if _LETTER.search(run):
                yield from self.letters.best(lattice(run.strip())).split()

    def read(self, text: str | None) -> Iterator[str]:
        """The words of the restored text, in pieces in order; a spaced-out run's come after its piece."""
        for piece in pieces(text or ""):
            low = piece.lower()
            for token in low.split():
                yield from self.words(token)
            yield from self._spaced(low)

    def vocabulary(self, text: str | None) -> set[str]:
        """The different words of the restored text."""
        found = set()
        for piece in pieces(text or ""):
            low = piece.lower()
            for token in set(low.split()):
                found.update(self.words(token))
            found.update(self._spaced(low))
        return found


def features(words: set[str]) -> set[str]:
    """Words, and their beginnings, marked by a caret."""
    return words | {f"^{word[:size]}" for word in words for size in STEMS if len(word) >= size}


@dataclass
class Model:
    counts: np.ndarray
    weights: dict[str, float]
    intercept: float

    def __post_init__(self):
        self._heads = {name[1:1 + STEMS[0]] for name in self.weights if name.startswith("^")}

    def score(self, words: set[str]) -> float:
        """The chance that a text of these words is toxic."""
        stems = features({word for word in words if word[:STEMS[0]] in self._heads})
        found = (words & self.weights.keys()) | (stems & self.weights.keys())
        total = self.intercept + math.fsum(self.weights[name] for name in found)
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, total))))


def lasso(rows: np.ndarray, columns: np.ndarray, labels: np.ndarray, sizes: np.ndarray, width: int, penalty: float,
          steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights of 0 or more, and the intercept, of a logistic regression on 0/1 features set at (``rows``, ``columns``), each row
    weighing ``sizes``, by accelerated proximal steps; a feature enters once it is worth ``penalty`` rows."""
    def times(weights: np.ndarray) -> np.ndarray:
        return np.bincount(rows, weights[columns], len(labels)) + weights[width]

    def back(values: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(columns, values[rows], width), values.sum())

    vector = np.ones(width + 1)
    for _ in range(20):
        vector = back(sizes * times(vector))
        norm = np.linalg.norm(vector)
        vector /= norm
    step, weights = 3.0 / norm, np.zeros(width + 1)
    ahead, t = weights, 1.0
    for _ in range(steps):
        chance = 1 / (1 + np.exp(-np.clip(times(ahead), -500, 500)))
        new = ahead - step * (back(sizes * (chance - labels)) + np.append(np.full(width, penalty), 0.0))
        new[:width] = np.maximum(new[:width], 0.0)
        t, last = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        ahead, weights = new + (last - 1) / t * (new - weights), new
    return weights[:width], float(weights[width])


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a row is kept for judging: its id's checksum leaves no remainder."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> tuple[DataFrame, dict[int, int]]:
    """``doc_id, toxic`` of at most ``rows`` different texts of each class, and how many texts each class has."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("doc_id")))
    known = cut(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    texts = cut(keyed.join(broadcast_checked(known, LABEL_ROWS), "doc_id").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")))
    sizes = {row["toxic"]: row["n"] for row in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    some = [texts.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for label in (0, 1)]
    return cut(reduce(DataFrame.union, some).select("doc_id", "toxic")), sizes


def _each(docs: DataFrame, counts: np.ndarray, schema: str, found: Callable[[Restorer, str | None], object], name: str) -> DataFrame:
    """``docs`` without ``text`` and with what ``found`` makes of each text, as ``name``."""
    kept = [column for column in docs.columns if column != "text"]
    kind = {"double": pa.float64(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}[schema]
    schema = docs.select(*kept, F.lit(None).cast(schema).alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(Letters(counts))
        for batch in batches:
            made = pa.array([found(restorer, text.as_py()) for text in batch["text"]], kind)
            yield pa.RecordBatch.from_arrays([*[batch[column] for column in kept], made], [*kept, name])

    return docs.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, most: int = FEATURES) -> Model:
    """The model of ``docs`` (``doc_id, text``) whose ``labels`` (``doc_id, toxic``) are not held out."""
    counts = character_counts(docs)
    sample, sizes = _sample(docs, labels, rows)
    if not sizes.get(1) or not sizes.get(0):
        return Model(counts, {}, -700.0 if not sizes.get(1) else 700.0)
    texts = docs.join(F.broadcast(sample), "doc_id")  # at most twice ``rows`` ids
    toxic = _each(texts.where("toxic = 1"), counts, "array<string>", lambda restorer, text: list(features(restorer.vocabulary(text))), "found")
    often = toxic.select(F.explode("found").alias("feature")).groupBy("feature").count().where("count > 1")
    often = often.orderBy(F.col("count").desc(), "feature").limit(CANDIDATES).select("feature").toArrow()["feature"].to_pylist()
    place = {name: i for i, name in enumerate(often)}
    both = _each(texts, counts, "binary", lambda restorer, text: np.array(
        [place[name] for name in features(restorer.vocabulary(text)) if name in place], np.int32).tobytes(), "found")
    held = both.select("toxic", "found").toArrow()  # a bounded sample, with only the candidates in it, four bytes each
    label, found = held["toxic"].to_numpy().astype(float), held["found"].to_pylist()
    lines = np.repeat(np.arange(len(found), dtype=np.int32), [len(row) // 4 for row in found])
    columns = np.frombuffer(b"".join(found), np.int32)
    n = [max(1, int((label == kind).sum())) for kind in (0, 1)]
    size = np.where(label == 1, sizes[1] / n[1], sizes[0] / n[0])
    bad, good = (np.bincount(columns, label[lines] == kind, len(often)) / n[kind] for kind in (1, 0))
    worth = bad * np.log((bad + 1e-6) / (good + 1 / n[0]))
    chosen = np.sort(np.argsort(-worth, kind="stable")[:most])
    chosen = chosen[bad[chosen] > good[chosen]]
    number = np.full(len(often), -1)
    number[chosen] = np.arange(len(chosen))
    for penalty in (PENALTY, PENALTY / 10):  # the first fit selects, the second weighs what is left
        kept = number[columns] >= 0
        weights, intercept = lasso(lines[kept], number[columns[kept]], label, size, len(chosen), penalty)
        chosen = chosen[weights > 0]
        number[:] = -1
        number[chosen] = np.arange(len(chosen))
    weights = weights[weights > 0]
    return Model(counts, {often[c]: float(w) for c, w in zip(chosen, weights)}, intercept)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row of ``docs`` (``doc_id, text``): the chance that it is toxic."""
    return _each(docs, model.counts, "double", lambda restorer, text: model.score(restorer.vocabulary(text)), "score")


def restored(docs: DataFrame, counts: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, words``: the words of each restored text."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return _each(rows, counts, "array<string>", lambda restorer, held: list(restorer.read(held)), "words")


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """Per row of ``docs`` its ``doc_id``, whether it is ``held_out``, its ``score`` and what that means: ``predicted``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("toxic"))
    found = scored(rows, fit(rows, known))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
