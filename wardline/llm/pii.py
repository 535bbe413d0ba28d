"""Personal data by weak supervision.

Wide patterns propose candidate spans. Labelers of three kinds vote on each or abstain: regex labelers (the strict
form, a check of its parts), gazetteers (domains, dialling codes, issuers, names and prefixes of keys) and context
(cue words before the span, what it touches). Expectation-maximisation over the counted vote patterns of all
candidates in the corpus estimates how reliable every labeler is. The resulting probabilities train the final span
classifier, a logistic model over what a span looks like and stands in, which decides on the candidates.

Strict matches (:func:`base_spans`) always stay; the classifier adds spans, of the four kinds and of secrets (keys,
tokens, passwords). Both passes read texts in place: the first returns counts of patterns, whose number is bounded by
the votes and features, the second the spans. Nothing is shuffled but these counts.

Every pattern here runs in time linear in the text, whatever the text. Keys and named values are taken whole, however
long they are.

Defined results: a null or empty text has no spans; repeated rows get the same spans; a null id is carried through; an
empty table gives an empty result; :func:`masked` keeps all columns of its input.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.voting import posteriors

KINDS = ("email", "ip", "card", "phone", "secret")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])")
_KEY = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]{16,}+(?![A-Za-z0-9])")
_GIVEN = re.compile(
    r"(?i)(?<![a-z])(?:token|password|passwd|pwd|secret|api[_-]?key|access[_-]?key)[\"']?[ \t]{0,3}[=:][ \t]{0,3}"
    r"[\"']?([A-Za-z0-9+/_.~-]{6,}+)")

# Gazetteers: fixed values.
DOMAINS = frozenset("com org net edu gov io info biz de fr es it uk eu us ca ch at nl".split())
DIAL_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "41", "43", "44", "45", "46", "47", "48",
              "49", "51", "52", "54", "55", "56", "57", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90",
              "91", "351", "353", "358", "420")
ISSUERS = ("3", "4", "5", "6")
KEY_PREFIXES = ("AKIA", "ASIA", "ghp", "sk", "xox")
CUES = frozenset("email mail e-mail contact phone call tel mobile fax ip address host card visa credit account token "
                 "password passwd pwd secret key".split())
OTHER_CUES = frozenset("version section chapter figure page release isbn year nr no vol".split())


class Candidate(NamedTuple):
    kind: int
    start: int
    end: int
    base: bool


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    """Whether the digits' check sum is right."""
    plain, doubled = map(int, digits[::-2]), [int(d) for d in digits[-2::-2]]
    return (sum(plain) + sum(2 * d - 9 * (d > 4) for d in doubled)) % 10 == 0


def _octets_fit(match: str) -> bool:
    return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in match.split("."))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of a local part, ``@`` and a dotted domain: a match holds one ``@``, so look around each."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            floor = found.end()
            yield start, floor
        at = text.find("@", max(at + 1, floor))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Strict matches as ``(kind, start, end)`` by kind, then start; leftmost and non-overlapping in each kind,
    failing ones dropped without a retry."""
    found = [(0, *span) for span in _emails(text)]
    found += [(1, *m.span()) for m in _IP.finditer(text) if _octets_fit(m.group())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _digits(m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *m.span()))
    if "+" in text:
        found += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return found


def candidates(text: str) -> list[Candidate]:
    """The strict matches and everything the wide patterns propose that no strict match touches."""
    base = base_spans(text)
    wide: list[tuple[int, int, int]] = []
    if re.search("[0-9]", text):
        wide += [(1, *m.span()) for m in _IP.finditer(text)]
        wide += [(2, *m.span()) for m in _CARD.finditer(text) if 13 <= len(_digits(m.group())) <= 19]
        wide += [(3, *m.span()) for m in _LOCAL_PHONE.finditer(text)]
        wide += [(4, *m.span()) for m in _KEY.finditer(text) if _mixed_key(m.group())]
    if "=" in text or ":" in text:
        given, named = _Taken(), [m.span(1) for m in _GIVEN.finditer(text)]
        for span in named:
            given.add(*span)
        # A value that is named goes whole: a key that is part of it would leave the rest.
        wide = [span for span in wide if span[0] != 4 or not given.touches(*span[1:])] + [(4, *span) for span in named]
    taken = _Taken()
    for _, start, end in sorted(base, key=lambda span: span[1:]):
        taken.add(start, end)
    free = sorted({span for span in wide if not taken.touches(span[1], span[2])})
    return [Candidate(*span, True) for span in base] + [Candidate(*span, False) for span in free]


class _Taken:
    """Stretches of a text that are spoken for; each bound of a stretch sits in one sorted list."""

    def __init__(self):
        self.bounds: list[int] = []

    def touches(self, start: int, end: int) -> bool:
        at = bisect_right(self.bounds, start)
        return at % 2 == 1 or at < len(self.bounds) and self.bounds[at] < end

    def add(self, start: int, end: int) -> None:
        """Join the stretch with those that it overlaps or meets."""
        low, high = bisect_left(self.bounds, start), bisect_right(self.bounds, end)
        self.bounds[low:high] = [start] * (low % 2 == 0) + [end] * (high % 2 == 0)


def _mixed_key(text: str) -> bool:
    digits = sum("0" <= c <= "9" for c in text)
    return 2 <= digits < len(text)


_WORD_BEFORE = re.compile(r"[A-Za-z-]+")


def _before(text: str, start: int) -> list[str]:
    return [w.lower() for w in _WORD_BEFORE.findall(text[max(0, start - 40):start])[-3:]]


def _sound(kind: str, span: str) -> bool:
    """Whether the parts of a span are what its kind asks for."""
    digits = _digits(span)
    if kind == "email":
        return span.rpartition(".")[2].isalpha()
    if kind == "ip":
        return _octets_fit(span) and len(digits) >= 6
    if kind == "card":
        return luhn(digits)
    return 10 <= len(digits) <= 15 if kind == "phone" else len(set(span)) >= 8 and len(digits) >= 2


def votes(text: str, c: Candidate) -> tuple[int, ...]:
    """The labelers' votes on a candidate: 1 personal data, 2 not, 0 none."""
    span, kind = text[c.start:c.end], KINDS[c.kind]
    digits = _digits(span)
    cues = _before(text, c.start)
    form = 1 if _sound(kind, span) else 2
    if kind == "email":
        listed = int(span.rpartition(".")[2].lower() in DOMAINS)
    elif kind == "ip":
        listed = 0 if _octets_fit(span) and digits.strip("0") else 2
    elif kind == "card":
        listed = 1 if digits.startswith(ISSUERS) and len(digits) in (15, 16) else 2
    elif kind == "phone":
        listed = int(span.startswith("+") and digits.startswith(DIAL_CODES))
    else:
        listed = int(span.startswith(KEY_PREFIXES) or bool(CUES.intersection(cues[-1:])))
    context = 1 if CUES.intersection(cues) else 2 if OTHER_CUES.intersection(cues) else 0
    around = text[c.start - 1:c.start] + text[c.end:c.end + 1]
    attached = 2 if any(ch.isalnum() or ch in "_/" for ch in around) else 0
    return int(c.base), form, listed, context, attached


def looks(text: str, c: Candidate) -> tuple[int, ...]:
    """What the classifier sees: a few coarse features of a span and its surroundings."""
    span = text[c.start:c.end]
    cues = _before(text, c.start)
    letters = sum(ch.isalpha() for ch in span)
    around = text[c.start - 1:c.start] + text[c.end:c.end + 1]
    return (
        min(len(span) // 6, 7),
        min(4 * letters // max(len(span), 1), 3),
        int(_sound(KINDS[c.kind], span)),
        sum(not ch.isalnum() for ch in span[:8]) if len(span) < 8 else min(sum(not ch.isalnum() for ch in span), 4),
        int(bool(CUES.intersection(cues))) + 2 * int(bool(OTHER_CUES.intersection(cues))),
        int(any(ch.isalnum() for ch in around)),
        int(span.isupper()) + 2 * int(span.islower()),
    )


_WIDTHS = (8, 4, 2, 5, 4, 2, 3)


def _features(kind: int, seen: tuple[int, ...]) -> list[int]:
    """Places of the ones in a candidate's feature vector: its kind, and its kind with every look."""
    at, places = len(KINDS), [kind]
    for width, value in zip(_WIDTHS, seen):
        places.append(at + kind * width + min(value, width - 1))
        at += len(KINDS) * width
    return places


N_FEATURES = len(KINDS) * (1 + sum(_WIDTHS))


@dataclass(frozen=True)
class Model:
    """The trained span classifier."""

    weights: np.ndarray

    def probability(self, text: str, c: Candidate) -> float:
        score = self.weights[_features(c.kind, looks(text, c))].sum()
        return float(1 / (1 + np.exp(-np.clip(score, -500, 500))))


def _pattern(kind: int, cast: tuple[int, ...], seen: tuple[int, ...]) -> str:
    return ",".join(map(str, (kind, *cast, *seen)))


def train(docs: DataFrame, text: str = "text", penalty: float = 1.0, steps: int = 50) -> Model:
    """Labeler reliabilities by expectation-maximisation, kind by kind, and the classifier they supervise.

    Every candidate of ``docs`` counts; the driver gets the counts of their patterns, a bounded table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for value in batch["text"]:
                whole = value.as_py() or ""
                counts.update(_pattern(c.kind, votes(whole, c), looks(whole, c)) for c in candidates(whole))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["pattern", "n"])

    found = (
        docs.select(F.col(text).alias("text")).mapInArrow(run, "pattern string, n long")
        .groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toPandas()
    )
    weights = np.zeros(N_FEATURES)
    if not len(found):
        return Model(weights)
    table = np.array([[int(x) for x in p.split(",")] for p in found["pattern"]])
    counts, kinds = found["n"].to_numpy(float), table[:, 0]
    cast, seen = table[:, 1:-len(_WIDTHS)], table[:, -len(_WIDTHS):]
    target = np.empty(len(table))
    for kind in np.unique(kinds):
        own = kinds == kind
        target[own] = posteriors(cast[own], counts[own], trust=0.8)
    hot = np.zeros((len(table), N_FEATURES))
    for row, (kind, look) in enumerate(zip(kinds, seen)):
        hot[row, _features(int(kind), tuple(look))] = 1
    # Counts enter by their logarithm, so that one frequent pattern doesn't drown the others; full-batch Newton steps.
    amount = np.log1p(counts)
    for _ in range(steps):
        chance = 1 / (1 + np.exp(-np.clip(hot @ weights, -500, 500)))
        slope = hot.T @ (amount * (target - chance)) - penalty * weights
        curve = (hot * (amount * chance * (1 - chance))[:, None]).T @ hot + penalty * np.eye(N_FEATURES)
        step = np.linalg.solve(curve, slope)
        weights = weights + step
        if np.abs(step).max() < 1e-8:
            break
    return Model(weights)


def spans(text: str, model: Model) -> list[tuple[int, int, int, bool, float]]:
    """``(kind, start, end, base, probability)`` by kind and start: the strict matches, and candidates the classifier
    takes, the likelier one where two overlap."""
    kept, taken = [], _Taken()
    found = [(c, model.probability(text, c)) for c in candidates(text)]
    for c, p in sorted(found, key=lambda x: (not x[0].base, -x[1], x[0])):
        if c.base or p >= 0.5 and not taken.touches(c.start, c.end):
            kept.append((c.kind, c.start, c.end, c.base, p))
            taken.add(c.start, c.end)
    return sorted(kept)


SPAN = "array<struct<kind: string, start: int, end: int, base: boolean, p: double>>"


def find(docs: DataFrame, model: Model | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, spans`` for every row, trained on ``docs`` unless a model is given. Places are code points."""
    model = model or train(docs, text)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()),
                               ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                [(KINDS[k], a, b, base, p) for k, a, b, base, p in spans(value.as_py() or "", model)]
                for value in batch["text"]
            ]
            named = [[dict(zip(("kind", "start", "end", "base", "p"), x)) for x in row] for row in found]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(named, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, spans {SPAN}")


def masked(docs: DataFrame, model: Model | None = None, text: str = "text") -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in angle brackets; a null text stays null."""
    model = model or train(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            clean = [_mask(value.as_py(), model) for value in batch.column(at)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def _mask(text: str | None, model: Model) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for start, end, kind in sorted((a, b, KINDS[k]) for k, a, b, _, _ in spans(text, model)):
        if end > at:
            out += [text[at:max(at, start)], f"<{kind.upper()}>"]
            at = end
    return "".join(out) + text[at:]
