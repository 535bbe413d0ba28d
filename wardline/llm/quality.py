"""Quality rules as weak supervision: rules vote or abstain, and what they are worth is estimated, not set.

Each document gets a vote per rule: good, bad or none. Votes have few patterns, so the patterns' counts over the
whole corpus are a small table, and expectation-maximisation over it (a two-class model in which each rule has its
own chances of every vote in either class) sees every document. A document's posterior probability of being good
replaces the demand that it pass all rules.

The estimate runs on at most 3 ** (number of rules) counted patterns, whatever the size of the corpus. Texts are read
once; the signals, some sixty bytes a document, are written to the shared folder.

Defined results: a null or empty text has no words, all counts 0, and fails the base rules; ties and repeated rows
are judged alike; an empty table gives an empty result; a null id is carried through; columns of the input other than
text are carried along by :func:`keep_good` and dropped by :func:`judged` but for the id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from wardline.llm import words
from wardline.llm.shared import cut
from wardline.llm.voting import posteriors

WINDOW = 5
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_NOT_CONTINUED = (np.arange(256) & 0xC0) != 0x80

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper",
          "n_loud", "n_stops")


def count_signals(texts: pa.Array) -> dict[str, np.ndarray]:
    """:data:`COUNTS` of each text."""
    out = {name: np.zeros(len(texts), np.int64) for name in COUNTS}
    for at, some in words.slices(texts):
        found = words.scan(some)
        to = slice(at, at + len(some))
        last = found.data[found.ends - 1]
        out["n_words"][to] = np.diff(found.first)
        out["word_chars"][to] = words.by_row(_NOT_CONTINUED[found.data] & ~words._SPACE[found.data], found.offsets)
        out["n_symbols"][to] = words.by_row(_SYMBOLS[found.data], found.offsets)
        out["n_letters"][to] = words.by_row(_LETTER[found.data], found.offsets)
        out["n_upper"][to] = words.by_row(_UPPER[found.data], found.offsets)
        out["n_loud"][to] = words.by_row(last == ord("!"), found.first)
        out["n_stops"][to] = words.by_row((last == ord(".")) | (last == ord("?")) | (last == ord("!")), found.first)
        out["n_repeat_words"][to] = words.by_row(_repeated(found), found.first)
        lines = [_lines(text.as_py() or "") for text in some]
        out["n_lines"][to] = [all_lines for all_lines, _ in lines]
        out["n_dup_lines"][to] = [all_lines - different for all_lines, different in lines]
    return out


def _repeated(found: words.Scan) -> np.ndarray:
    """Words in a window whose sequence of words stands twice or more in their text."""
    row = found.rows()
    starts = np.flatnonzero(np.arange(len(row)) + WINDOW <= found.first[1:][row]) if len(row) else np.empty(0, np.int64)
    hashes = words.window_hashes(words.word_hashes(found), WINDOW)[starts]
    keys = words.mixed(hashes ^ words.mixed(row[starts].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys)
    heads = np.flatnonzero(np.diff(keys[order], prepend=keys[order][:1] + np.uint64(1)) != 0)
    sizes = np.diff(heads, append=len(keys))
    return words.covered(starts[order[np.repeat(sizes > 1, sizes)]], WINDOW, len(row))


def _lines(text: str) -> tuple[int, int]:
    """Lines with a word, and how many different ones."""
    held = [line for line in text.split("\n") if line.strip(" \t\x0b\x0c\r")]
    return len(held), len(set(held))


def signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with :data:`COUNTS` of the text; columns of ``docs`` with such a name are replaced."""
    return _counted(docs.drop(*(name for name in COUNTS if name != text)), lambda batch: batch[text])


def _counted(rows: DataFrame, texts: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = count_signals(texts(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, counts.values())], [*batch.schema.names, *counts])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, *(StructField(name, LongType()) for name in COUNTS)]))


def _rules() -> dict[str, Column]:
    """Each rule's vote: 1 good, 2 bad, 0 none. A rule votes where it has something to say: nearly all documents pass
    nearly all rules, so passing one is no evidence and counts as an abstention; prose is a finding of its own."""
    def share(part, whole):
        return F.col(part) / F.greatest(F.col(whole), F.lit(1))

    def bad(when):
        return F.when(when, 2).otherwise(0)

    count, letters = F.col("n_words"), share("word_chars", "n_words")
    prose = (
        (count >= 20) & letters.between(2.5, 12) & (share("n_stops", "n_words") >= 0.01)
        & (share("n_symbols", "n_words") < 0.05) & (share("n_upper", "n_letters") < 0.2)
        & (share("n_repeat_words", "n_words") < 0.2) & (share("n_loud", "n_words") < 0.1)
    )
    return {
        "prose": F.when(prose, 1).otherwise(0),
        "length": bad(count < 10),
        "word_length": bad((count > 0) & ~letters.between(2, 15)),
        "symbols": bad(share("n_symbols", "n_words") > 0.3),
        "lines": bad((F.col("n_lines") > 3) & (share("n_dup_lines", "n_lines") > 0.3)),
        "repeats": bad(share("n_repeat_words", "n_words") > 0.3),
        "capitals": bad(share("n_upper", "n_letters") > 0.3),
        "shouting": bad(share("n_loud", "n_words") > 0.3),
        "sentences": bad((count > 100) & (share("n_stops", "n_words") < 0.002)),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _judge(counted: DataFrame, learnt_from: DataFrame) -> DataFrame:
    """``counted`` with ``base_failed``, ``p_good`` and ``kept``, the rules' worth estimated over ``learnt_from``."""
    rules = _rules()
    pattern = sum(vote * 3**place for place, vote in enumerate(rules.values())).cast("int")
    found = learnt_from.groupBy(pattern.alias("pattern")).count().toPandas()  # 3 ** len(rules) rows at most
    p_good = F.lit(None).cast("double")
    if len(found):
        votes = found["pattern"].to_numpy()[:, None] // 3 ** np.arange(len(rules)) % 3
        belief = posteriors(votes, found["count"].to_numpy(float))
        known = F.create_map(*[F.lit(x) for pair in zip(found["pattern"].tolist(), belief.tolist()) for x in pair])
        p_good = F.element_at(known, pattern)
    return counted.withColumns({"base_failed": base_failed(), "p_good": p_good}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``doc_id``, :data:`COUNTS`, ``base_failed``, ``p_good`` and ``kept``: the base rules passed and the
    posterior at least one half."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    counted = cut(signals(rows).drop("text"))
    return _judge(counted, counted)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns. Texts are read twice and stay where they are."""
    votes = signals(docs.select(F.col(text).alias("text"))).drop("text")
    whole = _counted(docs.select(F.struct(*docs.columns).alias("row")), lambda batch: pc.struct_field(batch["row"], [text]))
    return _judge(whole, votes).where("kept").select("row.*")
