"""Scoring documents by masked pseudo-likelihood.

A small network predicts every word from the ``SIDE`` words on either side, and a document's score is the sum of the
words' conditional log-probabilities. A word's probability is that of its class, which the network predicts from the
context, times the word's own share of the class, by its exact count in the corpus. One count in each class is kept
for all words that the corpus has not.

What is gathered grows with the corpus: the vocabulary, a written table of every different word (as 64 bits of hash) with
its count. It is never whole in one place. Every task gets the words of the highest bands of frequency, ``KNOWN`` at most;
``OWN`` of them have a row of weights each, the other words share the remaining buckets. Counts of words that are not
known come by a join, a row per document and different word. Such a word is hardly more than a ``KNOWN``-th of the corpus,
so that no key of the join is hot. Classes are cut by the counts so that each has about the same mass.

Passes over all texts, none of which moves a text:

* the words of each task are counted, the counts added up;
* every task trains the network on all its documents, in numpy, from the same start, and sends its weights with the
  number of words they stand for; Spark averages them by that number, block of weights by block;
* every document is scored but for the shares of words not known, which the join adds as whole numbers.

The network has a fixed size (about a megabyte), which with ``KNOWN`` bounds what is broadcast.

Defined results: a text without words has no log-probabilities, their sum is 0 and their mean null; at the ends of a
text a boundary stands for the missing neighbours; repeated rows get the same score; a null id is carried through; an
empty table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm import words
from wardline.llm.shared import cut

KNOWN = 1 << 16
OWN = 3072
BUCKETS = 4096
CLASSES = 64
HIDDEN = 16
SIDE = 2
STEP = 4096
RATE = 0.1
BLOCK = 1 << 14
SPREAD = 16
MERGE = 1 << 18  # different words that a task counts before it passes them on
FINE = 1 << 24  # logarithms are added up in this many parts


@dataclass
class Network:
    """``near[p]`` holds each bucket's contribution to the hidden layer from position p; its last row stands for
    the boundary."""

    near: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def start(cls, prior: np.ndarray, seed: int = 7) -> Network:
        draw = np.random.default_rng(seed)
        return cls(
            draw.normal(0, 0.3, (2 * SIDE, BUCKETS + 1, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32),
            draw.normal(0, 0.1, (HIDDEN, CLASSES)).astype(np.float32), np.log(prior).astype(np.float32),
        )

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, f.name).ravel() for f in fields(self)])

    def like(self, flat: np.ndarray) -> Network:
        """A network of this shape with the weights of ``flat``."""
        parts, at = [], 0
        for own in (getattr(self, f.name) for f in fields(self)):
            parts.append(flat[at:at + own.size].reshape(own.shape).astype(np.float32))  # a copy
            at += own.size
        return Network(*parts)

    def forward(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hidden values and class log-probabilities for rows of neighbours."""
        hidden = self.near[0][around[:, 0]] + self.bias
        for place in range(1, 2 * SIDE):
            hidden += self.near[place][around[:, place]]
        np.tanh(hidden, out=hidden)
        logs = hidden @ self.out + self.out_bias
        logs -= logs.max(axis=1, keepdims=True)
        logs -= np.log(np.exp(logs).sum(axis=1, keepdims=True))
        return hidden, logs

    def learn(self, around: np.ndarray, target: np.ndarray, rate: float, seen: Network) -> None:
        """One gradient step; ``seen`` holds the sums of squared gradients that every weight's steps are divided by."""
        hidden, logs = self.forward(around)
        slope = np.exp(logs)
        slope[np.arange(len(target)), target] -= 1
        back = (slope @ self.out.T) * (1 - hidden * hidden)
        for own, sums, asked in ((self.out, seen.out, hidden.T @ slope), (self.out_bias, seen.out_bias, slope.sum(axis=0)),
                                 (self.bias, seen.bias, back.sum(axis=0))):
            sums += asked * asked
            own -= np.float32(rate) * asked / np.sqrt(sums)
        for place in range(2 * SIDE):
            order = np.argsort(around[:, place], kind="stable")
            heads = np.flatnonzero(np.diff(around[order, place], prepend=-1))
            rows, asked = around[order[heads], place], np.add.reduceat(back[order], heads, axis=0)
            sums = seen.near[place][rows] + asked * asked
            seen.near[place][rows] = sums
            self.near[place][rows] -= np.float32(rate) * asked / np.sqrt(sums)


@dataclass
class Lexicon:
    """What every task knows of the corpus: the frequent words (sorted hashes), their counts and buckets, and the class of
    each bucket, with its starting probability and its number of words in the corpus."""

    known: np.ndarray
    counts: np.ndarray
    buckets: np.ndarray
    of: np.ndarray
    prior: np.ndarray
    totals: np.ndarray

    @classmethod
    def cut(cls, known: np.ndarray, counts: np.ndarray, shared: np.ndarray) -> Lexicon:
        """From the frequent words with their counts and the counts of all words by shared bucket."""
        order = np.lexsort((known, -counts))
        buckets = _shared(known)
        buckets[order[:OWN]] = np.arange(len(order[:OWN]))
        mass = np.zeros(BUCKETS, np.int64)
        mass[OWN:] = shared
        np.subtract.at(mass, _shared(known), counts)
        np.add.at(mass, buckets, counts)
        order, smooth = np.argsort(-mass, kind="stable"), mass + 1.0
        middle = (np.cumsum(smooth[order]) - smooth[order] / 2) / smooth.sum()
        of = np.empty(BUCKETS, np.int64)
        of[order] = np.minimum((middle * CLASSES).astype(np.int64), CLASSES - 1)
        prior = np.maximum(np.bincount(of, smooth, CLASSES), 1e-3) / smooth.sum()
        place = np.argsort(known)
        return cls(known[place], counts[place], buckets[place], of, prior, np.bincount(of, mass, CLASSES))

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's bucket and its count, 0 if it is not known."""
        if not len(self.known):
            return _shared(hashes), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        held = self.known[at] == hashes
        return np.where(held, self.buckets[at], _shared(hashes)), np.where(held, self.counts[at], 0)

    def shares(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The logarithm of each word's share of its class; for a word not known, but for its count."""
        return np.log(np.maximum(counts, 1)) - np.log(self.totals + 1)[self.of[buckets]]


def _shared(hashes: np.ndarray) -> np.ndarray:
    return OWN + hashes % (BUCKETS - OWN)


def _hashes(texts: pa.Array) -> tuple[words.Scan, np.ndarray]:
    found = words.scan(texts)
    return found, words.word_hashes(found).view(np.int64)


def _neighbours(buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The buckets ``SIDE`` to the left and right of every word, ``BUCKETS`` beyond its text."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    place = np.arange(len(buckets))
    around = np.empty((len(buckets), 2 * SIDE), np.int64)
    for column, step in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        at = place + step
        inside = (at >= first[row]) & (at < first[row + 1])
        around[:, column] = np.where(inside, buckets[np.clip(at, 0, max(len(buckets) - 1, 0))], BUCKETS)
    return around


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
    for batch in batches:
        for _, some in words.slices(batch["text"]):
            yield some


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for some in _texts(batches):
        fresh, many = np.unique(_hashes(some)[1], return_counts=True)
        held, at = np.unique(np.concatenate([held, fresh]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([counts, many]), len(held)).astype(np.int64)
        if len(held) > MERGE:
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts)], ["word", "n"])
            held, counts = held[:0], counts[:0]
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts)], ["word", "n"])


def _average_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of weights, averaged by their words as they arrive."""
    sums: dict[int, np.ndarray] = {}
    total: dict[int, int] = {}
    for batch in batches:
        for block, n, weights in zip(*(batch[name].to_pylist() for name in ("block", "n", "weights"))):
            own = np.frombuffer(weights, np.float32).astype(float) * n
            sums[block] = sums[block] + own if block in sums else own
            total[block] = total.get(block, 0) + n
    held = [(sums[block] / total[block]).astype(np.float32).tobytes() for block in sums]
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array(list(total.values()), pa.int64()), pa.array(held, pa.binary())],
        ["block", "n", "weights"])


@dataclass
class Scorer:
    lexicon: Lexicon
    network: Network

    def word_logs(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The conditional log-probability of every word, and which words lack the logarithm of their count in it."""
        buckets, counts = self.lexicon.look_up(hashes)
        around, target = _neighbours(buckets, first), self.lexicon.of[buckets]
        out = np.empty(len(buckets))
        for at in range(0, len(buckets), STEP):
            to = slice(at, at + STEP)
            _, logs = self.network.forward(around[to])
            out[to] = logs[np.arange(len(logs)), target[to]]
        return out + self.lexicon.shares(buckets, counts), counts == 0


@dataclass
class Model:
    """What tasks get, and the written table of all words, ``word, n``."""

    scorer: Scorer
    vocabulary: DataFrame


def _band(n: str):
    return F.floor(F.log2(n) * 8)


def _lexicon(vocabulary: DataFrame, known: int) -> Lexicon:
    """Every result here has a bounded number of rows: bands, words of the highest bands, buckets."""
    bands = vocabulary.groupBy(_band("n").alias("band")).count().orderBy(F.desc("band")).collect()
    lowest, most = None, 0
    for row in bands:
        most += row["count"]
        if most > known:
            break
        lowest = row["band"]
    frequent = vocabulary.where(F.lit(False) if lowest is None else _band("n") >= lowest).toArrow()
    shared = np.zeros(BUCKETS - OWN, np.int64)
    bucket = F.pmod("word", F.lit(BUCKETS - OWN)).alias("bucket")
    for row in vocabulary.groupBy(bucket).agg(F.sum("n").alias("n")).collect():
        shared[row["bucket"]] = row["n"]
    return Lexicon.cut(frequent["word"].to_numpy(), frequent["n"].to_numpy(), shared)


def train(docs: DataFrame, text: str = "text", rate: float = RATE, known: int = KNOWN) -> Model:
    """Vocabulary and network from all texts of ``docs``."""
    texts = docs.select(F.col(text).alias("text"))
    vocabulary = cut(texts.mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    lexicon = _lexicon(vocabulary, known)
    start = Network.start(lexicon.prior)
    given = docs.sparkSession.sparkContext.broadcast((lexicon, start))  # a fixed size, see above

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, network = given.value
        network, seen = network.like(network.flat()), 0
        squares = network.like(np.full(network.flat().size, 1e-6, np.float32))
        for some in _texts(batches):
            found, hashes = _hashes(some)
            buckets, _ = lexicon.look_up(hashes)
            around, target = _neighbours(buckets, found.first), lexicon.of[buckets]
            for at in range(0, len(buckets), STEP):
                network.learn(around[at:at + STEP], target[at:at + STEP], rate, squares)
            seen += len(buckets)
        flat = network.flat() if seen else np.empty(0, np.float32)
        blocks = [flat[at:at + BLOCK].tobytes() for at in range(0, len(flat), BLOCK)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(blocks)), pa.int32()), pa.array([seen] * len(blocks), pa.int64()), pa.array(blocks, pa.binary())],
            ["block", "n", "weights"])

    blocks, schema = -(-start.flat().size // BLOCK), "block int, n long, weights binary"
    # In two steps, so that no task gets a row from every other.
    averaged = (
        texts.mapInArrow(run, schema).withColumn("some", F.spark_partition_id() % SPREAD)
        .repartition(blocks * SPREAD, "block", "some").mapInArrow(_average_blocks, schema)
        .repartition(blocks, "block").mapInArrow(_average_blocks, schema).collect()
    )
    if not averaged:
        return Model(Scorer(lexicon, start), vocabulary)
    flat = np.concatenate([np.frombuffer(row["weights"], np.float32) for row in sorted(averaged, key=lambda row: row["block"])])
    return Model(Scorer(lexicon, start.like(flat)), vocabulary)


def score(docs: DataFrame, model: Model | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, log_probability, mean_log_probability`` of every row; trained on ``docs`` unless a model
    is given."""
    model = model or train(docs, text)
    given = docs.sparkSession.sparkContext.broadcast(model.scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, some in words.slices(batch["text"]):
                found, hashes = _hashes(some)
                logs, lacking = given.value.word_logs(hashes, found.first)
                bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(lacking)])[found.first]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(at, len(some)), pa.array(np.diff(found.first)),
                     pa.array(np.bincount(found.rows(), logs, len(some))),
                     pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(hashes[lacking])).cast(pa.list_(pa.int64()))],
                    ["doc_id", "n_words", "known", "rare"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, n_words long, known double, rare array<long>")
    scored = cut(scored.withColumn("row", F.monotonically_increasing_id()))
    asked = scored.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times"))
    part = F.round(F.log("n") * FINE).cast("long") * F.col("times")
    added = asked.join(model.vocabulary, "word").groupBy("row").agg((F.sum(part) / FINE).alias("added"))
    total = (F.col("known") + F.coalesce("added", F.lit(0.0))).alias("log_probability")
    return scored.join(added, "row", "left").select("doc_id", "n_words", total).withColumn(
        "mean_log_probability", F.when(F.col("n_words") > 0, F.col("log_probability") / F.col("n_words")))
