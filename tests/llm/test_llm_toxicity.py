from collections import Counter
from itertools import product
from zlib import crc32

import numpy as np
import pytest
from awkward import docs, empty, rows
from pyspark.sql import functions as F

from conftest import SMALL
from wardline.llm import queries, toxicity
from wardline.llm.toxicity import CLASSES, Letters, Restorer

TABLE = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"{TABLE}/{name}.parquet") for name in ("documents", "labels")]


@pytest.fixture(scope="module")
def model(tables):
    return toxicity.fit(tables[0].select("doc_id", "text"), tables[1].select("doc_id", "toxic"))


@pytest.fixture(scope="module")
def restorer(model):
    return Restorer(Letters(model.counts))


@pytest.mark.parametrize("hidden, meant", [
    ("1d10t", ["idiot"]), ("i.d.i.o.t", ["idiot"]), ("s-t-u-p-i-d!!", ["stupid"]), ("idiooooot", ["idiot"]), ("$tup1d", ["stupid"]),
    ("IIDDIIOOTT", ["idiot"]), ("th3 p4th3t1c m0r0n", ["the", "pathetic", "moron"]), ("st-u-pid", ["stupid"]),
    ("well-known end. Start", ["well", "known", "end", "start"]), ("GROSS!! été", ["gross", "été"]), ("athe*** tion$$$", ["athe", "tion"]),
    ("a, y 2024 10.20.30.40 --- | 中文", ["a", "y", "中文"]), ("less wrong committee", ["less", "wrong", "committee"]), ("", []), (None, []),
])
def test_restores(restorer, hidden, meant):
    assert list(restorer.read(hidden)) == meant


@pytest.mark.parametrize("hidden, word", [("i d i o t", "idiot"), ("you w o r t h l e s s", "worthless"), ("the 1 d 1 0 t said", "idiot"), ("s c u m", "scum")])
def test_spaced_letters_are_joined_too(restorer, hidden, word):
    assert word in restorer.vocabulary(hidden)


def code(char):
    return int(toxicity._CLASS[ord(char)])


def plain_score(log, choices):
    """The log-probability of one way through a lattice."""
    total, a, b = 0.0, 0, 0
    for letters, cost in [*choices, (" ", 0.0)]:
        total += cost
        for letter in letters:
            c = code(letter)
            if c or b:
                total += log[a, b, c]
                a, b = (b, c) if c else (0, 0)
    return total


@pytest.mark.parametrize("token", ["1d10t", "b.a.dd", "m00rr0n", "$c-um", "a_7+!l", "éé8ß.x"])
def test_viterbi_finds_the_best_of_all_ways(model, token):
    letters, held = Letters(model.counts), toxicity.lattice(token)
    ways = [(plain_score(letters.log, way), "".join(x for x, _ in way)) for way in product(*held)]
    best = max(score for score, _ in ways)
    assert letters.best(held).split() in [text.split() for score, text in ways if score > best - 1e-4]


def test_character_counts(spark):
    texts = ["Ab  b1c", None, "", "é zZ\n中 a"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    want = Counter()
    for text in texts:
        for word in "".join(c if code(c) else " " for c in (text or "").lower()).split():
            held = [0, 0, *map(code, word), 0]
            want.update(zip(held, held[1:], held[2:]))
    found = toxicity.character_counts(frame)
    places = np.flatnonzero(found)
    got = {(int(p) // CLASSES**2, int(p) // CLASSES % CLASSES, int(p) % CLASSES): int(found[p]) for p in places}
    assert {key: n for key, n in got.items() if key != (0, 0, 0)} == want


def test_probabilities_sum_to_one(model):
    assert np.allclose(np.exp(Letters(model.counts).log.astype(float)).sum(axis=2), 1, atol=1e-3)


def test_held_out_accuracy(spark, tables, model):
    found = toxicity.scored(tables[0].select("doc_id", "text"), model).join(tables[1], "doc_id").where(toxicity.held_out(F.col("doc_id")))
    count = Counter((r.toxic, int(r.score >= 0.5)) for r in found.collect())
    assert count[1, 1] / (count[1, 1] + count[0, 1]) >= 0.95 and count[0, 0] / (count[0, 0] + count[0, 1]) >= 0.99
    assert count[1, 1] / (count[1, 1] + count[1, 0]) >= 0.75


def test_hidden_words_score_like_plain_ones(model, restorer):
    clean = "the and of them are seen. "
    plain_scores = {word: model.score(restorer.vocabulary(clean + word)) for word in ("idiot", "moron", "worthless", "stupid", "clown", "loser")}
    assert model.score(restorer.vocabulary(clean)) < 0.1 and sum(plain >= 0.5 for plain in plain_scores.values()) >= 3
    for word, plain in plain_scores.items():
        leet = word.translate(str.maketrans("ieost", "13057"))
        for hidden in (leet, ".".join(word), " ".join(word), word[:2] + word[2] * 4 + word[3:], "*".join(word)):
            assert model.score(restorer.vocabulary(clean + hidden)) >= plain - 1e-9, hidden


def test_pieces_are_whole_and_end_between_words():
    for text in ("one two three four a b c d five", "x" * 90, "a b " * 30, "", "é\n" * 40, "ab " * 50):
        for size in (1, 5, 17):
            found = list(toxicity.pieces(text, size))
            assert "".join(found) == text and [w for p in found for w in p.split()] == text.split()


def test_very_long_text(restorer):
    assert "idiot" in restorer.vocabulary("word " * 600_000 + "1d10t " + "more " * 10) and len(list(restorer.read("x" * 3_000_000))) == 1


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 0, 5), (2, 1, 5), (2, 0, 5), (4, 1, 5), (None, 1, 5), (5, None, 5), (9, 0, 5), (17, 1, 5), (99, 1, 5)],
                                   "doc_id long, toxic int, score int")
    found = toxicity.toxicity(docs(spark), labels).collect()
    assert Counter(r.doc_id for r in found) == Counter(row[0] for row in rows())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert all(r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    assert len({r.score for r in found if r.doc_id in (6, 7, 8)}) == 1


@pytest.mark.parametrize("label, score", [(0, 0.0), (1, 1.0)])
def test_labels_of_one_class(spark, label, score):
    labels = spark.createDataFrame([(1, label), (2, label), (3, label), (4, label)], "doc_id long, toxic int")
    assert {round(r.score, 9) for r in toxicity.toxicity(docs(spark), labels).collect()} == {score}


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(empty(spark), labels).collect() == []
    assert {r.score < 1e-9 for r in toxicity.toxicity(docs(spark), labels).collect()} == {True}


def test_labels_that_are_held_out_change_nothing(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "toxic")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(table, labels).weights == toxicity.fit(table, turned).weights
    assert queries.op12_toxicity(spark, SMALL).columns == ["doc_id", "held_out", "score", "predicted"]
