import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from awkward import docs, empty, passage, rows, words

from conftest import SMALL
from wardline.llm import pii, pseudo, quality, queries, voting

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits_of(text):
    return [int(c) for c in text if c in "0123456789"]


def passes_luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    found = [(0, *m.span()) for m in EMAIL.finditer(text)]
    found += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    found += [(2, *m.span()) for m in CARD.finditer(text)
              if 16 <= len(digits_of(m.group())) <= 19 and passes_luhn(digits_of(m.group()))]
    return found + [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m.group())) <= 15]


@pytest.mark.parametrize("letters, longest", [("a1.@+- (2é)5%", 40), ("0123456789 -4.", 60), ("a.@-b", 30)])
def test_base_spans_are_the_plain_matches(letters, longest):
    draw = random.Random(letters)
    for _ in range(6000):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, longest)))
        assert pii.base_spans(text) == plain_spans(text), text


@pytest.mark.parametrize("text", [
    "1" * 200_000, "1." * 100_000, "a@" * 100_000, "a" * 300_000 + "@", "+1 " * 100_000, "1-" * 100_000, "Aa1" * 70_000,
    "token=" * 50_000, "1.2.3." * 50_000, "+1" + " " * 200_000])
def test_time_is_linear_in_the_text(text):
    begin = time.process_time()
    pii.spans(text, pii.Model(np.zeros(pii.N_FEATURES)))
    assert time.process_time() - begin < 5


def test_find_awkward_rows(spark):
    found = pii.find(docs(spark)).collect()
    want = Counter((n, tuple(plain_spans(t or ""))) for n, t, *_ in rows())
    assert Counter((r.doc_id, tuple((pii.KINDS.index(s.kind), s.start, s.end) for s in r.spans if s.base)) for r in found) == want
    secret = next(r for r in found if r.doc_id == 21)
    assert [s.kind for s in secret.spans if not s.base] == ["secret"]
    assert pii.find(empty(spark)).collect() == []


def test_masked_keeps_columns_and_rows(spark):
    frame = docs(spark)
    masked = pii.masked(frame)
    assert masked.schema.names == frame.schema.names and masked.count() == len(rows())
    found = {r.doc_id: r.text for r in masked.collect()}
    assert found[6] is None and found[7] == ""
    assert found[20] == "mail <EMAIL> or <PHONE>, card <CARD>, host <IP>"
    assert found[21].startswith('token = "<SECRET>" and <IP>.5')
    assert found[11] == passage(3, 20_000)


def test_taken_stretches():
    draw = random.Random(3)
    for _ in range(300):
        taken, plain = pii._Taken(), set()
        for _ in range(12):
            start = draw.randint(0, 40)
            end = start + draw.randint(1, 6)
            assert taken.touches(start, end) == bool(plain & set(range(start, end)))
            taken.add(start, end)
            plain |= set(range(start, end))


def test_pii_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in queries.op6_personal_data(spark, SMALL).collect():
        base = plain_spans(texts[r.doc_id])
        shown = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in base) for i in range(4)]
        assert set(shown.split(",")) <= set(r.spans.split(","))
        order = [(pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])) for s in r.spans.split(",") if s]
        assert order == sorted(order)


def test_voters_are_weighed_by_their_agreement():
    draw = np.random.default_rng(0)
    truth = draw.random(20_000) < 0.7
    right = np.stack([draw.random(20_000) < a for a in (0.95, 0.9, 0.85, 0.6)], axis=1)
    votes = np.where(right == truth[:, None], 1, 2) * (draw.random(right.shape) < 0.8)
    patterns, place, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    belief = voting.posteriors(patterns, counts.astype(float))
    assert ((belief >= 0.5)[place.ravel()] == truth).mean() > 0.93


# --- pseudo-likelihood --------------------------------------------------------------------------------


def test_network_learns_what_stands_around(spark):
    """A word that its neighbours settle becomes likelier than its frequency, on texts not seen."""
    draw = random.Random(5)
    pairs = [("red", "apple"), ("green", "pear"), ("blue", "plum"), ("gold", "quince")]

    def text(count):
        return " ".join(w for _ in range(count) for w in draw.choice(pairs))

    frame = spark.createDataFrame([(i, text(400)) for i in range(60)], "doc_id long, text string").repartition(3)
    scorer = pseudo.train(frame).scorer
    assert gain(scorer, pa.array([text(500)])) > 0.3


def gain(scorer, texts):
    """By how much the context makes a word likelier than its frequency does."""
    found, hashes = pseudo._hashes(texts)
    buckets, counts = scorer.lexicon.look_up(hashes)
    plain = np.log(scorer.lexicon.prior[scorer.lexicon.of[buckets]]) + scorer.lexicon.shares(buckets, counts)
    return scorer.word_logs(hashes, found.first)[0].mean() - plain.mean()


def test_network_beats_frequencies_on_held_out_documents(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(4)
    scorer = pseudo.train(frame.where("doc_id % 5 > 0")).scorer
    texts = pa.array([r.text for r in frame.where("doc_id % 5 = 0").select("text").collect()])
    assert gain(scorer, texts) > 0.01


def hash_of(word):
    return int(pseudo._hashes(pa.array([word]))[1][0])


def test_vocabulary_holds_every_word(spark):
    frame = docs(spark)
    found = {r.word: r.n for r in pseudo.train(frame).vocabulary.collect()}
    want = Counter(w for _, t, *_ in rows() for w in words(t))
    assert found == {hash_of(w): n for w, n in want.items()}


@pytest.mark.parametrize("known", [0, 1, 40, 100_000])
def test_probabilities_sum_to_one_over_the_vocabulary(spark, known):
    """Every word of the corpus in one place, and one unseen word per class for the rest."""
    frame = docs(spark)
    model = pseudo.train(frame, known=known)
    vocabulary, lexicon = {r.word: r.n for r in model.vocabulary.collect()}, model.scorer.lexicon
    assert len(lexicon.known) <= known
    hashes = np.array(list(vocabulary), np.int64)
    buckets, counts = lexicon.look_up(hashes)
    true = np.array(list(vocabulary.values()))
    assert np.array_equal(counts[counts > 0], true[counts > 0])
    assert np.array_equal(np.bincount(lexicon.of[buckets], true, pseudo.CLASSES), lexicon.totals)
    around = np.random.default_rng(2).integers(0, pseudo.BUCKETS + 1, (50, 2 * pseudo.SIDE))
    logs = model.scorer.network.forward(around)[1]
    seen = np.exp(logs[:, lexicon.of[buckets]] + lexicon.shares(buckets, true)).sum(axis=1)
    unseen = np.exp(logs - np.log(lexicon.totals + 1)).sum(axis=1)
    assert np.allclose(seen + unseen, 1, atol=1e-4)


@pytest.mark.parametrize("known", [0, 5, 100_000])
def test_score_is_the_sum_of_the_words(spark, known):
    """Against a plain sum with every word's count at hand, whether counts are known to the tasks or joined."""
    frame = docs(spark)
    model = pseudo.train(frame, known=known)
    vocabulary, lexicon = {r.word: r.n for r in model.vocabulary.collect()}, model.scorer.lexicon
    other = rows() + [(99, "word neverseen word", *rows()[0][2:])]
    want = {}
    for number, text, *_ in other:
        found, hashes = pseudo._hashes(pa.array([text], pa.string()))
        logs, lacking = model.scorer.word_logs(hashes, found.first)
        own = [np.log(vocabulary.get(int(h), 1)) if lacks else 0 for h, lacks in zip(hashes, lacking)]
        want.setdefault(number, []).append(float(np.sum(logs) + np.sum(own)))
    got = {}
    for r in pseudo.score(docs(spark, other), model).collect():
        got.setdefault(r.doc_id, []).append(r.log_probability)
    assert got.keys() == want.keys()
    assert all(np.allclose(sorted(got[k]), sorted(want[k]), rtol=1e-5, atol=1e-3) for k in want)


def test_a_rarer_word_in_the_same_place_is_less_likely(spark):
    """Two words of one class, told apart by their own counts."""
    frame = spark.createDataFrame([(i, f"left {'common' if i % 10 else 'rare'} right") for i in range(400)], "doc_id long, text string")
    model = pseudo.train(frame, known=0)
    asked = spark.createDataFrame([(1, "left common right"), (2, "left rare right"), (3, "left neverseen right")], "doc_id long, text string")
    found = {r.doc_id: r.log_probability for r in pseudo.score(asked, model).collect()}
    assert found[1] > found[2] > found[3]


def test_learning_follows_the_gradient():
    draw = np.random.default_rng(3)
    network = pseudo.Network.start(np.full(pseudo.CLASSES, 1 / pseudo.CLASSES))
    around, target = draw.integers(0, 9, (512, 2 * pseudo.SIDE)), draw.integers(0, 4, 512)
    def loss():
        return -network.forward(around)[1][np.arange(512), target].mean()
    before, squares = loss(), network.like(np.full(network.flat().size, 1e-6, np.float32))
    for _ in range(60):
        network.learn(around, target, 0.05, squares)
    assert loss() < before - 1


def test_score_awkward_rows(spark):
    frame = docs(spark)
    found = pseudo.score(frame).collect()
    want = Counter((n, len(words(t))) for n, t, *_ in rows())
    assert Counter((r.doc_id, r.n_words) for r in found) == want
    for r in found:
        assert (r.log_probability == 0 and r.mean_log_probability is None) if r.n_words == 0 else r.log_probability < 0
    assert len({r.log_probability for r in found if r.doc_id == 17}) == 1
    assert pseudo.score(empty(spark)).collect() == []


# --- quality rules ------------------------------------------------------------------------------------


def plain_counts(text):
    held = words(text)
    windows = Counter(tuple(held[i:i + 5]) for i in range(len(held) - 4))
    again = [False] * len(held)
    for i in range(len(held) - 4):
        if windows[tuple(held[i:i + 5])] > 1:
            again[i:i + 5] = [True] * 5
    seen, same = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            same += line in seen
            seen.add(line)
    return len(held), sum(map(len, held)), len(re.findall(r"[#*$%&|<>]", text or "")), same, sum(again)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_counts_of_awkward_rows(spark):
    found = quality.judged(docs(spark)).collect()
    assert Counter((r.doc_id, *(r[n] for n in NAMES)) for r in found) == Counter((n, *plain_counts(t)) for n, t, *_ in rows())
    for r in found:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept is False if r.base_failed else r.kept == (r.p_good >= 0.5)
    assert quality.judged(empty(spark)).collect() == [] == quality.keep_good(empty(spark)).collect()


def test_keep_good_keeps_columns(spark):
    frame = docs(spark)
    kept = quality.keep_good(frame)
    assert kept.schema == frame.schema
    judged = sorted(r.doc_id for r in quality.judged(frame).where("kept AND doc_id IS NOT NULL").collect())
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == judged


def test_quality_agrees_with_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    found = queries.op9_quality_votes(spark, folder).join(labels, "doc_id").collect()
    assert not any(r.kept for r in found if r.quality == 0)
    assert all(r.kept for r in found if r.quality == 1 and not r.base_failed)


def test_quality_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in queries.op9_quality_votes(spark, SMALL).collect():
        assert tuple(r[n] for n in NAMES) == plain_counts(texts[r.doc_id])
