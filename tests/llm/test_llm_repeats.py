import hashlib

import pytest
from awkward import docs, empty, passage, rows, words

from conftest import SMALL
from wardline.llm import queries, repeats


def model(pairs, window=50):
    """Each document's words and which of them go, by looking at every window."""
    least = {}
    for number, text in pairs:
        held = words(text)
        for at in range(len(held) - window + 1) if number is not None else ():
            key = tuple(held[at:at + window])
            least[key] = min(least.get(key, number), number)
    out = []
    for number, text in pairs:
        held = words(text)
        gone = [False] * len(held)
        for at in range(len(held) - window + 1) if number is not None else ():
            if least[tuple(held[at:at + window])] < number:
                gone[at:at + window] = [True] * window
        out.append((number, len(held), sum(gone), " ".join(w for w, g in zip(held, gone) if not g)))
    return sorted(out, key=repr)


def result(frame, **options):
    return sorted(map(tuple, repeats.remove_repeats(frame, **options).collect()), key=repr)


def test_awkward_rows(spark):
    assert result(docs(spark)) == model([row[:2] for row in rows()])


@pytest.mark.parametrize("window", [2, 7, 50])
def test_shifted_and_mutated_copies(spark, window):
    base = passage(9, 400).split()
    pairs = [(40 - i, " ".join(base[i * 3:300 + i] + [f"x{i}"] + base[100 + i:180 + 2 * i])) for i in range(30)]
    frame = spark.createDataFrame(pairs, "doc_id long, text string")
    assert result(frame, window=window) == model(pairs, window)


def test_same_for_any_number_of_parts(spark, monkeypatch):
    few = result(docs(spark))
    monkeypatch.setattr(repeats, "tasks", lambda spark: 23)
    assert result(docs(spark).repartition(7)) == few


def test_empty_table(spark):
    assert result(empty(spark)) == []


def test_query(spark):
    pairs = [(row.doc_id, row.text) for row in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    expected = [(n, count, gone, hashlib.sha256(kept.encode()).hexdigest()) for n, count, gone, kept in model(pairs)]
    found = queries.op1_remove_repeats(spark, SMALL).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, found)) == sorted(expected)
    assert sum(row[2] for row in expected) > 0
