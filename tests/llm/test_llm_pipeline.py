"""Every stage of the corpus pipeline over what the one before kept, on awkward rows and on the smallest tables."""

from collections import Counter

import pytest
from awkward import docs, empty, rows, words
from test_llm_packing import check as check_packing
from test_llm_pii_pseudo_quality import plain_spans
from test_llm_sharding_mixing import shares
from test_llm_simhash import plain_components, plain_fingerprint

import corpus_pipeline
from conftest import SMALL
from wardline.llm import quality


def stages(spark, frame, folder):
    """What went into each stage and what came out, written and read in between."""
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        path = corpus_pipeline.scratch_path(spark, f"test-{name}")
        stage(spark, frame, folder).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = (frame, after)
        frame = after
    return out


def plain(row):
    return tuple(row)


@pytest.mark.parametrize("table", ["awkward", "small"])
def test_stages(spark, table):
    frame = docs(spark) if table == "awkward" else spark.read.parquet(f"{SMALL}/documents.parquet")
    out = stages(spark, frame, SMALL)
    for name, (before, after) in out.items():
        if name != "pack_sequences":
            assert after.dtypes == frame.dtypes

    before, after = out["quality_rules"]
    judged = Counter(r.doc_id for r in quality.judged(before).where("kept").collect())
    assert Counter(r.doc_id for r in after.collect()) == judged
    assert set(map(plain, after.collect())) <= set(map(plain, before.collect()))

    before, after = (x.collect() for x in out["near_duplicates"])
    before.sort(key=lambda r: (r.doc_id is None, r.doc_id or 0))
    groups = plain_components(list(range(len(before))), [plain_fingerprint(r.text) for r in before])
    assert Counter(r.doc_id for r in after) == Counter(before[i].doc_id for i in set(groups))
    assert set(map(plain, after)) <= set(map(plain, before))

    before, after = out["personal_data"]
    assert before.count() == after.count()
    assert all(not plain_spans(r.text or "") and r.n_chars == (None if r.text is None else len(r.text)) for r in after.collect())
    clean = {r.text for r in before.collect() if r.text and not any(c in "0123456789@" for c in r.text)}
    assert clean <= {r.text for r in after.collect()}

    before, after = (x.collect() for x in out["mix_sources"])
    times, held = Counter(map(plain, after)), Counter(map(plain, before))
    assert set(times) <= set(held) and all(times[row] <= 2 * held[row] for row in times)
    sizes = Counter()
    for r in before:
        sizes[r.source] += len(words(r.text))
    for source, target in shares(sizes).items():
        if target == 2 * sizes[source]:
            assert all(times[plain(r)] == 2 * held[plain(r)] for r in before if r.source == source)

    before, after = (x.collect() for x in out["pack_sequences"])
    check_packing(after, [(r.doc_id, r.text) for r in before])


def test_empty_table(spark):
    assert all(after.count() == 0 for _, after in stages(spark, empty(spark), SMALL).values())


def test_run_is_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SMALL).columns[:2] == ["row", "doc_id"]
    assert len(rows()) > 20
