"""Secrets of any length go to their last character."""

import random
import string
import time

import numpy as np
import pytest

from conftest import SMALL
from wardline.llm import pii

LETTERS = string.ascii_letters + string.digits


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(spark.read.parquet(f"{SMALL}/documents.parquet"))


@pytest.mark.parametrize("size", [40, 128, 129, 200, 201, 1000, 100_000])
@pytest.mark.parametrize("parts", [1, 3])
def test_named_values_go_whole(model, size, parts):
    draw = random.Random(size)
    value = [draw.choice(LETTERS) for _ in range(size)]
    for at in range(1, parts):
        value[size * at // parts] = "."
    assert pii._mask(f"the token={''.join(value)} is set", model) == "the token=<SECRET> is set"


@pytest.mark.parametrize("size", [100, 128, 129, 1000, 100_000])
def test_keys_go_whole(model, size):
    draw = random.Random(size)
    value = "".join(draw.choice(LETTERS) for _ in range(size))
    assert pii._mask(f"use the key {value} here", model) == "use the key <SECRET> here"


@pytest.mark.parametrize("text", ["a1" * 200_000, "token=" + "a1." * 100_000, "token=a1-b2c " * 30_000, "secret:" * 40_000])
def test_time_is_linear_in_the_text(text):
    begin = time.process_time()
    pii.spans(text, pii.Model(np.zeros(pii.N_FEATURES)))
    assert time.process_time() - begin < 5
