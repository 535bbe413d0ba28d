"""Tables that no operator may stumble over, and plain models to hold results against."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, part string, row int, k double, " \
    "kept string, fingerprint string, rate string, bucket string, spans string, n_words string, target int"


def words(text):
    return WORD.findall(text or "")


def passage(seed, count):
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i * seed) % 997}" for i in range(count))


def rows():
    """Nulls in every column, empty, blank and very long texts, copies, near copies, ties and repeated rows; the
    extra columns carry names that operators use themselves."""
    shared = passage(5, 70)
    texts = [
        (1, passage(1, 120), "a"), (2, passage(2, 30) + "\n" + shared + " tail one", "b"), (3, shared, "b"),
        (4, "before " + shared + " after", "c"), (5, passage(1, 120), "a"), (6, None, "a"), (7, "", "a"),
        (8, " \t\n\x0b\x0c\r ", None), (9, "word", "é"), (10, "two  words", "z"), (11, passage(3, 20_000), "a"),
        (12, passage(4, 49), "a"), (13, passage(4, 49), None), (14, "same " * 300, "b"), (15, "same " * 300, "b"),
        (16, "nbsp inside \x1cfs \x85nel 中文 😀 <|endoftext|>", "c"), (None, passage(1, 120), "a"), (None, None, None),
        (17, "GROSS!! LAUT!! " * 40, "d"), (17, "GROSS!! LAUT!! " * 40, "d"), (18, passage(6, 80), "d"),
        (18, passage(7, 80), "d"), (19, passage(1, 119) + " changed", "a"),
        (20, "mail joe.doe+x@mail.example.com or +1 (555) 010-2345, card 4111 1111 1111 1111, host 10.20.30.40", "a"),
        (21, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and 1.2.3.4.5 and 999.1.1.1 and a@b', "a"),
    ]
    extra = ("x",) * 1 + (None, 3, None, "p", 1, 0.5, "no", "f", "r", "b", "s", "w", 4)
    return [(number, text, None if number == 2 else "en", source, *extra[2:]) for number, text, source in texts]


def docs(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
