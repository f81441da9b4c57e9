"""A small documents table with everything that is odd, for every operator."""

import random

WORDS = "the of and river stone light under morning paper glass window winter garden quiet letter".split()

ENDINGS = ["", "s", "ed", "ing", "ly"]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(ENDINGS) + ("." if rng.random() < 0.1 else "") for _ in range(n))


LONG = prose(1, 40_000) + "\n" + prose(2, 10)
# Nulls in any column, empty and very long texts, repeated rows, ids used twice.
ODD = [
    (1, "The mit license, and idiots.", "en", "a", 5),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \t\n ", "de", None, 3),
    (5, "...!!! 123", "", "b", 1),
    (6, prose(3, 70), "en", "b", 9),
    (6, prose(3, 70), "en", "b", 9),
    (6, prose(4, 70), "fr", "c", 9),
    (7, LONG, "en", "a", len(LONG)),
    (None, prose(5, 60), "en", "c", 2),
    (None, None, None, None, None),
    (8, "日本語の文章 текст на русском ελληνικά  é́ \x00 ﻿", "ja", "日本", 4),
    (9, "x" * 5000, "en", "c", 5000),
    (10, "same words here now\nsame words here now\nsame words here now", "en", "a", 1),
]
CLASHING = ["Text", "DOC_ID", "size", "score", "shard", "label", "pos", "kept", "_c0", "_row", "length", "fingerprint"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """A documents table with further columns, whose names differ in case only or are those of results."""
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", *[f"'x{i}' as e{i}" for i in range(len(CLASHING))]).toDF(*df.columns, *CLASHING)
