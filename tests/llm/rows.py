"""A small table of documents with the cases that every operator must take: nulls in any column, empty and long texts,
ties, repeated rows, and a further column whose name clashes with results."""

import random

DDL = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string"


def words(rng, n, letters="abcdefghijklmnop"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def rows():
    rng = random.Random(7)
    long_text = words(rng, 3000)
    base = words(rng, 120)
    near = base.replace(base.split()[60], "changed", 1)
    passage = words(rng, 60)
    out = [
        (1, base, "en", "a"),
        (2, near, "en", "a"),
        (3, base, "en", "b"),
        (4, long_text, "en", "a"),
        (5, None, "de", "a"),
        (6, "", None, None),
        (7, "one two three", None, "a"),
        (8, words(rng, 50) + "\n" + passage + "\n" + words(rng, 50), "de", None),
        (9, words(rng, 40) + "\n" + passage + "\n" + words(rng, 30), "de", "b"),
        (10, "x" * 5000, "en", "a"),
        (11, ("spam ham eggs toast " * 40).strip(), "en", "a"),
        (12, "12 34 !!! ...", "de", "a"),
        (13, "mail ann@example.org or 10.0.0.1, call +1 (234) 567-8901, pay 4111 1111 1111 1111", "en", "a"),
        (14, "Released under the MIT License.\nThe Apache License, Version 2.0 too", "en", "b"),
        (None, words(rng, 40), "en", "a"),
        (15, "é" * 150 + " ünïcode 日本語 \t end", "fr", "c"),
        (15, "é" * 150 + " ünïcode 日本語 \t end", "fr", "c"),
    ]
    return [(i, t, lang, source, None if t is None else len(t), "clash", "clash") for i, t, lang, source in out]


def frame(spark):
    return spark.createDataFrame(rows(), DDL).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DDL)


def texts():
    return [t or "" for _, t, *_ in rows()]
