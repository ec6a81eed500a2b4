"""The join by a part of a text, against all pairs."""

from __future__ import annotations

import itertools
import random

from harrow.operators.parts import holding


def pairs(spark, texts, parts):
    t, p = spark.createDataFrame([(x,) for x in texts], "text string"), spark.createDataFrame([(x,) for x in parts], "part string")
    return [(r.text, r.part) for r in holding(t, "text", p, "part").collect()]


def test_holding_equals_all_pairs(spark):
    rng = random.Random(5)
    word = lambda most: "".join(rng.choice("abé") for _ in range(rng.randint(0, most)))
    texts, parts = [word(12) for _ in range(150)] + [None, "", "a\U0001f33eb", "aaaa"], [word(5) for _ in range(150)] + [None, "", "\U0001f33e", "zzz", "aaaa", "aaaaa"]
    expected = {(t, p) for t, p in itertools.product(texts, parts) if t is not None and p is not None and p in t}
    got = pairs(spark, texts, parts)
    assert len(got) == len(set(got)) and set(got) == expected


def test_holding_of_long_texts_and_of_none(spark):
    long = "abc " * 20000 + "needle"
    assert sorted(pairs(spark, [long], ["needle", "needles", "c a"])) == [(long, "c a"), (long, "needle")]
    assert pairs(spark, [], ["a", ""]) == [] and pairs(spark, ["a"], []) == []
