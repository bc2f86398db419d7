"""Patterns spelt for the JVM engine against the plain ones."""

import random
import re
import time

from pyspark.sql import functions as F

from keysieve import catalog as C
from keysieve.operators import labeling, recover


def _texts(seed, many):
    rng = random.Random(seed)
    pieces = ["a", "B7", "-", "_", ".", ":", " ", "\n", "é", "\U0001f600", "x" * 15, "y" * 16, "z" * 31, "Q9" * 16, "/", "=", '"']
    return ["".join(rng.choices(pieces, k=rng.randrange(12))) for _ in range(many)]


def test_runs_are_found_without_looking_behind(spark):
    assert not any("(?<" in p for p in (recover._RUN, recover._TOKEN, recover._LONG_RUN))
    texts = [*_texts(3, 300), "", "k" * 32, "k" * 31, "\U0001f600" + "k" * 32, "k" * 16 + "/" + "m" * 16]
    tokens = recover._hits_in_segment(F.col("t"), C.SIGNATURES, True)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(
        "i", F.concat(F.lit(" "), "t").rlike(recover._LONG_RUN).alias("long"), recover.may_hold_value(F.col("t")).alias("may"),
        F.transform(tokens, lambda h: h["value"]).alias("values"),
        F.transform(tokens, lambda h: F.substring("t", h["start"] + 1, F.length(h["value"]))).alias("there"),
    )
    found = {r.i: r for r in rows.collect()}
    for i, text in enumerate(texts):
        assert found[i].long == bool(re.search("%s{32}" % C.RUN_CLASS, text)), text
        assert found[i].may or not found[i].values, text
        assert found[i]["values"] == found[i].there, text
    assert found[len(texts) - 4]["values"] == ["k" * 32] == found[len(texts) - 2]["values"]


def test_a_binding_is_found_in_linear_time(spark):
    names = ["api_key", "token", "Secret-Key", "google", "xgoogle.rest", "key"]
    rng = random.Random(5)
    texts = _texts(6, 200) + ["".join(rng.choices([*names, " ", "=", ":", "'", "abcdefgh", "1234", "\n", "é"], k=9)) for _ in range(600)]
    found = [bool(re.search("(?i)" + labeling._BINDING, t)) for t in texts]
    assert found == [bool(re.search("(?i)" + C.SENSITIVE_BINDING_REGEX, t)) for t in texts] and 0 < sum(found) < len(found)
    rows = spark.createDataFrame([("x" * 60_000,), ("x" * 9 + "token = abcdefgh",)], "context_window string")
    start = time.perf_counter()
    assert len(labeling.with_suggestion(rows).select("context_window", "review_bucket", "_score").collect()) == 2
    assert time.perf_counter() - start < 15
