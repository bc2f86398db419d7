"""Recovery against Python's own regex engine, on texts made to be awkward."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from keysieve import catalog as C
from keysieve.operators.recover import first_wins, may_hold_value, recover_candidates
from tests.conftest import SOURCE_SCHEMA

ALNUM = "abcdefABCDEF0123456789xyzXYZ"
HEX = "0123456789abcdef"
JOINTS = [" ", "\n", '"', "\r\n", "\r", "\x0c", "\u2028", "\xe9", "\U0001F600", "_", "-", ".", ":", "=", "\n\n", "..", ""]


def _text(rng, n, alphabet):
    return "".join(rng.choice(alphabet) for _ in range(n))


def _value(rng):
    t = lambda n, a: _text(rng, n, a)
    return rng.choice([
        lambda: "AKIA" + t(16, "ABCDEF0123"),
        lambda: "AIza" + t(35, ALNUM + "-_"),
        lambda: "ghp_" + t(rng.choice([36, 40]), ALNUM + "_"),
        lambda: "glpat-" + t(20, ALNUM),
        lambda: "sk_live_" + t(24, ALNUM),
        lambda: "sk-" + t(48, ALNUM),
        lambda: "sk-proj-" + t(rng.choice([20, 50]), ALNUM + "-_"),
        lambda: "xoxb-" + t(rng.choice([0, 9, 10, 11, 30, 60]), ALNUM),
        lambda: "AC" + t(32, HEX),
        lambda: "key-" + t(32, ALNUM),
        lambda: "pypi-AgEI" + t(55, ALNUM),
        lambda: t(rng.choice([24, 40]), ALNUM) + "." + t(6, ALNUM) + "." + t(27, ALNUM),
        lambda: t(rng.choice([8, 9, 12]), "0123456789") + ":" + t(35, ALNUM),
        lambda: "-".join(t(n, HEX) for n in (8, 4, 4, 4, 12)),
        lambda: t(32, ALNUM),
        lambda: t(40, HEX),
        lambda: t(64, HEX),
        lambda: "a" * 32,
        lambda: t(rng.choice([31, 33, 100]), ALNUM),
    ])()


def _corpus(seed, count):
    rng = random.Random(seed)
    for i in range(count):
        parts = []
        for _ in range(rng.randrange(1, 40)):
            parts.append(rng.choice([_value(rng), _value(rng), _text(rng, rng.randrange(30), ALNUM + " .\n"), "caf\xe9"]))
            parts.append(rng.choice(JOINTS))
        yield (i, i, "acme", f"f{i}.txt", "u", "r", "".join(parts))


def _entropy(value):
    counts = Counter(value)
    return -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())


def _expected(rows):
    for file_id, *_, text in rows:
        for order, sig in enumerate(C.SIGNATURES):
            for m in re.finditer(sig.regex, text):
                value, start = m.group(), m.start()
                if len(value) < 16 or (sig.tier not in C.TRUSTED_TIERS and _entropy(value) < 2.5):
                    continue
                line = text.count("\n", 0, start) + 1
                lines = text.splitlines()
                shown = (lines[line - 1] if line <= len(lines) else "").strip()[:240]
                column = start - text.rfind("\n", 0, start)
                yield (file_id, order, value, start, m.end(), line, column, text[max(0, start - 360) : m.end() + 360], shown)


ROWS = list(_corpus(11, 300))
CUSTOM = (*C.SIGNATURES, C.Signature("Blank-spanning", r"zzzzzzzzzz zzzzzzzzzz", "LOW"))


@pytest.mark.parametrize("chars, signatures", [(400, C.SIGNATURES), (8192, C.SIGNATURES), (8192, CUSTOM)])
def test_same_as_finditer(spark, chars, signatures):
    files = spark.createDataFrame(ROWS, SOURCE_SCHEMA).repartition(8)
    got = recover_candidates(files, signatures, chars).select(
        "file_id", "sig_ord", "value", "start_index", "end_index", "line_number", "column_number", "window",
        "line_facts.usage",
    ).collect()
    assert sorted(map(tuple, got)) == sorted(_expected(ROWS))


def test_custom_signature_may_span_blanks(spark, files):
    custom = (C.Signature("Pair", r"user=\w+ pass=\w+", "HIGH"),)
    rows = recover_candidates(files(("a.txt", "x\nuser=alice pass=0123456789abcdef\n")), custom).collect()
    assert [(r["value"], r["line_number"], r["column_number"]) for r in rows] == [
        ("user=alice pass=0123456789abcdef", 2, 1)
    ]


def test_prefilter_never_drops_a_match(spark):
    rng = random.Random(3)
    texts = [(f"x {_value(rng)} y",) for _ in range(2000)]
    kept = spark.createDataFrame(texts, "t string").where(may_hold_value(F.col("t"))).collect()
    kept = {r["t"] for r in kept}
    for (text,) in texts:
        hit = any(len(m.group()) >= 16 for s in C.SIGNATURES for m in re.finditer(s.regex, text))
        assert not hit or text in kept


def test_long_values_and_lines_stay_whole(files):
    value = "sk-proj-" + "Ab1_" * 20_000
    text = "x" * 50_000 + ' = "' + value + '"' + " " * 30_000 + "const late = 1; call(\n"
    row = recover_candidates(files(("a.js", text))).where("provider = 'OpenAI Project Key'").collect()
    assert [r["value"] for r in row] == [value]
    # A declaration beats a quoted name, however far into the line it stands.
    assert row[0]["line_facts"]["variable"] == "late"


def test_first_candidate_wins_over_copies(spark, files):
    key = "0123456789abcdef0123456789abcdef01234567"
    copies = files(*[("a.txt", f"{key}\n{key} {key}\n")] * 3)
    kept = first_wins(recover_candidates(copies).drop("py", "line_facts")).orderBy("line_number").collect()
    assert [(r["file_ord"], r["line_number"], r["start_index"]) for r in kept] == [(1, 1, 0), (1, 2, 41)]


def test_result_does_not_depend_on_partitions(spark):
    files = spark.createDataFrame(ROWS[:80], SOURCE_SCHEMA)
    keep = ["file_id", "sig_ord", "start_index", "value", "line_number"]

    def run(parts):
        return sorted(map(tuple, first_wins(
            recover_candidates(files.repartition(parts)).drop("py", "line_facts")).select(*keep).collect()))

    assert run(1) == run(8)
