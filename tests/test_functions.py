"""Column functions against plain Python."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keysieve import catalog as C
from keysieve.functions import paths
from keysieve.functions.assets import asset_matches
from keysieve.functions.text import line_at, mask, shannon_entropy, strip
from keysieve.operators.features import nearest_term_distance
from keysieve.operators.recover import ATTRIBUTE_NAME, CALLED_NAME, CONFIG_KEY, DECLARED_NAME, QUOTED_NAME
from keysieve.functions.text import first_group


def column(spark, values, make, schema="i int, v string"):
    rows = spark.createDataFrame(list(enumerate(values)), schema).select("i", make(F.col("v")).alias("o"))
    return [r["o"] for r in rows.orderBy("i").collect()]


def test_languages(spark):
    names = {
        ".env": "config", "prod.env": "config", ".env.local": "plain_text", "a.tar.gz": "plain_text",
        "x/A.PY": "python", "docker-compose.yml": "config", "a/b.tsx": "javascript", "K.kts": "jvm",
        "m.rs": "tree_sitter_candidate", "x.cc": "plain_text", "README.rst": "documentation", "Makefile": "plain_text",
        "dir.py/": "python", "trailing.": "plain_text",
    }
    assert column(spark, names, paths.language) == list(names.values())


def test_path_markers(spark):
    docs = {"docs/x.md": False, "a/docs/x": True, "C:\\x\\tests\\a.py": True, "latest_run.py": True, "src/latest.py": False,
            "API_KEYS.md": True, "my.mock": True}
    assert column(spark, docs, paths.is_doc_or_test) == list(docs.values())
    templates = {"a/sample.yml": True, "sample/a.yml": False, "x\\API_KEYS.MD": True, "keys.md": False}
    assert column(spark, templates, paths.is_template_file) == list(templates.values())


def test_masks(spark):
    assert column(spark, ["", "12345678", "123456789"], mask) == ["", "*" * 8, "1234********6789"]
    assert column(spark, ["abcdef"], lambda c: mask(c, 2, 0)) == ["ab********"]


def test_entropy(spark):
    got = column(spark, ["", "aaaa", "abcd", "aabb\n\u00e9"], shannon_entropy)
    assert [round(x, 10) for x in got] == [0.0, 0.0, 2.0, 1.9182958341]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\r\n\x0b\x0c\x1c\x85\xa0\u2003\u2028\u3000", max_size=30), min_size=20, max_size=40))
def test_lines_and_strip_are_pythons(spark, texts):
    assert column(spark, texts, strip) == [t.strip() for t in texts]
    for number in (1, 2, 4):
        want = [t.splitlines()[number - 1] if number <= len(t.splitlines()) else "" for t in texts]
        assert column(spark, texts, lambda c: line_at(c, F.lit(number))) == want


def _assets(text):
    out = []
    for regex, kind in ((C.DATABASE_REGEX, "database"), (C.URL_REGEX, "url"), (C.HOST_REGEX, "host")):
        out += [(m.group().rstrip(".,);]"), kind) for m in re.finditer(regex, text)]
    return out


def test_assets_are_the_plain_patterns(spark):
    rng = random.Random(9)
    bits = ["a", "b1", "com", "io", "internal", ".", "..", "-", "_", "\xe9", " ", "\n", "https://", "redis://", "jdbc://",
            "postgresql://", "/x?y=", "'", ")", "]", ",", "\xa0", "dev", ".com", ".net", "\u2003", "xmysql://", ":5432"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 30))) for _ in range(4000)]
    got = column(spark, texts, asset_matches)
    assert [[tuple(a) for a in row] for row in got] == [_assets(t) for t in texts]


def test_long_dotted_runs_do_not_overflow(spark):
    (got,) = column(spark, ["a." * 50_000 + "com"], asset_matches)
    assert [len(a["reference"]) for a in got] == [100_003]


def test_nearest_term_distance(spark):
    rng = random.Random(4)
    bits = [*C.SECRET_TERMS, " ", "x", "yy", "_", "key", "\u00e9"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 30))) for _ in range(1500)]
    want = [
        min((abs(m.start() - len(t) // 2) for term in C.SECRET_TERMS for m in re.finditer(term, t)), default=None)
        for t in texts
    ]
    assert column(spark, texts, nearest_term_distance) == want


def test_line_tokens_are_the_plain_patterns(spark):
    plain = {
        CONFIG_KEY: r"\s*['\"]?([A-Za-z0-9_.\-/]+)['\"]?\s*[:=]",
        DECLARED_NAME: r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=",
        QUOTED_NAME: r"\b([A-Za-z_$][\w$]*)\s*[:=]\s*['\"]",
        ATTRIBUTE_NAME: r"\.([A-Za-z_$][\w$]*)\s*=\s*['\"]",
        CALLED_NAME: r"\b([A-Za-z_$][\w$.]*)\s*\(",
    }
    rng = random.Random(6)
    bits = ["const ", "let", "var\t", "x", "$", "a$b", "\xe9", "_", ".", "=", ":", "'", '"', "(", " ", "\xa0", "9", "/", "-"]
    lines = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 16))) for _ in range(3000)]
    lines += ["export FOO=1", '"K": "v"', "- k: v", "https://x", "  key = 'v'"]
    for ours, theirs in plain.items():
        find = re.match if ours == CONFIG_KEY else re.search
        want = [(m.group(1) if (m := find(theirs, line)) else None) for line in lines]
        assert column(spark, lines, lambda c: first_group(c, ours)) == want, theirs
