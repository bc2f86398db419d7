"""Databases, URLs and hosts named in a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keysieve import catalog as C
from keysieve.functions.text import SPACE, WORD

_REST = rf"[^{SPACE}'\"<>]+"
_DATABASE = rf"(?=[pmraj])(?<![{WORD}])(?:postgres(?:ql)?|mysql|mongodb|redis|amqp|jdbc)://{_REST}"
_URL = rf"https?://{_REST}"

DOTTED_END = r"\.(?:com|net|org|io|dev|cloud|local|internal)"

# The catalogue's host pattern repeats a group, which the JVM engine runs by
# recursion: a long dotted run would overflow its stack. Host labels are never
# empty, so once ".." is broken up the same strings are matched by one plain
# character loop. The second look-behind skips starts that follow a complete
# label of the same run: if they led to a match, an earlier start already did.
_HOST = (
    rf"(?:(?=[a-zA-Z0-9])(?<![{WORD}])|(?=-)(?<=[{WORD}]))"
    rf"(?:(?<![.-])|(?<![^{WORD}][a-zA-Z0-9]{{1,64}}[.-]))"
    r"[a-zA-Z0-9-][a-zA-Z0-9.-]*" + DOTTED_END + rf"(?![{WORD}])"
)

_HOST_WORD = r"(?<!\S)\S*" + DOTTED_END + r"\S*"

ASSET_TYPE = "array<struct<reference:string,kind:string>>"


def asset_matches(text: Column) -> Column:
    """array<struct<reference,kind>>: databases first, then URLs, then hosts."""

    none = F.array().cast(ASSET_TYPE)

    def found(possible: Column, matches: Column, kind: str) -> Column:
        every = F.transform(
            matches,
            lambda m: F.struct(
                F.rtrim(m, F.lit(C.ASSET_TRAILING)).alias("reference"), F.lit(kind).alias("kind")
            ),
        )
        # The cheap necessary condition spares most texts the full pattern.
        return F.when(possible, every).otherwise(none)

    # Hosts hold no blanks: only the words that may end like one are searched.
    undoubled = F.when(text.contains(".."), F.regexp_replace(text, r"\.(?=\.)", ". ")).otherwise(text)
    words = F.regexp_extract_all(undoubled, F.lit(_HOST_WORD), F.lit(0))
    hosts = F.flatten(
        F.transform(words, lambda word: F.regexp_extract_all(word, F.lit(_HOST), F.lit(0)))
    )
    addressed = text.contains("://")
    return F.concat(
        found(addressed, F.regexp_extract_all(text, F.lit(_DATABASE), F.lit(0)), "database"),
        found(addressed, F.regexp_extract_all(text, F.lit(_URL), F.lit(0)), "url"),
        found(text.rlike(DOTTED_END), hosts, "host"),
    )


def references(assets: Column) -> Column:
    return F.array_distinct(F.transform(assets, lambda a: a["reference"]))


def kinds(assets: Column) -> Column:
    return F.array_distinct(F.transform(assets, lambda a: a["kind"]))
