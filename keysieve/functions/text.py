"""String and array expressions the operators are built from."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python treats as white space, and the ones that
# end a line there. The JVM's own classes are narrower.
WHITE_SPACE = "".join(
    chr(c)
    for c in (
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
        0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
)
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
# Line breaks that are not counted by counting "\n", besides a lone "\r".
UNCOUNTED_BREAKS = "\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
# Members of a class of word characters; the ASCII ones first, as the cheap test.
WORD = r"\w\p{L}\p{N}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    Catalyst may inline a plain column into every place that uses it; a lambda
    variable is evaluated exactly once per row.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def contains_any(text: Column, terms: Iterable[str]) -> Column:
    return any_of(text.contains(t) for t in terms)


def rlike_any(text: Column, terms: Iterable[str]) -> Column:
    """``contains_any`` in one expression: for short texts that are expensive to spell out."""
    return text.rlike("|".join(rf"\Q{t}\E" for t in terms))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def line_breaks(text: Column) -> Column:
    """How often ``\\n`` occurs."""
    return F.size(F.split(text, "\n", -1)) - 1


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def first_group(text: Column, regex: str) -> Column:
    """Group 1 of the first match, or null."""
    return blank_to_null(F.regexp_extract(text, regex, 1))


def lines_of(text: Column) -> Column:
    return F.split(text, LINE_BREAK, -1)


def has_uncounted_break(text: Column) -> Column:
    lone_return = text.contains("\r") & text.rlike(r"\r(?!\n)")
    return contains_any(text, UNCOUNTED_BREAKS) | lone_return


def line_at(text: Column, number: Column) -> Column:
    """Text of a 1-based line; empty when out of range."""
    return F.coalesce(F.get(lines_of(text), number - 1), F.lit(""))


def keep_present(values: list[Column]) -> Column:
    """Array of the given strings without the null ones, in order."""
    return F.array_compact(F.array(*values))


def running_ends(lengths: Column) -> Column:
    """[0, l0, l0+l1, ...] for an array of lengths."""
    return F.aggregate(
        lengths,
        F.array(F.lit(0)),
        lambda ends, n: F.concat(ends, F.array(F.element_at(ends, -1) + n)),
    )


def find_all(text: Column, regex: str) -> Column:
    """All matches as array<struct<value,start>>, ``start`` being a 0-based offset.

    The offsets come from the gaps between matches, so they need no engine
    support for positions.
    """

    def located(parts: Column) -> Column:
        lengths = F.transform(
            parts["found"], lambda m, i: F.length(F.get(parts["gaps"], i)) + F.length(m)
        )
        return let(
            running_ends(lengths),
            lambda ends: F.transform(
                parts["found"],
                lambda m, i: F.struct(
                    m.alias("value"),
                    (F.get(ends, i) + F.length(F.get(parts["gaps"], i))).alias("start"),
                ),
            ),
        )

    return let(
        F.struct(
            F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("found"),
            F.split(text, regex, -1).alias("gaps"),
        ),
        located,
    )


def shannon_entropy(value: Column) -> Column:
    """Base-2 entropy over characters; 0.0 for the empty string.

    Sorting the characters turns equal ones into runs, whose lengths are the
    counts: one pass, however many different characters there are.
    """
    ordered = F.array_join(F.sort_array(F.split(value, "", -1)), "")
    length = F.length(value)

    def add(total: Column, run: Column) -> Column:
        return let(F.length(run) / length, lambda share: total + share * F.log2(share))

    runs = F.regexp_extract_all(ordered, F.lit(r"(?s)(.)\1*"), F.lit(0))
    return F.when(length == 0, F.lit(0.0)).otherwise(F.abs(F.aggregate(runs, F.lit(0.0), add)))


def mask(value: Column, prefix: int = 4, suffix: int = 4) -> Column:
    """Show only the ends of a value; short values become all stars."""
    length = F.length(value)
    return F.when(length <= prefix + suffix, F.repeat(F.lit("*"), length)).otherwise(
        F.concat(
            F.substring(value, 1, prefix),
            F.lit("********"),
            F.substring(value, length - suffix + 1, F.lit(suffix)) if suffix else F.lit(""),
        )
    )


def portable_boundaries(regex: str) -> str:
    r"""Spell a leading or trailing ``\b`` next to a word character as look-around.

    What ``\b`` means for non-ASCII letters depends on the JVM version; the
    spelled-out form is Unicode-aware everywhere.
    """
    if regex.startswith(r"\b"):
        regex = rf"(?<![{WORD}])" + regex[2:]
    if regex.endswith(r"\b"):
        regex = regex[:-2] + rf"(?![{WORD}])"
    return regex


def truthy(value: Column) -> Column:
    """Text 1/1.0/true/yes/y in any case and numbers other than zero; all else, null and NaN included, is false."""
    text = F.lower(strip(value.cast("string")))
    number = F.when(~F.typeof(value).isin("string", "boolean"), text.try_cast("double"))
    other = (number != 0) & ~F.isnan(number)
    return F.coalesce(text.isin("1", "1.0", "true", "yes", "y"), F.lit(False)) | F.coalesce(other, F.lit(False))
