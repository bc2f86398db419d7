"""Candidate recovery: from files to candidate strings with exact positions.

A file becomes bounded segments cut at places no match can span, a segment
becomes its long token runs, and only those runs meet the signatures. Cost is
linear in the text, no row ever holds more than a segment and its candidates,
and a candidate leaves with the text windows later steps need, so the content
itself is never copied past this point.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keysieve import catalog as C
from keysieve.functions import paths
from keysieve.functions.assets import ASSET_TYPE, asset_matches
from keysieve.functions.reuse import built_once
from keysieve.functions.text import (
    SPACE,
    WORD,
    any_of,
    contains_any,
    find_all,
    first_group,
    has_uncounted_break,
    let,
    line_breaks,
    lines_of,
    portable_boundaries,
    running_ends,
    shannon_entropy,
    strip,
)
from keysieve.operators.python_facts import segmented_facts

SEGMENT_CHARS = 8192
USAGE_CHARS = 240
LONG_LINE = 8192

# Runs are searched for with the character before them, in a text with a blank in front: letters inside a word then
# cost one test each, a third less time than a look-behind.
_RUN = "[^{0}{1}{{{2}}}".format(C.RUN_CLASS[1:], C.RUN_CLASS, C.MIN_VALUE_LENGTH)
_TOKEN = "[^{0}{1}{{{2},}}".format(C.TOKEN_CLASS[1:], C.TOKEN_CLASS, C.MIN_VALUE_LENGTH)
_LONG_RUN = "[^{0}{1}{{{2}}}".format(C.RUN_CLASS[1:], C.RUN_CLASS, C.LONG_RUN)
_HIT_TYPE = "array<struct<sig_ord:int,provider:string,tier:string,value:string,start:int>>"

_LINE_TOKENS = "struct<usage:string,config_key:string,variable:string,call:string>"

_FILE_COLUMNS = (
    "file_id", "file_ord", "repository", "file_path", "url", "raw_url", "pattern_source", "language",
)

# Configuration key and code tokens of a line, in the JVM's spelling of the
# Unicode classes the rules mean.
_NAME = rf"[A-Za-z_$][{WORD}$]*"
_NAME_START = rf"(?:(?=[A-Za-z_])(?<![{WORD}])|(?=\$)(?<=[{WORD}]))"
CONFIG_KEY = rf"^[{SPACE}]*['\"]?([A-Za-z0-9_.\-/]+)['\"]?[{SPACE}]*[:=]"
DECLARED_NAME = rf"(?=[clv])(?<![{WORD}])(?:const|let|var)[{SPACE}]+({_NAME})[{SPACE}]*="
QUOTED_NAME = rf"{_NAME_START}({_NAME})[{SPACE}]*[:=][{SPACE}]*['\"]"
ATTRIBUTE_NAME = rf"\.({_NAME})[{SPACE}]*=[{SPACE}]*['\"]"
CALLED_NAME = rf"{_NAME_START}([A-Za-z_$][{WORD}$.]*)[{SPACE}]*\("


def may_hold_value(text: Column) -> Column:
    """Necessary condition for any match of the catalogue, cheap enough for every file.

    Most values need a long run of characters; the few that do not start with a
    rare literal or, lacking one, are searched for themselves.
    """
    short = [s for s in C.SIGNATURES if s.short_run]
    literals = [a for s in short if not s.hint for a in s.anchors]
    hints = [s.hint for s in short if s.hint]
    # Bound, because a filter is pushed to where ``text`` may be a long expression.
    return let(
        F.concat(F.lit(" "), text),
        lambda t: t.rlike(_LONG_RUN)
        | (contains_any(t, literals) & t.rlike(_RUN))
        | any_of(t.rlike(hint) for hint in hints),
    )


def line_tokens(line: Column, language: Column) -> Column:
    """What the line-based context rules read from one line."""
    is_config = language == "config"
    is_code = language.isin(*C.LINE_TOKEN_LANGUAGES)
    return F.struct(
        F.substring(strip(line), 1, USAGE_CHARS).alias("usage"),
        F.when(is_config, first_group(line, CONFIG_KEY)).alias("config_key"),
        F.when(
            is_code,
            F.coalesce(
                first_group(line, DECLARED_NAME),
                first_group(line, QUOTED_NAME),
                first_group(line, ATTRIBUTE_NAME),
            ),
        ).alias("variable"),
        F.when(is_code, first_group(line, CALLED_NAME)).alias("call"),
    )


def _segments(content: Column, chars: int | None) -> Column:
    """Pieces of about ``chars`` characters that never end inside a token run."""
    if chars is None:
        return F.array(content)
    cut = rf"(?s).{{1,{chars}}}{C.TOKEN_CLASS}*"
    return F.when(F.length(content) <= chars, F.array(content)).otherwise(
        F.regexp_extract_all(content, F.lit(cut), F.lit(0))
    )


def _placed_segments(content: Column, chars: int | None, lines: Column, facts: Column) -> Column:
    """Segments with their place in the file and their surroundings.

    ``lines`` holds a struct per line: its text, or its tokens when it is so
    long that every segment on it would otherwise carry a copy. It is null for a
    plain file, whose only segment shows every line by itself.
    """

    def place(segs: Column) -> Column:
        sizes = F.transform(segs, F.length)
        breaks = F.transform(segs, lambda s: line_breaks(s))
        bound = F.struct(
            running_ends(sizes).alias("offsets"),
            running_ends(breaks).alias("lines"),
            breaks.alias("breaks"),
            # Characters after the last line break before each segment.
            F.aggregate(
                segs,
                F.array(F.lit(0)),
                lambda cols, s: F.concat(
                    cols,
                    F.array(
                        F.length(F.substring_index(s, "\n", -1))
                        + F.when(s.contains("\n"), F.lit(0)).otherwise(F.element_at(cols, -1))
                    ),
                ),
            ).alias("columns"),
        )
        return let(
            bound,
            lambda b: F.transform(
                segs,
                lambda s, i: F.struct(
                    s.alias("text"),
                    F.get(b["offsets"], i).alias("offset"),
                    F.get(b["lines"], i).alias("line"),
                    F.get(b["columns"], i).alias("column"),
                    F.coalesce(F.right(F.get(segs, i - 1), F.lit(C.ASSET_WINDOW)), F.lit("")).alias("before"),
                    F.coalesce(F.left(F.get(segs, i + 1), F.lit(C.ASSET_WINDOW)), F.lit("")).alias("after"),
                    F.slice(lines, F.get(b["lines"], i) + 1, F.get(b["breaks"], i) + 1).alias("lines"),
                    lines.isNull().alias("plain"),
                    (F.size(segs) == 1).alias("whole"),
                    _facts_in(facts, i).alias("py"),
                ),
            ),
        )

    return let(_segments(content, chars), place)


@built_once
def _file_segments(chars: int | None) -> Column:
    """Segments of the file in ``content``, with lines and Python facts."""
    content, language = F.col("content"), F.col("language")

    def lines(odd: Column) -> Column:
        every = F.when(odd, lines_of(content)).otherwise(
            # Without other breaks the cheap split differs in a trailing "\r" at most.
            F.transform(F.split(content, "\n", -1), lambda line: F.rtrim(line, F.lit("\r")))
        )
        carried = F.transform(
            every,
            lambda line: F.when(
                F.length(line) > LONG_LINE,
                F.struct(F.lit(None).cast("string").alias("text"), line_tokens(line, language).alias("tokens")),
            ).otherwise(_text_line(line)),
        )
        return carried if chars is None else F.when((F.length(content) > chars) | odd, carried)

    return let(
        let(has_uncounted_break(content), lines),
        lambda own: _placed_segments(content, chars, own, F.col("py_all")),
    )


def _text_line(line: Column) -> Column:
    return F.struct(line.alias("text"), F.lit(None).cast(_LINE_TOKENS).alias("tokens"))


def _with_assets(facts: Column) -> Column:
    """Python facts with the assets of the listed texts instead of the texts."""
    assets = F.transform(facts["sources"], lambda text: F.array_distinct(asset_matches(text)))
    return F.when(facts.isNotNull(), F.struct(facts["parse_error"], assets.alias("assets"), facts["segments"]))


def _facts_in(facts: Column, number: Column) -> Column:
    """The Python facts that candidates of a segment ask for."""
    none = F.array().cast(ASSET_TYPE)

    def named(rows: Column, *fields: str) -> Column:
        return F.transform(
            rows,
            lambda r: F.struct(
                *(r[f].alias(f) for f in fields),
                F.coalesce(F.when(r["source"] >= 0, F.get(facts["assets"], r["source"])), none).alias("assets"),
            ),
        )

    def of(own: Column) -> Column:
        return F.struct(
            facts["parse_error"].alias("parse_error"),
            own["places"].alias("places"),
            named(own["calls"], "call_line", "call_name", "names_loaded").alias("calls"),
            named(own["scopes"], "start_line", "end_line").alias("scopes"),
        )

    return F.when(facts.isNotNull(), let(F.get(facts["segments"], number), of))


def _hits_in_token(token: Column, signatures: Sequence[C.Signature]) -> Column:
    """Matches of every signature in one text, in signature order."""

    def hits_of(order: int, sig: C.Signature) -> Column:
        possible = F.length(token) >= sig.min_length
        if sig.anchors:
            possible = possible & any_of(token.contains(a) for a in sig.anchors)
        hits = F.transform(
            find_all(token, portable_boundaries(sig.scan_regex or sig.regex)),
            lambda m: F.struct(
                F.lit(order).alias("sig_ord"),
                F.lit(sig.provider).alias("provider"),
                F.lit(sig.tier).alias("tier"),
                m["value"].alias("value"),
                m["start"].alias("start"),
            ),
        )
        return F.when(possible, hits).otherwise(F.array().cast(_HIT_TYPE))

    every = F.flatten(F.array(*(hits_of(i, sig) for i, sig in enumerate(signatures))))
    return F.filter(every, lambda h: F.length(h["value"]) >= C.MIN_VALUE_LENGTH)


def _hits_in_segment(text: Column, signatures: Sequence[C.Signature], tokenise: bool) -> Column:
    if not tokenise:
        return _hits_in_token(text, signatures)

    def in_token(token: Column, start: Column) -> Column:
        # One character of surroundings decides the word boundaries; no
        # signature can consume it, since it is outside the token class.
        left = F.when(start > 0, F.substring(text, start, F.lit(1))).otherwise(F.lit(""))
        right = F.substring(text, start + F.length(token) + 1, F.lit(1))
        return let(
            F.struct(F.concat(left, token, right).alias("text"), (start - F.length(left)).alias("base")),
            lambda f: F.transform(
                _hits_in_token(f["text"], signatures),
                lambda h: h.withField("start", h["start"] + f["base"]),
            ),
        )

    def over(tokens: Column) -> Column:
        # Tokens are maximal runs in order, so each is the first occurrence of
        # its text after the one before.
        ends = F.aggregate(
            tokens,
            F.array(F.lit(0)),
            lambda seen, t: F.concat(
                seen,
                F.array(F.position(t, text, F.element_at(seen, -1) + 1) - 1 + F.length(t)),
            ),
        )
        return let(
            ends,
            lambda after: F.flatten(
                F.transform(tokens, lambda t, i: in_token(t, F.get(after, i + 1) - F.length(t)))
            ),
        )

    found = F.regexp_extract_all(F.concat(F.lit(" "), text), F.lit(_TOKEN), F.lit(0))
    return let(F.transform(found, lambda t: F.substring(t, 2, F.length(t))), over)


@built_once
def _candidates_in_segment(signatures: Sequence[C.Signature], tokenise: bool) -> Column:
    """Candidates of the segment in ``seg`` with place, windows and line tokens."""
    seg, language = F.col("seg"), F.col("language")

    def describe(hit: Column, around: Column) -> Column:
        def build(prefix: Column) -> Column:
            line = seg["line"] + line_breaks(prefix)
            column = F.length(F.substring_index(prefix, "\n", -1)) + F.when(
                prefix.contains("\n"), F.lit(0)
            ).otherwise(seg["column"])
            lead = F.length(seg["before"]) + hit["start"]
            margin = F.least(lead, F.lit(C.ASSET_WINDOW))
            rest = F.substring(seg["text"], hit["start"] + 1, F.length(seg["text"]))
            shown = F.concat(F.substring_index(prefix, "\n", -1), F.substring_index(rest, "\n", 1))
            return F.struct(
                hit["sig_ord"].alias("sig_ord"),
                hit["provider"].alias("provider"),
                hit["tier"].alias("signature_confidence"),
                hit["value"].alias("value"),
                shannon_entropy(hit["value"]).alias("entropy"),
                (seg["offset"] + hit["start"]).alias("start_index"),
                (seg["offset"] + hit["start"] + F.length(hit["value"])).alias("end_index"),
                (line + 1).alias("line_number"),
                (column + 1).alias("column_number"),
                F.substring(
                    around, lead - margin + 1, margin + F.length(hit["value"]) + C.ASSET_WINDOW
                ).alias("window"),
                margin.alias("window_lead"),
                let(
                    F.when(seg["plain"], _text_line(F.rtrim(shown, F.lit("\r")))).otherwise(
                        F.get(seg["lines"], line - seg["line"])
                    ),
                    lambda own: F.coalesce(own["tokens"], line_tokens(own["text"], language)),
                ).alias("line_facts"),
            )

        return let(F.left(seg["text"], hit["start"]), build)

    # The next segment starts with the character that ended this one's last run.
    closed = F.concat(seg["text"], F.left(seg["after"], F.lit(1))) if tokenise else seg["text"]
    return let(
        F.concat(seg["before"], seg["text"], seg["after"]),
        lambda around: F.transform(
            _hits_in_segment(closed, signatures, tokenise), lambda h: describe(h, around)
        ),
    )


def _is_kept(candidate: Column) -> Column:
    return candidate["signature_confidence"].isin(*C.TRUSTED_TIERS) | (candidate["entropy"] >= C.MIN_ENTROPY)


def _first_on_line(candidates: Column) -> Column:
    """Of the kept candidates of a segment, the first by signature and place for each value and line."""

    def firsts(found: Column) -> Column:
        names = F.transform(found, lambda c: F.struct(c["value"], c["line_number"]))
        return let(
            names,
            lambda own: F.filter(found, lambda c, i: F.array_position(own, F.struct(c["value"], c["line_number"])) == i + 1),
        )

    def earlier(a: Column, b: Column) -> Column:
        order = lambda c: F.struct(c["sig_ord"], c["start_index"])
        return F.when(order(a) < order(b), -1).when(order(a) > order(b), 1).otherwise(0)

    return let(F.array_sort(F.filter(candidates, _is_kept), earlier), firsts)


def recover_candidates(
    files: DataFrame,
    signatures: Sequence[C.Signature] = C.SIGNATURES,
    segment_chars: int = SEGMENT_CHARS,
    keep: Sequence[str] = (),
    once_per_line: bool = False,
) -> DataFrame:
    """One row per candidate string of every file.

    ``files`` has ``file_id, file_ord, repository, path, url, raw_url, content``
    and optionally ``pattern_source``. The result carries position, entropy, the
    +-360 character window, the tokens of the candidate's line and, for Python
    files, the facts its context is derived from.

    Other signatures than the catalogue's may match any character, so their
    files are searched whole instead of by segment and token run. ``keep`` names
    more file columns to carry along. With ``once_per_line`` a value comes once
    for its line and segment, by its first signature, as a stream needs it.
    """
    standard = tuple(signatures) == C.SIGNATURES
    chars = segment_chars if standard else None
    if "pattern_source" not in files.columns:
        files = files.withColumn("pattern_source", F.lit(None).cast("string"))
    columns = (*_FILE_COLUMNS, *keep)
    content = F.col("content")
    rows = files.withColumnsRenamed({"path": "file_path"}).withColumn(
        "language", paths.language(F.col("file_path"))
    )
    if standard:
        rows = rows.where(may_hold_value(content))

    is_python = F.col("language") == "python"
    rows = rows.withColumn("py_all", segmented_facts(F.when(is_python, content), chars))
    rows = rows.withColumn("py_all", _with_assets(F.col("py_all")))
    segments = rows.select(
        *columns,
        F.when(is_python, F.array_distinct(asset_matches(content))).alias("file_assets"),
        F.explode(_file_segments(chars)).alias("seg"),
    )
    if standard:
        segments = segments.where(F.col("seg.whole") | may_hold_value(F.col("seg.text")))

    every = _candidates_in_segment(tuple(signatures), standard)
    found = segments.select(
        *columns,
        F.struct(F.col("seg.py").alias("facts"), F.col("file_assets")).alias("py"),
        F.explode(let(every, _first_on_line) if once_per_line else every).alias("c"),
    )
    return found.where(_is_kept(F.col("c"))).select(*columns, "c.*", "py")


def first_wins(candidates: DataFrame) -> DataFrame:
    """Keep the first candidate per repository, path, value and line.

    First means: earliest file, then signature order, then position. The rank
    filter is applied before the shuffle as well, so a key shared by very many
    copies arrives as one row per input task.
    """
    order = Window.partitionBy("repository", "file_path", "value", "line_number").orderBy(
        "file_ord", "sig_ord", "start_index"
    )
    return (
        candidates.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
    )
