"""Facts about Python files: the one step that needs Python's own parser.

A file is parsed once, and only what the context rules can ask for comes back:
string literals that may hold a candidate, the calls that use a variable such a
literal is bound to, and the functions and classes around those literals.
Everything that combines these facts with candidates is a column expression in
``context``.

Recovery asks for facts by segment. A segment gets, for each of its long token
runs, the literals on the run's line that hold a value it may hold, so a literal
as long as the file goes to a segment with that segment's runs only, not whole.
It gets the innermost scopes of those runs' lines, found in one sweep over lines,
and the calls that use one of those literals' variables; of the calls below its
last line, which are there for all its candidates alike, only the first of those
that say the same. Texts to be searched for assets are listed once per file.
"""

from __future__ import annotations

import ast
import heapq
import re
import sys
import warnings
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keysieve import catalog as C
from keysieve.functions.assets import DOTTED_END

_LITERAL = T.StructType([
    T.StructField("node_ord", T.IntegerType()),
    T.StructField("start_line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()),
    T.StructField("value", T.StringType()),
    T.StructField("node_type", T.StringType()),
    T.StructField("parent_type", T.StringType()),
    T.StructField("variable", T.StringType()),
    T.StructField("enclosing_function", T.StringType()),
    T.StructField("call_name", T.StringType()),
    T.StructField("usage", T.StringType()),
])
_CALL = T.StructType([
    T.StructField("node_ord", T.IntegerType()),
    T.StructField("call_line", T.IntegerType()),
    T.StructField("call_name", T.StringType()),
    T.StructField("names_loaded", T.ArrayType(T.StringType())),
    T.StructField("source", T.StringType()),
])
_SCOPE = T.StructType([
    T.StructField("node_ord", T.IntegerType()),
    T.StructField("start_line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()),
    T.StructField("source", T.StringType()),
])
FACTS = T.StructType([
    T.StructField("parse_error", T.StringType()),
    T.StructField("literals", T.ArrayType(_LITERAL)),
    T.StructField("calls", T.ArrayType(_CALL)),
    T.StructField("scopes", T.ArrayType(_SCOPE)),
])

_IN_SOURCES = T.StructField("source", T.IntegerType())
_SEGMENT = T.StructType([
    T.StructField("places", T.ArrayType(_LITERAL)),
    T.StructField("calls", T.ArrayType(T.StructType([*(_CALL[n] for n in ("call_line", "call_name", "names_loaded")), _IN_SOURCES]))),
    T.StructField("scopes", T.ArrayType(T.StructType([_SCOPE["start_line"], _SCOPE["end_line"], _IN_SOURCES]))),
])
SEGMENTED = T.StructType([
    FACTS["parse_error"], T.StructField("sources", T.ArrayType(T.StringType())), T.StructField("segments", T.ArrayType(_SEGMENT)),
])

# Tasks use these and not the catalogue, which they can't import.
_LEAST = C.MIN_VALUE_LENGTH
_TOKEN_RUN = "%s{%d,}" % (C.TOKEN_CLASS, _LEAST)
_RUN = "%s{%d}" % (C.RUN_CLASS, _LEAST)
_TOKEN_CLASS = C.TOKEN_CLASS
# What every text with an asset has.
_MAY_NAME_ASSET = re.compile("://|" + DOTTED_END)

_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
_EMPTY = {"literals": [], "calls": [], "scopes": []}


def _dotted(expr: ast.AST) -> str | None:
    """``a.b.c`` for a chain of names; just the attributes when the root has no name."""
    parts = []
    while isinstance(expr, ast.Attribute):
        parts.append(expr.attr)
        expr = expr.value
    if isinstance(expr, ast.Name):
        parts.append(expr.id)
    return ".".join(reversed(parts)) or None


def _bound_name(target: ast.AST) -> str | None:
    match target:
        case ast.Name(id=name) | ast.Attribute(attr=name):
            return name
        case ast.Subscript():
            return "subscript"
    return None


def _binding(parent: ast.AST | None) -> str | None:
    """Name a literal is bound to by its direct parent."""
    match parent:
        case ast.Assign(targets=targets):
            return next(filter(None, map(_bound_name, targets)), None)
        case ast.AnnAssign(target=target):
            return _bound_name(target)
        case ast.keyword(arg=name):
            return name
    return None


class _Source:
    """Text of a node, from one encoding of the file."""

    def __init__(self, text: str) -> None:
        self.raw = text.encode("utf-8")
        self.starts = [0] + [m.end() for m in re.finditer(rb"\r\n|\r|\n", self.raw)]

    def span(self, node: ast.AST) -> tuple[int, int] | None:
        if getattr(node, "end_lineno", None) is None:
            return None
        begin = self.starts[node.lineno - 1] + node.col_offset
        return begin, self.starts[node.end_lineno - 1] + node.end_col_offset

    def of(self, node: ast.AST) -> str | None:
        span = self.span(node)
        return span and self.raw[span[0] : span[1]].decode("utf-8")


def file_facts(text: str, holds_value) -> dict:
    """Facts of one file; a file that does not parse has only ``parse_error``."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except SyntaxError as exc:
        return {"parse_error": f"SyntaxError: {exc.msg}", **_EMPTY}
    except (ValueError, RecursionError, MemoryError) as exc:
        return {"parse_error": f"{type(exc).__name__}: {exc}", **_EMPTY}

    # Breadth-first, carrying down what the context rules ask of ancestors.
    nodes = [(tree, -1, None, None)]
    for at, (node, _, function, call) in enumerate(nodes):
        inner = node.name if isinstance(node, _DEFS) else function
        nearest = (_dotted(node.func),) if isinstance(node, ast.Call) else call
        nodes.extend((child, at, inner, nearest) for child in ast.iter_child_nodes(node))

    source = _Source(text)
    literals, wanted = [], set()
    for at, (node, up, function, call) in enumerate(nodes):
        if not (isinstance(node, ast.Constant) and isinstance(node.value, str)):
            continue
        if not holds_value(node.value):
            continue
        parent = nodes[up][0]
        variable = _binding(parent)
        usage = source.of(parent) or ""
        literals.append({
            "node_ord": at, "start_line": node.lineno, "end_line": node.end_lineno,
            # A lone surrogate from an escape cannot leave Python as UTF-8.
            "value": node.value.encode("utf-8", "replace").decode("utf-8"),
            "node_type": type(node).__name__, "parent_type": type(parent).__name__,
            "variable": variable, "enclosing_function": function,
            "call_name": call[0] if call else None, "usage": usage.strip()[:240] or None,
            "span": source.span(node),
        })
        if variable and variable != "subscript":
            wanted.add(variable)

    loads: dict[int, set] = {}
    for node, up, _, _ in nodes:
        if isinstance(node, ast.Name) and isinstance(node.ctx, ast.Load) and node.id in wanted:
            while up >= 0:
                if isinstance(nodes[up][0], ast.Call):
                    loads.setdefault(up, set()).add(node.id)
                up = nodes[up][1]
    calls = [
        {
            "node_ord": at, "call_line": nodes[at][0].lineno,
            "call_name": _dotted(nodes[at][0].func), "names_loaded": sorted(loads[at]),
            "source": source.of(nodes[at][0]),
        }
        for at in sorted(loads)
    ]

    spans = [(lit["start_line"], lit["end_line"]) for lit in literals]
    first = min((s for s, _ in spans), default=0)
    last = max((e for _, e in spans), default=-1)
    scopes = [
        {
            "node_ord": at, "start_line": node.lineno, "end_line": node.end_lineno,
            "source": source.of(node),
        }
        for at, (node, *_) in enumerate(nodes)
        if isinstance(node, (*_DEFS, ast.ClassDef)) and node.lineno <= last and node.end_lineno >= first
    ]
    return {"parse_error": None, "literals": literals, "calls": calls, "scopes": scopes}


def _grams(run: str) -> set[str]:
    return {run[i : i + _LEAST] for i in range(len(run) - _LEAST + 1)}


def placed_literals(text: str, literals: list[dict]) -> list[dict]:
    """For each long token run, the literals on its line that share a possible value with it.

    An entry is the literal with ``at`` and ``line``, the run's place, and as ``value``
    the literal's own text of that value. A run inside a literal that is spelt as it
    reads is that text. Other runs are looked up by what literals hold.
    """
    raw = text.encode("utf-8")
    runs = [m.span() for m in re.finditer(_TOKEN_RUN.encode(), raw)]
    if not runs or not literals:
        return []
    begins = [a for a, _ in runs]
    breaks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
    lines = (np.searchsorted(breaks, begins, "left") + 1).tolist()
    chars = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    at = (chars[begins] - 1).tolist()
    texts = [raw[a:b].decode() for a, b in runs]

    found: dict[tuple[int, int], list[str]] = {}
    ranges, others = [], np.zeros(len(runs) + 1, np.int64)
    for k, literal in enumerate(literals):
        low, high = bisect_left(lines, literal["start_line"]), bisect_right(lines, literal["end_line"])
        first = last = low
        if literal["span"]:
            begin, end = literal["span"]
            value = literal["value"].encode("utf-8")
            inside = raw.find(value, begin, end)
            if inside >= 0:
                first = min(max(bisect_left(begins, inside), low), high)
                last = min(max(bisect_left(begins, inside + len(value)), first), high)
        for i in range(first, last):
            found[k, i] = [texts[i]]
        for a, b in ((low, first), (last, high)):
            others[a] += 1
            others[b] -= 1
        ranges.append((low, first, last, high))

    holders: dict[str, list[int]] = {}
    for i in np.flatnonzero(np.cumsum(others)[:-1] > 0).tolist():
        for gram in _grams(texts[i]):
            holders.setdefault(gram, []).append(i)
    if holders:
        for k, (literal, (low, first, last, high)) in enumerate(zip(literals, ranges)):
            if low == first and last == high:
                continue
            for m in re.finditer(_TOKEN_RUN, literal["value"]):
                for i in {i for gram in _grams(m[0]) for i in holders.get(gram, ())}:
                    if low <= i < first or last <= i < high:
                        found.setdefault((k, i), []).append(m[0])
    return [{**literals[k], "at": at[i], "line": lines[i], "value": "\n".join(own)} for (k, i), own in sorted(found.items())]


def _innermost(scopes: list[dict], lines: list[int]) -> dict[int, dict]:
    """For each line that a scope holds the last such scope in parse order, in one sweep."""
    starting = sorted(scopes, key=lambda s: s["start_line"], reverse=True)
    open_scopes, found = [], {}
    for line in sorted(set(lines)):
        while starting and starting[-1]["start_line"] <= line:
            scope = starting.pop()
            heapq.heappush(open_scopes, (-scope["node_ord"], scope["end_line"], id(scope), scope))
        while open_scopes and open_scopes[0][1] < line:
            heapq.heappop(open_scopes)
        if open_scopes:
            found[line] = open_scopes[0][3]
    return found


class _Sources:
    """Numbers of the texts that may name assets; -1 for the others."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}

    def number(self, text: str | None) -> int:
        if text is None or not _MAY_NAME_ASSET.search(text):
            return -1
        return self.numbers.setdefault(text, len(self.numbers))


class _Uses:
    """Calls that load one variable, asked for by segment from the last to the first."""

    def __init__(self, calls: list[dict]) -> None:
        self.calls = sorted(calls, key=lambda c: c["call_line"])
        self.lines = [c["call_line"] for c in self.calls]
        self.left = len(self.calls)
        self.later: dict[tuple, dict] = {}

    def of(self, first: int, last: int) -> list[dict]:
        """Calls from line ``first`` on; of those after ``last`` one for each name and source."""
        while self.left and self.lines[self.left - 1] > last:
            self.left -= 1
            call = self.calls[self.left]
            own = self.later.get((call["call_name"], call["number"]))
            if own is None or call["node_ord"] < own["node_ord"]:
                self.later[call["call_name"], call["number"]] = call
        return [*self.later.values(), *self.calls[bisect_left(self.lines, first) : bisect_right(self.lines, last)]]


def segment_ends(text: str, chars: int) -> list[int]:
    """Where recovery cuts a text: after about ``chars`` characters, never inside a token run."""
    if len(text) <= chars:
        return [len(text)]
    return [m.end() for m in re.finditer(r"(?s).{1,%d}%s*" % (chars, _TOKEN_CLASS), text)]


def segmented(facts: dict, places: list[dict], ends: list[int]) -> dict:
    """Facts by segment; ``places`` have the character and line at which they are asked for."""
    sources = _Sources()
    calls = [{**c, "number": sources.number(c["source"])} for c in facts["calls"]]
    using: dict[str, list[dict]] = {}
    for call in calls:
        for name in call["names_loaded"]:
            using.setdefault(name, []).append(call)
    uses = {name: _Uses(own) for name, own in using.items()}
    innermost = _innermost(facts["scopes"], [p["line"] for p in places])
    by_segment: list[list[dict]] = [[] for _ in ends]
    for place in places:
        by_segment[min(bisect_right(ends, place["at"]), len(ends) - 1)].append(place)
    segments = []
    for own in reversed(by_segment):
        lines = [p["line"] for p in own]
        variables = {p["variable"] for p in own} & uses.keys()
        used = {c["node_ord"]: c for v in sorted(variables) for c in uses[v].of(min(lines), max(lines))}
        around = {s["node_ord"]: s for s in map(innermost.get, lines) if s}
        segments.append({
            "places": own,
            "calls": [{**used[k], "source": used[k]["number"]} for k in sorted(used)],
            "scopes": [{**around[k], "source": sources.number(around[k]["source"])} for k in sorted(around)],
        })
    segments.reverse()
    return {"parse_error": facts["parse_error"], "sources": list(sources.numbers), "segments": segments}


def _facts_udf(schema: T.StructType, facts_of):
    @F.arrow_udf(schema)
    def facts(texts: pa.Array) -> pa.Array:
        from pyspark.sql.pandas.types import to_arrow_type

        rows = [None if t is None else facts_of(t) for t in texts.to_pylist()]
        return pa.array(rows, type=to_arrow_type(schema))

    return facts


def _holds_run(value: str) -> bool:
    return bool(re.search(_RUN, value))


def _holds_any(value: str) -> bool:
    return len(value) >= _LEAST


def python_facts(content):
    """Facts column for Python sources; null in, null out.

    Literals without a long enough run of token characters are left out: none
    of the catalogue's values can lie inside them.
    """
    return _facts_udf(FACTS, lambda text: file_facts(text, _holds_run))(content)


def segmented_facts(content, chars: int | None):
    """Facts column by segment of ``chars`` characters; without ``chars`` each literal is whole, in the only one.

    A file that doesn't parse has its error and empty segments.
    """

    def facts_of(text: str) -> dict:
        facts = file_facts(text, _holds_any if chars is None else _holds_run)
        if chars is None:
            # Any candidate may ask, on any line that the literal has.
            return segmented_whole(facts)
        return segmented(facts, placed_literals(text, facts["literals"]), segment_ends(text, chars))

    return _facts_udf(SEGMENTED, facts_of)(content)


def segmented_whole(facts: dict) -> dict:
    """All facts as those of one segment."""
    sources = _Sources()
    numbered = lambda rows: [{**r, "source": sources.number(r["source"])} for r in rows]
    segment = {"places": facts["literals"], "calls": numbered(facts["calls"]), "scopes": numbered(facts["scopes"])}
    return {"parse_error": facts["parse_error"], "sources": list(sources.numbers), "segments": [segment]}


# The function travels to the executors whole, so they need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
