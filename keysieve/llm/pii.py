"""Personal data in whole texts: fixed patterns, and more spans by candidate boosting.

One pass over the texts finds the spans of the fixed patterns and, by looser generators,
all candidates: overlapping stretches that look like an e-mail address, an IP address, a
card or a telephone number in some spelling. A candidate is described by its format
(digits, groups, separators, check digit, ends of a domain) and its context (what stands
beside it). Boosted trees learn which candidates are like the patterns' spans: these are
the positive labels, candidates that touch none of them the negative ones, and candidates
that overlap a span of their kind without being it stay unlabelled. A threshold for each
kind is set on rows the trees have not seen, where the precision reaches ``PRECISION``.

The patterns' spans always stay; the trees add spans such as an address with accented
letters, of which the pattern sees only a part. Nothing but text decides.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keysieve.llm import boosting
from keysieve.llm import common as K

#: One in this many labelled candidates, by hash, sets the thresholds; the trees learn from all others.
HELD_BACK = 4
#: Share of right spans that a threshold must reach on rows held back.
PRECISION = 0.99

# Kinds in their order and their patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Looser spellings that only propose candidates.
_DOTTED = re.compile(r"(?<![0-9])[0-9]{1,4}(?:(?:\[\.\]|\(\.\)| \. |[.,_:])[0-9]{1,4}){2,7}(?![0-9])")
_NUMBER = re.compile(r"(?<![0-9])[+(]{0,2}[0-9](?:[ .()/    ‐-–_-]{0,2}[0-9]){6,}")
_AT_SIGN = re.compile(r"@|[\[({] ?at ?[\])}]", re.I)
_LATER_LABEL = re.compile(r"(?:\.| ?[\[({] ?dot ?[\])}] ?)([^\W_]+(?:-+[^\W_]+)*)", re.I)
_ANY_DIGIT = re.compile("[0-9]")
_GROUP = re.compile(r"[^\W_]+")

FEATURES = 24
_SPANS = "kinds array<int>, starts array<int>, ends array<int>, marks array<int>, features binary"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """What the e-mail pattern matches, in linear time: from each at-sign outwards."""
    at, last = text.find("@"), 0
    while at >= 0:
        low = at
        while low > last and text[low - 1] in _LOCAL:
            low -= 1
        domain = _DOMAIN.match(text, at + 1) if low < at else None
        if domain:
            last = domain.end()
            yield low, last
        at = text.find("@", max(at + 1, last))


def luhn(digits: str) -> bool:
    """Whether the digits' check sum is a multiple of ten."""
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(2 * v - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns' matches that pass their kind's test."""
    found = [(EMAIL, a, b) for a, b in _emails(text)]
    if not _ANY_DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((IP, *m.span()))
    for m in _CARD.finditer(text):
        own = _digits(m[0])
        if 14 <= len(own) <= 19 and luhn(own):
            found.append((CARD, *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(_digits(m[0])) <= 15:
            found.append((PHONE, *m.span()))
    return found


def _wide_emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses in any letters and with a spelt-out at-sign or dot."""
    last = 0
    for sign in _AT_SIGN.finditer(text):
        low, high = sign.start(), sign.end()
        if sign[0] != "@":
            low -= text[low - 1 : low] == " "
            high += text[high : high + 1] == " "
        begin = low
        while begin > last and (text[begin - 1].isalnum() or text[begin - 1] in "._%+-"):
            begin -= 1
        end = high
        while end < len(text) and (text[end].isalnum() or text[end] == "-"):
            end += 1
        if begin == low or end == high:
            continue
        while label := _LATER_LABEL.match(text, end):
            end = label.end()
        yield begin, end
        last = end


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """All proposed (kind, start, end), overlapping ones and the patterns' own ``base`` spans included."""
    found = set(base)
    found.update((EMAIL, a, b) for a, b in _wide_emails(text))
    if _ANY_DIGIT.search(text):
        found.update((IP, *m.span()) for m in _DOTTED.finditer(text))
        found.update((IP, *m.span()) for m in _IP.finditer(text))
        found.update((CARD, *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() > 11)
        found.update((PHONE, *m.span()) for m in _PHONE.finditer(text))
        for m in _NUMBER.finditer(text):
            many = len(_digits(m[0]))
            found.update((kind, *m.span()) for kind, fits in ((CARD, 12 <= many <= 19), (PHONE, 7 <= many <= 15)) if fits)
    return sorted(found, key=lambda s: (s[1], s[0], s[2]))


def _side(char: str) -> int:
    """Class of a neighbouring character: none, white space, letter, digit or other."""
    return 0 if not char else 1 if char.isspace() else 2 if char.isalpha() else 3 if char.isdigit() else 4


def described(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format and context of a candidate; long ones count up to a bound."""
    own = text[start:end]
    digits = _digits(own[:64])
    groups = [len(g) for g in _GROUP.findall(own[:400])] or [0]
    numbers = [min(int(g), 99_999) for g in re.findall("[0-9]{1,9}", own[:64])] or [0]
    separators = {c for c in own[:400] if not c.isalnum()}
    domain = own[:400].rpartition("@")[2] if "@" in own else ""
    left, right = text[max(0, start - 24) : start], text[end : end + 24]
    return [
        kind, len(digits), min(sum(c.isalpha() for c in own[:400]), 200), min(len(own), 400),
        min(len(groups), 50), min(max(groups), 99), min(min(groups), 99), min(groups[0], 99), min(groups[-1], 99),
        max(numbers), float(12 <= len(digits) <= 19 and luhn(digits)), int(digits[0]) if digits else -1,
        own[:1] == "+", "(" in own, len(separators), "@" in own, domain.count("."), min(len(domain.rpartition(".")[2]), 40),
        _side(left[-1:]), _side(right[:1]), sum(c.isdigit() for c in left), sum(c.isdigit() for c in right),
        sum(c.isalpha() for c in left), any(c in "=\"'" for c in left[-12:]),
    ]


def _marks(spans: list[tuple[int, int, int]], base: set[tuple[int, int, int]]) -> list[int]:
    """Label of each candidate: 1 a pattern's own span, -1 one that overlaps a span of its kind, else 0."""
    out = []
    own = {kind: sorted((a, b) for k, a, b in base if k == kind) for kind in range(len(KINDS))}
    at = dict.fromkeys(own, 0)
    for kind, start, end in spans:
        there = own[kind]
        # Spans of one kind don't overlap and candidates come by start.
        while at[kind] < len(there) and there[at[kind]][1] <= start:
            at[kind] += 1
        near = at[kind] < len(there) and there[at[kind]][0] < end
        out.append(1 if (kind, start, end) in base else -1 if near else 0)
    return out


def _looked_at(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = []
        for text in texts:
            text = text if isinstance(text, str) else ""
            base = base_spans(text)
            spans = candidates(text, base)
            features = np.array([described(text, *s) for s in spans], np.float32)
            rows.append((
                [s[0] for s in spans], [s[1] for s in spans], [s[2] for s in spans], _marks(spans, set(base)), features.tobytes(),
            ))
        yield pd.DataFrame(rows, columns=["kinds", "starts", "ends", "marks", "features"])


class Model:
    """Trees and a threshold for each kind."""

    def __init__(self, trees: boosting.Trees, thresholds: np.ndarray):
        self.trees, self.thresholds = trees, thresholds

    def chosen(self, kinds, starts, ends, marks, features: bytes) -> tuple[list[tuple], list[float]]:
        """Spans of a text in order, the patterns' own and added ones, and their scores."""
        if len(kinds) == 0:
            return [], []
        x = np.frombuffer(features, np.float32).reshape(-1, FEATURES).astype(float)
        scores = self.trees.scores(x)
        base = [i for i in range(len(kinds)) if marks[i] == 1]
        picked = list(base)
        inside = _Inside([(starts[i], ends[i]) for i in base])
        taken: dict[int, list[tuple[int, int]]] = {}
        order = sorted(np.flatnonzero((np.asarray(marks) != 1) & (scores >= self.thresholds[np.asarray(kinds)])).tolist(),
                       key=lambda i: (-scores[i], starts[i] - ends[i], starts[i], kinds[i]))
        for i in order:
            own = taken.setdefault(kinds[i], [])
            if not inside.has(starts[i], ends[i]) and all(ends[i] <= a or b <= starts[i] for a, b in own):
                own.append((starts[i], ends[i]))
                picked.append(i)
        picked.sort(key=lambda i: (starts[i], kinds[i], ends[i]))
        return [(KINDS[kinds[i]], int(starts[i]), int(ends[i]), bool(marks[i] == 1)) for i in picked], [float(scores[i]) for i in picked]


class _Inside:
    """Whether a span lies within one of the given ones."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts = np.array([a for a, _ in spans], np.int64)
        self.reach = np.maximum.accumulate(np.array([b for _, b in spans], np.int64)) if spans else self.starts

    def has(self, start: int, end: int) -> bool:
        at = int(np.searchsorted(self.starts, start, "right")) - 1
        return at >= 0 and bool(self.reach[at] >= end)


def train(looked: DataFrame) -> Model:
    """Trees and thresholds from every labelled candidate of all documents.

    Candidates whose hash is divisible by ``HELD_BACK`` set the thresholds, the others
    teach the trees. A kind whose held-back rows hold no pattern span gets none added.
    """
    size = 4 * FEATURES
    rows = looked.select(F.xxhash64("features", "starts", "doc_id").alias("h"), "features", F.posexplode(F.arrays_zip("kinds", "marks")).alias("i", "s"))
    # What looks the same counts as one row with a weight.
    rows = K.settled(
        rows.where("s.marks >= 0").groupBy(
            (F.pmod(F.xxhash64("h", "i"), F.lit(HELD_BACK)) == 0).alias("back"), F.col("s.kinds").alias("kind"), F.col("s.marks").alias("y"),
            F.substring("features", F.col("i") * size + 1, F.lit(size)).alias("x"),
        ).agg(F.count(F.lit(1)).alias("n"))
    )
    trees = boosting.fit_table(rows.where("NOT back").select("x", "y", "n"), FEATURES)
    return Model(trees, _thresholds(rows.where("back"), trees))


def _thresholds(rows: DataFrame, trees: boosting.Trees) -> np.ndarray:
    """Lowest score of each kind at which the spans above it reach ``PRECISION``; 2 where there is none."""
    shared = rows.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def margin(x: pd.Series) -> pd.Series:
        return pd.Series(shared.value.margins(np.frombuffer(b"".join(x), np.float32).reshape(-1, FEATURES).astype(float)))

    # A threshold takes all rows of its score. Running sums come from the order of whole ranges and the order inside each.
    scored = rows.groupBy("kind", (-margin("x")).alias("below")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("right"))
    ranges = K.settled(scored.repartitionByRange("kind", "below").withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ranges.groupBy("kind", "part").agg(F.sum("n").alias("n"), F.sum("right").alias("right")).select(
        "kind", "part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_ahead") for c in ("n", "right"))
    )
    within = Window.partitionBy("kind", "part").orderBy("below").rowsBetween(Window.unboundedPreceding, 0)
    running = ranges.join(F.broadcast(ahead), ["kind", "part"]).select(
        "kind", "below", *((F.sum(c).over(within) + F.col(f"{c}_ahead")).alias(c) for c in ("n", "right"))
    )
    last = running.where((F.col("right") > 0) & (F.col("right") / F.col("n") >= PRECISION)).groupBy("kind").agg(F.max("below").alias("last"))
    found = ranges.join(F.broadcast(last), "kind").where("below > last").groupBy("kind").agg(F.min("below").alias("next"))
    thresholds = np.full(len(KINDS), 2.0)
    for row in last.join(found, "kind", "left").collect():
        # Half way to the next lower score, in log odds.
        ends = [-x for x in (row["last"], row["next"]) if x is not None]
        thresholds[row["kind"]] = max(0.5, float(K.sigmoid(np.mean(ends))))
    return thresholds


def looked_at(documents: DataFrame) -> DataFrame:
    """(doc_id and the document's candidates): one row per row, stored. Texts are read once, here."""
    looked = F.pandas_udf(_looked_at, _SPANS)
    with K.small_batches(documents.sparkSession):
        return K.settled(documents.select("doc_id", looked(F.col("text")).alias("_s")).select("doc_id", "_s.*"))


def detect(documents: DataFrame) -> DataFrame:
    """(doc_id, spans) for each row: spans are (kind, start, end, base, score), by start, kind and end.

    Places count code points, ends are exclusive. Null and empty texts have no spans; each
    row stands for itself, repeated ids too; further columns are ignored. Spans of one kind
    overlap only where an added span holds or meets one of the patterns' spans; a span
    inside a pattern's span is not added. No documents give no rows.
    """
    looked = looked_at(documents)
    model = looked.sparkSession.sparkContext.broadcast(train(looked))

    def chosen(batches: Iterator[tuple]) -> Iterator[pd.Series]:
        for columns in batches:
            rows = []
            for row in zip(*columns):
                spans, scores = model.value.chosen(*row)
                rows.append([{"kind": k, "start": a, "end": b, "base": own, "score": s} for (k, a, b, own), s in zip(spans, scores)])
            yield pd.Series(rows, dtype=object)

    # Hints tell Spark how columns come: several series at a time.
    chosen.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
    spans = F.pandas_udf(chosen, "array<struct<kind:string,start:int,end:int,base:boolean,score:double>>")
    return looked.select("doc_id", spans("kinds", "starts", "ends", "marks", "features").alias("spans"))


def digests(detected: DataFrame) -> DataFrame:
    """(doc_id, counts of each kind's pattern spans, their digest, all spans as text)."""

    def spelt(spans: Column) -> Column:
        names = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(names, ",")

    def count_of(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    counts = [count_of(kind) for kind in KINDS]
    return detected.select("doc_id", *counts, F.sha2(spelt(base), 256).alias("base_sha256"), spelt(F.col("spans")).alias("spans"))


def blanked(text: str, spans: list) -> str:
    """The text with its spans, merged where they overlap, replaced by their first kind in brackets."""
    out, last = [], 0
    merged: list[list] = []
    for s in spans:
        if merged and s["start"] < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s["end"])
        else:
            merged.append([s["start"], s["end"], s["kind"]])
    for start, end, kind in merged:
        out += [text[last:start], f"[{kind.upper()}]"]
        last = end
    return "".join(out) + text[last:]


def redacted(documents: DataFrame) -> DataFrame:
    """The documents with personal data replaced; null texts stay null, all other columns stay.

    Documents are matched by ``doc_id``, which must be unique and not null here.
    """
    found = detect(documents).where(F.size("spans") > 0)
    mark, name = K.fresh("_spans", documents), K.fresh("_found_id", documents)
    found = found.select(F.col("doc_id").alias(name), F.col("spans").alias(mark))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None or t is None else blanked(t, s) for t, s in zip(texts, spans)], dtype=object)

    held = documents.join(found, documents["doc_id"] == F.col(name), "left")
    text = F.when(F.col(mark).isNull(), F.col("text")).otherwise(cut("text", mark))
    return held.withColumn("text", text).select(*documents.columns)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
