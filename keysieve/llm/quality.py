"""Document quality from a linear-chain conditional random field over lines.

Every line of a text is a link of a chain that is either bad (0) or good (1). Its
features describe the line and its neighbours; a transition weight ties adjacent
lines. Forward-backward gives each line's marginal probability of being good, and the
marginals, weighted by line length, make the quality of the document. A logistic
curve maps that to the probability of the label.

The field is fitted on a bounded sample of labelled rows (``TRAIN_ROWS`` labels) and on
all lines of their texts; a text's label stands for its lines.
Scoring always reads every line of the whole text.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysieve.llm import common as K

FOLDS, HELD_OUT, CURVE_FOLD = 4, 2, 3
THRESHOLD = 0.7
#: Bounds of the sample that the field and the curve are fitted on, each.
TRAIN_ROWS = 2_000
#: The field learns from all lines of its texts, in chains of at most so many.
CHAIN_LINES = 64
STEPS, RATE, RIDGE = 120, 0.08, 1e-3

_BLANKS = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_LOWER = np.isin(np.arange(256), np.arange(97, 123))
_DIGIT = np.isin(np.arange(256), np.arange(48, 58))
_STOP = np.isin(np.arange(256), list(b".,;:?"))
_HIGH = np.arange(256) >= 128
_SIGN = ~(_BLANKS | _UPPER | _LOWER | _DIGIT | _STOP | _HIGH)
_SAME = bytes(range(256))
#: Own features of a line; the neighbours' copies of the first ``SHARED`` follow, then the constant.
OWN, SHARED = 13, 7
WIDTH = OWN + 2 * SHARED + 3


def _share(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(flags)])
    return (run[ends] - run[starts]) / size


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature rows, line lengths in bytes and text numbers of all lines of a block.

    Lines end at a line feed; an empty text is one empty line.
    """
    buffer, at = K.joined(texts, _SAME)
    breaks = buffer == 10
    breaks[at[1:] - 1] = True
    breaks[-1] = True
    ends = np.flatnonzero(breaks[1:]) + 1
    starts = np.concatenate([[1], ends[:-1] + 1])
    text = np.searchsorted(at, starts, "right") - 1
    length = ends - starts
    size = np.maximum(length, 1)
    hashes = K.SpanHashes(buffer)

    solid = ~_BLANKS[buffer]
    solid[0] = solid[-1] = False
    word_at, word_end = K.runs(solid)
    word = hashes.of(word_at, word_end)
    line = np.searchsorted(starts, word_at, "right") - 1
    words = np.bincount(line, minlength=len(starts))
    again = np.zeros(len(word))
    again[1:] = (word[1:] == word[:-1]) & (line[1:] == line[:-1])
    key = K.mixed(word ^ K.mixed(line.astype(np.uint64) + np.uint64(1)))
    kinds = np.bincount(line[np.unique(key, return_index=True)[1]], minlength=len(starts))
    tail = buffer[np.maximum(word_end - 1, 0)]
    some = np.maximum(words, 1)

    body = hashes.of(starts, ends)
    _, which, copies = np.unique(
        K.mixed(body ^ K.mixed(text.astype(np.uint64) + np.uint64(1))), return_inverse=True, return_counts=True
    )
    repeated = (copies[which] > 1) & (length > 0)

    upper = _share(_UPPER[buffer], starts, ends, size)
    lower = _share(_LOWER[buffer], starts, ends, size)
    own = np.column_stack([
        np.minimum(3 * _share(_SIGN[buffer], starts, ends, size), 1),
        upper / np.maximum(upper + lower, 1e-9),
        np.bincount(line, again, len(starts)) / some,
        repeated,
        1 - kinds / some,
        np.bincount(line, _SIGN[tail], len(starts)) / some,
        np.bincount(line, (word_end - word_at == 1) & _SIGN[tail], len(starts)) / some,
        _share(_DIGIT[buffer], starts, ends, size),
        _share(_HIGH[buffer], starts, ends, size),
        np.minimum(4 * _share(_STOP[buffer], starts, ends, size), 1),
        np.minimum(length / some / 20, 1),
        np.log1p(length) / 10,
        words == 0,
    ]).astype(np.float64)
    before, after = np.roll(own[:, :SHARED], 1, 0), np.roll(own[:, :SHARED], -1, 0)
    first = np.diff(text, prepend=-1) != 0
    last = np.roll(first, -1)
    before[first], after[last] = 0, 0
    return np.column_stack([own, before, after, first, last, np.ones(len(text))]), length, text


class Chains:
    """Chains laid out by position: row ``t`` of ``grid`` holds every chain's t-th line."""

    def __init__(self, text: np.ndarray, texts: int):
        size = np.bincount(text, minlength=texts)
        start = np.cumsum(size) - size
        order = np.argsort(-size, kind="stable")
        size, start = size[order], start[order]
        self.steps = [start[: np.searchsorted(-size, -t, "left")] + t for t in range(size.max(initial=0))]
        self.end = size, start

    def marginals(self, score: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Line marginals, expected transitions and the log-partition, by forward-backward."""
        n = len(score)
        ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
        expected = np.zeros((2, 2))
        for t, rows in enumerate(self.steps):
            ahead[rows] = score[rows] if t == 0 else score[rows] + _logsum(ahead[rows - 1][:, :, None] + link, 1)
        for rows in reversed(self.steps[1:]):
            behind[rows - 1] = _logsum(link + (score[rows] + behind[rows])[:, None, :], 2)
        whole = ahead + behind
        total = _logsum(whole, 1)
        for rows in self.steps[1:]:
            pair = ahead[rows - 1][:, :, None] + link + (score[rows] + behind[rows])[:, None, :]
            expected += np.exp(pair - total[rows][:, None, None]).sum(0)
        return np.exp(whole - total[:, None]), expected, float(total[self.end[1][self.end[0] > 0]].sum())


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))


def fit_field(texts: list[bytes], good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of line features (for good) and transitions, by Adam on the conditional likelihood."""
    rows, text, begins = [], [], []
    for lo, hi in K.blocks(texts):
        x, _, own = line_features(texts[lo:hi])
        size = np.bincount(own, minlength=hi - lo)
        place = np.arange(len(own)) - (np.cumsum(size) - size)[own]
        rows.append(x)
        text.append(own + lo)
        begins.append(place % CHAIN_LINES == 0)
    x, text = np.concatenate(rows), np.concatenate(text)
    # Long texts go on in another chain, so the longest chain bounds the steps of a pass.
    label, text = good[text], np.cumsum(np.concatenate(begins)) - 1
    count = int(text[-1]) + 1
    chains = Chains(text, count)
    weights, link = np.zeros(WIDTH), np.zeros((2, 2))
    same = text[1:] == text[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[:-1][same], label[1:][same]), 1)
    first, second = [0.0, 0.0], [0.0, 0.0]
    for step in range(1, STEPS + 1):
        score = np.column_stack([np.zeros(len(x)), x @ weights])
        marginal, expected, _ = chains.marginals(score, link)
        slopes = [
            x.T @ (label - marginal[:, 1]) / count - RIDGE * weights,
            (seen - expected) / count - RIDGE * link,
        ]
        for i, slope in enumerate(slopes):
            first[i] = 0.9 * first[i] + 0.1 * slope
            second[i] = 0.99 * second[i] + 0.01 * slope**2
            move = RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
            if i == 0:
                weights = weights + move
            else:
                link = link + move
    return weights, link


def goodness(texts: list[bytes], weights: np.ndarray, link: np.ndarray) -> np.ndarray:
    """Length-weighted mean marginal of good lines, as log-odds, for each text."""
    out = np.zeros(len(texts))
    for lo, hi in K.blocks(texts):
        x, length, text = line_features(texts[lo:hi])
        marginal, _, _ = Chains(text, hi - lo).marginals(np.column_stack([np.zeros(len(x)), x @ weights]), link)
        size = np.maximum(length, 1)
        mean = np.bincount(text, marginal[:, 1] * size, hi - lo) / np.bincount(text, size, hi - lo)
        mean = np.clip(mean, 1e-9, 1 - 1e-9)
        out[lo:hi] = np.log(mean / (1 - mean))
    return out


class Scorer:
    """A fitted field and its curve; ``score_column`` gives the probability of the label 1."""

    def __init__(self, field: tuple[np.ndarray, np.ndarray] | None, curve: np.ndarray, flat: float):
        self.field, self.curve, self.flat = field, curve, flat

    def score_column(self, text):
        field, curve, flat = self.field, self.curve, self.flat

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                if field is None:
                    yield pd.Series(np.full(len(batch), flat))
                else:
                    yield pd.Series(K.sigmoid(curve[0] + curve[1] * goodness(K.encoded(batch), *field)))

        return score(text)


def fold(doc_id):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS, F.lit(HELD_OUT))


def fit_scorer(documents: DataFrame, labels: DataFrame) -> Scorer:
    """Fit on labelled documents outside the held-out fold: one fold for the curve, two for the field.

    Labels that are null or on null ids teach nothing. Without both labels the score
    is the same number for every text, the share of good ones; without any label it is one.
    """
    documents = K.in_batches(documents)
    marks = labels.select("doc_id", "quality").where("quality IN (0, 1)").dropDuplicates(["doc_id", "quality"])
    marks = marks.withColumn("_fold", fold("doc_id")).where(F.col("_fold") != HELD_OUT)
    # Only labels that a document has may use up a sample; ids meet ids, no text is shuffled.
    marks = K.settled(marks.join(documents.select("doc_id"), "doc_id", "left_semi"))

    def sample(rows: DataFrame) -> tuple[list[bytes], np.ndarray]:
        # At most TRAIN_ROWS labels go to the texts, so no text is shuffled.
        picked = rows.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "quality").limit(TRAIN_ROWS)
        known = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
        got = known.orderBy("doc_id", "text").select("text", F.col("quality").cast("long").alias("quality")).limit(2 * TRAIN_ROWS).toArrow()
        return K.encoded(got["text"].to_pylist()), got["quality"].to_numpy().astype(np.int64)

    texts, good = sample(marks.where(F.col("_fold") != CURVE_FOLD))
    flat = float((good.sum() + 1) / (len(good) + 1))
    if len(set(good)) < 2:
        return Scorer(None, np.zeros(2), flat)
    field = fit_field(texts, good)
    more, marks = sample(marks.where(F.col("_fold") == CURVE_FOLD))
    if len(set(marks)) < 2:
        more, marks = texts, good
    return Scorer(field, K.logistic_fit(goodness(more, *field)[:, None], marks), flat)


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row of ``documents`` with ``held_out``, ``score`` and ``predicted``.

    Null and empty texts are one empty line. Columns of these names are replaced.
    """
    scorer = fit_scorer(documents, labels)
    return (
        documents.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False)))
        .withColumn("score", scorer.score_column("text"))
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
    )


def kept(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` predicted to be good, unchanged."""
    return documents.where(fit_scorer(documents, labels).score_column("text") >= THRESHOLD)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
