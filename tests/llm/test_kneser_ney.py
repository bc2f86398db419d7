"""The class models against a plain Kneser-Ney on a small table."""

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from keysieve.llm import toxicity as T


def words_of(text):
    return re.findall(r"[a-z\x80-\U0010ffff]+", (text or "").lower())


def cut(values):
    ones, twos = sum(v == 1 for v in values), sum(v == 2 for v in values)
    return min(max(ones / (ones + 2 * twos), 0.1), 0.95) if ones else 0.5


class Plain:
    def __init__(self, rows):
        pair = [Counter(), Counter()]
        for text, toxic in rows:
            own = words_of(text)
            pair[toxic].update(zip(["", *own], own))
        every = set(pair[0]) | set(pair[1])
        word, stem = [Counter(), Counter()], [Counter(), Counter()]
        self.contexts, roots = Counter(), Counter()
        after, kinds = [Counter(), Counter()], [Counter(), Counter()]
        for prior, w in every:
            self.contexts[w] += 1
            roots[self.stem(w)] += 1
            for c in (0, 1):
                n = pair[c][prior, w]
                word[c][w] += n
                stem[c][self.stem(w)] += n
                after[c][prior] += n
                kinds[c][prior] += n > 0
        total = sum(self.contexts.values())
        self.n = [max(1, sum(word[c].values())) for c in (0, 1)]
        self.left, self.root_left, self.backed, self.p = [], [], [{}, {}], [{}, {}]
        for c in (0, 1):
            word_cut, stem_cut = cut(word[c].values()), cut(stem[c].values())
            self.left.append(word_cut * max(1, sum(v > 0 for v in word[c].values())) / self.n[c])
            self.root_left.append(stem_cut * max(1, sum(v > 0 for v in stem[c].values())) / self.n[c])
            for s in roots:
                shared = (roots[s] + 0.5) / (total + 0.5 * len(roots) + 1)
                self.backed[c][s] = max(stem[c][s] - stem_cut, 0) / self.n[c] + self.root_left[c] * shared
            for w in self.contexts:
                shared = (roots[self.stem(w)] + 0.5) / (total + 0.5 * len(roots) + 1)
                ending = min(1, (self.contexts[w] + 0.5) / (total + 0.5 * len(self.contexts) + 1) / shared)
                self.p[c][w] = max(word[c][w] - word_cut, 0) / self.n[c] + self.left[c] * self.backed[c][self.stem(w)] * ending
        pair_cut = [cut(pair[c].values()) for c in (0, 1)]
        self.after_left = [{q: pair_cut[c] * kinds[c][q] / after[c][q] if after[c][q] else 1.0 for q in after[0] | after[1] | Counter(p for p, _ in every)} for c in (0, 1)]
        self.pairs = {
            (q, w): [max(pair[c][q, w] - pair_cut[c], 0) / max(1, after[c][q]) + self.after_left[c][q] * self.p[c][w] for c in (0, 1)] for q, w in every
        }

    @staticmethod
    def stem(word):
        return word.encode()[:4]

    def gain(self, w):
        if w in self.contexts:
            return math.log(self.p[1][w] / self.p[0][w])
        s = self.stem(w)
        if s in self.backed[0]:
            return math.log(self.left[1] * self.backed[1][s] / (self.left[0] * self.backed[0][s]))
        return math.log(self.left[1] * self.root_left[1] / (self.left[0] * self.root_left[0]))

    def signs(self, text):
        own = words_of(text)
        size = max(1, len(own))
        gains = [self.gain(w) for w in own]
        seen, after = [], 0.0
        for q, w, g in zip(["", *own], own, gains):
            if (q, w) in self.pairs:
                seen.append(math.log(self.pairs[q, w][1] / self.pairs[q, w][0]))
                after += seen[-1]
            else:
                after += g + (math.log(self.after_left[1][q] / self.after_left[0][q]) if q in self.after_left[0] else 0.0)
        top = lambda values: (sorted(values, reverse=True) + [0.0] * 4)[:4]
        return [sum(gains) / size, *top(gains), after / size, *top(seen)]


def test_signs_equal_a_plain_model(spark):
    rng = np.random.default_rng(9)
    names = ["thing", "thinker", "thin", "vile", "vileness", "drop", "dead", "über", "überall", "a", "bc"]
    rows = [(" ".join(rng.choice(names[: 9 if i % 3 else 11], rng.integers(0, 12))), int(i % 3 == 0)) for i in range(60)] + [("", 0), ("Drop dead!", 1)]
    table = spark.createDataFrame(rows, "text string, toxic int").repartition(3)
    model, plain = T.fit_models(table), Plain(rows)
    asked = [*{t for t, _ in rows}, "dead drop thing", "thinnest new words", "vile drop vilest dead dead dead dead dead dead", "zzzz", "THIN-thin"]
    texts = spark.createDataFrame([(t,) for t in asked], "text string")
    got = {r.text: r.signs for r in texts.withColumn("key", F.xxhash64("text")).join(model.signs(texts), "key").collect()}
    assert got.keys() == set(asked)
    for text, signs in got.items():
        np.testing.assert_allclose(signs, plain.signs(text), atol=1e-9, err_msg=text)
