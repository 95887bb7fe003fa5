"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of words in insult, threat and learned lexicons; how near
second-person words and learned words stand; shares of capitals, all-capital words, punctuation, symbols, digits and
obfuscated words (letters with digits or signs among them, stretched letters). The
learned lexicon are words whose smoothed log odds in toxic training texts are
high; the trees are boosted on the logistic loss over quantile bins; an isotonic regression of
cross-fitted margins maps margins to probabilities.

The model is fitted in the driver on at most ``SAMPLE`` labelled rows of the training
folds (those with the smallest hashes of their ids); scoring reads every whole text and is one Arrow
pass without a shuffle. Labels, language, source and ids are no inputs of a score.

Null and empty texts have all features zero and get the score of such a text. Rows
without a label train nothing. A null doc_id counts as held out. Repeated rows are scored
alike. Other columns are ignored. An empty table gives an empty result; without labels of both kinds all scores are the
share of toxic labels, or 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on, at most.
SAMPLE = 6000
#: Parts of the sample for cross-fitting.
FOLDS = 5

# Word lists of the hand-made lexicons.
INSULTS = frozenset(
    "idiot idiots stupid moron morons scum trash loser losers worthless pathetic disgusting clown dumb fool garbage ugly vermin filth freak coward parasite imbecile "
    "dumm idioten arschloch abschaum versager wertlos erbärmlich widerlich müll "
    "idiote stupide ordure minable pathétique dégoûtant abruti crétin "
    "idiota estúpido basura perdedor patético asqueroso imbécil inútil".split()
)
THREATS = frozenset("kill die hurt destroy hate attack burn beat töten stirb hasse tuer meurs hais matar muere odio".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti tus usted vosotros".split())

_WORD = re.compile(r"\w+(?:['’]\w+)*")
_ODD = re.compile(r"[^\W\d_][0-9@$*!#]{1,3}[^\W\d_]|([^\W\d_])\1\1")
_LEET = str.maketrans("013457@$!", "oieastasi")


@dataclass
class Lexicon:
    """Words with their log odds in toxic texts."""

    odds: dict[str, float] = field(default_factory=dict)

    @classmethod
    def learn(cls, texts: list[list[str]], toxic: np.ndarray, least: int = 3, most: int = 400) -> Lexicon:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for words, t in zip(texts, toxic.tolist(), strict=True):
            seen[int(t)].update(set(words))
        n0, n1 = max(1, int((toxic == 0).sum())), max(1, int((toxic == 1).sum()))
        odds = {w: math.log((c + 0.1) / (n1 + 0.2)) - math.log((seen[0][w] + 0.1) / (n0 + 0.2)) for w, c in seen[1].items() if c >= least}
        best = sorted(((v, w) for w, v in odds.items() if v > 1.5), reverse=True)[:most]
        return cls({w: v for v, w in best})


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


FEATURES = (
    "insults", "threats", "learned", "learned_top", "insult_rate", "learned_rate", "second_person", "near_insult",
    "near_learned", "capitals", "capital_words", "punctuation", "exclamations", "symbols", "digits", "odd_words", "deobfuscated", "log_words", "repeats",
)


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    text = text or ""
    words = tokens(text)
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    odds = lexicon.odds
    insults = [i for i, w in enumerate(words) if w in INSULTS]
    threats = sum(w in THREATS for w in words)
    learned = [i for i, w in enumerate(words) if w in odds]
    values = [odds[words[i]] for i in learned]
    second = [i for i, w in enumerate(words) if w in SECOND_PERSON]

    def nearness(places: list[int]) -> float:
        if not places or not second:
            return 0.0
        at = np.searchsorted(second, places)
        s = np.array([-(10**9), *second, 10**9])
        gap = np.minimum(np.abs(s[at + 1] - places), np.abs(np.array(places) - s[at]))
        return float(np.sum(1.0 / np.maximum(1, gap)))

    chars = len(text)
    letters = sum(map(len, words))
    capitals = len(text) - len(_UPPER.sub("", text))
    odd = [c for c in text.split() if _ODD.search(c)] if _ODD.search(text) else []
    plain = sum(w in INSULTS or w in odds for x in odd for w in tokens(re.sub(r"(\w)\1\1+", r"\1", x.lower().translate(_LEET))))
    return [
        float(len(insults)), float(threats), float(sum(values)), max(values, default=0.0), 100 * len(insults) / n, 100 * len(learned) / n, 100 * len(second) / n, nearness(insults),
        nearness(learned), capitals / letters, sum(1 for w in _CAPITALS.findall(text)) / n, len(_MARKS.findall(text)) / chars, text.count("!") / n, len(_SIGNS.findall(text)) / chars,
        len(_DIGITS.findall(text)) / chars, len(odd) / n, float(plain), math.log1p(n), 1 - len(set(words)) / n,
    ]


_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]+")
_CAPITALS = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{2,}\b")
_MARKS = re.compile(r"[.,;:!?…\"'()-]")
_SIGNS = re.compile(r"[#*$%&|<>@~^]")
_DIGITS = re.compile(r"\d")


@dataclass
class Tree:
    """A depth-limited regression tree in arrays; leaves have feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return self.value[at]
            rows = np.flatnonzero(inner)
            at[rows] = self.left[at[rows]] + (x[rows, f[rows]] > self.cut[at[rows]])


def _grow(bins: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, least: float, ridge: float) -> Tree:
    feature, cut, left, value = [-1], [0.0], [0], [0.0]
    todo = [(0, np.arange(len(grad)), 0)]
    while todo:
        node, rows, level = todo.pop()
        g, h = grad[rows].sum(), hess[rows].sum()
        value[node] = float(-g / (h + ridge))
        if level == depth or len(rows) < 2:
            continue
        best, pick = 1e-6, None
        for f in range(bins.shape[1]):
            m = len(edges[f])
            if not m:
                continue
            b = bins[rows, f]
            gs, hs = np.cumsum(np.bincount(b, grad[rows], m + 1))[:-1], np.cumsum(np.bincount(b, hess[rows], m + 1))[:-1]
            ok = (hs >= least) & (h - hs >= least)
            gain = np.where(ok, gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge), 0)
            k = int(gain.argmax())
            if gain[k] > best:
                best, pick = gain[k], (f, k)
        if pick is None:
            continue
        f, k = pick
        goes = bins[rows, f] > k
        feature[node], cut[node], left[node] = f, float(edges[f][k]), len(feature)
        for _ in range(2):
            feature.append(-1), cut.append(0.0), left.append(0), value.append(0.0)
        todo += [(left[node], rows[~goes], level + 1), (left[node] + 1, rows[goes], level + 1)]
    return Tree(np.array(feature), np.array(cut), np.array(left), np.array(value))


@dataclass
class Boosted:
    start: float = 0.0
    rate: float = 0.1
    trees: list[Tree] = field(default_factory=list)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 120, depth: int = 3, rate: float = 0.1, bins: int = 64) -> Boosted:
        p = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
        model = cls(math.log(p / (1 - p)), rate)
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
        edges = [e[e < x[:, f].max()] for f, e in enumerate(edges)]
        coded = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
        margin = np.full(len(y), model.start)
        for _ in range(rounds):
            p1 = 1 / (1 + np.exp(-margin))
            tree = _grow(coded, edges, p1 - y, p1 * (1 - p1), depth, 2.0, 1.0)
            model.trees.append(tree)
            margin += rate * tree.predict(x)
        return model

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.start + self.rate * sum((t.predict(x) for t in self.trees), np.zeros(len(x)))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots of a non-decreasing step map, one prior row of each label added for smoothness."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, first score, last score
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1.0, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    knots, levels = [], []
    for total, weight, a, b in blocks:
        level = (total + 0.5 * y.mean()) / (weight + 0.5)
        knots += [a, b]
        levels += [level, level]
    return np.array(knots), np.maximum.accumulate(np.array(levels))


@dataclass
class Model:
    lexicon: Lexicon = field(default_factory=Lexicon)
    boosted: Boosted | None = None
    knots: np.ndarray = field(default_factory=lambda: np.array([0.0]))
    levels: np.ndarray = field(default_factory=lambda: np.array([0.0]))

    @classmethod
    def fit(cls, texts: list[str], y: np.ndarray) -> Model:
        if not len(y) or y.min() == y.max():
            return cls(levels=np.array([float(y.mean()) if len(y) else 0.0]))
        words = [tokens(t or "") for t in texts]
        fold = np.arange(len(y)) % FOLDS
        # cross-fitting: a text's features never see a lexicon that its own label taught
        x = np.zeros((len(y), len(FEATURES)))
        for k in range(FOLDS):
            part = fold != k
            lexicon = Lexicon.learn([w for w, p in zip(words, part, strict=True) if p], y[part])
            for i in np.flatnonzero(~part):
                x[i] = features(texts[i], lexicon)
        margin = np.zeros(len(y))
        for k in range(FOLDS):
            part = fold != k
            if y[part].min() < y[part].max():
                margin[~part] = Boosted.fit(x[part], y[part]).margin(x[~part])
        knots, levels = isotonic(margin, y)
        return cls(Lexicon.learn(words, y), Boosted.fit(x, y), knots, levels)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.boosted is None:
            return np.full(len(texts), self.levels[0])
        x = np.array([features(t, self.lexicon) for t in texts]).reshape(-1, len(FEATURES))
        return np.clip(np.interp(self.boosted.margin(x), self.knots, self.levels), 0, 1)


def held_out():
    """crc32 of doc_id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the labelled rows of ``docs`` that are not held out: the ``sample`` of them with the smallest hashes."""
    train = labels.where(~held_out() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    train = train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most ``sample`` rows of 12 bytes
    rows = docs.select("doc_id", "text").join(F.broadcast(train), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")).orderBy("doc_id").collect()
    return Model.fit([r.text or "" for r in rows], np.array([float(r.toxic != 0) for r in rows]))


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (all columns) with held_out, score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: some hundred words and trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    plain = docs.drop("held_out", "score", "predicted").withColumn("held_out", held_out())
    kinds = [(f.name, f.dataType.simpleString()) for f in plain.schema] + [("score", "double"), ("predicted", "int")]
    return plain.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in kinds))
