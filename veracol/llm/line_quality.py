"""Quality by lines: a linear-chain conditional random field labels every line of a text good or bad.

A line's unit sees its own features and those of the lines before and after it: rates of byte classes, of repeated
words and of repeated word pairs. Labels are of documents, so those of their lines are latent: lines' own features are
first fitted so that good documents have no bad line and bad ones some, which tells the bad lines; the field is then
fitted to these labels by its likelihood. Of a text that is scored, forward-backward gives each line's chance of being bad; these, weighted by the lines' lengths,
are averaged, and a logistic curve over the average, fitted on other documents than the field, gives the score.

Training reads a bounded sample of labelled rows (TRAIN_TEXTS of each label, texts up to TRAIN_CHARS characters and
TRAIN_LINES lines); every text is scored whole. Labels, language, source and doc_id are no inputs of a score.

Defined cases: blank lines are no units; null, empty and blank text is one unit without features; repeated rows get
the same score; without labelled rows of both kinds every score is the share of good labels (1 without any label);
labels other than 0 and 1 are left out; an empty table gives an empty result; only doc_id and text, and doc_id and
quality of the labels, are read, so extra columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the training sample: texts of each label, and the characters and lines up to which a text is taken.
TRAIN_TEXTS, TRAIN_CHARS, TRAIN_LINES = 1_500, 20_000, 200
#: A score from here on predicts label 1.
THRESHOLD = 0.3
#: Climbing: steps that look for the bad lines, steps of the field, step size, pull to zero.
SEARCH, STEPS, RATE, RIDGE = 200, 200, 0.25, 1e-6
#: Least share of bad or good text that the curve tells from none.
FLOOR = 0.005

#: Byte classes: upper case, lower case and other scripts, digits, sentence marks, exclamations, bars and brackets, other symbols.
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)), b"0123456789", b".,;:'\"-()", b"!?", b"|[]{}<>\\/_", b"#$%&*+=@^~`"]
_CLASS = np.full(256, len(_CLASSES), np.uint8)
for _i, _members in enumerate(_CLASSES):
    _CLASS[list(_members)] = _i
#: Features of a line by itself, and of a unit: its line's, those of the lines before and after, whether there are such, and 1.
OWN = 2 * len(_CLASSES) + 7
WIDTH = 3 * OWN + 3


def lines_of(text: str) -> list[str]:
    """Lines with more than white space; one empty line for a text without any."""
    return [x for x in text.split("\n") if x and not x.isspace()] or [""]


def own_features(lines: list[str]) -> np.ndarray:
    """One row of features a line."""
    data = [x.encode("utf-8", "replace") + b"\n" for x in lines]
    sizes = np.array([len(x) for x in data])
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    kinds = _CLASS[np.frombuffer(b"".join(data), np.uint8)]
    out = np.zeros((len(lines), OWN), np.float32)
    for c in range(len(_CLASSES)):
        rate = np.add.reduceat((kinds == c).astype(np.int64), starts) / np.maximum(sizes - 1, 1)
        # A rate by itself, and how far it is past a small one.
        out[:, 2 * c], out[:, 2 * c + 1] = rate, np.minimum(1.0, 8 * rate)
    at, seen = 2 * len(_CLASSES), set()
    for i, x in enumerate(data):
        words = x.split()
        n = len(words)
        if n > 1:
            again = sum(map(eq, words[1:], words)) / (n - 1)
            pairs = 1 - len(set(zip(words, words[1:]))) / (n - 1)
            out[i, at : at + 4] = again, min(1.0, 4 * again), pairs, 1 - len(set(words)) / n
        out[i, at + 4 : at + 7] = n < 4, min(1.0, n / 200), x in seen
        seen.add(x)
    return out


def unit_features(lines: list[str]) -> np.ndarray:
    own = own_features(lines)
    out = np.zeros((len(lines), WIDTH), np.float32)
    out[:, :OWN] = own
    out[1:, OWN : 2 * OWN], out[:-1, 2 * OWN : 3 * OWN] = own[:-1], own[1:]
    out[0, -3], out[-1, -2], out[:, -1] = 1, 1, 1
    return out


@dataclass(frozen=True)
class Field:
    """Weights of a unit's features for `bad`, log potentials of neighbouring labels (good, bad), and the curve.

    Some hundred numbers, so that every task carries it.
    """

    weights: np.ndarray
    chain: np.ndarray
    offset: float
    slope: float

    def bad(self, features: np.ndarray) -> np.ndarray:
        """Each line's chance of being bad, by forward-backward."""
        odds = np.exp(np.clip(features @ self.weights, -50, 50)).tolist()
        (gg, gb), (bg, bb) = np.exp(self.chain).tolist()
        n = len(odds)
        ahead = [(1.0, odds[0])] * n
        g, b = 1.0, odds[0]
        for i in range(1, n):
            total = g + b
            g, b = (g * gg + b * bg) / total, (g * gb + b * bb) / total * odds[i]
            ahead[i] = g, b
        out, g, b = [0.0] * n, 1.0, 1.0
        for i in range(n - 1, -1, -1):
            good, bad = ahead[i][0] * g, ahead[i][1] * b
            out[i] = bad / (good + bad)
            b *= odds[i]
            g, b = gg * g + gb * b, bg * g + bb * b
            total = g + b
            g, b = g / total, b / total
        return np.array(out)

    def share(self, text: str) -> tuple[float, int, int]:
        """The length-weighted share of bad text, lines, and lines that are likelier bad."""
        lines = lines_of(text)
        bad = self.bad(unit_features(lines))
        size = np.array([len(x) or 1 for x in lines], float)
        return float(bad @ size / size.sum()), len(lines), int((bad > 0.5).sum())

    def score(self, share: float) -> float:
        return 1.0 / (1.0 + math.exp(-min(40.0, max(-40.0, self.offset + self.slope * _logit(share)))))


def _logit(share):
    return np.log((share + FLOOR) / (1 - share + FLOOR))


def _chains(odds: np.ndarray, inside: np.ndarray, chain: np.ndarray):
    """Of padded chains: the lines' chances of bad and the expected pairs of labels.

    Padding has odds 1 and takes no part in sums; each step is scaled to sum to 1.
    """
    d, longest = odds.shape
    unit = np.stack([np.ones_like(odds), odds], axis=2)
    step = np.exp(chain)
    ahead, after, scale = np.empty((d, longest, 2)), np.ones((d, longest, 2)), np.ones((d, longest))
    now = unit[:, 0]
    for t in range(longest):
        now = now if t == 0 else (now @ step) * unit[:, t]
        total = now.sum(axis=1)
        ahead[:, t] = now = now / total[:, None]
        scale[:, t] = total
    for t in range(longest - 2, -1, -1):
        back = (unit[:, t + 1] * after[:, t + 1]) @ step.T / scale[:, t + 1, None]
        after[:, t] = np.where(inside[:, t + 1, None], back, 1.0)
    bad = np.where(inside, ahead[:, :, 1] * after[:, :, 1], 0.0)
    pairs = np.einsum("dti,ij,dtj->dij", ahead[:, :-1], step, (unit * after / scale[:, :, None] * inside[:, :, None])[:, 1:])
    return bad, pairs


class _Climb:
    """Steps along a slope, each coordinate scaled by its own history."""

    def __init__(self, size: int) -> None:
        self.at, self.mean, self.square, self.step = np.zeros(size), np.zeros(size), np.zeros(size), 0

    def move(self, slope: np.ndarray) -> None:
        self.step += 1
        slope = slope - RIDGE * self.at
        self.mean, self.square = 0.9 * self.mean + 0.1 * slope, 0.99 * self.square + 0.01 * slope**2
        self.at = self.at + RATE * (self.mean / (1 - 0.9**self.step)) / (np.sqrt(self.square / (1 - 0.99**self.step)) + 1e-8)


def latent_labels(x: np.ndarray, doc: np.ndarray, label: np.ndarray, share: np.ndarray) -> np.ndarray:
    """1 for the lines that make their document bad. Lines are independent here and see their own features alone: a good
    document has no bad line, a bad one has some, and that likelihood is climbed."""
    own = np.c_[x[:, :OWN], np.ones(len(x))]
    lower = label[doc] == 0
    climb = _Climb(OWN + 1)
    for _ in range(SEARCH):
        u = np.clip(own @ climb.at, -50, 50)
        bad = 1 / (1 + np.exp(-u))
        # Of a bad document, the chance that all lines are good over that of any bad one.
        none = np.exp(np.minimum(-1e-6, -np.bincount(doc, np.logaddexp(0, u), len(label))))
        pull = np.minimum(50.0, none / (1 - none))
        climb.move((np.where(lower, pull[doc] * bad, -bad) * share[doc]) @ own)
    u = own @ climb.at
    top = np.full(len(label), -np.inf)
    np.maximum.at(top, doc, u)
    return (lower & ((u > 0) | (u == top[doc]))).astype(float)


def fit_features(docs: list[np.ndarray], label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and chain potentials from units of documents with their labels (1: good); each label weighs a half."""
    size = np.array([len(x) for x in docs])
    x = np.concatenate(docs).astype(float)
    inside = np.arange(size.max())[None, :] < size[:, None]
    share = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum()))
    said = np.zeros(inside.shape)
    said[inside] = latent_labels(x, np.repeat(np.arange(len(docs)), size), label, share)
    both = np.stack([1 - said, said], axis=2) * inside[:, :, None]
    pairs_said = np.einsum("dti,dtj->dij", both[:, :-1], both[:, 1:])
    climb = _Climb(WIDTH + 4)
    for _ in range(STEPS):
        odds = np.ones(inside.shape)
        odds[inside] = np.exp(np.clip(x @ climb.at[:WIDTH], -50, 50))
        bad, pairs = _chains(odds, inside, climb.at[WIDTH:].reshape(2, 2))
        climb.move(np.r_[((said - bad) * share[:, None])[inside] @ x, ((pairs_said - pairs) * share[:, None, None]).sum(axis=0).ravel()])
    return climb.at[:WIDTH].copy(), climb.at[WIDTH:].reshape(2, 2).copy()


def _curve(x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Offset and slope of the weighted logistic fit, by Newton steps."""
    a, at, pull = np.c_[np.ones(len(x)), x], np.zeros(2), 0.01 * np.eye(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ at, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + pull, a.T @ (weight * (label - p)) - pull @ at)
        at = at + np.clip(step, -2, 2)
    return float(at[0]), float(at[1])


def fit_texts(good: list[str], bad: list[str], share: float) -> Field:
    """A field from sampled texts; share: of good among all labelled ones. Each third text calibrates, the others train."""
    if not good or not bad:
        sure = min(max(share, 1e-6), 1 - 1e-6)
        return Field(np.zeros(WIDTH), np.zeros((2, 2)), math.log(sure / (1 - sure)), 0.0)
    units = [([unit_features(lines_of(t)) for t in texts], y) for texts, y in ((good, 1), (bad, 0))]
    train = [(x, y) for docs, y in units for i, x in enumerate(docs) if i % 3 or len(docs) < 3]
    weights, chain = fit_features([x for x, _ in train], np.array([y for _, y in train]))
    field = Field(weights, chain, 0.0, -1.0)
    tests = [(t, y) for texts, y in ((good, 1), (bad, 0)) for t in texts[::3]]
    label = np.array([y for _, y in tests], float)
    weight = np.where(label == 1, share / max(1, (label == 1).sum()), (1 - share) / max(1, (label == 0).sum())) * len(tests)
    return Field(weights, chain, *_curve(np.array([_logit(field.share(t)[0]) for t, _ in tests]), label, weight))


def fit(docs: DataFrame, labels: DataFrame, texts: int = TRAIN_TEXTS, chars: int = TRAIN_CHARS, lines: int = TRAIN_LINES) -> Field:
    """A field from a bounded sample of the labelled rows, drawn by a hash of the id."""
    label = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_good"))
    counts = {r._good: r.n for r in label.groupBy("_good").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = counts.get(1, 0) / sum(counts.values()) if counts else 1.0
    order = F.xxhash64("_id", F.lit(13)), F.col("_id")
    # At most twice `texts` ids, so that their side of the join is small at any size of the tables.
    drawn = label.where("_good = 1").orderBy(*order).limit(texts).unionByName(label.where("_good = 0").orderBy(*order).limit(texts))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = found.where((F.length("text") <= chars) & (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) < lines))
    rows = found.join(drawn, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "_good").orderBy(F.xxhash64("doc_id", F.lit(14)), "doc_id", "text", "_good").limit(2 * texts).collect()
    return fit_texts([r.text for r in rows if r._good == 1], [r.text for r in rows if r._good == 0], share)


def scored(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, score, share of bad text, lines and bad lines of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [field.share(t.as_py() or "") for t in batch.column("text")]
            columns = [batch.column("doc_id"), pa.array([field.score(g[0]) for g in got], pa.float64())]
            columns += [pa.array([g[i] for g in got], k) for i, k in enumerate((pa.float64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "bad_share", "n_lines", "n_bad_lines"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, bad_share double, n_lines long, n_bad_lines long")


def _held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, by labels of the rows that aren't held out."""
    out = _held_out(F.col("doc_id"))
    field = fit(docs, labels.where(~out))
    return scored(docs, field).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "bad_share", "n_lines", "n_bad_lines")
