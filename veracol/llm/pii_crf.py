"""Personal data by a skip-chain conditional random field.

Base spans come from fixed patterns. The field stands over the units of a document that have evidence: each base
span, and each token outside of base spans with a digit or an at sign. Labels are OTHER, EMAIL, IP, CARD and PHONE;
factors are those of a unit's shape, of neighbours in the text (chain), and of distant units that are equal or
alike, i.e. the same once case and the signs between their characters are dropped (skip). A base span's label is
observed; loopy sum-product messages pass until they settle, and units outside base spans whose marginal names an
entity, and which pass that entity's check, become added spans. Base spans always stay.

A skip factor joins a unit to a hub of its class rather than to every twin, so that one repeated n times costs n
messages; the hub is a variable of the field with a label of its own.

All weights, that of the skip factors too, maximise the pseudo-likelihood of a bounded sample of documents: texts
with evidence, labelled by their base spans, and for half of them a version into which one of their spans is
written again in a form that the patterns miss (12.34... for 12 34...), which keeps its label; for the others a version
with such a form of another text's phone number, which without a twin is OTHER. So the weights say how much a twin
tells about a unit that no pattern finds.

Defined cases: null or empty text has no spans; texts of any length are read whole, in time that grows with
their length; equal texts get equal spans; offsets count code points, ends are exclusive; an empty table gives an
empty result; only doc_id and text are read, so extra columns cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
#: Bounds of the training sample: texts, characters of a text that is drawn, units.
TRAIN_TEXTS, TRAIN_CHARS, TRAIN_UNITS = 1_000, 20_000, 40_000
#: Message rounds at most, the change at which they have settled, and the share of the old message kept.
ROUNDS, SETTLED, DAMPING = 30, 1e-4, 0.3
#: Marginal from which on an entity label makes a span.
LEAST_MARGINAL = 0.6
#: Steps of the fit, their length, and the pull of weights to zero.
STEPS, RATE, RIDGE = 400, 2.0, 1e-4

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_EVIDENCE = re.compile(r"[0-9@]")
_NO_DIGIT = re.compile(r"[^0-9]+")
_SIGNS = re.compile(r"[\W_]+")
_EDGES = "\"'`.,;:!?()[]{}<>"


def _digits(text: str) -> str:
    return _NO_DIGIT.sub("", text)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _is_card(text: str) -> bool:
    digits = _digits(text)
    return 13 <= len(digits) <= 19 and _luhn(digits)


def _emails(text: str) -> list[tuple[int, int]]:
    out, at, begin = [], text.find("@"), 0
    while at >= 0:
        # A match can only begin in the local part before an at sign.
        local = begin + len(text[begin:at].rstrip(_LOCAL))
        m = _EMAIL.match(text, local) if local < at else None
        begin = at + 1
        if m:
            out.append(m.span())
            begin = m.end()
        at = text.find("@", begin)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    if _EVIDENCE.search(text):
        for m in _DOTTED.finditer(text):
            if m[0].count(".") >= 3:
                # Four groups at a time, as leftmost matches take them.
                parts, start = m[0].split("."), m.start()
                for i in range(0, len(parts) - 3, 4):
                    size = sum(map(len, parts[i : i + 4])) + 3
                    if all(map(_byte, parts[i : i + 4])):
                        out.append(("ip", start, start + size))
                    start += size + 1
        out += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and _is_card(m[0])]
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def passes(kind: str, text: str) -> bool:
    """Whether the text, signs between its characters aside, can be of the kind."""
    if kind == "card":
        return _is_card(text)
    if kind == "phone":
        return 9 <= len(_digits(text)) <= 15
    if kind == "ip":
        parts = [x for x in _NO_DIGIT.split(text) if x]
        return len(parts) == 4 and all(map(_byte, parts))
    return bool(_emails(text))


def alike(unit: str) -> str:
    """What equal or similar units share: their digits where they are mostly digits, else letters and digits."""
    core = _SIGNS.sub("", unit).lower()
    digits = _digits(core)
    return "#" + digits if len(digits) >= 6 and 2 * len(digits) >= len(core) else core


#: Features of a unit: of its shape, and of what stands beside it.
N_FEATURES = 12


def _features(unit: str, before: str, after: str) -> list[float]:
    t = unit.strip(_EDGES)
    n, digits = max(1, len(t)), len(_digits(t))
    groups = [x for x in _NO_DIGIT.split(t) if x]
    return [
        1.0,
        "@" in t,
        "@" in t and "." in t.rpartition("@")[2],
        digits / n,
        len(groups) == 4 and all(map(_byte, groups)),
        13 <= digits <= 19,
        _is_card(t),
        unit.startswith("+"),
        "(" in unit and ")" in unit,
        9 <= digits <= 15,
        digits > 19,
        bool(_EVIDENCE.search(before) or _EVIDENCE.search(after)),
    ]


@dataclass(frozen=True)
class Field:
    """Weights of unit features by label, of neighbouring labels, and of a twin's hub with an equal label."""

    token: np.ndarray
    chain: np.ndarray
    skip: float


@dataclass
class Document:
    """The units with evidence of a text."""

    spans: list[tuple[int, int]]
    features: np.ndarray
    label: np.ndarray
    #: Whether the label is observed.
    base: np.ndarray
    #: Whether the unit before it in the text is the one before it here.
    follows: np.ndarray
    #: Class of alike units; -1 for a unit without a twin.
    twin: np.ndarray


def read(text: str, base: list[tuple[str, int, int]]) -> Document | None:
    """Units in order: base spans whole (a later one that overlaps is left to the first), then tokens clear of them."""
    if not _EVIDENCE.search(text):
        return None
    taken: list[tuple[int, int, int]] = []
    for a, b, kind in sorted((a, b, LABELS.index(k)) for k, a, b in base):
        if not taken or a >= taken[-1][1]:
            taken.append((a, b, kind))
    units: list[tuple[int, int, int, int]] = []
    words: list[tuple[int, int]] = []
    k = 0
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k < len(taken) and taken[k][0] < b:
            j = k
            while j < len(taken) and taken[j][0] < b:
                if not units or units[-1][0] != taken[j][0]:
                    units.append((*taken[j], len(words)))
                    words.append((a, b))
                j += 1
        else:
            if _EVIDENCE.search(m[0]):
                units.append((a, b, 0, len(words)))
            words.append((a, b))
    if not units:
        return None
    keys = [alike(text[a:b]) for a, b, *_ in units]
    classes: dict[str, int] = {}
    number = np.array([classes.setdefault(x, len(classes)) for x in keys])
    twin = np.where(np.bincount(number)[number] > 1, number, -1)
    place = [w for *_, w in units]
    word = lambda i: text[slice(*words[i])] if 0 <= i < len(words) else ""
    features = np.array([_features(text[a:b], word(w - 1), word(w + 1)) for a, b, _, w in units], float)
    label = np.array([x for _, _, x, _ in units])
    return Document([(a, b) for a, b, *_ in units], features, label, label > 0, np.r_[False, np.diff(place) == 1], twin)


def marginals(doc: Document, field: Field) -> np.ndarray:
    """Label marginals of each unit, by damped loopy messages along the chain and through the hubs."""
    k, n = len(LABELS), len(doc.label)
    own = np.exp(np.clip(doc.features @ field.token, -30, 30))
    # A neighbour without evidence is OTHER for sure.
    chain = np.exp(field.chain)
    own *= np.where(doc.follows[:, None], 1.0, chain[0])
    own *= np.where(np.r_[doc.follows[1:], False][:, None], 1.0, chain[:, 0])
    own[doc.base] = np.eye(k)[doc.label[doc.base]]
    own /= own.sum(axis=1, keepdims=True)
    link = np.flatnonzero(doc.follows)
    ahead, back = np.full((n, k), 1 / k), np.full((n, k), 1 / k)
    linked = np.flatnonzero(doc.twin >= 0)
    hub = doc.twin[linked]
    pull = np.exp(field.skip * np.eye(k))
    from_hub = np.full((len(linked), k), 1 / k)
    sums = np.zeros((int(doc.twin.max()) + 1, k)) if len(linked) else np.zeros((1, k))
    ahead_on, back_on = np.ones((n, k)), np.ones((n, k))

    def norm(x: np.ndarray) -> np.ndarray:
        return x / x.sum(axis=1, keepdims=True)

    rounds = 0
    while True:
        skip = np.ones((n, k))
        skip[linked] = from_hub
        ahead_on[link], back_on[link - 1] = ahead[link], back[link - 1]
        belief = norm(own * ahead_on * back_on * skip)
        rounds += 1
        if rounds > ROUNDS:
            return belief
        new_ahead = norm((own * ahead_on * skip)[link - 1] @ chain) if len(link) else ahead[link]
        new_back = norm((own * back_on * skip)[link] @ chain.T) if len(link) else back[link]
        to_hub = np.log(norm((own * ahead_on * back_on)[linked] @ pull)) if len(linked) else from_hub
        sums[:] = 0
        np.add.at(sums, hub, to_hub)
        others = sums[hub] - to_hub
        new_hub = norm(np.exp(others - others.max(axis=1, keepdims=True)) @ pull) if len(linked) else from_hub
        change = max([0.0, *(np.abs(x - y).max() for x, y in ((new_ahead, ahead[link]), (new_back, back[link - 1]), (new_hub, from_hub)) if len(x) and x.shape == y.shape)])
        ahead[link] = DAMPING * ahead[link] + (1 - DAMPING) * new_ahead
        if len(link):
            back[link - 1] = DAMPING * back[link - 1] + (1 - DAMPING) * new_back
        from_hub = DAMPING * from_hub + (1 - DAMPING) * new_hub
        if change < SETTLED:
            return belief


def added_spans(text: str, base: list[tuple[str, int, int]], field: Field) -> list[tuple[str, int, int]]:
    """Units outside base spans that the field labels and that pass the label's check, without the punctuation at
    their ends."""
    doc = read(text, base)
    if doc is None or doc.base.all():
        return []
    belief = marginals(doc, field)
    out = []
    for i in np.flatnonzero(~doc.base):
        label = int(belief[i].argmax())
        if label and belief[i, label] >= LEAST_MARGINAL:
            a, b = doc.spans[i]
            while a < b and text[a] in _EDGES:
                a += 1
            while b > a and text[b - 1] in _EDGES:
                b -= 1
            if a < b and passes(LABELS[label], text[a:b]):
                out.append((LABELS[label], a, b))
    return out


def disguised(kind: str, span: str, turn: int) -> str:
    """The span in a form that the patterns miss; empty for a kind without one."""
    digits, sign = _digits(span), ("", "/", "_")[turn % 3]
    if kind == "phone":
        return digits if not sign else sign.join((digits[:2], digits[2:5], digits[5:]))
    if kind == "card":
        return (sign or ".").join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return span.replace(".", sign or "-") if kind == "ip" else ""


def _with_repeat(text: str, base: list[tuple[str, int, int]], turn: int) -> Document | None:
    """The text with one of its spans written again, disguised, between two words of it."""
    can = [s for s in base if s[0] != "email"]
    if not can:
        return None
    kind, a, b = can[turn % len(can)]
    form = disguised(kind, text[a:b], turn)
    gaps = [0, *(m.end() for m in _TOKEN.finditer(text) if not any(x < m.end() < y for _, x, y in base)), len(text)]
    at = gaps[(turn * 7919) % len(gaps)]
    text = f"{text[:at]} {form} {text[at:]}"
    doc = read(text, base_spans(text))
    if doc is not None:
        doc.label[[i for i, s in enumerate(doc.spans) if s == (at + 1, at + 1 + len(form)) and not doc.base[i]]] = LABELS.index(kind)
    return doc


def _twins_said(doc: Document) -> np.ndarray:
    """How many of each unit's twins have each label."""
    k = len(LABELS)
    each = np.eye(k)[doc.label]
    out = np.zeros((len(doc.label), k))
    linked = np.flatnonzero(doc.twin >= 0)
    if len(linked):
        sums = np.zeros((int(doc.twin.max()) + 1, k))
        np.add.at(sums, doc.twin[linked], each[linked])
        out[linked] = sums[doc.twin[linked]] - each[linked]
    return out


def fit_texts(texts: list[str]) -> Field:
    """Weights by pseudo-likelihood: each label given its features, its neighbours' labels and its twins' labels
    (summed over the label of their hub)."""
    k = len(LABELS)
    docs, room, stray = [], TRAIN_UNITS, ""
    for turn, text in enumerate(texts):
        base = base_spans(text)
        other = _with_repeat(text, base, turn // 2) if turn % 2 else read(f"{text} {stray}", base) if stray else None
        stray = stray if turn % 2 else ""
        phones = [text[a:b] for kind, a, b in base if kind == "phone"]
        stray = disguised("phone", phones[0], turn) if phones else stray
        for doc in (read(text, base), other):
            if doc is not None and room > 0:
                room -= len(doc.label)
                docs.append(doc)
    token, chain, skip = np.zeros((N_FEATURES, k)), np.zeros((k, k)), 0.5
    if not docs:
        return Field(token, chain, skip)
    x, label = np.concatenate([d.features for d in docs]), np.concatenate([d.label for d in docs])
    before = np.concatenate([np.where(d.follows, np.r_[0, d.label[:-1]], 0) for d in docs])
    after = np.concatenate([np.where(np.r_[d.follows[1:], False], np.r_[d.label[1:], 0], 0) for d in docs])
    said = np.concatenate([_twins_said(d) for d in docs])
    y, eye = np.eye(k)[label], np.eye(k)

    def likely(weight: float) -> tuple[np.ndarray, float]:
        """Each unit's label given all else, and the mean log of that of the labels."""
        hub = np.exp(weight * (said - said.max(axis=1, keepdims=True)))
        z = x @ token + chain[before] + chain[:, after].T + np.log(hub @ np.exp(weight * eye))
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        return p, float(np.log(np.maximum((p * y).sum(axis=1), 1e-300)).mean())

    for _ in range(STEPS):
        p, _ = likely(skip)
        step = (y - p) / len(x)
        slope = (likely(skip + 1e-3)[1] - likely(skip - 1e-3)[1]) / 2e-3
        token += RATE * (x.T @ step - RIDGE * token)
        moved = np.zeros((k, k))
        np.add.at(moved, before, step)
        np.add.at(moved.T, after, step)
        chain += RATE * (moved - RIDGE * chain)
        skip = max(0.0, skip + RATE * (slope - RIDGE * skip))
    return Field(token, chain, skip)


def fit(docs: DataFrame, texts: int = TRAIN_TEXTS, chars: int = TRAIN_CHARS) -> Field:
    """Weights from a bounded sample of the texts with evidence of up to `chars` characters, drawn by a hash."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(text.alias("text")).where(F.col("text").rlike("[0-9@]") & (F.length("text") <= chars)).withColumn("_h", F.xxhash64("text"))
    # Hashes are drawn first, texts fetched after, so that tasks send the driver no more than the sample.
    drawn = [r._h for r in rows.select("_h").distinct().orderBy("_h").limit(texts).collect()]
    if not drawn:
        return fit_texts([])
    return fit_texts([r.text for r in rows.where(F.col("_h") <= drawn[-1]).dropDuplicates(["_h"]).orderBy("_h").collect()])


def found(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, base and added spans of every whole text, as arrays of (kind, start, end)."""
    span = "array<struct<kind:string,start:int,stop:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            sides: tuple[list, list] = [], []
            for t in batch.column("text"):
                text = t.as_py() or ""
                base = base_spans(text)
                for side, spans in zip(sides, (base, added_spans(text, base, field)), strict=True):
                    side.append([dict(zip(("kind", "start", "stop"), s, strict=True)) for s in spans])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(s, kind) for s in sides]], names=["doc_id", "base", "added"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, base {span}, added {span}")


def _joined(column: str):
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.stop.cast("string"))), ",")


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind and digest of the base spans, all spans, of every document."""
    rows = found(docs, fit(docs))
    order = {k: i for i, k in enumerate(KINDS)}
    place = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    every = F.transform(F.concat("base", "added"), lambda s: F.struct(place[s.kind].alias("place"), s.start.alias("start"), s.stop.alias("stop"), s.kind.alias("kind")))
    counts = [F.expr(f"CAST(size(filter(base, s -> s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in KINDS]
    rows = rows.withColumn("_all", F.sort_array(every))
    return rows.select("doc_id", *counts, F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("_all").alias("spans"), F.size("added").cast("long").alias("n_added"))
