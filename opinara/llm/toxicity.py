"""Toxicity by noisy-channel deobfuscation.

Suspicious stretches of a lower-cased text (letters mixed with or followed by look-alike signs, single letters between white
space or punctuation, letters repeated) are
read as a lattice: each sign may stand for some letters at a cost, separators vanish, runs shrink to one or two. The Viterbi
path under a character trigram model, whose counts come from every document, is the restored word. Restored words and
all others are then scored: words and their prefixes carry the smoothed odds with which labelled documents that contain
them are toxic, and a logistic regression over a document's strongest words gives the score.

Odds come from at most MAX_LABELLED labelled rows (those with the smallest hash of doc_id), never held-out ones; the regression
is fitted on odds from which a row's own label was taken out.

Defined results: null and empty texts score as a text without any telling word. Without labels of both kinds the score is the
share of toxic ones (0.05 without any). A doc_id labelled twice counts as toxic if either is, and one with several texts by the first of them; null labels
and doc_ids are not used. Texts are read whole. Repeated rows give repeated rows; an empty table an empty one; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.common import durable, slices

MAX_LABELLED = 40_000
LEAST_TOXIC = 3
CUT = 0.7
INPUTS = 9  # of the regression
SCORED = "doc_id long, held_out boolean, score double, predicted int"

#: What a sign may stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c"}

_WORD = re.compile(r"[^\W\d_]+")
_SIGNS = re.escape("".join(LOOKALIKES))
_ONE, _GAP = rf"[^\W_{_SIGNS}]|[{_SIGNS}]", rf"(?:[^\w{_SIGNS}]|_)+"
_SUSPECT = re.compile(
    rf"(?<![\w{_SIGNS}])(?:[^\W\d_]+[{_SIGNS}]+|[{_SIGNS}]{{1,3}}(?=[^\W\d_]))[\w{_SIGNS}]*"
    rf"|(?<![^\W_])(?:(?:{_ONE}){_GAP}){{3,}}(?:{_ONE})(?![^\W_])"
    r"|[^\W\d_]*([a-z])\1\1[^\W\d_]*"
)
_PAIR = re.compile(rf"([{_SIGNS}])\1")
SYMBOLS = 28  # a to z, other letters, everything else
_CODE = np.full(256, 27, np.int64)
_CODE[97:123] = np.arange(26)
_CODE[65:91] = np.arange(26)
_CODE[128:] = 26


class Model(NamedTuple):
    trigrams: np.ndarray  # log probabilities, by the two symbols before
    odds: dict[str, float]
    weights: list[float]


def symbol(char: str) -> int:
    return ord(char) - 97 if "a" <= char <= "z" else 26 if char.isalpha() else 27


def trigram_counts(data: bytes) -> np.ndarray:
    code = _CODE[np.frombuffer(data, np.uint8)]
    if len(code) < 3:
        return np.zeros(SYMBOLS**3, np.int64)
    return np.bincount((code[:-2] * SYMBOLS + code[1:-1]) * SYMBOLS + code[2:], minlength=SYMBOLS**3)


def trigram_model(counts: np.ndarray) -> np.ndarray:
    """Log probabilities, smoothed by those of shorter contexts."""
    three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
    one = three.sum((0, 1)) + 1
    two = three.sum(0) + 20 * one / one.sum()
    two /= two.sum(1, keepdims=True)
    three = three + 20 * two[None]
    return np.log(three / three.sum(2, keepdims=True))


def bare(token: str) -> str:
    """A stretch without what separates its letters."""
    return "".join(c for c in token if c.isalnum() or c in LOOKALIKES)


def restore(token: str, trigrams: np.ndarray, pairs: bool = False) -> str:
    """The likeliest word behind a suspicious stretch; with pairs, one where two equal signs are two letters.

    States are the last two symbols, so that work grows with the stretch's length alone; the word is read off back pointers."""
    runs: list[list] = []
    for c in bare(token):
        if runs and runs[-1][0] == c:
            runs[-1][1] += 1
        else:
            runs.append([c, 1])
    values, steps = {(27, 27): 0.0}, []  # steps: for each run, state to the state before and the letters between
    for char, n in runs:
        options = [(c, 0.5 if c != char else 0.0) for c in LOOKALIKES.get(char, "")] + ([(char, 0.0)] if char.isalpha() else [(char, 6.0)])
        new: dict[tuple[int, int], float] = {}
        back: dict[tuple[int, int], tuple[tuple[int, int], str]] = {}
        for (a, b), value in values.items():
            for letter, price in options:
                k = symbol(letter)
                for times in (2,) if pairs and n == 2 else (1, 2) if n > 1 else (1,):
                    total, x, y = value - price * times, a, b
                    if n > 2 and times == 2:
                        total -= 0.5
                    for _ in range(times):
                        total += trigrams[x, y, k]
                        x, y = y, k
                    if (x, y) not in new or new[x, y] < total:
                        new[x, y], back[x, y] = total, ((a, b), letter * times)
        values = new
        steps.append(back)
    _, state = max(((value + trigrams[a, b, 27], (a, b)) for (a, b), value in values.items()))
    letters = []
    for back in reversed(steps):
        state, written = back[state]
        letters.append(written)
    return "".join(reversed(letters))


_LETTERS = np.zeros(129, bool)  # by code point; 128 stands for all beyond ASCII, which may be letters or not
_LETTERS[[*range(97, 123), 128]] = True
_AS_SIGN = np.zeros(129, bool)
_AS_SIGN[[ord(sign) for sign in LOOKALIKES]] = True
_REACH = 96  # characters around a suspicious place, on to the next spaces, in which the pattern finds all it would in the whole text


def suspects(low: str) -> set[str]:
    """Suspicious stretches of a text in lower case. Arrays find the places; the pattern is only tried around them."""
    code = np.frombuffer(low.encode("utf-32-le", "replace"), np.uint32)
    if len(code) < 2:
        return set()
    code = np.minimum(code, 128)
    letter, sign, wide = _LETTERS[code], _AS_SIGN[code], code == 128
    mixed = letter[1:] & sign[:-1] | sign[1:] & letter[:-1]
    mixed[1:] |= (code[2:] == code[1:-1]) & (code[1:-1] == code[:-2]) & letter[1:-1] & ~wide[1:-1]
    firsts = lasts = np.flatnonzero(mixed) + 1
    edge = np.concatenate(([True], ~(letter | sign) | wide, [True]))
    single = np.flatnonzero(letter | sign)
    before, after = edge[:-2][single], edge[2:][single]
    alone = before & after
    four = np.flatnonzero(after[:-3] & alone[1:-2] & alone[2:-1] & before[3:]) if len(single) > 3 else single[:0]
    if len(four):
        firsts, lasts = np.concatenate((firsts, single[four])), np.concatenate((lasts, single[four + 3]))
        order = np.argsort(firsts, kind="stable")
        firsts, lasts = firsts[order], np.maximum.accumulate(lasts[order])
    cuts = np.flatnonzero(firsts[1:] - lasts[:-1] > 2 * _REACH) + 1
    windows: list[list[int]] = []  # from space to space: what has spaces inside lies between a first and its last
    for first, last in zip(firsts[[0, *cuts]].tolist(), lasts[[*(cuts - 1), -1]].tolist()) if len(firsts) else ():
        start, end = max(low.rfind(" ", 0, max(0, first - _REACH)), 0), low.find(" ", last + _REACH)
        end = end if end >= 0 else len(low)
        if windows and start < windows[-1][1]:
            windows[-1][1] = max(end, windows[-1][1])
        else:
            windows.append([start, end])
    return {m.group() for start, end in windows for m in _SUSPECT.finditer(low, start, end)}


class Reader:
    """Reads texts as sets of words, remembering what it has restored."""

    def __init__(self, trigrams: np.ndarray) -> None:
        self.trigrams, self.known, self.size = trigrams, {}, 0

    def restored(self, token: str) -> set[str]:
        """The words behind a suspicious stretch."""
        token = bare(token)
        if token not in self.known:
            if self.size > 1 << 22:
                self.known.clear()
                self.size = 0
            word = restore(token, self.trigrams)
            if _PAIR.search(token):
                word += " " + restore(token, self.trigrams, True)
            self.known[token] = word
            self.size += len(token) + 50
        return set(_WORD.findall(self.known[token]))

    def read(self, text: str | None) -> tuple[set[str], set[str]]:
        """The words of a text as they stand, and those behind its suspicious stretches."""
        low = (text or "").lower()
        return set(_WORD.findall(low)), set().union(*map(self.restored, suspects(low)))

    def words(self, text: str | None) -> set[str]:
        return set().union(*self.read(text))


def keys(word: str) -> list[str]:
    """A word as features: itself and its prefixes of 4 and 5 letters, marked."""
    return [word, f"{word[:4]}-", f"{word[:5]}-"][: 1 + (len(word) > 4) + (len(word) > 5)]


def telling(words: set[str], table: dict[str, object], worth) -> list[float]:
    """What those of words are worth of which a feature is in table, if over 0."""
    near = (w for w in words if w in table or f"{w[:4]}-" in table or f"{w[:5]}-" in table)
    return [v for w in near if (v := max((worth(k) for k in keys(w) if k in table), default=0.0)) > 0]


def document(text: str | None, reader: Reader, table: dict[str, object], worth) -> list[float]:
    """What the regression sees of a document: its three strongest words, the squares of the first two, all others together, the
    strongest restored word that doesn't stand in the text itself, and how many words tell."""
    plain, hidden = reader.read(text)
    veiled = telling(hidden - plain, table, worth)
    values = sorted(telling(plain, table, worth) + veiled, reverse=True)
    top = values[:3] + [0.0] * 3
    return [*top[:3], top[0] ** 2, top[1] ** 2, math.log1p(sum(values[3:])), max(veiled, default=0.0), min(len(values), 5) / 5, 1.0]


def evidence(toxic: float, clean: float, share: float) -> float:
    """Log odds of toxic among the documents with a feature, beyond those of all; 0 at least."""
    p = (toxic + 4 * share) / (toxic + clean + 4)
    return max(0.0, math.log(p / (1 - p)) - math.log(share / (1 - share)))


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**3, np.int64)
    for batch in batches:
        for rows in slices(batch, 0):
            total += trigram_counts(b"".join((raw or b"") + b"  " for raw in rows.column(0).cast(pa.binary()).to_pylist()))
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["code", "n"])


def _features(batches: Iterator[pa.RecordBatch], trigrams: np.ndarray) -> Iterator[pa.RecordBatch]:
    reader = Reader(trigrams)
    for batch in batches:
        for rows in slices(batch, 0):
            counts = (Counter(), Counter())
            for text, toxic in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                counts[toxic].update({k for word in reader.words(text) for k in keys(word)})
            every = list(counts[0].keys() | counts[1].keys())
            columns = [every, [counts[1][k] for k in every], [counts[0][k] for k in every]]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()))], names=["key", "toxic", "clean"])


def _left_out(batches: Iterator[pa.RecordBatch], trigrams: np.ndarray, counts: dict[str, tuple[int, int]], share: float) -> Iterator[pa.RecordBatch]:
    reader = Reader(trigrams)
    for batch in batches:
        for rows in slices(batch, 0):
            truth = rows.column(1).to_pylist()
            seen = [document(text, reader, counts, lambda k, own=own: evidence(counts[k][0] - own, counts[k][1] - 1 + own, share)) for text, own in zip(rows.column(0).to_pylist(), truth)]
            yield pa.record_batch([pa.array(seen, pa.list_(pa.float64())), pa.array(truth, pa.int32())], names=["x", "toxic"])


def regression(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> list[float]:
    """Logistic regression by Newton's method, with a slight ridge."""
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - w)
    return w.tolist()


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from all texts of docs, and from labels (doc_id, toxic) of rows that are not held out."""
    counts = np.zeros(SYMBOLS**3, np.int64)
    for row in docs.select("text").mapInArrow(_trigrams, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():  # SYMBOLS**3 rows at most
        counts[row["code"]] = row["n"]
    trigrams = trigram_model(counts)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    known = durable(known, "known")  # MAX_LABELLED small rows
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first(F.col("toxic") > 0).cast("int").alias("toxic"))  # a doc_id counts once however often it stands there
    rows = durable(rows.select("text", "toxic"), "labelled")
    totals = rows.agg(F.count("*").alias("n"), F.count_if(F.col("toxic") > 0).alias("toxic")).first()
    if not 0 < totals["toxic"] < totals["n"]:
        share = 0.05 if not totals["n"] else 0.01 + 0.98 * totals["toxic"] / totals["n"]
        return Model(trigrams, {}, [0.0] * (INPUTS - 1) + [math.log(share / (1 - share))])
    share = totals["toxic"] / totals["n"]
    found = rows.mapInArrow(partial(_features, trigrams=trigrams), "key string, toxic long, clean long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    telling = found.where((F.col("toxic") >= LEAST_TOXIC) & (F.col("toxic") > 3 * share * (F.col("toxic") + F.col("clean"))))
    table = {r["key"]: (r["toxic"], r["clean"]) for r in telling.collect()}  # bounded by the labelled rows' words
    seen = rows.mapInArrow(partial(_left_out, trigrams=trigrams, counts=table, share=share), "x array<double>, toxic int").collect()
    weights = regression(np.array([r["x"] for r in seen]), np.array([r["toxic"] for r in seen], float)) if seen else [0.0] * INPUTS
    return Model(trigrams, {k: evidence(*n, share) for k, n in table.items()}, weights)


def score(texts: list[str | None], model: Model, reader: Reader) -> list[float]:
    blank = [0.0] * (INPUTS - 1) + [1.0]
    found = [document(text, reader, model.odds, model.odds.__getitem__) if model.odds else blank for text in texts]
    return [1 / (1 + math.exp(-sum(w * x for w, x in zip(model.weights, row)))) for row in found]


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    reader = Reader(model.trigrams)
    for batch in batches:
        for rows in slices(batch, 2):
            found = np.array(score(rows.column(2).to_pylist(), model, reader), float)
            columns = [rows.column(0), rows.column(1), pa.array(found), pa.array((found >= CUT).astype(np.int32))]
            yield pa.record_batch(columns, names=[c.split()[0] for c in SCORED.split(", ")])


def classify(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""
    model = model or fit(docs, labels)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(partial(_score, model=model), SCORED)
