"""Language identification by averaged hashed subword embeddings and a linear softmax.

Features are the byte 2- to 4-grams of a lower-cased text, everything that is not a letter read as a space; each is hashed to
a row of an embedding table, a text is the mean of its rows, and a linear softmax over it gives the languages. Both are
trained by stochastic gradient descent in numpy on a bounded sample: PER_LANGUAGE rows, those of the smallest hash, of each
of the MAX_LANGUAGES most frequent languages (fewer of each where there would be more than MAX_ROWS). The driver gets a sampled row as its features, BUCKETS at most however long
its text is. A temperature fitted on rows left out of training calibrates the probabilities; the same rows set the
confidence under which a document is rejected, so that KEEP of them stay.

Defined results: null texts and texts without letters (Unicode category L) get ``und``, score 0 and are rejected. Without any
labelled row every text gets ``und``. Texts are read whole. A null doc_id is never held out. Repeated rows give repeated rows;
an empty table an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinara.llm.common import slices

BUCKETS = 1 << 16
WIDTH = 16
GRAMS = (2, 3, 4)
PER_LANGUAGE = 700
MAX_LANGUAGES = 256
MAX_ROWS = 16_000  # of all languages together
KEEP = 0.998
UNKNOWN = "und"
FOUND = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"

_LETTER = regex.compile(r"\p{L}")
#: Bytes as features: letters and parts of other characters for themselves, all else a space.
_READ = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


class Model(NamedTuple):
    languages: list[str]
    table: np.ndarray  # of each bucket, what it adds to each language's logit
    temperature: float
    slack: float  # a text of n grams has the temperature times 1 + slack / sqrt(n)
    doubt: float  # share of texts that the softmax takes for others however sure it is
    least: float


def buckets(data: np.ndarray) -> np.ndarray:
    """The buckets of all grams of a text's bytes, one row for each length of gram; grams that run over the end wrap."""
    out, h = [], np.zeros(len(data), np.uint32)
    for k in range(GRAMS[-1]):
        h = h + (np.roll(data, -k).astype(np.uint32) + np.uint32(1)) * _FACTORS[k]
        if k + 1 in GRAMS:
            m = (h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D + 2 * k)
            out.append(m >> np.uint32(16))
    return np.stack(out)


def readable(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_READ).split()) + b"    "


PART = 1 << 18


def parts(text: str) -> Iterator[np.ndarray]:
    """The buckets of a text's grams, for a part of it at a time."""
    data = np.frombuffer(readable(text), np.uint8)
    for at in range(0, len(data), PART):  # a part and the bytes its last grams run into
        yield buckets(data[at : at + PART + GRAMS[-1] - 1])[:, : min(PART, len(data) - at)].ravel()


def features(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Buckets of a text, their shares, and the number of its grams."""
    n = sum(np.bincount(part, minlength=BUCKETS) for part in parts(text))
    at = np.flatnonzero(n)
    return at, (n[at] / n.sum()).astype(np.float32), int(n.sum())


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, str]], **how) -> Model:
    """rows: (lang, text)."""
    return train_features([(lang, features(text)) for lang, text in rows], **how)


def train_features(rows: list[tuple[str, tuple]], epochs: int = 4, rate: float = 2.0, seed: int = 7) -> Model:
    """rows: (lang, features). Every fifth row calibrates."""
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), 1.0, 0.0, 0.0, 0.0)
    rng = np.random.default_rng(seed)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    data = [(found, languages.index(lang)) for lang, found in rows]
    fit, held = [d for i, d in enumerate(data) if i % 5], data[::5]
    embed = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    out = np.zeros((WIDTH, len(languages)), np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(fit)):
            (at, share, _), y = fit[i]
            mean = share @ embed[at]
            p = softmax(mean @ out)
            p[y] -= 1
            back = out @ p
            out -= step * np.outer(mean, p)
            embed[at] -= step * 20 * share[:, None] * back
    table = embed @ out
    logits = np.array([share @ table[at] for (at, share, _), _ in held])
    truth = np.array([y for _, y in held])
    short = np.array([[n**-0.5] for (_, _, n), _ in held])
    doubt = float(((logits.argmax(axis=1) != truth).sum() + 1) / (len(truth) + 2))
    probable = lambda t, slack: (1 - doubt) * softmax(logits / (t * (1 + slack * short))) + doubt / len(languages)
    loss = lambda x: -np.log(probable(*x)[np.arange(len(truth)), truth]).mean()
    temperature, slack = min(((float(t), s) for t in np.geomspace(0.2, 10, 35) for s in (0.0, 3.0, 10.0, 30.0, 100.0)), key=loss)
    sure = probable(temperature, slack).max(axis=1)
    return Model(languages, table, temperature, slack, doubt, float(min(0.5, np.quantile(sure, 1 - KEEP))))


def predict(texts: list[str | None], model: Model) -> list[tuple[str, float, bool]]:
    """Language, calibrated probability, and whether it is rejected, of each text."""
    out: list[tuple[str, float, bool]] = []
    for text in texts:
        if not text or not model.languages or not _LETTER.search(text):
            out.append((UNKNOWN, 0.0, True))
            continue
        total, n = np.zeros(len(model.languages)), 0
        for part in parts(text):
            total += model.table[part].sum(axis=0, dtype=np.float64)
            n += part.size
        p = softmax(total / n / (model.temperature * (1 + model.slack * n**-0.5)))
        p = (1 - model.doubt) * p + model.doubt / len(p)
        best = int(p.argmax())
        out.append((model.languages[best], float(p[best]), bool(p[best] < model.least)))
    return out


def _predict(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in slices(batch, 2):
            found = predict(rows.column(2).to_pylist(), model)
            lang, score, rejected = zip(*found) if found else ((), (), ())
            columns = [rows.column(0), rows.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.record_batch(columns, names=[c.split()[0] for c in FOUND.split(", ")])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in slices(batch, 1):
            found = [features(text) for text in rows.column(1).to_pylist()]
            columns = [[at.astype(np.uint16).tobytes() for at, _, _ in found], [share.tobytes() for _, share, _ in found], [n for _, _, n in found]]
            yield pa.record_batch([rows.column(0), *(pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.binary(), pa.int64())))], names=["lang", "at", "share", "n"])


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame) -> Model:
    """A model from the rows of docs (doc_id, text, lang) that are not held out."""
    known = docs.where(F.col("lang").isNotNull() & ~held_out() & F.col("text").isNotNull())
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    if not counts:
        return train([])
    each = min(PER_LANGUAGE, MAX_ROWS // len(counts))
    share = F.create_map(*(F.lit(x) for row in counts for x in (row["lang"], min(1.0, 2 * each / row["count"]))))
    order = F.xxhash64("doc_id", F.xxhash64("text"), F.lit(11))
    likely = known.where(F.pmod(order, F.lit(1 << 20)) / float(1 << 20) < share[F.col("lang")])  # twice as many as needed
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id", F.xxhash64("text")))
    sample = likely.withColumn("nth", nth).where(F.col("nth") <= each).orderBy("lang", "nth").select("lang", "text")
    rows = sample.mapInArrow(_features, "lang string, at binary, share binary, n long").collect()
    return train_features([(r["lang"], (np.frombuffer(r["at"], np.uint16).astype(np.int64), np.frombuffer(r["share"], np.float32), r["n"])) for r in rows])


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for every row of docs."""
    model = model or fit(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(partial(_predict, model=model), FOUND)


def keep_known(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs, all columns as they were, without the documents that identification rejects."""
    model = model or fit(docs)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, batch.schema.get_field_index("text")):
                yield rows.filter(pa.array([not x[2] for x in predict(rows.column("text").to_pylist(), model)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
