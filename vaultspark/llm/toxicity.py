"""Toxicity by compression distance.

Two zstandard dictionaries are trained, by the library's trainer, from labelled rows:

* the ordinary one from the windows of ordinary rows;
* the toxic one from the text of toxic rows that ordinary language leaves over: a word stays where its rate among
  toxic rows is more than ``RATE`` times that among ordinary ones and at least ``LEAST`` toxic rows have it. It
  follows the ordinary dictionary's bytes, so that common language costs the same with either; the ordinary one has as many blank bytes.

Each whole text, lower-cased, is cut at spaces into windows of 96 bytes, twice with different phases; every window is compressed with both
dictionaries, and what the toxic one saves is its gain. A document's largest gains and
their counts go through a logistic calibration, shifted so that the threshold
with the best F1 on the training rows lies at 0.7. The gains that calibrate come from dictionaries trained
without the row: training rows are dealt to ``FOLDS`` folds for it.

Bounds of training: at most ``MAX_TOXIC`` and ``MAX_ORDINARY`` labelled rows,
those with the smallest hash of doc_id, of which those with more than ``MAX_CHARS`` characters are left out; the dictionaries
have at most ``BASE`` and ``TAIL`` bytes. Rows whose
``crc32(doc_id as text) mod 3`` is 1 are held out and never used for training. Near
copies among the training rows count once. Scores depend on the text alone.

Defined cases: null and empty texts get a score (of no gain), texts of any length are scored whole; null doc_ids are not held
out; equal texts get equal scores; labels that contradict count as toxic; of rows that share a labelled doc_id the least text trains;
without labels of both kinds every score is 0; extra columns are kept, one that has the score's name is replaced.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, trim

MAX_TOXIC, MAX_ORDINARY, MAX_CHARS = 2500, 4000, 32_768
#: Bytes of a window, of the ordinary dictionary and of the toxic one behind it.
WINDOW, BASE, TAIL = 96, 48 << 10, 2 << 10
THRESHOLD = 0.7
RATE, LEAST, FOLDS = 4.0, 4, 2
_EDGE = ".,;:!?\"'()[]"


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    mean: list[float]
    scale: list[float]
    weight: list[float]


def windows(text: bytes, start: int = 0) -> Iterator[bytes]:
    """Windows of at most ``WINDOW`` bytes, cut at a space where there is one; the first may be shorter, ``start`` bytes."""
    at, n = 0, len(text)
    while at < n:
        end = at + (WINDOW if at or not start else start)
        if end < n:
            space = text.rfind(b" ", at + (end - at) // 2, end)
            end = space if space > at else end
        yield text[at:end]
        at = end


def _compressor(content: bytes) -> zstd.ZstdCompressor:
    how = zstd.ZstdCompressionParameters.from_level(6, source_size=WINDOW, dict_size=len(content), strategy=zstd.STRATEGY_LAZY, min_match=4, search_log=6, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstd.FORMAT_ZSTD1_MAGICLESS)
    return zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=how)


class Gains:
    """The features of a text: what the toxic dictionary saves over its windows."""

    def __init__(self, model: Model):
        self.plain, self.toxic = _compressor(model.ordinary), _compressor(model.toxic)

    def __call__(self, text: str | None) -> list[float]:
        raw, plain, toxic = (text or "").lower().encode(), self.plain.compress, self.toxic.compress
        gains = [len(plain(w)) - len(toxic(w)) for phase in (0, WINDOW // 2) for w in windows(raw, phase)]
        top = [*sorted(gains, reverse=True)[:6], *[0] * 6]
        logs = (*(sum(g >= k for g in gains) for k in (1, 2, 3, 5)), sum(g for g in gains if g >= 4), len(gains))
        return [1.0, *map(float, top[:4]), float(top[5]), sum(gains) / max(1, len(gains)), sum(g for g in gains if g >= 2) / max(1, len(gains)), *(math.log1p(x) for x in logs)]


def _families(texts: list[str]) -> list[str]:
    """One text of each family of near copies: those that share a minimum hash of their four-word shingles."""
    seen, out = set(), []
    for text in texts:
        words = text.lower().split()
        shingles = [" ".join(words[i : i + 4]).encode() for i in range(max(1, len(words) - 3))]
        keys = [(s, min(zlib.crc32(x, s) for x in shingles)) for s in (1, 2, 3)]
        if not any(k in seen for k in keys):
            out.append(text)
        seen.update(keys)
    return out


def _words(text: str) -> list[str]:
    return [w for w in (x.strip(_EDGE) for x in text.lower().split()) if w]


def left_over(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """What ordinary language leaves over of each toxic text."""
    ours, theirs = Counter(), Counter()
    for x in toxic:
        ours.update(set(_words(x)))
    for x in ordinary:
        theirs.update(w for w in set(_words(x)) if w in ours)
    telling = {w for w, a in ours.items() if a >= LEAST and a * len(ordinary) > RATE * (theirs[w] + 0.5) * len(toxic)}
    out = [" ".join(["", *(w for w in _words(x) if w in telling)]).encode() for x in toxic]
    return [x for x in out if x]


def _dictionary(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """A trained dictionary; of samples that are too few to train one, their end."""
    try:
        return zstd.train_dictionary(size, samples, k=k, d=d, level=6).as_bytes()
    except zstd.ZstdError:
        return b"".join(samples)[-size:]


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary, of one size."""
    base = _dictionary([w for x in ordinary for w in windows(x.lower().encode())], BASE, 64, 8)
    tail = _dictionary(left_over(toxic, ordinary), TAIL, 24, 8) or b"\x01"
    return base + bytes([1]) * len(tail), base + tail


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, scale = x.mean(0), x.std(0)
    mean[0], scale[0] = 0, 1
    scale[scale < 1e-9] = 1
    z, w = (x - mean) / scale, np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.3 * np.eye(len(w)), z.T @ (p - y) + 0.3 * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    score = z @ w
    cuts = np.unique(np.quantile(score, np.linspace(0, 1, 1000)))
    f1 = [2 * (y[score >= c] == 1).sum() / ((score >= c).sum() + y.sum()) for c in cuts]
    best = cuts[np.flatnonzero(np.array(f1) >= max(f1) - 1e-12)].mean()
    w[0] += math.log(THRESHOLD / (1 - THRESHOLD)) - best
    return mean, scale, w


def train(toxic: list[str], ordinary: list[str]) -> Model | None:
    """The dictionaries and the calibration, from texts of the two kinds."""
    if not toxic or not ordinary:
        return None
    once, others = _families(toxic), _families(ordinary)
    x, y = [], []
    for fold in range(FOLDS):
        # A kind with a single text has no other one to train from.
        rest = [[t for i, t in enumerate(texts) if i % FOLDS != fold] or texts for texts in (once, others)]
        gains = Gains(Model(*dictionaries(*rest), [], [], []))
        for kind, texts in ((1.0, once), (0.0, others)):
            x += [gains(t) for t in texts[fold::FOLDS]]
            y += [kind] * len(texts[fold::FOLDS])
    model = Model(*dictionaries(once, others), [], [], [])
    x, y = np.array(x), np.array(y)
    model.mean, model.scale, model.weight = (v.tolist() for v in _fit(x, y))
    return model


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[str]]:
    """Texts of at most MAX_TOXIC and MAX_ORDINARY labelled rows that are not held out."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    order = F.xxhash64("doc_id")
    chosen = [known.where(f"toxic {op} 0").orderBy(order, "doc_id").limit(n) for op, n in (("<>", MAX_TOXIC), ("=", MAX_ORDINARY))]
    ids = chosen[0].unionByName(chosen[1])
    # The ids are at most MAX_TOXIC + MAX_ORDINARY, so they may be broadcast, and the texts collected.
    rows = docs.select("doc_id", "text").where(F.length("text").between(1, MAX_CHARS)).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    rows.sort(key=lambda r: r.doc_id)
    return [r.text for r in rows if r.toxic], [r.text for r in rows if not r.toxic]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _scorer(model: Model | None, name: str):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = Gains(model) if model else None
        for batch in batches:
            if not model:
                s = np.zeros(batch.num_rows)
            elif not batch.num_rows:
                s = np.zeros(0)
            else:
                x = np.array([gains(t.as_py()) for t in batch.column(batch.num_columns - 1)])
                s = 1 / (1 + np.exp(-np.clip((x - np.array(model.mean)) / np.array(model.scale) @ np.array(model.weight), -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], [*batch.schema.names, name])
        trim()

    return score


def score_texts(docs: DataFrame, model: Model | None, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with ``score`` double; its text column moves to the end."""
    df = docs.drop(score)
    df = df.select(*[c for c in df.columns if c != text], text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{score}` double"
    return df.mapInArrow(_scorer(model, score), schema)


def fitted(spark: SparkSession, sf_dir: str) -> Model | None:
    return train(*training_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_texts(docs, fitted(spark, sf_dir))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
