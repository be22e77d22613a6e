"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader (proximal) under elastic-net penalties, then calibrated by one temperature.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqspark.llm.common import documents, pieces, store

UNKNOWN = "und"
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
CHUNK_CHARS = 300_000

#: Bound of the training sample, in documents over all languages; each language gets an equal share, at least one.
SAMPLE_DOCS = 1200
#: Weights of a model. Where BUCKETS for each language would be more, n-grams share fewer buckets.
WEIGHTS = BUCKETS * 400

_NO_LETTER = re.compile(r"[\W\d_]+")
_M1, _M2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)


def clean(text: str) -> str:
    """Lower case; each run of other signs than letters is one blank; empty without letters."""
    words = _NO_LETTER.sub(" ", text.lower()).strip()
    return f" {words} " if words else ""


def gram_buckets(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Buckets of the n-grams of each order that start at each character of the joined texts, and the texts' ends."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    out, rolled = [], np.zeros(len(points), np.uint32)
    for n in ORDERS:
        m = max(0, len(points) - n + 1)
        rolled = (rolled[:m] * _M1) ^ (points[n - 1 :] + np.uint32(n)) * _M2
        mixed = rolled ^ (rolled >> np.uint32(15))
        out.append(((mixed * _M2) >> np.uint32(16)).astype(np.int64))
    return out, np.cumsum([len(t) for t in texts])


def _chunks(texts: list[str]):
    begin = held = 0
    for i, t in enumerate(texts):
        if i > begin and held + len(t) > CHUNK_CHARS:
            yield begin, texts[begin:i]
            begin, held = i, 0
        held += len(t)
    if begin < len(texts):
        yield begin, texts[begin:]


def buckets_for(languages: int) -> int:
    """Buckets of a model, a power of two: all of them, or as many as WEIGHTS leaves to each of very many languages."""
    return min(BUCKETS, 1 << max(0, (WEIGHTS // max(1, languages)).bit_length() - 1))


def _each_document(texts: list[str], buckets: int = BUCKETS):
    """Index and n-gram buckets of each text that has letters."""
    for begin, part in _chunks(texts):
        cleaned = [clean(t) for t in part]
        grams, ends = gram_buckets(cleaned)
        for i, (end, t) in enumerate(zip(ends.tolist(), cleaned)):
            if t:
                start = end - len(t)
                yield begin + i, np.concatenate([g[start : end - n + 1] for n, g in zip(ORDERS, grams)]) & (buckets - 1)


# ------------------------------------------------------------------------------------------------------------ training


def document_frequencies(train: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Documents that hold each bucket, over all rows of train(text); the result is as long as `buckets` at any size."""

    def run(batches):
        counts = np.zeros(buckets, np.int64)
        docs = 0
        seen = np.zeros(buckets, bool)
        for batch in pieces(batches):
            for _, grams in _each_document(batch.column("text").to_pylist(), buckets):
                seen[:] = False
                seen[grams] = True
                counts += seen
                docs += 1
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(there, -1), pa.int32()), pa.array(np.append(counts[there], docs), pa.int64())], ["bucket", "docs"]
        )

    rows = train.select("text").mapInArrow(run, "bucket int, docs bigint").groupBy("bucket").agg(F.sum("docs").alias("docs")).collect()
    out = np.zeros(buckets + 1, np.int64)
    for r in rows:
        out[r["bucket"]] = r["docs"]  # the number of all documents stands last
    return out


def inverse_frequencies(counts: np.ndarray) -> np.ndarray:
    return (np.log((1 + counts[-1]) / (1 + counts[:-1])) + 1).astype(np.float32)


@dataclass
class Example:
    lang: str
    index: np.ndarray
    share: np.ndarray  # of the n-grams of the document, by bucket


def training_sample(train: DataFrame, size: int = SAMPLE_DOCS) -> tuple[list[Example], int]:
    """At most `size` documents of train(doc_id, text, lang), the same number of each language, and the buckets they use.

    Documents are drawn by hash of the id, those without an id by hash of the text. Each task passes on no more than a
    language's share. With more than `size` languages each has one document.
    """
    languages = train.select("lang").distinct().count()
    if not languages:
        return [], BUCKETS
    share = max(1, size // languages)
    buckets = buckets_for(languages)
    keyed = train.withColumn("key", F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit(17))).otherwise(F.xxhash64("doc_id", F.lit(17))))
    order = Window.partitionBy("lang").orderBy("key", "doc_id")
    ids = (
        keyed.select("key", "doc_id", "lang").withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= share).select("key", "lang").distinct()
    )
    chosen = store(ids, "sample-ids")
    texts = keyed.join(F.broadcast(chosen), ["key", "lang"], "left_semi").groupBy("key", "lang").agg(F.min("text").alias("text"))

    def run(batches):
        for batch in pieces(batches):
            langs = batch.column("lang").to_pylist()
            for i, grams in _each_document(batch.column("text").to_pylist(), buckets):
                index, count = np.unique(grams, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([langs[i]]),
                        pa.array([index.astype("<u2").tobytes()]),
                        pa.array([(count / len(grams)).astype("<f4").tobytes()]),
                    ],
                    ["lang", "index", "share"],
                )

    rows = texts.mapInArrow(run, "lang string, index binary, share binary").collect()
    examples = [Example(r["lang"], np.frombuffer(r["index"], "<u2").astype(np.int64), np.frombuffer(r["share"], "<f4")) for r in rows]
    # Rows arrive in any order; training should not depend on it.
    return sorted(examples, key=lambda e: (e.lang, len(e.index), e.index.tobytes(), e.share.tobytes())), buckets


class Ftrl:
    """Per-coordinate proximal updates; l1 keeps weights at zero, l2 shrinks the others."""

    def __init__(self, classes: int, alpha: float = 1.0, beta: float = 0.1, l1: float = 0.02, l2: float = 0.002, buckets: int = BUCKETS):
        self.z = np.zeros((buckets, classes))
        self.n = np.zeros((buckets, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def step(self, index: np.ndarray, x: np.ndarray, target: int) -> None:
        w = self.weights(index)
        p = softmax(x @ w)
        p[target] -= 1
        g = np.outer(x, p)
        n = self.n[index]
        grown = n + g * g
        self.z[index] += g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[index] = grown


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(scores: np.ndarray, targets: np.ndarray) -> float:
    """Least negative log-likelihood of scores / T, by golden-section search over log T.

    The targets are smoothed as if one more text of each class had been judged wrongly, so that few texts without an error
    don't make every score certain.
    """
    classes = scores.shape[1]
    doubt = classes / (len(targets) + classes)

    def loss(log_t: float) -> float:
        p = np.log(np.maximum(softmax(scores / np.exp(log_t)), 1e-12))
        return -float(((1 - doubt) * p[np.arange(len(targets)), targets] + doubt * p.mean(axis=1)).mean())

    low, high, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    while high - low > 1e-3:
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


#: TF-IDF shares are small numbers; one factor brings scores to the size that the penalties are stated for.
SCALE = 30.0


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x languages, with IDF, scale and temperature in them

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of texts with letters, and which texts those are."""
        cleaned = [clean(t) for t in texts]
        there = np.array([bool(t) for t in cleaned])
        kept = [t for t in cleaned if t]
        total = np.zeros((len(kept), len(self.languages)))
        if kept:
            grams, ends = gram_buckets(kept)
            starts = np.concatenate([[0], ends[:-1]])
            number = np.zeros(len(kept))
            for n, g in zip(ORDERS, grams):
                # Every second stretch is a text's, from its first n-gram to its last one.
                cuts = np.stack([starts, ends - n + 1], axis=1).ravel()
                padded = np.concatenate([self.weights[g & (len(self.weights) - 1)], np.zeros((n, len(self.languages)), np.float32)])
                total += np.add.reduceat(padded, cuts, axis=0)[::2]
                number += ends - starts - n + 1
            total /= number[:, None]
        return total, there


def train_model(train: DataFrame, size: int = SAMPLE_DOCS, epochs: int = 6) -> Model:
    """Fit on train(doc_id, text, lang): document frequencies over all its rows, weights on the bounded sample."""
    train = train.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    examples, buckets = training_sample(train, size)
    languages = sorted({e.lang for e in examples})
    if not languages:
        return Model([], np.zeros((buckets, 0), np.float32))
    idf = inverse_frequencies(document_frequencies(train, buckets))
    rng = np.random.default_rng(5)
    order = rng.permutation(len(examples))
    # A fifth is kept from training for the temperature, where there is enough.
    held = order[: len(order) // 5] if len(order) >= 20 * len(languages) else order[:0]
    fitted = order[len(held) :]
    number = {lang: i for i, lang in enumerate(languages)}
    data = [(e.index, SCALE * idf[e.index] * e.share, number[e.lang]) for e in examples]
    learner = Ftrl(len(languages), buckets=buckets)
    for _ in range(epochs):
        for i in rng.permutation(fitted):
            learner.step(*data[i])
    w = learner.weights()
    t = 1.0
    if len(held):
        scores = np.stack([data[i][1] @ w[data[i][0]] for i in held])
        t = temperature(scores, np.array([data[i][2] for i in held]))
    return Model(languages, (w * (SCALE / t) * idf[:, None]).astype(np.float32))


# ---------------------------------------------------------------------------------------------------------- prediction


def predict(docs: DataFrame, model: Model, name: str = "_lid") -> DataFrame:
    """Every column of docs and `name`, a struct of lang_pred, score (calibrated probability of lang_pred) and margin.

    The margin is how far the score lies on the way from chance, 1 / languages, to 1. With one language it is 1.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, margin double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        given = ["" if t is None else t for t in texts]
        langs = np.full(len(given), UNKNOWN, object)
        best, margin = np.zeros(len(given)), np.zeros(len(given))
        chance = 1 / max(1, len(m.languages))
        for begin, part in _chunks(given):
            scores, there = m.scores(part)
            if m.languages and there.any():
                p = softmax(scores)
                at = begin + np.flatnonzero(there)
                langs[at] = np.array(m.languages, object)[p.argmax(axis=1)]
                best[at] = p.max(axis=1)
                margin[at] = (best[at] - chance) / (1 - chance) if chance < 1 else 1.0
        return pd.DataFrame({"lang_pred": langs, "score": best, "margin": margin})

    return docs.withColumn(name, judge(F.col("text").cast("string")))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, size: int = SAMPLE_DOCS, name: str = "_lid") -> DataFrame:
    """Learn from the rows of docs(doc_id, text, lang) that are not held out and predict every row.

    Text that is null or has no letters is `und` with score 0, and so is everything when no row has text and language.
    Rows with a null doc_id are not held out and are learned as well. Any number of languages is learned. Rows that repeat
    are judged alike. Ties go to the first language by name. An empty table gives no rows; further columns pass through
    unread.
    """
    train = docs.filter(~held_out(F.col("doc_id"))).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )
    return predict(docs, train_model(train, size), name)


def op2_language_id(spark, sf_dir):
    judged = identify(documents(spark, sf_dir).select("doc_id", "text", "lang"))
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "_lid.lang_pred", "_lid.score")
