"""Toxicity by non-negative positive-unlabelled learning.

Kiryo, Niu, du Plessis and Sugiyama, "Positive-Unlabeled Learning with Non-Negative Risk Estimator" (2017): with class
prior p, the risk of a scorer is p * R(positives as positive) + max(0, R(unlabelled as negative) - p * R(positives as
negative)); where the second part turns negative, the step goes the other way. Labels of clean texts are never read as
such: they only count towards the prior, and unlabelled texts are drawn from all texts, labelled or not.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontaminate import LETTERS
from .shared import blocks, map_texts

FEATURES = 1 << 18
PREFIXES = (4, 5, 6)
#: Classifiers; documents in the sample, at most and on average: confirmed toxic ones and any others; the share of the
#: sample that each classifier draws.
MODELS, POSITIVES, UNLABELLED, DRAW = 4, 4_000, 16_000, 0.8
#: A feature counts if its share of the positives lies so many standard errors above its share of the unlabelled texts.
LIFT = 5.0
PASSES, RATE, DECAY = 400, 0.1, 5e-5
_CACHE = 400_000
_live: dict[int, dict[bytes, tuple[int, ...]]] = {}


def _parts(word: bytes) -> list[int]:
    """Features of a word: itself and its beginnings."""
    text = word.decode("utf-8", "replace")
    parts = {text, *(f"{text[:n]}*" for n in PREFIXES if len(text) >= n)}
    return [xxhash.xxh3_64_intdigest(p.encode()) & (FEATURES - 1) for p in parts]


def _live_words(model: int) -> dict[bytes, tuple[int, ...]]:
    """A worker's cache, for one model, of the features of words that have a weight."""
    if model not in _live:
        _live.clear()
        _live[model] = {}
    return _live[model]


def features(text: str | None) -> np.ndarray:
    """Sorted hashed numbers of the words and word beginnings that the whole text has."""
    words: set[bytes] = set()
    for block in blocks((text or "").lower().encode("utf-8", "surrogatepass").translate(LETTERS)):
        words.update(block.split())
    found: set[int] = set()
    for w in words:
        found.update(_parts(w))
    return np.array(sorted(found), np.int32)


def _scores(weights: np.ndarray, docs: list[np.ndarray]) -> np.ndarray:
    ends = np.cumsum([len(d) for d in docs])
    sums = np.concatenate([[0.0], np.cumsum(weights[np.concatenate(docs)] if len(docs) and ends[-1] else np.zeros(0))])
    return sums[ends] - sums[ends - [len(d) for d in docs]]


def train(positives: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear scorer that minimises the non-negative risk under the sigmoid loss."""
    rng = np.random.default_rng(seed)
    share = [np.bincount(np.concatenate(docs), minlength=FEATURES) / len(docs) for docs in (positives, unlabelled)]
    mean = (share[0] * len(positives) + share[1] * len(unlabelled)) / (len(positives) + len(unlabelled))
    error = np.sqrt(np.maximum(mean * (1 - mean), 1e-12) * (1 / len(positives) + 1 / len(unlabelled)))
    use = share[0] - share[1] > LIFT * error
    number = np.cumsum(use) - 1
    pos, unl = ([number[d[use[d]]] for d in docs] for docs in (positives, unlabelled))
    theta = rng.normal(0, 0.01, int(use.sum()) + 1)
    theta[-1] = -1.0
    moment, spread = np.zeros_like(theta), np.zeros_like(theta)

    def sigmoid(z):
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def back(docs, slope):
        flat = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        grad = np.bincount(flat, np.repeat(slope, [len(d) for d in docs]), len(theta)).astype(float)
        grad[-1] += slope.sum()
        return grad

    for turn in range(1, PASSES + 1):
        p, u = sigmoid(_scores(theta[:-1], pos) + theta[-1]), sigmoid(_scores(theta[:-1], unl) + theta[-1])
        negative = u.mean() - prior * p.mean()  # sigmoid loss, bounded: a hidden toxic text weighs no more than a clean one
        slope_p, slope_u = p * (1 - p) / len(pos), u * (1 - u) / len(unl)
        if negative >= 0:
            grad = back(unl, slope_u) - back(pos, 2 * prior * slope_p)
        else:  # the estimate of the clean part fell below nought: step back from it
            grad = back(pos, prior * slope_p) - back(unl, slope_u)
        grad[:-1] += DECAY * theta[:-1]
        moment += 0.1 * (grad - moment)
        spread += 0.001 * (grad * grad - spread)
        theta -= RATE * (moment / (1 - 0.9 ** turn)) / (np.sqrt(spread / (1 - 0.999 ** turn)) + 1e-10)
    weights, bias = np.zeros(FEATURES), theta[-1]
    weights[use] = theta[:-1]
    return weights.astype(np.float32), float(bias)


def _sample(ids: DataFrame, bound: int, salt: str) -> DataFrame:
    """About ``bound`` ids at most, drawn evenly by hash."""
    n = ids.count()
    unit = F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return ids.filter(unit < min(1.0, bound / max(n, 1)))


def fit(docs: DataFrame, labels: DataFrame, learn=None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, float]:
    """Weights and bias, the mean of ``MODELS`` linear scorers that learn side by side, each in a task of its own.

    ``learn`` is a condition on the id (as ``doc_id``) that rows must meet to be learnt from. The sample is bounded by
    ``POSITIVES + UNLABELLED`` whole texts, as hashed features; ids of the sample, and one row of weights for each classifier,
    are all that is broadcast or collected. Without a confirmed toxic text the score is the prior.
    """
    learn = F.lit(True) if learn is None else learn
    told = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull()).filter(learn)
    prior = told.agg(F.avg((F.col("y") == 1).cast("double"))).first()[0] or 0.0
    prior = min(max(prior, 1e-6), 1 - 1e-6)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("doc_id").isNotNull()).filter(learn)
    positive = _sample(told.filter("y = 1").select("doc_id").distinct(), POSITIVES, "positive").withColumn("toxic", F.lit(True))
    other = _sample(texts.select("doc_id"), UNLABELLED, "unlabelled").distinct().withColumn("toxic", F.lit(False))
    chosen = texts.join(F.broadcast(positive.unionByName(other)), "doc_id")

    def encoded(batches):
        for batch in batches:
            found = [features(t).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(found, pa.binary())], ["doc_id", "toxic", "found"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = chosen.select("text", "doc_id", "toxic").mapInArrow(encoded, f"doc_id {kind}, toxic boolean, found binary")
    rows = rows.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(MODELS - 1))))

    def learn_one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["toxic", "doc_id"])
        sides = [[np.frombuffer(f, np.int32) for f in group.found[group.toxic == t]] for t in (True, False)]
        if not sides[0] or not sides[1] or not sum(map(len, sides[0])):
            return pd.DataFrame({"weights": [], "bias": []})
        seed = int(group.model.iloc[0])
        rng = np.random.default_rng(seed)
        sides = [[s[i] for i in rng.permutation(len(s))[: math.ceil(DRAW * len(s))]] for s in sides]
        weights, bias = train(*sides, prior, seed)
        return pd.DataFrame({"weights": [weights.tobytes()], "bias": [bias]})

    models = rows.groupBy("model").applyInPandas(learn_one, "weights binary, bias double").collect()
    if not models:
        return np.zeros(FEATURES, np.float32), float(np.log(prior / (1 - prior)))
    return np.mean([np.frombuffer(m.weights, np.float32) for m in models], axis=0), float(np.mean([m.bias for m in models]))


def score(docs: DataFrame, weights: np.ndarray, bias: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row; null and empty texts get the score of a text without features.

    The whole text counts, whatever its length. Repeated rows are scored one by one, ids may be null, an empty table
    gives no rows, other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast((np.asarray(weights, np.float32), float(bias)))
    number = hash((np.asarray(weights, np.float32).tobytes(), float(bias)))

    def work(texts):
        w, b = model.value
        live, out = _live_words(number), []
        for text in texts:
            words: set[bytes] = set()
            for block in blocks((text or "").lower().encode("utf-8", "surrogatepass").translate(LETTERS)):
                words.update(block.split())
            found: set[int] = set()
            for word in words:
                got = live.get(word)
                if got is None:
                    got = tuple(f for f in _parts(word) if w[f])
                    if len(live) >= _CACHE:
                        live.clear()
                    live[word] = got
                if got:
                    found.update(got)
            z = b + float(w[sorted(found)].sum()) if found else b
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        return [out]

    return map_texts(docs, work, "score double", id_col, text_col)
