"""Quality from weak labels: overlapping heuristics vote, expectation-maximisation finds how far each can be trusted, and
the posterior labels train a hashed linear scorer.

Dawid and Skene, "Maximum likelihood estimation of observer error-rates using the EM algorithm" (1979); Ratner et al.,
"Data Programming" (2016). Votes: 1 good, 0 bad, 2 abstains.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repetition import SYMBOLS
from .shared import blocks, map_texts

FEATURES = 1 << 16
#: Documents that the scorer learns from, at most and on average; votes are counted over all.
SAMPLE = 12_000
ROUNDS, STEPS, RATE, DECAY = 60, 200, 0.05, 1e-5
_CACHE = 400_000
_MARKS = tuple(bytes([b]) for b in SYMBOLS)
_NO_LETTER = bytes(b for b in range(128) if not chr(b).isalnum())
_NO_CASE = bytes(b for b in range(256) if not chr(b).isascii() or not chr(b).isalpha())
_NOT_MARKS = bytes(b for b in range(256) if b >= 128 or chr(b).isalnum() or chr(b).isspace())
_RUN = re.compile(r"(.)\1+")
_shapes: dict[bytes, int] = {}


def _three(bad: bool, good: bool) -> int:
    return 0 if bad else 1 if good else 2


def measures(text: str | None) -> dict[str, float]:
    data = (text or "").encode("utf-8", "surrogatepass")
    n = again = ends = shouts = chars = bare = marked = 0
    seen: set[bytes] = set()
    last = b""
    for block in blocks(data):
        words = block.split()
        n += len(words)
        seen.update(words)
        again += sum(map(bytes.__eq__, words, [last, *words[:-1]]))
        last = words[-1] if words else last
        chars += sum(map(len, words))
        ends += sum(w.endswith((b".", b"?", b"!")) for w in words)
        shouts += sum(w.endswith(b"!!") for w in words)
        marked += sum(w.endswith(_MARKS) for w in words)
        bare += sum(not w.strip(_NO_LETTER) for w in words)
    distinct = len(seen)
    letters = data.translate(None, _NO_CASE)
    other = len(data.translate(None, _NOT_MARKS))
    upper = len(letters) - len(letters.translate(None, bytes(range(65, 91))))
    lines = [x for x in data.split(b"\n") if x.strip()]
    some = max(n, 1)
    return {
        "words": n, "symbols": (len(data) - len(data.translate(None, SYMBOLS))) / some, "upper": upper / max(len(letters), 1), "distinct": distinct / some ** 0.75,
        "again": again / some, "ends": ends / some, "shouts": shouts / some, "length": chars / some, "marked": marked / some, "bare": bare / some, "other": other / max(chars, 1), "lines": 1 - len(set(lines)) / max(len(lines), 1),
    }


def votes(m: dict[str, float]) -> list[int]:
    """One vote for each heuristic. They overlap on purpose: shouting, say, shows in capitals, in marks and in sentence
    ends."""
    none = m["words"] == 0
    return [
        _three(m["words"] < 5, m["words"] >= 20),
        2 if none else _three(m["symbols"] > 0.2, m["symbols"] < 0.05),
        2 if none else _three(m["upper"] > 0.5, m["upper"] < 0.2),
        2 if m["words"] < 40 else _three(m["distinct"] < 0.5, m["distinct"] > 1.0),
        2 if m["words"] < 10 else _three(m["again"] > 0.15, m["again"] < 0.05),
        2 if m["words"] < 40 else _three(m["ends"] < 0.005 or m["ends"] > 0.5, 0.02 < m["ends"] < 0.3),
        2 if none else _three(m["shouts"] > 0.2, m["shouts"] < 0.02),
        2 if none else _three(m["length"] > 20 or m["length"] < 2, 3 <= m["length"] <= 12),
        2 if none else _three(m["marked"] > 0.2, m["marked"] < 0.05),
        2 if none else _three(m["bare"] > 0.2, m["bare"] < 0.1),
        2 if none else _three(m["other"] > 0.12, m["other"] < 0.06),
        2 if m["words"] < 40 else _three(m["lines"] > 0.5, m["lines"] < 0.2),
    ]


LABELLERS = len(votes(measures("")))


def label_model(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of good for each pattern, P(vote | class, no abstention) as labellers x 2 x 2) by
    expectation-maximisation. An abstention says nothing about the class."""
    said_good, said_bad = (patterns == 1).sum(1), (patterns == 0).sum(1)
    good = np.clip((said_good - 2.0 * said_bad) / np.maximum(said_good + said_bad, 1) * 0.45 + 0.5, 0.05, 0.95)
    table = np.zeros((patterns.shape[1], 2, 2))
    for _ in range(ROUNDS):
        for c, weight in enumerate((counts * (1 - good), counts * good)):
            for v in range(2):
                table[:, c, v] = ((patterns == v) * weight[:, None]).sum(0) + 1.0
        table /= table.sum(2, keepdims=True)
        share = np.clip((counts * good).sum() / max(counts.sum(), 1), 0.02, 0.98)
        logs = np.zeros((2, len(patterns)))
        for j in range(patterns.shape[1]):
            said = patterns[:, j]
            logs += np.where(said == 2, 0.0, np.log(table[j][:, np.minimum(said, 1)]))
        logs += np.log([1 - share, share])[:, None]
        good = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
    return good, table


def _shape(word: bytes) -> int:
    """The number of a word's outline: runs of capitals, small letters and digits become one sign, other marks stay."""
    text = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word.decode("utf-8", "replace"))
    got = xxhash.xxh3_64_intdigest(_RUN.sub(r"\1", text)[:32].encode()) & (FEATURES - 1)
    if len(_shapes) >= _CACHE:
        _shapes.clear()
    if len(word) <= 64:
        _shapes[word] = got
    return got


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed outlines of words, of pairs of words, and of words that repeat the one before, with their shares."""
    total = np.zeros(FEATURES, np.int32)
    n = 0
    for block in blocks((text or "").encode("utf-8", "surrogatepass")):
        words = block.split()
        ids = np.array([_shape(w) if (g := _shapes.get(w)) is None else g for w in words], np.int64)
        pairs = (ids[:-1] * 31 + ids[1:] * 17 + 7) & (FEATURES - 1)
        total += np.bincount(ids, minlength=FEATURES).astype(np.int32) + np.bincount(pairs, minlength=FEATURES).astype(np.int32)
        total[1] += sum(map(bytes.__eq__, words[1:], words))
        n += len(words)
    if not n:
        return np.array([0], np.int32), np.array([1.0], np.float32)
    at = np.flatnonzero(total)
    return at.astype(np.int32), (total[at] / n).astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels."""
    sizes = np.array([len(r[0]) for r in rows])
    at, value, doc = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.repeat(np.arange(len(rows)), sizes)
    theta, moment, spread = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)
    for turn in range(1, STEPS + 1):
        z = np.bincount(doc, theta[at] * value, len(rows)) + theta[-1]
        slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(rows)
        grad = np.append(np.bincount(at, slope[doc] * value, FEATURES) + DECAY * theta[:-1], slope.sum())
        moment += 0.1 * (grad - moment)
        spread += 0.001 * (grad * grad - spread)
        theta -= RATE * (moment / (1 - 0.9 ** turn)) / (np.sqrt(spread / (1 - 0.999 ** turn)) + 1e-8)
    return theta[:-1].astype(np.float32), float(theta[-1])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, votes, posterior (label model), score (scorer), kept (score of 0.5 or more).

    Votes of all documents are counted by pattern, of which there are at most 3 ** LABELLERS, and the label model is
    fitted on these counts. The scorer learns from a hash sample of about ``SAMPLE`` whole texts in one task and scores
    every text whole. Null and empty texts have one feature of their own and are judged like others; repeated rows are
    judged one by one, ids may be null, an empty table gives no rows, other columns are not read.
    """
    def vote(texts):
        return [["".join(map(str, votes(measures(t)))) for t in texts]]

    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counts = map_texts(given, vote, "votes string").groupBy("votes").agg(F.count("*").alias("n")).collect()
    patterns = sorted((r.votes, r.n) for r in counts)
    table = np.array([[int(c) for c in p] for p, _ in patterns], int).reshape(len(patterns), LABELLERS)
    posterior, _ = label_model(table, np.array([n for _, n in patterns], float))
    told = docs.sparkSession.sparkContext.broadcast({p: float(g) for (p, _), g in zip(patterns, posterior)})

    total = sum(n for _, n in patterns)
    unit = F.pmod(F.xxhash64(F.lit("quality"), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    chosen = given.filter(unit < min(1.0, SAMPLE / max(total, 1)))

    def example(texts):
        found = [features(t) for t in texts]
        return [[f[0].tobytes() for f in found], [f[1].tobytes() for f in found], [told.value.get(v, 0.5) for v in vote(texts)[0]]]

    rows = map_texts(chosen, example, "at binary, share binary, target double")

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["target", "at", "share"])
        weights, bias = train([(np.frombuffer(a, np.int32), np.frombuffer(s, np.float32)) for a, s in zip(group["at"], group["share"])], group["target"].to_numpy())
        return pd.DataFrame({"weights": [weights.tobytes()], "bias": [bias]})

    fitted = rows.select("at", "share", "target", F.lit(0).alias("one")).groupBy("one").applyInPandas(learn, "weights binary, bias double").first()
    model = (np.frombuffer(fitted.weights, np.float32), fitted.bias) if fitted else (np.zeros(FEATURES, np.float32), 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts):
        weights, bias = shared.value
        said = vote(texts)[0]
        scores = []
        for t in texts:
            at, share = features(t)
            z = bias + float((weights[at] * share).sum())
            scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        return [said, [told.value.get(v, 0.5) for v in said], scores, [s >= 0.5 for s in scores]]

    return map_texts(given, work, "votes string, posterior double, score double, kept boolean")
