"""Near-duplicate documents by SetSketch registers, banded, estimated jointly by likelihood, then verified on full sets.

Ertl, "SetSketch: Filling the Gap between MinHash and HyperLogLog" (2021): a register holds the truncated, exponentially
spaced minimum of hashed elements; registers of two sets merge by maximum, and their equality follows the sets' overlap.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import map_texts, stored

#: Registers in a band and bands. At a similarity of 0.8 a register is equal with probability 0.808, so a link is
#: missed with probability (1 - 0.808 ** 6) ** 48 < 2e-7.
BAND, BANDS = 6, 48
BASE = 1.1
_TOP = 8.0
#: Rounds in which members of a bucket meet its best linked member before the rest meet one another.
STARS = 1
#: A target with so few members is compared pair by pair; a larger one in blocks of so many rows.
SMALL, BLOCK = 16, 128
#: Loss of log likelihood at the wanted similarity beyond which a candidate is left out before the exact check.
UNLIKELY = 18.0
_STEP = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20210101)
_MULTIPLIER = _rng.integers(0, 1 << 31, BAND * BANDS, np.uint32) * np.uint32(2) + np.uint32(1)
_OFFSET = _rng.integers(0, 1 << 32, BAND * BANDS, np.uint32)
_ROWS = 1024


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``k`` words, A-Z in lower case; fewer words are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    rolled = one
    for n in range(1, k):
        rolled = rolled[:-1] * _STEP + one[n:]
    return np.unique(_mix(rolled))


def registers(hashes: np.ndarray) -> np.ndarray:
    """Truncated minima as exponents of ``BASE``; larger means a smaller minimum, so sketches merge by maximum."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)[:, None]
    low = np.full(len(_MULTIPLIER), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), _ROWS):
        np.minimum(low, (x[at: at + _ROWS] * _MULTIPLIER + _OFFSET).min(axis=0), out=low)
    share = (low.astype(np.float64) + 1) / 4294967297.0
    value = np.floor(1 - np.log(-np.log1p(-share) / _TOP) / math.log(BASE))
    return np.clip(value, 0, 255).astype(np.uint8)


def sketches(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, a 128-bit fingerprint of the whole set as two longs, registers (null for empty sets)."""
    def work(texts):
        out = []
        for text in texts:
            h = shingles(text, k)
            if len(h):
                f = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64)
                out.append((len(h), int(f[0]), int(f[1]), registers(h).tobytes()))
            else:
                out.append((0, None, None, None))
        return list(zip(*out)) if out else [[]] * 4

    return map_texts(docs, work, "n_shingles long, f1 long, f2 long, registers binary", id_col, text_col)


def similar_enough(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, wanted: float) -> np.ndarray:
    """Rows of registers whose likelihood, given both set sizes, does not rule out the wanted similarity."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - more - less
    u = (na / (na + nb))[:, None]
    v = 1 - u
    most = np.minimum(u / v, v / u)

    def p(x):
        return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / math.log(BASE)

    def loglik(j):
        up, down = p(u - v * j), p(v - u * j)
        return more * np.log(up) + less * np.log(down) + same * np.log(np.clip(1 - up - down, 1e-300, 1))

    grid = most * np.linspace(0, 1, 101)[None, :]
    values = loglik(grid)
    best = grid[np.arange(len(grid)), values.argmax(1)]
    floor = np.minimum(wanted, most)
    near = (best >= wanted) | (values.max(1) - loglik(floor)[:, 0] <= UNLIKELY)
    return near & (most[:, 0] >= wanted - 1e-9)


def _likely(pairs: DataFrame, reps: DataFrame, wanted: float) -> DataFrame:
    """Pairs (x, y) that the sketches do not rule out."""
    def side(name):
        return reps.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("registers").alias(f"r_{name}"))

    both = pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "n_x", "n_y", "r_x", "r_y")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (4, 5))
            na, nb = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array(similar_enough(a, b, na, nb, wanted)))

    return both.mapInArrow(run, pairs.schema).distinct()


def _linked(pairs: DataFrame, texts: DataFrame, k: int, wanted: float) -> DataFrame:
    """Pairs whose full sets reach the wanted similarity; text moves, its sets are built where the pair meets."""
    tops = round(100 * wanted)

    def side(name):
        return texts.select(F.col("node").alias(name), F.col("text").alias(f"t_{name}"))

    both = pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "t_x", "t_y")

    def run(batches):
        last: tuple = (None, None)
        for batch in batches:
            keep = []
            for tx, ty in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if last[0] != ty:
                    last = (ty, shingles(ty, k))
                a, b = shingles(tx, k), last[1]
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= tops * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, pairs.schema)


def _pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).distinct()


def _inside(shared: DataFrame, joined: DataFrame, links: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, with their component and number of links."""
    degree = links.select(F.explode(F.array("x", "y")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    rows = shared.select("key", "node", "n").join(joined.join(degree, "node"), "node", "left").withColumns(
        {"component": F.coalesce("component", "node"), "d": F.coalesce("d", F.lit(0))})
    split = rows.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("key")
    return stored(rows.join(split, "key", "left_semi"), "inside")


def _central(inside: DataFrame) -> DataFrame:
    """Each member of a bucket against the bucket's member with most links, where their components differ."""
    hub = inside.groupBy("key").agg(F.max(F.struct("d", F.col("node").alias("hub"), F.col("component").alias("c"))).alias("m"))
    hub = hub.filter("m.d > 0").select("key", "m.hub", "m.c")
    return _pairs(inside.join(hub, "key").filter("component <> c"), "node", "hub")


def _crossing(inside: DataFrame, final: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left to compare, as (target, node) rows of queries and of members. In each bucket, those outside its
    largest component are queries to the whole of that component, and to one another."""
    sizes = inside.groupBy("key", "component").agg(F.count("*").alias("c"))
    main = sizes.groupBy("key").agg(F.max(F.struct("c", "component")).alias("m"), F.count("*").alias("parts")).select(
        "key", F.col("m.component").alias("main"), "parts")
    outer = inside.join(main, "key").filter("component <> main")
    named = F.concat(F.lit("c"), F.col("main").cast("string"))
    to_main = outer.select(named.alias("target"), "main", "node").distinct()
    whole = final.select("node", "component").unionByName(inside.select("node", "component")).distinct()
    of_main = to_main.select("target", "main").distinct().join(whole, F.col("main") == F.col("component")).select("target", "node")
    among = outer.filter("parts > 2").select(F.concat(F.lit("b"), F.col("key").cast("string")).alias("target"), "node")
    return to_main.select("target", "node").unionByName(among), of_main.unionByName(among)


def _compared(queries: DataFrame, members: DataFrame, reps: DataFrame, texts: DataFrame, k: int, wanted: float) -> DataFrame:
    """Links between each target's queries and members. Small targets become pairs; large ones are compared block by
    block inside tasks, so that nothing but links comes out and no task holds more than two blocks."""
    a = queries.groupBy("target").agg(F.count("*").alias("q"))
    b = members.groupBy("target").agg(F.count("*").alias("m"))
    sizes = stored(a.join(b, "target"), "targets")
    few = F.col("m") <= SMALL
    small, large = sizes.filter(few).select("target"), sizes.filter(~few)

    asked, held = (d.join(small, "target", "left_semi") for d in (queries, members))
    pairs = asked.withColumnRenamed("node", "a").join(held.withColumnRenamed("node", "b"), "target").filter("a <> b")
    links = _linked(_likely(_pairs(pairs, "a", "b"), reps, wanted), texts, k, wanted)

    cuts = large.select("target", F.ceil(F.col("q") / BLOCK).cast("int").alias("qs"), F.ceil(F.col("m") / BLOCK).cast("int").alias("ms"))
    spot = F.xxhash64("node")
    asked = queries.join(cuts, "target").select(
        "target", "node", F.pmod(spot, "qs").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("ms") - 1)).alias("mb"), F.lit(True).alias("asks"))
    held = members.join(cuts, "target").select(
        "target", "node", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("qb"), F.pmod(spot, "ms").alias("mb"), F.lit(False).alias("asks"))
    rows = asked.withColumn("qb", F.col("qb").cast("int")).unionByName(held.withColumn("mb", F.col("mb").cast("int")))
    rows = rows.join(texts.join(reps, "node"), "node")
    tops = round(100 * wanted)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        q, m = group[group.asks], group[~group.asks]
        sets = [[shingles(t, k) for t in side.text] for side in (q, m)]
        regs = [np.frombuffer(b"".join(side.registers), np.uint8).reshape(len(side), BAND * BANDS) for side in (q, m)]
        ids = [side.node.tolist() for side in (q, m)]
        found = []
        for i in range(len(q)):
            near = similar_enough(np.broadcast_to(regs[0][i], regs[1].shape), regs[1], np.full(len(m), float(q.n.iloc[i])), m.n.to_numpy(float), wanted)
            for j in np.flatnonzero(near):
                if ids[0][i] == ids[1][j]:
                    continue
                one, two = sets[0][i], sets[1][j]
                both = len(np.intersect1d(one, two, assume_unique=True))
                if 100 * both >= tops * (len(one) + len(two) - both):
                    found.append((max(ids[0][i], ids[1][j]), min(ids[0][i], ids[1][j])))
        return pd.DataFrame(found, columns=["x", "y"])

    return links.unionByName(rows.groupBy("target", "qb", "mb").applyInPandas(run, links.schema))


def near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept.

    Documents with equal shingle sets are one class from the start. Bands of registers that several classes share make
    buckets. First every class is compared with its bucket's least class, then with its bucket's best linked class while
    that finds links; then, in buckets that still hold several components, those outside the bucket's largest component
    are compared with that component and with one another, large ones block by block inside tasks. Pairs that already
    hang together are not compared again, so a group of near copies costs about its size, and no link between
    components is left out. Candidates pass the joint likelihood of their registers and are confirmed on full
    sets; ``similarity`` is a whole percentage.

    Documents without words or text link with nothing and are kept. A row with a null id is kept and has a null
    component. Rows that repeat an id are one document. An empty table gives no rows; other columns are not read.
    """
    wanted = similarity
    sk = stored(sketches(docs, k, id_col, text_col), "sketches")
    named = sk.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = named.groupBy("f1", "f2").agg(F.min("doc_id").alias("node"))
    members = stored(
        sk.join(nodes, ["f1", "f2"], "left").select(
            "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id")).alias("node"),
            F.when(F.col("doc_id") == F.col("node"), F.col("registers")).alias("registers")), "members")
    reps = members.filter("registers IS NOT NULL").select("node", F.col("n_shingles").alias("n"), "registers")
    band = F.array(*(F.xxhash64(F.lit(i), F.substring("registers", BAND * i + 1, BAND)) for i in range(BANDS)))
    bands = reps.select(F.explode(band).alias("key"), "node", "n")
    hubs = bands.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).filter("hub <> top").drop("top")
    shared = stored(bands.join(hubs, "key"), "bands")

    met = shared.select("node").distinct()
    texts = stored(
        docs.select(F.col(id_col).alias("node"), F.col(text_col).alias("text")).join(met, "node", "left_semi"), "texts")

    pairs = _pairs(shared.filter("node <> hub"), "node", "hub")
    links = stored(_linked(_likely(pairs, reps, wanted), texts, k, wanted), "links")
    final = components(links.select(F.col("x").alias("u"), F.col("y").alias("v")))
    for _ in range(STARS):
        pairs = _central(_inside(shared, final, links))
        new = stored(_linked(_likely(pairs, reps, wanted), texts, k, wanted), "links")
        if new.isEmpty():
            break
        links = links.unionByName(new)
        final = components(new.select(F.col("x").alias("u"), F.col("y").alias("v")), final)

    queries, members_of = (stored(d, "crossing") for d in _crossing(_inside(shared, final, links), final))
    new = stored(_compared(queries, members_of, reps, texts, k, wanted), "links")
    if not new.isEmpty():
        final = components(new.select(F.col("x").alias("u"), F.col("y").alias("v")), final)
    found = members.select("doc_id", "n_shingles", "node").join(final, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    return found.withColumn("kept", F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def keep_one_of_each(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents with the least id of their component, with all their columns; rows without an id stay."""
    kept = near_duplicates(docs, k, similarity).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    named = docs.filter("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").select(*docs.columns)
    return named.unionByName(docs.filter("doc_id IS NULL"))
