"""A manifest of a dataset as a content-addressed DAG, and proofs by descent from its root.

Leaves are digests of rows, in order inside each group; every ``FAN`` consecutive digests become one, up to the group's
root; the groups' roots become the dataset's root in the same way. What is stored are records from a digest to its
children. A proof descends from the root by the digits of a leaf's rank: at each level the record of the digest gives
the children, one of which is selected, and the others are collected; the path is then reversed. Requests that share a
prefix of digits descend together, so no record is asked twice for the same place.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import numbered
from .shared import stored

FAN = 8
#: Levels that one shuffle builds: a group of FAN ** LEVELS digests, 32 KB of hex text, meets in one row.
LEVELS = 3

SEGMENT = "array<struct<left:string,right:string>>"


class Manifest(NamedTuple):
    """``leaves`` (id, ``g``, rank, leaf, more columns), ``records`` and ``roots`` of the groups, and those above them."""

    leaves: DataFrame
    records: DataFrame
    roots: DataFrame
    top_records: DataFrame
    top: DataFrame


def digest(parts: Column) -> Column:
    return F.sha2(parts, 256)


def leaf_of(fields: list[Column]) -> Column:
    """Digest of a row: ``-`` for a null, else the value's UTF-8 byte count, a colon and the value, one after another."""
    def shown(c):
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest(F.concat(*[shown(c) for c in fields]))


def _runs(digests: Column) -> Column:
    """array<struct<digest,children>> over runs of FAN."""
    def node(children):
        return F.struct(digest(F.array_join(children, "")).alias("digest"), children.alias("children"))

    slices = F.transform(F.sequence(F.lit(0), F.size(digests) - 1, F.lit(FAN)), lambda i: F.slice(digests, i + 1, FAN))
    return F.transform(slices, node)


def _tree(nodes: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(records, roots) over ``nodes`` (g, rank, digest).

    Records are (level, digest, children), each digest once; roots are (g, digest, depth). A round groups
    FAN ** LEVELS neighbours by number, so a group of any size spreads evenly; the next round has that many times fewer.
    """
    block, rounds, base = FAN ** LEVELS, [], 0
    while True:
        by = F.expr(f"rank DIV {block}").alias("block")
        packed = F.array_sort(F.collect_list(F.struct("rank", "digest")))
        rows = nodes.groupBy("g", by).agg(F.transform(packed, lambda s: s["digest"]).alias("l0"))
        for i in range(1, LEVELS + 1):
            rows = rows.withColumn(f"l{i}", _runs(F.col(f"l{i - 1}") if i == 1 else F.col(f"l{i - 1}.digest")))
        # a block that is not the first, or is full, may have neighbours: all its levels count
        whole = (F.col("block") > 0) | (F.size("l0") == block)
        depth = reduce(lambda c, i: c.when(F.size("l0") > FAN ** i, i + 1), range(LEVELS - 1, -1, -1), F.when(whole, LEVELS)).otherwise(0)
        tops = [F.get("l0", F.lit(0)), *[F.get(f"l{i}.digest", F.lit(0)) for i in range(1, LEVELS + 1)]]
        top = reduce(lambda c, i: c.when(F.col("depth") == i, tops[i]), range(LEVELS + 1), F)
        rows = rows.withColumns({"depth": depth, "done": ~whole}).withColumn("digest", top)
        rows = stored(rows.drop("l0").withColumn("base", F.lit(base)), f"{name}-{base}")
        rounds.append(rows)
        rest = rows.filter(~F.col("done")).select("g", F.col("block").alias("rank"), "digest")
        if rest.isEmpty():
            break
        nodes, base = rest, base + LEVELS

    def records(rows):
        def at(level):
            return F.transform(f"l{level}", lambda n: F.struct(
                (F.col("base") + level).alias("level"), n["digest"].alias("digest"), n["children"].alias("children")))

        each = [F.when(F.col("depth") >= i, at(i)) for i in range(1, LEVELS + 1)]
        return rows.select(F.inline(F.flatten(F.filter(F.array(*each), lambda a: a.isNotNull()))))

    every = reduce(DataFrame.unionByName, map(records, rounds)).groupBy("level", "digest").agg(F.first("children").alias("children"))
    roots = [r.filter("done").select("g", "digest", (F.col("base") + F.col("depth")).alias("depth")) for r in rounds]
    return stored(every, f"{name}-records"), stored(reduce(DataFrame.unionByName, roots), f"{name}-roots")


def build(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields=("doc_id", "source", "lang", "n_chars", "text"), more: dict | None = None) -> Manifest:
    """The manifest of ``docs``; ``more`` adds columns to its leaves.

    Rows are ordered inside a group by id, then by digest; a null id comes first, rows that are alike stand side by side
    as leaves of their own. A null group is a group, before all others, which follow bytewise. An empty table gives
    empty frames. Only the columns named are read.
    """
    g = F.coalesce(F.concat(F.lit("1"), F.col(group_col).cast("string")), F.lit("0"))
    rows = docs.select(F.col(id_col).alias("doc_id"), g.alias("g"), leaf_of([F.col(c) for c in fields]).alias("leaf"),
                       *[c.alias(n) for n, c in (more or {}).items()])
    leaves = stored(numbered(rows, ["g"], ["doc_id", "leaf"], "rank"), "merkle-leaves")
    records, roots = _tree(leaves.select("g", "rank", F.col("leaf").alias("digest")), "merkle")
    places = stored(numbered(roots.withColumn("all", F.lit("")), ["all"], ["g"], "rank"), "merkle-groups")
    top_records, top = _tree(places.select(F.col("all").alias("g"), "rank", "digest"), "merkle-top")
    return Manifest(leaves, records, places, top_records, top)


def _segment(children: Column, digit: Column) -> Column:
    """What stands left and right of the selected child."""
    return F.struct(F.array_join(F.slice(children, F.lit(1), digit), "").alias("left"),
                    F.array_join(F.slice(children, digit + 2, F.lit(FAN)), "").alias("right"))


def _down(nodes: DataFrame, records: DataFrame, level: int) -> DataFrame:
    """From nodes of a level to all their children: the rank grows by a digit, the path by a segment."""
    known = records.filter(F.col("level") == level).select("digest", "children")
    rest = [c for c in nodes.columns if c not in ("digest", "prefix", "path")]
    found = nodes.join(known, "digest").select(*rest, "prefix", "path", "children", F.posexplode("children").alias("digit", "child"))
    return found.select(*rest, (F.col("prefix") * FAN + F.col("digit")).alias("prefix"), F.col("child").alias("digest"),
                        F.concat("path", F.array(_segment(F.col("children"), F.col("digit")))).alias("path"))


def prove(m: Manifest) -> DataFrame:
    """Every leaf with ``subroot``, ``root`` and ``path``: its siblings, level by level from the leaf to the root.

    A segment of the path has the run's digests left and right of the selected one, joined as text.
    """
    none, root = F.array().cast(SEGMENT), m.top.first()  # one row, or none in an empty table
    at = m.top.select("digest", F.col("digest").alias("root"), F.lit(0).cast("bigint").alias("prefix"), none.alias("path"))
    for level in range(root.depth if root else 0, 0, -1):
        at = _down(at, m.top_records, level)
    at = at.select("root", F.col("prefix").alias("rank"), F.col("path"))
    starts = stored(m.roots.join(at, "rank").select(
        "g", "depth", "digest", F.col("digest").alias("subroot"), "root", F.lit(0).cast("bigint").alias("prefix"), "path"), "merkle-starts")

    deepest = starts.agg(F.max("depth")).first()[0] or 0
    at = starts.filter(F.col("depth") == deepest)
    for level in range(deepest, 1, -1):
        at = _down(at, m.records, level).unionByName(starts.filter(F.col("depth") == level - 1))
    # the last digit selects among the requests of one run, eight at most
    lone = starts.filter((F.col("depth") == 0) & F.lit(deepest > 0))
    last = m.records.filter(F.col("level") == 1).select("digest", "children")
    runs = at.join(last, "digest", "left").unionByName(lone.withColumn("children", F.lit(None).cast("array<string>")))
    extra = [c for c in m.leaves.columns if c not in ("g", "rank")]
    asked = m.leaves.groupBy("g", F.expr(f"rank DIV {FAN}").alias("prefix")).agg(
        F.collect_list(F.struct((F.col("rank") % FAN).cast("int").alias("digit"), *extra)).alias("asked"))
    each = runs.join(asked, ["g", "prefix"]).select("subroot", "root", "path", "children", F.explode("asked").alias("r"))
    own = F.when(F.col("children").isNull(), none).otherwise(F.array(_segment(F.col("children"), F.col("r.digit"))))
    return each.select(*[F.col(f"r.{c}").alias(c) for c in extra], "subroot", "root", F.reverse(F.concat("path", own)).alias("path"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda d, s: digest(F.concat(s["left"], d, s["right"])))


def proof_digest(path: Column) -> Column:
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))
