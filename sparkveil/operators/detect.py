"""Detection: text column in, hits out.

Everything here is row-local.  A document's hits are built, resolved and
de-duplicated as one array column and exploded at the end, so detection is a
narrow stage: scan, project, generate, with no shuffle at any data size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import catalogs as cat
from ..functions import checks
from ..functions.catalogs import Pattern
from ..functions.folds import constants, first_of_runs, let, ordered_fold
from ..functions.match import FORMS, GUARDS, find_all, is_ascii, scannable

HIT = (
    "struct<type:string,category:string,label:string,value:string,normalized:string,"
    "confidence:double,start:int,end:int,context:boolean,source:string,ord:int>"
)
NEAR = 20          # characters within which an equal value counts as the same hit
CONTEXT_REACH = 100  # characters searched on either side for a context word


def _pick(values: list, ord_: Column, type_: str = "string") -> Column:
    """The entry of a per-pattern constant list for a pattern number."""
    entry = F.get(constants(values, type_), ord_)
    return F.nullif(entry, F.lit("")) if type_ == "string" else entry


def _hit(patterns: list[Pattern], m: Column, value, normalized, conf, context, source) -> Column:
    return F.struct(
        _pick([p.type for p in patterns], m["ord"]).alias("type"),
        _pick([p.category for p in patterns], m["ord"]).alias("category"),
        _pick([p.label for p in patterns], m["ord"]).alias("label"),
        value.alias("value"),
        normalized.alias("normalized"),
        conf.cast("double").alias("confidence"),
        m["start"].alias("start"),
        m["end"].alias("end"),
        context.alias("context"),
        F.lit(source).alias("source"),
        _pick([p.priority for p in patterns], m["ord"], "int").alias("ord"),
    )


def has_context(text: Column, start: Column, end: Column, type_: Column, ascii: Column | None = None) -> Column:
    """True when one of the type's context words lies near the hit.

    ``ascii``, where given, tells texts of ASCII characters only: there the words match the same without Unicode classes.
    """
    left = F.greatest(start - CONTEXT_REACH, F.lit(0))
    around = F.substring(text, left + 1, end + CONTEXT_REACH - left)

    def any_word(near):
        chain = F.when(F.lit(False), False)
        for name, words in cat.CONTEXT_WORDS.items():
            wide = near.rlike("(?iuU)" + words)
            chain = chain.when(type_ == name, wide if ascii is None else F.when(ascii, near.rlike("(?i)" + words)).otherwise(wide))
        return chain.otherwise(False)

    return F.when(type_.isin(list(cat.CONTEXT_WORDS)), let(around, any_word)).otherwise(False)


def _guarded(df: DataFrame, text: str, patterns: list[Pattern]) -> DataFrame:
    """Add the scannable text, one boolean per pre-test in use and the reduced forms of the text that are searched."""
    body = F.coalesce(scannable(F.col(text)), F.lit(""))
    # at least two characters between the first and the last non-blank one
    df = df.withColumn("__text", F.when(body.rlike(r"(?sU)[^\s\x1c-\x1f].*[^\s\x1c-\x1f]"), body).otherwise(""))
    names = sorted({p.guard for p in patterns if p.guard})
    df = df.withColumns({"__ascii": is_ascii(F.col("__text")), **{f"__{n}": GUARDS[n](F.col("__text")) for n in names}})
    forms = sorted({p.need[0] for p in patterns if p.need} & set(FORMS))
    return df.withColumns({f"__{n}": F.when(F.col("__ascii"), FORMS[n](F.col("__text"))) for n in forms})


def _find(df: DataFrame, text: str, patterns: list[Pattern], out: str, group=None) -> DataFrame:
    """Add the raw matches of a catalog as an array column."""
    df = _guarded(df, text, patterns)
    return df.withColumn(out, find_all(F.col("__text"), patterns, lambda g: F.col(f"__{g}"), group))


def _shape_hits(patterns: list[Pattern], found: Column, with_context: bool) -> Column:
    """Raw matches of a shape catalog, scored."""
    base = [p.confidence for p in patterns]

    def build(m):
        type_ = _pick([p.type for p in patterns], m["ord"])

        def scored(norm):
            conf = checks.confidence(type_, m["value"], norm, _pick(base, m["ord"], "double"))
            if not with_context:
                return _hit(patterns, m, m["value"], norm, conf, F.lit(False), "SHAPE")
            near = has_context(F.col("__text"), m["start"], m["end"], type_, F.col("__ascii"))
            return let(near, lambda n: _hit(
                patterns, m, m["value"], norm,
                F.round(F.when(n, F.least(F.lit(0.95), conf + 0.1)).otherwise(conf), 2), n, "SHAPE"))

        return let(checks.normalize_ws(m["value"]), scored)

    long_enough = F.filter(found, lambda m: F.length(checks.strip(m["value"])) >= 2)
    return F.transform(long_enough, build)


def not_noise(h: Column) -> Column:
    """False-positive filter: short values, short numbers, mobiles, stop words."""
    def sound(v):
        return (
            (F.length(v) >= 3)
            & ~((F.length(v) < 6) & (h["type"] != "PINCODE") & v.rlike(r"(?U)^\d+$"))
            & ~((h["type"] == "BANK_ACCOUNT") & v.rlike(r"(?U)^[6-9]\d{9}$"))
            & ~F.lower(v).isin(cat.STOP_VALUES)
        )

    return let(checks.strip(h["value"]), sound)


def resolve_same_span(hits: Column, same_span: str = "confidence") -> Column:
    """One hit per (start, end), out of all types that matched exactly there.

    ``confidence`` keeps the most confident hit, ties to the stronger type.
    ``first`` lets the stronger type keep the span when the values agree, and
    only a strictly more confident *different* value take it over.
    """
    if same_span == "confidence":
        ranked = F.array_sort(F.transform(
            F.filter(hits, not_noise),
            lambda h: F.struct(h["start"], h["end"], (-h["confidence"]).alias("neg"), h["ord"].alias("rank"), h.alias("hit")),
        ))
        best = first_of_runs(ranked, lambda a, b: (a["start"] == b["start"]) & (a["end"] == b["end"]))
        return F.transform(best, lambda r: r["hit"])

    ranked = F.array_sort(F.transform(
        hits, lambda h: F.struct(h["start"], h["end"], h["ord"].alias("rank"), h.alias("hit")),
    ))
    # The state is the holder of the current span; a loser gets keep = 0, a
    # winner the running number of its span's winners, and the last one stays.
    state = F.struct(
        F.lit(-1).alias("start"), F.lit(-1).alias("end"),
        F.lit("").alias("norm"), F.lit(-1.0).alias("conf"), F.lit(0).alias("n"),
    )

    def step(s, r):
        h = r["hit"]
        fresh = (s["start"] != r["start"]) | (s["end"] != r["end"])
        norm = F.lower(h["normalized"])
        held = ~fresh & (s["n"] > 0)
        challenges = ~held | ((norm != s["norm"]) & (h["confidence"] > s["conf"]))
        stored = challenges & not_noise(h)
        nxt = F.struct(
            r["start"].alias("start"), r["end"].alias("end"),
            F.when(stored, norm).when(fresh, F.lit("")).otherwise(s["norm"]).alias("norm"),
            F.when(stored, h["confidence"]).when(fresh, F.lit(-1.0)).otherwise(s["conf"]).alias("conf"),
            # a challenger that is itself noise still displaces the holder's row
            F.when(fresh, F.lit(0)).otherwise(s["n"]).__add__(F.when(challenges, 1).otherwise(0)).alias("n"),
        )
        return nxt, F.struct(stored.alias("stored"), challenges.alias("challenges"))

    def marked(items):
        # the fold carries marks only; the hits join them once, at the end
        return let(ordered_fold(items, state, step, "struct<stored:boolean,challenges:boolean>"), lambda marks: F.transform(
            items, lambda r, i: F.struct(F.get(marks, i)["stored"].alias("stored"),
                                         F.get(marks, i)["challenges"].alias("challenges"), r["hit"].alias("hit"))))

    claims = F.filter(let(ranked, marked), lambda m: m["challenges"])
    # the last challenger of each span decides: reverse, take the first of each run
    last = first_of_runs(
        F.reverse(claims),
        lambda a, b: (a["hit"]["start"] == b["hit"]["start"]) & (a["hit"]["end"] == b["hit"]["end"]),
    )
    return F.reverse(F.transform(F.filter(last, lambda m: m["stored"]), lambda m: m["hit"]))


def dedupe_nearby(hits: Column) -> Column:
    """Drop repeats of a value that overlap, or start close to, the last kept one.

    Hits of one (type, lower-case normalized value) are visited by falling
    confidence, then position; the result is back in text order.
    """
    keyed = F.array_sort(F.transform(hits, lambda h: F.struct(
        h["type"].alias("type"), F.lower(h["normalized"]).alias("norm"),
        (-h["confidence"]).alias("neg"), h["start"].alias("start"), h["ord"].alias("ord"),
        h["end"].alias("end"), h.alias("hit"),
    )))
    state = F.struct(
        F.lit("").alias("type"), F.lit("").alias("norm"),
        F.lit(0).alias("start"), F.lit(0).alias("end"),
    )

    def step(s, k):
        same = (s["type"] == k["type"]) & (s["norm"] == k["norm"])
        overlap = F.least(s["end"], k["end"]) > F.greatest(s["start"], k["start"])
        drop = same & (overlap | (F.abs(s["start"] - k["start"]) < NEAR))
        kept = F.struct(k["type"].alias("type"), k["norm"].alias("norm"),
                        k["start"].alias("start"), k["end"].alias("end"))
        return F.when(drop, s).otherwise(kept), ~drop

    def kept_of(a):
        def again(k, i):
            last = F.get(a, F.greatest(i - 1, F.lit(0)))
            return (i > 0) & F.coalesce((last["type"] == k["type"]) & (last["norm"] == k["norm"]), F.lit(True))

        # only a value that comes again can be dropped; the fold carries marks, not hits
        folded = let(ordered_fold(a, state, step, "boolean"), lambda keep: F.filter(a, lambda k, i: F.get(keep, i)))
        return F.when(F.size(F.filter(a, again)) > 0, folded).otherwise(a)

    back = F.array_sort(F.transform(let(keyed, kept_of), lambda k: F.struct(
        k["start"].alias("start"), k["neg"].alias("neg"), k["ord"].alias("ord"), k["hit"].alias("hit"))))
    return F.transform(back, lambda k: k["hit"])


def _round_confidence(hits: Column) -> Column:
    return F.transform(hits, lambda h: h.withField("confidence", F.round(h["confidence"], 2)))


def _choose(patterns: list[Pattern], types) -> list[Pattern]:
    if not types:
        return patterns
    wanted = {t.strip().upper() for t in types}
    return [p for p in patterns if p.type.upper() in wanted]


def _finish(df: DataFrame, stages: list, out: str) -> DataFrame:
    """Apply array stages one select at a time, then drop the helpers."""
    for stage in stages:
        df = df.withColumn(out, stage(F.col(out)))
    return df.drop("__text", "__ascii", *[f"__{name}" for name in [*GUARDS, *FORMS]])


def add_base_hits(df, text="text", out="hits", types=None, catalog=None, same_span="confidence"):
    """Array column of shape hits: scored, one per span, near repeats dropped."""
    patterns = _choose(catalog or cat.shape_catalog(), types)
    return _finish(_find(df, text, patterns, out), [
        lambda m: _shape_hits(patterns, m, False),
        lambda h: resolve_same_span(h, same_span),
        lambda h: dedupe_nearby(_round_confidence(h)),
    ], out)


def add_context_hits(df, text="text", out="hits", types=None, catalog=None):
    """Array column of shape hits of all types, boosted by context words."""
    patterns = _choose(catalog or cat.shape_catalog(), types)
    # no priority between types here: ties are broken by scan order
    patterns = [p._replace(priority=i) for i, p in enumerate(patterns)]
    return _finish(_find(df, text, patterns, out), [
        lambda m: _shape_hits(patterns, m, True), dedupe_nearby], out)


def add_label_hits(df, text="text", out="hits", types=None):
    """Array column of label hits: first of each (label, lower-case value)."""
    patterns = _choose(cat.label_catalog(), types)

    def build(found):
        hits = F.transform(found, lambda m: let(checks.strip(m["value"]), lambda v: _hit(
            patterns, m, v, v, F.lit(0.95), F.lit(False), "LABEL_BASED")))
        return F.filter(hits, lambda h: F.length(h["value"]) >= 2)

    def once(hits):
        ranked = F.array_sort(F.transform(hits, lambda h: F.struct(
            h["type"].alias("type"), F.lower(h["value"]).alias("low"),
            h["ord"].alias("ord"), h["start"].alias("start"), h.alias("hit"))))
        firsts = first_of_runs(ranked, lambda a, b: (a["type"] == b["type"]) & (a["low"] == b["low"]))
        return _in_text_order(F.transform(firsts, lambda r: r["hit"]))

    return _finish(_find(df, text, patterns, out), [build, once], out)


def add_generic_hits(df, text="text", out="hits", types=None, category=None, catalog=None):
    """Array column of generic hits; nothing is de-duplicated."""
    patterns = _choose(catalog or cat.generic_catalog(category), types)

    def build(found):
        return _in_text_order(F.transform(found, lambda m: _hit(
            patterns, m, m["value"], m["value"],
            _pick([p.confidence for p in patterns], m["ord"], "double"), F.lit(False), "GENERIC")))

    # the value is the whole match, also where the pattern has groups
    return _finish(_find(df, text, patterns, out, group=0), [build], out)


def _in_text_order(hits: Column) -> Column:
    placed = F.array_sort(F.transform(hits, lambda h: F.struct(
        h["start"].alias("start"), h["ord"].alias("ord"), h.alias("hit"))))
    return F.transform(placed, lambda r: r["hit"])


def balanced(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Documents dealt out anew into ``parts`` partitions; without it, as they are.

    Detection is bound by the processor, so a scan of a few large splits leaves
    cores idle.  That is for the caller to say: at scale a scan has splits
    enough, and the text should not be shuffled.
    """
    return df.repartition(parts) if parts else df


ADDERS = {
    "base": add_base_hits, "context": add_context_hits,
    "label": add_label_hits, "generic": add_generic_hits,
}


def explode_hits(df: DataFrame, key: list[str], hits: str = "hits") -> DataFrame:
    """One row per hit, with its position ``hit_no`` in the document."""
    # the outer form keeps the optimizer from adding a size(hits) > 0 filter,
    # which would be pushed down and run the whole detection a second time
    rows = df.select(*key, F.posexplode_outer(hits).alias("hit_no", "h"))
    return rows.filter(F.col("hit_no").isNotNull()).select(*key, "hit_no", "h.*")


def detect(df: DataFrame, kind: str = "base", key=("doc_id",), text: str = "text", **options) -> DataFrame:
    """Hits of one catalog kind as rows: ``key``, ``hit_no`` and the hit fields."""
    slim = df.select(*key, text)
    return explode_hits(ADDERS[kind](slim, text=text, **options), list(key))


def detect_base(df, **kw):
    return detect(df, "base", **kw)


def detect_context(df, **kw):
    return detect(df, "context", **kw)


def detect_labels(df, **kw):
    return detect(df, "label", **kw)


def detect_generic(df, **kw):
    return detect(df, "generic", **kw)


def detect_by_category(df, category: str, **kw):
    """Generic detection that only runs the patterns able to yield ``category``."""
    return detect(df, "generic", category=category, **kw)


def detect_custom(df, patterns, **kw):
    """Base detection with the caller's own patterns (``catalogs.user_catalog``), each tried out before any text is read."""
    return detect(df, "base", catalog=cat.user_catalog(patterns, df.sparkSession._jvm), **kw)
