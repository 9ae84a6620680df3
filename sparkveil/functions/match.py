"""Find-all with positions, as native column expressions.

Spark offers no "find all matches with offsets".  One ``regexp_replace`` wraps
every match in two reserved markers, one ``split`` cuts the text at them, and
a running sum over the pieces gives 0-based code point offsets.  That is a
single regex pass per pattern, whatever the number of matches.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .catalogs import Pattern
from .folds import let, ordered_fold

# Unicode noncharacters: never valid in interchanged text.
MATCH = "struct<start:int,end:int,value:string>"
OPEN, SEP = "﷐", "﷑"

GUARDS = {
    "digit": lambda t: t.rlike(r"(?U)\d"),
    "digit4": lambda t: t.rlike(r"(?U)\d{4}"),
    "at": lambda t: F.contains(t, F.lit("@")),
    "colon": lambda t: F.contains(t, F.lit(":")),
    "dash": lambda t: F.contains(t, F.lit("-")),
    "rupee": lambda t: F.contains(t, F.lit("₹")),
    "mac": lambda t: t.rlike(r"[:\-][0-9A-Fa-f]{2}[:\-]"),
    "run16": lambda t: t.rlike(r"[A-Za-z0-9_\-]{16}"),
    "separator": lambda t: F.contains(t, F.lit(":")) | F.contains(t, F.lit("=")),
}


# Blanks, as a regular expression has them in texts of ASCII characters.
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER, TEN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Characters of a label kept before its separator; none of the catalog's is as long.
HEAD = 40


def _heads(t: Column) -> Column:
    """What stands before each colon or equals sign: lower case, without blanks, ended by a colon."""
    parts = F.split(F.translate(t, UPPER + "=" + BLANKS, LOWER + ":"), ":", -1)
    return F.array_join(F.transform(parts, lambda x: F.right(x, F.lit(HEAD))), ":")


# Reduced forms of an ASCII text, in which a plain search tells that a pattern cannot match (``Pattern.need``).
FORMS = {
    # A for upper case, a for lower case, 0 for digits
    "shape": lambda t: F.translate(t, UPPER + LOWER + TEN, "A" * 26 + "a" * 26 + "0" * 10),
    # the same without blanks and dashes
    "packed": lambda t: F.translate(t, UPPER + LOWER + TEN + "-" + BLANKS, "A" * 26 + "a" * 26 + "0" * 10),
    # lower case without blanks
    "low": lambda t: F.translate(t, UPPER + BLANKS, LOWER),
    "heads": _heads,
}


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def may_match(p: Pattern, col) -> Column | None:
    """The pre-test of a pattern, from the helper columns that ``col(name)`` gives; None where it has none.

    Texts with other than ASCII characters pass every search in a reduced form: their letters, digits and blanks are
    more than those forms know.
    """
    tests = [col(p.guard)] if p.guard else []
    if p.need:
        form, pieces = p.need
        found = reduce(or_, [F.contains(col(form), F.lit(x)) for x in pieces])
        tests.append(found if form == "text" else ~col("ascii") | found)
    return reduce(and_, tests) if tests else None


# a repeated group that ends the pattern: nothing after it can need it to give anything back
LAST_LOOP = re.compile(r"(\((?:[^()\\]|\\.)*\)[*+])(\)*)$")


def java_regex(p: Pattern, ascii: bool = False) -> str:
    """The pattern with Unicode-aware classes, as Java wants it; with ``ascii`` in the plain form, which is several times
    as fast and matches the same in texts of ASCII characters.

    Java walks a repeated group by recursion, so that a long run of words would
    end the process; where the group ends the pattern it is made possessive,
    which matches the same and is a loop.
    """
    flags = ("(?ims)" if p.ignore_case else "") if ascii else "(?imsuU)" if p.ignore_case else "(?U)"
    return flags + LAST_LOOP.sub(r"\1+\2", p.regex)


def scannable(text: Column) -> Column:
    """The text with the two reserved markers neutralised, same length."""
    dirty = F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(SEP))
    return F.when(dirty, F.translate(text, OPEN + SEP, "��")).otherwise(text)


def pieces_of(text: Column, p: Pattern, group: int, ascii: Column) -> Column:
    """The text cut at the matches of one pattern: head, then one piece per match.

    A piece reads: whole match, SEP, capture group (or nothing), SEP, text up to
    the next match.  ``ascii`` tells which texts have ASCII characters only.
    """
    at = AROUND_AT.fullmatch(p.regex)
    if at and not p.ignore_case:  # the group, where it has one, is the whole match
        return F.split(marked_around_at(text, at[1], at[2]), OPEN, -1)
    inner = f"${group}" if group else ""
    put = F.lit(f"{OPEN}$0{SEP}{inner}{SEP}")
    marked = F.regexp_replace(text, F.lit(java_regex(p)), put)
    if p.ours:
        marked = F.when(ascii, F.regexp_replace(text, F.lit(java_regex(p, True)), put)).otherwise(marked)
    return F.split(marked, OPEN, -1)


# a pattern of the shape: word boundary, local part, @, domain with a last dot, word boundary
AROUND_AT = re.compile(r"\\b\(?(\[[^\]]+\])\+@(\[[^\]]+\]\+\\\.\[[^\]]+\]\{2,\})\)?\\b")


def marked_around_at(text: Column, local: str, domain: str) -> Column:
    """The text with every address as OPEN, address, SEP, SEP, as a leftmost scan finds them.

    A scan from every possible start walks through a long dotted run once for each of its words. Here the text is cut at
    each ``@``: the domain is matched once, forward from there, and the local part is the run that ends there, from its
    first word boundary on but not before the end of the address before it. So every character is looked at a few times.
    """
    parts = F.split(text, "@", -1)

    def around(i):
        left = F.get(parts, i)
        run = F.length(F.regexp_extract(F.reverse(left), f"^{local}*", 0))
        found = F.regexp_extract(F.get(parts, i + 1), f"(?U)^({domain})\\b", 1)
        return F.struct(left.alias("left"), (F.length(left) - run).alias("run"), F.length(found).alias("domain"))

    def step(taken, a):
        """``taken``: how much of the part on the left belongs to the address before."""
        begin = F.greatest(a["run"], taken)
        # the character before the run decides over the boundary, where there is one
        before = F.when(begin > 0, 1).otherwise(0)
        tail = F.substring(a["left"], begin - before + 1, F.length(a["left"]))
        name = F.length(F.when(before == 1, F.regexp_extract(tail, f"(?sU)(?<=.)\\b({local}++)\\z", 1)).otherwise(
            F.regexp_extract(tail, f"(?U)\\b({local}++)\\z", 1)))
        hit = (a["domain"] > 0) & (name > 0)
        return F.when(hit, a["domain"]).otherwise(0), F.struct(
            F.when(hit, name).otherwise(0).alias("name"), F.when(hit, a["domain"]).otherwise(0).alias("domain"))

    ats = F.transform(F.sequence(F.lit(0), F.size(parts) - 2), around)
    found = ordered_fold(ats, F.lit(0), step, "struct<name:int,domain:int>")

    def shown(hits):
        def one(part, i):
            end = F.when(i > 0, F.get(hits, F.greatest(i - 1, F.lit(0)))["domain"]).otherwise(0)
            name = F.coalesce(F.get(hits, i)["name"], F.lit(0))
            rest = F.substring(part, end + 1, F.length(part) - end - name)
            return F.concat(
                F.substring(part, F.lit(1), end), F.when(end > 0, F.lit(SEP + SEP)).otherwise(""), rest,
                F.when(name > 0, F.lit(OPEN)).otherwise(""), F.right(part, name))

        return F.array_join(F.transform(parts, one), "@")

    return F.when(F.size(parts) > 1, let(found, shown)).otherwise(text)


def matches_in(pieces: Column) -> Column:
    """array<struct<start,end,value>> out of the pieces of one pattern."""
    def step(pos, part):
        whole, grp, tail = part[0], part[1], part[2]
        end = pos + F.length(whole)
        hit = F.struct(
            pos.alias("start"), end.alias("end"),
            F.when(grp != "", grp).otherwise(whole).alias("value"),
        )
        return end + F.length(tail), hit

    parts = F.transform(F.slice(pieces, 2, F.size(pieces)), lambda x: F.split(x, SEP, -1))
    return ordered_fold(parts, F.length(pieces[0]), step, MATCH)


def find_all(text: Column, patterns: list[Pattern], col, group=None) -> Column:
    """array<struct<ord,start,end,value>> of every pattern of a catalog.

    ``ord`` is the position of the pattern in ``patterns``; ``col(name)`` gives
    the helper column of a pre-test (``may_match``).  Only patterns that matched are
    carried on to the offset computation, which is one expression for all.
    """
    def cut(i, p):
        pieces = pieces_of(text, p, p.group if group is None else group, col("ascii"))
        test = may_match(p, col)
        if test is not None:
            pieces = F.when(test, pieces)
        return F.struct(F.lit(i).alias("ord"), pieces.alias("pieces"))

    found = F.filter(
        F.array(*[cut(i, p) for i, p in enumerate(patterns)]), lambda f: F.size(f["pieces"]) > 1
    )
    return F.flatten(F.transform(found, lambda f: F.transform(
        matches_in(f["pieces"]),
        lambda m: F.struct(f["ord"].alias("ord"), m["start"].alias("start"),
                           m["end"].alias("end"), m["value"].alias("value")),
    )))
