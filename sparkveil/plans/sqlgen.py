"""SQL twins of the detection operators, built from the same catalogs.

The SQL engine used for checking has ASCII-only word boundaries.  Letters
outside ASCII are therefore mapped to ``_`` (a word character) and other such
characters to a control character, one for one; values are read back from the
original text by position.  The four shapes whose character class contains
``_`` are matched on a text with explicit boundary marks instead.
"""

from __future__ import annotations

from ..functions import catalogs as cat
from ..functions.checks import _dihedral, _permutations

B = "\x02"  # boundary mark
MARKED = {
    "UPI": rf"(?i){B}((?:{B}?[A-Za-z0-9._\-]){{2,256}}{B}?@(?:{B}?[a-z0-9._\-]){{2,64}}){B}",
    "EMAIL": rf"{B}((?:{B}?[a-zA-Z0-9._%+\-])+{B}?@(?:{B}?[a-zA-Z0-9.\-])+{B}?\.{B}?[a-zA-Z]{{2,}}){B}",
    "Email": rf"{B}(?:{B}?[a-zA-Z0-9._%+\-])+{B}?@(?:{B}?[a-zA-Z0-9.\-])+{B}?\.{B}?[A-Z|a-z]{{2,}}{B}",
    "API_KEY": rf"{B}((?:{B}?[A-Za-z0-9\-_]){{16,128}}){B}",
    "SOCIAL_HANDLE": rf"@{B}((?:{B}?[A-Za-z0-9._]){{1,50}}){B}",
}


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _one(p: cat.Pattern, ord_: int, key: str, group: int) -> str:
    """SELECT of the raw matches of one pattern: key, ord, start, end, value."""
    marked = p.type in MARKED and "\\b" in p.regex
    if marked:
        rx, source = MARKED[p.type], "m"
    else:
        rx = ("(?i)" if p.ignore_case else "") + p.regex
        source = "a" if "\\b" in p.regex else "text"
    plain = (lambda e: f"replace({e}, '{B}', '')") if marked else (lambda e: e)
    g1 = f"regexp_extract_all({source}, {lit(rx)}, 1)" if group else "NULL::VARCHAR[]"
    if group and source == "text":
        value = "CASE WHEN g1[i] <> '' THEN g1[i] ELSE g0[i] END"
    elif group:
        size = f"CASE WHEN g1[i] <> '' THEN length({plain('g1[i]')}) ELSE e - s END"
        value = f"substr(text, e - ({size}) + 1, {size})"
    else:
        value = "substr(text, s + 1, e - s)"
    where = ""
    if p.type == "UPI":
        where = (" WHERE NOT regexp_matches(lower(split_part(value, '@', 2)), "
                 "'^(gmail\\.com|yahoo\\.(com|in|co\\.in)|outlook\\.com|hotmail\\.(com|in))')")
    return f"""SELECT * FROM (SELECT {key}, {ord_} AS ord, s AS "start", e AS "end", {value} AS value FROM (
 SELECT {key}, text, g0, g1, i, s, s + length({plain('g0[i]')}) AS e FROM (
 SELECT {key}, text, g0, g1, i, (list_sum(list_transform(parts[1:i], lambda x: length({plain('x')})))
  + coalesce(list_sum(list_transform(g0[1:i-1], lambda x: length({plain('x')}))), 0))::INT AS s FROM (
 SELECT {key}, text, g0, g1, parts, unnest(range(1, len(g0) + 1)) AS i FROM (
 SELECT {key}, text, regexp_extract_all({source}, {lit(rx)}) AS g0, {g1} AS g1, string_split_regex({source}, {lit(rx)}) AS parts FROM prepared
 ) WHERE len(g0) > 0)))){where}"""


def raw_matches(source: str, key: str, patterns, group=None) -> str:
    """CTE list (src, prepared, raw): all matches of a catalog over ``source``."""
    parts = "\nUNION ALL\n".join(
        _one(p, i, key, p.group if group is None else group) for i, p in enumerate(patterns))
    return f"""src AS ({source}),
prepared AS (SELECT {key}, text,
 regexp_replace(regexp_replace(regexp_replace(text, '[\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]', ' ', 'g'),
  '[^\\x00-\\x7F\\p{{L}}\\p{{N}}₹]', chr(1), 'g'), '[^\\x00-\\x7F₹]', '_', 'g') AS a,
 regexp_replace(text, '([\\p{{L}}\\p{{N}}_]+)', '{B}\\1{B}', 'g') AS m
 FROM src WHERE length(trim(text)) >= 2),
raw AS ({parts})"""


def _column(patterns, what, quote=True) -> str:
    vals = [getattr(p, what) for p in patterns]
    items = ", ".join("NULL" if v is None else (lit(str(v)) if quote else str(v)) for v in vals)
    return f"[{items}][ord + 1]"


def _checks() -> tuple[str, str]:
    mul = "[" + ",".join(str(_dihedral(a, b)) for a in range(10) for b in range(10)) + "]"
    perm = "[" + ",".join(str(v) for row in _permutations() for v in row) + "]"
    d = "regexp_replace(normalized, '[^0-9]', '', 'g')"
    steps = f"list_transform(range(0, 12), lambda j: {perm}[(j % 8) * 10 + substr(reverse({d}), j + 1, 1)::INT + 1])"
    verhoeff = f"list_reduce(list_prepend(0, {steps}), lambda x, y: {mul}[x * 10 + y + 1]) = 0"
    luhn = (f"length({d}) >= 14 AND list_sum(list_transform(range(0, length({d})), lambda j: "
            f"CASE WHEN j % 2 = 0 THEN substr(reverse({d}), j + 1, 1)::INT "
            f"WHEN substr(reverse({d}), j + 1, 1)::INT < 5 THEN substr(reverse({d}), j + 1, 1)::INT * 2 "
            f"ELSE substr(reverse({d}), j + 1, 1)::INT * 2 - 9 END)) % 10 = 0")
    return verhoeff, luhn


def scored(key: str, patterns) -> str:
    """CTE ``scored``: raw matches with type, normalized value and confidence."""
    verhoeff, luhn = _checks()
    d = "length(regexp_replace(normalized, '[^0-9]', '', 'g'))"
    domain = "lower(split_part(value, '@', 2))"
    base = _column(patterns, "confidence", False)
    return f"""named AS (SELECT *, {_column(patterns, 'type')} AS type, {_column(patterns, 'priority', False)} AS prio,
 regexp_replace(value, '\\s+', '', 'g') AS normalized FROM raw WHERE length(trim(value)) >= 2),
scored AS (SELECT *, (CASE
 WHEN type = 'AADHAAR' AND {d} = 12 THEN CASE WHEN {verhoeff} THEN 0.95 ELSE 0.7 END
 WHEN type = 'CARD_NUMBER' AND {d} >= 15 THEN CASE WHEN {luhn} THEN 0.9 ELSE 0.6 END
 WHEN type = 'IMEI' AND {d} >= 14 THEN CASE WHEN {luhn} THEN 0.85 ELSE 0.6 END
 WHEN type = 'UPI' AND contains(value, '@') THEN CASE WHEN contains({domain}, '.com') OR contains({domain}, '.in') THEN 0.2 ELSE 0.85 END
 ELSE {base} END)::DOUBLE AS confidence FROM named)"""


def _nearby(key: str, source: str, prio: str) -> str:
    """CTEs ``ranked``, ``walk``, ``kept``: the greedy near-repeat rule."""
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY {key}, type, lower(normalized)
 ORDER BY confidence DESC, "start", {prio}) AS rn FROM {source}),
walk AS (SELECT {key}, type, lower(normalized) AS norm, rn, true AS keep, "start" AS ls, "end" AS le FROM ranked WHERE rn = 1
 UNION ALL
 SELECT n.{key}, n.type, w.norm, n.rn,
  NOT (least(w.le, n."end") > greatest(w.ls, n."start") OR abs(w.ls - n."start") < 20),
  CASE WHEN least(w.le, n."end") > greatest(w.ls, n."start") OR abs(w.ls - n."start") < 20 THEN w.ls ELSE n."start" END,
  CASE WHEN least(w.le, n."end") > greatest(w.ls, n."start") OR abs(w.ls - n."start") < 20 THEN w.le ELSE n."end" END
 FROM walk w JOIN ranked n ON n.{key} = w.{key} AND n.type = w.type AND lower(n.normalized) = w.norm AND n.rn = w.rn + 1),
kept AS (SELECT r.* FROM ranked r JOIN walk w ON r.{key} = w.{key} AND r.type = w.type
 AND lower(r.normalized) = w.norm AND r.rn = w.rn WHERE w.keep)"""


def first_ctes(source: str, key: str = "doc_id") -> str:
    """CTEs ending in ``kept``: the base detection with the rule ``same_span="first"``."""
    patterns = cat.shape_catalog()
    stop = ", ".join(lit(w) for w in cat.STOP_VALUES)
    takes = "(lower(s.normalized) <> c.norm AND s.confidence > c.conf)"
    return f"""{raw_matches(source, key, patterns)},
{scored(key, patterns)},
spans AS (SELECT *, (length(trim(value)) >= 3 AND NOT (regexp_full_match(trim(value), '[0-9]+') AND length(trim(value)) < 6 AND type <> 'PINCODE')
 AND NOT (type = 'BANK_ACCOUNT' AND regexp_full_match(trim(value), '[6-9][0-9]{{9}}')) AND lower(trim(value)) NOT IN ({stop})) AS ok,
 row_number() OVER (PARTITION BY {key}, "start", "end" ORDER BY prio) AS sn FROM scored),
claim AS (SELECT {key}, "start", "end", sn, CASE WHEN ok THEN lower(normalized) ELSE '' END AS norm, CASE WHEN ok THEN confidence ELSE -1 END AS conf,
 CASE WHEN ok THEN sn END AS winner FROM spans WHERE sn = 1
 UNION ALL SELECT s.{key}, s."start", s."end", s.sn, CASE WHEN {takes} AND s.ok THEN lower(s.normalized) ELSE c.norm END,
  CASE WHEN {takes} AND s.ok THEN s.confidence ELSE c.conf END, CASE WHEN NOT {takes} THEN c.winner WHEN s.ok THEN s.sn END
 FROM claim c JOIN spans s ON s.{key} = c.{key} AND s."start" = c."start" AND s."end" = c."end" AND s.sn = c.sn + 1),
ended AS (SELECT * FROM claim QUALIFY row_number() OVER (PARTITION BY {key}, "start", "end" ORDER BY sn DESC) = 1),
owned AS (SELECT s.* FROM spans s JOIN ended e ON s.{key} = e.{key} AND s."start" = e."start" AND s."end" = e."end" AND s.sn = e.winner),
{_nearby(key, "owned", "prio")}"""


def base_ctes(source: str, key: str = "doc_id", types=None) -> str:
    """CTEs ending in ``kept``: the base detection over ``source``."""
    patterns = cat.shape_catalog()
    if types:
        patterns = [p for p in patterns if p.type in types]
    stop = ", ".join(lit(w) for w in cat.STOP_VALUES)
    return f"""{raw_matches(source, key, patterns)},
{scored(key, patterns)},
sound AS (SELECT * FROM scored WHERE length(trim(value)) >= 3
 AND NOT (regexp_full_match(trim(value), '[0-9]+') AND length(trim(value)) < 6 AND type <> 'PINCODE')
 AND NOT (type = 'BANK_ACCOUNT' AND regexp_full_match(trim(value), '[6-9][0-9]{{9}}'))
 AND lower(trim(value)) NOT IN ({stop})),
owned AS (SELECT * FROM sound QUALIFY row_number() OVER (PARTITION BY {key}, "start", "end" ORDER BY confidence DESC, prio) = 1),
{_nearby(key, "owned", "prio")}"""


def context_ctes(source: str, key: str = "doc_id") -> str:
    """CTEs ending in ``kept``: the context detection over ``source``."""
    patterns = cat.shape_catalog()
    words = " ".join(
        f"WHEN type = {lit(t)} THEN regexp_matches(near, {lit('(?i)' + w)})" for t, w in cat.CONTEXT_WORDS.items())
    return f"""{raw_matches(source, key, patterns)},
{scored(key, patterns)},
nearby AS (SELECT s.*, substr(p.text, greatest(s."start" - 100, 0) + 1, s."end" + 100 - greatest(s."start" - 100, 0)) AS near
 FROM scored s JOIN prepared p ON s.{key} = p.{key}),
seen AS (SELECT * EXCLUDE (confidence, near), confidence AS c0, coalesce(CASE {words} ELSE false END, false) AS context FROM nearby),
boosted AS (SELECT * EXCLUDE (c0), round(CASE WHEN context THEN least(0.95, c0 + 0.1) ELSE c0 END, 2) AS confidence FROM seen),
{_nearby(key, "boosted", "ord")}"""


def label_ctes(source: str, key: str = "doc_id") -> str:
    """CTEs ending in ``kept``: the label detection over ``source``."""
    patterns = cat.label_catalog()
    return f"""{raw_matches(source, key, patterns)},
named AS (SELECT * EXCLUDE (value), {_column(patterns, 'type')} AS type, {_column(patterns, 'category')} AS category,
 {_column(patterns, 'label')} AS label, regexp_replace(value, '^\\s+|\\s+$', '', 'g') AS value FROM raw),
kept AS (SELECT * FROM named WHERE length(value) >= 2
 QUALIFY row_number() OVER (PARTITION BY {key}, type, lower(value) ORDER BY ord, "start") = 1)"""


def generic_ctes(source: str, key: str = "doc_id", category=None) -> str:
    """CTEs ending in ``kept``: the generic detection over ``source``."""
    patterns = cat.generic_catalog(category)
    return f"""{raw_matches(source, key, patterns, 0)},
kept AS (SELECT *, {_column(patterns, 'type')} AS type, {_column(patterns, 'category')} AS category,
 {_column(patterns, 'label')} AS label, 0.95 AS confidence FROM raw)"""
