"""Quality rules from repetition coverage: characters inside duplicated word n-grams and duplicated lines.

The measures follow Rae et al., "Scaling Language Models: Methods, Analysis & Insights from Training Gopher" (2021),
table A1; hashes of n words roll on from those of n - 1 words, in numpy, for one text at a time. Shares count what an
n-gram or line adds after it stood once, so that a header that returns as a footer counts once, not twice.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .shared import filter_texts, map_texts

#: Share of a text's word characters that may lie inside n-grams seen before in the text, by n.
MOST_IN_NGRAMS = {5: 0.15, 6: 0.145, 7: 0.14, 8: 0.135, 9: 0.13, 10: 0.125}
#: Share of the characters of lines with a word that may lie in lines equal to an earlier one, and share of such lines.
MOST_IN_LINES, MOST_LINES = 0.30, 0.40
MIN_WORDS = 10
SYMBOLS = b"#*$%&|<>"
_BLANK = " \t\n\v\f\r"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def repeated_starts(hashes: np.ndarray) -> np.ndarray:
    """Where a value stands that stands elsewhere too."""
    ordered = np.sort(hashes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    return np.isin(hashes, np.unique(twice)) if len(twice) else np.zeros(len(hashes), bool)


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Words inside windows of ``n`` words that begin where ``starts`` is true."""
    edge = np.zeros(total + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def coverage(words: list[bytes], lengths: tuple[int, ...]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length, the words inside n-grams found twice or more, and inside those found before. ``lengths``
    ascend."""
    total = len(words)
    none = np.zeros(total, bool)
    one = np.fromiter(map(hash, words), np.int64, total).view(np.uint64)
    out, rolled, n, over = {}, one, 1, False
    for want in lengths:
        if total < want or over:
            out[want] = none, none
            continue
        while n < want:
            rolled = rolled[:-1] * _STEP + one[n:]
            n += 1
        starts = repeated_starts(rolled)
        over = not starts.any()  # a longer n-gram can only repeat where this one does
        if over:
            out[want] = none, none
            continue
        later, at = starts.copy(), np.flatnonzero(starts)
        later[at[np.unique(rolled[at], return_index=True)[1]]] = False
        out[want] = covered(starts, want, total), covered(later, want, total)
    return out


def measure(text: str | None, lengths: tuple[int, ...] = tuple(MOST_IN_NGRAMS)) -> dict:
    """Counts of one text; ``ngram_chars`` has the word characters inside n-grams seen before, by n."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    sizes = np.fromiter(map(len, words) if text.isascii() else (len(w.decode("utf-8", "surrogatepass")) for w in words), np.int64, len(words))
    lines = [line for line in text.split("\n") if line.strip(_BLANK)]
    seen, n_dup, dup_chars = set(), 0, 0
    for line in lines:
        if line in seen:
            n_dup += 1
            dup_chars += len(line)
        else:
            seen.add(line)
    inside = coverage(words, tuple(sorted({5, *lengths})))
    return {
        "n_words": len(words), "word_chars": int(sizes.sum()), "n_symbols": len(data) - len(data.translate(None, SYMBOLS)),
        "n_dup_lines": n_dup, "n_repeat_words": int(inside[5][0].sum()), "n_lines": len(lines), "line_chars": sum(map(len, lines)),
        "dup_line_chars": dup_chars, "ngram_chars": {n: int(sizes[inside[n][1]].sum()) for n in lengths},
    }


def verdict(m: dict, most: dict[int, float] = MOST_IN_NGRAMS) -> tuple[bool, list[str]]:
    """Whether the base rules fail, and the repetition rules that do."""
    base = m["n_words"] < MIN_WORDS or 100 * m["n_repeat_words"] > 20 * m["n_words"]
    broken = [f"ngram_{n}" for n, share in most.items() if m["ngram_chars"][n] > share * m["word_chars"]]
    if m["dup_line_chars"] > MOST_IN_LINES * m["line_chars"]:
        broken.append("line_chars")
    if m["n_dup_lines"] > MOST_LINES * m["n_lines"]:
        broken.append("lines")
    return base, broken


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: dict[int, float] = MOST_IN_NGRAMS) -> DataFrame:
    """One row for each document with its counts, the rules it breaks and whether it is kept; no shuffle.

    Words are ``[^\\x20\\x09-\\x0D]+``. Null and empty texts have no words and fail the base rules. Repeated rows are
    judged one by one, ids may be null, an empty table gives no rows, other columns are not read.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    lengths = tuple(sorted(most))

    def work(texts):
        rows = []
        for text in texts:
            m = measure(text, lengths)
            base, broken = verdict(m, most)
            shares = [m["ngram_chars"][n] / max(1, m["word_chars"]) for n in lengths]
            rows.append((*(m[n] for n in names), base, not base and not broken, m["dup_line_chars"] / max(1, m["line_chars"]), shares, broken))
        return list(zip(*rows)) if rows else [[]] * 10

    fields = ", ".join(f"{n} long" for n in names)
    return map_texts(docs, work, fields + ", base_failed boolean, kept boolean, dup_line_char_share double, ngram_char_shares array<double>, broken array<string>", id_col, text_col)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that break no rule, with all their columns."""
    def keep(texts):
        return [not base and not broken for base, broken in (verdict(measure(t)) for t in texts)]

    return filter_texts(docs, keep, text_col)
