"""A web page as blocks of text under a tree of elements, with scores of its containers.

Only what decides over text is kept: block elements and containers in a tree, inline markup as text, links as a count.
Time is linear in the page; nothing of it is left out.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import xxhash

# Elements of HTML by what they mean here.
RAW = frozenset("script style noscript iframe textarea title xmp noembed noframes".split())
CONTAINERS = frozenset("body div article section main td center form".split())
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre table thead tbody tfoot tr th caption blockquote figure figcaption address fieldset "
    "legend details summary hgroup header footer nav aside menu dialog select option button template svg canvas object audio video map head".split())
DROPPED = frozenset("nav aside footer menu dialog select button template svg canvas object audio video map head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCKS - frozenset("option button svg canvas object audio video map td th tr caption thead tbody tfoot".split())
CELLS = frozenset("td th caption".split())
# element: those it closes, if they stand above the innermost of the others
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "caption"), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")),
    "thead": (("caption", "thead", "tbody"), ("table",)), "tbody": (("caption", "thead", "tbody"), ("table",)), "tfoot": (("caption", "thead", "tbody"), ("table",)),
    "option": (("option",), ("select",)), "body": (("head",), ()),
}
# Words in a class, id or role that name what is not the article.
HEADER_WORDS = frozenset("header masthead topbar banner".split())
OTHER_WORDS = frozenset(
    "comment comments disqus respond replies reply discussion ad ads adv advert adverts advertisement advertising advertorial adsense "
    "sponsor sponsors sponsored promo promos promotion promoted cookie cookies consent gdpr ccpa popup modal overlay lightbox nav navbar "
    "navigation menu menus menubar breadcrumb breadcrumbs footer sidebar aside rail share sharing social newsletter subscribe subscription signup "
    "related recommended recommendations pagination pager paginator skip outbrain taboola toolbar widget widgets notice notices alert "
    "announcement login search searchform form copyright contentinfo complementary dialog".split())
OTHER_STARTS = ("sidebar", "cookie", "advert", "newsletter", "breadcrumb", "navbar", "comment")
OTHER_ENDS = ("sidebar", "footer", "nav", "menu", "navbar", "comments")
ARTICLE_WORDS = frozenset("article content entry main post story text body blog".split())
NOT_THAT = frozenset(["commentary", "commentator", "subheader"])
HIDDEN = frozenset("hidden visually-hidden sr-only d-none screen-reader-text".split())

HEADER, OTHER, FORM = 1, 2, 3
#: What a container passes on of its score to the one around it.
DECAY = 0.75
#: Containers below this share of the page's best one do not vote, in thousandths.
LEAST_VOTE = 100
#: Steps of a path that are shown; the whole path counts.
SHOWN_STEPS = 16

_STRICT = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)|(?=\s|/|$))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


@lru_cache(65_536)
def meaning(tag: str, attrs: str) -> tuple[int, bool, str]:
    """(kind, speaks of an article, step of a path) of an element."""
    found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTR.findall(attrs)} if attrs else {}
    classes = found.get("class", "").split()
    names = [w.lower() for w in _WORDS.findall(" ".join([*classes, found.get("id", ""), found.get("role", "")]))]
    words = [w for i, w in enumerate(names) if (not i or names[i - 1] not in ("with", "has", "no", "without")) and w not in NOT_THAT]
    kind = 0
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I)
    if tag in DROPPED or hidden or HIDDEN.intersection(c.lower() for c in classes):
        kind = OTHER
    elif tag == "form":
        kind = FORM
    elif tag != "body":
        if any(w in OTHER_WORDS or w.startswith(OTHER_STARTS) or w.endswith(OTHER_ENDS) for w in words):
            kind = OTHER
        elif tag == "header" or any(w in HEADER_WORDS or w.endswith("header") for w in words):
            kind = HEADER
    step = tag if tag == "body" else ".".join([tag, *sorted({_DIGITS.sub("#", c.lower()) for c in classes})])
    return kind, tag in ("article", "main") or not ARTICLE_WORDS.isdisjoint(words), step


class Page:
    """Elements (``parent``, ``tag``, ``kind``, ...) in the order they open, and blocks (element, text, characters in links)."""

    def __init__(self, source: str | None):
        self.parent, self.tag, self.attrs = [-1], ["body"], [""]
        self.blocks: list[tuple[int, str, int]] = []
        self._read(source or "")
        self._judge()

    def _read(self, s: str) -> None:
        stack, open_at, buf = [0], {}, []
        linked = in_link = 0
        pos, pattern = 0, _STRICT
        last = s.rfind(">")

        def flush():
            nonlocal linked
            if buf:
                text = " ".join("".join(buf).split())
                if text:
                    self.blocks.append((stack[-1], text, min(linked, len(text))))
                buf.clear()
            linked = 0

        def say(text):
            nonlocal linked
            if "&" in text:
                text = html.unescape(text)
            if in_link:
                linked += len(text.strip())
            buf.append(text)

        def top(*tags):
            return max((open_at[t][-1] for t in tags if open_at.get(t)), default=-1)

        def close(depth):
            flush()
            while len(stack) > depth:
                open_at[self.tag[stack.pop()]].pop()

        while True:
            at = s.find("<", pos)
            if at < 0 or at > last:
                tail = s[pos:]
                cut = re.search(r"<[a-zA-Z/!?]", tail)  # a tag that the page's end cuts off
                say(tail[:cut.start()] if cut else tail)
                break
            mark = s[at + 1:at + 2]
            if mark in ("!", "?") or mark == "/" and not s[at + 2:at + 3].isalpha():
                say(s[pos:at])
                if s.startswith("<!--", at):
                    end = s.find("-->", at + 2)
                    pos = len(s) if end < 0 else end + 3
                else:
                    end = s.find(">", at)
                    pos = len(s) if end < 0 else end + 1
                continue
            m = pattern.match(s, at)
            if m is None and pattern is _STRICT and (mark == "/" or mark.isascii() and mark.isalpha()):
                pattern = _LOOSE  # from here on quotes do not hide an angle bracket, so that no quote is looked for twice
                m = pattern.match(s, at)
            if m is None:
                say(s[pos:at + 1])
                pos = at + 1
                continue
            say(s[pos:at])
            pos = m.end()
            ends, name, attrs = m[1], m[2].lower(), m[3]
            if name in RAW:
                if not ends and not attrs.endswith("/"):
                    end = _ENDS[name].search(s, pos)
                    pos = end.start() if end else len(s)
                continue
            if name == "a":
                in_link = not ends
                continue
            if name in ("br", "hr"):
                buf.append(" ")
                if name == "hr":
                    flush()
                continue
            if name not in BLOCKS:
                continue
            if name == "body":
                flush()
                close(1)
                continue
            if ends:
                at_depth = top(name)
                if at_depth > 0 and (name in CELLS or name in ("table", "tr", "tbody", "thead", "tfoot") or at_depth > top(*CELLS)):
                    close(at_depth)
                elif name == "p":
                    flush()
                in_link = in_link and name in ("p", "li")
                continue
            if name in CLOSES_P and open_at.get("p") and top("p") > top(*CELLS, "button", "object"):
                close(top("p"))
            if name in IMPLIED:
                shut, bound = IMPLIED[name]
                depth = top(*shut)
                if depth > 0 and depth > top(*bound):
                    close(min(open_at[t][-1] for t in shut if open_at.get(t) and open_at[t][-1] > top(*bound)))
            if name in HEADINGS and self.tag[stack[-1]] in HEADINGS:
                close(len(stack) - 1)
            flush()
            self.parent.append(stack[-1])
            self.tag.append(name)
            self.attrs.append(attrs.strip(" /"))
            open_at.setdefault(name, []).append(len(stack))
            stack.append(len(self.tag) - 1)
        flush()

    def _judge(self) -> None:
        """What each element is, which blocks count, and the containers' scores."""
        n = len(self.tag)
        self.kind, self.fine, self.step = map(list, zip(*map(meaning, self.tag, self.attrs)))
        shut = [False] * n  # inside an element that is never text
        for e in range(1, n):
            shut[e] = shut[self.parent[e]] or self.tag[e] in DROPPED
        chars, linked, title = [0] * n, [0] * n, [False] * n
        for e, text, links in self.blocks:
            if not shut[e]:
                chars[e] += len(text)
                linked[e] += links
        for e in range(n - 1, 0, -1):
            up = self.parent[e]
            title[e] = title[e] or self.tag[e] in ("h1", "main")
            chars[up] += chars[e]
            linked[up] += linked[e]
            title[up] = title[up] or title[e]
        self.drop, self.head, self.inner = [False] * n, [0] * n, [False] * n
        for e in range(1, n):
            up, kind = self.parent[e], self.kind[e]
            most = 2 * chars[e] > chars[0]
            if kind in (OTHER, HEADER) and self.tag[e] not in DROPPED and self.tag[e] != "header" and most and title[e]:
                kind = 0  # a wrapper of the page that is named after one of its parts
            if kind == FORM and most:
                kind = 0
            self.inner[e] = self.inner[up] or self.tag[e] in ("article", "main")
            links = self.tag[e] in ("ul", "ol") and not self.inner[e] and chars[e] and 10 * linked[e] >= 9 * chars[e]
            self.drop[e] = self.drop[up] or kind in (OTHER, FORM) or bool(links)
            self.head[e] = self.head[up] or (e if kind == HEADER else 0)

        own = [0.0] * n
        for e, text, links in self.blocks:
            if not self.drop[e] and not self.head[e]:
                box = e
                while self.tag[box] not in CONTAINERS:
                    box = self.parent[box]
                own[box] += max(0, len(text) - 2 * links) * (0.7 if box == e else 1.0)
        for e in range(n - 1, 0, -1):
            if own[e]:
                own[self.parent[e]] += own[e] * (DECAY if self.tag[self.parent[e]] in CONTAINERS and self.tag[e] in CONTAINERS else 1.0)
        self.score = [s * (1.25 if fine else 1.0) if tag in CONTAINERS else 0.0 for s, fine, tag in zip(own, self.fine, self.tag)]
        self._paths()

    def _paths(self) -> None:
        """The path of each container that scores, as a digest of its steps from the body on."""
        self.path: list[bytes] = []
        for e, tag in enumerate(self.tag):
            before = self.path[self.parent[e]] if e else b""
            self.path.append(xxhash.xxh3_128_digest(before + self.step[e].encode("utf-8", "surrogatepass")) if tag in CONTAINERS else before)

    def best(self) -> int:
        """The container that scores most, the outermost of equals."""
        return max(range(len(self.tag)), key=lambda e: (self.score[e], -e))

    def shown(self, e: int) -> str:
        steps = []
        while e >= 0 and len(steps) < SHOWN_STEPS:
            if self.tag[e] in CONTAINERS:
                steps.append(self.step[e])
            e = self.parent[e]
        return ">".join(reversed(steps))

    def votes(self) -> list[tuple[bytes, str, int]]:
        """(path, its text, thousandths of the best score) of the containers that may hold the article."""
        most = max(self.score)
        if not most:
            return []
        found: dict[bytes, tuple[str, int]] = {}
        for e, s in enumerate(self.score):
            share = int(1000 * s / most)
            if share >= LEAST_VOTE and share > found.get(self.path[e], ("", 0))[1]:
                found[self.path[e]] = (self.shown(e), share)
        return [(p, *v) for p, v in found.items()]

    def chosen(self, path: bytes | None) -> tuple[list[int], bool]:
        """Containers to read, and whether they come from ``path``: those on it, if they hold a fair part of the page."""
        best = self.best()
        if path is not None:
            on = [e for e, p in enumerate(self.path) if p == path and self.tag[e] in CONTAINERS and self.score[e] > 0 and not self.drop[e]]
            most = max((self.score[e] for e in on), default=0)
            if on and 4 * most >= self.score[best]:
                if "." not in self.step[on[0]] and self.step[on[0]] in ("div", "td", "section"):
                    on = [e for e in on if 10 * self.score[e] >= most]  # nothing names them, so they must look alike
                return on, True
        return [best], False

    def text(self, containers: list[int]) -> str:
        """The blocks inside, in page order; of a header inside only its headings; the headline above, if none is inside."""
        n = len(self.tag)
        inside = [False] * n
        for e in containers:
            inside[e] = True
        for e in range(1, n):
            inside[e] = inside[e] or inside[self.parent[e]]
        heading = list(self.tag)
        for e in range(1, n):
            if heading[self.parent[e]] in HEADINGS:
                heading[e] = heading[self.parent[e]]

        def counts(e):
            if self.drop[e] or not inside[e]:
                return False
            h = self.head[e]
            return not h or bool(self.parent[h] and inside[self.parent[h]] and heading[e] in HEADINGS)

        kept = [(i, text) for i, (e, text, _) in enumerate(self.blocks) if counts(e)]
        if kept and not any(heading[self.blocks[i][0]] == "h1" for i, _ in kept):
            above = set()
            e = containers[0]
            while e > 0:
                e = self.parent[e]
                above.add(e)
            for i, (e, text, _) in enumerate(self.blocks[:kept[0][0]]):
                if heading[e] == "h1" and not self.drop[e] and not self.head[e] and self.parent[e] in above:
                    kept.insert(0, (i, text))
                    break
        return "\n".join(text for _, text in kept)
