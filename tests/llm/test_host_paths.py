import html as H
import random
import re

import pytest

from sparkveil.llm import host_paths
from sparkveil.llm.host_paths import extract
from sparkveil.llm.page_tree import Page
from sparkveil.llm.queries import QUERIES, table


def own(source):
    page = Page(source)
    return page.text(page.chosen(None)[0])


LONG = "A sentence with some words, that goes on for a while and then ends. "


@pytest.mark.parametrize("source, want", [
    (None, ""), ("", ""), ("   ", ""), ("no markup &amp; none", "no markup & none"), ("<p>one<p>two", "one\ntwo"),
    ("<div><p>a &lt;b&gt; &copy 5&nbsp;&#8364;</p><p>x\n  y<br>z</p></div>", "a <b> © 5 €\nx y z"),
    ("<body><nav><a href=x>Home</a></nav><header>Site</header><div id=c><h1>T</h1><p>Text.</p></div><footer>f</footer>", "T\nText."),
    ("<SCRIPT>if (a<b) '</p>'</SCRIPT><P>Text<STYLE>p{}</STYLE> more</P><!-- <p>no</p> -->", "Text more"),
    ("<p>Text</p><!-- never closed <p>no</p>", "Text"), ("<p>Text</p><script>never closed <p>no</p>", "Text"),
    ("<p title='a > b' data-x=\">\">Text</p><p>cut <a href=\"x", "Text\ncut"), ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
    ("<article><h1>T</h1><p>One.</p><div class=comments><p>" + LONG * 5 + "</p></div><aside>s</aside></article>", "T\nOne."),
    ("<main><article><header><h1>T</h1><p>kicker</p></header><p>One.</p><div class='ad-box'>buy</div><p>Two.</p><form>mail <input></form></article></main>", "T\nOne.\nTwo."),
    ("<div class='cookie-notice'>" + LONG * 3 + "</div><div class=post><p>" + LONG + "</p></div>", LONG.strip()),
    ("<form><div id=content><p>" + LONG + "</p></div></form>", LONG.strip()),
    ("<div class='layout has-sidebar'><div class=sidebar>x</div><div class=content><p>" + LONG + "</p></div></div>", LONG.strip()),
    ("<h1>T</h1><div><p>" + LONG + "</p><ul><li>one<li>two</ul><table><tr><td>1<td>2</table></div>", "T\n" + LONG + "\none\ntwo\n1\n2".replace(LONG, LONG.strip())),
    ("<p>a<p hidden>b</p><p style='display: none'>c</p><div class=sr-only>d</div><p>e</p>", "a\ne"),
    ("<p>x <b>bold <i>both</b> it</i> y</p></div></section><p>z</p>", "x bold both it y\nz"),
])
def test_one_page(source, want):
    assert own(source) == want.replace(LONG, LONG.strip())


def test_odd_shapes_take_linear_time():
    for piece in ("<div>", "</div>", "<a href='", "<p title=\"", "<", "&", "<!--", "<b><div></b>", "<li><ul>", "<td><table>", "</p>", "<script>"):
        own(piece * 100_000 + LONG)
    assert own("<div>" * 20_000 + LONG) == LONG.strip()


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS host", "1 AS path", "2 AS text")


def site(rng, n, host):
    """Pages whose side column is sometimes longer than the article."""
    rows = []
    for i in range(n):
        article = [f"{host} {i} says {rng.randint(0, 9)}. " + LONG * rng.randint(2, 4) for _ in range(3)]
        side = [LONG * (14 if i % 5 == 0 else 1)]
        text = "<body><div class='w a'><div class='x17'>%s</div><div class='y%d'>%s</div></div>" % (
            "".join(f"<p>{p}</p>" for p in article), i, "".join(f"<p>{p}</p>" for p in side))
        rows.append((i, f"http://www.{host}/p/{i}", text, "\n".join(p.strip() for p in article)))
    return rows


@pytest.mark.parametrize("most", [100, 0])
def test_the_host_decides(spark, most, monkeypatch):
    monkeypatch.setattr(host_paths, "HOT", 3)
    rng = random.Random(5)
    rows = [r for host, n in (("hot.example.org", 40), ("b.example.org", 10), ("c.example.org", 5)) for r in site(rng, n, host)]
    got = {r.url: r for r in extract(frame(spark, [r[:3] for r in rows]), broadcast_hosts=most).collect()}
    assert all(got[u].text == want and got[u].by_host for _, u, _, want in rows)
    assert sum(own(h) != want for _, _, h, want in rows) == 11  # what single pages get wrong


def test_like_a_plain_reading(spark, sf):
    got = {r.page_id: r for r in QUERIES["op11_consensus_host_paths"](spark, sf).collect()}
    rows = table(spark, sf, "pages").collect()
    assert len(got) == len(rows)
    for r in rows:
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = re.sub(r"</?(?:h1|p)>", "\0", re.sub(r"<br>", " ", re.sub(r"</?b>", "", inside))).split("\0")
        want = "\n".join(x for x in (" ".join(H.unescape(p).split()) for p in parts) if x)
        assert (got[r.page_id].text, got[r.page_id].n_chars) == (want, len(want))


def test_odd_rows(spark):
    rows = [(1, None, "<p>a</p>"), (2, "not an address", "<p>b</p>"), (None, "http://h/", None), (4, "http://h/", ""), (4, "http://h/", ""),
            (5, "http://H:80/x", "<p>c</p>"), (6, "http://h/", "<p>" + "word " * 200_000 + "</p>")]
    got = sorted((str(r.page_id), r.text[:9], len(r.text)) for r in extract(frame(spark, rows)).collect())
    assert got == sorted([("1", "a", 1), ("2", "b", 1), ("None", "", 0), ("4", "", 0), ("4", "", 0), ("5", "c", 1), ("6", "word word", 999_999)])
    assert extract(frame(spark, rows).limit(0)).count() == 0
