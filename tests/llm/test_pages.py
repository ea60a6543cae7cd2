"""Page extraction: the reader on odd markup, importances against a recursive tree, and articles known from the making."""

import html
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lorewell.llm import dom, pages

DATA = "/root/testdata/sf0.01"
SCHEMA = "page_id long, url string, html string, text string"


def main_text(page):
    elements, blocks = dom.read(page)
    return dom.article(elements, blocks, dom.places(elements)[0], frozenset())


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []), ("plain  text\n only", ["plain text only"]), ("a &amp; b &lt;c&gt; &#233;&eacute; &copy", ["a & b <c> éé ©"]), ("1 < 2 and 3 > 2", ["1 < 2 and 3 > 2"]),
        ("<p>one<br>two<p>three <b>bold</b> end", ["one two", "three bold end"]), ("<p><b>open<br><p>next</p>", ["open", "next"]), ("<ul><li>a<li>b</ul>", ["a", "b"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]), ("<p>x<!-- gone <p> -->y<!DOCTYPE z>", ["xy"]), ("<p>x<!-- open <p>y", ["x"]), ("<p>a<script>var t='</p>';</script>b<style>p{}</style>", ["ab"]),
        ("<script>open <p>x", []), ("<p title='a>b' class=\"c\">t</p>", ["t"]), ("<p title=\"open>t</p>", ["t"]), ("</div><p>a</p></section>", ["a"]), ("<P>UP</P><Nav>menu</NAV>", ["UP"]), ("<p>a</p <p>b", ["a", "b"]),
        ("<body><nav>m</nav><header>h</header><article><header><h1>t</h1></header><p>x</p><aside>s</aside><div class='share ad-box'>ad</div><form>f</form><footer>f</footer></article><p>after</p></body>", ["t", "x"]),
        ("<main><h1>t</h1><div id=sidebar>s</div><p>x <span class=ad>ad</span> y <button>go</button></p><section class='reader-comments'><article>c</article></section></main>", ["t", "x y"]),
        ("<div class='notice'>n</div><div>body</div><div role=navigation>m</div><div hidden>h</div><div class=header>h</div>", ["body"]), ("<article class=comment>c</article><p>x", ["x"]), ("<nav><a>m</a><article><p>left open</p></article>", ["left open"]),
        ("<form><div class='with-sidebar'><article><p>asp</p></article></div></form>", ["asp"]), ("<article></article><p>outside</p>", []), ("<article><p>one</p></article><article><p>two</p></article>", ["one", "two"]), ("<p>a\u00a0b\tc&nbsp;d</p>", ["a b c d"]),
        ("<p>" + "long " * 100_000, [("long " * 100_000).strip()]), ("<div>" * 3000 + "deep", ["deep"]),
    ],
)
def test_reader(page, want):
    assert main_text(page) == want


def tree(all_pages, decay, least):
    """Composite and highest importance of every place of one host, by recursion."""
    m, texts, shows, below = Counter(), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for page in all_pages:
        elements, blocks = dom.read(page)
        place, style = dom.places(elements)
        for k, t in {(place[k], t) for k, t in blocks}:
            texts[k][t] += 1
        own = {(place[k], style[e.parent][0] if k else 0, place[e.parent] if k else None) for k, e in enumerate(elements) if place[k]}
        for k, shown, up in own:
            m[k] += 1
            below[up, shown].add(k)
        for k, s in {(place[k], style[k]) for k in range(len(elements)) if place[k]}:
            if s[1]:
                shows[k][s] += 1
    log = lambda n, k: math.log(n) / math.log(m[k])
    composite, highest = {}, {}

    def visit(k):
        children = [c for s, _ in shows[k] for c in below[k, s]]
        for c in children:
            visit(c)
        if texts[k]:
            composite[k] = 1 - sum(log(n, k) for n in texts[k].values()) / len(texts[k]) if m[k] > 1 else 1.0
        elif shows[k]:
            total, g = sum(shows[k].values()), decay ** len(shows[k])
            shape = -sum(n / total * log(n / total, k) for n in shows[k].values()) if m[k] > 1 else 1.0
            composite[k] = (1 - g) * min(1, shape) + g * sum(n / total * sum(composite[c] for c in below[k, s]) / many for (s, many), n in shows[k].items())
        else:
            composite[k] = 0.0
        highest[k] = max([composite[k] if m[k] >= least else 1.0, *(highest[c] for c in children)])

    visit(dom.key_of("root"))
    return composite, highest, m


def site(rng, host, n, repeated=0):
    """Pages of a host without names for its parts: a bar, a box, an article, a foot."""
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    bar, foot = [word() for _ in range(4)], word()
    out = []
    for k in range(n):
        body = [" ".join(word() for _ in range(8)) for _ in range(rng.randrange(1, 6))]
        body = out[0][1] if out and k <= repeated else body
        more = rng.choice(["", "<table><tr><td>" + word() + "</table>"])
        out.append((f"<html><body><div>{''.join(f'<p>{b}</p>' for b in bar)}</div><section><h2>{word()}</h2>{''.join(f'<p>{x}</p>' for x in body)}{more}</section><div>{foot}</div></body></html>", body, bar, foot))
    return [(f"https://{host}/{k}", *x) for k, x in enumerate(out)]


def test_importance_is_that_of_the_recursive_tree(spark):
    rng = random.Random(1)
    made = {h: site(rng, h, n) for h, n in (("a.example", 30), ("b.example", 3), ("", 1))}
    rows = [(k, u if h else None, page, None) for h, xs in made.items() for k, (u, page, *_) in enumerate(xs)]
    p = pages.PageParams(task_counts=50)
    got = {(r.host, r.place): r for r in pages.importance(pages._counts(spark.createDataFrame(rows, SCHEMA).repartition(5), "html", p), p).collect()}
    for h, xs in made.items():
        composite, highest, m = tree([x[1] for x in xs], p.decay, p.min_pages)
        mine = {k: r for (host, k), r in got.items() if host == h}
        assert set(mine) == set(composite)
        for k, r in mine.items():
            assert r.pages == m[k] and abs(r.highest - highest[k]) < 1e-9 and abs(r.composite - (composite[k] if m[k] >= p.min_pages else 1.0)) < 1e-9


def test_the_tree_alone_finds_what_a_site_repeats(spark):
    rng = random.Random(4)
    made = site(rng, "a.example", 60, 5) + site(rng, "b.example", 20)
    rows = [(k, u, page, "t") for k, (u, page, *_) in enumerate(made)]
    out = pages.extract(spark.createDataFrame(rows, SCHEMA), params=pages.PageParams(named=False))
    assert out.columns == ["page_id", "url", "html", "text", "text_"]
    got = {r.page_id: r.text_.split("\n\n") for r in out.collect()}
    for k, (_, _, body, bar, foot) in enumerate(made):
        assert [x for x in got[k] if x in body] == body and not set(got[k]) & {*bar, foot}


def truth(page):
    """The article of a made page: its parts between block tags."""
    body = page.split("<article>")[1].split("</article>")[0] if "<article>" in page else ""
    parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", body)]
    return "\n\n".join(x for x in parts if x)


def test_whole_table(spark):
    rows = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    got = {r.page_id: r for r in pages.op13_pages(spark, DATA).collect()}
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == truth(r.html) and got[r.page_id].n_chars == len(truth(r.html)) and got[r.page_id].url == r.url


def test_large_tables_of_places_are_joined_by_shuffle(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rng = random.Random(4)
        rows = [(k, u, page, "t") for k, (u, page, *_) in enumerate(site(rng, "a.example", 20))]
        got = pages.extract(spark.createDataFrame(rows, SCHEMA), params=pages.PageParams(named=False)).collect()
        assert len(got) == 20 and all(r.text_ for r in got)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_edges(spark):
    rows = [(1, None, None, None), (None, None, "", "x"), (2, "no url", "<p>x", None), (2, "no url", "<p>x", None), (3, "HTTP://User@Host.Example:80/a", "<nav>n</nav>", None)]
    out = pages.extract(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r.page_id or 0, r.text_) for r in out.collect()) == [(0, ""), (1, ""), (2, "x"), (2, "x"), (3, "")]
    assert pages.extract(spark.createDataFrame([], SCHEMA)).collect() == []
    hosts = spark.createDataFrame(rows, SCHEMA).select(pages.host_of(F.col("url")).alias("h")).collect()
    assert sorted(r.h for r in hosts) == ["", "", "", "", "host.example"]
