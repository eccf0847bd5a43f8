"""Site style trees: templates of a host go, articles stay whole."""

import math
import random

import pytest

from tapegrid.llm import dom, sites
from tests.llm.conftest import prose

SCHEMA = "page_id long, url string, html string"


def kept(page):
    elements, blocks, _ = dom.read(page)
    return [b.text for b, x in zip(blocks, sites.kept(elements, blocks)) if x]


@pytest.mark.parametrize("page, want", [
    ("", []), ("<p", []), ("plain & text &amp;amp; 1 < 2", ["plain & text &amp; 1 < 2"]),
    ("<nav><ul><li>a</ul></nav><article><h1>T</h1><p>x <script>var t='</p>'</script>y</p><div class=ad>n</div></article><footer>f", ["T", "x y"]),
    ("<p>a<br>b\n\t c<b>d</b><p>e&nbsp;f&#65;", ["a b cd", "e fA"]),
    ("<body class=has-sidebar><div id=top>x</div><div class='main sidebar-right'><h1>T</h1><p>a</div><div class=sidebar>s</div>", ["T", "a"]),
    ("<header>h</header><main><header><h1>T</h1></header><p>a<aside>s</aside><form>f</form><section id=comments><p>c</section></main><p>out", ["T", "a"]),
    ("<ul><li><a href=x>m</a><li><a>n</a></ul><ul><li>item <a>x</a></ul><table><tr><td>1<td>2</table>", ["item x", "1", "2"]),
    ('<p title="a > b">z</p><!-- <p>c --> <p>q</p x><textarea><p>no</textarea><div class="cookieNotice">c</div>', ["z", "q"]),
])
def test_names(page, want):
    assert kept(page) == want


def test_long_broken_pages():
    for page in ('<a "' * 100_001, '<a href="x>' * 100_001, "</p>" * 100_000, "<div>" * 30_000 + "</li>" * 30_000, "<" * 200_000, "<!--" * 100_000):
        dom.read(page)


def site(n, seed=0):
    """Pages of one host: a line of unknown name on every page, inside the article, and a different article each."""
    rng = random.Random(seed)
    for i in range(n):
        paragraphs = [prose(rng.randint(5, 40), 1000 * seed + 10 * i + k).replace("\n", " ") for k in range(rng.randint(1, 5))]
        yield (f"Title {seed} {i}", paragraphs,
               f"<title>Title {seed} {i}</title><article><h1>Title {seed} {i}</h1><div class=x7><span>Read this in the app</span></div>" + "".join(f"<p>{p}" for p in paragraphs) + "</article>")


def test_template_goes_and_articles_stay(spark):
    rows, want = [], {}
    for h, n in (("a.example", 40), ("b.example", 3), ("c.example", 2), ("d.example", 1)):
        for title, paragraphs, page in site(n, len(want)):
            k = len(rows)
            rows.append((k, f"https://user@{h.upper()}:80/p{k}?x#y", page))
            want[k] = [title] + ([] if n > 2 else ["Read this in the app"]) + paragraphs
    copied = rows[0]  # copies of one article on its host, most of them with one word more, are no template
    for _ in range(60):
        rows.append((len(rows), copied[1], copied[2].replace("</article>", f"<p>copy {len(rows)}</article>")))
        want[len(rows) - 1] = want[0] + [f"copy {len(rows) - 1}"]
    got = {r.page_id: r for r in sites.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k: r.text for k, r in got.items()} == {k: "\n\n".join(v) for k, v in want.items()}
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_importance_equals_entropy(spark):
    rows = [(i, "http://h/", page) for i, (_, _, page) in enumerate(site(9, 3))] + [(20, "http://h/", "<title>z</title><article><h1>Title 3 1</h1><p>own</article>")]
    found = sites.features(spark.createDataFrame(rows, SCHEMA).select(sites.host_of(sites.F.col("url")).alias("host"), "html"))
    texts, shape = sites.importance(found)
    raw = found.collect()
    styles, held = {}, {}
    for r in raw:
        (held if r.content else styles).setdefault(r.node, {}).setdefault(r.value, set()).add(r.unit)
    around = {(r.node, r.value): r.around for r in raw if r.content}

    def entropy(node):
        m = len(set().union(*styles[node].values()))
        return 1.0 if m < 3 else sum(-len(u) / m * math.log(len(u) / m, m) for u in styles[node].values())

    for r in shape.collect():
        assert r.importance == pytest.approx(entropy(r.node))
    seen = set()
    for r in texts.collect():
        m = len(set().union(*held[r.node].values()))
        k = len(held[r.node][r.value])
        spread = sum(-1 / k * math.log(1 / k, m) for _ in range(k)) if m > 1 else 0
        assert r.importance == pytest.approx(1.0 if m < 3 else 0.9 * (1 - spread) + 0.1 * entropy(around[(r.node, r.value)]))
        seen.add((r.pages, r.own))
    assert (10, 2) in seen and (9, 9) in seen


def test_odd_rows(spark):
    rows = [(None, None, None, 1, "a", 0.5), (1, None, "", 2, "b", None), (1, "no url", "<p>a</p>", 3, None, 0.1), (1, "no url", "<p>a</p>", 3, None, 0.1), (2, "http://x/", None, 4, "c", 0.2),
            (3, "http://x/", "<p>" + prose(50_000, 1) + "</p>", 5, "d", 0.3)]
    df = spark.createDataFrame(rows, SCHEMA + ", _host long, host string, value double")
    got = sites.extract(df)
    assert got.columns == ["page_id", "url", "_host", "host", "value", "text", "n_chars"]
    by = sorted((r.page_id or 0, r.text) for r in got.collect())
    assert [x[0] for x in by] == [0, 1, 1, 1, 2, 3] and [x[1] for x in by[:5]] == ["", "", "a", "a", ""] and len(by[5][1].split(" ")) == 50_000
    assert sites.report(spark.createDataFrame([], SCHEMA)).collect() == []
