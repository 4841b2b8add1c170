import math
import re
from html import unescape

import pytest
from helpers import none_of
from stormledger.llm import html_extract
from stormledger.llm.html_extract import extract, main_text, style_tree
from stormledger.llm.queries import op2_site_style_tree
from pyspark.sql import functions as F

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class=x>
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="ad">Buy</div><div id="cookie-notice">We use</div>
<article><header><h1>The &amp; title</h1></header><p>One <b>two
  three<br>four<p>Five&nbsp;six &lt;x&gt;<div class="share">Tweet</div><ul><li>a<li>b</ul><!-- no <p>gone --><script>1<2</script>
<section class="comments"><p>Reader says</p></section><table><tr><td>c<td>d</table></article><aside>Side</aside><form>Name</form><footer>&copy; me</footer>"""


def test_one_page():
    assert main_text(PAGE) == "The & title\nOne two three four\nFive six <x>\na\nb\nc\nd"
    assert main_text(None) == main_text("") == main_text("<nav>x</nav>") == ""
    assert main_text("just text  &amp; more") == "just text & more"
    assert main_text("<p>a</p><p>b" + "<div>" * 3000 + "deep") == "a\nb\ndeep"
    assert main_text("<article>a<p>b</article><article>c</article>") == "a\nb\nc"


def test_repeated_branches_go(spark):
    rows = [(i, f"http://h.org/{i}", f"<html><body><div class='top'>Always the same words here</div><div class='text'><p>unique text {i} {i * i} and so on</p><p>second {i + 7000}</p></div><div class='x'>{'One of two' if i % 2 else 'Two of two'}</div></body></html>") for i in range(40)]
    rows += [(100, None, rows[0][2]), (101, "http://other.org/", rows[0][2]), (102, "http://h.org/z", None), (102, "http://h.org/z", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id, r.text) for r in extract(df).collect())
    for i, text in got[:40]:
        assert text == f"unique text {i} {i * i} and so on\nsecond {i + 7000}"
    assert got[40][1] == got[41][1] == "Always the same words here\nunique text 0 0 and so on\nsecond 7000\nTwo of two"
    assert got[42:] == [(102, ""), (102, "")]
    assert extract(none_of(df)).collect() == []
    assert all(0 <= r.importance <= 1 for r in style_tree(df).collect())


def test_query_has_the_articles(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op2_site_style_tree(spark, sf).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id].html or "", re.S)
        want = [" ".join(unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", inner[1] if inner else "")]
        have = re.sub(r"\s", "", r.text)
        assert have == re.sub(r"\s", "", "".join(want)) and r.n_chars == len(r.text)


@pytest.mark.parametrize("size, least", [("sf0.001", 0.9), ("sf0.01", 0.99)])
def test_the_tree_alone_finds_the_articles(spark, size, least):
    """No article tag and no word of a tag or class: only importance decides, on hosts of one page (sf0.001, a short one may have no worthiest box) and of a few."""
    pages = spark.read.parquet(f"/root/testdata/{size}/pages.parquet")
    bare = pages.withColumn("html", F.replace(F.replace("html", F.lit("<article>"), F.lit("<div>")), F.lit("</article>"), F.lit("</div>")))
    want = {r.page_id: r.text for r in extract(pages).collect()}
    got = {r.page_id: r.text for r in extract(bare, names=False).collect()}
    assert all(want[k] in got[k] for k in want)
    assert sum(got[k] == want[k] for k in want) >= least * len(want)


def test_boxes_of_a_page(spark):
    """A small host, boxes with words that stay the same and boxes with words that change; an own box in the main content stays."""
    page = "<html><body><div class=a><a>Home {0}</a><a>News</a></div><div class=w><div class=t><h1>Title {0}</h1><div class=lead>In short {1}</div><p>The long story of {0} and {1} goes on with {2}</p><p>and on {0}{2}</p></div><div class=r>See {1}</div></div><div class=f>by {0}</div></body></html>"
    df = spark.createDataFrame([(i, f"http://h{i % 4}.org/{i}", page.format(*(f"word{i * 37 + k}" for k in range(3)))) for i in range(12)], "page_id long, url string, html string")
    for r in extract(df, names=False).collect():
        x = [f"word{r.page_id * 37 + k}" for k in range(3)]
        assert r.text == f"Title {x[0]}\nIn short {x[1]}\nThe long story of {x[0]} and {x[1]} goes on with {x[2]}\nand on {x[0]}{x[2]}"


def texts_of(spark, pages):
    df = spark.createDataFrame([(i, f"http://h.org/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in extract(df).collect()}


def test_a_host_that_is_mostly_copies_keeps_its_articles(spark):
    body = ["a copied story of some length"] * 80 + [f"unique story {i} {i * i} of some length" for i in range(20)]
    for before, after in (("<article>", "</article>"), ("<div id=wrap><article><div class=content>", "</div></article></div>"), ("<main><div class=content>", "</div></main>"), ("<div class=content>", "</div>")):
        got = texts_of(spark, [f"<html><body><div class=top>Always the same</div>{before}<p>{x}</p>{after}</body></html>" for x in body])
        assert len(got) == 100 and all(x in got[i] for i, x in enumerate(body)), before


def test_long_menus_go_without_the_article(spark):
    menu = "<div class=top><a>" + "the same long list of places " * 60 + "</a></div>"
    for before, after in (("<article>", "</article>"), ("<div class=content>", "</div>")):
        got = texts_of(spark, [f"<html><body><div id=wrap>{menu}{before}<p>the story of page {i} {i * i}</p><div class=box>The same box</div>{after}</div></body></html>" for i in range(40)])
        assert got == {i: f"the story of page {i} {i * i}" for i in range(40)}


def test_names_of_states_and_wrappers_keep_the_article():
    assert main_text("<body class='has-sidebar'><article class='post comments-open'>a<div class=comments><article>c</article></div></article><div class=sidebar>s</div>") == "a"
    assert main_text("<body class=modal>a") == "a"
    assert main_text("<form id=f><main class=no-sidebar><article>a</article></main></form><div class=related><article>r</article></div>") == "a"
    assert main_text("<div class=widget><article class=promo>a<div class=ad>x</div></article></div>") == "a"
    assert main_text("<aside><article>r</article></aside><p>a") == "a"


def plain_tree(pages):
    """(importance, own) of each path of one host's pages, by the definition, with plain sums over all pages."""
    rows = [html_extract.tree_rows(p, False) for p in pages]
    paths = {path for styles, _, _ in rows for path, *_ in styles}
    m, gamma, presentation, weight, news, own = {}, {}, {}, {}, {}, {}
    for path in paths:
        styles = [x for s, _, _ in rows for p, x, *_ in s if p == path]
        m[path], counts = len(styles), [styles.count(x) for x in set(styles)]
        base = math.log(max(m[path], html_extract.BASE))
        gamma[path] = html_extract.GAMMA ** len(counts)
        presentation[path] = min(1, max(0, -sum(n / m[path] * math.log(n / m[path]) for n in counts) / base))
        told = [(f, w) for _, texts, _ in rows for (p, f), w in texts.items() if p == path]
        weight[path] = sum(w for _, w in told)
        seen = lambda f: sum(g == f for g, _ in told)
        news[path] = sum(w * min(1, max(0, 1 - math.log(seen(f)) / base)) for f, w in told)
        own[path] = sum(w for f, w in told if seen(f) == 1)
    below = {path: {p for _, _, above in rows for p, x in above if x == path} for path in paths}
    out = {}
    for path in paths:
        all_ = sum(weight[p] for p in below[path])
        worth = sum((1 - gamma[p]) * presentation[p] * weight[p] + gamma[p] * news[p] for p in below[path])
        out[path] = ((1 - gamma[path]) * presentation[path] + gamma[path] * (worth / all_ if all_ else 0), sum(own[p] for p in below[path]) / all_ if all_ else 0)
    return out


def test_the_tree_against_plain_sums(spark, sf):
    """Pages of two hosts: importance and own share of every node are those of the definition."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").where("html is not null").orderBy("page_id").limit(10).collect()
    hosts = {"a.org": [p.html for p in pages[:6]] + [PAGE, PAGE], "b.org": [p.html for p in pages[6:]]}
    df = spark.createDataFrame([(f"http://{h}/{k}", x) for h, xs in hosts.items() for k, x in enumerate(xs)], "url string, html string")
    got = {(r.host, r.path): (r.importance, r.own) for r in style_tree(df, names=False).collect()}
    want = {(h, path): x for h, xs in hosts.items() for path, x in plain_tree(xs).items()}
    assert set(got) <= set(want) and len(got) > 30
    for k, (importance, own) in got.items():
        assert importance == pytest.approx(want[k][0], abs=1e-9) and own == pytest.approx(want[k][1], abs=1e-9)


def test_the_query_rests_on_the_tree(spark):
    """Without cuts nearly every text of the query would be another one, so it is the tree that makes it."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where("html is not null")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    off = {r.page_id: main_text(r.html, names=False) for r in pages.collect()}
    assert sum(got[k] != off[k] for k in off) >= 0.9 * len(off)
