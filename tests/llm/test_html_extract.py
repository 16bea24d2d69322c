import re

from catalogspark.llm import html_extract
from catalogspark.llm.html_extract import blocks, extract_text, parse

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>'
    '<nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- c --><div class="ad">Buy</div>'
    "<article><h1>Head&amp;</h1><p><b>One&nbsp; two.<br><p>Three\n four</p><div id='side-bar'>S</div><p>&lt;b&gt; a &#233;"
    '</p><section class="user-comments"><p>Nice</p></section><form><p>Mail</p></form></article>'
    "<aside>Side</aside><footer>&copy; x</footer>"
)


def texts(html):
    return "\n".join(blocks(parse(html)))


def test_article_and_its_surroundings():
    assert texts(PAGE) == "Head&\nOne two.\nThree four\n<b> a é"


def test_without_article_and_odd_markup():
    assert texts("<body><header>H</header><div>a<div>b</div>c</div><table><tr><td>1<td>2<tr><td>3</table>") == "a\nb\nc\n1\n2\n3"
    assert texts("<main><ul><li>a<li>b</ul></main><p>after") == "a\nb"
    assert texts("plain & simple &am") == "plain & simple &am"
    assert texts("") == "" and texts("<p") == "" and texts("<div>" * 5000 + "deep") == "deep"
    assert texts("<article><p>a</article><article class='comment'><p>b</article>") == "a"


def test_template_subtrees_go_and_copies_do_not(spark):
    extra = "<div class='x1'><p>Follow us <i>now</i></p></div>"
    rows = [(i, f"http://h.com/{i}", f"<article><p>Own {i}</p><p>Common line</p>{extra}</article>", 1) for i in range(8)]
    rows += [(20 + i, f"http://h.com/{i}", "<article><div>Same page</div></article>", 1) for i in range(30)]
    rows += [(60, "http://few.com/", f"<article><p>Own</p>{extra}</article>", 1), (61, None, None, 1), (62, "x", "", 1)]
    rows += [(70 + i, f"http://d.com/{i}", f"<div>bar</div><div>text {i}</div>", 1) for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int").repartition(3)
    got = {r.id: r for r in extract_text(df).collect()}
    assert len(got) == len(rows)
    # 8 of 38 pages
    assert got[3].text == "Own 3\nCommon line" and got[25].text == "Same page"
    assert got[60].text == "Own\nFollow us now" and got[61].text == got[62].text == "" and got[61].url is None
    assert got[72].text == "text 2" and got[72].n_chars == 6
    assert extract_text(df.limit(0)).count() == 0


def test_templates_go_before_the_lists(spark):
    """Menus and notices that no list knows fall to the method, listed ones that a site repeats too."""
    frame = "<div class='zq'><ul><li>Home<li>News</ul></div><nav>Own menu</nav>{}<section class='k9'>All rights kept</section>"
    rows = [(i, f"http://h.com/{i}", frame.format(f"<div>Text number {i}</div><div class='ad'>Buy {i}</div>")) for i in range(9)]
    got = {r.id: r for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, r in got.items():
        assert (r.text, r.template_words, r.other_words) == (f"Text number {i}", 7, 2)


def test_joined_templates_give_the_same(spark, sf, monkeypatch):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    many = pages.unionAll(pages.withColumnRenamed("url", "u").selectExpr("page_id + 1000 as page_id", "'http://a.com' as url", "concat('<div>q</div>', html) as html"))
    small = sorted(extract_text(many).collect())
    monkeypatch.setattr(html_extract, "BROADCAST_TEMPLATES", 0)
    assert sorted(extract_text(many).collect()) == small


def test_whole_table_has_every_article_paragraph(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    from html import unescape

    for r in extract_text(spark.read.parquet(f"{sf}/pages.parquet")).collect():
        article = re.search("(?s)<article>(.*)</article>", pages[r.id])[1]
        parts = [" ".join(unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n".join(x for x in parts if x)


def test_templates_of_copy_heavy_and_large_hosts_go(spark):
    block = "<div class='x1'>Follow our channel for more news</div>"
    rows = [(i, "http://h.com/", f"<div>Own {i}</div>{block}") for i in range(100)]
    rows += [(1000 + i, "http://h.com/", f"<div>Copied</div>{block}") for i in range(900)]
    # a block on 20 of 200 pages, and a short cell on as many
    rows += [(2000 + i, "http://big.com/", f"<div>Page {i}</div>" + (f"{block}<div>Red</div>" if i < 20 else "")) for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.id: r.text for r in extract_text(df, many_pages=20).collect()}
    assert got[7] == "Own 7" and got[1007] == "Copied"
    assert got[2007] == "Page 7\nRed" and got[2100] == "Page 100"
