"""Pages in forms that sites use: heads in any order, JSON-LD, broken marks, menus and links."""

from datetime import datetime

from corpusloom.operators import pages
from corpusloom.plans import reads

BODY = "<article><p>A text that is long enough to be one, with words in it.</p></article>"
CASES = {
    "suffix": f"<html><head><title>真实文章标题 - 示例媒体</title></head><body><article><h2>示例媒体（公众号：example）</h2>{BODY}</article></body></html>",
    "reordered": f'<html><head><meta content="Open title" property="og:title"><title>Other</title></head><body>{BODY}',
    "twitter": f"<HTML LANG='de'><head><META NAME='twitter:title' CONTENT='Ein &amp; zwei'><title>Other</title></head><body>{BODY}</body></html>",
    "dated": f"""<head><link href='/a/b/?utm_source=x' rel="alternate canonical"><link rel=canonical href="https://site.example/real/"><script type="application/ld+json">not json</script>
        <script TYPE='application/ld+json'>{{"@graph": [{{"@type": "WebPage"}}, {{"@type": "NewsArticle", "datePublished": "2024-02-03T04:05:06Z", "url": "/news/one-story", "headline": "One"}}]}}</script></head><body>{BODY}</body>""",
    "menus": """<body><nav><a href="/x">Menu</a></nav><div class="sidebar"><p>Beside it.</p></div><main><h1>Head</h1><p>First <b>part</b><p>Second &lt;part&gt;<br>third<ul><li><a href='/one'>one link</a><li><a href="/two">two links</a></ul>
        <p>Text with <a href="story-three">a link</a> in the midst of it.</p><script>var t = "</p>";</script><!-- <p>no</p> --></main><footer>End</footer>""",
    "bare": "Only words & more <b>bold",
    "empty": "",
    "null": None,
}


def parsed(spark):
    rows = [(k, "https://publisher.example/blog/p?id=1", html) for k, html in enumerate(CASES.values())]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_articles(spark):
    got = {list(CASES)[r.page_id]: r for r in pages.articles(parsed(spark)).collect()}
    own = "https://publisher.example/blog/p?id=1"
    assert got["suffix"].title == "真实文章标题" and "公众号" in got["suffix"].body
    assert got["reordered"].title == "Open title" and got["twitter"].title == "Ein & zwei" and got["twitter"].lang == "de"
    assert got["dated"].published_at == datetime(2024, 2, 3, 4, 5, 6)
    assert got["dated"].canonical == own  # the first one named is relative, so the page's own address stands
    assert got["menus"].body.split("\n") == ["Head", "First part", "Second <part>", "third", "Text with a link in the midst of it."]
    assert got["menus"].link_chars == len("alink") and got["menus"].canonical == own
    assert got["bare"].body == "Only words & more bold" and got["empty"].body == got["null"].body == "" and got["null"].title is None
    assert pages.articles(parsed(spark).limit(0)).count() == 0


def test_links(spark):
    got = {(list(CASES)[r.page_id], r.link): r for r in pages.article_links(parsed(spark)).collect()}
    assert got["dated", "https://publisher.example/news/one-story"].origin == "json-ld" and got["dated", "https://publisher.example/news/one-story"].title == "One"
    assert got["menus", "https://publisher.example/blog/story-three"].title == "a link"
    assert not any(link.endswith(("/x", "/one", "/two")) for _, link in got)  # paths that short are no articles
    below = {r.link for r in pages.article_links(parsed(spark).withColumn("url", reads.F.lit("https://publisher.example/blog")), below=True).collect() if r.origin == "anchor"}
    assert below == set()


def test_tables_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = pages.articles(rows).collect()
    assert len(found) == rows.count() and all(r.title and r.body and "track(" not in r.body for r in found)
    titles = {r.page_id: r.title for r in reads.a3_page_titles(spark, "/root/testdata/sf0.001").collect() if r.page_id % 3}
    import html

    assert sum(html.unescape(titles[r.page_id]).strip() == r.title for r in found if r.page_id % 3) > 0.9 * len(titles)
