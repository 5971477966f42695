"""URL models and block rules."""

import pytest
from pyspark.sql import functions as F

from aerolith.llm import html_blocks, url_model


def pages(spark, urls):
    return spark.createDataFrame([(n, url, "x", "y") for n, url in enumerate(urls)], "page_id long, url string, host string, score string")


def test_rules_and_odd_urls(spark):
    urls = ["http://Example.COM/en/x", "http://www.example.com/en/", "ftp://a.b.example.com/en/1", "http://notexample.com/en/", "http://a.com",
            "x.net/es/", None, "", "http://", "http://net/es/q?z#y", "a://b.net/fr/#x", "http://x.com/?://y.net/es/", "HTTP://É.Com/é" + "z" * 50_000]
    found = url_model.judge_urls(pages(spark, urls)).orderBy("page_id").collect()
    assert found[0].__fields__ == ["page_id", "url", "host", "path", "rule", "verdict", "score"]
    assert [(row.host, row.path[:9], row.rule) for row in found] == [
        ("example.com", "/en/x", "example.com/en/"), ("www.example.com", "/en/", "www.example.com/en/"), ("a.b.example.com", "/en/1", "example.com/en/"),
        ("notexample.com", "/en/", "com/"), ("a.com", "", None), ("", "", None), ("", "", None), ("", "", None), ("", "", None),
        ("net", "/es/q", "net/es/"), ("b.net", "/fr/", "net/fr/"), ("x.com", "/", "com/"), ("É.com", "/é" + "z" * 7, "com/")]
    assert [row.verdict for row in found][5:9] == ["block"] * 4
    assert url_model.judge_urls(pages(spark, urls).filter("false")).count() == 0


def test_untrained_models_allow_what_they_can_read(spark):
    found = url_model.judge_urls(pages(spark, ["http://a.org/x", None])).orderBy("page_id").collect()
    assert [row.verdict for row in found] == ["allow", "block"]


def test_models_learn_what_rules_do_not_reach(spark):
    good = [f"http://host{n}.com/news/story-{n}" for n in range(60)]
    bad = [f"http://casino{n}.net/es/win-{n}" for n in range(60)]
    asked = ["http://host.org/news/story-9", "http://casino.org/win-7", "http://host3.org/news/story-1", "http://casino7.org/win-3"]
    found = url_model.judge_urls(pages(spark, good + bad + asked)).filter("page_id >= 120").orderBy("page_id").collect()
    assert [row.verdict for row in found] == ["allow", "block", "allow", "block"]


def test_grams(spark, one):
    assert one(url_model.grams(F.lit("ab"))) == ["^^^a", "^^ab", "^ab^"]
    assert one(url_model.grams(F.lit(""))) == []


STORY = "This is the text of the story, and it was long enough to be good for all of the readers that have come here to read it."


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("no markup", ""), ("<p>" + STORY, STORY), ("<article>a &lt;b&gt;&nbsp;c", "a <b> c"),
    ("<article><h1>Title</h1><p>x<br>y<p>z</article><p>" + STORY, "Title\n\nx y\n\nz"),
    (f"<nav>{STORY}</nav><div class='cookie-notice'>{STORY}</div><h2>On top</h2><p>{STORY}</p><p>Short.</p><form>{STORY}</form>"
     f"<div id=comments><p>{STORY}</p></div><aside>{STORY}</aside><footer>{STORY}", f"On top\n\n{STORY}\n\nShort."),
    (f"<article><header><h1>T</h1></header><p>{STORY}<script>var t='</p>';</script></p><div class=share><a href=x>Mail</a></div></article>", f"T\n\n{STORY}"),
    ("<article><p>one</p><!-- <p>two</p> --><p>1 < 2 & 3</p><p>cut <fo", "one\n\n1 < 2 & 3\n\ncut"),
    ("<main><p>a\t\n b</p><ul><li><a href=x>linked words only</a></li></ul><p hidden>no</p></main>", "a b\n\nlinked words only"),
    ("<div class='layout with-sidebar'><article><p>kept</article></div>", "kept"), ("<div class=nav-open><main><p>kept</main></div>", "kept"),
    ("<div id=sidebar><main><p>kept</main></div>", "kept"), ("<div id=comments><article><p>a reader</article></div><article><p>kept</article>", "kept"),
    ("<article><p>one</p><p><a href=x>Read the whole of the linked story here</a></p><p>two", "one\n\nRead the whole of the linked story here\n\ntwo"),
    (f"<article><section class=notice-board-history><p>{STORY}</p></section><div class=share-buttons>Share</div><p>end", f"{STORY}\n\nend"),
    ("<article><article class=comment-body><p>a reader</article><p>kept", "kept"),
    ("<article>" + "<div>" * 3000 + "deep", "deep"), ("<article>" + "<p class=\"x" * 2000, ""),
])
def test_main_text(page, text):
    assert html_blocks.main_text(page) == text


def test_stray_end_tags_cost_one_lookup():
    page = "<article>" + "<div>" * 40_000 + "</section>" * 40_000 + "<p>end"  # quadratic work would take minutes
    assert html_blocks.main_text(page) == "end"


def test_open_blocks_take_the_nearest_label():
    assert html_blocks.second_pass([0, 1, 0, 0, -1, 0, 1], -1) == [1, 1, 1, -1, -1, 1, 1]
    assert html_blocks.second_pass([0, 0], -1) == [-1, -1] and html_blocks.second_pass([], 1) == []


def test_pages_keep_their_columns(spark):
    given = spark.createDataFrame([(1, None, "<article>x</article>", "a", "b")] * 2, "page_id long, url string, html string, text string, row string")
    found = html_blocks.extract_pages(given)
    assert found.columns == ["page_id", "url", "html", "row", "text", "n_chars"]
    assert [(row.text, row.n_chars, row.row) for row in found.collect()] == [("x", 1, "b")] * 2
    assert html_blocks.extract_pages(given.filter("false")).count() == 0
