"""What names cut inside marked articles."""

import pytest

from strokemill.llm import htmlmain

TEXT = "<h1>Title</h1><p>First paragraph of the article, long enough to be one.</p><p>Second paragraph of it, which says a little more.</p>"
WANT = "Title First paragraph of the article, long enough to be one. Second paragraph of it, which says a little more."


@pytest.mark.parametrize(
    "inner",
    [
        "<div class='ad'>Buy this now, it is cheap</div>",
        "<div class='comments'><p>Nice one!</p><p>I disagree.</p></div>",
        "<section id='comments'><article class='comment'><p>Nice one!</p></article><article class='comment'><p>No.</p></article></section>",
        "<div class='newsletter notice'>Subscribe to our letter</div>",
        "<aside>Also read this</aside>",
        "<div style='display: none'>unseen words</div>",
        "<div hidden>unseen words</div>",
        "<div class='box sponsored'>Paid for by someone</div>",
        "<div class='comments'>" + "<p>A very long comment of some reader, longer than the article.</p>" * 9 + "</div>",
    ],
)
@pytest.mark.parametrize("place", ["{0}{1}", "{1}{0}"])
def test_no_content_inside_a_marked_article(inner, place):
    page = f"<html><body><nav>Home</nav><article>{place.format(TEXT, inner)}</article><footer>foot</footer></body></html>"
    assert htmlmain.extract(page) == WANT


@pytest.mark.parametrize("outside", ["<section id='comments'><article class='comment'><p>Nice one!</p></article></section>", "<div class='comments'><article><p>Nice one!</p></article></div>"])
def test_comments_beside_the_article_are_no_articles(outside):
    assert htmlmain.extract(f"<html><body><article>{TEXT}</article>{outside}</body></html>") == WANT


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body class='has-sidebar'><article>{TEXT}</article></body></html>",
        f"<html><body><div class='related'><article>{TEXT}</article></div></body></html>",
        f"<html><body><article><div class='share'>{TEXT}</div></article></body></html>",
        "<html><body><article><div class='header'><h1>Title</h1></div>" + TEXT.replace("<h1>Title</h1>", "") + "</article></body></html>",
        f"<html><body><article class='header'>{TEXT}</article></body></html>",
        f"<html><body><article data-x='not hidden here'>{TEXT}</article></body></html>",
    ],
)
def test_names_around_the_text_cut_nothing(page):
    assert htmlmain.extract(page) == WANT


def test_ten_pages_of_a_host(spark):
    rows = [(i, f"http://h.example/{i}", f"<html><body><article><h1>T{i}</h1><p>Words of page {i}, its own ones {i * 7}.</p><div class='ad'>Buy it</div><div class='comments'><p>I read page {i}</p><p>So did I {i}</p></div></article></body></html>") for i in range(10)]
    got = htmlmain.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"T{i} Words of page {i}, its own ones {i * 7}." for i in range(10)}
