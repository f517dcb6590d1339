"""Boilerplate runs on hosts of many pages."""

from regsync.llm import pages


def test_a_section_notice_of_a_large_host_goes(spark):
    notice = "this notice stands on the pages of one section only"
    rows = [(i, "http://a.example/x", f"<p>n{i} alpha beta gamma delta{i}</p>" + (f"<div>{notice}</div>" if i < 4 else "")) for i in range(120)]
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"n{i} alpha beta gamma delta{i}" for i in range(120))


def texts(spark, htmls):
    rows = [(i, f"http://a.example/{i}", h) for i, h in enumerate(htmls)]
    return [r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_names_inside_an_article_only_cast_doubt(spark):
    page = "<article><header><h1>Title of it</h1></header><p>Area is <math>x+1</math> wide, <object>fallback</object> <div class=\"share-price\">Share price rose</div> <p class=\"reply\">The reply was</p></article>"
    whole = "Title of it Area is x+1 wide, fallback Share price rose The reply was"
    assert texts(spark, [page]) == [whole]
    # on three pages of the host the doubtful blocks are boilerplate, the rest of an article is not
    assert texts(spark, [page, page + " ", page + "<p>x</p>"]) == ["Title of it Area is x+1 wide, fallback"] * 3
    named = "<div class='post'><header>by line</header><p>Text</p><div class='ad'>Buy</div><section class='comments'><p>First!</p></section><form>Mail</form><footer>(c)</footer><div role='navigation'>Home</div></div>"
    assert texts(spark, [named, f"<main>{named}</main>", f"<article>{named}<h2>End</h2></article>"]) == ["Text", "Text", "Text End"]


def test_only_boilerplate_gives_an_empty_text(spark):
    notice = "this notice of thirteen words stands alone on all of the five pages"
    assert texts(spark, [f"<p>{notice}</p>"] * 5) == [""] * 5
    assert texts(spark, [f"<main><article>{notice}</article><article>{notice}</article></main>"] * 3) == [""] * 3
    assert texts(spark, [f"<article>{notice}</article>"] * 5) == [notice] * 5  # marked as the article: repeated texts stay


def test_short_blocks_repeated_on_pages_go(spark):
    bar = "<div>Home Products About us Contact</div>"
    assert texts(spark, [f"{bar}<p>page {i} says something of its own</p>" for i in range(5)]) == [f"page {i} says something of its own" for i in range(5)]
    assert texts(spark, [f"{bar}<p>page {i}</p>" for i in range(2)]) == [f"Home Products About us Contact page {i}" for i in range(2)]
    inside = [f"<p>Home Products About us Contact page {i}</p>" for i in range(5)]  # the same words inside a longer block
    assert texts(spark, inside) == [h[3:-4] for h in inside]
