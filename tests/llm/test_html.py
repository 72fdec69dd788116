"""Main text of pages: the tree against pages of another hand, other seeds, and hostile markup."""

import re
import time

import pytest

from tributary.llm.html import FEATURES, main_text, page_blocks, train_tree
from tributary.llm.html_labels import LABELLED_PAGES, MARK, labelled_pages

LONG = "The council met on Tuesday to discuss the new bridge across the river and agreed to send the plans back to the engineers for another look at costs."
MORE = "Work could begin in spring if the money is found, the mayor said, though some members doubted that the figures in the report would hold for long."


@pytest.fixture(scope="module")
def tree(spark):
    return train_tree(spark)


def texts(spark, tree, *pages):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "page_id long, html string")
    return [r.text for r in main_text(df, tree=tree).orderBy("page_id").collect()]


def test_tree_looks_at_neighbours(tree):
    used = {FEATURES[int(i)] for i in re.findall(r"f\[(\d+)\]", tree)}
    assert "link_share" in used
    assert used & {"words_before", "words_after"} and used & {"link_share_before", "link_share_after"}


def test_pages_of_other_seeds(spark, tree):
    held = labelled_pages(150, seed=4_242)
    assert not set(held) & set(LABELLED_PAGES)
    df = spark.createDataFrame([(i, p) for i, p in enumerate(held)], "page_id long, html string")
    right = total = 0
    for r in main_text(df, tree=tree).collect():
        pairs = [(b["label"], m.main) for b, m in zip(page_blocks(held[r.page_id], labelled=True), r.blocks, strict=True) if b["label"] >= 0]
        right, total = right + sum(bool(y) == m for y, m in pairs), total + len(pairs)
    assert right >= 0.98 * total


def test_article_paragraphs_with_links_stay(spark, tree):
    linked = LONG.replace("new bridge", '<a href="/b">new bridge</a>').replace("the engineers", '<a href="/e">the engineers</a>')
    half = " ".join(f'<a href="/{i}">{w}</a>' if i % 3 == 0 else w for i, w in enumerate(MORE.split()))
    page = f"<body><nav><a href=/>Home</a></nav><article><h1>Bridge</h1><p>{linked}</p><p>{half}</p><p>{LONG}</p></article><footer><p>All rights kept by us</p></footer></body>"
    assert texts(spark, tree, page) == [f"Bridge\n\n{LONG}\n\n{MORE}\n\n{LONG}"]


def test_names_on_what_holds_the_article_condemn_nothing(spark, tree):
    inner = f"<article><h1>Bridge</h1><p>{LONG}</p></article><div class=sidebar><p>{MORE}</p></div>"
    want = f"Bridge\n\n{LONG}"
    pages = [
        f'<html><head><title>t</title></head><body class="has-sidebar menu-open">{inner}</body></html>',
        f'<html><body><div class="content-sidebar-wrap">{inner}</div></body></html>',
        f'<html><body><div id="with-comments"><h1>Bridge</h1><p>{LONG}</p></div><div class="comments"><p>{MORE}</p></div></body></html>',
    ]
    assert texts(spark, tree, *pages) == [want] * 3


def test_pages_without_end_tags(spark, tree):
    want = f"Bridge\n\n{LONG}\n\n{MORE}"
    body = f"<h1>Bridge</h1><p>{LONG}<p>{MORE}"
    pages = [
        f"<html><head><title>t</title><meta charset=utf-8><body>{body}",
        f"<title>t</title>{body}",
        f"<body><svg width=1><path d='M0'>{body}</body>",
        f"<body><a name=top>{body}</body>",
        f"<body>{body}<span hidden>not <span>seen</span> at all</span><p style='display: none'>{MORE}</p></body>",
    ]
    assert texts(spark, tree, *pages) == [want] * 5


def test_menu_without_links_or_marks_goes(spark, tree):
    menu = "<ul><li>Home</li><li>News</li><li>Sport</li><li>Contact</li></ul>"
    listed = "<ul><li>a new deck</li><li>two lanes</li></ul>"
    page = f"<body>{menu}<div><h1>Bridge</h1><p>{LONG}</p>{listed}<p>{MORE}</p></div></body>"
    assert texts(spark, tree, page) == [f"Bridge\n\n{LONG}\n\na new deck\n\ntwo lanes\n\n{MORE}"]


@pytest.mark.parametrize("value", ["²", "99999999999", "-1", "x", "1"])
def test_foreign_pages_are_not_asked_for_labels(spark, tree, value):
    page = f'<body><article><h1>Bridge</h1><p {MARK}="{value}">{LONG}</p></article></body>'
    assert texts(spark, tree, page) == [f"Bridge\n\n{LONG}"]
    assert {b["label"] for b in page_blocks(page)} == {-1}


def test_deep_and_long_pages_take_linear_time():
    def seconds(levels):
        started = time.perf_counter()
        blocks = page_blocks("<div><section>" * levels + "x" + "</p></nav></section>" * levels)
        assert [b["text"] for b in blocks] == ["x"]
        return time.perf_counter() - started

    seconds(500)
    assert seconds(16_000) < 12 * seconds(4_000) + 1.0
    long = page_blocks(f"<p>{'word ' * 400_000}</p>" * 2)
    assert [b["words"] for b in long] == [400_000] * 2


def test_nulls_copies_and_clashing_columns(spark, tree):
    rows = [(1, None, "x", "y"), (2, "", "x", "y"), (3, f"<p>{LONG}", "x", "y"), (3, f"<p>{LONG}", "x", "y")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string, main string")
    found = main_text(df, tree=tree)
    assert sorted((r.page_id, r.text, r.n_chars, r.main) for r in found.collect())[-2:] == [(3, LONG, len(LONG), "y")] * 2
    assert found.where("page_id < 3 and n_chars = 0").count() == 2
