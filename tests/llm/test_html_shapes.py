"""Main text over many shapes of pages whose parts are known, and time on awkward ones."""

import time

import numpy as np
import pytest

from seqloom.llm import html

RNG = np.random.default_rng(21)


def words(n):
    return " ".join(RNG.choice(["lorem", "ipsum", "dolor", "a", "of", "river", "stone,"], n))


def links(n):
    return "<ul>" + "".join(f'<li><a href="/x">{words(2)}</a></li>' for _ in range(n)) + "</ul>"


TEXT = words(60)

#: How the article stands on a page.
WRAPPERS = {
    "article": ("<article>", "</article>"),
    "main": ("<main>", "</main>"),
    "role main": ("<div role=main>", "</div>"),
    "role article": ("<div role='article'>", "</div>"),
    "article in main": ("<main><div class=teaser><p>Other news of the day</p></div><article>", "</article></main>"),
    "content div": ("<div id=content>", "</div>"),
    "plain div": ("<div>", "</div>"),
    "nothing": ("", ""),
    "layout names": ("<div class='page with-sidebar'><div class='story-body'>", "</div></div>"),
}
#: What isn't the article and goes, where the page says so by its elements or names.
AROUND = [
    f"<nav>{links(5)}</nav>", f"<div class=menu>{links(4)}</div>", f"<div class='ad-slot'><p>{words(20)}</p></div>", f"<div id=sponsored-content><p>{words(30)}</p></div>",
    f"<div class=cookie-notice><p>{words(15)}</p></div>", f"<aside><p>{words(25)}</p></aside>", f"<form><label>Name</label><p>{words(6)}</p></form>",
    f"<div class=newsletter-promo-card><p>{words(12)}</p></div>", f"<section class=userComments><p>{words(40)}</p></section>", f"<div class='comment-thread'><p>{words(50)}</p></div>",
    f"<div class='related-stories related'>{links(3)}</div>", "<script>var x = '<p>no</p>';</script>", "<style>p { }</style>", f"<footer><p>{words(20)}</p></footer>",
]


@pytest.mark.parametrize("shape", WRAPPERS)
def test_parts_of_pages_of_every_shape(shape):
    right = found = wanted = 0
    for _ in range(40):
        parts = [("h1", words(int(RNG.integers(2, 9))))] + [("p", words(int(n))) for n in RNG.choice([2, 5, 15, 40, 90], int(RNG.integers(1, 8)))]
        body = "".join(f"<{tag}>{t}</{tag}>" for tag, t in parts)
        around = list(RNG.choice(AROUND, int(RNG.integers(0, 6))))
        cut = int(RNG.integers(0, len(around) + 1))
        begin, end = WRAPPERS[shape]
        page = f"<html><head><title>t</title></head><body>{''.join(around[:cut])}{begin}{body}{end}{''.join(around[cut:])}</body></html>"
        got, want = html.main_text(page).split("\n"), [t for _, t in parts]
        right, found, wanted = right + sum(g in want for g in got), found + len(got), wanted + len(want)
    assert right / found > 0.99 and right / wanted > 0.99, (right, found, wanted)


def test_pages_without_an_article_element():
    assert html.main_text(f"<div id=content><h1>Title here</h1><p>{TEXT}</p><p>short one</p><p>{TEXT}</p></div>") == f"Title here\n{TEXT}\nshort one\n{TEXT}"
    for page in (f"<div role=main><p>{TEXT}</p></div>", f"<div><p>{TEXT}</p></div>", f"<p>{TEXT}", TEXT):
        assert html.main_text(page) == TEXT
    page = f"<body>{links(5)}<h1>Head line</h1><p>{TEXT}</p><p>x y</p><p><a href=/>linked words here</a></p><p>{TEXT}</p>{links(4)}</body>"
    assert html.main_text(page) == f"Head line\n{TEXT}\nx y\nlinked words here\n{TEXT}"


def test_links_in_an_article_stay():
    page = f"<article><p>{TEXT}</p><p><a href=y>Read the report</a></p><p><a href=z>{TEXT}</a></p><p>See <a>six linked words</a></p><ul><li><a>One</a><li><a>Two</a></ul></article>"
    assert html.main_text(page) == f"{TEXT}\nRead the report\n{TEXT}\nSee six linked words\nOne\nTwo"


@pytest.mark.parametrize("name", ["class=user-comments", "class=comment-thread", "class='x comment'", "id=sponsored-content", "class=ad-slot", "class=newsletter-promo-card", "class=userComments", "role=complementary", "class=post-footer"])
def test_marked_elements_go(name):
    assert html.main_text(f"<article><p>a b c</p><div {name}><p>{TEXT}</p></div></article>") == "a b c"
    assert html.main_text(f"<div><p>{TEXT}</p><div {name}><p>{TEXT}</p></div></div>") == TEXT


@pytest.mark.parametrize("name", ["class=with-sidebar", "class=header-image-article", "class=has-ads", "class=no-comments", "class=cookie-recipe", "class=article-header", "class=download", "class=shadow", "class=commentary"])
def test_names_that_only_look_like_marks(name):
    assert html.main_text(f"<article><div {name}><p>{TEXT}</p></div></article>") == TEXT


def test_teasers_in_a_large_main_element():
    cards = "".join(f"<article><p>{words(6)}</p></article>" for _ in range(2))
    assert TEXT in html.main_text(f"<main><p>{TEXT}</p><p>{TEXT}</p>{cards}</main>")


def test_the_tree_asks_for_neighbours():
    def asked(tree):
        return set() if isinstance(tree, float) else {html.FEATURES[tree[0]], *asked(tree[2]), *asked(tree[3])}

    rows = np.array(html.LABELLED, float)
    assert {"links_before", "links_after", "words_after", "link_density", "words"} <= asked(html.trained())
    assert all((html.decide(html.trained(), r[:-1]) >= 0.5) == (r[-1] == 1) for r in rows)


@pytest.mark.parametrize("page", [lambda n: "<svg>" * n, lambda n: "<b>" * n + "<p>x y" * n, lambda n: "<div>" * n + "</i>" * n + "<i>" * n + "</div>" * n, lambda n: "<li>" * n + "</ul>" * n])
def test_time_is_linear(page):
    took = []
    for n in (3_000, 24_000):
        began = time.perf_counter()
        html.blocks(page(n))
        took.append(time.perf_counter() - began)
    assert took[1] < 24 * took[0] + 0.3
