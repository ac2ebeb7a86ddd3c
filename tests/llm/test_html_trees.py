import time

import pytest

from panelforge.llm.html_extract import main_text

PROSE = "A sentence of the article, long enough to count, with commas, and with more words in it than any menu has. " * 3


def page(body):
    return f"<html><head><title>x</title></head><body>{body}</body></html>"


def test_names_that_tell_in_part_keep_prose_and_lose_links():
    parts = "".join(f'<p class="{c}">{c} {PROSE}</p>' for c in ("form-factor", "related-work", "notes-share", "plain"))
    links = '<div class="related-reading"><a href="/a">One more story</a> <a href="/b">And another</a></div>'
    wholly = "".join(f'<div class="{c}">gone {PROSE}</div>' for c in ("comment-list", "ad-slot", "share-buttons", "newsletter", "sidebar2"))
    text = main_text(page(f"<article>{parts}{links}{wholly}</article>"))
    assert [b.split(" ")[0] for b in text.split("\n\n")] == ["form-factor", "related-work", "notes-share", "plain"]


def test_headers_of_articles_stay_and_those_of_pages_go():
    text = main_text(page(f"<header><h1>Site</h1></header><article><header><h1>Title of it</h1></header><p>{PROSE}</p><footer>gone</footer></article>"))
    assert text == f"Title of it\n\n{PROSE.strip()}"


def test_formulas_stay():
    assert main_text(page(f"<article><p>{PROSE} where <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p></article>")).endswith("where x=1 holds")


def test_bodies_in_several_containers():
    inner = lambda k: f'<div><div id="{k}"><p>{k} {PROSE}</p><p>{k} {PROSE}</p></div></div>'
    text = main_text(page(f'<div id="wrap">{inner("a")}{inner("b")}</div><div class="footer">gone</div>'))
    assert [b[0] for b in text.split("\n\n")] == ["a", "a", "b", "b"]


def plain_best(tree):
    """(tag, text, children) scored by its definition, container by container."""

    def score(node):
        tag, text, children = node
        own = sum(points(c) for c in children if c[0] == "p")
        return own + sum(score(c) / 2 for c in children if c[0] == "div")

    def points(node):
        return 1 + node[1].count(",") + min(len(node[1]) / 100, 3)

    every, todo = [], [tree]
    while todo:
        node = todo.pop(0)
        every.append(node)
        todo = [c for c in node[2] if c[0] == "div"] + todo
    return max(every, key=score)


def test_best_container_against_plain_scores():
    def markup(node):
        return f"<{node[0]}>{node[1]}{''.join(map(markup, node[2]))}</{node[0]}>"

    p = lambda k, n: ("p", f"{k} " + "word, " * n + "end", [])
    for sizes in ((30, 2, 1), (2, 30, 1), (1, 2, 30), (8, 8, 40)):
        a, b, c = (("div", "", [p(k, n), p(k, n)]) for k, n in zip("abc", sizes, strict=True))
        tree = ("div", "", [("div", "", [a]), ("div", "", [b, c])])
        best = plain_best(tree)
        text = main_text(page(markup(tree)))
        assert all(child[1].split(" ")[0] in text for child in best[2] if child[0] == "p")


def test_deep_pages_take_linear_time():
    deep = page("<div><p>some text, and <a href=x>a link</a> here</p>" * 18_000 + "</div>" * 18_000)
    assert len(deep) > 900_000
    began = time.process_time()
    assert main_text(deep).count("some text") > 0
    assert time.process_time() - began < 5
    began = time.process_time()
    main_text(page("<div>" * 90_000 + "x" + "</div>" * 90_000))
    assert time.process_time() - began < 5


LONG = "This paragraph of the article says something of substance, with commas, clauses, and so on, about its results. " * 4


def article(inner):
    return main_text(f"<html><body><article><h1>T</h1><p>{LONG}</p>{inner}</article></body></html>")


@pytest.mark.parametrize("attribute", ['id="discussion"', 'class="search"', 'class="tags"', 'class="related"', 'class="promo"'])
def test_parts_of_an_article_that_share_names_with_boilerplate(attribute):
    assert "the very end" in article(f"<section {attribute}><h2>Part</h2><p>{LONG} the very end</p></section>")
    assert "one more" not in article(f"<section {attribute}><a href='#'>Another title</a> <a href='#'>one more</a></section>")
    assert "the very end" not in main_text(f"<html><body><article><p>{LONG}</p></article><div {attribute}><p>{LONG} the very end</p></div></body></html>")


@pytest.mark.parametrize("name", ["comments", "comment-list", "newsletter", "ad", "sidebar"])
def test_boilerplate_inside_an_article_goes_whatever_its_length(name):
    assert "the very end" not in article(f"<section id='{name}'><p>{LONG} the very end</p></section>")


def test_references_are_no_menu():
    items = "".join(f"<li><a href='#'>Smith, J., and Miller, A. (20{10 + i}). On the theory of things, part {i}.</a></li>" for i in range(5))
    menu = "".join(f"<li><a href='#'>{t}</a></li>" for t in ("Home page", "All the news", "Sport today", "Travel, food"))
    got = article(f"<h2>References</h2><ol>{items}</ol><ul>{menu}</ul>")
    assert got.count("Smith, J.") == 5 and "Sport" not in got


def test_nesting_is_linear():
    began = time.perf_counter()
    assert main_text("<p><button>" + "<div>" * 30_000 + "x") == ""
    assert time.perf_counter() - began < 3
