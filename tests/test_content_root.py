"""The content root by text and link density, against a plain recomputation; markup that used to take quadratic time."""

import random
import time

import pytest

from veriglot.sources import html as H

PROSE = "This is a sentence of the story that goes on for a while, with a <a href='/x'>link</a> in it. "
MENU = "<ul>" + "".join(f"<li><a href='/{i}'>Menu item number {i}</a></li>" for i in range(12)) + "</ul>"


def texts(page):
    return [b[1] for b in H.page_blocks(page)]


def page(content, menu=f"<nav>{MENU}</nav>", foot="<footer><p>Copyright of the company and its partners</p></footer>"):
    return f"<html><head><title>t</title></head><body>{menu}{content}{foot}</body></html>"


STORY = f"<h1>A heading of the story</h1><p>{PROSE * 3}</p><p>{PROSE * 2}</p>"


@pytest.mark.parametrize("content", [f"<div id='c'>{STORY}</div>", f"<div><div>{STORY}</div></div>", f"<section>{STORY}</section>", STORY, f"<table><tr><td>{STORY}</td></tr></table>"])
@pytest.mark.parametrize("menu", [f"<nav>{MENU}</nav>", f"<div class='menu'>{MENU}</div>", MENU])
def test_menus_and_footers_go(content, menu):
    found = " ".join(texts(page(content, menu)))
    assert "sentence of the story" in found and "heading of the story" in found
    assert "Menu item" not in found and "Copyright" not in found


def test_root_is_the_innermost_region():
    tree = H.Tree(page(f"<div id='outer'><div id='side'>{MENU}</div><div id='inner'>{STORY}</div></div>"))
    assert H.content_root(tree).attrs.get("id") == "inner"
    both = H.Tree(page(f"<div id='outer'><div id='a'>{STORY}</div><div id='b'>{STORY}</div></div>"))
    assert H.content_root(both).attrs.get("id") == "outer"


def test_article_and_main_come_first():
    assert texts(page(f"<div>{STORY * 3}</div><main><p>The main text here</p>{MENU}</main>"))[0] == "The main text here"
    assert texts(page(f"<main>{STORY}</main><article><p>The article here</p></article>")) == ["The article here"]


def test_pages_without_prose_keep_their_blocks():
    assert texts("<p>Short words here</p>") == ["Short words here"]
    assert texts("") == [] and texts(None) == [] and texts("<div></div>") == []


def slow_region(node, link=False):
    link = link or node.tag == "a"
    own = sum(len(c.strip()) for c in node.children if isinstance(c, str) and not isinstance(c, H.Comment))
    cost = 0 if node.tag in H.FREE else H.CHROME_COST if node.tag in H.CHROME else H.ELEMENT_COST
    own *= -H.LINK_COST if link else 0 if node.tag in ("script", "style") else 1
    below = sum(max(0, slow_region(c, link)) for c in node.children if isinstance(c, H.Node) and c.tag not in ("script", "style"))
    return own - cost + below


def test_measures_against_plain():
    rng = random.Random(6)
    for _ in range(150):
        parts = rng.choices(["<div>", "</div>", "<p>", "</p>", "<a href='x'>", "</a>", "some text ", "x", "<script>var a</script>", "<!-- c -->", "<br>", "</nav>", "<nav>", "<span>", "</span>"], k=rng.randint(0, 60))
        tree = H.Tree("".join(parts))
        for node in [tree.root, *H.walk(tree.root)]:
            assert node.size == len(H.all_text(node))
            if node is tree.root:
                assert node.region == pytest.approx(slow_region(node))


@pytest.mark.parametrize("made", ["<div>" * 20_000, "<div>" * 20_000 + "--------------" + "</div>" * 20_000, "<p></b>" * 20_000, "<b><i></b></i></u>" * 20_000, "<span>" * 20_000 + "short" + "</div>" * 20_000, "<div><p>ab</p>" * 10_000])
def test_hostile_markup_in_linear_time(made):
    began = time.perf_counter()
    H.page_blocks(made)
    assert time.perf_counter() - began < 2
