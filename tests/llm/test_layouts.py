"""Page text on layouts that name nothing, and on broken marks: F1 of 0.9 or more on each."""

from collections import Counter

import pytest
from quarryline.llm import html_main
from quarryline.llm.dom import Forest

LONG = "Long paragraph with many words, here and there, that tells a story of some length and goes on for a while. " * 2
NAV = '<div class="css-9a"><a href=/>home</a> <a href=/b>about us</a> <a href=/c>contact</a></div>'
FOOT = '<div class="css-77"><a href=/x>terms</a> <a href=/y>privacy</a> &copy; 2024</div>'
TIPS = "".join(f"<li><a href=/t{i}>Tip number {i}</a> do this thing with care and then that one</li>" for i in range(10))
LAYOUTS = {
    "hashed names": (f'{NAV}<div class="css-3f"><h1>Head line</h1><p>{LONG}</p><p>{LONG}</p></div>{FOOT}', f"Head line {LONG}{LONG}"),
    "headline apart": (f"<h1>Head line</h1><div><p>{LONG}</p><p>{LONG}</p></div>", f"Head line {LONG}{LONG}"),
    "thread": (f"{NAV}<div class=thread><div class=msg><p>{LONG}</p></div><div class=msg><p>{LONG}</p></div></div>{FOOT}", LONG + LONG),
    "nested boxes": (f"{NAV}<div id=root><div class=a1><div class=b2><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div><div class=c3><h3>More</h3><ul><li><a href=/>x y</a></li><li><a href=/>z w</a></li></ul></div></div></div>{FOOT}", f"Title {LONG}{LONG}"),
    "bare text": (f"{LONG}<br>{LONG}", LONG + LONG),
    "linked tips": (f"<h1>Ten tips</h1><ul>{TIPS}</ul>", "Ten tips " + " ".join(f"Tip number {i} do this thing with care and then that one" for i in range(10))),
    "table layout": (f"<table><tr><td class=side><a href=/1>one</a> <a href=/2>two</a></td><td><h1>Head</h1><p>{LONG}</p></td></tr></table>", f"Head {LONG}"),
    "loose comment end": (f"<article><p>{LONG}</p><!-- x --!><p>after it {LONG}</p></article>", f"{LONG} after it {LONG}"),
    "empty comments": (f"<article><p>{LONG}</p><!--><p>after</p><!---><p>it</p></article>", f"{LONG} after it"),
    "nameless end tag": (f"<article><p>one </>{LONG}</p></article>", f"one {LONG}"),
    "labels of a drawing": (f"<article><p>{LONG}</p><svg><text>label</text></svg></article>", LONG),
}


def extracted(page):
    forest = Forest()
    forest.add(page)
    return forest.main_texts(html_main.content_nodes(forest, html_main.weights()) > 0.5)[0]


@pytest.mark.parametrize("name", LAYOUTS)
def test_layout(name):
    page, wanted = LAYOUTS[name]
    for whole in (f"<html><head><title>t</title></head><body>{page}</body></html>", page):
        got, want = Counter(extracted(whole).split()), Counter(wanted.split())
        assert 2 * sum((got & want).values()) / (sum(got.values()) + sum(want.values())) >= 0.9, extracted(whole)[:200]
    assert "label" not in got and "</>" not in got
