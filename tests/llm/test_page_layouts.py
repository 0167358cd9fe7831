"""Main text of hand-written pages in layouts of many kinds, none of them learned from."""

import pytest

from weirflow.llm import html_extract as H

S = "Some plain words of a sentence that is long enough to be one, with a comma and more of it."
P = f"<p>{S}</p>"
NAV = "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>About us</a></li></ul></nav>"
FOOT = "<footer>&copy; 2024 Site Name. All rights reserved.</footer>"
PAGES = {
    "paragraphs alone": (P * 3, [S] * 3),
    "a short article alone": (f"<article>{P}</article>", [S]),
    "a section": (f"{NAV}<section class=story><h2>Title here</h2>{P * 3}</section>{FOOT}", ["Title here", S, S, S]),
    "classes that only look like hints": (f"{NAV}<main class='page side-by-side'><h1>Title here</h1>{P * 3}</main>{FOOT}", ["Title here", S, S, S]),
    "a drawing closed by a slash": (f"<article><h1>Title</h1>{P}<svg viewBox='0 0 1 1'/>{P}{P}</article>", ["Title", S, S, S]),
    "a drawing with content": (f"<article><h1>Title</h1>{P}<svg><text>no text</text></svg>{P}</article>", ["Title", S, S]),
    "a formula in a sentence": (f"<article><h1>Title</h1>{P}<p>{S} <math/> More words here.</p>{P}</article>", ["Title", S, f"{S} More words here.", S]),
    "an advert in the article": (f"{NAV}<article><h1>Title</h1>{P}<div class='ad'><p>Buy boots now at half the price!</p></div>{P}</article>{FOOT}", ["Title", S, S]),
    "code first": (f"{NAV}<article><pre>x = 1\ny = 2 and more code</pre>{P}{P}</article>{FOOT}", ["x = 1 y = 2 and more code", S, S]),
    "a sidebar": (f"{NAV}<div class=content><h1>Title</h1>{P * 2}</div><aside class=sidebar><h3>Related</h3><ul><li><a href=/x>Other story</a></li></ul></aside>{FOOT}", ["Title", S, S]),
    "comments": (f"<article><h1>Title</h1>{P * 2}</article><section class=comments><h3>Comments</h3><div class=comment><p>Nice</p><p>I liked this a lot, thanks for it.</p></div></section>{FOOT}", ["Title", S, S]),
    "a notice and a form": (f"<div class=cookie-notice><p>We use cookies to give you a better experience. <button>OK</button></p></div>{NAV}<main><h1>Title</h1>{P * 2}</main><form><label>Mail</label><input><button>Join</button></form>{FOOT}", ["Title", S, S]),
    "no container": (f"<h1>Title</h1>{P * 2}{FOOT}", ["Title", S, S]),
    "a list": (f"{NAV}<main><h1>Title</h1><ol><li>{S}</li><li>{S}</li></ol></main>{FOOT}", ["Title", S, S]),
    "a table": (f"{NAV}<article><h1>Title</h1>{P}<table><tr><td>Alpha<td>12 units</table>{P}</article>", ["Title", S, "Alpha", "12 units", S]),
    "a site header": (f"<header><h1>Site name</h1><p>The best site of all</p></header>{NAV}<article><h1>Title</h1>{P * 2}</article>{FOOT}", ["Title", S, S]),
    "a promotion in the article": (f"{NAV}<article><h1>Title</h1>{P}<aside class=promo><p>Subscribe to our letter today and never miss a thing.</p></aside>{P}</article>{FOOT}", ["Title", S, S]),
    "a quotation": (f"{NAV}<div id=post><h2>Title</h2>{P}<blockquote><p>{S}</p></blockquote>{P}</div>{FOOT}", ["Title", S, S, S]),
}


@pytest.fixture(scope="module")
def model():
    return H.trained()


@pytest.mark.parametrize("kind", PAGES)
def test_layout(model, kind):
    body, want = PAGES[kind]
    assert H.main_text(f"<!DOCTYPE html><html><head><title>t</title></head><body>{body}</body></html>", model) == "\n".join(want)
