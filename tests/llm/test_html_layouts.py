"""Hand-made page layouts, each with the article that should come out."""

import pytest

from causalframe.llm.html import main_text

P = [f"Paragraph number {i} of the story, which goes on for a while, with commas, and then it ends." for i in range(6)]
BODY = "".join(f"<p>{p}</p>" for p in P)
WANT = "\n\n".join(P)
LINKS = "".join(f'<li><a href="/{i}">Another headline of the day {i}</a></li>' for i in range(30))
NOISE = f'<nav><ul>{LINKS}</ul></nav><div class="cookie-banner"><p>We use cookies, all of them, every day, and more.</p></div>'
AFTER = f'<div class="related"><h3>Related</h3><ul>{LINKS}</ul></div><div id="comments"><p>I like it, very much, indeed, and I say so, often, here.</p></div><footer><p>All rights, reserved, by us, for ever, 2024.</p></footer>'

LAYOUTS = {
    "main of two sections": f"{NOISE}<main><section>{''.join(f'<p>{p}</p>' for p in P[:5])}</section><section><p>{P[5]}</p></section></main>{AFTER}",
    "plain divs": f"<div id=page>{NOISE}<div class=text>{BODY}</div>{AFTER}</div>",
    "deep wrappers": NOISE + "<div>" * 60 + BODY + "</div>" * 60 + AFTER,
    "every paragraph in a div": f"<div id=page>{NOISE}<div class=text>{''.join(f'<div>{p}</div>' for p in P)}</div>{AFTER}</div>",
    "table for layout": f"<table><tr><td><ul>{LINKS}</ul></td><td>{BODY}</td></tr></table>{AFTER}",
    "aside and advert inside": f"{NOISE}<article>{''.join(f'<p>{p}</p>' for p in P[:3])}<aside><p>Read also, this, that, and the other, at once.</p></aside><div class='ad'><p>Buy this, buy that, buy now, buy all.</p></div>{''.join(f'<p>{p}</p>' for p in P[3:])}</article>{AFTER}",
    "comments longer than the article": f"{NOISE}<article>{BODY}</article><section class='comments'>{'<p>Some long, long comment, that goes on, and on, about nothing, at all, for ever.</p>' * 40}</section>",
    "no end tags": f"<body>{NOISE}<div class=story><p>{'<p>'.join(P)}</div>{AFTER}",
    "form and script between": f"{NOISE}<div class=story>{''.join(f'<p>{p}</p>' for p in P[:2])}<form><p>Your name, please, and mail, and age.</p><input></form><script>var x='<p>no</p>';</script>{''.join(f'<p>{p}</p>' for p in P[2:])}</div>{AFTER}",
    "paragraphs in the body itself": f"<body>{BODY}</body>",
    "main within main": f"<div role=main>{NOISE}<div class='post with-comments'>{BODY}</div></div>{AFTER}",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layout(name):
    assert main_text(f"<!doctype html><html><head><title>t</title></head>{LAYOUTS[name]}</html>") == WANT


@pytest.mark.parametrize("name", ["with-sidebar", "has-sidebar", "nav-open", "no-footer", "post-with-comments", "ad-free", "form-page", "search-on", "page-with-header"])
def test_names_are_no_verdict(name):
    assert main_text(f'<body><div class="{name}">{NOISE}{BODY}{AFTER}</div></body>') == WANT


def test_lists_code_and_references():
    page = f"<body>{NOISE}<article><h1>A &amp; B</h1>{BODY}<ul><li>one&nbsp;thing<li>two</ul><pre>x  =\n 1</pre><p>last&#8230; &lt;p&gt;</p></article>{AFTER}</body>"
    assert main_text(page) == "A & B\n\n" + WANT + "\n\none thing\n\ntwo\n\nx = 1\n\nlast… <p>"


def test_very_deep_pages_end():
    assert main_text("<div>" * 100_000 + BODY) == WANT
