import pytest

from causalframe.llm.html import main_text

TEXT = [f"Paragraph {i}, which goes on, and on, until it is long enough to count as text." for i in range(4)]
BODY = "".join(f"<p>{t}</p>" for t in TEXT)
WANT = "\n\n".join(TEXT)
SIDE = '<div class="cookie-notice"><p>We use cookies, all of them, every day.</p></div><div class="comments"><p>A comment, I like it, very much, indeed.</p></div>'


@pytest.mark.parametrize("start", ['<div class="layout has-sidebar">', '<div class="with-nav">', '<div class="post-header">', '<section title="The hidden valley">', '<div data-x="aria-hidden=true">', '<div title=\'class="ads"\'>', '<div class="sidebar">'])
def test_wrappers_keep_the_article(start):
    assert main_text(f"<body>{start}{BODY}</div></section></body>") == WANT
    if "sidebar\"" not in start.replace("has-sidebar", ""):
        assert main_text(f"<body>{SIDE}{start}{BODY}{SIDE}</div></section>{SIDE}</body>") == WANT
        assert main_text(f"<body>{SIDE}{start}<article>{BODY}</article>{SIDE}</div></section>{SIDE}</body>") == WANT


@pytest.mark.parametrize("start", ["<div hidden>", '<div hidden="">', '<div class=x HIDDEN>', '<div aria-hidden="true">', '<div style="color:red; display : none">', '<div class="page-comments">', '<div id="comments">'])
def test_what_stays_out(start):
    long = "".join(f"<p>Other {i}, which goes on, and on, and is no part of it, not at all.</p>" for i in range(9))
    assert main_text(f"<body><main>{BODY}</main>{start}{long}</div></body>") == WANT
    if "page-" not in start:
        assert main_text(f"<body><div>{BODY}</div>{start}{long}</div></body>") == WANT
