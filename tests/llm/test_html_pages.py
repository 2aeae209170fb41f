"""Pages whose names of furniture stand on what holds the text, and furniture under other names."""

import pytest

from telescribe.llm.html_extract import main_text

ONE = "The first paragraph of the article, with commas, and long enough to count as prose for the scores."
TWO = "A second one, which says a little more, and ends here."
THREE = "A third, so that the container is found."
BODY = f"<p>{ONE}</p><p>{TWO}</p><p>{THREE}</p>"
TEXT = f"{ONE}\n\n{TWO}\n\n{THREE}"
LINKS = "<a href='x'>link text</a> " * 40


@pytest.mark.parametrize("html, want", [
    (f"<body><form><div>{BODY}</div></form></body>", TEXT),
    (f"<body><form action='/'><input name='q'><article>{BODY}</article></form></body>", TEXT),
    (f'<body><div class="page-with-sidebar"><article>{BODY}</article><div class="sidebar">Menu and more</div></div></body>', TEXT),
    (f'<body><div class="page-with-sidebar"><div>{BODY}</div><div class="sidebar">Menu and more</div></div></body>', TEXT),
    (f'<body><div id="header-main-wrapper"><main>{BODY}</main></div></body>', TEXT),
    (f'<article>{BODY}<p class="social">Society is a thing, and people talk.</p></article>', TEXT + "\n\nSociety is a thing, and people talk."),
    (f'<article>{BODY}<div class="banner-box"><p>{ONE}</p></div></article>', f"{TEXT}\n\n{ONE}"),
    (f'<article>{BODY}<div class="banner-box">Sale</div><div class="ad"><p>{ONE}</p></div><div class="share">{LINKS}</div></article>', TEXT),
    (f'<body><article>{BODY}</article><section class="discussion"><p>{ONE} I agree.</p></section></body>', TEXT),
    (f'<article>{BODY}<section class="opinions"><h3>3 Comments</h3><p>I agree, very much so.</p></section></article>', TEXT),
    (f'<main>{BODY}<div class="comments"><article class="comment"><p>{ONE}</p></article></div></main>', TEXT),
    (f'<article><h2>Comments on the law</h2>{BODY}</article>', "Comments on the law\n\n" + TEXT),
    (f'<article><section><h2>Discussion</h2>{BODY}</section></article>', "Discussion\n\n" + TEXT),
    (f'<body><div>Save 20 percent today</div><div id="x">{BODY}</div></body>', TEXT),
    (f'<body><h1>Title</h1><div><div>{BODY}</div></div><div class="footer">imprint</div></body>', "Title\n\n" + TEXT),
    (f'<body><div class="nav">{LINKS}</div><div>{BODY}</div><div>{LINKS}</div></body>', TEXT),
    (f'<body><nav>{LINKS}</nav><div class="notice">We use cookies.</div><article>{BODY}<aside>Aside</aside><form>Name</form></article><footer>Footer</footer></body>', TEXT),
    (f'<body><aside>{BODY}</aside></body>', TEXT),
    (f'<body><div class="content"><header><h1>Head</h1></header>{BODY}</div></body>', TEXT),
])
def test_pages(html, want):
    assert main_text(html) == want


@pytest.mark.parametrize("html", [None, "", "<html></html>", "<script>a < b</script>", "<div hidden>x</div>", "<nav>menu</nav>"])
def test_pages_without_text(html):
    assert main_text(html) == ""
