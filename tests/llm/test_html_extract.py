import itertools
import random

from gradewell.llm.html_extract import extract, main_text, minimum_cut

PARA = "The river runs past the old stone bridge and the boats go by all day."


def page(body, head="<title>No</title><style>p{}</style>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def test_minimum_cut_against_all_labellings():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(1, 8)
        gain = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i) if rng.random() < 0.4]

        def cost(lab):
            return sum(max(g, 0) if not x else max(-g, 0) for g, x in zip(gain, lab)) + \
                sum(w for i, j, w in edges if lab[i] != lab[j])
        best = min(cost(lab) for lab in itertools.product([False, True], repeat=n))
        assert abs(cost(minimum_cut(gain, edges)) - best) < 1e-6


def test_article_without_boilerplate():
    body = ("<header class=top><a href=/>Site</a></header><nav><ul><li><a href=/a>One</a></li><li><a>Two</a></li></ul></nav>"
            "<script>var t='</p>';</script><!-- <p>hidden</p> --><div class='ad'>" + PARA + "</div>"
            f"<article><header><h1>Big &amp; small</h1></header><p>{PARA}<br>More\n  here &lt;b&gt;.</p><p>Yes."
            f"<p><b>{PARA}</p><form><label>Mail</label><input></form></article>"
            f"<aside class='related'>{PARA}</aside><section id=comments><p>{PARA} I agree!</p></section>"
            "<div class='cookie-notice'>We use cookies to make this site work well for you.</div>"
            "<footer>&copy; 2024 Site</footer>")
    assert main_text(page(body)) == "\n".join(["Big & small", f"{PARA} More here <b>.", "Yes.", PARA])


def test_without_semantic_tags():
    body = (f"<div class=menu><a>Home</a> | <a>About</a></div><div id=content><h2>Title here</h2><div>{PARA}</div>"
            f"<div>Short one.</div><div>{PARA}</div></div><div class=footer>Imprint</div>")
    assert main_text(page(body)) == "\n".join(["Title here", PARA, "Short one.", PARA])


def test_broken_and_empty_pages():
    assert main_text(None) == main_text("") == main_text("<html></html>") == main_text("<script>x") == ""
    assert main_text(f"<p>{PARA}<p>{PARA}</div>") == f"{PARA}\n{PARA}"
    assert main_text(f"<article><p title='a>b'>{PARA}</p>") == PARA
    assert main_text("<p>" + "word " * 50_000 + "</p>").count("word") == 50_000
    assert main_text("<div>" * 3000 + PARA) == PARA
    assert main_text(f"<p>{PARA} 1 < 2") == f"{PARA} 1 < 2"


def test_names_of_the_whole_page_speak_against_no_block():
    text = f"<h1>Title here</h1><p>{PARA}</p><p>{PARA}</p>"
    rest = f"<div class=sidebar><p>{PARA}</p></div><div id=comments><div class=text><p>{PARA} I agree!</p></div></div>"
    want = "\n".join(["Title here", PARA, PARA])
    for tag in ("body class='single-post has-sidebar'", "body class='comments-open no-sidebar'", "body id=search class=modal"):
        assert main_text(f"<html><{tag}>{text}{rest}</body></html>") == want, tag
    for tag in ("div class='no-sidebar'", "div class='ad-free content'", "div class='layout sidebar right'", "form action=/x"):
        assert main_text(page(f"<{tag}>{text}{rest}</{tag.split()[0]}>")) == want, tag
        assert main_text(page(f"<{tag}><article>{text}</article>{rest}</{tag.split()[0]}>")) == want, tag
    long = f"<section id=comments>{f'<p>{PARA} I agree!</p>' * 20}</section>"
    assert main_text(page(f"<article>{text}</article>{long}")) == main_text(page(text + long)) == want
    assert main_text(page(f"<nav><div class=content><p>{PARA}</p></div></nav><p>{PARA}</p>")) == PARA


def test_formulas_fallbacks_and_open_elements_hide_no_text():
    assert main_text(f"<p>{PARA} So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x^2</annotation></math> holds.</p>") == f"{PARA} So x=2 holds."
    for tag in ("noscript", "object"):
        assert main_text(page(f"<article><p>{PARA}</p><{tag}><p>{PARA} Again.</p></{tag}></article>")) == f"{PARA}\n{PARA} Again."
        assert main_text(page(f"<{tag}><p>{PARA}</p><p>{PARA}</p></{tag}>")) == f"{PARA}\n{PARA}"
    assert main_text(page(f"<noscript>Please enable scripts to see this.</noscript><article><p>{PARA}</p></article>")) == PARA
    for tag in ("select", "object", "video", "svg", "iframe", "canvas", "template", "audio"):
        assert main_text(page(f"<p>{PARA}</p><p><{tag}></p><p>{PARA}</p>")) == f"{PARA}\n{PARA}", tag
        if tag != "object":
            assert main_text(page(f"<p>{PARA}</p><{tag}><b>{PARA}</b></{tag}><p>{PARA}</p>")) == f"{PARA}\n{PARA}", tag


def test_query_rows(frame, spark):
    rows = [(1, "u", f"<article><p>{PARA}</p></article>"), (2, None, None), (3, "v", ""), (1, "u", f"<article><p>{PARA}</p></article>"),
            (None, "w", "<p>x</p>")]
    got = sorted(((r.page_id, r.url, r.text) for r in extract(frame(rows, "page_id long, url string, html string")).collect()), key=str)
    assert len(got) == 5 and got.count((1, "u", PARA)) == 2 and (2, None, "") in got and (3, "v", "") in got
    assert extract(frame([], "page_id long, url string, html string")).count() == 0


def test_adverts_between_paragraphs_take_nothing():
    for advert in ("<div class=ad>x</div>", "<aside><a href=/>more links here</a></aside>", "<div class='promo box'><a>Buy</a> now!</div>"):
        for n in (1, 20, 400):
            body = "".join(f"<p>Seven quiet rivers cross valley number {i} before they meet the sea.</p>{advert}" for i in range(n))
            want = "\n".join(f"Seven quiet rivers cross valley number {i} before they meet the sea." for i in range(n))
            assert main_text(page(body)) == want, (advert, n)


def test_short_quoted_and_linked_paragraphs_stay():
    body = (f"<div id=wrap><h1>Title here</h1><p>{PARA}</p><p>Ok</p><blockquote>Quote of someone.</blockquote>"
            f"<p><a href=x>The whole paragraph is one link</a></p><p>{PARA}</p></div>"
            "<ul><li><a href=1>First other page</a></li><li><a href=2>Second other page</a></li></ul>")
    assert main_text(page(body)) == "\n".join(
        ["Title here", PARA, "Ok", "Quote of someone.", "The whole paragraph is one link", PARA])


def test_twenty_thousand_blocks_in_two_seconds():
    import time
    for between in ("<div class=ad>x</div>", "<div>Go on</div>"):
        body = f"<p>{PARA}</p>{between}" * 10_000
        began = time.process_time()
        assert main_text(page(body)).count(PARA) == 10_000
        assert time.process_time() - began < 2


def test_whole_extraction_is_the_least_labelling():
    """The text of a page against every labelling of its blocks, on small random pages."""
    from gradewell.llm.html_extract import log_odds, parse, smoothness
    rng = random.Random(8)
    pieces = [f"<p>{PARA}</p>", "<p>Ok</p>", "<div class=ad>Buy now</div>", "<li><a>Home</a></li>", "<h2>Part</h2>", "<aside>Side note.</aside>",
              "<div>Some few words</div>", "<div><p>Inner text of a box, quite plain.</p><div>and more</div></div>", "<p><a>a link</a> and so on</p>"]
    for _ in range(150):
        body = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 6)))
        if rng.random() < 0.4:
            body = f"<article>{body}</article><footer><p>Imprint</p></footer>"
        blocks = parse(page(body))
        gain, edges = [log_odds(b) for b in blocks], smoothness(blocks)

        def cost(lab):
            return sum(max(g, 0) if not x else max(-g, 0) for g, x in zip(gain, lab)) + sum(w for i, j, w in edges if lab[i] != lab[j])
        best = min(itertools.product([False, True], repeat=len(blocks)), key=lambda lab: (round(cost(lab), 9), sum(lab)))
        assert main_text(page(body)) == "\n".join(b.text for b, x in zip(blocks, best) if x)
