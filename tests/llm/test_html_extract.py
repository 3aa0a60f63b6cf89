import random

from hypothesis import given
from hypothesis import strategies as st

from recordloom.llm import html_extract as H

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><script>var a="</p><b>";</script></head><body>
<header>Site name</header><nav><ul><li><a href="/a">Home page of it</a></li></ul></nav><!-- <p>no</p> --><div class="cookie-notice">We use cookies here and there</div>
<article><h1>A title &lt;x&gt;</h1><p>First   line
goes <b>o</b>n&nbsp;here.</p><aside>See also these other things</aside><div class="ad">Buy it</div><p>Second &amp
one</p><form><p>Mail</p><input value="x"></form><ul><li>item one</li><li>item two</ul><style>p{}</style>
<section class="comments"><p>I think so too, a reader</p></section></article><footer>&copy; foot of the page</footer></body></html>"""
WANT = "A title <x>\nFirst line goes on here.\nSecond & one\nitem one\nitem two"


def _brute(scores):
    best, span = 0.0, (0, 0)
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            if sum(scores[i:j]) > best:
                best, span = sum(scores[i:j]), (i, j)
    return best, span


@given(st.lists(st.integers(-4, 4), max_size=14))
def test_scan_is_the_maximum(scores):
    a, b = H.best_region([float(x) for x in scores])
    assert sum(scores[a:b]) == _brute(scores)[0]


def test_article():
    assert H.extract(PAGE, H.Weights()) == WANT


def test_without_landmark_uses_learned_weights():
    w = H.fit(dict(H.count(PAGE)))
    filler = " and it goes on with many more words than any inset costs"
    plain = PAGE.replace("<article>", '<div class="post">').replace("</article>", "</div>").replace("one</p>", f"one{filler}</p>").replace("item one", f"item one{filler}").replace("item two", f"item two{filler}").replace("here.</p>", f"here.{filler}</p>")
    assert H.extract(plain, w) == WANT.replace("& one", f"& one{filler}").replace("item one", f"item one{filler}").replace("two", f"two{filler}").replace("here.", f"here.{filler}")


def test_a_landmark_weighs_and_does_not_bound_the_scan():
    w = H.fit(H.count(PAGE))
    story = "A long story that stands in a plain element and has many words of its own. " * 10
    teasers = "<article><p>A teaser of some words</p></article>" * 3
    assert H.extract(f"<nav>Home</nav>{teasers}<div><p>{story}</p></div>{teasers}<footer>Foot</footer>", w) == story.strip()
    assert story.strip() in H.extract(f"<div><p>{story}</p></div><article><p>A reader says this or that of it</p></article>", w)
    # A few words beside of an article are still no part of it, and neighbours both are.
    assert H.extract(f"<p>Posted on Monday by a writer</p><article><ul><li>x</li></ul><p>{story}</p><ul><li>y</li></ul></article><p>All rights are reserved</p>", w) == f"x\n{story.strip()}\ny"
    assert H.extract("<article><p>one two</p><aside>See also these other things of the site</aside><p>last</p></article>", w) == "one two\nlast"
    assert H.extract("<article><p>first of them</p></article><article><p>second of them</p></article>", w) == "first of them\nsecond of them"


def test_lists_of_an_article_stay_where_most_lists_are_menus():
    menu = "".join(f'<li><a href="/{i}">entry number {i}</a></li>' for i in range(40))
    page = f"<body><nav><ul class='links'>{menu}</ul><ul>{menu}</ul><ol>{menu}</ol><table><tr><td>{menu}</td></tr></table><figure>{menu}</figure></nav><article><p>{{}}</p></article></body>"
    counts = H.Counter()
    for _ in range(30):
        counts.update(H.count(page.format("Words of an article without any list in it, as most of them are. " * 5)))
    w = H.fit(counts)
    got = H.extract(page.format("Before.</p><ul><li>one</li></ul><ol><li>two</li></ol><ul class='links'><li>three</li></ul><table><tr><td>four</td></tr></table><figure>five</figure><p>After."), w)
    assert got == "Before.\none\ntwo\nthree\nfour\nfive\nAfter."


def test_implied_end_tags():
    w = H.fit(H.count(PAGE))
    body = "<article><p class=ad>buy now<p>words of the text<ul><li class=promo>an offer<li>first item<li>second item</ul><table><tr><td class=share>share<td>cell<tr><td>next</table><dl><dt class=ad>x<dd>meaning</dl></article>"
    assert H.extract(body, w) == "words of the text\nfirst item\nsecond item\ncell\nnext\nmeaning"
    assert H.extract("<article><div class=ad><p>buy<div>it</div></div><ul><li>a<ul><li>b</ul>c</ul><p>d</article>", w) == "a\nb\nc\nd"


def test_broken_and_empty():
    w = H.Weights()
    assert H.extract(None, w) == H.extract("", w) == ""
    assert H.extract("<article><p>open <b>never closed<p>two", w) == "open never closed\ntwo"
    assert H.extract("<article><p>a < b and <", w) == "a < b and <"
    assert H.extract("<p>" * 50_000 + "deep words here", w) != ""
    r = random.Random(0)
    for _ in range(300):
        H.extract("".join(r.choice(["<p", ">", "</", "article", "<article>", '"', "=", " ", "x", "<!--", "-->", "&am", "<script>", "&#x;"]) for _ in range(40)), w)


def test_frame(spark):
    rows = [(1, "u", PAGE, "t"), (2, None, None, "t"), (2, None, None, "t"), (3, "v", "<article>" + "<p>word word</p>" * 20_000, "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.n_chars, r.text[:20]) for r in H.extract_pages(df, H.fit_pages(df)).collect())
    assert got == [(1, len(WANT), WANT[:20]), (2, 0, ""), (2, 0, ""), (3, 10 * 20_000 - 1, "word word\nword word\n"[:20])]
    assert H.extract_pages(df.limit(0), H.fit_pages(df.limit(0))).count() == 0


WORDS = "some words of the main text that goes on for a while and says this and that of it, " * 3


def test_any_number_of_open_elements():
    for n in (1_000, 2_500, 60_000):
        page = f"<html><body><div><nav>menu {'<b>' * n}</nav></div><article>{WORDS}</article></body></html>"
        assert H.extract(page, H.Weights()) == WORDS.strip()
        assert H.extract(f"<ul>{'<b class=x>' * n}{'<li>item' * 50}</ul><article>{WORDS}</article>", H.Weights()) == WORDS.strip()


def test_names_tell_as_a_whole_and_not_of_what_the_page_is_about():
    pages = [
        '<body class="has-sidebar"><article>{}</article></body>', '<div class="content has-sidebar"><article>{}</article></div>', '<body class="no-comments"><main>{}</main></body>',
        '<body class="page-header-image"><main>{}</main></body>', '<main class="no-comments">{}</main>', '<article><section id="related-work">{}</section></article>', '<body class="sidebar"><div id="social"><article class="comments">{}</article></div></body>',
        '<form id="aspnet"><header><main>{}</main></header></form>', '<article><span class="ad-hoc">{}</span></article>',
    ]
    for page in pages:
        assert H.extract(page.format(WORDS), H.Weights()) == WORDS.strip(), page
    assert H.extract(f'<article><h2 id="share-prices">Prices</h2><h2 id="share">Share</h2><p>{WORDS}</article>', H.Weights()) == f"Prices\nShare\n{WORDS.strip()}"
    for name in ("sidebar", "cookie-notice", "comment-list", "site-footer", "related-posts", "ad", "ad_container-2", "social share", "newsletter-signup"):
        assert H.extract(f'<article><p>{WORDS}</p><div class="{name}">not of it at all</div><p>{WORDS}</p></article>', H.Weights()) == f"{WORDS.strip()}\n{WORDS.strip()}", name
    aside = f"<article><p>{WORDS}</p></article><aside><article>a teaser of some words</article></aside><div class=sidebar><article>another teaser of it</article></div>"
    assert H.extract(aside, H.Weights()) == WORDS.strip()


def test_title_in_the_header_of_an_article():
    got = H.extract(f'<header>Site</header><article><header class="entry-header"><h1>Title</h1></header><p>{WORDS}</p></article>', H.Weights())
    assert got == f"Title\n{WORDS.strip()}"


def test_sections_under_a_telling_heading():
    comments = "I have read this and think so too, says one of many readers here. " * 8
    w = H.fit(H.count(PAGE))
    short = "An article of twenty words that is shorter than what its readers have to say of it on the page below."
    for heading in ("Reader comments", "12 Comments", "Comments (3)", "Leave a reply", "Commentaires"):
        assert H.extract(f"<article><p>{short}</p></article><div><h3>{heading}</h3><p>{comments}</p><p>{comments}</p></div>", w) == short, heading
    assert H.extract(f"<article><h1>T</h1><p>{WORDS}</p><h2>Related articles</h2><p>One</p><h3>Two</h3><p>x</p><h2>On it goes</h2><p>{WORDS}</p></article>", w) == f"T\n{WORDS.strip()}\nOn it goes\n{WORDS.strip()}"
    assert H.extract(f"<article><h2>Comments on a theorem</h2><p>{WORDS}</p></article>", w) == f"Comments on a theorem\n{WORDS.strip()}"


def test_whole_extraction_against_all_regions():
    """Every region of small pages is tried; on many the best one is neither nothing nor all."""
    r, w, differ = random.Random(4), H.fit(H.count(PAGE)), 0
    for _ in range(400):
        parts = ["<p>", "</p>", "<div>", "</div>", "<article>", "</article>", "<nav>", "</nav>", "<br>", "<ul><li>", "<div class=ad>", "word " * r.randrange(1, 40), "a b c", "<h2>Comments</h2>"]
        source = "".join(r.choice(parts) for _ in range(r.randrange(1, 22)))
        page = H.parse(source)
        scores = w.scores(page)
        worth = H.worths(page, scores, w)
        best, span = _brute(worth)
        if best == 0:
            assert H.extract(source, w) == ""
            continue
        totals = [sum(worth[i:j]) for i in range(len(worth)) for j in range(i + 1, len(worth) + 1)]
        if sum(abs(t - best) < 1e-9 for t in totals) == 1:
            assert H.extract(source, w) == H.written(page.pieces[span[0] : span[1]], scores)
        differ += H.extract(source, w) != H.written(page.pieces, scores)
    assert differ > 20
