import itertools
import random

import numpy as np
import pytest
from loomwright.llm import html
from loomwright.llm.mincut import min_cut


def test_min_cut_matches_brute_force():
    rng = random.Random(1)
    for _ in range(600):
        n = rng.randint(1, 9)
        z = [rng.choice([rng.uniform(-3, 3), rng.randint(-2, 2)]) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.choice([0.5, 1, 2, rng.random()])) for _ in range(rng.randint(0, 14))]

        def energy(x):
            return sum(abs(a) for a, b in zip(z, x) if a and (a > 0) != b) + sum(w for i, j, w in edges if x[i] != x[j])

        assert energy(min_cut(z, edges)) <= min(map(energy, itertools.product([False, True], repeat=n))) + 1e-6


def test_pages_match_their_articles(spark):
    """The test pages hold their article in one element; what is in it is all the text."""
    import html as entities
    import re

    from loomwright.llm.queries import op7_html_extraction

    folder = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = op7_html_extraction(spark, folder).collect()
    assert len(got) == len(pages)
    for r in got:
        inside = re.search("<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        parts = [" ".join(entities.unescape(re.sub("</?b>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", inside)]
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


LONG = "This is a long paragraph with many words, which shows that it is content and not a menu."


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("<p></p><script>var a='<p>no</p>'</script>", ""),
        (f"<article><h1>A &amp; B</h1><p>{LONG}<p>Short.</article><footer>c</footer>", f"A & B\n{LONG}\nShort."),
        (f"<main><p>a&nbsp;\n b<br>c &#233;</p><div class='ad'>{LONG}</div><p>{LONG}</p></main>", f"a b c é\n{LONG}"),
        (f"<body><header><h1>Site</h1></header><div class=content><h2>Title</h2><p>{LONG}</p></div><div id=comments><p>{LONG}</p></div>", f"Title\n{LONG}"),
        (f"<div><p>{LONG}</p><p style='display:none'>{LONG}</p><div role=navigation>{LONG}</div><form>{LONG}</form><aside>{LONG}</aside></div>", LONG),
        (f"<article><p>{LONG} <b>bo</b>ld <!-- no -->a < b</p></article>", f"{LONG} bold a < b"),
        (f"<article><p title='a > b'>{LONG}</p></article", LONG),
        (f"<form id=aspnetForm><nav><a href=x>One</a></nav><article><p>{LONG}</p></article><label>Name</label><p>{LONG}</p></form>", LONG),
        (f"<article><p>{LONG}</p><section id=discussion><h2>Discussion</h2><p>{LONG}</p></section><div class=reply><p>{LONG}</p></div></article>", f"{LONG}\nDiscussion\n{LONG}\n{LONG}"),
        (f"<article><p>{LONG}</p></article><div id=discussion><p>{LONG}</p></div><div class=comments><div class=reply><article><p>{LONG}</p></article></div></div>", LONG),
        (f"<article><p>{LONG}</p><aside>{LONG}</aside><p>{LONG}</p><ul><li><a href=x>One</a></ul><p>{LONG}</p></article>", f"{LONG}\n{LONG}\nOne\n{LONG}"),
        (f"<div class='cookie-notice'>{LONG}</div><nav><a href=x>One</a> <a href=y>Two</a></nav><p>{LONG}</p>", LONG),
    ],
)
def test_cases(page, want):
    assert html.main_text(page) == want


@pytest.mark.parametrize("wrapper", ["site-content has-sidebar", "post with-ads", "article-with-comments", "side-effects", "menu-page", "full-banner", "sidebar-wrapper"])
def test_wrappers_keep_their_article(wrapper):
    assert html.main_text(f"<div class='{wrapper}'><article><h1>T</h1><p>{LONG}</p></article></div>") == f"T\n{LONG}"


@pytest.mark.parametrize("name, says", [("comment-list", -2), ("post-comments", -2), ("sidebar left", -1), ("cookie-notice", -1), ("relatedPosts", -1), ("site-footer", -1), ("entry-content", 1), ("has-sidebar", 0), ("x y", 0), ("adapter", 0)])
def test_names_of_containers(name, says):
    assert html.named(name) == says


def test_text_inside_formulas_and_drawings_stays():
    page = f"<article><p>{LONG} <math><mi>x</mi></math> <svg><text>lab</text></svg> <object>alt</object></p><section class=comments><article><p>{LONG}</p></article></section></article>"
    assert html.main_text(page) == f"{LONG} x lab alt"


def mixed_page(rng):
    """A page without telling names: blocks of an article, some short or linked, between lists of links and odd sentences; and which are content."""
    sentence = lambda n: " ".join(rng.choice(["light", "over", "stone", "river", "when", "green", "paper", "walks"]) for _ in range(n))
    link = lambda: f"<a href=x>{sentence(3)}</a>"
    blocks = [(f"<li>{link()}</li>", False) for _ in range(rng.randint(4, 8))] + [(f"<li>{sentence(9)}.</li>", False)] * rng.randint(0, 1) + [(f"<li>{link()}</li>", False) for _ in range(3)]
    above = "<ul>" + "".join(b for b, _ in blocks) + "</ul>"
    body = [(rng.choice([f"<p>{sentence(40)}, {sentence(9)}.</p>"] * 7 + [f"<p>{sentence(2)}</p>", f"<p>{link()} {sentence(2)}</p>", f"<h3>{sentence(2)}</h3>"]), True) for _ in range(rng.randint(5, 12))]
    below = [(f"<li>{link()}</li>", False) for _ in range(rng.randint(3, 6))]
    page = f"<div>{above}</div><div>{''.join(b for b, _ in body)}</div><div><ul>{''.join(b for b, _ in below)}</ul></div>"
    return page, [c for _, c in blocks + body + below]


def test_the_cut_decides_on_mixed_pages():
    """Ties turn labels over that the price alone has wrong, in most cases rightly."""
    rng = random.Random(11)
    by_sign = by_cut = flipped = total = 0
    for _ in range(300):
        page, want = mixed_page(rng)
        found = html.blocks(page)
        z = html.prices(found)
        assert len(found) == len(want)
        cut = min_cut(z, html.ties(found))
        by_sign += sum((x > 0) == w for x, w in zip(z, want))
        by_cut += sum(c == w for c, w in zip(cut, want))
        flipped += sum(c != (x > 0) for c, x in zip(cut, z))
        total += len(want)
    assert flipped > 0.03 * total and by_cut > by_sign + 0.05 * total and by_cut > 0.96 * total


def test_weights_are_fitted_and_fall_back(spark):
    from loomwright.llm.training import logistic

    made = [f"<nav>{'<li><a href=x>One two</a></li>' * 3}</nav><article><h1>T</h1><p>{LONG}</p><p>{LONG}</p></article>" for _ in range(60)]
    pages = spark.createDataFrame(list(enumerate(made)), "page_id long, html string")
    weights = html.fitted(pages, "page_id", "html")
    assert weights[html.FEATURES.index("linked")] < 0 < weights[html.FEATURES.index("words")] and (weights != html.USUAL).any()
    assert (html.fitted(pages, "page_id", "html") == weights).all()
    plain = spark.createDataFrame([(1, f"<p>{LONG}</p>")], "page_id long, html string")
    assert (html.fitted(plain, "page_id", "html") == html.USUAL).all() and (html.fitted(plain.limit(0), "page_id", "html") == html.USUAL).all()
    x = np.array([[1.0, 0.0], [1.0, 1.0]])
    assert logistic(x, np.array([0.0, 1.0]), 1e6, around=np.array([0.5, 2.0])) == pytest.approx([0.5, 2.0], abs=1e-3)


def test_one_page_id_of_many_rows_is_one_sample(spark):
    pages = spark.createDataFrame([(1, f"<article><p>{LONG}</p></article><nav>x</nav>")] * 300, "page_id long, html string")
    assert html.texts_of(pages, html.sampled_ids(pages, "page_id", 50), "page_id", "html").count() == 1


def test_hostile_pages_end():
    for page in ("<div>" * 20_000 + "x", "<p>hello there you" * 5000, '<a "' * 20_000, "</div>" * 20_000 + "<" * 2000, "<div>a" * 2000 + "b</div>" * 2000, "<!--" * 5000, "&amp;" * 50_000):
        html.main_text(page)


def test_hard_rows(spark, clashing):
    pages = spark.createDataFrame([(1, None, None), (None, "u", f"<article><p>{LONG}</p></article>"), (2, "v", ""), (2, "v", "")], "page_id long, url string, html string")
    got = html.extract(clashing(pages)).collect()
    assert len(got) == 4 and {(r["page_id"], r["text"], r["n_chars"]) for r in got} == {(1, "", 0), (None, LONG, len(LONG)), (2, "", 0)}
    assert html.extract(pages.limit(0)).count() == 0
