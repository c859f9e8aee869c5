import random

import pytest

from evidmill.llm.html_text import CHROME, LEAST_PAGES, LEAST_SHARE, LEAST_TEXTS, OPEN, TEXT, WINDOW, blocks, extract, host_of, main_text, repeats

SCHEMA = "page_id long, url string, html string"


def text_of(page):
    return main_text(blocks(page))


ARTICLE = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{margin:0}</style><script>var t="</p><article>no</article>";</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy now</div>
<div class="page with-sidebar"><article class="post"><header><h1>Title&nbsp;one &amp;amp;</h1></header><p><b>First  line.<br><p>Second
   <i>li</i>ne &eacute;&#233;&#x1F600;</p><div class="share-buttons">Tweet</div><table><tr><td>a<td>b</table><aside>Also</aside>
<ul><li>one<li>two</ul><form><input value="x">Mail <button>Go</button></form><section id="comments"><article class="comment">Me too</article></section></article></div>
<footer>&copy; host</footer><div class="cookie-notice">We use cookies"""


def test_markup_settles_the_text():
    assert text_of(ARTICLE) == "Title one &amp;\nFirst line.\nSecond line éé\U0001f600\na b\none\ntwo"


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("just text", "just text"), ("<p>a</p><p>b", "a\nb"), ("<p>1 < 2 & 3 > 2</p>", "1 < 2 & 3 > 2"),
    ("<article>a<script>x</article>", "a"), ("<main><p title='a>b'>c</p></main>", "c"), ("<div>a<div>b</div>c</div>", "a\nb\nc"),
    ("<body class='has-menu'><p>x</p></body>", "x"), ("<div hidden>a</div><p style='display: none'>b</p><p>c</p>", "c"), ("<nav>only</nav>", ""),
    ("<p>a<!-- never closed", "a"), ("<P>A</P><NAV>b</NAV>", "A"), ("<div class=\"unclosed>x</div>y", "x\ny"), ("<article><p>a</p></article></article></div><p>b</p>", "a"),
])
def test_small_pages(page, want):
    assert text_of(page) == want


def test_kinds():
    assert [b.kind for b in blocks("<p>a</p><nav>b</nav><main>c<div class='related'>d</div></main>")] == [OPEN, CHROME, TEXT, CHROME]


def brute(pages):
    """Covered words by comparing windows of all pages of a host directly."""
    hosts = {}
    for page_id, url, page in pages:
        host = url.split("/")[2]
        found = blocks(page)
        seen = set()
        for b in found:
            if b.kind != TEXT:
                w = b.text.split()
                seen |= {tuple(w[k : k + WINDOW]) for k in range(len(w) - WINDOW + 1)} if len(w) >= WINDOW else {("whole", *w)}
        hosts.setdefault(host, []).append((page_id, found, frozenset(seen)))
    out = {}
    for members in hosts.values():
        for page_id, found, _ in members:
            if any(b.kind == TEXT for b in found):
                out[page_id] = "\n".join(b.text for b in found if b.kind == TEXT)
                continue
            kept = []
            for b in found:
                w = b.text.split()
                keys = [tuple(w[k : k + WINDOW]) for k in range(len(w) - WINDOW + 1)] if len(w) >= WINDOW else [("whole", *w)]
                covered = set()
                for k, key in enumerate(keys):
                    holders = [s for _, _, s in members if key in s]
                    if len(holders) >= LEAST_PAGES and len(set(holders)) > 1:
                        covered |= set(range(k, k + WINDOW))
                rest = " ".join(x for k, x in enumerate(w) if k not in covered)
                if b.kind == OPEN and rest:
                    kept.append(rest)
            out[page_id] = "\n".join(kept)
    return out


def site(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    run = lambda n: " ".join(rng.choice(words) for _ in range(n))
    pages = []
    for h in range(3):
        top, bottom = run(rng.choice([3, 9, 20])), run(12)
        for k in range(8):
            body = "".join(f"<div>{run(rng.randint(1, 30))}</div>" for _ in range(3))
            mixed = f"<div>{run(5)} {bottom} {run(4)}</div>"
            pages.append((len(pages), f"https://h{h}.example/{k}", f"<div>{top}</div>{body}{mixed if k % 2 else ''}<div>{bottom}</div>"))
        twin = f"<div>{run(40)}</div>"
        pages += [(len(pages) + k, f"https://twin{h}.example/{k}", twin) for k in range(4)]
    pages.append((len(pages), "https://h0.example/article", ARTICLE))
    return pages


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_like_brute_force(spark, seed):
    pages = site(seed)
    got = {r.page_id: r for r in extract(spark.createDataFrame([(*p, "x", 0) for p in pages], SCHEMA + ", text string, name int")).collect()}
    want = brute(pages)
    assert {k: r.text for k, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values()) and sum(r.n_repeated > 0 for r in got.values()) > 20
    # The same page under several addresses isn't boilerplate.
    assert all(want[p[0]] for p in pages if "twin" in p[1])


def test_copies_under_changing_menus_and_short_blocks_stay(spark):
    rng = random.Random(7)
    run = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    article, foot = run(40), run(12)
    copies = [(k, f"https://copies.example/{k}", f"<nav>{run(8)}</nav><div>{article}</div><div class='ad'>{run(9)}</div><footer>{run(7)}</footer>") for k in range(4)]
    # A host with other pages: the article under menus that markup doesn't tell from text, and short answers between texts.
    bare = [(10 + k, f"https://bare.example/{k}", f"<div>{run(8)}</div><div>{article if k < 3 else run(40)}</div><p>Yes.</p><div>{run(10)}</div><p>{foot}</p><p>Top</p>") for k in range(10)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(copies + bare, SCHEMA)).collect()}
    assert [got[k] for k in range(4)] == [article] * 4
    for k in range(10):
        assert "\nYes.\n" in got[10 + k] and foot not in got[10 + k] and "Top" not in got[10 + k]
        assert (article in got[10 + k]) == (k < 3)


def test_nulls_repeats_and_empty_table(spark):
    pages = [(1, None, None), (1, None, None), (None, "http://a/", "<p>x</p>"), (2, "http://a/", ""), (3, "nonsense", "<p>" + "long " * 50_000)]
    got = sorted(map(tuple, extract(spark.createDataFrame(pages, SCHEMA)).select("page_id", "n_chars").collect()), key=str)
    assert got == sorted([(1, 0), (1, 0), (None, 1), (2, 0), (3, 249_999)], key=str)
    assert extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hosts(spark):
    urls = ["https://A.Example:80/x", "//b.example?q", "ftp://u:p@c.example/", "d.example/x", None, "http://e.example#f"]
    got = [r.h for r in spark.createDataFrame([(u,) for u in urls], "url string").select(host_of("url").alias("h")).collect()]
    assert got == ["a.example", "b.example", "c.example", "", "", "e.example"]


def longest(tokens, pos, holders, least):
    """Tokens of the longest beginning of a suffix that enough texts hold; ``holders``: (tokens, text) of a host."""
    n = 0
    while pos + n < len(tokens):
        part = tokens[pos : pos + n + 1]
        if len({text for other, text in holders if any(other[k : k + n + 1] == part for k in range(len(other)))}) < least:
            break
        n += 1
    return n


@pytest.mark.parametrize("seed", [1, 2])
def test_lengths_of_repeats_like_brute_force(spark, seed):
    rng = random.Random(seed)
    common = [rng.randrange(50) for _ in range(23)]
    stretches, holders = [], []
    for sid in range(24):
        host, cut = f"h{sid % 2}", rng.randrange(15)
        stretches.append((sid, host, common[cut : cut + rng.randint(1, 23)] + [rng.randrange(4) for _ in range(rng.randint(1, 14))]))
        holders += [(sid, text, 3) for text in rng.sample(range(8), rng.randint(1, 2))]
    got = repeats(spark.createDataFrame(stretches, "sid long, host string, words array<long>"), spark.createDataFrame(holders, "sid long, digest long, _least long"))
    want = {}
    for sid, host, words in stretches:
        held = [(other, text) for k, h, other in stretches if h == host for s, text, _ in holders if s == k]
        want.update({(sid, pos): n for pos in range(len(words)) if (n := longest(words, pos, held, 3))})
    assert {(r.sid, r.pos): r.length for r in got.collect()} == want
    assert max(want.values()) > 2 * WINDOW


def judged(pages):
    """Texts by the rules, with the repeats of a host found by comparing its blocks directly."""
    hosts = {}
    for page_id, url, page in pages:
        found = blocks(page)
        hosts.setdefault(url.split("/")[2], []).append((page_id, found, main_text(found)))
    out = {}
    for members in hosts.values():
        texts = {t for _, _, t in members if t}
        least = max(LEAST_PAGES, len(texts) * LEAST_SHARE)
        tokens = lambda b: w if len(w := b.text.split(" ")) >= WINDOW else [("whole", *w)]
        held = [(tokens(b), t) for _, found, t in members if t for b in found]
        for page_id, found, _ in members:
            runs = []
            for k, b in enumerate(found):
                w = tokens(b)
                for pos in range(len(w)):
                    n = longest(w, pos, held, least)
                    if n >= (WINDOW if len(w) > 1 else 1):
                        runs.append((k, pos, n))
            out[page_id] = main_text(found, runs, len(texts) >= LEAST_TEXTS)
    return out


def test_repeats_inside_the_article_go_by_their_length(spark):
    rng = random.Random(3)
    run = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    notice, quote, share, lead = run(17), run(14), "Share this", "Weekly report"
    pages, want = [], {}
    for k in range(12):
        text, other = run(rng.randint(20, 60)), run(9)
        # A notice on most texts goes with the line beside it. A heading, and a passage in a paragraph of its own words, are text.
        last = f"<p>{notice}</p><p>{share}</p>" if k % 4 else f"<p>{share}</p>"
        pages.append((k, f"https://news.example/{k}", f"<nav>{run(3)}</nav><article><h1>{lead}</h1><p>{text}</p><p>{other} {quote}</p>{last}</article>"))
        want[k] = "\n".join([lead, text, f"{other} {quote}"] + ([] if k % 4 else [share]))
    # On less than half of the texts it stays; and one article under several addresses, and versions of one, aren't boilerplate.
    rare = [(20 + k, f"https://rare.example/{k}", f"<article><p>{run(30)}</p>{f'<p>{notice}</p>' if k < 6 else ''}</article>") for k in range(13)]
    body = run(40)
    copies = [(60 + k, f"https://copies.example/{k}", f"<nav>{run(8)}</nav><article><p>{body}</p></article>") for k in range(4)]
    versions = [(70 + k, f"https://versions.example/{k}", f"<main><p>{body}</p><p>{run(12)}</p></main>") for k in range(12)]
    # On a host with few texts a passage that all have is theirs.
    few = [(90 + k, f"https://few.example/{k}", f"<article><h1>{notice}</h1><p>{run(30)}</p></article>") for k in range(LEAST_TEXTS - 1)]
    bare = [(40 + k, f"https://bare.example/{k}", f"<div>{run(20)} {quote}</div><footer>{notice}</footer>") for k in range(4)]
    chrome = [(50, "https://bare.example/x", f"<footer>{notice}</footer>"), (50, "https://bare.example/y", f"<div>{notice} {run(3)}</div>")]
    everything = pages + rare + copies + versions + few + bare
    rows = spark.createDataFrame(everything + chrome + [(None, "https://news.example/9", f"<article><p>{notice}</p></article>")], SCHEMA)
    got = {(r.page_id, r.url): r for r in extract(rows).collect()}
    texts = {k: r.text for (k, _), r in got.items() if k not in (None, 50)}
    assert {k: texts[k] for k in want} == want
    assert all(texts[k] == text_of(page) for k, _, page in rare + copies + versions + few)
    assert all(quote not in texts[k] and len(texts[k].split()) == 20 for k, _, _ in bare)
    assert texts == {k: t for k, t in judged(everything + chrome).items() if k != 50}
    # Rows that repeat an id are judged apart; a page without text holds nothing, a page without id is read by its markup.
    assert got[50, "https://bare.example/x"].text == "" and got[50, "https://bare.example/x"].n_repeated == 12
    assert notice not in got[50, "https://bare.example/y"].text and len(got[50, "https://bare.example/y"].text.split()) == 3
    assert got[None, "https://news.example/9"].text == notice


def test_site_like_the_rules(spark):
    pages = site(5)
    assert {r.page_id: r.text for r in extract(spark.createDataFrame(pages, SCHEMA)).collect()} == judged(pages)
