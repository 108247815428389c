"""Tokens, personal data, language model, toxicity, mixing and HTML against plain Python."""

import collections
import hashlib
import math
import random
import re
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest

from factorloom.llm import html, lm, mixing, pieces, pii, toxicity

sentencepiece = pytest.importorskip("sentencepiece")

ODD = [None, "", " ", "\n", "  hello  world\n\nfoo\tbar ", " " * 100, "▁x ▁▁", "\x00a​﻿b", "日本語 𝒜", "<s> <0x0A> </s><unk>", "a" * 3000, "don't, U.S.A. 3.14%", *(" " * k + "the" for k in range(1, 40))]


def docs(spark, texts, schema="doc_id long, text string"):
    return spark.createDataFrame(list(enumerate(texts)), schema)


def test_pieces_match_the_library(spark):
    path = pieces.model_path()
    library, rng = sentencepiece.SentencePieceProcessor(model_file=path), random.Random(5)
    vocabulary = [library.id_to_piece(i) for i in range(300, 32000)]
    texts = ODD + ["".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 20))).replace("▁", " ") for _ in range(800)]
    texts += ["".join(rng.choice("abcdeinrstlouh  .,\n") for _ in range(rng.randrange(60))) for _ in range(800)]
    for r in pieces.encode_decode(docs(spark, texts), path, whole=True).collect():
        ids = library.encode(texts[r.doc_id] or "")
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == library.decode(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.encode_decode(docs(spark, ["x"]).limit(0), path).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def holds(kind, value):
        d = re.sub("[^0-9]", "", value)
        luhn = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0
        return {"email": True, "ip": all(int(p or 0) <= 255 for p in value.split(".")) if kind == "ip" else True, "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]

    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if holds(k, m.group())]


def test_personal_data_base_spans_match_python(spark):
    rng = random.Random(6)
    parts = ["a@b.c_d@e.f", "x@y.z@w.v", "1.2.3.4.5", "300.1.1.1", "+1 (449) 555-7462", "4111 1111-1111 1111", "4111111111111111", "é𝒜", " ", "@", "+", ".", "-", "7", "0000000001.0.0.0", "99999999999.1.1.1", "+49 30 1234567"]
    texts = [None, "", "1" * 5000, "x" * 30000 + "@", *("".join(rng.choice(parts) + rng.choice(["", " ", ","]) for _ in range(rng.randrange(1, 12))) for _ in range(300))]
    for r in pii.personal_data(docs(spark, texts)).collect():
        base = base_spans(texts[r.doc_id] or "")
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, _, _ in base) for k in PATTERNS]
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))
    assert pii.personal_data(docs(spark, ["a"]).limit(0)).count() == 0


def test_personal_data_adds_wide_spans_and_leaves_clean_texts_alone(spark):
    texts = ["call (449) 555-7462 now", "mail joe (at) example (dot) com", "no data 12 34", "+1 (449) 555-7462", *["phone +1 (449) 555-7462, mail a@b.com"] * 30]
    got = {r.doc_id: r.spans for r in pii.personal_data(docs(spark, texts)).collect()}
    assert got[0] == "phone:5:19" and got[1].startswith("email:5:") and got[2] == "" and got[3] == "phone:0:17"


def test_reliabilities_trust_the_labelers_that_agree():
    good, bad = 0b00100111, 0b00000000
    belief = pii.reliabilities([(good, 90.0), (bad, 10.0)])
    assert belief[good] > 0.9 and belief[bad] < 0.1


def brute_ppm(texts, order):
    trie = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    coded = [lm.START * order + (t or "").encode().lower() + lm.END for t in texts]
    for i, s in enumerate(coded):
        if zlib.crc32(str(i).encode()) % 5 != 1:
            for p in range(order, len(s)):
                for k in range(order + 1):
                    trie[k][s[p - k : p]][s[p]] += 1
    out = []
    for s in coded:
        total = 0.0
        for p in range(order, len(s)):
            excluded, done = set(), False
            for k in range(order, -1, -1):
                live = {y: n for y, n in trie[k].get(s[p - k : p], {}).items() if y not in excluded}
                if not live:
                    continue
                n, d = sum(live.values()), len(live)
                if s[p] in live:
                    total, done = total + math.log10(live[s[p]] / (n + d)), True
                    break
                total, excluded = total + math.log10(d / (n + d)), excluded | set(live)
            total -= 0 if done else math.log10(256 - len(excluded))
        out.append(total)
    return out


def test_language_model_matches_a_plain_trie(spark):
    rng = random.Random(7)
    texts = [None, "", "É é\n x", *(" ".join("".join(rng.choice("abcé") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(30))) for _ in range(60))]
    counts = collections.Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update([*(t or "").encode().lower().split(), None])
    n, v, ppm = sum(counts.values()), len(counts), brute_ppm(texts, lm.ORDER)
    rows = lm.lm_scores(docs(spark, texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = [*(texts[r.doc_id] or "").encode().lower().split(), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words))
        assert r.score == pytest.approx(ppm[r.doc_id])


def test_language_model_of_nothing(spark):
    assert lm.lm_scores(docs(spark, ["a"]).limit(0)).count() == 0


def test_language_model_of_repeated_rows_null_ids_and_other_columns(spark):
    rows = [(None, "one two", 1.0), (3, "one two", 2.0), (3, "one two", 2.0), (3, "Three", 3.0)]
    got = lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string, score double")).collect()
    assert len(got) == 4 and [r.held_out for r in got if r.doc_id is None] == [zlib.crc32(b"") % 5 == 1]
    same = [(r.n_tokens, r.score) for r in got if r.n_tokens == 3]
    assert len(same) == 3 and len(set(same)) == 1
    long = lm.lm_scores(docs(spark, ["word " * 200_000, "word"])).collect()
    assert {r.n_tokens for r in long} == {200_001, 2}


def test_toxicity_finds_marked_texts_and_leaves_clean_ones_alone(spark):
    rng = random.Random(8)
    plain = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(200)]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        w = [rng.choice(plain) for _ in range(40)] + ([rng.choice(["scum", "idiot"]), "vequ" + rng.choice(plain)] if toxic else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w), i))
        labels.append((i, 1, int(toxic)))
    df = spark.createDataFrame([*rows, (1000, None, 0), (1001, "", 0), (1002, "x" * 50000, 0), (1003, "you scum", 1)], "doc_id long, text string, toxic int")
    known = spark.createDataFrame([r for r in labels if r[0] % 5] + [(2000, None, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(df, known, whole=True).collect()
    assert {r.doc_id for r in got if r.toxic} == {i for i in range(0, 900, 6)} | {1003}
    assert len(got) == 904 and set(got[0].asDict()) == {"doc_id", "text", "p_quality", "p_toxic", "toxic"}


def test_toxicity_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert not any(r.toxic for r in toxicity.toxicity(docs(spark, ["a", None]), none).collect())
    assert toxicity.toxicity(docs(spark, ["a"]).limit(0), none).count() == 0


def test_toxicity_told_by_held_out_texts(spark):
    """Texts that the models were not fitted on: the chain has to be right in nine of ten, the words alone tell."""
    rng = random.Random(18)
    plain = ["".join(rng.choice("klmnopqrst") for _ in range(5)) for _ in range(300)]
    rows = []
    for i in range(1500):
        toxic = rng.random() < 0.3
        rows.append((i, " ".join([rng.choice(plain) for _ in range(30)] + [rng.choice(["dreck", "mist", "abschaum"])] * toxic), int(toxic), int(rng.random() < 0.5)))
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    known = spark.createDataFrame([(i, q, t) for i, _, t, q in rows if i % 3], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.toxic for r in toxicity.toxicity(df, known).collect()}
    held = [r for r in rows if r[0] % 3 == 0]
    assert sum(got[i] == bool(t) for i, _, t, _ in held) >= 0.9 * len(held)


def test_toxicity_with_repeated_rows_conflicting_labels_and_a_bound(spark):
    rows = [(i, "good words here" if i % 2 else "bad scum here") for i in range(60)]
    df = spark.createDataFrame(rows + rows[:10] + [(None, "bad scum here")], "doc_id long, text string")
    labels = [(i, 1, int(i % 2 == 0)) for i in range(60)] + [(i, 1, 0) for i in range(0, 60, 4)] + [(None, 1, 1), (1, None, 1)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = [sorted((r.doc_id or -1, r.toxic, round(r.p_toxic, 9)) for r in toxicity.toxicity(df, k, sample=40).collect()) for k in (known, known.repartition(7))]
    assert got[0] == got[1] and len(got[0]) == 71 and all(t == (i < 0 or i % 2 == 0) for i, t, _ in got[0])


def test_pieces_and_personal_data_of_repeated_rows_and_other_columns(spark):
    rows = [(1, "mail a@b.com", 7), (1, "mail a@b.com", 7), (None, "mail a@b.com", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int").selectExpr("*", "1 AS n_tokens", "2 AS ids", "3 AS id", "4 AS found", "5 AS base_email")
    assert [(r.n_email, r.spans) for r in pii.personal_data(df).collect()] == [(1, "email:5:12")] * 3
    assert len({(r.n_tokens, r.ids_sha256) for r in pieces.encode_decode(df, pieces.model_path()).collect()}) == 1


def test_personal_data_of_texts_with_very_many_matches(spark):
    texts = ["+49 30 1234567 " * 30_000, "é a@b.com, " * 1000]
    got = {r.doc_id: r for r in pii.personal_data(docs(spark, texts)).collect()}
    assert got[0].n_phone == 30_000 and got[1].n_email == 1000
    for i, kind in ((0, "phone"), (1, "email")):
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(texts[i]) if k == kind).encode()).hexdigest()


def test_personal_data_finds_addresses_and_cards_in_other_dress(spark):
    texts = ["login from 10[.]20[.]30[.]40 today", "visa card 4111.1111.1111.1111 to pay", "visa card 4111.1111.1111.1112 to pay", *["host 8.8.8.8, card 4111 1111 1111 1111"] * 30]
    got = {r.doc_id: r.spans for r in pii.personal_data(docs(spark, texts)).collect()}
    assert (got[0], got[1], got[2]) == ("ip:11:28", "card:10:29", "")


def test_mixing_takes_rows_of_one_id_alike(spark):
    rows = [(7, "a b c", "x")] * 3 + [(i, "w " * (i % 9), "y") for i in range(300)] + [(None, "a", None)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 304 and len({r.copies for r in got if r.doc_id == 7 and r.source == "x"}) == 1


def test_mixing_comes_near_its_targets(spark):
    rng = random.Random(9)
    rows = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(60))), rng.choice(["a", "b", "b", "b", None, "c"])) for i in range(2000)]
    rows += [(9000, None, "a"), (9001, "", "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "0 AS size")
    got = mixing.mix(df).collect()
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        assert r.taken == r.copies * r.size and r.taken <= 2 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, open_, want = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        share = left / max(sum(weight[s] for s in open_), 1)
        full = {s for s in open_ if share * weight[s] > 2 * sizes[s]}
        if not full:
            want |= {s: share * weight[s] for s in open_}
            break
        for s in full:
            want[s] = 2.0 * sizes[s]
            left -= want[s]
        open_ -= full
    for s in names:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 60
    assert sorted(map(tuple, mixing.mix(df.repartition(3)).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert mixing.mix(df.limit(0)).count() == 0


PAGE = """<html><body class="has-sidebar"><div id="cookie-notice"><p>We use cookies</p></div><header><h1>Site</h1></header><nav><a href="/">Home</a></nav>
<div class="wrap"><article class="post"><h1>Title &amp; more</h1><div class="entry"><p>One   two&#32;three,
four <b>fi</b>ve.<p>Long enough to be told apart.<ul><li>a<li>b</ul><script>var t = "</p>";</script><form><p>Subscribe</p></form></div><footer>by me</footer></article>
<section id="comments"><p>A comment that is much longer than the article itself, so long that one would think it is the article, really.</p></section></div>
<aside><p>side</p></aside><footer>&copy;</footer></body></html>"""
BARE = "<body><div class='x-17'><p>Text of a page without an article element, in a plain container.</p></div><div class='related'><p>More of it</p></div>"


def plain_blocks(page, skip):
    """The text blocks of a well-formed page by Python's own parser, without the elements that skip names."""
    blocks, stack, text = [], [], []

    class Walk(HTMLParser):
        def flush(self):
            words = " ".join("".join(text).split())
            if words and not any(stack):
                blocks.append(words)
            text.clear()

        def handle_starttag(self, tag, attributes):
            if tag == "br":
                text.append(" ")
                return
            if tag not in ("b", "a", "i"):
                self.flush()
            stack.append(skip(tag, dict(attributes)))

        def handle_endtag(self, tag):
            if tag not in ("b", "a", "i"):
                self.flush()
            stack.pop()

        def handle_data(self, data):
            text.append(data)

    Walk().feed(page)
    return "\n".join(blocks)


def made_page(rng, words):
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    inline = lambda n: f"{text(n)} <b>{text(2)}</b>{rng.choice([' ', '<br>', '&nbsp;', '&#33;'])}{text(n)} &amp; {text(1)}"
    body = "".join(rng.choice([f"<p>{inline(12)}</p>", f"<ul><li>{inline(4)}</li><li>{text(3)}</li></ul>", f"<h2>{text(3)}</h2>", f"<blockquote><p>{inline(9)}</p></blockquote>", f'<div class="ad-tech"><p>{inline(6)}</p></div>']) for _ in range(8))
    around = [f"<nav><ul><li><a>{text(2)}</a></li></ul></nav>", f"<aside><p>{text(9)}</p></aside>", f'<div class="ad"><p>{text(20)}</p></div>', f'<div class="cookie-notice"><p>{text(9)}</p></div>', f'<section id="comments"><p>{text(60)}</p></section>']
    inside = [f'<div class="share-buttons"><p>{text(3)}</p></div>', f"<form><p>{text(5)}</p></form>", f"<script>var x = 1;</script><style>p</style>"]
    rng.shuffle(around)
    return f"<html><body>{''.join(around[:2])}<article><h1>{text(4)}</h1>{body}{rng.choice(inside)}{body[:0]}</article>{''.join(around[2:])}<footer><p>{text(4)}</p></footer></body></html>"


def test_html_main_text_matches_a_plain_walk(spark):
    rng = random.Random(19)
    words = "alpha beta gamma delta épsilon zeta eta theta".split()
    rows = [(i, f"http://h{i % 7}.example/{i}", made_page(rng, words)) for i in range(140)]
    skip = lambda tag, a: tag in ("nav", "aside", "form", "script", "style", "footer") or a.get("class") in ("ad", "cookie-notice", "share-buttons") or a.get("id") == "comments"
    df = spark.createDataFrame(rows + rows[:3], "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS text", "3 AS paths")
    got = html.extract_main_text(df).collect()
    assert len(got) == 143
    for r in got:
        assert r.text == plain_blocks(rows[r.page_id][2], skip) and r.n_chars == len(r.text)


def test_html_hosts_with_equal_votes_and_other_templates(spark):
    left, right = (f"<body><div class='{c}'><p>{c} text that is long enough to be the article of its page.</p></div><p>x</p></body>" for c in ("one", "two"))
    rows = [(i, "http://h.example", left if i % 2 else right) for i in range(6)] + [(9, "http://h.example", "<body><main><p>Another template, in a main element.</p></main></body>")]
    got = {r.page_id: r.text for r in html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert all(got[i].startswith("one" if i % 2 else "two") for i in range(6)) and got[9].startswith("Another")


def test_html_hostile_pages_take_linear_time():
    pages = ["<a " * 350_000, "<div>" * 200_000 + "deep", "<div>" * 100_000 + "</p>" * 100_000, "<a x=\"" * 150_000, "<b><div>" + "<i>" * 90_000 + "</b>" * 90_000, "<!--" * 250_000, "<" * 1_000_000, "<ul><li>" * 120_000, "<article>" + "<div>t " * 140_000]
    for page in pages:
        began = time.time()
        read = html.Page(page)
        if (best := read.best()) is not None:
            read.under(best)
        assert time.time() - began < 10


def test_html_keeps_what_an_article_says_about_ads(spark):
    page = '<body><article><h1>T</h1><div class="ad-tech"><p>On ads</p></div><div class="ad-slot">buy</div><p>End of it</p></article></body>'
    read = html.Page(page)
    assert read.under(read.best()) == "T\nOn ads\nEnd of it"


def test_html_main_text(spark):
    rows = [(i, f"http://Host.example/{i}", PAGE) for i in range(5)] + [(10, "http://b.example", BARE), (11, None, None), (12, "x", ""), (13, "http://b.example/2", "<p>a &lt; b"), (14, "", "<" * 2000)]
    got = {r.page_id: r for r in html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0].text == "Title & more\nOne two three, four five.\nLong enough to be told apart.\na\nb"
    assert got[10].text == "Text of a page without an article element, in a plain container."
    assert (got[11].text, got[11].n_chars, got[12].text, got[13].text) == ("", 0, "", "a < b")
    assert got[0].n_chars == len(got[0].text) and got[0].url == rows[0][1]
    assert html.extract_main_text(spark.createDataFrame(rows[:1], "page_id long, url string, html string").limit(0)).count() == 0


PROSE = "<h1>The title</h1><p>" + "Words of the article, and more of them. " * 8 + "</p>"
KEPT = "The title\n" + ("Words of the article, and more of them. " * 8).strip()
MARKED = {
    "theme classes": f'<body><div class="site-content has-sidebar"><article>{PROSE}</article></div></body>',
    "no sidebar": f'<div class="container no-sidebar"><article>{PROSE}</article></div>',
    "with sidebar": f'<div class="layout with-sidebar"><article>{PROSE}</article><div class="sidebar"><p>Aside</p></div></div>',
    "id with bar": f'<div id="page" class="has-footer-bar"><article>{PROSE}</article></div>',
    "marked around an article": f'<div class="sidebar-right"><article>{PROSE}</article></div>',
    "marked around most text": f'<div class="header-top"><div class="text">{PROSE}</div></div><p>x</p>',
    "comments inside": f'<article>{PROSE}<section class="user-comments"><p>I disagree with it all.</p></section><div class="comment-thread"><p>So do I, really.</p></div></article>',
    "comment articles": f'<article>{PROSE}</article><div class="comments"><article><p>A long comment. </p></article></div>',
    "title in a part": f'<article><div class="post-header">{PROSE[: PROSE.index("<p>")]}</div>{PROSE[PROSE.index("<p>") :]}</article>',
    "unclosed drawing": f'<article><svg viewBox="0 0 1 1"><path d="M0">{PROSE}</article>',
    "unclosed choice": f'<article><select><option>one<option>two{PROSE}</article>',
    "unclosed frame": f'<article><iframe src="x">{PROSE}</article>',
    "unclosed object": f'<article><object data="x">{PROSE}</article>',
    "closed ones": f'<article><svg><text>drawn</text></svg><select><option>one</select><iframe src="x">no frames</iframe>{PROSE}</article>',
    "advert before a short article": f'<div class="ad">{"Buy this now, and that. " * 40}</div><article>{PROSE}</article>',
    "menus of links": f'<div class="main-menu">{"<a href=x>a place to go</a> " * 90}</div><article>{PROSE}</article>',
}


def test_html_keeps_articles_below_marked_wrappers_and_after_unclosed_elements(spark):
    pages = spark.createDataFrame([(i, f"http://h{i}.example/a", source) for i, source in enumerate(MARKED.values())], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract_main_text(pages).collect()}
    assert {name: got[i] for i, name in enumerate(MARKED)} == {name: KEPT for name in MARKED}


def test_html_keeps_formulas_and_fallbacks_and_prefers_a_short_article_to_a_list(spark):
    rows = [
        (0, "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.</p><object data='x'>A chart of it.</object></article>"),
        (1, "<article><p>Short.</p></article><ul>" + "<li>an item of a list</li>" * 60 + "</ul>"),
    ]
    pages = spark.createDataFrame([(i, None, source) for i, source in rows], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract_main_text(pages, share=0.9).collect()}
    assert got == {0: "Let x=2 hold.\nA chart of it.", 1: "Short."}


def test_thousands_of_bytes_that_are_no_utf8_decode():
    assert pieces.readable(b"a" + b"\xff" * 5000 + "é".encode() + b"\xe9") == "a" + "\ufffd" * 5000 + "é" + "\ufffd"



def plain_chain(texts, labels, folds=3):
    """The chain over dense 0/1 matrices: {id: probabilities}, from {id: text} and {id: (0 or 1, ...)}."""

    def parts(text):
        words = re.findall(rb"[0-9a-z\x80-\xff]+", text.encode().lower())
        return set(words) | {(k, w[:k], len(w) > k) for w in words for k in toxicity.PREFIXES}

    ids = sorted(labels, key=str)
    have = {i: parts(t) for i, t in texts.items()}
    n, fold = len(ids), np.random.default_rng(0).permutation(len(ids)) % folds

    def gain(feature, y):
        k, m = sum(y[j] for j, i in enumerate(ids) if feature in have[i]), sum(feature in have[i] for i in ids)
        part = lambda a, share: a * math.log((a + 0.5) / (m * share + 0.5)) if a > 0 else 0.0
        return part(k, sum(y) / n) + part(m - k, 1 - sum(y) / n)

    def fitted(x, y):
        rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
        theta = np.zeros(x.shape[1] + 1)
        theta[-1] = math.log(rate / (1 - rate))
        one, two = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, 301):
            error = 1 / (1 + np.exp(-(x @ theta[:-1] + theta[-1]))) - y
            slope = np.append(x.T @ error, error.sum()) / len(y)
            slope[:-1] += 2e-5 * theta[:-1]
            one, two = 0.9 * one + 0.1 * slope, 0.99 * two + 0.01 * slope**2
            theta -= 0.1 * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.99**step)) + 1e-8)
        return lambda z: 1 / (1 + np.exp(-(z @ theta[:-1] + theta[-1])))

    every, earlier, found = sorted(set().union(*have.values()), key=str), np.zeros((n, 0)), np.zeros((len(texts), 0))
    for c in range(len(labels[ids[0]])):
        y = np.array([labels[i][c] for i in ids], dtype=float)
        chosen = [f for f in every if gain(f, y.tolist()) >= toxicity.LEAST_GAIN]
        own = np.array([[f in have[i] for f in chosen] for i in ids], dtype=float)
        x = np.hstack((own, earlier))
        outside = np.zeros(n)
        for k in range(folds):
            outside[fold == k] = fitted(x[fold != k], y[fold != k])(x[fold == k])
        whole = np.hstack((np.array([[f in have[i] for f in chosen] for i in texts], dtype=float), found))
        found = np.column_stack((found, fitted(x, y)(whole)))
        earlier = np.column_stack((earlier, outside))
    return dict(zip(texts, found))


def test_the_chain_equals_one_over_dense_matrices(spark):
    rng = random.Random(7)
    plain = ["house", "garden", "weather", "reading", "houses", "Music!", "café"]
    texts, labels = {}, {}
    for i in range(150):
        good, bad = rng.random() < 0.5, rng.random() < 0.35
        words = [rng.choice(plain) for _ in range(12)] + ["careful", "sourced"] * good + ["idiots", "scum"] * (bad and rng.random() < 0.9) + ["moron"] * (bad and not good)
        rng.shuffle(words)
        texts[i], labels[i] = " ".join(words), (int(good), int(bad))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    known = spark.createDataFrame([(i, *labels[i]) for i in range(110)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: (r.p_quality, r.p_toxic) for r in toxicity.toxicity(df, known).collect()}
    want = plain_chain(texts, {i: labels[i] for i in range(110)})
    assert all(np.allclose(got[i], want[i], atol=1e-6) for i in texts)
    assert sum((got[i][1] >= 0.5) == bool(labels[i][1]) for i in range(110, 150)) >= 34


def test_distinct_keys_are_sorted_and_quickly_found():
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 1 << 62, 400_000).astype(np.uint64)
    keys = np.concatenate((keys, keys[:200_000]))
    assert (lm.distinct(keys) == np.array(sorted(set(keys.tolist())), dtype=np.uint64)).all()
    assert len(lm.distinct(keys[:0])) == 0
    took = []
    for find in (lm.distinct, np.unique):
        began = time.perf_counter()
        find(keys)
        took.append(time.perf_counter() - began)
    assert took[0] < took[1] or took[0] < 0.1


def test_counts_are_handed_on_in_small_batches():
    keys = np.arange(3 * lm.HANDED + 5, dtype=np.int64)
    batches = list(lm.handed({"key": keys, "n": keys % 7}))
    assert max(b.num_rows for b in batches) == lm.HANDED and len(batches) == 4
    assert (np.concatenate([b.column("key").to_numpy() for b in batches]) == keys).all() and batches[0].schema.names == ["key", "n"]
    #: a tally of what a task holds stays far below its share of an executor
    assert 16 * lm.COUNTED <= 20_000_000
