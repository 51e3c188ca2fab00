"""Operators against brute force, round trips and held-out accuracy, and their edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trackloom.llm import token_counts
from trackloom.llm._graph import components
from trackloom.llm._text import NON_SPACE, Words, row_blocks, shingle_sets
from trackloom.llm._tokens import PieceTokens, WordTokens
from trackloom.llm.decontamination import find_phrases, remove_spans
from trackloom.llm.embeddings import near_duplicate_vectors
from trackloom.llm.fm_index import FMIndex
from trackloom.llm.html import best_container, extract_main_text, parse, text_below
from trackloom.llm.jaccard import _may_link, join_region, near_duplicates, signature
from trackloom.llm.packing import TournamentTree, first_fit_decreasing, pack
from trackloom.llm.pii import FEATURES, SegmentField, _likelihood, all_spans, base_spans, candidates, find_personal_data, fit_field, luhn, mask, perturbed, train_field, windows_of
from trackloom.llm.quality import held_out, score_quality, train_quality
from trackloom.llm.urls import GlobAutomaton, Rule, judge_urls
from trackloom.llm.warc import archive_and_read, build_archive, read_archive, read_warc, write_warc

SF = "/root/testdata/sf0.01"
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def documents(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + extra)


# --- WARC ------------------------------------------------------------------------------------


def test_archive_round_trip():
    records = [f"record {i} ".encode() * (i % 50) for i in range(300)] + [b"", b"\x00\xff" * 9000]
    data = build_archive(records)
    assert data[:4] == b"\x5d\x2a\x4d\x18"
    assert list(read_archive(data)) == records
    assert list(read_archive(build_archive([b"x"]))) == [b"x"]


def test_the_dictionary_is_used():
    import zstandard

    rnd = random.Random(1)
    words = [f"word{rnd.randint(0, 10**6)}" for _ in range(300)]
    records = [(" ".join(words[:150]) + " " + " ".join(rnd.choice(words) for _ in range(30))).encode() for _ in range(400)]
    alone = sum(len(zstandard.ZstdCompressor(level=3, write_checksum=True).compress(r)) for r in records)
    assert len(build_archive(records, dictionary_bytes=8 << 10)) < alone / 2


def test_records_have_ids_of_their_own(spark, tmp_path):
    long = "x" * 2000
    rows = [(5, "u", long)] * 3 + [(4, "u", long)] * 2 + [(None, "u", "a")] * 2 + [(7, "u", "b")]
    write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    records = [r.decode() for f in spark.read.format("binaryFile").load(str(tmp_path / "w")).collect() for r in read_archive(bytes(f.content))]
    ids = [re.search("WARC-Record-ID: (.*)\r", r)[1] for r in records]
    assert len(set(ids)) == len(rows)
    responses = {i for i, r in zip(ids, records) if "WARC-Type: response" in r}
    assert {re.search("WARC-Refers-To: (.*)\r", r)[1] for r in records if "WARC-Type: revisit" in r} <= responses


def test_a_payload_of_many_megabytes(spark, tmp_path):
    long = "<p>é" + "".join(f"{i} " for i in range(2_500_000))
    pages = spark.createDataFrame([(1, "http://a", long), (2, "http://b", long)], "page_id long, url string, html string")
    write_warc(pages, str(tmp_path / "w"))
    got = {r.page_id: r for r in read_warc(spark, str(tmp_path / "w")).collect()}
    assert got[1].record_type == "revisit" and got[1].refers_to == 2 and got[1].payload_digest == got[2].payload_digest
    assert bytes(got[2].payload).decode() == long


def test_revisits_nulls_and_ties(spark, tmp_path):
    long = "é" * 600
    rows = [(1, "http://a/\r\nb", long), (2, None, long), (5, "u", long), (5, "u", long), (3, "x", None), (4, "y", ""), (6, "z", "short"), (7, "z", "short"), (None, "n", long), (None, "n", "w" * 2000), (None, "n", "w" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload_digest", F.lit("clash"))
    write_warc(pages, str(tmp_path / "w"), archive_bytes=3000)
    got = read_warc(spark, str(tmp_path / "w")).collect()
    assert len(got) == len(rows)
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got)
    assert kinds == sorted([(1, "revisit", 5), (2, "revisit", 5), (5, "response", None), (5, "response", None), (3, "response", None), (4, "response", None), (6, "response", None), (7, "response", None), (0, "revisit", 5), (0, "response", None), (0, "response", None)], key=lambda k: k)
    assert all(r.payload_digest == hashlib.sha1(long.encode()).hexdigest() and r.payload_bytes == 1200 for r in got if r.page_id in (1, 2, 5))
    assert archive_and_read(pages.limit(0)).count() == 0


# --- decontamination -------------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=60), st.lists(st.integers(1, 9), min_size=1, max_size=4))
def test_fm_index_finds_all(text, pattern):
    text = np.array([*text, 0])
    index = FMIndex(text, rate=3)
    low, high = index.search(np.array([pattern]))
    want = [i for i in range(len(text) - len(pattern) + 1) if list(text[i : i + len(pattern)]) == pattern]
    assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == want


def test_fm_index_keeps_sampled_positions_only():
    text = np.concatenate([np.random.default_rng(1).integers(1, 40, 20_000), [0]])
    sizes = {rate: FMIndex(text, rate).sample.nbytes for rate in (4, 64)}
    assert sizes[64] < sizes[4] / 12 and sizes[4] <= 4 * (len(text) // 4 + 2)
    index = FMIndex(text, 64)
    assert sum(x.words.nbytes + x.counts.nbytes for x in index.levels) < 2 * len(text)


def test_items_without_an_id(spark):
    docs = documents(spark, [(1, "a b c d e"), (2, "x y")])
    bench = spark.createDataFrame([(None, "a b c"), (7, "x y z q"), (8, "d e")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r["items"], r.n_items) for r in find_phrases(docs, bench, 3).collect()}
    assert got == {1: (5, ["8"], 1), 2: (0, [], 0)}


def brute_hits(text, items, size):
    words = [m for m in re.finditer("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    names, hit = [m[0] for m in words], set()
    found = set()
    for item, own in items:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in own or ""))
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            for i in range(len(names) - n + 1):
                if names[i : i + n] == w[k : k + n]:
                    found.add(str(item))
                    hit.update(range(i, i + n))
    return len(names), len(hit), sorted(found)


@pytest.mark.parametrize("shard,chars", [(1 << 18, 8 << 20), (40, 60)])
def test_phrases_by_brute_force(spark, shard, chars):
    rnd = random.Random(5)
    items = [(i, " ".join(rnd.choice("abcdé") for _ in range(rnd.randint(0, 18)))) for i in range(12)] + [(20, None), (21, "...")]
    texts = [" ".join(rnd.choice("abcdé") for _ in range(rnd.randint(0, 120))) for _ in range(30)] + [None, "", "A-B, c D! É", "a" * 50_000, items[3][1].upper(), "a b c d " * 400]
    docs = documents(spark, list(enumerate(texts)) + [(0, texts[0])]).withColumn("items", F.lit(1)).withColumn("lang", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = find_phrases(docs, bench, 4, shard, chars).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        n, hit, found = brute_hits(r.text, items, 4)
        assert (r.n_words, r.n_hit, r.n_items, r["items"]) == (n, hit, len(found), found), r.doc_id
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
        assert r.contaminated == (hit > 0 and 20 * hit >= n) and r.lang == "x"
        if hit:
            assert remove_spans(r.text, [(s.start, s.end) for s in r.spans]) is not None
            assert sum(len(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", r.text[s.start : s.end].lower())) for s in r.spans) == hit
    assert find_phrases(docs.limit(0), bench).count() == 0
    assert find_phrases(docs, bench.limit(0)).where("contaminated or n_hit > 0").count() == 0


# --- pages -----------------------------------------------------------------------------------


def test_article_without_its_surroundings():
    html = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header>top</header><nav><p>menu</p></nav>
    <div class="cookie notice">we use</div><main><div class="post-12"><h1>A &amp; B&nbsp;C</h1><p>one<br>two <b>three</b><p>four
    <script>var x = "</p>";</script> five<ul><li>six<li>seven</ul><div class="ads">buy</div><form>f<input></form><section id="comments"><p>nice</p></section><article class="comment c-1"><p>me too</p></article></div></main>
    <aside>side</aside><footer>foot</footer><!-- gone --></body></html>"""
    assert text_below(parse(html), None) == "A & B C\n\none two three\n\nfour five\n\nsix\n\nseven"
    assert text_below(parse("<p>a &lt;b&gt; &#233;<div>c"), None) == "a <b> é\n\nc"
    assert text_below(parse(None), None) == text_below(parse("<script>never closed"), None) == ""


@pytest.mark.parametrize("name", ["content has-sidebar", "no-sidebar", "with-sidebar", "ads-enabled", "sidebar", "post comments-open"])
def test_names_do_not_drop_the_article(name):
    kept = "<p>" + "words of the article, and more. " * 9 + "<math><mi>x</mi></math></p>"
    for tag in ("div", "article", "main"):
        page = f"<html><body><div class='menu'><p>menu</p></div><{tag} class='{name}'>{kept}</{tag}><div class='sidebar'>side</div></body></html>"
        text = text_below(parse(page), None)
        assert text.startswith("words of the article") and text.endswith("x") and "menu" not in text and "side" not in text


def test_a_long_thread_does_not_outweigh_a_short_article():
    page = "<body><article><p>Short.</p></article><div class='comments'>" + "<p>A long answer.</p>" * 9 + "</div></body>"
    assert text_below(parse(page), None) == "Short."


@pytest.mark.parametrize("attributes", ["class='content no-sidebar'", "class='main-side-content'", "id='top-nav-article'"])
def test_names_are_evidence_only(attributes):
    page = f"<body><nav>menu</nav><div {attributes}><h1>Title</h1><p>The text of it, as long as it is.</p></div><div class='sidebar'>side</div></body>"
    assert text_below(parse(page), None) == "Title\n\nThe text of it, as long as it is."


def test_a_form_around_the_article_is_no_form():
    page = "<body><form><div><h1>Title</h1><p>All of the page lies in one form.</p><select><option>a</select><input></div></form><form><p>Send</p></form></body>"
    assert text_below(parse(page), None) == "Title\n\nAll of the page lies in one form."
    assert text_below(parse("<body><p>Short.</p><form>Name, street and town, and whatever else one likes to ask for</form></body>"), None) == "Short."


def test_white_space_of_all_kinds():
    assert text_below(parse("<p>a\u2003\u2003b\u2028c &#x3000; d&nbsp;</p>"), None) == "a b c d"


def test_deep_elements_take_linear_time():
    import time

    def took(n):
        page = "<div class='x'><p>" * n + "word"
        began = time.process_time()
        parsed = parse(page)
        assert text_below(parsed, parsed.below(best_container(parsed))) == "word"
        return time.process_time() - began

    took(500)
    assert took(10_000) < 1
    wide = parse("<body>" + "<b>" * 20_000 + "x" + "<p>y" * 2000)
    assert text_below(wide, None).startswith("x\n\ny")


def plain_main_text(html):
    """Blocks of pages that nest nothing but div, p and headings and mark what is around by nav, header, footer and aside."""
    import html as reference

    kept = re.sub(r"(?s)<(nav|header|footer|aside|script|style|head)\b.*?</\1>", "", html)
    return [" ".join(reference.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:div|p|h[1-6]|body|html)\b[^>]*>", kept)]


def test_pages_without_article_elements(spark):
    rnd = random.Random(4)

    def words(n):
        return " ".join(rnd.choice(["alpha", "b&amp;c", "d\u2003e", "f,", "g."]) for _ in range(n))

    rows = []
    for i in range(40):
        body = "".join(f"<p>{words(rnd.randint(3, 40))}</p>" for _ in range(rnd.randint(1, 6)))
        rows.append((i, f"http://h{i % 3}.example/{i}", f"<html><head><title>t</title></head><body><header>{words(5)}</header><nav>{words(9)}</nav><div class='story s{i}'><h1>{words(4)}</h1>{body}</div><aside>{words(8)}</aside><footer>{words(3)}</footer></body></html>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in extract_main_text(pages).collect():
        assert r.text == "\n\n".join(b for b in plain_main_text(r.html) if b)


def test_end_tags_close_deep_elements():
    page = "<body><span>" + "<b>" * 20 + "a" + "</span><p>b</p></body>"
    assert text_below(parse(page), None) == "a\n\nb"


def test_hosts_elect_a_container(spark):
    def page(i, body):
        return (i, "http://h.example/x", f"<html><body><div class='teaser'>{'t ' * 30}</div><div class='story n{i}'>{body}</div></body></html>")

    rows = [page(i, "<p>" + "word, and more. " * 40 + "</p>") for i in range(8)] + [page(9, "<p>tiny</p>"), (10, None, None), (11, "nohost", ""), (12, "http://other.example", "<p>only</p>"), (12, "http://other.example", "<p>only</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("container", F.lit(3))
    got = {}
    for r in extract_main_text(pages).collect():
        got.setdefault(r.page_id, []).append(r)
    assert got[9][0].text == "tiny" and got[9][0].container == "/html/body/div.nN.story"
    assert got[10][0].text == got[11][0].text == "" and got[10][0].n_chars == 0
    assert [r.text for r in got[12]] == ["only", "only"]
    assert extract_main_text(pages.limit(0)).count() == 0


def test_given_pages_give_their_articles(spark):
    got = {r.page_id: r for r in extract_main_text(table(spark, "pages")).collect()}
    for p in table(spark, "pages").collect():
        article = p.html.split("<article>")[1].split("</article>")[0]
        import html

        want = [" ".join(html.unescape(re.sub("<br>|</?b>", " ", part)).split()) for part in re.split("</?(?:p|h1)>", article)]
        assert got[p.page_id].text == "\n\n".join(w for w in want if w) and got[p.page_id].n_chars == len(got[p.page_id].text)


def prose(n, text="Some words of prose stand here, and more."):
    return "".join(f"<p>{text} {i}</p>" for i in range(n))


ARTICLE_CLASSES = "".join(f"<{tag} class='{name}'>{name.upper()} stands here.</{tag}>" for tag, name in [("p", "social"), ("p", "notice"), ("div", "ad-hoc"), ("div", "table-widget"), ("h2", "section-header"), ("div", "alert")])
#: Articles, and what must not be in their text.
ARTICLES = {
    "headline and lead": (f"<div class='post'><h1>Head</h1><p class='lead'>Lead.</p><div class='body'>{prose(12)}</div></div>", ""),
    "sections": (f"<div class='main-text'><div class='intro'>{prose(2)}</div><div class='body'>{prose(12)}</div><div class='end'>{prose(2, 'The end of a long article, told in two parts.')}</div></div>", ""),
    "sections of an article": (f"<article><section class='intro'>{prose(2)}</section><section class='body'>{prose(12)}</section><section class='end'>{prose(2)}</section></article>", ""),
    "after a table": ("<div class='c'><p>Start.</p><table>" + "<tr><td>cell a</td><td>cell b</td></tr>" * 30 + "</table><p>END</p></div>", ""),
    "after a quotation": (f"<div class='c'><p>Start.</p><blockquote>{prose(8)}</blockquote><p>END</p></div>", ""),
    "marked paragraphs": (f"<article><h1>Head</h1>{prose(3)}{ARTICLE_CLASSES}<blockquote><p>Said.</p><footer>Its source</footer></blockquote></article>", ""),
    "buttons and drawings": (f"<article><p>one <button>PUSHME</button> two <svg><text>DRAWN</text><path d='x'/></svg> three <select><option>o<option>p</select> four<svg class='x'/> five</p>{prose(2)}</article>", "PUSHME|DRAWN|o<option>p|o|p"),
    "unclosed quote": ("<article><p title=\"abc>two words</p><p>three</p></article>", ""),
    "unclosed quote before another": ("<article><p title=\"abc>two <a href=\"x\">words</a></p><p>three</p></article>", ""),
    "signs in attributes": ("<article><p title=\"a > b\" class='x'>two</p><img alt='a>b'><p data-x=1/>three</p></article>", ""),
}


def wanted(name, article):
    """Blocks by their tags alone."""
    article = re.sub(r"<(button|svg|select)\b[^>]*(?<!/)>.*?</\1>", "", article)
    article = re.sub(r"<svg[^>]*/>", "", article)
    if "quote" in name:
        article = article.replace('title="abc', "")
    article = re.sub(r"""(title|alt|data-x)=("[^"]*"|'[^']*'|1/)""", "", article)
    blocks = re.split(r"</?(?:div|p|h[1-6]|article|section|table|tr|td|blockquote|footer)\b[^>]*>", article)
    return "\n\n".join(b for b in (" ".join(re.sub("<[^>]*>", "", b).split()) for b in blocks) if b)


def around(article):
    links = "".join(f"<li><a href='{i}'>Link number {i}</a>" for i in range(9))
    return (
        f"<html><body><header><p>Site</p></header><nav><a href='/'>Home</a></nav><div class='main-menu'><ul>{links}</ul></div>{article}<div class='sidebar'><p>Side text stands here.</p></div><div class='related-posts'><h3>More</h3><ul>{links}</ul></div>"
        f"<div class='comments'><p>I liked it, and more than that.</p></div><div class='links'><ul>{links}</ul></div><div class='bottom'><p>Copyright 2024 Foo. All rights reserved.</p></div><footer>Foot</footer></body></html>"
    )


@pytest.mark.parametrize("name", ARTICLES)
def test_no_part_of_an_article_is_lost(name):
    article, _ = ARTICLES[name]
    for page in (article, around(article)):
        parsed = parse(page)
        assert text_below(parsed, parsed.below(best_container(parsed))) == wanted(name, article)


def test_hosts_of_such_pages(spark):
    rows = [(k * 100 + i, f"http://h{k}.example/{i}", around(article)) for k, (article, _) in enumerate(ARTICLES.values()) for i in range(50)]
    mixed = [(10_000 + i, "http://mixed.example/", around(list(ARTICLES.values())[i % 10][0])) for i in range(50)]
    short = [(20_000 + i, "http://short.example/", around(f"<div class='post'>{'<h1>Head</h1><p>Lead.</p>' if i == 7 else ''}<div class='body'>{prose(5)}</div></div>")) for i in range(20)]
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows + mixed + short, "page_id long, url string, html string")).collect()}
    for k, (name, (article, _)) in enumerate(ARTICLES.items()):
        assert {got[k * 100 + i] for i in range(50)} == {wanted(name, article)} == {got[10_000 + i] for i in range(50) if i % 10 == k}
    assert got[20_007] == "Head\n\nLead.\n\n" + got[20_000] and got[20_000].count("Some") == 5


def test_very_long_pages(spark):
    body = prose(40_000)
    pages = spark.createDataFrame([(1, "http://a", around(f"<article>{body}</article>")), (2, "http://b", "<p>" + "x" * 5_000_000)], "page_id long, url string, html string")
    got = {r.page_id: r for r in extract_main_text(pages).collect()}
    assert got[1].text == wanted("", body) and got[2].n_chars == 5_000_000


# --- vectors ---------------------------------------------------------------------------------


def test_vectors_by_brute_force(spark):
    random_ = np.random.default_rng(3)
    base = random_.normal(size=(30, 8))
    rows = [(i, (base[i % 30] + random_.normal(size=8) * (0.02 if i % 3 else 0.12)).tolist(), int(i % 2)) for i in range(400)]
    rows += [(1000, rows[0][1], 0), (1001, [2 * x for x in rows[0][1]], 0), (1002, rows[0][1], None), (1003, None, 0), (1004, [0.0] * 8, 0), (1005, [float("nan")] * 8, 0), (1006, [1.0, None] * 4, 0), (1007, [1.0, 0.0], 0), (1008, [1.0, 0.0], 0), (1007, [1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("kept", F.lit("clash"))
    got = near_duplicate_vectors(df, block=16, cell_rows=20).collect()
    good = [(i, np.array(v, dtype=float), label) for i, v, label in rows if v and label is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {}
    for a in range(len(good)):
        for b in range(len(good)):
            if a != b and good[a][2] == good[b][2] and len(good[a][1]) == len(good[b][1]):
                x, y = good[a][1], good[b][1]
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                    links.setdefault(a, set()).add(b)
    root = {}
    for a in range(len(good)):
        seen, todo = {a}, [a]
        while todo:
            todo += [n for n in links.get(todo.pop(), ()) if n not in seen and not seen.add(n)]
        root[a] = min(good[n][0] for n in seen)
    want = sorted([(good[a][0], len(links.get(a, ())), root[a]) for a in range(len(good))] + [(i, 0, i) for i in (1002, 1003, 1004, 1005, 1006)])
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert near_duplicate_vectors(df.limit(0)).count() == 0


# --- tokens ----------------------------------------------------------------------------------

ODD = [None, "", " ", "Hello   wörld it's don't\x1cfoo bar  x<|endoftext|>y <|STARTOFTEXT|> 12.5 a̋ é İstanbul ΣΑΣ", " lead", "tail ", "two  spaces", "nl\nnl\tt x", "word%%% x'll're a'b 'tis ''s", "a▁b c", "ß" * 3000, "x " * 5000]


def test_memo_equals_the_tokenizers():
    plain = Tokenizer.from_file(WORDS)
    for memo in (WordTokens(WORDS), PieceTokens(PIECES)):
        for target in (64, 1 << 20):
            got = []
            for _, ids, ends in memo.blocks(pa.array(ODD, pa.string()), target):
                got += np.split(ids, ends[1:-1])
            want = memo.encode([t or "" for t in ODD])
            assert [g.tolist() for g in got] == [list(w) for w in want]
    assert list(plain.encode(ODD[3], add_special_tokens=False).ids) == list(WordTokens(WORDS).encode([ODD[3]])[0])


@pytest.mark.parametrize("shuffled", [False, True])
def test_token_counts_across_blocks_and_files(spark, tmp_path, monkeypatch, shuffled):
    rows = [(i, t) for i, t in enumerate(ODD * 3)] + [(None, "no id"), (1, "again")]
    docs = documents(spark, rows).withColumn("n_tokens", F.lit(1)).repartition(3)
    if not shuffled:
        docs.write.parquet(str(tmp_path / "d"))
        docs = spark.read.parquet(str(tmp_path / "d"))
    monkeypatch.setattr(token_counts, "_FILE_BYTES", 300)
    scan = token_counts.scan_token_files
    monkeypatch.setattr(token_counts, "scan_token_files", lambda s, p, e: scan(s, p, e, block_ids=7))
    model = PieceTokens(PIECES)
    got = token_counts.count_tokens(docs, PIECES).collect()
    want = sorted((-1 if i is None else i, len(model.encode([t or ""])[0])) for i, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in got) == want
    for stream in {r.stream for r in got}:
        at = 0
        for k, r in enumerate(sorted((r for r in got if r.stream == stream), key=lambda r: r.ordinal)):
            assert r.start == at and r.ordinal == k
            at += r.n_tokens + 1
    assert token_counts.count_tokens(docs.where("doc_id > 900"), PIECES).count() == 0


def test_files_keep_their_order_whatever_the_job_is_called(spark, tmp_path):
    for k in range(3):  # a job id that looks like a file's number
        ids = np.array([5] * (2 * k + 1) + [2] + [5] * (2 * k + 2) + [2], dtype="<u2").tobytes()
        listed = np.array([2 * k + 1, 2 * k + 2], dtype="<i8").tobytes() + b"\1\1"
        for number, data in ((2 * k, ids), (2 * k + 1, listed + b"\2\0")):
            (tmp_path / f"part-00004-1d5ae000-c417-4c00-8c12-c0ffee-c{number:03d}.txt").write_bytes(data)
    got = sorted((r.ordinal, r.doc_id, r.n_tokens, r.start) for r in token_counts.scan_token_files(spark, str(tmp_path)).collect())
    assert got == [(k, k + 1, k + 1, sum(range(k + 1)) + k) for k in range(6)]


def test_lists_that_do_not_fit_their_files_fail(spark, tmp_path):
    (tmp_path / "part-00000-x-c000.txt").write_bytes(np.array([5, 2, 5, 2], dtype="<u2").tobytes())
    (tmp_path / "part-00000-x-c001.txt").write_bytes(np.array([1], dtype="<i8").tobytes() + b"\1\2\0")
    with pytest.raises(Exception, match="differ"):
        token_counts.scan_token_files(spark, str(tmp_path)).collect()


def test_a_very_long_text_is_counted_whole(spark):
    long = "some words of it " * 1_500_000
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(documents(spark, [(1, long.strip()), (2, "some words")]), PIECES).collect()}
    model = PieceTokens(PIECES)
    assert got == {1: len(model.encode(["some words of it"])[0]) * 1_500_000, 2: len(model.encode(["some words"])[0])}


def test_first_fit_decreasing_is_that(spark):
    rnd = random.Random(2)
    sizes = np.array([rnd.randint(1, 100) for _ in range(500)])
    bins, offsets = first_fit_decreasing(sizes, 100)
    free = []
    for i in sorted(range(500), key=lambda i: -sizes[i]):
        k = next((k for k, f in enumerate(free) if f >= sizes[i]), None)
        if k is None:
            k = len(free)
            free.append(100)
        assert bins[i] == k and offsets[i] == 100 - free[k]
        free[k] -= sizes[i]
    assert TournamentTree(1, 5).first_fit(5) == (0, 5)


def test_packing_is_whole_and_gapless(spark):
    docs = table(spark, "documents").select("doc_id", "text").union(documents(spark, [(5000, None), (5001, ""), (None, "x"), (5000, None)])).withColumn("length", F.lit("clash"))
    rows = pack(docs, WORDS, group_rows=300).collect()
    tokenizer = Tokenizer.from_file(WORDS)
    texts = {r.doc_id: r.text for r in docs.collect()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts) and len(by_doc[5000]) == 2
    for doc, pieces in by_doc.items():
        ids = [*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 2]
        at = 0
        for p in sorted(pieces, key=lambda p: p.start) if doc != 5000 else pieces[:1]:
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], dtype="<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
    total = sum(r.length for r in rows)
    assert total / (4096 * len(by_sequence)) > 0.9
    assert pack(docs.limit(0), WORDS).count() == 0


# --- near duplicates -------------------------------------------------------------------------


def brute_components(texts):
    sets = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links = [[j for j in range(len(sets)) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])] for i in range(len(sets))]
    root = []
    for i in range(len(sets)):
        seen, todo = {i}, [i]
        while todo:
            todo += [n for n in links[todo.pop()] if n not in seen and not seen.add(n)]
        root.append(min(seen))
    return [len(s) for s in sets], root


@pytest.mark.parametrize("block", [256, 3])
def test_near_duplicates_by_brute_force(spark, block):
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", "  \n", "one two", "ONE  two", "one two three"]
    common = " ".join(rnd.choice(words) for _ in range(60))
    for _ in range(6):
        base = [rnd.choice(words) for _ in range(rnd.randint(20, 160))]
        for _ in range(14):
            own = list(base)
            for _ in range(rnd.randint(0, max(1, len(own) // 22))):
                own[rnd.randrange(len(own))] = rnd.choice(words)
            texts.append(" ".join(own))
            texts.append(common + " " + " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 40))))
    texts += [texts[10]] * 5 + ["long " * 3 + " ".join(rnd.choice(words) for _ in range(9000))]
    sizes, root = brute_components(texts)
    docs = documents(spark, list(enumerate(texts))).withColumn("n_shingles", F.lit("clash"))
    got = {r.doc_id: r for r in near_duplicates(docs, block=block).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == root


def test_near_duplicates_of_nulls_and_none(spark):
    same = "a b c d e f g"
    docs = documents(spark, [(None, same), (4, same), (4, same), (9, same.upper()), (None, "x y"), (7, None)])
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in near_duplicates(docs).collect() if r.doc_id)
    assert got == [(4, 3, 4), (4, 3, 4), (7, 0, 7), (9, 3, 4)]
    assert near_duplicates(docs).count() == 6
    assert near_duplicates(docs.limit(0)).count() == 0


def test_signatures_lose_no_link():
    rnd = np.random.default_rng(1)
    sets = []
    for _ in range(25):
        base = rnd.integers(0, 1 << 63, size=rnd.integers(1, 300), dtype=np.uint64)
        for _ in range(3):
            own = base.copy()
            own[rnd.integers(0, len(own), size=len(own) // 12)] = rnd.integers(0, 1 << 63)
            sets.append(np.unique(own))
    sizes = np.array([len(s) for s in sets])
    kept = _may_link(sizes, [signature(s) for s in sets], 80, 100)
    for i, a in enumerate(sets):
        if any(i != j and 100 * len(set(a.tolist()) & set(b.tolist())) >= 80 * len(set(a.tolist()) | set(b.tolist())) for j, b in enumerate(sets)):
            assert kept[i]
    assert len(join_region([s for s in sets if len(s)], 80, 100)) > 20


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (1, 2), (2, 1)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="aB é\n,", max_size=30), max_size=8))
def test_shingle_counts(texts):
    got = []
    for _, data, offsets in row_blocks(pa.array(texts, pa.string()), 16):
        got += [len(s) for s in shingle_sets(Words(data, offsets, NON_SPACE), 5)]
    assert got == brute_components(texts)[0]


# --- personal data ---------------------------------------------------------------------------


def plain_base(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a.@1+ -()%2é", max_size=40))
def test_base_spans_are_the_patterns(text):
    assert sorted(base_spans(text)) == plain_base(text)


def test_likelihood_gradient():
    text = "mail a1@b2.de or 10.0.0.1 now"
    tokens, spans, x = candidates(text)
    rnd = np.random.default_rng(0)
    w = rnd.normal(size=(5, x.shape[1])) * 0.3
    gold = {(a, b): 0 if k == "email" else 1 for a, b, k in base_spans(text)}
    value, told = _likelihood(len(tokens), spans, x @ w.T, gold)
    gradient = told.T @ x
    for k, f in ((0, 1), (1, 3), (3, 9)):
        moved = w.copy()
        moved[k, f] += 1e-5
        assert (_likelihood(len(tokens), spans, x @ moved.T, gold)[0] - value) / 1e-5 == pytest.approx(gradient[k, f], abs=1e-3)


def test_field_finds_what_patterns_miss(spark):
    docs = table(spark, "documents")
    field = train_field(docs)
    spans = [s for r in docs.select("text").collect() for s in all_spans(r.text, field)]
    assert {s[2] for s in spans if not s[3]} >= {"secret"}
    text = 'x +1 (212) 555-7713 4918187128635271 and token = "0cab398dc11d1a2a11dc6572c8df8bd228c864f3" y'
    got = {(text[a:b], k) for a, b, k, _ in all_spans(text, field)}
    assert ("4918187128635271", "card") in got or not luhn("4918187128635271")
    assert ("0cab398dc11d1a2a11dc6572c8df8bd228c864f3", "secret") in got
    assert all_spans("Plain words only, nothing here. In 1998 there were 25 of them.", field) == []
    windows = ["a b.4@mail.example.com c"] * 20
    assert isinstance(fit_field(windows), SegmentField) and isinstance(fit_field([]), SegmentField)


def best_by_enumeration(text, field):
    """Score of the best set of disjoint candidate spans."""
    _, spans, x = candidates(text)
    value = (x @ field.weights.T).max(axis=1) if spans else []
    spans = [(s[0], s[1], v) for s, v in zip(spans, value) if v > 0]

    def best(at):
        return max([0.0, *(v + best(b) for a, b, v in spans if a >= at)])

    return best(0)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="a1@. +-:\n", max_size=14), st.integers(1, 9))
def test_decoding_is_the_best_labelling(text, seed):
    field = SegmentField(np.random.default_rng(seed).normal(size=(5, len(FEATURES))))
    got = field.decode(text, starts=3)
    assert all(a[1] <= b[0] for a, b in zip(got, got[1:]))
    places = {(s[2], s[3]): (field.weights @ row).max() for _, spans, x in [candidates(text)] for s, row in zip(spans, x)}
    assert sum(places[a, b] for a, b, _ in got) == pytest.approx(best_by_enumeration(text, field))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["w" * 30, "x" * 47 + " ", "1" + "y" * 60, "4 4 4", "word", " ", "1", "@", ". ", "é", "\n", "x9", "-", "wordsthatarelong " * 3, "a,b;c:d " * 4]), max_size=40))
def test_windows_hold_every_candidate(parts):
    text = "".join(parts)
    windows = windows_of(text)
    assert all(a < b and text[a:b].strip() for a, b in windows) and all(x[1] < y[0] or x[1] <= y[0] for x, y in zip(windows, windows[1:]))
    starts = set(candidates(text)[0])
    assert all(a in starts for a, _ in windows)
    for _, _, a, b in candidates(text)[1]:
        assert any(x <= a and b <= y for x, y in windows)


def test_a_long_dense_text_is_labelled_as_a_whole():
    field = fit_field([])
    value = "4918.1871.2863.5271"
    text = "9 " * 9000 + f"a.b @ c.de {value}"
    spans = all_spans(text, field)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert [s for s in all_spans("x " * 50_000 + "me@b.de", field)] == [(100_000, 100_007, "email", True)]


def test_rows_of_personal_data_by_brute_force(spark):
    docs = table(spark, "documents").select("doc_id", "text")
    field = train_field(docs)
    for r in find_personal_data(docs, field).collect():
        base = sorted(plain_base(r.text or ""), key=lambda s: (s[0], ["email", "ip", "card", "phone"].index(s[2])))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[2] == k for s in base) for k in ("email", "ip", "card", "phone")]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest()
        assert [(s.start, s.end, s.kind) for s in r.found if s.base] == base
        assert r.spans == ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.found)


def test_the_field_learns_forms_that_no_pattern_knows(spark):
    field, plain = train_field(table(spark, "documents")), fit_field([])
    rnd, forms = random.Random(8), np.random.default_rng(9)
    hits = {"learnt": 0, "unlearnt": 0, "all": 0}
    for k in range(120):
        digits = "".join(rnd.choice("123456789") for _ in range(15))
        card = next(digits + c for c in "0123456789" if luhn(digits + c))
        value = [f"{card[:4]} {card[4:8]} {card[8:12]} {card[12:]}", f"+{rnd.randint(1, 99)} {rnd.randint(100, 999)} {rnd.randint(10**6, 10**7)}", f"{rnd.choice(['ann', 'j.doe'])}{k}@mail{k}.example.org"][k % 3]
        text, gold = perturbed(f"Some words before {value} and some after.", forms)
        a, b, kind = gold[-1]
        hits["all"] += 1
        hits["learnt"] += (a, b, kind) in [s[:3] for s in all_spans(text, field)]
        hits["unlearnt"] += (a, b, kind) in [s[:3] for s in all_spans(text, plain)]
    assert hits["learnt"] >= 0.8 * hits["all"] and hits["learnt"] > hits["unlearnt"]
    for clean in ("In 2003.04.05 it was 12.500 m long, 00 of 12 @ home.", "Version 1.2.3.4.5 of 2019-2020, pages 100-200, 3/4/5/6.", "It rose +5 and +2020 to +12.5 (+3)."):
        assert [s for s in all_spans(clean, field) if not s[3]] == []


def held_out_forms(rnd, k):
    """A value in a form that training never shows, and its kind."""
    digits = "".join(rnd.choice("123456789") for _ in range(15))
    card = next(digits + c for c in "0123456789" if luhn(digits + c))
    return [
        (f"{card[:4]}. {card[4:8]}. {card[8:12]}. {card[12:]}", "card"),
        (f"{card[:6]}.{card[6:12]}-{card[12:]}", "card"),
        (f"00{rnd.randint(1, 99)} {rnd.randint(100, 999)} {rnd.randint(10**6, 10**7)}", "phone"),
        (f"{rnd.choice(['ann', 'j.doe'])}{k} @ mail.box{k}.example.org", "email"),
    ][k % 4]


def test_held_out_forms_are_found(spark):
    """Recall on forms drawn apart from those of training, other groups and separators, in other sentences."""
    field = train_field(table(spark, "documents"))
    rnd = random.Random(21)
    found = {}
    for k in range(200):
        value, kind = held_out_forms(rnd, k)
        text = f"It was told to us that {value} would do, as ever."
        a = text.index(value)
        hit = any(s[2] == kind and s[0] < a + len(value) and a < s[1] for s in all_spans(text, field))
        found.setdefault(k % 4, []).append(hit)
    recall = {k: sum(v) / len(v) for k, v in found.items()}
    print("recall of held-out forms", recall)
    assert sum(recall.values()) / 4 >= 0.5


def test_personal_data_rows(spark):
    field = fit_field([])
    docs = documents(spark, [(1, None), (2, ""), (3, "mail é.x1@b.de"), (3, "mail é.x1@b.de"), (4, "1" * 30_000), (5, "+1 (212) 555-7713")]).withColumn("spans", F.lit(1)).withColumn("keep", F.lit("k"))
    got = {}
    for r in find_personal_data(docs, field).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [r.spans for r in got[3]] == ["email:6:14"] * 2 and got[3][0].masked == "mail é[EMAIL]" and got[3][0].keep == "k"
    assert got[1][0].masked is None and got[1][0].spans == "" and got[2][0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[5][0].n_phone == 1 and got[4][0].n_card == 0
    assert find_personal_data(docs.limit(0), field).count() == 0 and isinstance(train_field(docs.limit(0)), SegmentField)
    assert mask("abcdef", [(1, 3, "ip"), (2, 4, "card")]) == "a[IP]ef"


# --- URLs ------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab/*?\\", max_size=7), min_size=1, max_size=12), st.lists(st.text(alphabet="ab/", max_size=9), max_size=8))
def test_automaton_matches_like_regexes(globs, texts):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    got = GlobAutomaton(globs * 5).match(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets)
    for k, g in enumerate(globs * 5):
        pattern = re.compile("".join(".*" if p == "**" else "[^/]*" if p == "*" else "[^/]" if p == "?" else re.escape(p[-1]) for p in re.findall(r"\\.|\*\*|.", g)))
        assert [bool(x) for x in got[:, k]] == [pattern.fullmatch(t) is not None for t in texts], g


def test_longest_rule_decides(spark):
    rules = [Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7")]
    urls = ["http://A.Example.COM/en/7x?q", "https://b.com/en/1#x", "http://com/en/", "http://xcom/en/", "no scheme", None, "http://evil.net/x.com/en/", "ftp://spam.org", "http://a.com", "http://h/" + "x" * 5000]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(1, urls[1])], "page_id long, url string").withColumn("rule", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(df, rules, ["*spam*"]).collect()}
    assert got[0] == ("a.example.com", "/en/7x", "example.com/en/7", "allow") and got[1] == ("b.com", "/en/1", "com/en/", "block")
    assert got[2][2:] == ("com/en/", "block") and got[3][2:] == (None, "allow") and got[4] == got[5] == ("", "", None, "allow")
    assert got[6][2:] == (None, "allow") and got[7][2:] == (None, "block") and got[8][:2] == ("a.com", "") and len(got[9][1]) == 5001
    assert judge_urls(df.limit(0), rules, []).count() == 0 and judge_urls(df, [], []).where("verdict = 'block'").count() == 0


def test_rules_without_a_path_and_with_signs_of_globs(spark):
    rules = [Rule("block", "com", ""), Rule("allow", "a.com", "/x*y"), Rule("allow", "q.com", "/?")]
    urls = ["http://community.net/", "http://a.company.org/", "http://b.com", "http://b.com/p", "http://a.com/xzy", "http://a.com/x*yz", "http://q.com/a", "http://q.com/?a", "http://s.a.com/x*y"]
    got = [r.rule for r in judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules, []).orderBy("page_id").collect()]
    assert got == [None, None, "com", "com", "com", "a.com/x*y", "com", "com", "a.com/x*y"]
    with pytest.raises(ValueError):
        Rule("block", "com", "x")


# --- quality ---------------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    scored = score_quality(docs, train_quality(docs, labels)).join(labels, "doc_id").where(held_out(F.col("doc_id"))).select("quality", "predicted", "score").collect()
    assert len(scored) > 80 and np.mean([r.quality == r.predicted for r in scored]) > 0.95
    ids = [r.doc_id for r in docs.where(held_out(F.col("doc_id"))).select("doc_id").collect()]
    assert set(ids) == {r.doc_id for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}


def test_quality_edges(spark):
    docs = documents(spark, [(1, None), (2, ""), (2, ""), (None, "a b c"), (3, "!" * 20_000)]).withColumn("score", F.lit("clash"))
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    got = score_quality(docs, train_quality(docs, none)).collect()
    assert len(got) == 5 and all(r.score == 0.5 and r.predicted == 1 for r in got)
    assert score_quality(docs.limit(0), train_quality(docs, none)).count() == 0


def test_centre_distances_without_a_cube_of_differences():
    import tracemalloc

    from trackloom.llm import embeddings

    centre = np.random.default_rng(1).normal(size=(500, 64))
    centre /= np.linalg.norm(centre, axis=1)[:, None]
    centre[1] = centre[0]
    tracemalloc.start()
    apart = embeddings._apart(centre)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500 * 500 * 8 * 6
    exact = np.stack([np.linalg.norm(centre - c, axis=1) for c in centre])
    assert (apart >= exact).all() and np.abs(apart - exact).max() < 1e-5
