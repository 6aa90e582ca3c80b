"""Revisits, page text, token files and preference pairs: small cases against brute force."""

import datetime as dt
import random
import re
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from deltawarden.llm import preferences, revisits, separators, tagpaths, tokens
from deltawarden.session import scratch_path

RECORDS = ("record_id bigint, warc_type string, profile string, target_uri string, captured_at timestamp, "
           "http_status int, http_headers array<struct<name: string, value: string>>, body string, status string")
NOT_MODIFIED = "http://netpreserve.org/warc/1.0/revisit/server-not-modified"


def at(hour):
    return None if hour is None else dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour)


def response(i, url, hour, headers=(), status=200):
    return (i, "response", None, url, at(hour), status, list(headers), f"body {i}", "x")


def revisit(i, url, hour, headers=(), profile=NOT_MODIFIED):
    return (i, "revisit", profile, url, at(hour), 304, None if headers is None else list(headers), None, "x")


def test_revisits(spark):
    rows = [
        response(1, "http://www.a.org/x/", 1, [("ETag", '"1"'), ("Content-Type", "text/html"), ("Age", "1")]),
        response(2, "https://a.org/x#top", 5, [("etag", 'W/"2"'), ("Last-Modified", "Mon")]),
        response(3, "a.org/x?b=2&a=1&utm_source=q", 2, [("Last-Modified", "Tue")]),
        response(4, "http://a.org/x", 6, [("ETag", '"9"')], status=404),
        revisit(10, "HTTP://A.org:80/x", 0), revisit(11, "http://a.org/x", 3, [
            ("ETag", '"1"'), ("age", "7"), ("Content-Type", "none"), ("Connection", "Keep, X-A"), ("X-A", "1"), ("N", None)]),
        revisit(12, "http://a.org/x", 5, [("ETag", '"2"')]), revisit(13, "http://a.org/x", 7, [("ETag", '"1"')]),
        revisit(14, "http://a.org/x?a=1&b=2", 9, [("Last-Modified", "Tue")]), revisit(15, "http://a.org/x", 8, None),
        revisit(16, None, 8), revisit(17, "http://a.org/x", None), revisit(18, "http://b.org/", 8),
        revisit(19, "http://a.org/x", 8, [], "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"),
        revisit(20, "http://a.org/x", 8, [("ETag", '"2"'), ("Last-Modified", "Wed")]),
        revisit(None, "http://a.org/x", 8, None), revisit(15, "http://a.org/x", 8, None)]
    records = spark.createDataFrame(rows, RECORDS)
    for partitions in (1, 7):
        resolved = revisits.resolve_revisits(records, partitions)
        found = {r.record_id: r for r in resolved.collect()}
        assert {k: (r.status, r.base_id) for k, r in found.items()} == {
            10: ("no_base", None), 11: ("resolved", 1), 12: ("resolved", 2), 13: ("mismatch", 2), 14: ("resolved", 3),
            15: ("unverified", 2), 16: ("invalid", None), 17: ("invalid", None), 18: ("no_base", None),
            20: ("mismatch", 2), None: ("unverified", 2)}
        assert resolved.count() == 12
        assert [tuple(h) for h in found[11].headers] == [
            ("Content-Type", "text/html"), ("ETag", '"1"'), ("age", "7"), ("N", None)]
        bodies = {r.record_id: r.body for r in revisits.with_bodies(resolved, records).collect()}
        assert bodies[11] == "body 1" and bodies[15] == "body 2" and bodies[13] is None and bodies[16] is None
    assert revisits.resolve_revisits(records.limit(0)).count() == 0


def test_as_of_over_many_partitions(spark):
    r = random.Random(3)
    rows = []
    for i in range(600):
        url = "http://hot.org/" if r.random() < 0.6 else f"http://h{r.randint(0, 40)}.org/"
        rows.append(response(i, url, r.randint(0, 60)) if r.random() < 0.2 else revisit(i, url, r.randint(0, 60)))
    found = revisits.resolve_revisits(spark.createDataFrame(rows, RECORDS), 23).collect()
    for f in found:
        earlier = [(x[4], x[0]) for x in rows if x[1] == "response" and x[3] == f.target_uri and x[4] <= f.captured_at]
        assert f.base_id == (max(earlier)[1] if earlier else None)
    assert len(found) == sum(x[1] == "revisit" for x in rows)


LONG = "This is a sentence of the story, and it goes on for a while; then it ends. " * 3
PAGES = {
    "none": ("", ""), "blank": ("<html><body> &nbsp; </body></html>", ""), "plain": ("just &lt;text&gt; here", "just <text> here"),
    "open": (f"<p>{LONG}<p>Short &amp; sweet.<p>{LONG}", [LONG, "Short & sweet.", LONG]),
    "parts": (f"""<html><head><title>T</title><style>p{{}}</style></head><body class="has-sidebar">
        <header><h1>Site</h1><p>The slogan of the site, as ever.</p></header><nav><ul><li><a href=/>Home</a><li>More</ul></nav>
        <div id="cookie-notice"><p>{LONG}</p></div>
        <main><div class="content"><h2>Title</h2><p>{LONG}</p><div class="ad-slot">Buy now</div><p>Tiny.</p>
        <ul><li>One <b>bold</b>  item<li>Two <a href=x>linked words</a></ul><blockquote>Said so.</blockquote>
        <table><tr><td>c1<td>c2</table><form><label>Mail</label></form><script>var a = "<p>no</p>";</script>
        <p>a<br>b&#x41;\n c<span> d</span></p><aside>Related stories here</aside></div></main>
        <section class="comments"><h3>Comments</h3><p>{LONG}</p><article><p>{LONG}</p></article></section>
        <div class="sidebar"><p>{LONG}</p></div><footer>&copy; someone</footer></body></html>""",
              ["Title", LONG, "Tiny.", "One bold item", "Two linked words", "Said so.", "c1", "c2", "a bA c d"]),
    "divs": (f"""<body><div class=menu><a href=a>A link</a> <a href=b>Another link</a></div>
        <div><div class=post><h1>Head</h1><p>{LONG}</p><p>ok.</p><p>{LONG}</p></div>
        <div><a href=1>see this</a><a href=2>see that</a></div></div><div class="footer">Bye.</div></body>""",
             ["Head", LONG, "ok.", LONG]),
    "article_header": (f"""<article><header><h1>Head</h1><p>By someone</p></header><p>{LONG}</p><footer>tags</footer>
        <div class="comment-list"><p>{LONG}{LONG}</p></div></article>""", ["Head", LONG]),
    "hidden": (f"<div><p>{LONG}</p><p style='display: none'>no</p><p hidden>no</p><p aria-hidden=true>no</p></div>", [LONG]),
    "broken": (f"<article><p>{LONG}</b></i></div><p <b>x</p><!-- c --><p>{LONG}", None),
    "comment_open": (f"<article><p>{LONG}</p></article><!-- never closed", [LONG]),
}


def spelled(want):
    return want if isinstance(want, str) else "\n".join(re.sub(r"\s+", " ", w).strip() for w in want)


@pytest.mark.parametrize("name", sorted(PAGES))
def test_pages(name):
    html, want = PAGES[name]
    got = tagpaths.extract(html)
    if want is None:
        assert got.startswith(LONG.strip())
    else:
        assert got == spelled(want)


@pytest.mark.parametrize("html", [
    f"<meta charset=utf-8><title>T</title><article><h1>Head</h1><p>{LONG}</p></article>",
    f"<html><head><title>T</title><style>p{{}}</style><article><h1>Head</h1><p>{LONG}</p></article>",
    f"<head><noscript><img src=a></noscript><meta name=a><article><h1>Head</h1><p>{LONG}</p></article>",
    *[f"<body><div><{tag}>inner</div><article><h1>Head</h1><p>{LONG}</p></article>" for tag in (
        "button", "select", "object", "audio", "canvas", "noscript")],
    *[f"<body><{tag}><article><h1>Head</h1><p>{LONG}</p></article></body>" for tag in (
        "button", "select", "object", "audio", "canvas", "noscript")],
    f"<div><button><div>a</div>b</button><select><option>c</select></div><main><h1>Head</h1><p>{LONG}</p></main>",
    f"<body><form action=x><nav><a href=a>Home</a></nav><article><h1>Head</h1><p>{LONG}</p><p hidden>no</p></article></form>",
    f"<form><div role=main><h1>Head</h1><p>{LONG}<span hidden>no</span></p></div><div class=sidebar>{LONG[:40]}</div></form>",
    f"<div style='display:none'><article><h1>Head</h1><p>{LONG}</p></article></div>"])
def test_real_markup_loses_no_page(html):
    got = tagpaths.extract(html).split("\n")
    assert [x for x in got if x != "inner"] == spelled(["Head", LONG]).split("\n")


def test_unmarked_parts_of_an_article_are_judged_by_path():
    html = f"""<body><article><h1>Head</h1><p>{LONG}</p>
        <h2>Part</h2><p>{LONG}</p><ul><li>One thing<li>Another <a href=a>thing</a></ul><table><tr><td>c1<td>c2</table>
        <h3>Read also</h3><ul><li><a href=1>That story</a><li><a href=2>This story</a></ul>
        <section><div>Buy this now</div><div><a href=3>More of it</a></div></section><ul><li><a href=4>Old story</a></ul>
        <h2>End</h2><p>Tiny.</p></article></body>"""
    assert tagpaths.extract(html) == spelled(
        ["Head", LONG, "Part", LONG, "One thing", "Another thing", "c1", "c2", "End", "Tiny."])


def test_page_table(spark):
    rows = [(i, "u", html, "t") for i, (html, _) in enumerate(PAGES.values())] + [(None, None, None, None), (0, "u", "", "t")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = tagpaths.main_text(pages)
    assert got.columns == ["page_id", "url", "text"]
    assert sorted(((r.page_id, r.text) for r in got.collect()), key=str) == sorted(
        ((r[0], tagpaths.extract(r[2] or "")) for r in rows), key=str)
    assert tagpaths.main_text(pages.limit(0)).count() == 0


def test_given_pages(spark):
    """The pages of the smallest table: the article's heading and paragraphs, cut out by hand."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    import html as entities
    for row in pages.collect():
        inner = re.search(r"<article>(.*)</article>", row.html, re.S)[1]
        parts = [entities.unescape(re.sub(r"</?b>|<br>", " ", x)) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert tagpaths.extract(row.html) == spelled([x for x in parts if x.strip()])


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_separator_scan(spark, block, tmp_path):
    files = {"a": [5, 0, 7, 7, 7, 0, 0, 1], "b": [0], "c": [], "d": [3] * 20, "e": [1, 2, 0] * 5, "f": [9] * 11 + [0]}
    for name, ids in files.items():
        (tmp_path / f"{name}.bin").write_bytes(np.array(ids, "<u2").tobytes())
    want = []
    for name, ids in files.items():
        start = 0
        for k, i in enumerate(j for j, x in enumerate([*ids, 0]) if x == 0):
            if i < len(ids) or start < i:
                want.append((f"{name}.bin", k, start, i - start, i < len(ids)))
            start = i + 1
    got = separators.document_counts(spark, f"file://{tmp_path}", end=0, block_tokens=block)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_odd_file_is_an_error(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"123")
    with pytest.raises(Exception, match="whole number"):
        separators.document_counts(spark, f"file://{tmp_path}").collect()


def test_token_files(spark):
    texts = [None, "", "a b c", "<|endoftext|> inside", "w " * 3000, "a b c"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "z", "x"), (2, "a b c", "x")],
                                 "doc_id bigint, text string, file string").repartition(3)
    folder = scratch_path(spark, "test-tokens")
    written = separators.write_token_files(docs, folder)
    counted = written.join(separators.document_counts(spark, folder, block_tokens=500), ["file", "doc_index"]).collect()
    table = tokens.word_ids("word_bpe_49k.json", plain_specials=True)
    want = [(d.doc_id, len(tokens.text_ids(d.text or "", table)) // 4) for d in docs.collect()]
    assert sorted([(c.doc_id, c.n_tokens) for c in counted], key=str) == sorted(want, key=str)
    assert all(c.terminated for c in counted)
    empty = scratch_path(spark, "test-tokens")
    assert separators.write_token_files(docs.limit(0), empty).count() == 0


def brute_pairs(chosen, rejected):
    """(pair, part, segment, train_start, train_end) in order, per pair."""
    def key(row):
        return [(v is not None, v if v is not None else "") for v in row]

    out = []
    for pair in {r[0] for r in chosen + rejected}:
        c, j = (sorted((r[1:] for r in side if r[0] == pair), key=key) for side in (chosen, rejected))
        n = 0
        while n < min(len(c), len(j)) and c[n] == j[n]:
            n += 1
        for part, turns in (("prompt", c[:n]), ("chosen", c[n:]), ("rejected", j[n:])):
            for _, role, text in turns:
                head, said = f"<|im_start|>{role or 'user'}\n", (text or "") + "<|im_end|>"
                span = (len(head), len(head) + len(said)) if part != "prompt" and role == "assistant" else (0, 0)
                out.append((pair, part, head + said + "\n", *span))
    return sorted(out, key=str)


def test_preference_pairs(spark):
    r = random.Random(9)

    def side():
        return [(r.choice([1, 2, 3, None]), r.choice([0, 1, 2, None]), r.choice(["user", "assistant", None]),
                 r.choice(["hi", "yo 漢", "", None])) for _ in range(r.randint(0, 25))]

    schema = "pair_id bigint, turn bigint, role string, text string"
    cases = [(side(), side()) for _ in range(4)]
    turns = [(5, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(6)]
    cases += [(turns, turns), (turns, turns[:3]), (turns[:5], [*turns[:5], (5, 5, "assistant", "else")]), ([], turns),
              (turns + turns[:1], turns)]
    for c, j in cases:
        pairs = preferences.render_pairs(spark.createDataFrame(c, schema), spark.createDataFrame(j, schema))
        got = [(p.pair_id, p.part, p.segment, p.train_start, p.train_end) for p in pairs.collect()]
        assert sorted(got, key=str) == brute_pairs(c, j)
    pairs = preferences.render_pairs(spark.createDataFrame(turns, schema).withColumn("part", F.lit(1)),
                                     spark.createDataFrame([*turns[:5], (5, 5, "assistant", "else")], schema))
    row = preferences.assemble(pairs).first()
    assert row.prompt.count("<|im_start|>") == 5 and row.rejected == "<|im_start|>assistant\nelse<|im_end|>\n"
    start, end = row.rejected_spans[0]
    assert row.rejected[start:end] == "else<|im_end|>" and len(row.chosen_spans) == 1
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


BODY = "<p>A long sentence, with words in it, and some more of them. Another one follows here.</p>" * 4


def inside_article(part):
    page = (f"<html><body><nav><a href=x>home</a></nav><article><h1>Title</h1>{BODY}{part}"
            "<p>The end of it, with a last sentence here.</p></article></body></html>")
    return tagpaths.extract(page).split("\n")[5:-1]


@pytest.mark.parametrize("part", [
    '<p class="social-history">The social history of the town is long, and full.</p>',
    '<div class="widget-theory">The theory of widgets, in short, is sound.</div>',
    '<div class="dialog">She said, come in, and sat down.</div>',
    '<p>It says so <a href=x>there</a>, and in other places, too.</p>'])
def test_a_word_in_a_class_name_does_not_delete_sentences(part):
    assert len(inside_article(part)) == 1


@pytest.mark.parametrize("part", [
    '<p>Read also <a href=x>Ten ways of doing it, now</a></p>', '<div class="cookie-notice">We use cookies, and more.</div>',
    '<div class="social-share-2"><a>Share</a> <a>Tweet</a></div>', '<div class="related posts"><a>One more</a></div>',
    '<div class="promo-of-the-week">Only now</div>'])
def test_linked_and_marked_parts_of_an_article_are_left_out(part):
    assert inside_article(part) == []


@pytest.mark.parametrize("page", [
    "<div>" * 20_000 + "<p>A sentence, of text.</p>",
    "".join("<div><p>Words, and more words here.</p>" for _ in range(4000)),
    "<p>" + "<span>" * 20_000 + "A sentence, of text."])
def test_deep_pages_take_bounded_memory_and_time(page):
    started = time.process_time()
    tracemalloc.start()
    assert tagpaths.extract(page)
    assert tracemalloc.get_traced_memory()[1] < 50_000_000
    tracemalloc.stop()
    assert time.process_time() - started < 30


def test_ids_that_do_not_fit_are_an_error(spark):
    docs = spark.createDataFrame([(1, "hello there")], "doc_id bigint, text string")
    with pytest.raises(Exception, match="does not fit"):
        separators.write_token_files(docs, scratch_path(spark, "narrow"), end=7, dtype="|u1")
    with pytest.raises(ValueError, match="end id"):
        separators.write_token_files(docs, scratch_path(spark, "narrow"), end=70_000)
