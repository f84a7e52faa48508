"""WARC, HTML and URL operators."""

import base64
import hashlib
import random
import time
import tracemalloc
import zlib

import pytest

from veridoc.llm import html, urls, warc

PAGES = "page_id long, url string, html string, id int, `first` string, text string"


def frame(spark, rows):
    return spark.createDataFrame([(a, b, c, 1, "f", "t") for a, b, c in rows], PAGES)


ROWS = [(3, "http://a/x", "same ünï"), (1, "http://a/\r\ny z", "same ünï"), (2, None, None), (5, "u", ""), (4, "http://b", "other"), (1, "http://dup", "same ünï"), (None, "n", "same ünï"), (None, "m", "alone"), (7, "http://big", "z" * 300_000)]


def test_warc_round_trip(spark):
    got = warc.round_trip(frame(spark, ROWS)).collect()
    want = []
    first = {}
    for i, _, h in ROWS:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    for i, u, h in ROWS:
        data = (h or "").encode()
        to = first.get(h or "")
        revisit = to is not None and to != i
        uri = None if u is None else u.replace("\r", "%0D").replace("\n", "%0A").replace(" ", "%20")
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", to if revisit else None, uri))
    assert sorted(map(str, [tuple(r) for r in got])) == sorted(map(str, want))
    assert warc.round_trip(frame(spark, ROWS).limit(0)).count() == 0
    kept = warc.round_trip(frame(spark, ROWS), least=9).collect()
    assert {r.page_id: r.record_type for r in kept}[5] == "response"


def test_warc_normaliser(tmp_path):
    recs = [warc.record(i, f"http://x/{i}", bytes([i]) * i * 1000, "D", None, False) for i in range(30)]
    source = tmp_path / "a.warc.gz"
    half = zlib.compressobj(6, zlib.DEFLATED, 31)
    two = half.compress(b"".join(recs[:17])) + half.flush()
    rest = zlib.compressobj(6, zlib.DEFLATED, 31)
    source.write_bytes(two + rest.compress(b"".join(recs[17:])) + rest.flush())
    assert warc.normalise(str(source), str(tmp_path / "b.warc.gz")) == 30
    index = [tuple(map(int, x.split())) for x in (tmp_path / "b.warc.gz.idx").read_text().splitlines()]
    with open(tmp_path / "b.warc.gz", "rb") as f:
        for i in (29, 0, 13):
            head, http, payload = warc.read_member(f, *index[i])
            assert warc.page_id_of(head[b"warc-record-id"].decode()) == i and payload == bytes([i]) * i * 1000
    assert zlib.decompress((tmp_path / "b.warc.gz").read_bytes()[: index[0][1]], 31) == recs[0]
    (tmp_path / "bad.warc.gz").write_bytes(zlib.compress(recs[5][:-900], wbits=31))
    with pytest.raises(ValueError):
        warc.normalise(str(tmp_path / "bad.warc.gz"), str(tmp_path / "c.warc.gz"))


def test_record_ids():
    for i in (0, 1, -1, 2**63 - 1, -(2**63), None):
        assert warc.page_id_of(warc.record_id(i)) == i


ARTICLE = (
    "<!doctype html><head><title>T</title><style>p{}</style></head><body class=has-sidebar><header><h1>Site</h1></header><nav><a href=/>Home</a></nav>"
    "<div class='cookie-notice'><p>We use cookies on this site</p></div><div id=sidebar><p>Latest news in the side bar</p></div>"
    "<article><header><h1>The &amp; title</h1></header><p>First <b>bo</b>ld&nbsp;para.<p>Second\n  para<br>line <script>x('</p>')</script>&lt;tag&gt;"
    "<ul><li>one<li>two</ul><!-- no --><div class=advert>Buy</div><form><input>Go</form><section class=comments><p>lol</section></article><footer>&copy; x</footer>"
)
TEXT = "The & title First bold para. Second para line <tag> one two"


def test_html_text():
    assert html.Page(ARTICLE).text(None) == TEXT
    assert html.Page(ARTICLE + "<p unfinished='").text(None) == TEXT
    for source, text in (("", ""), ("<p>hi", "hi"), ("plain &amp; text", "plain & text"), ("<nav>only</nav>", ""), ("a < b", "a < b"), ("<div><p>x<!-- y", "x"), ("<table><tr><td>a<td>b</table>", "a b"), ("<body><p>x</body", "x")):
        assert html.Page(source).text(None) == text, source


def test_consensus(spark):
    """A page whose own best container is wrong follows its host's vote."""
    good = "<body><div class='post-1'><p>{0} long enough text of the article</p></div><div class=extra><p>x</p></div></body>"
    odd = "<body><div class='post-9'><p>short</p></div><div class=extra><p>much longer text that is not the article, on and on and on</p></div></body>"
    rows = [(i, "https://H.org/a", good.format(i)) for i in range(5)] + [(5, "https://h.org/b", odd), (6, "https://z.org/", odd), (7, None, None), (8, "https://h.org/c", "")]
    got = {r.page_id: r.text for r in html.extract(frame(spark, rows)).collect()}
    assert got[5] == "short" and got[6].startswith("much longer") and got[0] == "0 long enough text of the article" and got[7] == got[8] == ""
    assert html.extract(frame(spark, rows).limit(0)).count() == 0


def test_split_article(spark):
    """An article in containers of different classes keeps all of them."""
    lead, body, more = "lead " * 60, "body " * 100, "more " * 40
    beside = "<div class=sidebar><p>" + "junk " * 90 + "</p></div>"
    two = f"<body><div class=content><div class=lead><p>{lead}</p></div><div class=body><p>{body}</p></div></div>{beside}</body>"
    deep = f"<body><div class=content><div class=lead>{lead}</div><div class=wrap><div class=body>{body}</div></div><section>{more}</section></div>{beside}</body>"
    alike = f"<body><div class=wrap><div class=part>{lead}</div><div class=part>{body}</div></div><div class=end>end</div>{beside}</body>"
    links = f"<body><div class=body>{body}</div><div class=list><a href=/>{more}</a></div></body>"
    want = {1: lead + body, 2: lead + body + more, 3: lead + body, 4: body}
    for i, source in enumerate((two, deep, alike, links), 1):
        assert html.Page(source).text(None).split() == want[i].split(), i
    rows = [(i, "https://two.org/a", two) for i in (1, 11, 12)] + [(2, "https://deep.org/", deep), (3, "https://alike.org/", alike), (4, "https://links.org/", links)]
    got = {r.page_id: r.text.split() for r in html.extract(frame(spark, rows)).collect()}
    assert all(got[i] == want[i].split() for i in want) and got[11] == got[12] == got[1]


def drawn_page(rng):
    """A page drawn as a tree, and the text that its article holds: what is
    written and what is wanted come from the same tree, not from a parser."""
    words = lambda n: " ".join(rng.choice(["one", "two &amp; half", "thr&eacute;e", "fo  ur", "five\n", "漢字", "a &lt; b"]) for _ in range(n))
    plain = lambda t: " ".join(t.replace("&amp;", "&").replace("&eacute;", "é").replace("&lt;", "<").split())
    inline = lambda t: rng.choice(["{}", "<b>{}</b>", "<em class=x>{}</em>", "<a href='/q?a=1&b=2'>{}</a>", "<span>{}</span>"]).format(t)
    junk = lambda: rng.choice(
        ["<nav><ul><li>menu<li>more</ul></nav>", "<script>if (a < b) document.write('<p>no</p>')</script>", "<style>p > a {}</style>", "<aside><p>beside it</p></aside>", "<div class='ad-box'>buy <p>this</p></div>",
         "<form><p>name <input name=x> <button>send</button></form>", "<!-- no <p>text</p> -->", "<div role=banner>top</div>", "<ul class=comments><li>said one<li>said two</ul>", "<div id=cookie-notice>we use cookies</div>"]
    )

    def block(depth):
        kind = rng.randrange(6) if depth < 4 else 0
        if kind < 2:
            t, u = words(rng.randrange(1, 9)), words(3)
            name = rng.choice(["p", "h2", "blockquote", "pre"])
            return f"<{name}>{inline(t)} {u}</{name}>", plain(t + " " + u)
        if kind == 2:
            items = [words(3) for _ in range(rng.randrange(1, 4))]
            return "<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>", plain(" ".join(items))
        if kind == 3:
            cells = [[words(2) for _ in range(2)] for _ in range(2)]
            return "<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in r) for r in cells) + "</table>", plain(" ".join(c for r in cells for c in r))
        if kind == 4:
            return junk(), ""
        inner = [block(depth + 1) for _ in range(rng.randrange(1, 4))]
        return f"<div class='{rng.choice(['part', 'col-2 text', 'row'])}'>" + "".join(a for a, _ in inner) + "</div>", " ".join(b for _, b in inner if b)

    blocks = [block(0) for _ in range(rng.randrange(3, 9))] + [("<p>The article's own last line of text.</p>", "The article's own last line of text.")]
    around = [junk() for _ in range(6)]
    source = f"<!doctype html><html><head><title>t</title></head><body>{''.join(around[:3])}<article class='post-{rng.randrange(99)}'>" + "".join(a for a, _ in blocks) + f"</article>{''.join(around[3:])}<footer>end</footer></body></html>"
    return source, " ".join(b for _, b in blocks if b)


def test_html_brute_force(spark):
    rng = random.Random(31)
    drawn = [drawn_page(rng) for _ in range(300)]
    rows = [(i, f"https://h{i % 7}.org/{i}", s) for i, (s, _) in enumerate(drawn)]
    rows += [(300, "https://h0.org/", drawn[0][0])] * 2 + [(None, "https://h0.org/", drawn[1][0]), (301, None, None)]
    want = [t for _, t in drawn] + [drawn[0][1]] * 2 + [drawn[1][1], ""]
    df = frame(spark, rows).selectExpr("*", "1 AS host", "2 AS path", "3 AS __of")
    got = [(r.page_id, r.url, r.text, r.n_chars) for r in html.extract(df).collect()]
    assert sorted(got, key=str) == sorted(((i, u, t, len(t)) for (i, u, _), t in zip(rows, want, strict=True)), key=str)


@pytest.mark.parametrize(
    "source,text",
    [
        ("<a " * 350_000, ""), ("<div>x" * 100_000, "x " * 100_000), ("<div class='a b'>" * 100_000 + "<p>text", "text"), ("<ul>" + "<div>" * 50_000 + "<li>y</li>" * 50_000, "y " * 50_000),
        ("<p a=\"<a b='" * 100_000, ""), ("<p " + "n" * 1_000_000 + ">t", "t"), ("<script>" + "</script " * 100_000, ""), ("<p " + " " * 1_000_000 + ">t", "t"), ("<!--" * 200_000, ""), ("<p class='" + "c " * 400_000 + "'>t</p>", "t"),
    ],
)
def test_long_markup(source, text):
    """A megabyte of hostile markup takes seconds and no memory to speak of."""
    tracemalloc.start()
    start = time.process_time()
    page = html.Page(source)
    found = page.text(page.best()[0])
    spent, peak = time.process_time() - start, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == text.strip() and spent < 30 and peak < 200_000_000


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    stop = min([path.index(c) for c in "?#" if c in path], default=len(path))
    return "".join(c.lower() if c.isascii() else c for c in rest[:end]), path[:stop]


def brute_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_rules(spark, monkeypatch):
    given = ["http://a.net/x", "http://net", "http://NET/", "https://x.Example.net/en/1", "https://example.net/en", "http://badexample.com/de/1", "http://example.com/de/?q", "http://example.com?/de/", "x://a.org/fr/#z", "no scheme", None, "", "://", "http://É.org/fr/é", "a://b.net/c://d", "http://h\nx.net/p\nq"]
    rows = [(i, u, None) for i, u in enumerate(given)]
    for inline in (urls.INLINE_RULES, 0):
        monkeypatch.setattr(urls, "INLINE_RULES", inline)
        got = {r.page_id: r for r in urls.judge(frame(spark, rows), RULES).collect()}
        for i, u in enumerate(given):
            host, path = brute_parts(u)
            rule, verdict = brute_rule(host, path)
            assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict or "allow"), u
    assert urls.judge(frame(spark, rows).limit(0), RULES).count() == 0


def test_long_heads(spark):
    """Tags that never end, or with an attribute over and over."""
    rows = [(1, "http://a.com/", "<link " * 200_000), (2, "http://b.com/", "<link " + "rel= " * 200_000 + ">"), (3, "http://c.com/", "<meta http-equiv " * 50_000 + "<link rel=canonical href='http://d.net/'>")]
    start = time.time()
    got = {r.page_id: r.verdict for r in urls.judge(frame(spark, rows), RULES).collect()}
    assert got == {1: "allow", 2: "allow", 3: "block"} and time.time() - start < 60


def test_aliases(spark):
    link = '<html><head><LINK href="{}" rel="canonical"></head>'
    rows = [
        (1, "https://a.com/x#t", link.format("//B.net/p")),  # alias of a blocked page
        (2, "http://c.com/1", "<meta http-equiv=refresh content=\"0;url='/2'\">"),
        (3, "http://c.com/2", link.format("http://d.net/")),  # blocked over two steps
        (4, "http://c.com/1", None),
        (5, "http://e.com/", link.format("http://f.net/q")),
        (6, "http://e.com/z", link.format("http://e.com/")),
        (7, "http://e.com/y", link.format("http://example.net/en/ok")),
        (8, "http://e.com/", link.format("/y")),  # its component has an allowed page
        (9, "http://f.net/q", None),  # a rule stays a rule
        (10, "http://lonely.com/", None),
    ]
    got = {r.page_id: r.verdict for r in urls.judge(frame(spark, rows), RULES).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "block", 10: "allow"}
    extra = spark.createDataFrame([("http://lonely.com/", "http://g.net/")], "a string, b string")
    assert {r.page_id: r.verdict for r in urls.judge(frame(spark, rows), RULES, extra).collect()}[10] == "block"
