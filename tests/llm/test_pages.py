"""Operators over pages: SQL, odd rows, and pages of many shapes."""

import hashlib
import html as entities
import re

import pytest

from cairn.llm import html, urls, warc

PAGE = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def odd_pages(spark):
    big = "<p>" + "x" * 1200 + "</p>"
    rows = [
        (1, "http://a.example.com/x", big),
        (5, "http://b.example.com/y?q=1", big),
        (3, None, big),
        (None, "http://c.example.com/", big),
        (7, "no scheme", "short"),
        (8, "http://H.Example.COM/en/z\r\nX: y", "short"),
        (9, "http://d.example.com/", None),
        (10, "http://d.example.com/", ""),
        (11, "", "WARC/1.1\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"),
        (11, "", "WARC/1.1\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"),
        (12, "http://é.example.com/ü", "é" * 700),
        (13, "http://f.example.com/", "é" * 700),
    ]
    return spark.createDataFrame(rows, PAGE)


def test_warc_of_odd_rows(spark, odd_pages):
    got = warc.round_trip(odd_pages).collect()
    want = []
    rows = [(r.page_id, (r.html or "").encode()) for r in odd_pages.collect()]
    for i, b in rows:
        same = [j for j, c in rows if c == b and j is not None]
        top = max(same) if same else None
        again = len(b) >= 1000 and top is not None and sum(c == b for _, c in rows) > 1 and (i is None or i < top)
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top if again else None))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=key) == sorted(want, key=key)
    for r in got:
        c = r.capture
        assert c.request.http_header.startswith("GET ") and b"page-url" in bytes(c.metadata.payload)
        assert (c.response.payload is None) == (r.record_type == "revisit")
        if r.record_type == "response":
            assert c.response.stated_digest == r.payload_digest == hashlib.sha1(bytes(c.response.payload)).hexdigest()


def test_warc_of_nothing(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGE)).count() == 0


def test_warc_that_is_cut():
    good = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    bodies = lambda data, n: [b for _, b in warc.parse_records(data[i : i + n] for i in range(0, len(data), n))]
    for n in (1, 7, 1000):
        assert bodies(good * 2, n) == [b"abc", b"abc"]
        for bad in (good[:-3], good[:20], b"x" + good, good.replace(b": 3", b": 2")):
            with pytest.raises(warc.BadArchive):
                bodies(bad, n)
    packed = b"".join(warc.member(good) for _ in range(5))
    for step in (1, 50, 1 << 20):
        assert b"".join(warc.inflate(packed, step)) == good * 5
    with pytest.raises(warc.BadArchive):
        b"".join(warc.inflate(packed[:-1]))


def test_members():
    """A gzip member a record, each readable by itself, always with a zero byte at its end."""
    import gzip

    for n in (0, 1, 255, 70_000, (1 << 24) - 1, 1 << 24, (1 << 24) + 9):
        assert warc.member(bytes(n))[-1] == 0 and gzip.decompress(warc.member(bytes(n))) == bytes(n)


def test_archives_are_rolled_by_bytes(spark, tmp_path, monkeypatch):
    """Large pages: several files, each of whole members, and a row of any size comes back."""
    import gzip
    import random

    rows = [(i, f"http://a.example.com/{i}", random.Random(i).randbytes(25_000_000).hex()) for i in range(3)]
    path = str(tmp_path / "w")
    pages = spark.createDataFrame(rows, PAGE).repartition(1)
    warc.write_archives(pages, path)
    files = [f for f in (tmp_path / "w").iterdir() if f.name.startswith("part-")]
    assert len(files) == 3 or len(files) == 2
    assert all(gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\nWARC-Type: ") for f in files)
    got = {r.payload_digest: r.payload_bytes for r in warc.read_records(spark, path, payloads=False).filter("kind = 'response'").collect()}
    assert got == {hashlib.sha1(h.encode()).hexdigest(): 50_000_000 for _, _, h in rows}


def test_distinct_payloads_are_spread(spark):
    """No task gets the pages that revisit nothing, whatever the planner does later."""
    rows = [(i, f"http://a.example.com/{i}", f"<p>{i}</p>" * 150) for i in range(600)] + [(1000 + i, "http://b.example.com/", "same " * 300) for i in range(300)]
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "20"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        out = warc.round_trip(spark.createDataFrame(rows, PAGE), payloads=False).selectExpr("spark_partition_id() p", "page_id", "record_type", "refers_to").cache()
        sizes = [r[1] for r in out.filter("record_type = 'response'").groupBy("p").count().collect()]
        assert sum(sizes) == 601 and max(sizes) < 150
        assert out.filter("refers_to = 1299").count() == 299
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_control_characters_in_urls(spark):
    rows = [(i, f"http://a.example.com/{chr(c)}x", "y") for i, c in enumerate([*range(1, 33), 127])]
    got = {r.page_id: r.capture.response.uri for r in warc.round_trip(spark.createDataFrame(rows, PAGE)).collect()}
    assert got == {i: f"http://a.example.com/%{c:02X}x" for i, c in enumerate([*range(1, 33), 127])}


def test_urls_of_odd_rows(spark, odd_pages):
    got = {r.page_id: r for r in urls.judge_urls(odd_pages, urls.rule_table(spark)).collect()}
    assert (got[3].host, got[3].path, got[3].rule, got[3].verdict) == ("", "", None, "allow")
    assert (got[7].host, got[7].path) == ("", "") and got[8].host == "h.example.com"
    assert got[8].rule == "example.com/en/" and got[8].verdict == "block"
    assert urls.judge_urls(spark.createDataFrame([], PAGE), urls.rule_table(spark)).count() == 0
    none = urls.judge_urls(odd_pages, urls.rule_table(spark).limit(0))
    assert none.count() == odd_pages.count() and none.filter("rule is not null").count() == 0


def test_nested_rules(spark):
    """Rules within rules, ends beside starts, many URLs to a sweep: as a plain search has it."""
    rules = [("com", "", "allow"), ("com", "/a", "block"), ("com", "/a/b", "allow"), ("com", "/a/b", "block"), ("com", "/a/bc", "allow"), ("x.com", "/", "block"), ("x.com", "/é", "allow"), ("y.x.com", "/a/", "allow"), ("org", "/zz", "block")]
    hosts = ["com", "x.com", "y.x.com", "z.y.x.com", "yx.com", "org", "a.org", "net", "", "com.", "x..com"]
    paths = ["", "/", "/a", "/a/", "/a/b", "/a/b/c", "/a/bc", "/a/bd", "/b", "/é", "/ê", "/zz", "/zzz", "/a\U0010ffff"]
    rows = [(i, f"http://{h}{p}", None) for i, (h, p) in enumerate((h, p) for h in hosts for p in paths)]
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r.page_id: r for r in urls.judge_urls(spark.createDataFrame(rows, PAGE), table, rows_per_sweep=7).collect()}
    for i, url, _ in rows:
        rest = url.split("://")[1]
        host = re.match("[^/]*", rest)[0]
        path = rest[len(host) :]
        fit = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fit)[3:] if fit else (None, "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, *want), url


def test_a_hot_suffix_is_swept_in_parts(spark, monkeypatch):
    """However a join has dealt them, the URLs below one suffix are in many tasks."""
    rows = [(i, f"http://h{i}.com/{i % 50}", None) for i in range(4_000)]
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        plans, write = [], urls.durable
        monkeypatch.setattr(urls, "durable", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, label))
        out = urls.judge_urls(spark.createDataFrame(rows, PAGE), urls.rule_table(spark), rows_per_sweep=100)
        assert any("hashpartitioning(_part" in p for p in plans) and out.filter("rule = 'com/' and verdict = 'allow'").count() == 4_000
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_main_text(spark, data, duck):
    pages = dict(duck.sql("SELECT page_id, html FROM pages").fetchall())
    for r in html.op8_main_text(spark, data).collect():
        inside = re.search("<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split("</?(?:p|h1|br)>", inside)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


SHAPES = {
    "div": ('<body><div class="top-nav"><a href="/">Home</a></div><div id="main"><div class="story-7"><h2>Head</h2><p>{}</p><p>{}</p></div><div class="side bar sidebar"><p>{}</p></div></div><div class="cookie-banner">We use cookies</div></body>', "Head\n{}\n{}"),
    "unclosed": ("<body><nav><ul><li><a href=x>One<li><a href=y>Two</ul></nav><main><h1>Head</h1><p>{}<p>{}<form><p>{}</form></main><footer>End", "Head\n{}\n{}"),
    "comments": ('<article><header>By a person</header><p>{}</p><script>var a = "<p>no</p>";</script><!-- <p>no</p> --><p>{}</p><section class="comments"><p>{}</p></section></article>', "{}\n{}"),
    "inline": ("<body><div><p>{} <b>bold</b><i>italic</i> &amp;&nbsp;&lt;x&gt;</p><aside>{}</aside><p>{}</p></div></body>", "{} bolditalic & <x>\n{1}"),
}


@pytest.mark.parametrize(("token", "is_unwanted"), [("comment-list", True), ("topNav", True), ("ad", True), ("post-comments", True), ("cookieBanner x", True), ("content has-sidebar", False), ("overflow-hidden", False), ("adult-education", False), ("no-comments", False), ("entry-content", False)])
def test_unwanted(token, is_unwanted):
    assert html.unwanted(token) == is_unwanted


@pytest.mark.parametrize("name", SHAPES)
def test_shapes(name):
    text = [f"This is the {w} sentence of the article, long enough to be told from a menu, and it goes on." for w in ("first", "second", "third")]
    page, want = SHAPES[name]
    if name == "inline":
        want = f"{text[0]} bolditalic & <x>\n{text[2]}"
    else:
        want = want.format(*text)
    assert html.Page(page.format(*text)).main_text(None) == want


def test_host_consensus(spark):
    """A page whose own best container is a long list of teasers goes by its host's path."""
    long = "Running text with commas, and more of it, to fill the article with something to read. " * 6
    page = lambda body, extra="": f'<html><body><div class="teasers">{extra}</div><div class="text-{len(body)}"><p>{body}</p></div></body></html>'
    rows = [(i, f"http://one.example.com/{i}", page(f"{i} {long}")) for i in range(6)]
    rows.append((6, "http://one.example.com/6", page(long[:200], "<p>" + long[:300] + "</p>")))
    got = {r.page_id: r.text for r in html.main_texts(spark.createDataFrame(rows, PAGE)).collect()}
    assert got[6] == " ".join(long[:200].split()) and got[0].startswith("0 Running")


def test_all_at_the_host_path(spark):
    """A page in several containers at the host's path, and one with more beside it, are whole."""
    long = "Running text with commas, and more of it, to fill a chapter with something to read. " * 4
    chapter = lambda i: f'<section class="chapter"><p>{i} {long}</p></section>'
    page = lambda body: f'<html><body><div class="story">{body}</div></body></html>'
    bodies = [*[chapter(i) for i in range(5)], "".join(chapter(i) for i in range(3)), chapter(0) + f'<div class="rest"><p>rest {long}</p></div>']
    rows = [(i, f"http://book.example.com/{i}", page(b)) for i, b in enumerate(bodies)]
    got = {r.page_id: r.text for r in html.main_texts(spark.createDataFrame(rows, PAGE)).collect()}
    assert got[4] == f"4 {long}".strip()
    assert got[5] == "\n".join(f"{i} {long}".strip() for i in range(3))
    assert got[6] == f"0 {long}".strip() + "\n" + f"rest {long}".strip()


LONG = "Running text with commas, and more of it, to fill an article with something to read."
SPLIT = {
    "title and lead": ("<body><div class=story><h1>Title</h1><div class=lead><p>{0}</p></div><div class=body><p>{1}</p><p>{2}</p><p>{3}</p><p>{4}</p></div></div></body>", "Title\n{0}\n{1}\n{2}\n{3}\n{4}"),
    "two articles": ("<body><article><p>{0}</p><p>{1}</p></article><article><p>{2}</p></article></body>", "{0}\n{1}\n{2}"),
    "article and section": ("<body><article><p>{0}</p></article><section><p>{1}</p></section></body>", "{0}\n{1}"),
    "linked title": ("<body><div><a href=/>Home</a> <a href=/x>Topics</a></div><div class=post><h2><a href=x>Title</a></h2><div class=entry><p>{0}</p></div></div></body>", "Title\n{0}"),
    "links only": ("<body><div><a href=/>Home</a></div><div><a href=/x>Topics</a></div></body>", "Home\nTopics"),
}


@pytest.mark.parametrize("name", SPLIT)
def test_split_articles(name):
    page, want = SPLIT[name]
    text = [f"{i} {LONG}" for i in range(5)]
    assert html.Page(page.format(*text)).main_text(None) == want.format(*text)


def test_paths_have_all_class_words():
    """Containers whose first four class words agree don't share a path."""
    page = html.Page('<body><div class="a b c d story"><p>x</p></div><div class="a b c d tiles"><p>y</p></div></body>')
    assert [page.path(c) for c in (2, 3)] == ["/body/div.a.b.c.d.story", "/body/div.a.b.c.d.tiles"]
    assert page.keys[2] == html._path_key("/body/div.a.b.c.d.story") != page.keys[3]


def test_main_text_of_odd_pages(spark, odd_pages):
    got = html.main_texts(odd_pages).collect()
    assert len(got) == odd_pages.count() and html.main_texts(spark.createDataFrame([], PAGE)).count() == 0
    assert {r.text for r in got if r.page_id in (9, 10)} == {""}
    for bad in ("<", "<p", "</", "<!--", "<a href='", "&#xFFFFFFFF;", "<svg><p>x", "</p></div>", "<p><p><p>" * 50, "<div>" * 500 + "deep"):
        html.Page(bad).main_text(None)


ARTICLE = "<article><p>" + "Some words of the article, which go on and on. " * 7 + "</p></article>"
INSIDE = ("Some words of the article, which go on and on. " * 7).strip()
BADLY_CLOSED = {
    "head left open": f"<html><head><title>x</title><meta charset=utf-8><body>{ARTICLE}",
    "text after a head left open": f"<head><title>x</title>{INSIDE}",
    "page in a form": f"<body><form id=page action=/><input name=state>{ARTICLE}<select><option>one<option>two</select></form></body>",
    "page in two forms": f"<body><form><fieldset><p>{INSIDE}</p></fieldset><fieldset><p>Name and address, please.</p></fieldset></form></body>",
    "label left open": f"<body><label>Your name <p>{INSIDE}</p></body>",
    "button with a block": f"<body><button><div>Menu</div></button>{ARTICLE}",
    "menu left open": f"<body><nav><ul><li>One<li>Two</ul>{ARTICLE}<footer>The end",
    "advert left open": f"<body><div class=ad>Buy this<div class=story><p>{INSIDE}</p></div></body>",
    "main in an overlay": f"<body><div class=menu-overlay>Menu<main><p>{INSIDE}</p></main>More</div>",
    "search form": f"<body>{ARTICLE}<form><h1>Search</h1><p>Search these pages.</p></form>",
    "long paragraph beside lists": "<body><div class=texts><p>" + INSIDE + "</p></div>" + "".join(f"<div class=x><a href=/{i}>A link of some length, {i}</a></div>" for i in range(40)) + "</body>",
}


@pytest.mark.parametrize("name", BADLY_CLOSED)
def test_badly_closed(name):
    assert html.Page(BADLY_CLOSED[name]).main_text(None) == INSIDE


DEEP = ["<div>" * 60_000, "<b>" * 20_000 + "</i>" * 20_000, "<b>" * 20_000 + "<h1>x</h1>" * 10_000, "<label>" * 40_000, "<nav>" * 30_000 + "<p>" * 30_000, "<form>" * 40_000 + "x", "<div class=ad>" * 20_000 + "x", "<p><div>x" * 30_000, "<a b='" * 40_000, "<li><ul>" * 30_000, "&amp" * 60_000]


@pytest.mark.parametrize("i", range(len(DEEP)))
def test_deep_pages(i):
    """300 KB of odd markup in a second or so and 100 MB: both in proportion to the page."""
    import time
    import tracemalloc

    def read(source):
        page = html.Page(source)
        return html.Page.unpacked(page.packed()).main_text(page.path(page.best()))

    began = time.perf_counter()
    assert len(read(DEEP[i])) <= len(DEEP[i])
    assert time.perf_counter() - began < 5
    third = DEEP[i][: len(DEEP[i]) // 3]
    tracemalloc.start()
    read(third)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 33 << 20


def test_a_long_block_keeps_its_weight():
    """One block of 40,000 characters outweighs many of teasers: no score is capped."""
    long = "A sentence of the article and more of it. " * 1000
    teasers = "".join(f"<div class=box><p>{i} Another text, with some words, and commas, to be read, elsewhere.</p></div>" for i in range(80))
    page = html.Page(f"<body><div class=wrap>{teasers}</div><div class=text><p>{long}</p></div></body>")
    assert page.path(page.best()).endswith("div.text")


def test_pages_without_article(spark):
    """Hosts with templates of their own, none with an article element: by construction."""
    import random

    rng = random.Random(11)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(20, 60))) + ", and so on."
    links = lambda n: "".join(f'<li><a href="/{i}">{text()[:20]}</a>' for i in range(n))
    templates = [
        lambda body: f"<html><head><title>t</title><body><div id=menu><ul>{links(5)}</ul></div><div class='col wide'>{body}</div><div class=sidebar><p>{text()}</p></div><div id=footer>x</div>",
        lambda body: f"<body><form action=/><table><tr><td class=left><ul>{links(6)}</ul><td class=text-12>{body}</table></form></body>",
        lambda body: f"<body><header><h1>Site</h1></header><section class=entry>{body}<div class=comments><p>{text()}</p></div></section><div class='share buttons'>Share</div></body>",
    ]
    rows, want = [], {}
    for i in range(90):
        parts = [text() for _ in range(rng.randint(1, 6))]
        body = "<h2>Head</h2>" + "".join(f"<p>{p}" if i % 2 else f"<p>{p}</p>" for p in parts)
        rows.append((i, f"http://h{i % 3}.example.com/{i}", templates[i % 3](body)))
        want[i] = "\n".join(["Head", *[" ".join(p.split()) for p in parts]])
    got = {r.page_id: r.text for r in html.main_texts(spark.createDataFrame(rows, PAGE)).collect()}
    assert got == want


def test_many_hosts_are_spread(spark):
    """Where hosts' paths aren't broadcast, a host's pages meet its path in many parts."""
    rows = [(i, "http://one.example.com/", f"<body><div><p>{INSIDE} {i}</p></div></body>") for i in range(300)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = html.main_texts(spark.createDataFrame(rows, PAGE)).selectExpr("spark_partition_id() p", "text")
        assert out.filter("text <> ''").count() == 300 and out.select("p").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
