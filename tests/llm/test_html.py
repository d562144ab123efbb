import html as references
import re

import pyarrow.dataset as ds
from conftest import SF_SMALL

from surgewatch.llm import html, queries

PAGES = "page_id bigint, url string, html string"


def plain(source):
    """Main text of the test tables' pages: what stands in <article>, cut at block tags."""
    inside = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    inside = re.sub(r"<!--.*?-->", "", inside, flags=re.S)
    parts = re.split(r"</?(?:p|h1|div|ul|li)\b[^>]*>", inside)
    blocks = (" ".join(references.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", p)).split()) for p in parts)
    return "\n".join(b for b in blocks if b)


def texts(df):
    return {r.page_id: r.text for r in df.collect()}


def test_whole_table(spark):
    t = ds.dataset(f"{SF_SMALL}/pages.parquet").to_table().to_pylist()
    rows = queries.op5_html_text(spark, SF_SMALL).collect()
    assert {r.page_id: (r.url, r.text) for r in rows} == {r["page_id"]: (r["url"], plain(r["html"])) for r in t}
    assert all(r.n_chars == len(r.text) for r in rows) and len(rows) == len(t)


def one(source):
    return [t for t, _, _ in html.parse(source).blocks]


def test_markup():
    assert one("<p>a &amp; b&nbsp;c &#233;&eacute;<p>d<br>e <b>f</b>g") == ["a & b c éé", "d e fg"]
    assert one("x<!-- <p>no</p> -->y<script>var a='</p>';</script><style>p{}</style><div>z</div>") == ["xy", "z"]
    assert one("<header>H</header><nav>N</nav><div class='side-bar x'>keep</div><div id=sidebar>S</div><aside>A</aside><p>t</p><footer>F</footer>") == ["keep", "t"]
    assert one("<div>out</div><article><header><h1>T</h1></header><p>one</p><section class='comments'><p>C</p></section></article><div>out</div>") == ["T", "one"]
    assert one("<article></article><p>body") == ["body"]
    assert one("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>") == ["a", "b", "c", "d", "e"]
    assert one("<p title='a > b'>q</p><form><input value=1>no</form><p hidden>h</p><p style='display: none'>h</p><div role=navigation>n</div>") == ["q"]
    assert one("1 < 2 <b>and</b> <3 <p") == ["1 < 2 and <3 <p"]
    assert one("<article>a</article><article class='comment'>no</article><article>b</article>") == ["a", "b"]
    assert one("") == [] and one("<html><head><title>t</title></head><body></body></html>") == []
    assert one("<p>" * 3000 + "deep" + "<div>" * 3000 + "x") == ["deep", "x"]


def test_templates_of_a_host_go(spark):
    rows = []
    for i in range(40):
        share = "<div><span>Like this page</span> <i>now</i></div>"
        rows.append((i, f"https://big.example.com/p/{i}?x=1", f"<body><p>about us</p><p>story {i}</p>{share}{'<p>common line</p>' if i % 3 == 0 else ''}</body>"))
    rows += [(100 + i, "http://small.example.com/", "<p>about us</p>") for i in range(5)]
    rows += [(200, None, None), (201, "", ""), (202, "//BIG.example.com:80/z", "<p>about us</p><p>  late   story </p>"), (None, "nonsense", "<p>null id</p>")]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as host", "2 as blocks").repartition(3)
    got = texts(html.main_text(df))
    for i in range(40):
        assert got[i] == f"story {i}" + ("\ncommon line" if i % 3 == 0 else "")
    assert got[100] == "about us" and got[200] == "" and got[201] == "" and got[202] == "late story" and got[None] == "null id"
    shuffled = texts(html.main_text(df, max_broadcast_hosts=0))
    assert shuffled == got
    assert html.main_text(df.limit(0)).count() == 0


def test_very_long_page_and_repeated_rows(spark):
    long = "<article>" + "".join(f"<p>paragraph {i} &lt;</p>" for i in range(30_000)) + "</article>"
    df = spark.createDataFrame([(1, "http://a.example/", long)] * 2, PAGES)
    rows = html.main_text(df).collect()
    assert len(rows) == 2 and {r.text for r in rows} == {"\n".join(f"paragraph {i} <" for i in range(30_000))}


def test_recurring_inline_label_before_unique_text(spark):
    rows = [(i, f"https://label.example.com/{i}", f"<body><p><b>Summary:</b> unique article text {i}</p><p><a>By us</a> on day {i}</p>"
             f"<a>Home</a> |&nbsp;<a>About</a><p>x{i}</p></body>") for i in range(40)]
    got = texts(html.main_text(spark.createDataFrame(rows, PAGES)))
    assert got == {i: f"Summary: unique article text {i}\nBy us on day {i}\nx{i}" for i in range(40)}


def test_copies_of_one_page_do_not_vote(spark):
    article = "<nav>N</nav><p>about us</p><article><h1>Title</h1><p>first</p><p>second</p></article>"
    rows = [(i, f"https://copy.example.com/a?utm={i}", article) for i in range(30)]
    rows += [(100 + i, f"https://copy.example.com/{i}", f"<p>about us</p><p>other {i}</p>") for i in range(9)]
    got = texts(html.main_text(spark.createDataFrame(rows, PAGES).repartition(4)))
    assert got == {i: "Title\nfirst\nsecond" for i in range(30)} | {100 + i: f"about us\nother {i}" for i in range(9)}


def test_attributes_are_scanned_as_values():
    assert one("<p><a href=it's>one</a></p><p>two</p><p>it's three</p>") == ["one", "two", "it's three"]
    assert one('<p title="abc>Hello</p><p>there</p>') == ["Hello", "there"]
    assert one("<p title='a > b' data-x=\"c's > d\" hidden-not = 5/6 >q</p><p =odd / >r</p><p a='x'b=y>s</p>") == ["q", "r", "s"]
    assert one("<p " + "a=b " * 20_000 + "x") == ["<p " + "a=b " * 20_000 + "x"]


def test_class_words_inside_and_outside_articles():
    inside = "<article><section id='related-work'><p>cited</p></section><div class='share-price-table'>7.5</div><p class='alert note'>careful</p>{}</article>"
    assert one(inside.format("<div class='comments'>C</div><div class='box ad'>A</div><ul class='share'><li>S</ul>")) == ["cited", "7.5", "careful"]
    assert one("<div class='share-price-table'>7.5</div><section id=related-work>cited</section><div class='cookie-banner'>C</div>"
               "<div id='site_footer'>F</div><div class='sponsored box'>S</div>") == ["7.5", "cited"]


def test_deeply_nested_text_is_linear():
    page = html.parse("<div>t" * 3000)
    assert len(page.blocks) == 3000 and len(page.keys()) == len(page.parents()) <= 3001
    assert html.kept_texts({"blocks": [{"text": t, "at": at, "pieces": [{"at": a, "sign": s} for a, s in p]} for t, at, p in page.blocks],
                            "keys": page.keys(), "parents": page.parents()}, {page.keys()[2000]}) == ["t"] * 1999


def subtree_counts(pages):
    """host -> subtree -> distinct pages, from the parsed pages alone."""
    seen = {}
    for host, source in pages:
        page = html.parse(source)
        signs = {s for _, _, pieces in page.blocks for _, s in pieces if s is not None}
        seen.setdefault(host, {}).setdefault(tuple(t for t, _, _ in page.blocks), {k for k in page.keys() if k is not None} | signs)
    counts = {}
    for host, contents in seen.items():
        for keys in contents.values():
            for k in keys:
                counts.setdefault(host, {}).setdefault(k, 0)
                counts[host][k] += 1
    return counts, {h: len(c) for h, c in seen.items()}


def test_templates_equal_a_plain_count(spark):
    menu = "<nav><a>Home</a> | <a>News</a></nav><div class='ad'>buy</div>"
    rows = [(i, f"http://h{i % 3}.example/{i}", f"<body>{menu}<p>line {i % 7}</p><div><i>made by us</i></div><p>own {i // 2}</p>{'<p>often</p>' * (i % 5 > 0)}</body>")
            for i in range(90)]
    counts, pages = subtree_counts([(f"h{i % 3}.example", h) for i, _, h in rows])
    for share, least in ((0.75, 10), (0.1, 2), (1.0, 1)):
        want = {h: sorted(k for k, n in c.items() if n >= least and n >= share * pages[h]) for h, c in counts.items()}
        got = html.templates(html.parsed(spark.createDataFrame(rows, PAGES).repartition(4)), share, least).collect()
        assert {r.host: sorted(r.subtrees) for r in got} == want
    n = html.removals(spark.createDataFrame(rows, PAGES)).first()
    # the menu and the advert are template too; "made by us" and "often" are template only
    assert (n.pages, n.ruled_blocks, n.ruled_and_template) == (90, 180, 180)
    assert n.template_blocks == 90 + sum(i % 5 > 0 for i in range(90)) and n.blocks == 3 * 90 + sum(i % 5 > 0 for i in range(90))
