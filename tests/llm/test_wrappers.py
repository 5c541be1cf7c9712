import random
import re
from html import escape, unescape

import pytest
from pyspark.sql import functions as F

from photolake.llm import wrappers
from tests.compare import same

SCHEMA = "page_id long, url string, html string"


def texts(spark, rows, schema=SCHEMA, **more):
    return {r.page_id: r.text for r in wrappers.main_text(spark.createDataFrame(rows, schema), **more).collect()}


def plain(page):
    """The text of the supplied pages: what their article holds, by plain replacements."""
    body = re.search("<article>(.*)</article>", page, re.S)
    return " ".join(unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", body[1] if body else ""))).split())


def site(rng, kind, n):
    """Pages of a host and the text of their articles."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    some = lambda k: " ".join(word() for _ in range(rng.randint(3, k)))
    out = []
    for _ in range(n):
        title = some(8) + ' & "more"'
        blocks = [title, *(some(40) for _ in range(rng.randint(1, 6)))]
        inner = f"<h1>{escape(title)}</h1>" + "".join(rng.choice(["<p>{}</p>", "<p>{}", "<div>\n {}</div>", "<blockquote><p>{}</p></blockquote>", "<ul><li>{}</ul>", "<h2>{}</h2>"]).format(b.replace(" ", rng.choice([" ", "\n  ", "&nbsp;", " <b>", " </i><!-- x -->"]), 1)) for b in blocks[1:])
        menu = "<ul>" + "".join(f"<li><a href='/{word()}'>{some(3)}</a>" for _ in range(rng.randint(2, 6))) + "</ul>"
        head = f"<html><head><title>{escape(title)}</title><style>p{{}}</style><script>if (a < b) document.write('<article>no</article>')</script></head><body>"
        if kind == "article":
            page = f"{head}<header><a>Logo</a></header><nav>{menu}</nav><div class='cookie-notice'>{some(9)}</div><article class='post'>{inner}<aside>{some(9)}</aside><div class=\"shareBar\">{some(4)}</div></article><section id=comments><h3>{some(4)}</h3><article class=comment>{some(20)}</article></section><footer>{some(9)}</footer>"
        elif kind == "main":
            page = f"{head}<div role=navigation>{menu}</div><main>{inner}<form><label>{some(3)}</label><input><button>Go</button></form><div class='ad-slot'>{some(9)}</div></main><div id='site-footer'>{some(9)}</div></body></html>"
        elif kind == "unclosed":
            page = f"{head}<div class=advertisement>{some(5)}<article>{inner}</article><footer>{some(5)}"
        else:
            page = f"{head}<div id=top>Our site</div><div class=x>{menu}</div><div class=text>{inner}</div><div class=y>Written by nobody for <a>all</a></div><div class='left_sidebar'>{some(9)}</div>"
        out.append((page, " ".join(blocks)))
    return out


@pytest.mark.parametrize("kind", ["article", "main", "unclosed", "none"])
def test_templates_of_many_kinds(spark, kind):
    made = site(random.Random(kind), kind, 40)
    rows = [(i, f"http://{kind}.example.org/{i}", page) for i, (page, _) in enumerate(made)]
    assert texts(spark, rows) == {i: text for i, (_, text) in enumerate(made)}


def test_wrappers_joined_to_the_pages_give_the_same(spark):
    made = site(random.Random(5), "none", 30) + site(random.Random(6), "main", 30)
    rows = [(i, f"http://{'ab'[i // 30]}.example.org/{i}", page) for i, (page, _) in enumerate(made)]
    assert texts(spark, rows, sent=0) == texts(spark, rows) == {i: text for i, (_, text) in enumerate(made)}


@pytest.mark.parametrize("seed", range(6))
def test_pages_match_their_wrapper_in_whatever_order_it_is_learned(seed):
    rng = random.Random(seed)

    def grown(depth=0):
        tags = rng.sample(["div", "p", "ul", "table", "section", "h2"], 3)
        return "".join(rng.choice(["some text", f"<{t} class={rng.choice('xyz')}>{grown(depth + 1) if depth < 3 else 'end'}</{t}>"]) for t in rng.choices(tags, k=rng.randint(0, 5)))

    pages = [wrappers.parsed(grown()) for _ in range(60)]
    parts = []
    for i in range(0, 60, 15):
        w = wrappers.learned(*pages[i])
        for p in pages[i + 1 : i + 15]:
            wrappers.aligned(w, wrappers.learned(*p))
        parts.append(w)
    rng.shuffle(parts)
    w = parts[0]
    for other in parts[1:]:
        wrappers.aligned(w, other)
    pattern = wrappers.pattern(w)
    assert "|" not in pattern
    for node, _ in pages:
        assert re.fullmatch(pattern, wrappers.tokens(node, w))


def test_a_wrapper_has_slots_repeats_and_options():
    pages = ["<ul><li>a<li>b</ul><p>x</p>", "<ul><li>c</ul><h2>t</h2><p>y</p>", "<p>z</p><p>z</p>"]
    w = None
    for p in pages:
        more = wrappers.learned(*wrappers.parsed(p))
        if w:
            wrappers.aligned(w, more)
        else:
            w = more
    assert wrappers.pattern(w) == "(?:<ul>(?:<li>#</li>)+</ul>)?(?:<h2>#</h2>)?(?:<p>#</p>)+"


def test_many_classes_and_deep_pages(spark):
    many = "".join(f"<div class=c{chr(97 + i // 26)}{chr(97 + i % 26)}>text {i}</div>" for i in range(300))
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    rows = [(1, "http://a/1", many), (2, "http://a/2", many + "<p>end"), (3, "http://a/3", deep + "<p>behind"), (4, "http://a/4", "<article>" + deep + "</article>out")]
    got = texts(spark, rows)
    assert got[1] == " ".join(f"text {i}" for i in range(300)) and got[2] == got[1] + " end"
    assert got[3] == "deep behind" and got[4] == "deep"
    w = wrappers.learned(*wrappers.parsed(many))
    assert list(w["k"]) == ["div"]


def test_odd_pages(spark):
    page = "<p>One &amp; two&nbsp;&#233;&eacute;&lt;b&gt; a < b<br>three<script>x</script><b>fo</b>ur"
    long = "<article>" + "<p>" + "word " * 400_000 + "</p>" * 3 + "</article>"
    rows = [(1, None, None), (2, "http://x/", ""), (3, "no url", page), (3, "no url", page), (4, "http://x/2", "plain text"), (5, "HTTPS://u:p@X:80/", long), (6, "http://x/3", "<p title='a > b'>cut <a href=\"x"), (7, "http://y/", "<!-- never closed <p>x</p>"), (8, "http://y/", "</div></p><p>a</div>b</article>c")]
    got = wrappers.main_text(spark.createDataFrame(rows, SCHEMA))
    assert got.count() == len(rows)
    found = {r.page_id: (r.text, r.n_chars) for r in got.collect()}
    assert found[1] == found[2] == found[7] == ("", 0)
    assert found[3][0] == "One & two éé<b> a < b threefour"
    assert found[4] == ("plain text", 10)
    assert found[5] == (" ".join(["word"] * 400_000), 1_999_999)
    assert found[6][0] == "cut" and found[8][0] == "a b c"
    assert wrappers.main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_copies_of_one_page_are_no_template(spark):
    page = "<title>t</title><div>A text that all copies have.</div>"
    assert set(texts(spark, [(i, "http://x/", page) for i in range(50)]).values()) == {"A text that all copies have."}


def test_other_columns_keep_their_values(spark):
    rows = [(1, "http://x/", "<p>a</p>", "h", "w", "t", 5)]
    got = wrappers.main_text(spark.createDataFrame(rows, SCHEMA + ", host string, wrapper string, text string, n_chars long"), sent=0)
    assert got.columns == ["page_id", "url", "host", "wrapper", "text", "n_chars"]
    assert [tuple(r) for r in got.collect()] == [(1, "http://x/", "h", "w", "a", 1)]


def test_hosts(spark):
    urls = ["http://A.b/c", "https://u:p@h.org:8080/x?y", "x", None, "http://h.org#a"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(wrappers.host(F.col("u"))).collect()
    assert [r[0] for r in got] == ["a.b", "h.org", "", "", "h.org"]


def test_supplied_pages_against_plain_replacements(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    found = {r.page_id: r.text for r in wrappers.op13_main_text(spark, sf_dir).collect()}
    assert found == {i: plain(page) for i, page in pages.items()}


def test_the_query_gives_what_its_sql_gives(spark, sf_dir, duck):
    same(wrappers.op13_main_text(spark, sf_dir).toPandas(), duck.execute(wrappers.ORACLE_SQL).df())
