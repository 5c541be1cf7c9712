"""Main text of web pages through wrappers: union-free regular expressions inferred for each host.

A page is a stream of balanced tokens: elements, and slots of text. The streams of a host are aligned
one with the other (after Crescenzi, Mecca and Merialdo, VLDB 2001): elements that stand one after the
other are folded into repeated groups, what only one side has becomes optional, an order that differs
becomes a repeated group of optional parts, and different texts at one place become a slot. Tasks align
the pages they read, then what tasks found is aligned for each host. The wrapper tells of each slot
whether its text is the host's own (the same on pages with different titles, or links alone), and a
page's text is read by matching the page with its host's wrapper.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photolake.llm.tables import table, unused
from photolake.storage import materialize

#: Levels of elements that are told apart; deeper ones are blocks of the last.
DEPTH = 32
#: Kinds of children that an element may have in a wrapper before classes are left out.
KINDS = 48
#: Pages, with as many different titles, that must agree on a text before it is the host's own.
AGREE = 3
#: Hosts that a task holds before it hands back what it has.
HOSTS = 1024
#: Bytes of wrappers that are sent to every task; beyond, wrappers are joined to the pages.
SENT = 32 << 20

# Names of HTML elements and of attributes' words by what they mean.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noscript xmp noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
BLOCKS = set("address article aside blockquote caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
AWAY = set("aside audio button canvas datalist dialog footer form head map math menu nav object search select svg template video".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
# what an element ends when it begins, and what keeps the search for it inside
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
IN_HEAD = set("base link meta noscript script style template title".split())
WORDS = set(
    "ad ads adsense adslot adv advert advertisement advertisements advertising aside banner bottombar breadcrumb breadcrumbs colophon comment comments consent cookie cookies copyright disqus discussion follow footer footnav form gdpr hidden leaderboard login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popular popup privacy promo promoted promotion recommended recommendations related replies reply respond responses rail search share sharebar sharing sidebar signin signup skip social sponsor sponsored subscribe subscription taboola teaser toolbar topbar trending widget widgets outbrain".split()
)
PARTS = ("advert", "breadcrumb", "cookie", "disqus", "footer", "menu", "navbar", "newsletter", "popup", "sidebar", "sponsor", "comments")
TOPS = {"header", "masthead", "banner", "alert"}
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NOT_ARTICLES = set("ad ads advert advertisement comment promo promoted recommended related reply sponsored teaser".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
TELLING = re.compile(r"class|id|role|itemprop|style|hidden", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
OF_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


class Node:
    """An element, or the text between elements (``tag`` is ``#``)."""

    __slots__ = ("tag", "name", "away", "main", "kids", "texts", "links")

    def __init__(self, tag: str, name: str = "", away: bool = False, main: int = 0) -> None:
        self.tag, self.name, self.away, self.main = tag, name, away, main
        self.kids: list[Node] = []
        self.texts: list[str] = []
        self.links = 0

    def label(self) -> str:
        return self.tag + (f".{self.name}" if self.name else "") + ("!" if self.away else "")

    def text(self) -> str:
        return " ".join("".join(self.texts).split())


def bare(label: str) -> str:
    """A label without its class."""
    return label.split(".")[0].rstrip("!") + ("!" if label.endswith("!") else "")


@lru_cache(1 << 14)
def _described(tag: str, attributes: str, inside: bool) -> tuple[str, bool, int]:
    """An element's name, whether it is no part of an article, and how sure it is the article (0 to 3)."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    role, said = found.get("role", "").lower(), f"{found.get('class', '')} {found.get('id', '')}"
    words = {w.lower() for w in WORD.findall(said)}
    name = next(iter(w.lower() for w in WORD.findall(said)), "")[:24]
    if found.get("aria-hidden", "").lower() == "true" or "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower():
        return name, True, 0
    if tag == "article" or role == "article" or "articlebody" in found.get("itemprop", "").lower():
        away = bool(words & NOT_ARTICLES) or role in ROLES
        return name, away, 0 if away else 3
    if tag == "main" or role == "main":
        return name, False, 2
    away = tag in AWAY or role in ROLES or bool(words & WORDS) or any(p in w for w in words for p in PARTS)
    if not inside:
        away = away or tag == "header" or bool(words & TOPS)
    return name, away, 0


def parsed(page: str | None) -> tuple[Node, str]:
    """A page's elements, whatever is missing or unbalanced, and its title."""
    root, title, at, page = Node("body"), "", 0, page or ""
    stack, fresh, link = [root], True, 0
    beyond: Counter = Counter()

    def add(text: str) -> None:
        nonlocal fresh
        here = stack[-1]
        if fresh or not here.kids or here.kids[-1].tag != "#":
            here.kids.append(Node("#"))
            fresh = False
        if "&" in text:
            text = html.unescape(text)
        slot = here.kids[-1]
        slot.texts.append(text)
        if link:
            slot.links += len(text)

    def close(tags: set[str], within: set[str]) -> None:
        nonlocal fresh
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                fresh = True
                return
            if stack[i].tag in within:
                return

    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        ending, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in ("html", "body"):
            if not ending:
                close({"head"}, set())
            continue
        if ending:
            if tag == "a":
                link = 0
            if beyond[tag]:
                beyond[tag] -= 1
                fresh = True
            elif tag not in VOID:
                # a stray end of a block is a border as well
                fresh = fresh or tag in BLOCKS
                close({tag}, set() if tag in ("article", "main") else {"article", "main"} if tag != "p" else set(CLOSES_P) - {"p"})
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            if tag == "title" and not title:
                title = " ".join(html.unescape(page[at : end.start() if end else len(page)]).split())
            at = end.start() if end else len(page)
            continue
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            close({"head"}, set())
        if tag in VOID:
            if tag in ("br", "hr"):
                if tag == "hr":
                    close({"p"}, set())
                add(" ")
            continue
        # most attributes tell nothing here
        telling = attributes if attributes and TELLING.search(attributes) else ""
        if telling or tag not in INLINE:
            name, away, main = _described(tag, telling, any([n.main for n in stack]))
        else:
            away = False
        if tag in INLINE and not away:
            if tag == "a":
                link = 1
            continue
        if tag in CLOSES_P:
            close({"p"}, {"table", "td", "th", "button", "object", "article", "main"})
        if tag in ENDS:
            close(*ENDS[tag])
        fresh, link = True, 0 if tag != "a" else 1
        if len(stack) > DEPTH + away or attributes.rstrip().endswith("/") and tag not in BLOCKS:
            if not attributes.rstrip().endswith("/"):
                beyond[tag] += 1
            continue
        known = tag if tag in BLOCKS or tag in INLINE or tag in AWAY else "x"
        node = Node(tag, name, away, main)
        stack[-1].kids.append(node)
        stack.append(node)
        if known == "x":
            node.name = ""
    _lifted(root)
    return root, title


def _lifted(root: Node) -> None:
    """Where the only article stands in an element that is none (one that was not closed), that one is let be."""
    held: list[list[Node]] = []

    def look(node: Node, above: list[Node]) -> bool:
        """Whether an article stands outside of all such elements."""
        above = [*above, node] if node.away else above
        if node.main:
            if not above:
                return True
            held.append(above)
        return any([look(k, above) for k in node.kids if k.tag != "#"])

    if not look(root, []) and held:
        for node in held[0]:
            node.away = False


# A wrapper is a dict: k, its children by label; s, their order: groups [labels, repeated, optional labels];
# for text, t: [pages, hash or 0 where texts differ, hashes of titles, characters, characters in links]


def _order(labels: list[str]) -> list[list]:
    """Children's labels folded into groups: those between two of one label belong to one repeated group."""
    if len(labels) == 1:
        return [[labels, False, []]]
    first, last = {}, {}
    for i, x in enumerate(labels):
        first.setdefault(x, i)
        last[x] = i
    groups: list[list] = []
    start = 0
    while start < len(labels):
        end, i = last[labels[start]], start
        while i <= end:
            end = max(end, last[labels[i]])
            i += 1
        names = sorted({*labels[start : end + 1]}, key=first.get)
        place = {x: k for k, x in enumerate(names)}
        rounds: list[set] = [set()]
        before = -1
        for x in labels[start : end + 1]:
            if place[x] <= before:
                rounds.append(set())
            rounds[-1].add(x)
            before = place[x]
        groups.append([names, len(rounds) > 1, [x for x in names if any(x not in r for r in rounds)]])
        start = end + 1
    return groups


def _aligned(a: list[list], b: list[list]) -> list[list]:
    """Two orders of children as one that has room for both."""
    if a == b:
        return a
    of: dict[str, int] = {}
    for groups in (a, b):
        for names, _, _ in groups:
            tied = {of[x] for x in names if x in of} or {len(of) + 1_000_000 + (groups is b) * 1_000_000}
            to = min(tied)
            for x in [x for x, g in of.items() if g in tied] + names:
                of[x] = to
    lines = [[[of[n[0]] for n, _, _ in groups] for groups in (a, b)][k] for k in (0, 1)]

    def tie(some: list[int]) -> None:
        tied = set(some)
        for x, g in of.items():
            if g in tied:
                of[x] = some[0]
        for line in lines:
            line[:] = [some[0] if g in tied else g for g in line]

    moved = True
    while moved:
        moved = False
        for line in lines:
            for i, g in enumerate(line):
                j = len(line) - 1 - line[::-1].index(g)
                if j > i:
                    if len(set(line[i : j + 1])) > 1:
                        tie(line[i : j + 1])
                    del line[i + 1 : j + 1]
                    moved = True
                    break
        both = [g for g in lines[0] if g in lines[1]]
        for g, h in zip(both, both[1:]):
            if lines[1].index(g) > lines[1].index(h):
                i, j = lines[0].index(g), lines[0].index(h)
                tie(lines[0][i : j + 1])
                moved = True
                break
    out, i = [], 0
    for g in lines[0]:
        if g in lines[1]:
            j = lines[1].index(g)
            out += lines[1][i:j]
            i = j + 1
        out.append(g)
    out += lines[1][i:]
    result = []
    for g in out:
        sides = [[x for x in groups if of[x[0][0]] == g] for groups in (a, b)]
        parts = sides[0] + sides[1]
        names = list(dict.fromkeys(n for p in parts for n in p[0]))
        if len(sides[0]) == len(sides[1]) == 1 and sides[0][0][0] == sides[1][0][0]:
            free = set(sides[0][0][2]) | set(sides[1][0][2])
            result.append([names, any(p[1] for p in parts), [n for n in names if n in free]])
        elif len(parts) == 1:
            # one side alone has it
            result.append([names, parts[0][1], names])
        else:
            result.append([names, True, names])
    return result


def learned(node: Node, title: str) -> dict:
    """The wrapper of one page."""
    named = hash_of(title)

    def of(node: Node) -> dict:
        labels, kids = [], {}
        for kid in node.kids:
            if kid.tag == "#":
                text = kid.text()
                if not text:
                    continue
                made: dict = {"t": [1, hash_of(text), [named], len(text), min(kid.links, len(text))]}
            else:
                made = of(kid)
            label = kid.label()
            labels.append(label)
            if label in kids:
                aligned(kids[label], made, same_page=True)
            else:
                kids[label] = made
        return _general({"k": kids, "s": _order(labels)})

    return of(node)


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) >> 1 or 1


def _general(w: dict) -> dict:
    """Where there are too many kinds of children, those that differ by class alone become one."""
    if len(w["k"]) <= KINDS:
        return w
    kids: dict = {}
    for label, kid in w["k"].items():
        short = bare(label)
        if short in kids:
            aligned(kids[short], kid)
        else:
            kids[short] = kid
    labels = list(dict.fromkeys(bare(x) for names, _, _ in w["s"] for x in names))
    return {"k": kids, "s": [[labels, True, labels]]}


def aligned(w: dict, other: dict, same_page: bool = False) -> None:
    """Take ``other`` into the wrapper ``w``."""
    if "t" in w:
        a, b = w["t"], other["t"]
        titles = a[2] if a[2] == b[2] else sorted({*a[2], *b[2]})[:AGREE]
        w["t"] = [a[0] + (0 if same_page else b[0]), a[1] if a[1] == b[1] else 0, titles, a[3] + b[3], a[4] + b[4]]
        return
    if w["s"] == other["s"]:
        # the same children in the same order
        for label, kid in other["k"].items():
            aligned(w["k"][label], kid, same_page)
        return
    wide = [len(x["s"]) == 1 and x["s"][0][0] == [bare(n) for n in x["s"][0][0]] and x["s"][0][1] and len(x["k"]) > KINDS // 2 for x in (w, other)]
    kids, order = other["k"], other["s"]
    if any(wide) and not all(wide):
        # one side has left classes out
        target = w if wide[1] else other
        short = {"k": {}, "s": []}
        for label, kid in target["k"].items():
            if bare(label) in short["k"]:
                aligned(short["k"][bare(label)], kid)
            else:
                short["k"][bare(label)] = kid
        labels = list(short["k"])
        short["s"] = [[labels, True, labels]] if labels else []
        if wide[1]:
            w["k"], w["s"] = short["k"], short["s"]
        else:
            kids, order = short["k"], short["s"]
    for label, kid in kids.items():
        if label in w["k"]:
            aligned(w["k"][label], kid, same_page)
        else:
            w["k"][label] = kid
    w["s"] = _aligned(w["s"], order)
    w.update(_general(w))


def tokens(node: Node, w: dict) -> str:
    """A page's stream of tokens, by the labels that its wrapper has."""
    out = []
    for kid in node.kids:
        label = _known(kid, w)
        if kid.tag == "#":
            out += ["#"] if kid.text() else []
        else:
            out.append(f"<{label}>{tokens(kid, w['k'][label])}</{label}>")
    return "".join(out)


def _known(node: Node, w: dict) -> str:
    label = node.label()
    return label if label in w["k"] else bare(label)


def pattern(w: dict) -> str:
    """A wrapper as a regular expression over :func:`tokens`; there is no alternation in it."""
    out = []
    for names, repeated, free in w["s"]:
        inner = ""
        for n in names:
            one = "#" if n == "#" else f"<{re.escape(n)}>{pattern(w['k'][n])}</{re.escape(n)}>"
            inner += f"(?:{one})?" if n in free else one
        out.append(f"(?:{inner})+" if repeated else inner)
    return "".join(out)


def extracted(node: Node, w: dict) -> str:
    """The main text of a page, read by its host's wrapper."""
    best = 0

    def look(n: Node) -> None:
        nonlocal best
        for kid in n.kids:
            if kid.tag != "#" and not kid.away:
                best = max(best, kid.main)
                look(kid)

    look(node)
    out: list[str] = []

    def read(n: Node, w: dict | None, inside: bool, listed: bool) -> None:
        for kid in n.kids:
            if kid.tag == "#":
                text = kid.text() if inside else ""
                if text and not _hosts_own(w and w["k"].get("#"), n.tag, listed, best):
                    out.append(text)
            elif not kid.away:
                below = w and w["k"].get(_known(kid, w))
                read(kid, below, inside or kid.main == best, listed or kid.tag in ("ul", "ol", "dl", "li", "table"))

    read(node, w, best == 0, False)
    return " ".join(out)


def _hosts_own(slot: dict | None, tag: str, listed: bool, best: int) -> bool:
    """Whether a slot holds a text of the host's template, or nothing but a list of links outside an article."""
    if slot is None or tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        return False
    pages, same, titles, characters, links = slot["t"]
    if same and pages >= AGREE and len(titles) >= AGREE:
        return True
    return best == 0 and tag != "p" and (listed or tag == "div") and links >= 0.8 * characters


def _of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, dict] = {}

    def told() -> pa.RecordBatch:
        rows = [list(held), [json.dumps(w, separators=(",", ":")) for w in held.values()]]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in rows], ["host", "wrapper"])

    for batch in batches:
        for host, page in zip(batch.column(0), batch.column(1)):
            w = learned(*parsed(page.as_py()))
            host = host.as_py()
            if host in held:
                aligned(held[host], w)
            else:
                held[host] = w
            if len(held) > HOSTS:
                yield told()
    if held:
        yield told()


def _joined(rows: pd.DataFrame) -> pd.DataFrame:
    w = None
    for text in sorted(rows["wrapper"]):
        more = json.loads(text)
        if w is None:
            w = more
        else:
            aligned(w, more)
    return pd.DataFrame({"host": rows["host"].iloc[:1], "wrapper": [json.dumps(w, separators=(",", ":"))]})


def host(url: Column) -> Column:
    """A URL's host in small letters; empty for null and what has none."""
    return F.lower(F.coalesce(F.regexp_extract(url, OF_HOST, 1), F.lit("")))


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, wrapper`` (JSON) of every host, from all its pages.

    Each task aligns the pages that it reads, so a host has a row for each task however many pages it
    has. These are aligned by groups whose number is about the square root of the tasks', then for each
    host. A wrapper has one place for each path of elements, told apart by tag and first word of the
    class or id, down to 32 levels and with up to 48 kinds of children each, beyond which classes are
    left out; so it does not grow with the pages. Null pages are empty; null URLs are one host.
    """
    read = pages.select(host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    made = read.mapInArrow(_of_task, "host string, wrapper string").withColumn("task", F.spark_partition_id())
    made = materialize(made, "aligned")
    tasks = (made.agg(F.max("task")).first()[0] or 0) + 1
    groups = max(1, int(tasks**0.5))
    if groups > 1:
        made = made.groupBy("host", F.pmod("task", F.lit(groups)).alias("some")).applyInPandas(_joined, "host string, wrapper string")
    return materialize(made.groupBy("host").applyInPandas(_joined, "host string, wrapper string"), "wrappers")


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", sent: int = SENT) -> DataFrame:
    """``pages`` without their HTML, with ``text`` and ``n_chars`` (code points) of every row.

    The text is the article's: of the elements ``article`` (or the like), else ``main``, else all of the
    page, without elements that are none of it by tag, role or words of their class or id, and without
    what the host's wrapper knows as its own. Character references are decoded, white space in a block
    is one space, blocks are joined in the order of the page by one space. Unclosed and stray tags are
    borne with. Null and empty pages give an empty text, null URLs are one host, very long pages are
    read whole, repeated rows are rows of their own; columns of clashing names keep their values. An
    empty table gives no rows.

    Pages are not shuffled while all wrappers together are within ``sent`` bytes, which are then sent
    to every task; beyond, wrappers are joined to the pages by host.
    """
    spark = pages.sparkSession
    known = wrappers(pages, url_col, html_col)
    of, found, other = unused(pages, "host", "wrapper", "of_host")
    size = known.agg(F.coalesce(F.sum(F.octet_length("wrapper")), F.lit(0))).first()[0]
    kept = [c for c in pages.columns if c != html_col and c not in ("text", "n_chars")]
    rows = pages.withColumn(of, host(F.col(url_col)))
    small = None
    if size <= sent:
        small = spark.sparkContext.broadcast({r["host"]: r["wrapper"] for r in known.collect()})
        rows = rows.select(*kept, html_col, of, F.lit(None).cast("string").alias(found))
    else:
        told = known.select(F.col("host").alias(other), F.col("wrapper").alias(found))
        rows = rows.join(told, F.col(of) == F.col(other)).select(*kept, html_col, of, found)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, dict] = {}
        for batch in batches:
            texts = []
            n = len(kept)
            for page, name, w in zip(batch.column(n), batch.column(n + 1), batch.column(n + 2)):
                name = name.as_py()
                if name not in made:
                    if len(made) > HOSTS:
                        made.clear()
                    made[name] = json.loads(small.value[name] if small else w.as_py())
                texts.append(extracted(parsed(page.as_py())[0], made[name]))
            columns = [batch.column(i) for i in range(n)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*kept, "text", "n_chars"])

    schema = T.StructType([*(pages.schema[c] for c in kept), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rows.mapInArrow(read, schema)


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


#: The supplied pages all have one article with few character references, so that replacements do for them.
ORACLE_SQL = r"""with article as (select page_id, url, coalesce(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '') as body from pages),
bare as (select page_id, url, regexp_replace(regexp_replace(body, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') as t from article),
plain as (select page_id, url, trim(regexp_replace(replace(replace(replace(t, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '\s+', ' ', 'g')) as t from bare)
select page_id, url, regexp_replace(t, '&amp;?', '&', 'g') as text, length(regexp_replace(t, '&amp;?', '&', 'g')) as n_chars from plain"""
