"""Main-text extraction by consensus host paths.

Pass 1 scores each page's containers and lets the page vote for the
generalised tag-class path of the best one; votes are summed per host in
Spark.  Pass 2 extracts again, from the containers at the host's winning path;
a page without such a container, or with nothing in it, uses its own best one.

Within the container, menus, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments are left out: by tag, by role, and by a class
or id that says nothing else ("comments", "ad-box").  A class that may as well
name a part of the article ("related-work", "discussion") only raises doubt.
A doubtful element goes if half of its characters are links, or if in most of at
least SEEN pages of the host that have such an element it says the same.

Edge cases: null, empty and tagless html give their bare text or an empty one;
a null url is a host of its own; unclosed and stray tags, comments and quotes
are read as browsers do, roughly; repeated rows vote each; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import hot_limit, materialize, salted, table

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|svg|iframe|object|title|select|canvas|math)\b[^>]*+>.*?(?:</\1\s*+>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)"
    r"|<[a-zA-Z][^>]*\Z",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role|hidden|style|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_LETTERS = re.compile(r"[a-z]+")

# HTML elements by how they behave.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr img picture source".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}
# What marks boilerplate, by element and by word of a class or id.
OUT_TAGS = frozenset("nav footer aside form button dialog menu head input fieldset".split())
OUT_WORDS = frozenset(
    "nav navbar navigation menu footer sidebar ad ads advert adverts advertisement advertising adsense banner promo promoted sponsor sponsored"
    " cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login"
    " comment comments disqus replies respond share sharing social breadcrumb breadcrumbs pagination pager toolbar copyright skip hidden paywall".split()
)
DOUBT_WORDS = frozenset("aside discussion form promotion recommended recommendations register related search widget".split())
# Words that say nothing beside one of these.
PLAIN_WORDS = frozenset(
    "area article articles bar block body bottom box btn button buttons col column container content entry footer global group header holder icon icons inner"
    " item items js label layout left line link links list main module nav outer page panel post posts primary right row secondary section site slot small"
    " sticky text the thread title top unit user wide widget wrap wrapper".split()
)
HEAD_WORDS = frozenset("header masthead topbar".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
MAIN_TAGS = frozenset(("article", "main"))
SHARE = 0.85
#: Pages of a host from which a doubtful element's repetition counts.
SEEN = 3


def said_by(token: str) -> int:
    """2: a class or id says that its element is boilerplate; 1: it may; 0: it doesn't."""
    words = set(_LETTERS.findall(token))
    if not words & (OUT_WORDS | DOUBT_WORDS):
        return 0
    return 2 if words & OUT_WORDS and words <= OUT_WORDS | PLAIN_WORDS else 1


class Page:
    """The containers of a page and its text blocks in order.

    tag, path, parent and out (boilerplate, own or inherited) per container;
    blocks: (container, text, characters inside links); doubt: containers that
    may be boilerplate, of which those are out that are links for the most part
    or have one of the paths in ``drop``.
    """

    def __init__(self, source: str, drop: frozenset[str] | set[str] = frozenset()):
        self.doubt: list[int] = []
        self.tag, self.path, self.parent, self.out, self.main = ["#"], [""], [-1], [False], [False]
        self.blocks: list[tuple[int, str, int]] = []
        stack = [0]
        parts: list[str] = []
        links = link_chars = 0

        def flush():
            nonlocal link_chars
            if parts:
                text = " ".join(_html.unescape("".join(parts)).split())
                if text:
                    self.blocks.append((stack[-1], text, min(link_chars, len(text))))
                parts.clear()
            link_chars = 0

        at = 0
        for m in _TOKEN.finditer(source):
            if m.start() > at:
                piece = source[at : m.start()]
                parts.append(piece)
                if links:
                    link_chars += len(piece)
            at = m.end()
            name = m[3] or m[6]
            if name is None:
                continue
            name = name.lower()
            if name in INLINE:
                if name == "a":
                    links = max(0, links - 1) if m[2] or m[5] else links + 1
                continue
            flush()
            if m[2] or m[5]:
                for i in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[i]] == name:
                        del stack[i:]
                        break
                continue
            if name in CLOSES_P:
                for i in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[i]] == "p":
                        del stack[i:]
                        break
                    if self.tag[stack[i]] in ("article", "section", "div", "td", "li"):
                        break
            for closed in SIBLINGS.get(name, ()):
                for i in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[i]] in SCOPE[name]:
                        break
                    if self.tag[stack[i]] == closed:
                        del stack[i:]
                        break
            if name in VOID:
                continue
            links = 0
            self._open(name, m[4] if m[4] is not None else m[7] or "", stack)
        if at < len(source):
            parts.append(source[at:])
        flush()
        if self.doubt:
            self._judge(drop)

    def _judge(self, drop):
        chars, links = [0] * len(self.tag), [0] * len(self.tag)
        for at, text, linked in self.blocks:
            chars[at] += len(text)
            links[at] += linked
        for i in range(len(self.tag) - 1, 0, -1):
            chars[self.parent[i]] += chars[i]
            links[self.parent[i]] += links[i]
        for i in self.doubt:
            self.out[i] = self.out[i] or 2 * links[i] >= chars[i] or self.path[i] in drop
        for i in range(1, len(self.tag)):
            self.out[i] = self.out[i] or self.out[self.parent[i]]

    def doubtful(self) -> list[tuple[str, int]]:
        """(path, digest of its text) of the doubtful containers that are still in; one of each path."""
        held: dict[str, int] = {}
        for i in self.doubt:
            if not self.out[i] and self.path[i] not in held:
                held[self.path[i]] = int.from_bytes(hashlib.blake2b(self.text({i}).encode(), digest_size=8).digest(), "big", signed=True)
        return list(held.items())

    def _open(self, name: str, attributes: str, stack: list[int]):
        up = stack[-1]
        cls, words, said, hidden, role, article = "", set(), 0, False, "", False
        if attributes and not attributes.isspace():
            for a in _ATTR.finditer(attributes):
                key, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
                if key in ("class", "id"):
                    words.update(_LETTERS.findall(value))
                    said = max(said, *map(said_by, value.split()), 0)
                    if key == "class" and value.strip():
                        cls = "." + "".join(c for c in value.split()[0] if not c.isdigit())
                elif key == "role":
                    role = value
                elif key == "itemprop":
                    article = value == "articlebody"
                elif key == "hidden" or key == "style" and "display:none" in value.replace(" ", ""):
                    hidden = True
        inside = self.main[up]
        top = name in ("html", "body", "main")
        out = self.out[up] or (
            not top
            and (
                name in OUT_TAGS or hidden or role in OUT_ROLES or said == 2 and name != "article"
                or (not inside and (name == "header" or bool(words & HEAD_WORDS)))
            )
        )
        self.tag.append(name)
        self.path.append(f"{self.path[up]}/{name}{cls}")
        self.parent.append(up)
        self.out.append(out)
        self.main.append(inside or name in MAIN_TAGS or article)
        stack.append(len(self.tag) - 1)
        if said == 1 and not out and not top and name != "article":
            self.doubt.append(stack[-1])

    def best(self) -> tuple[int, float]:
        """The container of the main text and its score: plain characters less those in links."""
        n = len(self.tag)
        score = [0.0] * n
        for at, text, linked in self.blocks:
            if not self.out[at]:
                worth = max(len(text) - 2 * linked, 0)
                while at >= 0:
                    score[at] += worth
                    at = self.parent[at]
        kids: list[list[int]] = [[] for _ in range(n)]
        for i in range(1, n):
            if score[i] > 0 and not self.out[i]:
                kids[self.parent[i]].append(i)
        at = 0
        while kids[at]:
            lead = max(kids[at], key=lambda i: (score[i] * (1.5 if self.tag[i] in MAIN_TAGS else 1), -i))
            if self.tag[at] == "article" or self.tag[lead] in ("p", "pre", "blockquote", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "figure", "dl"):
                break
            if score[lead] < SHARE * score[at] and self.tag[lead] not in MAIN_TAGS:
                break
            at = lead
        return at, score[at]

    def text(self, roots: set[int]) -> str:
        """The blocks below these containers that aren't boilerplate."""
        under = [False] * len(self.tag)
        for i in range(len(self.tag)):
            under[i] = i in roots or (i > 0 and under[self.parent[i]])
        return "\n".join(t for at, t, _ in self.blocks if under[at] and not self.out[at])

    def extract(self, path: str | None) -> str:
        roots = {i for i, p in enumerate(self.path) if p == path and not self.out[i]} if path else set()
        return (self.text(roots) if roots else "") or self.text({self.best()[0]})


def host_of(url: str | None) -> str:
    if not url:
        return ""
    return re.sub(r"^[a-zA-Z][\w+.-]*://", "", url).split("/")[0].split("?")[0].split("#")[0].split("@")[-1].lower()


def _votes(batches):
    """(url, html) to votes: per host and path for the best container (digest null), per doubtful one and what it says."""
    for batch in batches:
        total: dict[tuple, list[float]] = {}
        for url, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            page, host = Page(source or ""), host_of(url)
            at, score = page.best()
            own = [((host, page.path[at], None), score)] if at and score > 0 else []
            for key, worth in own + [((host, *d), 0.0) for d in page.doubtful()]:
                held = total.setdefault(key, [0, 0.0])
                held[0] += 1
                held[1] += worth
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[i] for k in total], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))]
            + [pa.array([v[0] for v in total.values()], pa.int64()), pa.array([v[1] for v in total.values()], pa.float64())],
            names=["host", "path", "digest", "votes", "score"],
        )


def _extracted(batches):
    for batch in batches:
        texts = [
            Page(source or "", set(drop or ())).extract(path)
            for source, path, drop in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )


#: Bytes of host paths up to which they are broadcast.
MOST_PATHS = 16 << 20


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path, drop, n): each host's winning container path, the paths of doubtful elements that are boilerplate there, and its pages with a vote."""
    votes = pages.select("url", "html").mapInArrow(_votes, "host string, path string, digest long, votes long, score double")
    summed = materialize(votes.groupBy("host", "path", "digest").agg(F.sum("votes").alias("votes"), F.sum("score").alias("score")))
    main = summed.where("digest IS NULL").groupBy("host").agg(F.max(F.struct("votes", F.round("score"), "path")).alias("m"), F.sum("votes").alias("n"))
    doubtful = summed.where("digest IS NOT NULL").groupBy("host", "path").agg(F.sum("votes").alias("pages"), F.max("votes").alias("same"))
    drop = doubtful.where((F.col("pages") >= SEEN) & (2 * F.col("same") > F.col("pages"))).groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("drop"))
    return main.select("host", "m.path", "n").join(drop, "host", "full").select("host", "path", "drop", F.coalesce("n", F.lit(1).cast("long")).alias("n"))


def _host(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(host_of, batch.column(1).to_pylist()), pa.string())], names=["page_id", "url", "html", "host"])


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of pages(page_id, url, html) with its main text."""
    paths = materialize(host_paths(pages))
    keyed = pages.select("page_id", "url", "html").mapInArrow(_host, "page_id long, url string, html string, host string")
    size = paths.agg(F.sum(F.length("host") + F.coalesce(F.length("path"), F.lit(0)) + F.coalesce(F.length(F.concat_ws("", "drop")), F.lit(0)) + 64).alias("b"), F.sum("n").alias("n")).first()
    if (size["b"] or 0) <= MOST_PATHS:
        joined = keyed.join(F.broadcast(paths), "host", "left")
    else:  # a host may hold a third of all pages: its pages are dealt over salts
        dealt, spread = salted(keyed, paths, ["host"], "n", hot_limit(size["n"]))
        joined = dealt.join(spread, ["host", "_salt"], "left")
    return joined.select("page_id", "url", "html", "path", "drop").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")


def op8_consensus_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
