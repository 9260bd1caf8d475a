"""Main text of web pages by templates deduced from equivalence classes of tokens.

A token is an opening or closing tag at its path of containers. Its occurrence vector holds how often it stands in
each page of a host; tokens of one vector form a class. Classes of at least two tokens, found on at least half of
the host's pages, make up the host's template, each nested in the class of its container; a class whose tokens do not
come in the template's order in a page is not valid there. What lies between template tokens are slots. The slots
below the template's article container, without those of menus, adverts and the like, are the main text.

Vectors are compared by sums of hashes of (page, count), so that a host's pages are summed where they lie."""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_skewed, materialize

#: A class is on one of so many pages of its host at least, and has so many tokens at least.
SHARE, SIZE = 2, 2
#: A container counts as the article if it has this share, in per cent, of the text of the largest of its rank.
SUBTREE = 60
#: Token rows that a task gathers before it sends them on.
GATHER = 100_000

# Fixed values of HTML: elements without content, elements inside a line, elements that are closed by the next of their kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
#: Block elements that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements beyond which nothing is closed for the start of another.
SCOPES = frozenset("article body div dl ol section table ul".split())
#: Containers that are never main text, by element and by role.
ASIDE = frozenset("aside button dialog embed footer form head header iframe math menu nav noscript object script select style svg template textarea title".split())
ASIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of a class or id that name such a container, and those that name main text.
ASIDE_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising alert aside banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login"
    " masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promotion related replies reply respond search share sharing"
    " sidebar signup social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
MAIN_WORDS = frozenset("article articlebody body content entry main post story text".split())
COMMENTS = frozenset("comment comments replies reply".split())

PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg|math|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*+)>|<[!?/][^>]*(?:>|\Z)",
    re.I | re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


class Box(NamedTuple):
    """An open container: its token, its element, its rank as the article (1 to 3, 0: none), whether it never is main text."""

    token: int
    name: str
    rank: int
    aside: bool


_boxes: dict[tuple[int, str, str], Box] = {}


def _box(parent: int, name: str, attributes: str) -> Box:
    """The container `name` with these attributes below a container; digits in names are left out, as pages number them."""
    key = (parent, name, attributes)
    if key not in _boxes:
        if len(_boxes) > 50_000:
            _boxes.clear()
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
        words = [w.lower() for c in ("class", "id") for w in WORD.findall(found.get(c, ""))]
        label = f"{name}|{' '.join(words)}|{found.get('role', '').lower()}|{found.get('itemprop', '').lower()}"
        token = int.from_bytes(hashlib.blake2b(f"{parent}|{label}".encode(), digest_size=8).digest(), "big", signed=True) & ~1
        whole = name in ("html", "body", "article", "main")
        hinted = any(w in ASIDE_WORDS for w in words) and (not any(w in MAIN_WORDS for w in words) or words[-1] in ASIDE_WORDS)
        aside = name in ASIDE or found.get("role", "").lower() in ASIDE_ROLES or (hinted and not whole) or (whole and any(w in COMMENTS for w in words))
        main = name in ("article", "main") or found.get("role", "").lower() in ("main", "article") or found.get("itemprop", "").lower() == "articlebody"
        rank = 0 if aside else 1 if main else 2 if name != "body" and any(w in MAIN_WORDS for w in words) else 3 if name == "body" else 0
        _boxes[key] = Box(token, name, rank, aside)
    return _boxes[key]


class Page(NamedTuple):
    """Tokens of a page in order (closing tokens are odd); its containers as (box, container around it or -1); its
    texts as (container or -1, block, text)."""

    tokens: list[int]
    nodes: list[tuple[Box, int]]
    texts: list[tuple[int, int, str]]

    def sizes(self) -> dict[int, tuple[Box, int, int]]:
        """By token: box, token of the container around it, length of all text below."""
        below = [0] * len(self.nodes)
        for node, _, text in self.texts:
            if node >= 0:
                below[node] += len(text)
        out: dict[int, tuple[Box, int, int]] = {}
        for k in range(len(self.nodes) - 1, -1, -1):
            box, parent = self.nodes[k]
            if parent >= 0:
                below[parent] += below[k]
            out[box.token] = (box, self.nodes[parent][0].token if parent >= 0 else 0, below[k] + out.get(box.token, (box, 0, 0))[2])
        return out


def scan(source: str) -> Page:
    """Containers, tokens and texts of a page. Inline elements are no containers, unless they are named like an advert
    or another aside; unclosed elements end with the element around them. Takes time in proportion to the page."""
    stack: list[int] = []
    tokens, nodes, texts, block, at = [], [], [], 0, 0
    open_names: Counter[str] = Counter()

    def text(raw: str) -> None:
        if raw and not raw.isspace():
            texts.append((stack[-1] if stack else -1, block, raw))
        elif raw and texts and texts[-1][1] == block:
            texts.append((stack[-1] if stack else -1, block, " "))

    def close(keep: int) -> None:
        while len(stack) > keep:
            box = nodes[stack.pop()][0]
            open_names[box.name] -= 1
            tokens.append(box.token | 1)

    for m in PIECE.finditer(source):
        text(source[at : m.start()])
        at = m.end()
        if not m[3]:
            block += m[1] is not None
            continue
        name = m[3].lower()
        if m[2]:
            block += name not in INLINE or open_names[name] > 0
            if open_names[name]:
                close(next(k for k in range(len(stack) - 1, -1, -1) if nodes[stack[k]][0].name == name))
            continue
        if name == "br":
            text(" ")
            continue
        block += name not in INLINE
        ends = (*CLOSES.get(name, ()), *(("p",) if name in ENDS_P else ()))
        if name not in VOID and any(open_names[e] for e in ends):
            for k in range(len(stack) - 1, -1, -1):
                around = nodes[stack[k]][0].name
                if around in ends:
                    close(k)
                    break
                if around in SCOPES:
                    break
        box = _box(nodes[stack[-1]][0].token if stack else 0, name, m[4])
        if name in VOID or (name in INLINE and not box.aside):
            continue
        block += name in INLINE
        nodes.append((box, stack[-1] if stack else -1))
        stack.append(len(nodes) - 1)
        open_names[name] += 1
        tokens.append(box.token)
    text(source[at:])
    return Page(tokens, nodes, texts)


_TOKENS = "host string, token long, parent long, rank int, pages long, total long, chars long, place long, v1 long, v2 long"


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial token rows of pages. A page is named by its source, which gives each count of a token in it two hashes;
    token 0 stands for the page itself."""
    rows: dict[tuple[str, int], list[int]] = {}

    def flush():
        columns = [[k[0] for k in rows], [k[1] for k in rows], *[[r[i] for r in rows.values()] for i in range(8)]]
        types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 6)
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[c.split()[0] for c in _TOKENS.split(", ")])
        rows.clear()
        return out

    for batch in batches:
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            page = scan(source)
            boxes = page.sizes()
            count: dict[int, int] = {0: 1}
            place: dict[int, int] = {0: 0}
            for k, t in enumerate(page.tokens):
                count[t] = count.get(t, 0) + 1
                place.setdefault(t, k)
            name = hashlib.blake2b(source.encode("utf-8", "replace"), digest_size=16).digest()
            hashes: dict[int, tuple[int, int]] = {}
            for t, n in count.items():
                if n not in hashes:
                    h = hashlib.blake2b(name + n.to_bytes(8, "big"), digest_size=8).digest()
                    hashes[n] = int.from_bytes(h[:4], "big") >> 1, int.from_bytes(h[4:], "big") >> 1
                box, parent, chars = boxes.get(t & ~1, (None, 0, 0))
                row = rows.setdefault((host, t), [parent, box.rank if box and not t & 1 else 0, 0, 0, 0, 0, 0, 0])
                for i, x in enumerate((1, n, chars, place[t], *hashes[n]), 2):
                    row[i] += x
            if len(rows) > GATHER:
                yield flush()
    if rows:
        yield flush()


def token_vectors(pages: DataFrame) -> DataFrame:
    """(host, token, parent, rank, pages, total, chars, place, v1, v2) of pages (host, html): how many pages hold a
    token, how often, and the two sums of hashes that stand for its occurrence vector."""
    partial = pages.select("host", "html").mapInArrow(_gather, _TOKENS)
    sums = [F.sum(c).alias(c) for c in ("pages", "total", "chars", "place", "v1", "v2")]
    return partial.groupBy("host", "token").agg(F.max("parent").alias("parent"), F.max("rank").alias("rank"), *sums)


def templates(vectors: DataFrame) -> DataFrame:
    """(host, pages, template, article): template lists the tokens of the host's valid classes with their class, the
    class around it and their place in order; article is the token of the container that holds the main text.

    A host's template has at most SHARE times as many tokens as its pages have on average."""
    of_host = vectors.where("token = 0").select("host", F.col("pages").alias("host_pages"))
    rows = vectors.where("token <> 0").join(of_host.hint("merge"), ["host"]).where(F.col("pages") * SHARE >= F.col("host_pages"))
    same = Window.partitionBy("host", "pages", "total", "v1", "v2")
    rows = rows.withColumn("class", F.min("token").over(same)).withColumn("size", F.count(F.lit(1)).over(same)).where(F.col("size") >= SIZE)
    around = rows.select("host", F.col("token").alias("parent"), F.col("class").alias("around"))
    rows = rows.join(around.hint("merge"), ["host", "parent"], "left")
    mean = F.col("place") / F.col("pages")
    best = rows.where("rank > 0").withColumn("most", F.max("chars").over(Window.partitionBy("host", "rank")))
    # The best rank, there the smallest container that still has most of the text.
    best = best.where(F.col("chars") * 100 >= F.col("most") * SUBTREE).groupBy("host").agg(F.min_by("token", F.struct("rank", "chars", -mean, "token")).alias("article"))
    listed = rows.groupBy("host").agg(F.array_sort(F.collect_list(F.struct(mean.alias("place"), "token", "class", F.coalesce("around", F.lit(0)).alias("around")))).alias("template"))
    out = of_host.join(listed.hint("merge"), ["host"], "left").join(best.hint("merge"), ["host"], "left")
    return out.select("host", F.col("host_pages").alias("pages"), F.coalesce("template", F.expr("cast(array() as array<struct<place:double,token:bigint,class:bigint,around:bigint>>)")).alias("template"), "article")


def _valid(tokens: list[int], template: list[dict]) -> set[int]:
    """Tokens of the classes that come in the template's order throughout the page, below valid classes."""
    order: dict[int, list[int]] = {}
    around: dict[int, int] = {}
    for t in template:
        order.setdefault(t["class"], []).append(t["token"])
        around.setdefault(t["class"], t["around"])
    of, at, bad = {t["token"]: t["class"] for t in template}, dict.fromkeys(order, 0), set()
    for t in tokens:
        c = of.get(t)
        if c is not None:
            if order[c][at[c]] != t:
                bad.add(c)
            at[c] = (at[c] + 1) % len(order[c])
    bad |= {c for c in order if at[c]}
    return {t for t, c in of.items() if c not in bad and (around[c] in (0, c) or around[c] not in bad)}


def main_text(source: str, template: list[dict], article: int | None) -> str:
    """The main text of a page: its texts in slots below the article container, or, where that is no valid container
    of this page, below the page's own best one; without asides. Blocks are joined by an empty line."""
    page = scan(source)
    sizes = page.sizes()
    if article is None or article not in sizes or not _valid(page.tokens, template) & {article, article | 1}:
        found = [(b.rank, total, b.token) for b, _, total in sizes.values() if b.rank]
        first = min((r for r, _, _ in found), default=0)
        most = max((n for r, n, _ in found if r == first), default=0)
        article = min(((n, t) for r, n, t in found if r == first and n * 100 >= most * SUBTREE), default=(0, None))[1]
    taken: list[bool | None] = []  # None: an aside, or below one
    for box, parent in page.nodes:
        above = taken[parent] if parent >= 0 else article is None
        taken.append(None if box.aside or above is None else above or box.token == article)
    blocks: dict[int, list[str]] = {}
    for node, block, raw in page.texts:
        if taken[node] if node >= 0 else article is None:
            blocks.setdefault(block, []).append(raw)
    out = (" ".join(html.unescape("".join(b)).split()) for b in blocks.values())
    return "\n\n".join(b for b in out if b)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        source, template, article = (batch.column(batch.schema.get_field_index(c)) for c in ("_html", "_template", "_article"))
        texts = [main_text(s, t, a) for s, t, a in zip(source.to_pylist(), template.to_pylist(), article.to_pylist())]
        kept = [i for i, c in enumerate(batch.schema.names) if c not in ("_html", "_template", "_article", "_host")]
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pa.array(texts, pa.string())], names=[*[batch.schema.names[i] for i in kept], "main_text"])


def extract(pages: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of each page and main_text, one row for each row of pages (url, html, ...).

    A null html is empty and gives the empty text; a null url, or one without a host, belongs to the host named
    by the empty string; repeated rows stay; an empty table gives no rows. Names that begin with _ and main_text are
    the operator's own. Templates of hosts with many pages are broadcast, the others merged."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
    rows = pages.select(*keep, F.coalesce("html", F.lit("")).alias("_html"), host.alias("_host"))
    found = materialize(token_vectors(rows.select(F.col("_host").alias("host"), F.col("_html").alias("html"))), "vectors")
    known = materialize(templates(found), "templates")
    total = known.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    values = known.select(F.col("host").alias("_host"), F.col("pages").alias("_n"), F.col("template").alias("_template"), F.col("article").alias("_article"))
    joined = join_skewed(rows, values, ["_host"], total)
    schema = pages.select(*keep).schema.add("main_text", "string")
    return joined.mapInArrow(_extract, schema)


def op13_html_extraction(spark, sf_dir: str) -> DataFrame:
    from .common import ship, table

    ship(spark)
    out = extract(table(spark, sf_dir, "pages"), ["page_id", "url"])
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


#: On the given tables the main text is that of the article element; this takes it by position, without templates.
OP13_SQL = r"""
WITH inside AS (
  SELECT page_id, url, regexp_extract(html, '(?s)<article[^>]*>(.*)</article>', 1) AS body FROM pages),
cut AS (
  SELECT page_id, url, unnest(regexp_split_to_array(body, '</?(?:h[1-6]|p|div|ul|li)[^>]*>')) AS block, generate_subscripts(regexp_split_to_array(body, '</?(?:h[1-6]|p|div|ul|li)[^>]*>'), 1) AS k
  FROM inside),
plain AS (
  SELECT page_id, url, k, trim(regexp_replace(replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(block, '<br[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS block
  FROM cut),
whole AS (SELECT page_id, string_agg(block, chr(10) || chr(10) ORDER BY k) AS text FROM plain WHERE block <> '' GROUP BY page_id)
SELECT p.page_id, p.url, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n_chars FROM pages p LEFT JOIN whole w ON w.page_id = p.page_id
"""
