"""HTML main text by site style trees.

Every page is parsed once into blocks: runs of text with the path of elements
(tag, class and id words) above them. The paths of all pages of a host, merged,
are the host's style tree; a node of it is a path. A node's content importance
follows from how its texts spread over the pages: for a text on n of m pages the
entropy to the base m is ln n / ln m, and a node's importance is one minus the
mean entropy of its occurrences, so menus and notices that repeat come near 0 and
articles near 1. Pages with equal main text count once, so copies of an article do
not speak against it.

Kinds that HTML sets aside for menus, headers, footers, side columns, forms and the
like always go. Names of class, id and role attributes that point to such parts are
a prior only: such a branch goes unless its importance, measured as a whole, reaches
``named_importance``. That is the mean of its content importance and its presentation
importance, which is the same measure over the element kinds (tag and class) below
the branch; paragraphs, headings, list items and cells are judged by content alone.
A name says nothing where it tells what an element has ("has-sidebar"), on the
outermost article or main element, and above the only such elements of a page.

The entropy is taken over the host's pages that have the node, from two pages on, and
blended with that over all pages of all hosts that have it: with m pages of its own, a
host's importance weighs (m - 1) / m. Any other node goes
if the importance of its content stays under ``min_importance``. A page with an
article or main element is reduced to that branch; nodes inside it go alike, but not
where they hold half of the branch's text or more: that is a copy, not a notice.

Only distinct (host, page signature, node, hash) rows and their counts are grouped,
so one host with a third of all pages is spread over all tasks; the blocks of a page stay in
one row and meet the list of unimportant paths of their host in a join that AQE
splits where a host is large.

Defined cases: null, empty and text-free html give an empty text; a url without a
host counts to the host ""; unclosed and misnested tags are closed as browsers do
for paragraphs and list items; repeated rows are extracted each; an empty table
gives an empty result. Other columns are not returned.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship_package

# Element kinds of HTML.
DROPPED = frozenset("script style noscript template iframe object svg canvas head title nav footer aside form button "
                    "select textarea input label dialog menu".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
MAIN = frozenset(("article", "main"))
# Words of class, id and role attributes that name parts beside the main text.
ASIDE_WORDS = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie "
                        "cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices "
                        "popup promo promoted related reply replies respond share sharing sidebar signup social sponsor "
                        "sponsored subscribe toolbar widget widgets complementary contentinfo search".split())
# Words before such a word that make it tell what an element has, not what it is.
HAVING = frozenset("has have with without no hide show".split())
# Kinds that hold text rather than parts.
TEXT_KINDS = tuple("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption caption".split())
CLOSED_BY = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main "
                            "nav ol p pre section table ul li".split()),
             "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")),
             "tr": frozenset(("tr",)), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")),
             "option": frozenset(("option",))}
SCOPE = frozenset(("ul", "ol", "dl", "table", "article", "main", "section", "div", "nav", "aside", "footer", "header", "body"))

_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                    r"|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)|([^<]+|<)", re.S)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in RAW}
_NAMING = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORD = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


@dataclass(frozen=True)
class StyleTree:
    min_importance: float = 0.35
    #: From here on a branch stays although its name points beside the main text.
    named_importance: float = 0.7


def _names(attributes: str) -> str:
    found = [_CAMEL.sub(" ", m.group(1).strip("\"'")) for m in _NAMING.finditer(attributes)] if "=" in attributes else []
    return ".".join(_WORD.findall(" ".join(found).lower()))


def _named_aside(tag: str, names: str) -> bool:
    if not names or tag in ("html", "body"):
        return False
    words = names.split(".")
    return any(w in ASIDE_WORDS and not (k and words[k - 1] in HAVING) for k, w in enumerate(words))


def blocks(page: str | None) -> list[tuple[str, bool, bool, str, str]]:
    """(path, inside article or main, set aside, text, branch) of each block with text, in page order.

    ``branch``: path of the outermost element that is set aside by its name; empty
    where none is, or where the kind alone sets the block aside.
    """
    out: list[tuple[str, bool, bool, str, str, str]] = []
    # tag, path, in main, set aside by kind, branch named above article and main, branch named inside them
    stack: list[tuple[str, str, bool, bool, str, str]] = [("", "", False, False, "", "")]
    text: list[str] = []
    at = stack[0]

    def flush() -> None:
        if text:
            joined = " ".join(_SPACE.sub(" ", html.unescape("".join(text))).split(" ")).strip()
            text.clear()
            if joined:
                out.append((at[1], at[2], at[3], joined, at[4], at[5]))

    def finished() -> list[tuple[str, bool, bool, str, str]]:
        free = any(main and not (kind or upper or inner) for _, main, kind, _, upper, inner in out)
        done = []
        for path, main, kind, joined, upper, inner in out:
            branch = "" if kind else inner if main and not free else upper or inner
            done.append((path, main, kind or bool(branch), joined, branch))
        return done

    def leave(k: int) -> None:
        if any(x[0] not in INLINE for x in stack[k:]):
            flush()
        del stack[k:]

    page, pos = page or "", 0
    while pos < len(page):
        m = _PIECE.match(page, pos)
        pos = m.end()
        close, tag, attributes, chars = m.groups()
        if chars is not None:
            if not text:
                at = next(x for x in reversed(stack) if x[0] not in INLINE)
            text.append(chars)
        elif tag is None:
            continue
        elif close:
            tag = tag.lower()
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if k and (tag not in INLINE or all(x[0] in INLINE for x in stack[k:])):
                leave(k)
        else:
            tag = tag.lower()
            if tag == "br":
                text.append(" ") if text else None
                continue
            if tag not in INLINE:
                flush()
            for name, by in CLOSED_BY.items():
                if tag in by:
                    k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name
                              or stack[i][0] in SCOPE), 0)
                    if k and stack[k][0] == name:
                        leave(k)
            if tag in VOID:
                continue
            _, path, in_main, aside, upper, inner = stack[-1]
            names = _names(attributes)
            named = _named_aside(tag, names) and (in_main or tag not in MAIN)
            if tag in INLINE and not named:
                stack.append((tag, path, in_main, aside, upper, inner))
            else:
                if tag in INLINE:
                    flush()
                    tag = f"{tag}*"
                step = f"{path}>{tag}.{names}" if names else f"{path}>{tag}"
                if named and in_main:
                    inner = inner or step
                elif named:
                    upper = upper or step
                stack.append((tag, step, in_main or tag in MAIN,
                              aside or tag in DROPPED or (tag == "header" and not in_main), upper, inner))
            if tag in RAW and not attributes.rstrip().endswith("/"):
                end = _RAW_END[tag].search(page, pos)
                pos = end.start() if end else len(page)
    flush()
    return finished()


PARSED = "id long, url string, host string, blocks array<struct<path:string,main:boolean,aside:boolean,text:string,branch:string>>"
_BLOCK = pa.struct([("path", pa.string()), ("main", pa.bool_()), ("aside", pa.bool_()), ("text", pa.string()),
                    ("branch", pa.string())])
_HOST = re.compile(r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]*)")


def parse_pages(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """One row per page with its blocks."""
    ship_package(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts = [(m.group(1).lower() if u and (m := _HOST.match(u)) else "") for u in b.column(1).to_pylist()]
            found = [[dict(zip(_BLOCK.names, x)) for x in blocks(p.as_py())] for p in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.string()), pa.array(hosts, pa.string()),
                                              pa.array(found, pa.list_(_BLOCK))], names=["id", "url", "host", "blocks"])

    return pages.select(F.col(id_col).cast("long").alias("id"), F.col("url"), F.col("html")).mapInArrow(run, PARSED)


def _by_kind(b: Column) -> Column:
    """Whether the kind of an element alone sets a block aside."""
    return b["aside"] & (b["branch"] == "")


def importance(parsed: DataFrame, p: StyleTree = StyleTree()) -> DataFrame:
    """(host, path, named, pages, importance): the nodes of each host's style tree.

    ``named``: a branch that its name sets aside, judged as a whole. Pages with an
    article or main element count by that branch only. ``pages`` are the host's pages
    with the node, pages of equal text once. A node on one page of all hosts has the
    importance 1, or 0 if it is named.
    """
    has_main = F.exists("blocks", lambda b: b["main"] & ~b["aside"])
    asked = F.filter("blocks", lambda b: ~_by_kind(b) & (b["main"] | ~has_main))
    own_text = F.transform(F.filter("asked", lambda b: ~b["aside"]), lambda b: b["text"])
    all_text = F.transform("asked", lambda b: b["text"])
    pages = (parsed.select("host", asked.alias("asked"))
             .select("host", F.xxhash64(F.when(F.size(own_text) > 0, own_text).otherwise(all_text)).alias("page"),
                     F.explode("asked").alias("b")))
    named = F.col("b.branch") != ""
    node = F.when(named, F.col("b.branch")).otherwise(F.col("b.path"))
    below = F.when(named, F.xxhash64(F.substring("b.path", F.char_length("b.branch") + 1, F.char_length("b.path"))))
    # what is counted: 0 the page itself, 1 a text, 2 an element kind below a named branch
    items = F.array(F.struct(F.lit(0).alias("what"), F.lit(0).cast("long").alias("item")),
                    F.struct(F.lit(1).alias("what"), F.xxhash64("b.text").alias("item")),
                    F.struct(F.lit(2).alias("what"), below.alias("item")))
    seen = (pages.select("host", "page", node.alias("path"), named.alias("named"), F.explode(items).alias("x"))
            .select("host", "page", "path", "named", "x.what", "x.item").where(F.col("item").isNotNull()).distinct()
            .groupBy("host", "path", "named", "what", "item").agg(F.count(F.lit(1)).alias("n")))
    seen = materialize(seen, "style_counts")
    def nodes(counts: DataFrame, keys: list[str], of: str) -> DataFrame:
        """The mean of n ln n / n over the occurrences of a node's texts and element kinds."""
        mean = lambda k: F.sum(F.when(F.col("what") == k, F.col("n") * F.log("n"))) / F.sum(
            F.when(F.col("what") == k, F.col("n")))
        return counts.groupBy(*keys).agg(mean(1).alias(f"{of}_texts"), mean(2).alias(f"{of}_kinds"),
                                         F.sum(F.when(F.col("what") == 0, F.col("n"))).alias(f"{of}_pages"))

    tag = F.regexp_extract("path", r">([^>.*]*)[^>]*$", 1)

    def value(of: str) -> Column:
        m = F.greatest(F.col(f"{of}_pages"), F.lit(2))
        one = lambda c: F.greatest(F.lit(0.0), 1.0 - F.col(c) / F.log(m))
        texts = one(f"{of}_texts")
        return F.when(F.col("named") & ~tag.isin(*TEXT_KINDS), (texts + one(f"{of}_kinds")) / 2).otherwise(texts)

    own = nodes(seen, ["host", "path", "named"], "own")
    whole = nodes(seen.groupBy("path", "named", "what", "item").agg(F.sum("n").alias("n")), ["path", "named"], "whole")
    weight = (F.col("own_pages") - 1) / F.col("own_pages")
    judged = (F.when(F.col("whole_pages") > 1, weight * value("own") + (1.0 - weight) * value("whole"))
              .when(F.col("named"), 0.0).otherwise(1.0))
    return own.join(whole, ["path", "named"]).select("host", "path", "named", F.col("own_pages").alias("pages"),
                                                     judged.alias("importance"))


def extract(pages: DataFrame, id_col: str = "page_id", p: StyleTree = StyleTree()) -> DataFrame:
    """(id, url, host, text): the main text of each page, its blocks joined by line feeds in page order."""
    parsed = materialize(parse_pages(pages, id_col), "page_blocks", "zstd")
    poor = ~F.col("named") & (F.col("importance") < p.min_importance)
    rich = F.col("named") & (F.col("importance") >= p.named_importance)
    judged = importance(parsed, p).where(poor | rich).groupBy("host").agg(
        F.collect_set(F.when(poor, F.col("path"))).alias("poor"), F.collect_set(F.when(rich, F.col("path"))).alias("rich"))
    none = F.array().cast("array<string>")
    listed = parsed.join(materialize(judged, "judged_paths"), "host", "left").withColumns(
        {"poor": F.coalesce("poor", none), "rich": F.coalesce("rich", none)})

    def beside(b: Column) -> Column:
        return b["aside"] & ~F.array_contains(F.col("rich"), b["branch"])

    def repeats(b: Column) -> Column:
        return ~b["aside"] & F.array_contains(F.col("poor"), b["path"])

    def chars(found: Column) -> Column:
        return F.aggregate(found, F.lit(0).cast("long"), lambda n, b: n + F.char_length(b["text"]))

    has_main = F.exists("blocks", lambda b: b["main"] & ~beside(b))
    asked = listed.select("id", "url", "host", "poor", "rich", has_main.alias("has_main"), F.filter(
        "blocks", lambda b: ~beside(b) & (b["main"] | ~has_main)).alias("asked"))
    repeated = F.filter("asked", repeats)
    copy = F.col("has_main") & (2 * chars(repeated) >= chars(F.col("asked")))
    kept = F.when(copy, F.col("asked")).otherwise(F.filter("asked", lambda b: ~repeats(b)))
    return asked.select("id", "url", "host", F.array_join(F.transform(kept, lambda b: b["text"]), "\n").alias("text"))


def extraction_report(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html")).select(
        F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))
