"""HTML extraction: main text without the templates of a site.

Every page is parsed once into text blocks and element subtrees. Subtrees are hashed and counted per host in Spark; one that
recurs on many pages of its host is template and goes. Elements whose tag or class says that they are menus, headers,
footers, sidebars, notices, adverts, forms or reader comments go at once, a class only by its whole name; inside an article or main element a class says so
only of adverts, menus, comments, share and related links and newsletters.
"""

from __future__ import annotations

import hashlib
import html as character_references
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermill.llm.url_filter import host_of
from ledgermill.session import materialise

#: A subtree is template if it is on so many different pages of a host and on such a share of them.
LEAST_PAGES, LEAST_SHARE = 10, 0.05
#: On hosts with few different pages it must be on half of them and on so many at least. Above so many the share falls with
#: the root of their number: chance does not repeat a text more often on a larger host, and menus have more variants there.
FEW_PAGES, MANY_PAGES = 3, 400
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CHROME = {"nav", "footer", "aside", "form", "head", "option", "dialog", "menu"}
#: Controls and media inside a line: they go with what they hold, and the text around them stays one block.
INLINE_CHROME = {"button", "select", "object", "canvas", "audio", "video"}
CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar"}
_PLACE = "(?:article|bottom|entry|footer|global|header|left|main|page|post|primary|right|secondary|site|social|top)"
_FORM = (r"(?:area|articles?|bars?|block|box|buttons?|container|form|icons?|inner|items?|links?|list|menu|message|outer|panel|posts?|section|signup|slot|"
         r"stories|unit|widget|wrapper|\d+)")
#: Outside article and main: a class or id that is such a word, with words of place before and of form after it. A longer name
#: that only holds one (has-sidebar, no-comments, notice-text) says nothing of its element.
CHROME_NAME = re.compile(
    rf"(?:^|\s)(?:{_PLACE}[_-])*(?:ads?|adverts?|advertisements?|advertising|banner|promo|promoted|sponsor|sponsored|nav|navbar|navigation|menu|menus|breadcrumbs?|"
    r"sidebar|footer|masthead|topbar|cookies?|consent|gdpr|notice|notices|notification|alert|popup|modal|overlay|"
    r"newsletter|subscribe|signup|login|share|sharing|social|related|recommended|comments?|commentlist|disqus|replies|respond|search|pagination|pager|skip|widget)"
    rf"(?:[_-](?:notice|consent|banner|{_FORM}))*(?:$|\s)|(?:^|\s)(?:site[_-])?(?:header|head|foot|side)(?:$|\s)", re.I)
#: Inside them: names that are such a word, with words of place before and of form after it.
CLEAR_NAME = re.compile(
    r"(?:^|\s)(?:(?:article|entry|page|post|site|social)[_-])*(?:ads?|adverts?|advertisements?|advertising|nav|navbar|navigation|comments?|commentlist|disqus|"
    r"share|sharing|related|newsletter)(?:[_-](?:area|articles?|bars?|block|box|buttons?|container|form|icons?|items?|links?|list|menu|posts?|section|signup|slot|"
    r"stories|unit|widget|wrapper|\d+))*(?:$|\s)", re.I)
#: Elements that begin and end a block of text.
BLOCKS = {"address", "article", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4",
          "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
          *CHROME, "fieldset"}
#: Elements of which recurring subtrees count as template. Paragraphs, headings and items of an article are never judged so
#: by themselves: near copies of a page would lose what they share, and a title may recur.
CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "figure", "details", "header", "center", "blockquote"}
CLOSES_P = BLOCKS - {"body", "html"}


def _is_chrome(tag: str, attributes: str, inside_article: bool) -> bool:
    if tag in CHROME or (tag == "header" and not inside_article):
        return True
    for name, value in ATTRIBUTE.findall(attributes):
        value = value.strip("\"'").lower()
        name = name.lower()
        if name == "role" and value in CHROME_ROLES or name == "style" and "display:none" in value.replace(" ", ""):
            return True
        if name in ("class", "id") and tag not in ("html", "body", "main", "article") and (CLEAR_NAME if inside_article else CHROME_NAME).search(value):
            return True
        if name in ("class", "id") and tag == "article" and re.search(r"(?:^|[\s_-])comments?(?:$|[\s_-])", value):
            return True
    return False


def _hash(parts: Iterable[str]) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def parse(html: str | None) -> tuple[list[tuple[str, bool, list[int]]], list[int]]:
    """Blocks of text, whether an article or main element is around each and the hashes of the judged subtrees around it, and
    all judged hashes of the page. Missing end tags are closed by their parents, by the next block or by the end of the page.
    """
    html = html or ""
    blocks: list[list] = []             # text, inside article, open judged elements
    stack: list[list] = []              # tag, chrome above or here, judged index or None, content hash parts, in an article
    judged: list = []                   # hash of each judged subtree, in order of its start
    text: list[str] = []

    def flush() -> None:
        value = " ".join(character_references.unescape("".join(text)).split())
        text.clear()
        if value and not (stack and stack[-1][1]):
            blocks.append([value, bool(stack) and stack[-1][4], [s[2] for s in stack if s[2] is not None]])

    def close(to: int) -> None:
        while len(stack) > to:
            if stack[-1][0] in BLOCKS:
                flush()
            tag, _, index, parts, _ = stack.pop()
            content = _hash(parts)
            if index is not None:
                judged[index] = content
            if stack:
                stack[-1][3].append(f"<{tag}>{content}")

    at, size = 0, len(html)
    while at < size:
        found = TAG.search(html, at)
        piece = html[at:found.start()] if found else html[at:]
        if piece:
            text.append(piece)
            if stack:
                stack[-1][3].append(piece.strip())
        if not found:
            break
        at = max(found.end(), at + 1)
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if stack[i][0] in ("article", "main", "table") and tag not in ("body", "html", "article", "main", "table"):
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else size
            continue
        if tag in INLINE_CHROME:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else at           # without an end only the tag goes
            text.append(" ")
            continue
        if tag == "br" or tag in VOID:
            if tag == "br":
                text.append(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p" or (tag == "li" and stack[i][0] == "li"):
                    close(i)
                    break
                if stack[i][0] in BLOCKS:
                    break
            flush()
        inside = bool(stack) and stack[-1][4]
        chrome = bool(stack and stack[-1][1]) or _is_chrome(tag, found[3], inside)
        index = None
        if tag in CONTAINERS or chrome and tag in BLOCKS or (tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li") and not inside):
            index = len(judged)
            judged.append(0)
        if not found[0].endswith("/>") or tag in BLOCKS:
            stack.append([tag, chrome, index, [], inside or tag in ("article", "main")])
    flush()
    close(0)
    flush()
    return [(b[0], b[1], [judged[i] for i in b[2]]) for b in blocks], sorted(set(judged))


def parse_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, host, blocks (array of text, inside, subtrees), subtrees, content (hash of the texts of the blocks)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.list_(pa.struct([("text", pa.string()), ("inside", pa.bool_()), ("subtrees", pa.list_(pa.int64()))]))
        for batch in batches:
            found = [parse(h.as_py()) for h in batch.column(3)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([[{"text": t, "inside": i, "subtrees": s} for t, i, s in f[0]] for f in found], block),
                 pa.array([f[1] for f in found], pa.list_(pa.int64())), pa.array([_hash(b[0] for b in f[0]) for f in found], pa.int64())],
                names=["page_id", "url", "host", "blocks", "subtrees", "content"])
    return pages.select(F.col("page_id").cast("long"), "url", host_of(F.col("url")).alias("host"), "html").mapInArrow(
        run, "page_id long, url string, host string, blocks array<struct<text:string,inside:boolean,subtrees:array<bigint>>>, subtrees array<bigint>, content long")


def least_recurrence(pages: Column, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> Column:
    """On how many different pages of a host with so many a subtree must be to be template."""
    few = F.least(F.lit(float(least_pages)), F.greatest(F.lit(float(FEW_PAGES)), pages / 2))
    return F.greatest(few, F.least(pages * least_share, F.sqrt(pages * MANY_PAGES) * least_share))


def templates(parsed: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """host, subtree, pages of the subtrees that recur. Pages of equal content count once, so copies of a page do not make
    its own text recur. Counts are combined before the shuffle, so a subtree on every page of a host with a third of all
    pages is still one row per task. The page itself is counted as a null subtree; only what recurs is kept for the join."""
    each = parsed.select("host", "content", F.explode(F.concat("subtrees", F.array(F.lit(None).cast("bigint")))).alias("subtree")).distinct()
    counts = materialise(each.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("pages"))
                         .where(F.col("subtree").isNull() | (F.col("pages") >= min(FEW_PAGES, least_pages))))
    hosts = counts.where(F.col("subtree").isNull()).select("host", F.col("pages").alias("host_pages"))
    return (counts.where(F.col("subtree").isNotNull()).join(hosts, "host")
            .where(F.col("pages") >= least_recurrence(F.col("host_pages"), least_pages, least_share)).select("host", "subtree", "pages"))


def main_blocks(blocks: Column) -> Column:
    """The blocks inside article and main elements if they hold most of the text, else all."""
    def length(these: Column) -> Column:
        return F.aggregate(these, F.lit(0), lambda n, b: n + F.char_length(b["text"]))
    inside = F.filter(blocks, lambda b: b["inside"])
    return F.when(2 * length(inside) > length(blocks), inside).otherwise(blocks)


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """page_id, url, text: the blocks of the main text joined by two line breaks, in page order.

    Null or empty html: empty text. Null url: its pages share the host "". Repeated rows all stay, but count once as template; equal
    page_ids with different urls are kept apart by host. Extra columns are not read; an empty table gives an empty one.
    Templates go first, then what is outside articles if those hold most of the rest. Pages without a judged subtree around
    their blocks pass by the join.
    """
    parsed = parse_pages(pages)
    inner = F.array_distinct(F.flatten(F.transform("blocks", lambda b: b["subtrees"])))
    plain = parsed.where(F.size(inner) == 0)
    asked = parsed.where(F.size(inner) > 0)
    hits = (asked.select("page_id", "host", F.explode(inner).alias("subtree")).distinct()
            .join(templates(parsed, least_pages, least_share), ["host", "subtree"])
            .groupBy("page_id", "host").agg(F.collect_set("subtree").alias("_drop"))          # of one page
            .select(F.col("page_id").alias("_page"), F.col("host").alias("_host"), "_drop"))
    judged = asked.join(hits, asked["page_id"].eqNullSafe(hits["_page"]) & (asked["host"] == hits["_host"]), "left").withColumn(
        "blocks", F.filter("blocks", lambda b: F.col("_drop").isNull() | ~F.arrays_overlap(b["subtrees"], F.col("_drop"))))
    both = plain.select("page_id", "url", "blocks").unionByName(judged.select("page_id", "url", "blocks"))
    return both.withColumn("blocks", main_blocks(F.col("blocks"))).select("page_id", "url", F.array_join(F.transform("blocks", lambda b: b["text"]), "\n\n").alias("text"))


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
