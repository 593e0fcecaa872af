"""Main text of web pages by equivalence-class template deduction.

Pages of one host share a template. Every page is cut into tokens: opening and closing tags
with the path of their elements, and whole text blocks. The occurrence vector of a token
lists how often each page of the host has it; tokens with equal vectors form an equivalence
class. Vectors are compared by an order-free hash that is summed up in parallel, so that no
host is gathered anywhere. Classes of several tokens on at least half of the pages are
valid when their tags pair up; classes whose tokens occur once a page are the skeleton and the
others nest between its tokens. What lies between template tokens are slots. The text of a
page is what its slots hold, without those inside menus, headers, footers and the like,
and without text that is itself part of the template.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from headgrid.llm.common import arrow_map, stored

#: A template token is on this share of the host's pages, on two pages, and in a class of this size.
SHARE, LEAST_PAGES, LEAST_TOKENS = 0.5, 2, 3
#: Different tokens that a task counts before it hands the counts on.
HELD_TOKENS = 200_000

# Element names and the words in class, id and role that mark what is not the article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead "
    "title tr ul".split()
)
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
DROPPED = set(
    "aside audio canvas datalist dialog footer form head iframe input map menu nav noscript object script search select style svg template "
    "textarea title video xmp".split()
)
MARKS = set(
    "ad ads adv advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie "
    "cookies dialog disqus footer gdpr masthead menu menubar modal nav navbar navigation navigation newsletter notice notices notification overlay "
    "pager pagination popup promo promoted promotion recommended related replies reply respond share sharing sidebar signup social sponsor sponsored "
    "subscribe toolbar widget widgets".split()
)
MAIN_MARKS = set("article articlebody main".split())
#: Parts of a class name that may stand beside a mark: `site-footer` is a mark, `has-sidebar` and `comments-open` are not.
BESIDE = set(
    "area bar block bottom box container content fixed global group holder inner item items left list main major minor outer page panel primary region "
    "right row secondary section site sticky top unit wrap wrapper".split()
)
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"<]*\"|'[^'<]*')*+(?=>|\Z)|[^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
HOST = re.compile(r"^\s*(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", re.I)


def host_of(url: str | None) -> str:
    found = HOST.match(url or "")
    return found[1].lower() if found else ""


class Element:
    """An open element. ``barred``: dropped whatever it holds; ``marked``: the numbers of the marks it stands in."""

    __slots__ = ("tag", "path", "barred", "marked", "main", "paragraph")

    def __init__(self, tag, path, barred, marked, main, paragraph):
        self.tag, self.path, self.barred, self.marked, self.main, self.paragraph = tag, path, barred, marked, main, paragraph

    @property
    def dropped(self) -> bool:
        return self.barred or bool(self.marked)


def _is_mark(name: str) -> bool:
    """Whether a whole class, id or role names what is not the article."""
    parts = [p for p in re.split(r"[-_0-9]+", name) if p]
    return any(p in MARKS for p in parts) and all(p in MARKS or p in BESIDE for p in parts)


def _element(tag: str, attributes: str, above: Element | None, number: int, spared: frozenset) -> Element:
    label, words, hidden = tag, set(), False
    if attributes and not attributes.isspace():
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), (a or b or c).lower()
            if name == "hidden":
                hidden = True
            elif name == "style":
                hidden = hidden or bool(HIDDEN.search(value))
            else:
                words.update(value.split())
                if name in ("class", "id"):
                    label += "." + re.sub(r"[^a-z\-_ ]+", "", value)
    within = above.main if above else False
    main = within or tag in ("article", "main") or bool(words & MAIN_MARKS and tag in ("div", "section"))
    paragraph = tag == "p" or bool(above and above.paragraph)
    barred = (
        (above.barred if above else False)
        or tag in DROPPED
        or hidden
        or tag == "header" and not within
        or tag == "button" and not paragraph
    )
    marked = above.marked if above else ()
    if not barred and number not in spared and tag not in ("html", "body", "main", "article"):
        if any(map(_is_mark, words)) or "header" in words and not within:
            marked = (*marked, number)
    return Element(tag, f"{above.path if above else ''}/{label}", barred, marked, main, paragraph)


def parse(html: str | None) -> list[tuple[int, str, str, bool, bool]]:
    """Tokens of a page in order: (kind, path, text, dropped, main); kind is 1 for an opening tag, 2 for a closing one, 0 for a text block.

    Closing tags that are missing are implied as browsers do for paragraphs, items and cells. If all the
    article and main elements of a page stand in marked elements, the marks around the first do not count.
    Beside an article elsewhere they do: reader comments are often article elements.
    """
    out, around = _tokens(html, frozenset())
    if around and not any(kind == 0 and main for kind, _, _, _, main in out):
        out, _ = _tokens(html, frozenset(around))
    return out


def _tokens(html: str | None, spared: frozenset) -> tuple[list[tuple[int, str, str, bool, bool]], tuple]:
    """Tokens of a page, and the marks around its first marked article or main element."""
    html = html or ""
    out: list[tuple[int, str, str, bool, bool]] = []
    stack: list[Element] = []
    held: list[str] = []
    place: Element | None = None
    around: tuple = ()

    def flush():
        if held:
            text = " ".join(unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((0, place.path if place else "", text, False, bool(place and place.main)))

    def text_of(raw):
        nonlocal place
        if not raw:
            return
        top = stack[-1] if stack else None
        if top is not None and top.dropped:
            return
        if not held or place is None:
            place = next((e for e in reversed(stack) if e.tag in BLOCK), None)
        held.append(raw)

    def pop(n):
        while len(stack) > n:
            gone = stack.pop()
            out.append((2, gone.path, "", gone.dropped, gone.main))

    at, end, number = 0, len(html), 0
    while at < end:
        found = TAG.search(html, at)
        if not found:
            text_of(html[at:])
            break
        text_of(html[at : found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag, closing = tag.lower(), found[1]
        if tag == "br":
            if held:
                held.append(" ")
            continue
        if tag in BLOCK:
            flush()
        if closing:
            n = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag), None)
            if n is not None:
                pop(n)
            continue
        if tag in BLOCK:  # a paragraph ends where a block begins
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == "p":
                    pop(i)
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in ENDS:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in ENDS[tag]:
                    pop(i)
                    break
                if stack[i].tag in SCOPES[tag]:
                    break
        number += 1
        element = _element(tag, found[3], stack[-1] if stack else None, number, spared)
        if tag in VOID:
            continue
        if tag in ("article", "main") and element.marked and not element.barred and not around:
            around = element.marked
        out.append((1, element.path, "", element.dropped, element.main))
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b", re.I).search(html, at)
            at = close.start() if close else end
            if not close:
                break
        if found[0].endswith("/>") and tag in ("svg", "path", "use"):
            out.append((2, element.path, "", element.dropped, element.main))
        else:
            stack.append(element)
    flush()
    pop(0)
    return out, around


def _name(kind: int, path: str, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind} {path}\0{text}".encode("utf-8", "surrogatepass"), 1)


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


# Template of each host


def count_tokens(pages: DataFrame) -> DataFrame:
    """(host, token, vector, pages, times, pair) summed by task; token 0 counts the pages. ``pages``: page_key, host, html."""

    def run(batches):
        def table(held):
            rows = [(h, _signed(t), _signed(v[0]), v[1], v[2], _signed(v[3])) for (h, t), v in held.items()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), [pa.string()] + [pa.int64()] * 5)],
                names=["host", "token", "vector", "pages", "times", "pair"],
            )

        held: dict[tuple[str, int], list[int]] = {}
        for batch in batches:
            for key, host, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
                page: dict[tuple[int, int], int] = {(0, 0): 1}
                for kind, path, text, _, _ in parse(html):
                    name = _name(kind, path, text), (_name(3 - kind, path, "") if kind else 0)
                    page[name] = page.get(name, 0) + 1
                for (name, pair), n in page.items():
                    sums = held.setdefault((host, name), [0, 0, 0, pair])
                    sums[0] ^= xxhash.xxh64_intdigest(f"{key} {n}")
                    sums[1] += 1
                    sums[2] += n
            if len(held) > HELD_TOKENS:
                yield table(held)
                held = {}
        if held:
            yield table(held)

    return arrow_map(pages, run, "host string, token long, vector long, pages long, times long, pair long")


def host_templates(pages: DataFrame) -> DataFrame:
    """(host, skeleton, nested): tokens of the valid classes that occur once a page, and those of the others."""
    sums = count_tokens(pages).groupBy("host", "token").agg(
        F.bit_xor("vector").alias("vector"), F.sum("pages").alias("pages"), F.sum("times").alias("times"), F.max("pair").alias("pair")
    )
    sums = stored(sums.where((F.col("pages") >= LEAST_PAGES) | (F.col("token") == 0)), "tokens")
    totals = sums.where("token = 0").select("host", F.col("pages").alias("all_pages"))
    common = sums.where("token <> 0").join(totals, "host").where(F.col("pages") >= F.col("all_pages") * SHARE)
    classes = common.groupBy("host", "vector", "pages", "times").agg(F.collect_list(F.struct("token", "pair")).alias("members"))
    names = F.transform("members", lambda m: m["token"])
    paired = F.forall("members", lambda m: (m["pair"] == 0) | F.array_contains(names, m["pair"]))
    valid = classes.where((F.size("members") >= LEAST_TOKENS) & paired)
    once = F.col("times") == F.col("pages")
    return valid.groupBy("host").agg(
        F.flatten(F.collect_list(F.when(once, names))).alias("skeleton"), F.flatten(F.collect_list(F.when(~once, names))).alias("nested")
    )


def slots(html: str | None, skeleton: set[int], nested: set[int]) -> list[tuple[int, bool, bool, str]]:
    """(slot, main, constant, text) of the text blocks; the slot counts skeleton tokens passed, constant blocks are template."""
    out, slot, seen = [], 0, set()
    for kind, path, text, dropped, main in parse(html):
        name = _signed(_name(kind, path, text))
        if name in skeleton and name not in seen:
            slot += 1
            seen.add(name)
        if kind == 0 and not dropped:
            out.append((slot, main, name in skeleton or name in nested, text))
    return out


def main_text(html: str | None, skeleton: set[int], nested: set[int]) -> str:
    """Text of the slots inside the main elements, or of all remaining slots if a page has none.

    Template text is left out, inside the main elements only if it is less than what is left: else it is a copied article.
    """
    found = slots(html, skeleton, nested)
    inside = [(constant, text) for _, main, constant, text in found if main]
    if inside:
        own = [text for constant, text in inside if not constant]
        return "\n".join(own if 2 * sum(map(len, own)) > sum(len(text) for _, text in inside) else [text for _, text in inside])
    return "\n".join([text for _, _, constant, text in found if not constant] or [text for _, _, _, text in found])


def extract_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", keep: tuple[str, ...] = ()
) -> DataFrame:
    """id, url, ``keep`` and text of every row of ``pages``.

    Text inside elements that are no part of an article (by tag, or by a whole name in class, id or role, unless
    that would leave no article or main element) is left out;
    text that is part of the host's template is left out too, unless it is most of the main element's text.

    * A null html is an empty page; its text is empty, as is that of pages without an article's text.
    * Pages without a readable host in their url, or with a null url, count as one host. A host with
      a single page has no template; its page is judged by its elements alone.
    * Repeated rows and null ids stay, one output row each; an empty table gives an empty result.
    * Unclosed, truncated and nested-wrong markup is read as far as it goes. Other columns are not read.
    """
    names = [f"keep_{i}" for i in range(len(keep))]

    def with_host(batches):
        for batch in batches:
            hosts = pa.array([host_of(u) for u in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, hosts], names=[*batch.schema.names, "host"])

    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), *[F.col(c).alias(n) for c, n in zip(keep, names)]
    )
    types = dict(rows.dtypes)
    hosted = arrow_map(rows, with_host, ", ".join(f"{c} {types[c]}" for c in rows.columns) + ", host string")
    templates = host_templates(hosted.select(F.xxhash64("id", "url", "html").alias("page_key"), "host", "html"))
    joined = hosted.join(stored(templates, "templates"), "host", "left")

    def run(batches):
        known: dict[str, tuple[set, set]] = {}
        for batch in batches:
            out = []
            for host, html, skeleton, nested in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "skeleton", "nested"))):
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[host] = set(skeleton or ()), set(nested or ())
                out.append(main_text(html, *known[host]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "url", *names)), pa.array(out, pa.string())], names=["id", "url", *names, "text"]
            )

    out = ", ".join(f"{c} {types[c]}" for c in ("id", "url", *names)) + ", text string"
    found = arrow_map(joined, run, out)
    return found.toDF(id_col, url_col, *keep, "text")
