"""Main text of web pages by template deduction over the pages of a host.

A page is read as tokens: elements, named by their path and marks, and runs of text, named by
their path and wording. Over the pages of a host each token has an occurrence vector, its count
on every page. Tokens with equal vectors form a class. A class is valid if it is on a few
pages of the host and hangs below one other class; valid classes nested in one another are the
template of the host, or of each layout that the host has. What the template does not hold are slots. A text stands in
the slot of its nearest template element. Left out, on every page, are slots that consist of links,
slots that say little beside the best one of their class, which is on the same pages, and wording
that belongs to the template itself: a slot that holds nothing else on a page. The names of elements
are hints that rank slots: a slot named as an advert, notice, menu and the like is left out unless
its text outranks all others of the host, and one in article or main ranks above others.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.decontam import measured
from panelwright.session import materialise

FEW = 3  # distinct pages that an element must be on, or SHARE of those of a small host
SHARE = 0.5  # of the pages with a slot that its constant wording is on
REPEATED = 0.9  # a slot with more of its text in wording that PAGES share says nothing of its own
PAGES = 5  # fewer distinct pages of a host cannot tell constant wording from an article's
LINKED = 0.5  # a slot with more of its text in links is a menu
WEIGHTS = (0.02, 1, 5, 10)  # of text in a slot named as aside, without a hint, in main, in article
LOW = 0.01  # rank of a slot outside article and main, against the best of its class, that is too little for text of its own
FAINT = 0.02  # weight of constant wording against other text when a page's slots are ranked

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<raw>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<marks>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<marks2>[^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
OPAQUE = set("script style textarea noscript iframe title xmp noembed template svg math object".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
DROPPED = set("head nav footer aside form button select option menu dialog fieldset audio video canvas datalist".split())
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
FLOW = HEADINGS | set("p li dt dd pre blockquote".split())  # text of the slot around it; except headings, if it has no marks
SIBLINGS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tbody", "thead"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
ASIDE = set(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion teaser "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer masthead topbar header toolbar "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "login comment comments commentlist disqus reply replies respond responses discussion share sharing social "
    "related recommended recommendations widget pagination pager search skip hidden copyright".split()
)
KEEPS = set("article main with has no".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())


def hidden(marks: dict[str, str]) -> bool:
    return "hidden" in marks or marks.get("aria-hidden") == "true" or "display:none" in marks.get("style", "").replace(" ", "").lower()


def aside(name: str, marks: dict[str, str], inside: bool) -> bool:
    """Whether an element looks like no part of the article, by its name, role, class and id."""
    if name in DROPPED or (name == "header" and not inside):
        return True
    if name in ("article", "main", "body", "html"):
        return name == "article" and bool({"comment", "comments", "reply"} & _parts(marks))
    if marks.get("role", "").lower() in ROLES:
        return True
    if "class" not in marks and "id" not in marks:
        return False
    parts = _parts(marks)
    found = parts & ASIDE
    if inside:
        found = found - {"header"}
    return bool(found) and not parts & KEEPS


def _parts(marks: dict[str, str]) -> set[str]:
    return {p.lower() for p in PART.findall(marks.get("class", "") + " " + marks.get("id", ""))}


def attributes(raw: str) -> dict[str, str]:
    return {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(raw)} if raw and not raw.isspace() else {}


class Element:
    __slots__ = ("name", "token", "out", "main", "inline", "linked", "flow", "quiet")

    def __init__(self, name: str, token: int, out: int, main: int, inline: bool, linked: bool, flow: bool, quiet: bool) -> None:
        self.name, self.token, self.out, self.main, self.inline, self.linked = name, token, out, main, inline, linked
        self.flow, self.quiet = flow, quiet


def read_page(page: str) -> tuple[dict[int, tuple[int, int]], list[tuple]]:
    """Elements {token: (count, parent)} and blocks (path of tokens, own token, text, linked, hint).

    The path ends with the element whose slot the text is in. hint is 3 inside article, 2 inside
    main, 0 inside elements named as asides, else 1; hidden text is left out. White space in a
    block becomes one space.
    """
    seen: dict[int, tuple[int, int]] = {}
    blocks: list[tuple] = []
    stack = [Element("", 0, 0, 0, False, False, False, False)]
    pieces: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            held = [e for e in stack if not e.inline]
            top = held[-1]
            while held[-1].flow:
                held.pop()
            if top.out < 2:
                blocks.append((tuple(e.token for e in held), top.token, text, min(linked, len(text)), 0 if top.out else 1 + top.main))
        pieces.clear()
        linked = 0

    def said(raw: str) -> None:
        nonlocal linked
        if raw and not stack[-1].quiet:
            text = entities.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if stack[-1].linked:
                linked += len(" ".join(text.split()))

    def close(upto: int) -> None:
        if any(not e.inline for e in stack[upto:]):
            flush()
        del stack[upto:]

    at, size = 0, len(page)
    while at < size:
        found = MARKUP.search(page, at)
        said(page[at : found.start()] if found else page[at:])
        if not found:
            break
        at = found.end()
        if found["raw"] is not None:
            said(found["raw"].replace("&", "&amp;"))
            continue
        name = (found["name"] or found["name2"] or "").lower()
        if not name:
            continue
        if found["end"] or found["end2"]:
            if name == "br":
                pieces.append(" ")
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    close(i)
                    break
                if name in INLINE and not stack[i].inline:
                    break
            else:
                if name == "p":
                    flush()
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name in OPAQUE:
            if not (found["marks"] or found["marks2"] or "").endswith("/") or name not in ("svg", "math"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else size
            continue
        inline = name in INLINE
        if name in VOID:
            if not inline:
                flush()
            continue
        if name in CLOSES_P:
            i = next((i for i in range(len(stack) - 1, 0, -1) if not stack[i].inline), 0)
            if i and stack[i].name == "p":
                close(i)
        if name in SIBLINGS:
            i = len(stack) - 1
            while i and stack[i].name not in SCOPE.get(name, ()):
                if stack[i].name in SIBLINGS[name]:
                    close(i)
                    break
                i -= 1
        if name == "body" and stack[-1].name == "head":
            close(len(stack) - 1)
        if not inline:
            flush()
        top = stack[-1]
        raw = found["marks"] or found["marks2"] or ""
        marks = attributes(raw) if len(raw) > 1 else {}
        out = top.out
        if out < 2 and marks and hidden(marks) or name == "head":
            out = 2
        elif not out and (marks or not inline) and aside(name, marks, top.main == 2):
            out = 1
        main = max(top.main, 2 if name == "article" else 1 if name == "main" or marks.get("role") == "main" else 0)
        token, flow = top.token, name in HEADINGS or name in FLOW and not marks.keys() & {"class", "id"}
        if not inline:
            label = f"{name}.{marks.get('class', '')}#{re.sub(r'[0-9]+', '0', marks.get('id', ''))}"
            token = xxhash.xxh64_intdigest(label.encode(), top.token) & (2**63 - 1)
            count, _ = seen.get(token, (0, 0))
            seen[token] = (count + 1, top.token)
        stack.append(Element(name, token, out, main, inline, top.linked or name == "a", flow, inline and (top.quiet or out > top.out)))
    flush()
    return seen, blocks


def wording(own: int, text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8"), own) & (2**63 - 1) | 1 << 62


TOKENS = "host string, token long, parent long, n int, chars long, linked long, hint int, wording boolean"


def page_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of TOKENS and the page's key, a row per distinct token of each page."""
    names = [c.split()[0] for c in TOKENS.split(", ")] + ["page"]
    for batch in batches:
        rows = []
        for host, key, page in zip(batch["host"], batch["key"], batch["html"]):
            seen, blocks = read_page(page)
            sizes: dict[int, list[int]] = {}
            said: dict[int, tuple[int, int, int]] = {}
            for path, own, text, linked, hint in blocks:
                slot = sizes.setdefault(path[-1], [0, 0, 0])
                slot[0] += len(text)
                slot[1] += linked
                slot[2] = max(slot[2], hint)
                words = wording(own, text)
                said[words] = (said.get(words, (0,))[0] + 1, path[-1], len(text))
            rows.append((host, 0, 0, 1, *sizes.get(0, (0, 0, -1)), False, key))
            for token, (count, parent) in seen.items():
                rows.append((host, token, parent, count, *sizes.get(token, (0, 0, -1)), False, key))
            for token, (count, parent, chars) in said.items():
                rows.append((host, token, parent, count, count * chars, 0, -1, True, key))
        yield pd.DataFrame(rows, columns=names)


def templates(pages: DataFrame) -> DataFrame:
    """(host, elements, menus, constant, raised, low): what the host's template says of its slots.

    pages holds host, key and html; key is of the content only. Copies of a page count once, as
    they tell nothing of what is constant, and equal rows would cancel each other. Occurrence vectors are folded into one number each by a
    combinable aggregate, so the pages of one host, however many, never meet in a task. Of the
    valid elements only menus and what hangs right below one are stored, as no others are asked
    for: a slot further down is told by the one of them that is nearest. raised are slots named
    as asides whose text outranks that of all others of the host. low are slots outside article and
    main that say too little beside the best slot of their own class; as a class is on the same
    pages throughout, no layout is measured by another.
    """
    tokens = pages.mapInPandas(page_tokens, TOKENS + ", page long")
    tokens = tokens.groupBy("host", "token", "wording").agg(
        F.bit_xor(F.xxhash64("page", "n")).alias("vector"),
        F.count(F.lit(1)).alias("pages"),
        F.min("parent").alias("parent"),
        F.sum("chars").alias("chars"),
        F.sum("linked").alias("linked"),
        F.max("hint").alias("hint"),
    )
    tokens = materialise(tokens, "page-tokens")
    hosts = tokens.filter((F.col("token") == 0) & ~F.col("wording")).select("host", F.col("pages").alias("all"))
    least = F.least(F.lit(float(FEW)), SHARE * F.col("all"))
    often = tokens.join(hosts, "host").filter(F.col("pages") >= F.when(F.col("wording"), F.lit(float(PAGES))).otherwise(least))
    often = materialise(often, "frequent-tokens")
    above = often.filter(~F.col("wording")).select(
        "host", F.col("token").alias("parent"), F.struct("vector", "pages").alias("above"), F.col("chars").alias("around")
    )
    placed = often.join(above, ["host", "parent"], "left").withColumn("own", F.struct("vector", "pages"))
    classes = placed.groupBy("host", "own").agg(
        F.count(F.lit(1)).alias("size"),
        F.count_distinct(F.when(~F.col("wording") & (F.col("above") != F.col("own")), F.col("above"))).alias("parents"),
    )
    # A class of elements hangs below at most one other; a lone element still parts the page.
    held = placed.join(classes, ["host", "own"]).filter((F.col("parents") <= 1) | F.col("wording"))
    # Wording is constant where its slot has it on most pages, whatever part of the host's pages
    # has that slot, or where the slot has little else than wording that pages share.
    said = held.filter("wording")
    shared = said.groupBy("host", "parent").agg(F.sum("chars").alias("shared"))
    constant = said.join(shared, ["host", "parent"]).filter(
        ((F.col("size") > 1) & (F.col("pages") >= SHARE * F.col("above.pages"))) | (F.col("shared") >= REPEATED * F.col("around"))
    )
    fixed = constant.groupBy("host", F.col("parent").alias("token")).agg(F.sum("chars").alias("fixed"))
    slots = held.filter(~F.col("wording")).join(fixed, ["host", "token"], "left")
    slots = slots.withColumn("menu", F.col("linked") > LINKED * F.col("chars"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), F.greatest("hint", F.lit(0)) + 1)
    slots = slots.withColumn("rank", F.greatest(F.col("chars") - F.col("linked") - F.coalesce("fixed", F.lit(0)), F.lit(0)) * weight)
    # Text outside the template, in no slot that is valid, is ranked as well.
    best = tokens.filter(~F.col("wording") & (F.col("hint") > 0))
    best = best.groupBy("host").agg(F.max((F.col("chars") - F.col("linked")) * weight).alias("best"))
    raised = slots.join(best, "host", "left").filter(
        (F.col("hint") == 0) & ~F.col("menu") & (F.col("pages") >= PAGES) & (F.col("rank") > 0) & (F.col("rank") >= F.coalesce("best", F.lit(0)))
    )
    leading = slots.groupBy("host", "own").agg(F.max("rank").alias("leading"))
    low = slots.join(leading, ["host", "own"]).filter((F.col("hint") <= 1) & (F.col("chars") > 0) & (F.col("rank") < LOW * F.col("leading")))
    menus = slots.filter("menu").select("host", "token")
    below = slots.filter("not menu").join(menus.withColumnRenamed("token", "parent"), ["host", "parent"])
    parts = [
        frame.select("host", "token", F.lit(kind).alias("kind"))
        for kind, frame in (("elements", below), ("menus", menus), ("constant", constant), ("raised", raised), ("low", low))
    ]
    said = reduce(DataFrame.union, parts)
    return said.groupBy("host").agg(*[F.collect_list(F.when(F.col("kind") == k, F.col("token"))).alias(k) for k in KINDS])


KINDS = ("elements", "menus", "constant", "raised", "low")


def main_text(
    page: str,
    elements: set[int],
    menus: set[int],
    constant: set[int],
    raised: set[int] = frozenset(),
    low: set[int] = frozenset(),
) -> str:
    """The text of the page's article slots, blocks joined by one space.

    Left out are slots named as asides, unless raised, menus, low slots, and slots that hold only
    constant wording on this page. Beside text of its own a slot's constant wording stays, such as a
    quotation that articles share. Where constant wording is the larger part of the slot that ranks
    highest on the page, the page is a near copy of others, and it stays in every slot.
    """
    _, blocks = read_page(page)
    kept, ranks = [], {}
    for path, own, text, linked, hint in blocks:
        slot = path[-1]
        if slot in low or hint == 0 and slot not in raised or next((t for t in reversed(path) if t in menus or t in elements), 0) in menus:
            continue
        fixed = wording(own, text) in constant
        kept.append((slot, text, fixed))
        rank = ranks.setdefault(slot, [0.0, 0, 0])
        rank[0] += (len(text) - linked) * (FAINT if fixed else 1) * WEIGHTS[hint]
        rank[1 + fixed] += len(text)
    top = max(ranks, key=lambda slot: ranks[slot][0], default=0)
    copied = top in ranks and ranks[top][1] < ranks[top][2]
    return " ".join(text for slot, text, fixed in kept if not fixed or copied or ranks[slot][1])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row.

    A null or empty html has an empty text. Pages without a readable host share the host "".
    Repeated rows have equal results, an empty table has none; other columns are not read.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    keyed = rows.select("host", "html").filter("html != ''").distinct().withColumn("key", F.xxhash64("html"))
    template = measured(templates(keyed), "templates")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple] = {}
        for batch in batches:
            texts = []
            for host, page, *tokens in zip(batch["host"], batch["html"], *[batch[k] for k in KINDS]):
                if host not in held:
                    if len(held) >= 1000:
                        held.clear()
                    held[host] = tuple(set(t) if t is not None else set() for t in tokens)
                texts.append(main_text(page, *held[host]))
            yield pd.DataFrame(
                {"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]}
            )

    joined = rows.join(template, "host", "left")
    return joined.mapInPandas(run, "page_id long, url string, text string, n_chars long")
