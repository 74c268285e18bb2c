"""Main text of web pages by equivalence classes of template tokens (after Arasu and Garcia-Molina).

A page's tokens are its block elements, told apart by their paths, and its text chunks. A token's occurrence vector over the
pages of its host is kept as one number, the sum over pages of count x a hash of the page, so that tokens share a vector where
they share the number, and sums are combined before any shuffle. Tokens of a host with one vector are an equivalence class; it
is valid if enough pages have it and it holds more than one token. Valid classes nest by their paths into the host's template:
an element belongs to it if its parent does, a chunk if the element around its own does. The template's chunks are fixed and
dropped on all pages of the host; what varies lies in its slots, a slot being the innermost template element around a chunk.

On hosts with a template (LEAST_PAGES pages of different texts), each slot is judged once, by what all pages have in it, and
its verdict holds on every page:
- it goes if most of its text lies in elements that are by tag or role a menu, header, footer, sidebar, advert, form or script,
  or reader comments by tag, role or class;
- it goes if most of its text lies in elements with a telling class or id, unless that would leave hardly any text of the host
  (UNTOLD): then the class names are not telling there;
- it goes if most of its text is links, unless it is an article's or a heading, or lies below an element that holds plain
  paragraphs of its own;
- all other slots stay, whatever their length: a headline, a lead, a table.
Where a host has no template, the elements' tags, roles and classes decide on each page, and nothing else is left out.

A form, and an element that only its class or id tells of, are looked through where they hold more than half of a page's plain
text and two paragraphs or headings: a page may be one form as a whole, an article may be called a popup. A class tells by its
own name, or by its last part (site-footer), or by its first before a word for a box (ad-slot); not otherwise (notice-period).

The templates are written, one row a host. Up to BROADCAST_BYTES of them are broadcast, so that pages are not shuffled and a
hot host is no task's alone; beyond that they meet the pages by a join on the host, whose hot keys Spark splits.

Cases: null or empty html: empty text; null url: no host, so no template. Unclosed, misnested and cut-off markup is read as
far as it goes. Repeated pages count as often as they occur. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from zlib import crc32

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.common import map_batches, read, written

#: Pages of a host that make a template, and the share of them that its tokens are on; the share of a host's plain text below which class names are not telling.
LEAST_PAGES, SUPPORT, UNTOLD = 4, 0.5, 0.1
#: Bytes of all templates, as JSON, that are broadcast.
BROADCAST_BYTES = 8 << 20
#: Elements that are a paragraph of the one around them, and headings.
PARAGRAPH, HEADING = re.compile(r"(p|li|td|th|tr|dd|dt|blockquote|pre)\b"), re.compile(r"h[1-6]\b")
#: Names that mark what is not main text: fixed values.
DROPPED = frozenset("nav footer aside script style noscript template button select iframe textarea svg head title object canvas menu".split())
WORDS = frozenset("ad ads advert advertisement adverts banner promo sponsor sponsored cookie cookies consent notice notices alert popup modal overlay newsletter subscribe sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead share sharing social related recommended comment comments reply replies disqus widget login signup toolbar".split())
COMMENTS = frozenset("comment comments reply replies disqus".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog menu menubar".split())
FORMS = frozenset("form dialog".split())
BOXES = frozenset("area bar block body bottom box button container content form group head inner item items left link links list main outer panel posts right section slot text title top unit wrap wrapper".split())
RAW = ("script", "style", "noscript", "textarea", "template", "title", "svg", "iframe")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose start closes an open one of their kind.
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCKS_CLOSE_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def tells(names: str, words: frozenset) -> bool:
    """Whether one of some class names or ids is one of words, ends with one, or begins with one and ends with a word for a box."""
    for name in names.split():
        parts = [x for x in re.split(r"[^a-z]+", name) if x]
        if parts and (parts[-1] in words or parts[0] in words and parts[-1] in BOXES):
            return True
    return False


def marks(name: str, attributes: str) -> tuple[str, int, bool]:
    """An element's name in paths (with its first class), how it is marked (2 by tag, role or as comments, 1 by another class or
    id, 0 not at all), and whether it may be looked through: a form, or what only a class tells of."""
    if not attributes:
        return name, 2 * (name in DROPPED or name in FORMS), name in FORMS
    found = {k.lower(): (a or b or c).lower() for k, a, b, c in ATTRIBUTE.findall(attributes)}
    names = f"{found.get('class', '')} {found.get('id', '')}" if name not in ("html", "body", "article", "main") else ""
    first = found.get("class", "").split()
    path = f"{name}.{first[0]}" if first else name
    if name in DROPPED or found.get("role") in ROLES or tells(names, COMMENTS):
        return path, 2, False
    if name in FORMS or found.get("role") in FORMS:
        return path, 2, True
    out = int(tells(names, WORDS))
    return path, out, bool(out)


class Chunk:
    """A block's text: path of its elements, how it is marked, whether it is in an article, whether all of it is in links."""

    __slots__ = ("path", "out", "article", "text", "linked")

    def __init__(self, path: tuple, out: int, article: bool, text: str, linked: bool) -> None:
        self.path, self.out, self.article, self.text, self.linked = path, out, article, text, linked


def chunks(page: str | None, elements: dict | None = None) -> list[Chunk]:
    """The blocks of a page that hold text, in order. elements, if given, gets the count of each path."""
    found: list[Chunk] = []
    stack: list[tuple[str, str, bool, bool, tuple]] = []  # name, name in paths, marked for good, in an article, what may be looked through
    told: list[tuple[bool, tuple]] = []  # of each chunk: marked for good, and the last of these
    whole = 0  # plain text that is not marked for good
    parts: list[tuple[str, bool]] = []
    links = 0
    page = page or ""

    def flush() -> None:
        nonlocal whole
        if parts:
            text = " ".join(entities.unescape("".join([t for t, _ in parts])).split())
            if text:
                hard, article, soft = stack[-1][2:] if stack else (False, False, ())
                linked = all(linked or not t.strip() for t, linked in parts)
                found.append(Chunk(tuple([s[1] for s in stack]), 0, article, text, linked))
                told.append((hard, soft))
                if not hard and not linked:
                    whole += len(text)
                    for held in soft:
                        held[1] += len(text)
                        held[2] += bool(stack) and bool(PARAGRAPH.match(stack[-1][0]) or HEADING.match(stack[-1][0]))
            parts.clear()

    at = 0
    for m in MARKUP.finditer(page):
        if m.start() < at:  # inside script or style
            continue
        if m.start() > at:
            parts.append((page[at : m.start()], links > 0))
        at = m.end()
        closing, name = m[1], (m[2] or "").lower()
        if not name:
            continue
        if name == "a":
            links = max(0, links + (-1 if closing else 1))
        if name in INLINE and (closing or name not in RAW):
            continue
        if name == "br":
            parts.append((" ", False))
            continue
        flush()
        if closing:
            if any(s[0] == name for s in stack):
                while stack.pop()[0] != name:
                    pass
                links = 0
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID:
            continue
        shut = CLOSES.get(name, frozenset())
        while stack and (stack[-1][0] in shut or stack[-1][0] == "p" and name in BLOCKS_CLOSE_P):
            stack.pop()
        path_name, out, through = marks(name, m[3])
        outer = stack[-1] if stack else ("", "", False, False, ())
        if name == "header" and not outer[3]:
            out, through = 2, False
        soft = (*outer[4], [out, 0, 0]) if through else outer[4]
        stack.append((name, path_name, outer[2] or out == 2 and not through, outer[3] or name in ("article", "main"), soft))
        if elements is not None:
            path = tuple([s[1] for s in stack])
            elements[path] = elements.get(path, 0) + 1
    if at < len(page):
        parts.append((page[at:], links > 0))
    flush()
    for chunk, (hard, soft) in zip(found, told, strict=True):
        chunk.out = 2 if hard else max([out for out, chars, blocks in soft if 2 * chars <= whole or blocks < 2], default=0)
    return found


def host_of(url) -> str | None:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    return m[1].lower() if m else None


def text_token(c: Chunk) -> str:
    return "T" + "\x1f".join(c.path) + "\x1e" + xxhash.xxh3_64_hexdigest(c.text)


def tokens(url, page) -> tuple[list[tuple], int]:
    """Rows (host, token, count, chars, linked, marked 1, marked 2, in articles) of a page: elements by path, texts by path and text,
    and what each path holds; and one bit by its texts that are not marked 2."""
    elements: dict = {}
    own = chunks(page, elements)
    out: dict = {"E" + "\x1f".join(path): [n, 0, 0, 0, 0, 0] for path, n in elements.items()}
    for c in own:
        out.setdefault(text_token(c), [0] * 6)[0] += 1
        n = len(c.text)
        held = out.setdefault("S" + "\x1f".join(c.path), [0] * 6)
        for i, x in enumerate((1, n, n * c.linked, n * (c.out == 1), n * (c.out == 2), n * c.article)):
            held[i] += x
    texts = xxhash.xxh3_64_intdigest("\x1e".join([c.text for c in own if c.out < 2]))
    host = host_of(url)
    return [(host, k, *v) for k, v in out.items()] if host else [], 1 << texts % 63


def within(path: tuple, tree: set[tuple]) -> tuple:
    """The slot of a path: the innermost of the elements around it, itself included, that the template has."""
    return next(path[:i] for i in range(len(path), -1, -1) if path[:i] in tree)


def template(rows: list[tuple], pages: int, seen: int) -> tuple[list[str], list[str], dict[str, bool]]:
    """Fixed chunks, elements, and by slot whether it stays, of a host: rows (token, vector, pages that have it, bits of their texts, chars, linked,
    marked 1, marked 2, in articles), pages of the host and bits of their texts. All empty if the host has no template."""
    if pages < LEAST_PAGES or seen.bit_count() < LEAST_PAGES:
        return [], [], {}
    need = max(LEAST_PAGES, SUPPORT * pages)
    classes: dict[int, list] = defaultdict(list)
    held: list[tuple] = []
    fixed_chars: dict[tuple, int] = defaultdict(int)
    for token, vector, support, bits, *sums in rows:
        path = tuple(token[1:].split("\x1e")[0].split("\x1f")) if token[1:] else ()
        if token[0] == "S":
            held.append((path, *sums))
        elif support >= need and (token[0] == "E" or bits.bit_count() >= LEAST_PAGES):
            classes[vector].append((token, path))
    valid = [t for members in classes.values() if len(members) > 1 for t in members]
    tree: set[tuple] = {()}
    for path in sorted((p for t, p in valid if t[0] == "E"), key=len):
        if path[:-1] in tree:
            tree.add(path)
    fixed = sorted(t for t, p in valid if t[0] == "T" and p[:-1] in tree)
    for t in fixed:
        fixed_chars[tuple(t[1:].split("\x1e")[0].split("\x1f"))] += 1
    slots: dict[tuple, list] = defaultdict(lambda: [0] * 5)
    plain: set[tuple] = set()  # elements with paragraphs of their own that are neither links nor fixed
    for path, chars, linked, *rest in held:
        own = slots[within(path, tree)]
        for i, x in enumerate((chars, linked, *rest)):
            own[i] += x
        if 2 * linked < chars and path not in fixed_chars and not any(map(HEADING.match, path)):
            plain.add(path[:-1] if path and PARAGRAPH.match(path[-1]) else path)
    told = [sum(s[0] - s[1] for s in slots.values() if 2 * s[3] <= s[0] and (2 * s[2] > s[0]) == by) for by in (False, True)]
    telling = told[0] >= UNTOLD * sum(told)

    def stays(path, chars, linked, soft, hard, article):
        if 2 * hard > chars or telling and 2 * (soft + hard) > chars:
            return False
        return 2 * linked <= chars or 2 * article > chars or any(map(HEADING.match, path)) or any(path[:i] in plain for i in range(len(path) + 1))

    join = "\x1f".join
    return fixed, sorted(map(join, tree)), {join(p): stays(p, *s) for p, s in sorted(slots.items()) if s[0]}


def templates(pages: DataFrame) -> DataFrame:
    """One row for each host with a template: host, fixed and tree array<string>, slots map<string, boolean>."""
    sums = ["chars", "linked", "soft", "hard", "article"]

    def make(batch):
        rows = []
        for url, page_html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            key = crc32(f"{url}\n{len(page_html or '')}".encode()) or 1
            key = key * 0x9E3779B1 % (1 << 40)
            own, bit = tokens(url, page_html)
            rows += [(host, token, n * key % (1 << 40), 1, bit, *more) for host, token, n, *more in own]
            if host_of(url):
                rows.append((host_of(url), "", 0, 1, bit, 0, 0, 0, 0, 0))
        columns = list(zip(*rows, strict=True)) or [()] * 10
        return dict(zip(("host", "token", "vector", "pages", "seen", *sums), map(list, columns), strict=True))

    each = map_batches(pages.select("url", "html"), make, "host string, token string, vector bigint, pages bigint, seen bigint, " + ", ".join(f"{x} bigint" for x in sums))
    # Sums of vectors stay below 2^63: parts of 2^40 from as many as 2^23 rows are cut down in each step.
    added = [F.sum(F.col("vector").cast("decimal(38,0)")).alias("vector"), F.sum("pages").alias("pages"), F.bit_or("seen").alias("seen"), *[F.sum(x).alias(x) for x in sums]]
    summed = each.groupBy("host", "token").agg(*added).where(F.col("pages") >= LEAST_PAGES)
    summed = written(summed.withColumn("vector", F.pmod("vector", F.lit(1 << 62).cast("decimal(38,0)")).cast("bigint")), "html-tokens")
    hosts = summed.where("token = ''").select("host", F.col("pages").alias("of"), F.col("seen").alias("bits"))
    often = summed.where("token <> ''").join(hosts, "host").where(F.col("pages") >= F.when(F.col("token").startswith("S"), SUPPORT / 10).otherwise(SUPPORT) * F.col("of"))
    grouped = often.groupBy("host").agg(F.max("of").alias("of"), F.max("bits").alias("bits"), F.collect_list(F.struct("token", "vector", "pages", "seen", *sums)).alias("rows"))

    def deduce(batch):
        columns = [batch.column(i).to_pylist() for i in range(4)]
        found = [template([tuple(r.values()) for r in rows], of, bits) for _, of, bits, rows in zip(*columns, strict=True)]
        return {"host": columns[0]} | {name: [f[i] for f in found] for i, name in enumerate(("fixed", "tree", "slots"))}

    return map_batches(grouped, deduce, "host string, fixed array<string>, tree array<string>, slots map<string, boolean>").where(F.size("tree") > 0)


def main_text(page: str | None, fixed: set[str], tree: set[tuple], slots: dict[tuple, bool]) -> str:
    """What varies in the template's slots that stay. Chunks in no slot that the template judged, and all chunks where there
    is no template (an empty tree), stay if they are not marked."""
    kept = []
    for c in chunks(page):
        stays = slots.get(within(c.path, tree)) if tree else None
        if not c.out if stays is None else stays and text_token(c) not in fixed:
            kept.append(c.text)
    return " ".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page, and whether its host's template decided it."""
    host = F.lower(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)).alias("host")
    found = written(templates(pages), "html-templates")
    size = found.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()[0]
    joined = pages.select("page_id", "url", "html", host).join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "host", "left")
    path = lambda name: tuple(name.split("\x1f")) if name else ()

    def make(batch):
        read = lambda name: batch.column(name).to_pylist()
        known: dict = {}
        texts = []
        for name, page, fixed, tree, slots in zip(*map(read, ("host", "html", "fixed", "tree", "slots")), strict=True):
            if name not in known:
                known[name] = set(fixed or ()), set(map(path, tree or ())), {path(k): v for k, v in slots or ()}
            texts.append(main_text(page, *known[name]))
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "by_template": [bool(t) for t in read("tree")]}

    return map_batches(joined, make, "page_id bigint, url string, text string, by_template boolean")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"), "by_template")
