"""Main text of web pages with wrappers inferred per host: union-free regular expressions over block tokens.

A page is cut into blocks of text, each with the path of elements above it. Its token stream is the sequence of paths.
Streams of one host are aligned one after another into a wrapper: equal tokens match; a token that one side lacks becomes
optional; runs of a token, or of a group of up to GROUP tokens, become repeated; a text that differs becomes a slot, one
that is the same on all pages stays constant. Constants are the host's template.

The text of a page is its article (or, without one, its main element, or else its body) without elements whose name is
boilerplate (nav, footer, form and the like), and without what the host's wrapper shows to be template: its constants,
wherever they are, and its marked slots. A slot is marked if an element around it has a class, id or role word such as
sidebar or comments, and the same element with the same word stands on several pages of the host; a marked element that
one page only has is content. Hosts with fewer than LEAST_PAGES different texts give no such evidence: there the words
decide alone. A page whose articles all lie in marked elements keeps them.

Wrappers are folded per task, so a host with a third of all pages gives one small row per task; those are merged in two
rounds of groups. The constants of all hosts travel with the function only if they are few; else they are joined by host.

Edge cases: null html is empty; a null url is the host ""; pages of a host with fewer than LEAST_PAGES different
texts lose no constants, as copies of one text do not tell it from a template; unclosed elements end with their parent, unclosed comments and scripts with the page.
"""

from __future__ import annotations

import json
import re
import zlib
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.arrowio import bounded
from spanloom.llm.common import saved

GROUP, MOST_ITEMS, MOST_DEPTH, LEAST_PAGES = 6, 200, 80, 3
SHIP_BYTES = 16 << 20
#: Cells up to which alignment fills a whole table.
TABLE = 1 << 16
#: Element names.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp"}
DROPPED = RAW | {"nav", "footer", "aside", "form", "svg", "canvas", "object", "button", "select", "dialog", "menu", "head", "fieldset", "math"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "meter", "output",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
#: Words of class, id and role that mark boilerplate.
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu",
    "breadcrumb", "breadcrumbs", "sidebar", "footer", "contentinfo", "complementary", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "newsletter", "subscribe",
    "subscription", "signup", "login", "search", "share", "sharing", "social", "related", "recommended", "comment", "comments", "disqus", "replies", "reply", "popup",
    "modal", "overlay", "widget", "pagination", "pager", "toolbar", "copyright", "masthead", "topbar", "responses", "discussion", "respond", "skyscraper", "leaderboard",
}
#: Beginnings and ends of such words.
STARTS = ("advert", "cookie", "sidebar", "newsletter", "breadcrumb", "navbar", "sponsor", "promo", "popup", "commentlist", "commentform")
ENDS = ("nav", "navbar", "sidebar", "menu", "footer", "banner", "comments", "popup", "newsletter", "advert")
COMMENT = {"comment", "comments", "reply", "replies"}
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*)>""")
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def mark_of(name: str, attrs: str, inside: bool) -> str:
    """The word by which an element looks like boilerplate, or ""; ``inside`` an article or main element a header is part of it."""
    if not attrs or name in ("html", "body", "main"):
        return ""
    words = {w for _, a, b, c in ATTR.findall(attrs) for w in re.split(r"[^a-z0-9]+", (a or b or c).lower())}
    if name == "article":
        found = words & COMMENT
    else:
        found = words & MARKS or {w for w in words if w.startswith(STARTS) or w.endswith(ENDS) or (w == "header" and not inside)}
    return min(found, default="")


#: (path, place, text, mark, pieces): place 2 in an article, 1 in main, 0 elsewhere in the body, -1 in a dropped element; mark
#: names the marked element around it, or is ""; pieces are (mark, text) where marks differ within the block, else None.
Block = tuple[str, int, str, str, tuple | None]


def blocks(html: str) -> list[Block]:
    """The page's blocks in order.

    An article or main element that begins gives a block without text, so that an empty one counts. Paths name the first
    MOST_DEPTH elements; deeper ones open and close alike.
    """
    out: list[Block] = []
    stack: list[tuple[str, int, str, str]] = [("", 0, "", "")]
    inline: list[tuple[str, str, int]] = []  # marked inline elements: name, mark, depth of the stack
    plain: dict[str, int] = {}  # inline elements that opened without a mark inside of marked ones of that name
    pieces: list[tuple[str, str]] = []
    at, n = 0, len(html)

    opened: dict[str, int] = {}

    def close_from(i: int) -> None:
        for x in stack[i:]:
            opened[x[0]] -= 1
        del stack[i:]
        while inline and inline[-1][2] > len(stack):
            inline.pop()

    def add(text: str) -> None:
        pieces.append((stack[-1][3] or (inline[-1][1] if inline else ""), text))

    def flush() -> None:
        if pieces:
            text = " ".join("".join(t for _, t in pieces).split())
            if text:
                marks = {m for m, t in pieces if t.strip()}
                out.append((stack[-1][2], stack[-1][1], text, min(marks) if len(marks) == 1 else "", tuple(pieces) if len(marks) > 1 else None))
            pieces.clear()

    while at < n:
        left = html.find("<", at)
        if left < 0:
            left = n
        if left > at:
            text = html[at:left]
            add(unescape(text) if "&" in text else text)
        if left >= n:
            break
        follow = html[left + 1 : left + 2]
        if follow and follow in "!?":
            close = html.find("-->", left + 4) if html.startswith("<!--", left) else html.find(">", left)
            at = n if close < 0 else close + (3 if html.startswith("<!--", left) else 1)
            continue
        tag = TAG.match(html, left) or LOOSE.match(html, left)
        if not tag:
            add("<")
            at = left + 1
            continue
        at = tag.end()
        closing, name, attrs = tag[1], tag[2].lower(), tag[3]
        if name in INLINE and name not in VOID:
            if closing and plain.get(name):
                plain[name] -= 1
            elif closing and inline and inline[-1][0] == name:
                inline.pop()
            elif not closing and (word := mark_of(name, attrs, stack[-1][1] > 0)):
                inline.append((name, f"{stack[-1][2]}/{name}.{word}", len(stack)))
                plain[name] = 0
            elif not closing and inline and inline[-1][0] == name:
                plain[name] = plain.get(name, 0) + 1
            continue
        if name in VOID:
            if name in ("br", "hr"):
                flush()
            continue
        if closing:
            for i in range(len(stack) - 1, 0, -1) if opened.get(name) else ():
                if stack[i][0] == name:
                    flush()
                    close_from(i)
                    break
            continue
        if name in RAW:
            end = re.compile(f"</{name}", re.I).search(html, at)
            at = n if not end else html.find(">", end.end()) + 1 or n
            flush()
            continue
        flush()
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
            peers = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(name, (name,))
            stop = {"ul", "ol", "dl", "table", "article", "main", "body", "blockquote", "section", "div"} if name != "p" else set()
            for i in range(len(stack) - 1, 0, -1) if any(map(opened.get, peers)) else ():
                if stack[i][0] in peers:
                    close_from(i)
                    break
                if stack[i][0] in stop or stack[i][0] not in ("p", "b") and name == "p" and stack[i][0] not in INLINE:
                    break
        _, place, path, mark = stack[-1]
        below = f"{path}/{name}" if len(stack) < MOST_DEPTH else path
        if place >= 0:
            word = mark_of(name, attrs, place > 0)
            if name in DROPPED or (name == "header" and place == 0):
                place = -1
            else:
                mark = mark or (f"{below}.{word}" if word else "")
                if name == "article":
                    place = 2
                elif place == 0 and (name == "main" or "role" in attrs and re.search(r"role\s*=\s*[\"']?main\b", attrs)):
                    place = 1
                if place > stack[-1][1]:
                    out.append((path, place, "", mark, None))
        stack.append((name, place, below, mark))
        opened[name] = opened.get(name, 0) + 1
    flush()
    return out


def text_hash(text: str) -> int:
    data = text.encode("utf-8", "surrogatepass")
    return (zlib.crc32(data) << 31 | zlib.adler32(data) & 0x7FFFFFFF) or 1


#: A wrapper's item: [key, repeated, optional, hash of the constant text or 0 for a slot, items of a group].
Item = list


def fold(items: list[Item]) -> list[Item]:
    """Repeated neighbours become one repeated item, repeated neighbouring groups one repeated group."""
    out: list[Item] = []
    for item in items:
        if out and out[-1][0] == item[0]:
            out[-1] = [item[0], True, out[-1][2] and item[2], 0, merge_items(out[-1][4], item[4])]
        else:
            out.append(item)
    for size in range(2, GROUP + 1):
        i = 0
        while i + 2 * size <= len(out):
            one, two = out[i : i + size], out[i + size : i + 2 * size]
            if [x[0] for x in one] == [x[0] for x in two]:
                inner = merge_items(one, two)
                out[i : i + 2 * size] = [["(" + " ".join(x[0] for x in one) + ")", True, False, 0, inner]]
                while out[i + 1 : i + 1 + size] and [x[0] for x in out[i + 1 : i + 1 + size]] == [x[0] for x in inner]:
                    inner = merge_items(inner, out[i + 1 : i + 1 + size])
                    out[i][4] = inner
                    del out[i + 1 : i + 1 + size]
            i += 1
    return out


def merge_items(one: list[Item], two: list[Item]) -> list[Item]:
    """Item by item, for streams with the same keys."""
    if not one or not two:
        return one or two
    return [[a[0], a[1] or b[1], a[2] or b[2], a[3] if a[3] == b[3] else 0, merge_items(a[4], b[4])] for a, b in zip(one, two, strict=True)]


def key_of(block: Block) -> str:
    path, place, _, mark, _ = block
    return f"{path}!" if place < 0 else f"{path}~{mark}" if mark else path


def stream(page: list[Block]) -> list[Item]:
    return fold([[key_of(b), False, False, text_hash(b[2]), []] for b in page if b[2]])


def marks_of(page: list[Block]) -> dict[str, int]:
    """The marks of a page's elements, each 1."""
    return {m: 1 for _, _, text, mark, pieces in page if text for m in ([x for x, _ in pieces] if pieces else [mark]) if m}


def more_marks(one: dict[str, int], two: dict[str, int]) -> dict[str, int]:
    """Pages that have a mark, at most 2."""
    return {m: min(2, one.get(m, 0) + two.get(m, 0)) for m in one.keys() | two.keys()}


def align(one: list[Item], two: list[Item]) -> list[Item]:
    """The wrapper of both: the longest common subsequence of keys matches, other items become optional."""
    a, b = [x[0] for x in one], [x[0] for x in two]
    if a == b:
        return merge_items(one, two)
    numbers: dict[str, int] = {}
    x, y = (np.array([numbers.setdefault(k, len(numbers)) for k in keys], np.int64) for keys in (a, b))
    out, i, j = [], 0, 0
    for p, q in [*common(x, y), (len(a), len(b))]:
        out += [[x[0], x[1], True, x[3], x[4]] for x in [*one[i:p], *two[j:q]]]
        if p < len(a):
            out += merge_items([one[p]], [two[q]])
        i, j = p + 1, q + 1
    return cut_items(fold(out))


def lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of x and each beginning of y."""
    row = np.zeros(len(y) + 1, np.int64)
    for v in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(y == v, row[:-1] + 1, 0)))
    return row


def common(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Places of a longest common subsequence; long sequences are halved, so memory grows with their length only."""
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    head = int(differ[0]) if len(differ) else n
    if head:
        return [*((i, i) for i in range(head)), *((i + head, j + head) for i, j in common(x[head:], y[head:]))]
    if not n:
        return []
    if len(x) * len(y) > TABLE and len(x) > 1:
        half = len(x) // 2
        cut = int(np.argmax(lengths(x[:half], y) + lengths(x[half:][::-1], y[::-1])[::-1]))
        return common(x[:half], y[:cut]) + [(i + half, j + cut) for i, j in common(x[half:], y[cut:])]
    a, b = x.tolist(), y.tolist()
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(len(b) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if a[i] == b[j] else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def cut_items(items: list[Item]) -> list[Item]:
    """Beyond MOST_ITEMS items, each run of optional ones becomes one repeated wildcard; items of all pages stay, which are
    at most as many as the shortest page has."""
    if len(items) <= MOST_ITEMS:
        return items
    out: list[Item] = []
    for item in items:
        if not item[2]:
            out.append(item)
        elif not out or out[-1][0] != "*":
            out.append(["*", True, True, 0, []])
    return out


def as_regex(items: list[Item]) -> str:
    """The wrapper as text: path with its constant's hash or #, then ? if optional and + if repeated."""
    part = lambda x: ("(" + as_regex(x[4]) + ")" if x[4] else x[0] + (f"={x[3]:x}" if x[3] else "#")) + "+" * x[1] + "?" * x[2]
    return " ".join(map(part, items))


def constants(items: list[Item], texts: int) -> list[int]:
    """Hashes of (key, text) of the constants outside of dropped elements that all pages of the host have, given how many
    different texts, up to LEAST_PAGES, the pages have."""
    if texts < LEAST_PAGES:
        return []
    return [pair_hash(x[0], x[3]) for x in items if x[3] and not x[1] and not x[2] and not x[0].endswith("!") and not x[4]]


def pair_hash(path: str, text: int) -> int:
    return (text * 31 + zlib.crc32(path.encode())) & 0x7FFFFFFFFFFFFFFF


def mark_hash(mark: str) -> int:
    return pair_hash("~", text_hash(mark))


def page_text(page: list[Block], template: frozenset | None) -> str:
    """The page's text, given the hashes of its host's constants and marked slots; None if the host has too few pages."""
    gone = {m for m in marks_of(page) if template is None or mark_hash(m) in template}
    opened = [m for _, p, t, m, _ in page if p > 0 and not t]
    if opened and all(m and (template is None or mark_hash(m) in template) for m in opened):
        gone -= set(opened)
        opened = []
    hidden = {m for m in opened if m and (template is None or mark_hash(m) in template)}
    place = max([0, *(p for _, p, t, m, _ in page if m not in gone and (t or m not in hidden))])
    out = []
    for block in page:
        path, p, text, mark, pieces = block
        if not text or p < place or mark in gone or (template and pair_hash(key_of(block), text_hash(text)) in template):
            continue
        if pieces and gone:
            text = " ".join("".join(t for m, t in pieces if m not in gone).split())
        if text:
            out.append(text)
    return "\n".join(out)


def least(hashes) -> list[int]:
    """The LEAST_PAGES least different ones: enough to tell whether there are so many, in any order of merging."""
    return sorted(set(hashes))[:LEAST_PAGES]


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


#: ``texts``: hashes of different texts, at most LEAST_PAGES. ``marks``: how many pages have a mark, at most 2.
WRAPPER = "host string, wrapper string, pages long, texts array<long>, marks string"
FIELDS = pa.schema([("host", pa.string()), ("wrapper", pa.string()), ("pages", pa.int64()), ("texts", pa.list_(pa.int64())), ("marks", pa.string())])


def merge_wrappers(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row per key: the alignment of its wrappers, in order of their text."""

    def run(table: pa.Table) -> pa.Table:
        items, pages, texts, marks = None, 0, [], {}
        for text, n, seen, marked in sorted(zip(*(table.column(c).to_pylist() for c in ("wrapper", "pages", "texts", "marks")), strict=True)):
            two = json.loads(text)
            items = two if items is None else align(items, two)
            pages, texts, marks = pages + n, least([*texts, *seen]), more_marks(marks, json.loads(marked))
        row = {"host": table.column("host")[0].as_py(), "wrapper": json.dumps(items), "pages": pages, "texts": texts, "marks": json.dumps(marks, sort_keys=True)}
        return pa.Table.from_pylist([row], FIELDS)

    return rows.groupBy(*key).applyInArrow(run, WRAPPER)


def infer(pages: DataFrame, hosts_held: int = 2000, items_held: int = 400000) -> DataFrame:
    """pages(url, html) -> host, wrapper (items as JSON), pages, texts, marks: one row per host."""

    def run(batches):
        held: dict[str, tuple[list[Item], int, list[int], dict[str, int]]] = {}
        size = 0

        def rows():
            columns = [[json.dumps(x[0]) for x in held.values()], [x[1] for x in held.values()], [x[2] for x in held.values()], [json.dumps(x[3], sort_keys=True) for x in held.values()]]
            return pa.RecordBatch.from_pydict(dict(zip(FIELDS.names, [list(held), *columns], strict=True)), FIELDS)

        for batch in batches:
            for host, html in zip(batch.column(0), batch.column(1), strict=True):
                page = blocks(html.as_py() or "")
                items, text, marks = cut_items(stream(page)), text_hash(page_text(page, None)), marks_of(page)
                known = held.get(host.as_py())
                if known:
                    held[host.as_py()] = align(known[0], items), known[1] + 1, least([*known[2], text]), more_marks(known[3], marks)
                else:
                    held[host.as_py()] = items, 1, [text], marks
                size += len(held[host.as_py()][0]) - (len(known[0]) if known else 0)
                if len(held) >= hosts_held or size >= items_held:
                    yield rows()
                    held.clear()
                    size = 0
        yield rows()

    parts = bounded(pages.select(host_of(F.col("url")).alias("host"), "html")).mapInArrow(run, WRAPPER)
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(64)).cast("int"))
    return merge_wrappers(merge_wrappers(salted, ["host", "salt"]), ["host"])


def templates(wrappers: DataFrame) -> DataFrame:
    """host, template array<long>: hashes of constants and of marks that several pages have, of hosts with enough pages."""

    def run(batches):
        for batch in batches:
            found = []
            for wrapper, texts, marks in zip(*batch.columns[1:], strict=True):
                slots = [mark_hash(m) for m, n in sorted(json.loads(marks.as_py()).items()) if n > 1]
                found.append(constants(json.loads(wrapper.as_py()), len(texts)) + slots if len(texts) >= LEAST_PAGES else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["host", "template"])

    return wrappers.select("host", "wrapper", "texts", "marks").mapInArrow(run, "host string, template array<long>").where("template IS NOT NULL")


def extract(pages: DataFrame, ship_bytes: int = SHIP_BYTES) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars: a row per row."""
    found = saved(templates(saved(infer(pages), "wrappers")), "templates")
    size = found.select(F.sum(F.octet_length("host") + 8 * F.size("template"))).first()[0] or 0
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    if size <= ship_bytes:
        shared = pages.sparkSession.sparkContext.broadcast({r.host: frozenset(r.template) for r in found.collect()})
        rows = rows.withColumn("template", F.lit(None).cast("array<long>"))
    else:
        shared = None
        rows = rows.join(found, "host", "left").select("page_id", "url", "html", "host", "template")

    def run(batches):
        for batch in batches:
            out = []
            for html, host, own in zip(batch.column(2), batch.column(3), batch.column(4), strict=True):
                template = shared.value.get(host.as_py()) if shared else None if own.as_py() is None else frozenset(own.as_py())
                out.append(page_text(blocks(html.as_py() or ""), template))
            texts = pa.array([t.encode("utf-8", "replace").decode() for t in out], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts, pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return bounded(rows).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op7(spark, sf_dir) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
