"""Main text of web pages: wrappers inferred per host as union-free regular expressions."""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from maskloom.llm.common import stored

_BLOCK = frozenset("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table
    tbody td tfoot th thead title tr ul""".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
#: What never holds main text, by element, role, or word of class or id.
_DROPPED = frozenset("""aside button datalist dialog footer form head header iframe menu nav noscript object script select
    style svg template textarea title""".split())
_DROPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
_DROPPED_WORDS = frozenset("""ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent
    cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices
    popup promo promotion reactions related replies reply respond search share sharing sidebar signup skyscraper social
    sponsor sponsored subscribe toolbar widget""".split())
_MAIN = frozenset("article main".split())
_MAIN_WORDS = frozenset("articlebody content entry main post story".split())
#: Opening one of these ends an open one of the group, up to the nearest of the fence.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
         "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
         "option": ({"option"}, {"select"})}
_FENCE = frozenset("table td th button object".split())

#: Ids that say what an element holds, as the whole id of anything but a heading.
_DROPPED_IDS = frozenset("comments disqus footer header masthead menu nav navbar navigation respond sidebar".split())

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_BARE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")


@dataclass(slots=True)
class Open:
    """An open element: its block elements as a path, and whether it stands in dropped or main parts."""
    name: str
    path: str
    dropped: bool
    main: bool


@dataclass(slots=True)
class Block:
    path: str
    text: str
    dropped: bool
    main: bool


def _open(name: str, attributes: str, parent: Open) -> Open:
    words: set[str] = set()
    dropped, main, label = name in _DROPPED, name in _MAIN, name
    if "=" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            value = (m[2] or m[3] or m[4] or "").lower()
            if m[1].lower() == "role":
                dropped = dropped or value in _DROPPED_ROLES
                main = main or value == "main"
                label = f"{label}@{value}"
            elif m[1].lower() == "id":
                dropped = dropped or (value in _DROPPED_IDS and name not in _HEADINGS)
                main = main or (value in _MAIN_WORDS and name in ("div", "section", "td"))
            else:
                words.update(_WORD.findall(value))
                if m[1].lower() == "class" and value:
                    label = f"{label}.{'.'.join(sorted(value.split()))}"
    if name not in _MAIN and name not in ("html", "body"):
        dropped = dropped or not words.isdisjoint(_DROPPED_WORDS)
        main = main or (not words.isdisjoint(_MAIN_WORDS) and name in ("div", "section", "td"))
    if name == "header" and parent.main and not parent.dropped:
        dropped = False  # of the article itself: its headings are text, see blocks()
    path = parent.path
    if name in _BLOCK:
        # The whole path at any depth: the last element, and a digest of those around it.
        path = f"{label}/{hashlib.blake2b(f'{path}>{label}'.encode(), digest_size=8).hexdigest()}"
    return Open(name, path, parent.dropped or dropped, parent.main or main)


def blocks(html: str) -> list[Block]:
    """The page's pieces of text in order, white space single, references decoded; time grows with the page's length."""
    stack = [Open("", "", False, False)]
    found: list[Block] = []
    buffer: list[str] = []
    tag = _TAG
    n_open: Counter[str] = Counter()
    byline = 0  # open header elements inside the article

    def flush() -> None:
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                top = stack[-1]
                head = byline and not any(o.name in _HEADINGS for o in stack)
                found.append(Block(top.path, text, bool(top.dropped or head), top.main))

    def close(at: int) -> None:
        nonlocal byline
        flush()
        byline -= sum(o.name == "header" for o in stack[at:])
        forget(at)

    def forget(at: int) -> None:
        n_open.subtract(o.name for o in stack[at:])
        del stack[at:]

    at, size = 0, len(html)
    while at < size:
        start = html.find("<", at)
        if start < 0:
            start = size
        if start > at:
            buffer.append(entities.unescape(html[at:start]))
        if start == size:
            break
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), start):
            end = html.find(">", start)
            at = size if end < 0 else end + 1
            continue
        if html[start + 1:start + 3].lstrip("/")[:1].isalpha() and html.find(">", start) < 0:
            break  # a tag that never ends takes the rest with it
        m = tag.match(html, start)
        if not m and tag is _TAG and html[start + 1:start + 2].isalpha():
            tag = _BARE_TAG  # a quote stays open up to the end: from here on quotes mean nothing
            m = tag.match(html, start)
        if not m:
            buffer.append("<")
            at = start + 1
            continue
        at = m.end()
        name = m[2].lower()
        if m[1]:
            if name == "br":
                buffer.append(" ")
            for depth in range(len(stack) - 1, 0, -1) if n_open[name] > 0 else ():
                if stack[depth].name == name:
                    if name in _BLOCK or any(o.name in _BLOCK for o in stack[depth:]):
                        close(depth)
                    else:
                        forget(depth)
                    break
            continue
        if name in _RAW:
            end = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(html, at)
            at = end.start() if end else size
            close_tag = html.find(">", at)
            at = size if close_tag < 0 else close_tag + 1
            continue
        if name == "br":
            buffer.append(" ")
            continue
        if name in _BLOCK:
            flush()
            group, fence = _ENDS.get(name, ({"p"}, _FENCE))
            if any(n_open[x] > 0 for x in group):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].name in group:
                        close(depth)
                        if name not in _ENDS or stack[-1].name not in group:
                            break
                    elif stack[depth].name in fence:
                        break
        if name not in _VOID and not m[3].endswith("/"):
            opened = _open(name, m[3], stack[-1])
            if name not in _BLOCK and opened.dropped and not stack[-1].dropped:
                flush()
            stack.append(opened)
            n_open[name] += 1
            byline += name == "header"
    flush()
    return found


# --- Wrappers ---------------------------------------------------------------------
# An item is [path with marks, digests of the texts that all its pages have there, optional, repeated, least page, greatest
# page]. Where no text is common it is a slot; the pages, as digests of all their texts, tell whether more than
# copies of one page have it. Marks: ! for parts that never are main text, * for parts that are said to be.

def _digest(text: str) -> str:
    return f"{zlib.crc32(text.encode()):08x}{len(text):x}"


def _marked(block: Block) -> str:
    return f"{block.path}{'!' * block.dropped}{'*' * block.main}"


def page_stream(page: list[Block]) -> tuple[list[list], list[int]]:
    """A page as a wrapper, neighbours of one path as one repeated item, and the item of each block."""
    whole = hashlib.blake2b("\n".join(b.text for b in page).encode(), digest_size=8).hexdigest()
    items: list[list] = []
    of = []
    for block in page:
        path = _marked(block)
        if items and items[-1][0] == path:
            items[-1][1].append(_digest(block.text))
            items[-1][3] = True
        else:
            items.append([path, [_digest(block.text)], False, False, whole, whole])
        of.append(len(items) - 1)
    out, places = folded(items)
    return out, [places[n] for n in of]


def folded(items: list[list]) -> tuple[list[list], list[int]]:
    """Groups of two to four items that come again at once as repeated items, and where each item went."""
    out: list[list] = []
    places: list[int] = []
    at = 0
    while at < len(items):
        for n in (2, 3, 4):
            if len(out) >= n and [i[0] for i in out[-n:]] == [i[0] for i in items[at:at + n]]:
                for old, new in zip(out[-n:], items[at:at + n]):
                    old[1] = old[1] + new[1]
                    old[3:] = True, min(old[4], new[4]), max(old[5], new[5])
                places += range(len(out) - n, len(out))
                at += n
                break
        else:
            places.append(len(out))
            out.append(list(items[at]))
            at += 1
    for item in out:
        item[1] = sorted(set(item[1]))
    return out, places


def aligned(a: list[list], b: list[list]) -> list[tuple[int | None, int | None]]:
    """Pairs of matching places in order; at a mismatch the side goes on that finds the other's path sooner."""
    places: tuple[dict[str, list[int]], dict[str, list[int]]] = (defaultdict(list), defaultdict(list))
    for side, items in zip(places, (a, b)):
        for n, item in enumerate(items):
            side[item[0]].append(n)

    def ahead(side: dict[str, list[int]], path: str, at: int) -> int | None:
        found = side.get(path, [])
        n = bisect_left(found, at)
        return found[n] if n < len(found) else None

    pairs: list[tuple[int | None, int | None]] = []
    i = j = 0
    while i < len(a) and j < len(b):
        if a[i][0] == b[j][0]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
            continue
        in_a, in_b = ahead(places[0], b[j][0], i), ahead(places[1], a[i][0], j)
        if in_a is not None and (in_b is None or in_a - i <= in_b - j):
            pairs += [(n, None) for n in range(i, in_a)]
            i = in_a
        elif in_b is not None:
            pairs += [(None, n) for n in range(j, in_b)]
            j = in_b
        else:
            pairs += [(i, None), (None, j)]
            i, j = i + 1, j + 1
    return pairs + [(n, None) for n in range(i, len(a))] + [(None, n) for n in range(j, len(b))]


def merged(a: list[list], b: list[list]) -> list[list]:
    """The wrapper of both: unmatched items are optional, texts that only one side has become slots."""
    out = []
    for i, j in aligned(a, b):
        if i is None or j is None:
            path, texts, _, *rest = a[i] if j is None else b[j]
            out.append([path, texts, True, *rest])
        else:
            x, y = a[i], b[j]
            common = x[1] if x[1] == y[1] else sorted(set(x[1]).intersection(y[1]))
            out.append([x[0], common, x[2] or y[2], x[3] or y[3], min(x[4], y[4]), max(x[5], y[5])])
    return folded(out)[0]


def as_expression(wrapper: list[list]) -> str:
    """A wrapper written as a union-free regular expression over paths."""
    parts = []
    for path, texts, optional, repeated, *_ in wrapper:
        part = f"{path}={'+'.join(texts) or '#slot'}"
        part = f"({part})+" if repeated else part
        parts.append(f"({part})?" if optional else part)
    return " ".join(parts)


def _host() -> Column:
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def host_wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON) for each host, learned from all its pages.

    Each task folds its own pages into one wrapper per host; those are merged in two
    steps, the first over shares of the tasks, so no task gets a host's pages or all
    partial wrappers of a large one.
    """
    limit = 5_000

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        known: dict[str, list[list]] = {}

        def out() -> pd.DataFrame:
            return pd.DataFrame({"host": list(known), "task": task, "share": task % 64,
                                 "wrapper": [json.dumps(w) for w in known.values()]})

        for batch in batches:
            for host, html in zip(batch["host"], batch["html"]):
                stream, _ = page_stream(blocks(html or ""))
                known[host] = merged(known[host], stream) if host in known else stream
            if len(known) > limit:
                yield out()
                known.clear()
        if known:
            yield out()

    def combine(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values(["task", "wrapper"])
        wrapper = json.loads(ordered["wrapper"].iloc[0])
        for other in ordered["wrapper"].iloc[1:]:
            wrapper = merged(wrapper, json.loads(other))
        return ordered.head(1).assign(wrapper=json.dumps(wrapper))

    schema = "host string, task int, share int, wrapper string"
    partial = pages.select(_host().alias("host"), "html").mapInPandas(fold, schema)
    shares = partial.groupBy("host", "share").applyInPandas(combine, schema)
    return shares.groupBy("host").applyInPandas(combine, schema).select("host", "wrapper")


def main_text(html: str, wrapper: list[list]) -> tuple[str, int]:
    """The article's blocks joined by line ends, and how many blocks were left out.

    Each block is judged by the wrapper's item that it is aligned with. If the page has items said
    to be main text, those are the article, but for what never is. If not, it is what the template leaves:
    texts that all different pages with that item have there are template, be they menus, notices or single lines.
    """
    page = blocks(html)
    stream, of = page_stream(page)
    items = list(stream)
    for i, j in aligned(wrapper, stream):
        if i is not None and j is not None:
            items[j] = wrapper[i]
    said = any("*" == item[0][-1:] for item in items)

    def main(block: Block, item: list) -> bool:
        marks = item[0].removeprefix(block.path)
        if said:
            return marks == "*"
        return marks == "" and (item[4] == item[5] or _digest(block.text) not in item[1])

    kept = [b.text for b, n in zip(page, of) if main(b, items[n])]
    return "\n".join(kept), len(page) - len(kept)


TEXTS = "page_id long, url string, text string, n_chars long, n_left_out long"


def extract(pages: DataFrame) -> DataFrame:
    """Per page its main text.

    Wrappers are written once; where their files are small Spark sends them to the tasks
    by its own limit for that, else pages and wrappers are joined by host and skewed hosts are
    split. Of the rows of a host only different pages tell what is template. A null html is empty, its text too; pages without url share a wrapper; repeated
    rows are extracted as often as they stand; an empty table gives no rows; other columns
    are not read.
    """
    wrappers = stored(host_wrappers(pages), "wrappers")
    joined = (pages.select(F.col("page_id").cast("long"), "url", "html", _host().alias("host"))
              .join(wrappers, "host", "left").select("page_id", "url", "html", "wrapper"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list[list]] = {}
        for batch in batches:
            found = []
            for html, wrapper in zip(batch["html"], batch["wrapper"]):
                if wrapper not in known:
                    if len(known) > 2_000:
                        known.clear()
                    known[wrapper] = [[path, frozenset(texts), *rest] for path, texts, *rest in json.loads(wrapper or "[]")]
                found.append(main_text(html or "", known[wrapper]))
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64").array, "url": batch["url"].array,
                                "text": [t for t, _ in found], "n_chars": [len(t) for t, _ in found],
                                "n_left_out": [n for _, n in found]})

    return joined.mapInPandas(run, TEXTS)
