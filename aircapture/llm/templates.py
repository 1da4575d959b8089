"""Main text of web pages, by templates deduced from the pages of a host."""

from __future__ import annotations

import re
import uuid
from collections.abc import Hashable, Iterable, Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from aircapture.llm.common import cut, release, shared_folder

# Names of HTML elements by their part in a page: fixed values.
RAW = frozenset("script style iframe textarea head".split())
#: Elements without main text that hold other elements; one that is never closed ends with its parent.
HIDDEN = frozenset("noscript template svg math select object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
CONTENT = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 header".split())
BOILERPLATE = frozenset("nav footer aside button dialog menu".split())
#: Elements that are outside the main text unless they hold it, as containers with a word of MARKS are.
DOUBTFUL = frozenset("form fieldset header".split())
#: Words of class and id names that mark containers outside the main text.
MARKS = frozenset(
    "ad ads adv advert advertisement adverts sponsor sponsored promo promotion banner sidebar widget menu nav navbar "
    "navigation breadcrumb breadcrumbs footer cookie cookies consent notice popup modal overlay comment comments disqus "
    "share sharing social related recommended newsletter subscribe subscription login signup form masthead".split()
)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: HTML elements that end an unclosed svg or math, by the rules of HTML (of those that are not inline).
_BREAKOUT = frozenset("blockquote body center dd div dl dt h1 h2 h3 h4 h5 h6 li menu nav ol p pre table ul".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _signature(tag: str, attributes: str) -> tuple[str, bool]:
    """The tag with the names in its class, id and role, and whether they mark boilerplate."""
    names = [a or b or c for a, b, c in _NAMES.findall(attributes)]
    parts = {p.lower() for n in names for p in _PART.findall(n)}
    return (f"{tag}.{'.'.join(sorted(parts))}" if parts else tag), bool(parts & MARKS)


class Page:
    """Tokens of one page: blocks of text, each with the path of the containers around it.

    ``places`` are paths that a template found once in every page: an element
    of such a name opens at its place, whatever an earlier one left open.
    """

    def __init__(self, html: str, places: dict[str, tuple[str, ...]] | None = None) -> None:
        #: path, in a boilerplate element, numbers of the doubtful containers around it, text, linked characters
        self.blocks: list[tuple[tuple[str, ...], bool, tuple[int, ...], str, int]] = []
        self.paths: dict[tuple[str, ...], list[int]] = {}  # occurrences, first position
        #: path and None where an element opens, path and number of the block where a text stands
        self.events: list[tuple[tuple[str, ...], int | None]] = []
        self.doubtful: list[tuple[str, ...]] = []  # paths of containers that may be boilerplate
        self.holding: set[int] = set()  # numbers of those with an article or main inside
        self._read(html, places or {})

    def _read(self, html: str, places: dict[str, tuple[str, ...]]) -> None:
        stack: list[tuple[str, str, bool, int | None]] = []  # tag, signature, boilerplate, number if doubtful
        hidden: int | None = None  # where in the stack hidden elements begin
        closes = True  # whether the hidden element has an end tag
        text: list[str] = []
        at, links, linked = 0, 0, 0
        position = 0

        def flush() -> None:
            nonlocal linked
            said = " ".join("".join(text).split())
            if said:
                path = tuple(s[1] for s in stack)
                doubts = tuple(s[3] for s in stack if s[3] is not None)
                self.events.append((path, len(self.blocks)))
                self.blocks.append((path, any(s[2] for s in stack), doubts, said, linked))
            text.clear()
            linked = 0

        def add(piece: str) -> None:
            nonlocal linked
            if piece and hidden is None:
                piece = unescape(piece)
                text.append(piece)
                linked += len(piece) if links else 0

        n = len(html)
        while at < n:
            m = _TAG.search(html, at)
            if m is None:
                rest = html[at:]
                cut = rest.rfind("<")  # a tag that the page's end cut off
                add(rest[:cut] if cut >= 0 and re.match(r"</?[a-zA-Z!]", rest[cut:]) else rest)
                break
            add(html[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag, closing = m[2].lower(), bool(m[1])
            alone = m[3].rstrip().endswith("/")
            if tag in RAW and not closing:
                if not alone:
                    end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                    if end is None and tag == "head":
                        end = re.compile(r"(?=<body\b)", re.I).search(html, at)
                    at = end.end() if end else n
                continue
            if hidden is not None:
                if closing:
                    k = next((k for k in reversed(range(len(stack))) if stack[k][0] == tag), n)
                    if k >= hidden:
                        del stack[k:]
                        hidden = None if k == hidden else hidden
                        continue
                elif closes or not (tag in CONTENT or (tag in _BREAKOUT and stack[hidden][0] in ("svg", "math"))):
                    if not alone and tag not in VOID and tag not in INLINE:
                        stack.append((tag, tag, False, None))
                    continue
                del stack[hidden:]  # never closed: it ends here
                hidden = None
            if tag in HIDDEN:
                if not closing and not alone:
                    hidden = len(stack)
                    closes = re.compile(rf"</{tag}\s*>", re.I).search(html, at) is not None
                    stack.append((tag, tag, False, None))
                continue
            if tag in VOID:
                if tag in ("br", "hr"):
                    text.append("\n")
                continue
            if tag in INLINE:
                links = max(0, links + (-1 if closing else 1)) if tag == "a" else links
                continue
            flush()
            links = 0
            if closing:
                for k in reversed(range(len(stack))):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                continue
            name, marked = _signature(tag, m[3])
            ends = _CLOSES.get(tag, frozenset())
            while stack and (stack[-1][0] == "p" or stack[-1][0] in ends):
                stack.pop()
            inside = any(s[0] in CONTENT for s in stack)
            place = places.get(name)
            if place is not None and not inside:
                while stack and tuple(s[1] for s in stack) != place[: len(stack)]:
                    stack.pop()
            number = None
            if tag in CONTENT:
                self.holding.update(s[3] for s in stack if s[3] is not None)
            elif tag not in ("html", "body") and (marked or (tag in DOUBTFUL and not (tag == "header" and inside))):
                number = len(self.doubtful)
                self.doubtful.append((*(s[1] for s in stack), name))
            stack.append((tag, name, tag in BOILERPLATE, number))
            path = tuple(s[1] for s in stack)
            position += 1
            self.events.append((path, None))
            self.paths.setdefault(path, [0, position])[0] += 1
        if hidden is not None:
            del stack[hidden:]
        flush()

    def shares(self) -> dict[tuple[str, ...], float]:
        """The share of the page's unlinked text at or below each path."""
        below: dict[tuple[str, ...], int] = {}
        for path, _, _, said, linked in self.blocks:
            plain = max(0, len(said) - linked)
            for k in range(len(path) + 1):
                below[path[:k]] = below.get(path[:k], 0) + plain
        whole = below.get((), 0) or 1
        return {path: n / whole for path, n in below.items()}

    def unmarked(self, elements: dict[tuple[str, ...], dict] | None = None) -> list[int]:
        """Numbers of the blocks that are in no container of menus, notices and the like.

        A name that marks a container counts only if the container holds no
        article or main and little of the text: of the host's pages where the
        template knows it, else of this page (or, without a template, if an
        article or main is elsewhere).
        """
        own = self.shares() if self.doubtful else {}
        content = any(not b[1] and any(p.split(".")[0] in CONTENT for p in b[0]) for b in self.blocks)
        out = set()
        for k, path in enumerate(self.doubtful):
            told = (elements or {}).get(path)
            share = own.get(path, 0.0) if told is None else told["share"]
            if k not in self.holding and (share < 0.5 or (not elements and content)):
                out.add(k)
        return [k for k, b in enumerate(self.blocks) if not b[1] and not out.intersection(b[2])]

    def text(self, elements: dict[tuple[str, ...], dict] | None = None, slots: dict[int, dict] | None = None) -> str:
        """The blocks that are main text.

        The template decides: the page is read as instances of the host's
        classes (``elements`` by path), and what fills a slot between their
        members is main text wherever it stands, what belongs to the classes
        (the texts of ``slots``) is not, also in an article. Without a template
        the blocks inside an article or main are, or all if there is none.
        Slots of links count only inside an article or main, and what is in a
        container of menus, notices and the like does not.
        """
        good = self.unmarked(elements)
        if not elements:
            inside = [k for k in good if any(p.split(".")[0] in CONTENT for p in self.blocks[k][0])]
            return " ".join(self.blocks[k][3] for k in inside or good)
        numbers = {path: e["slot"] for path, e in elements.items()}
        classes = {e["slot"]: e["class"] for e in elements.values()}
        events = [(len(path), None if k is not None else numbers.get(path, path)) for path, k in self.events]
        gaps, _ = instances(events, classes)
        said = []
        for k in good:
            path, _, _, text, _ = self.blocks[k]
            told = elements.get(path)
            if told is not None:
                slot = (slots or {}).get(slot_number(gaps[k], told["slot"]))
                linked = (slot or told)["linked"]
                if linked >= 0.6 and not any(p.split(".")[0] in CONTENT for p in path):
                    continue
                if slot and text_number(text) in slot["texts"]:
                    continue
            said.append(text)
        return " ".join(said)


#: A tag: its element (any key) and whether it is the end tag.
Tag = tuple[Hashable, bool]


def instances(events: Iterable[tuple[int, Hashable | None]], classes: dict[Hashable, int]) -> tuple[list[tuple], dict[int, tuple[Tag, ...]]]:
    """Reads a page as instances of classes: the gap of each text, and the order of each class.

    ``events`` are depths with the element that opens there, or None for a text
    in the element of that depth. Members of a class are the start and end tags
    of its elements; a class is ordered if its tags come in one order, again
    and again, and nested if no tag of an outer class comes within an instance
    other than around it. The elements of a class that is not ordered here
    stand each for itself, and its order is (), as that of one not nested.
    The gap of a text is the member before it in the instance around it, and
    that in the next instance around that one.
    """
    tags: list[Tag | None] = []
    runs: dict[int, list[Tag]] = {}
    standing: list[tuple[int, Hashable]] = []

    def add(element: Hashable, end: bool) -> None:
        c = classes.get(element)
        if c is not None:
            tag = (element, end)
            tags.append(tag)
            if c in runs:
                runs[c].append(tag)
            else:
                runs[c] = [tag]

    for depth, element in events:
        if element is None:
            while standing and standing[-1][0] > depth:
                add(standing.pop()[1], True)
            tags.append(None)
        else:
            while standing and standing[-1][0] >= depth:
                add(standing.pop()[1], True)
            standing.append((depth, element))
            add(element, False)
    while standing:
        add(standing.pop()[1], True)

    orders: dict[int, tuple[Tag, ...]] = {}
    for c, run in runs.items():
        times = run.count(run[0])
        period = run[: len(run) // times]
        orders[c] = tuple(period) if period * times == run else ()
    length = {c: len(order) for c, order in orders.items()}

    gaps: list[tuple] = []
    around: list[list] = []  # class (or element in a tuple, if for itself), members yet to come, the last of them
    for tag in tags:
        if tag is None:
            gaps.append((around[-1][2] if around else None, around[-2][2] if len(around) > 1 else None))
            continue
        c = classes[tag[0]]
        name = c if length[c] else (tag[0],)
        at = len(around) - 1
        while at >= 0 and around[at][0] != name:
            at -= 1
        if at < 0:
            around.append([name, length[c] or 2, None])
        elif at < len(around) - 1:
            for crossed, _, _ in around[at + 1 :]:
                if crossed in orders:
                    orders[crossed] = ()
            del around[at + 1 :]
        inner = around[-1]
        inner[1] -= 1
        inner[2] = tag
        if not inner[1]:
            around.pop()
    return gaps, orders


def host(url):
    """Lower-case host of an address; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)), F.lit(""))


def text_number(text: str) -> int:
    return xxh3_64_intdigest(text.encode()) - 2**63


@lru_cache(maxsize=50_000)
def slot_number(gap: tuple, element: int) -> int:
    """A number for texts in ``element`` that stand in ``gap``: the element's role there."""
    return text_number(f"{gap} {element}")


def _tokens(pages: DataFrame) -> DataFrame:
    """host, page (a number for the html), ``tokens`` and ``sequence``, one row per different page of a host.

    A token is an element's path ("" for the page itself) or a text, which has
    no path but ``said``, its number; ``slot`` is a number for host and path.
    The sequence has the number of the token for each start tag, and -1 less
    that of the token for each text.
    """
    columns = ("path", "slot", "said", "depth", "n", "at", "chars", "linked", "share")
    kinds = (pa.string(), pa.int64(), pa.int64(), *[pa.int32()] * 5, pa.float32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            numbers, ends, out, sequences = [], [0], [[] for _ in columns], []
            for h, html in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                read = Page(html)
                numbers.append(text_number(html))
                shares = read.shares()
                texts: dict[tuple[str, ...], dict[int, list[int]]] = {}
                blocks = [(path, text_number(said)) for path, _, _, said, _ in read.blocks]
                for (path, number), (_, _, _, said, linked) in zip(blocks, read.blocks, strict=True):
                    t = texts.setdefault(path, {}).setdefault(number, [0, 0, 0])
                    t[0] += 1
                    t[1] += len(said)
                    t[2] += linked
                rows, where = [], {}
                for path, (n, at) in {(): [1, 0], **read.paths}.items():
                    name, inside = "/".join(path), texts.get(path, {})
                    slot = text_number(f"{h}\n{name}")
                    chars, linked = (sum(t[k] for t in inside.values()) for k in (1, 2))
                    where[path] = len(rows)
                    rows.append((name, slot, None, len(path), n, at, chars, linked, shares.get(path, 0.0)))
                    for number, (times, size, ties) in inside.items():
                        where[path, number] = -1 - len(rows)
                        rows.append((None, slot, number, len(path), times, 0, size, ties, 0.0))
                for held, v in zip(out, zip(*rows, strict=True), strict=True):
                    held.extend(v)
                sequences.append([where[path] if k is None else where[blocks[k]] for path, k in read.events])
                ends.append(len(out[0]))
            flat = pa.StructArray.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], columns)
            tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays(
                [b.column("host"), pa.array(numbers, pa.int64()), tokens, pa.array(sequences, pa.list_(pa.int32()))],
                ["host", "page", "tokens", "sequence"],
            )

    token = "path: string, slot: long, said: long, depth: int, n: int, at: int, chars: int, linked: int, share: float"
    read = pages.select("host", "html").mapInArrow(run, f"host string, page long, tokens array<struct<{token}>>, sequence array<int>")
    first = read.groupBy("host", "page").agg(F.first(F.struct("tokens", "sequence")).alias("t"))
    return first.select("host", "page", "t.tokens", "t.sequence")


def _survey(pages: DataFrame) -> DataFrame:
    """What the pages say of their host's classes, added up over each batch of pages.

    From host, ``page`` (tokens without paths), ``sequence`` and ``known``
    (slot, class and candidate texts of the host's elements). Rows with a
    ``class`` tell in how many pages its tags come in the order ``about``
    (slot and side of each; none if not ordered or not nested). Rows without
    tell of a slot, ``key``: ``about`` is the element, then slot and side of
    the members before, and the sums are those of all that is said there, or of
    one text of it, ``said``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, classes, candidates = None, {}, {}

        def read(b: pa.RecordBatch, first: int, orders: dict[tuple, int], slots: dict[tuple, list[int]]) -> None:
            nonlocal last, classes, candidates
            page, sequence = b.column("page"), b.column("sequence")
            slot, said, depth, n, chars, linked = (page.flatten().field(f).to_pylist() for f in ("slot", "said", "depth", "n", "chars", "linked"))
            starts, steps = page.offsets.to_pylist(), sequence.flatten().to_pylist()
            starts, ends = [v - starts[0] for v in starts], sequence.offsets.to_pylist()
            ends = [v - ends[0] for v in ends]
            for k, (h, known) in enumerate(zip(b.column("host").to_pylist(), b.column("known"), strict=True)):
                if h != last:
                    last, known = h, known.as_py()
                    classes = {e["slot"]: e["class"] for e in known}
                    candidates = {e["slot"]: frozenset(e["texts"] or ()) for e in known}
                at, mine = starts[k], steps[ends[k] : ends[k + 1]]
                gaps, found = instances([(depth[at + e], slot[at + e]) if e >= 0 else (depth[at - 1 - e], None) for e in mine], classes)
                for c, order in found.items():
                    orders[h, c, order] = orders.get((h, c, order), 0) + 1
                for i, gap in zip((at - 1 - e for e in mine if e < 0), gaps, strict=True):
                    some = candidates.get(slot[i])
                    if some is None:
                        continue
                    for text in (None, said[i]) if said[i] in some else (None,):
                        held = slots.setdefault((h, gap, slot[i], text), [0, 0, 0, -1])
                        if held[3] != first + k:
                            held[0] += 1
                            held[3] = first + k
                        held[1] += chars[i] // n[i]
                        held[2] += linked[i] // n[i]

        for b in batches:
            orders: dict[tuple, int] = {}  # pages by host, class and order
            slots: dict[tuple, list[int]] = {}  # pages, chars, linked and the last page by host, gap, element and text
            for first in range(0, b.num_rows, 500):
                read(b.slice(first, 500), first, orders, slots)
            out = []
            for (h, c, order), times in orders.items():
                about = [int(v) for tag in order for v in tag]
                out.append((h, c, text_number(str(about)), None, about, times, 0, 0))
            for (h, gap, element, text), (times, size, ties, _) in slots.items():
                about = [element, *(int(v) for tag in gap if tag for v in tag)]
                out.append((h, None, slot_number(gap, element), text, about, times, size, ties))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], [f.split()[0] for f in fields.split(", ")]
            )

    kinds = (pa.string(), *[pa.int64()] * 3, pa.list_(pa.int64()), *[pa.int64()] * 3)
    fields = "host string, class long, key long, said long, about array<long>, pages long, chars long, linked long"
    return (
        pages.mapInArrow(run, fields)
        .groupBy("host", "class", "key", "said")
        .agg(F.first("about").alias("about"), *(F.sum(c).alias(c) for c in ("pages", "chars", "linked")))
    )


def ordered_members(orders: list[tuple[list[Tag], int]], pages: int, always: float) -> list[Hashable]:
    """Elements of a class in order, without those that break it.

    Of the commonest order of tags, the elements that stand to each other as
    there in a share of ``always`` of the pages of the class.
    """
    orders = [(order, n) for order, n in orders if order]
    if not orders:
        return []
    best, most = max(orders, key=lambda o: (o[1], str(o[0])))
    members = [element for element, end in best if not end]
    if most >= pages * always:
        return members
    places = [({tag: k for k, tag in enumerate(order)}, n) for order, n in orders]

    def stands(at: dict[Tag, int], a: Hashable, b: Hashable) -> tuple[bool, bool]:
        return at[a, True] < at[b, False], at[b, True] < at[a, True]

    first = {tag: k for k, tag in enumerate(best)}
    bad: dict[Hashable, set] = {m: set() for m in members}
    for i, a in enumerate(members):
        for b in members[i + 1 :]:
            agreed = sum(n for at, n in places if at[a, False] < at[b, False] and stands(at, a, b) == stands(first, a, b))
            if agreed < pages * always:
                bad[a].add(b)
                bad[b].add(a)
    while bad and (worst := max(bad, key=lambda m: (len(bad[m]), str(m)))) and bad[worst]:
        for other in bad.pop(worst):
            bad[other].discard(worst)
    return [m for m in members if m in bad]


def constant_slots(elements: list[dict], slots: list[dict], stale: float) -> set[int]:
    """Keys of the slots whose recurring texts belong to the template; the other ones are filled with main text.

    Slots have key, path, chars (of all texts there). What a slot's siblings say
    decides: the innermost element that holds the slot and also texts that vary.
    If no more than headings vary there, or the recurring texts are more than a
    share of ``stale`` of it, its pages have one body in common, and it stays.
    Menus, notices and links, which never are main text, do not count.
    """
    shares = {e["path"]: e["share"] for e in elements}

    def parts(path: str) -> list[str]:
        return path.split("/") if path else []

    def outside(path: str) -> bool:
        names = parts(path)
        for k, name in enumerate(names, 1):
            tag, *words = name.split(".")
            if tag in BOILERPLATE or (MARKS.intersection(words) and shares.get("/".join(names[:k]), 0.0) < 0.5):
                return True
        return False

    held: dict[str, int] = {}
    for s in slots:
        held[s["path"]] = held.get(s["path"], 0) + s["chars"]
    varied = {e["path"]: e["chars"] - held.get(e["path"], 0) for e in elements if e["linked"] < 0.6 and not outside(e["path"])}
    open_slots, gone = {s["key"]: s for s in slots}, {}
    above = {"/".join(parts(s["path"])[:k]) for s in slots for k in range(len(parts(s["path"])))}

    def below(path: str, region: str) -> bool:
        return not region or path.startswith(f"{region}/")

    for region in sorted(above, key=lambda r: (-len(parts(r)), r)):
        said = {p: n for p, n in varied.items() if n > 0 and (p == region or below(p, region))}
        mine = [s for s in open_slots.values() if below(s["path"], region)]
        if not said or not mine:
            continue
        same = sum(s["chars"] for s in (*mine, *gone.values()) if s["path"] in varied and below(s["path"], region))
        bodiless = all(HEADINGS.intersection(n.split(".")[0] for n in parts(p)) for p in said)
        for s in mine:
            del open_slots[s["key"]]
            if bodiless or same > stale * (same + sum(said.values())):
                if s["path"] in varied:
                    varied[s["path"]] += s["chars"]
            else:
                gone[s["key"]] = s
    return set(gone)


def templates(pages: DataFrame, support: float = 0.5, least_pages: int = 3, always: float = 0.8, stale: float = 0.8) -> DataFrame:
    """host, ``template``: its elements in order, and ``slots``: what stands between them.

    Only different pages count: all copies of one html are one page. The
    occurrence vector of an element is how often each page of the host has it;
    elements of one vector form an equivalence class. Vectors are compared by
    the xor of hashes of (page, count), which adds up in partial aggregates, so
    a host of any size needs no list of its pages. Classes count whose vector
    is positive in a share of ``support`` of the pages; what is above their
    elements then does, too.

    The pages are read again with these classes (:func:`instances`). A class
    must be ordered and nested in a share of ``always`` of its pages; elements
    that break its order leave it (``place`` -1, else the place in the order)
    and stand for themselves.
    A slot is what stands in an element after a member of the class around it,
    so one element has several roles if it comes in several gaps.

    A text is a member of the class around its slot if it is in a share of
    ``always`` of the pages with the slot (not in all, since pages may be cut
    off), in ``least_pages`` at least, and if such texts are a share of
    ``always`` of all that is said there. Else the slot varies, with all its
    texts: what a story's paragraphs have in common stays. What is said around
    it decides whether they are dropped (:func:`constant_slots`). ``slots`` has
    the slots of a share of ``support`` of the pages, with these texts.
    """
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/templates-{uuid.uuid4().hex}"
    _tokens(pages).write.parquet(folder)
    stored = spark.read.schema("host string, page long, tokens array<struct<path: string, slot: long, said: long, depth: int, n: int, at: int, "
                               "chars: int, linked: int, share: float>>, sequence array<int>").parquet(folder)  # fmt: skip
    each = stored.select("host", "page", F.explode("tokens").alias("t")).select("host", "page", "t.*")
    told = (
        each.withColumn("host", F.when(F.col("said").isNull(), F.col("host")))
        .groupBy("host", "path", "slot", "said")
        .agg(
            F.count("*").alias("with"),
            F.sum("n").alias("total"),
            F.bit_xor(F.xxhash64("page", "n")).alias("class"),
            F.avg("at").alias("at"),
            F.sum("chars").alias("chars"),
            F.sum("linked").alias("linked"),
            F.avg("share").alias("share"),
        )
        .where(F.col("said").isNull() | (F.col("with") >= least_pages))
    )
    told = cut(told)
    elements = told.where("said is null").drop("said")
    sizes = elements.where("path = ''").select("host", F.col("with").alias("pages"))
    valid = elements.join(sizes, "host").where((F.col("pages") >= least_pages) & (F.col("with") >= F.col("pages") * support))
    texts = told.where("said is not null").select("slot", "said", F.col("with").alias("within"))
    # a text that fills a slot of enough pages is in these shares of them
    candidates = (
        texts.join(valid.select("slot", "pages"), "slot")
        .where(F.col("within") >= F.col("pages") * (support * always))
        .groupBy("slot")
        .agg(F.collect_list("said").alias("texts"))
    )
    linked = F.coalesce(F.try_divide("linked", "chars"), F.lit(0.0)).alias("linked")
    element = F.struct(
        "at", "path", "slot", "class", "with", (F.col("total") == F.col("with")).alias("once"), "chars", linked, "share", "texts"
    )
    known = cut(valid.join(candidates, "slot", "left").groupBy("host", "pages").agg(F.sort_array(F.collect_list(element)).alias("known")))
    bare = F.transform("tokens", lambda t: t.dropFields("path", "at", "share")).alias("page")
    asked = F.transform("known", lambda e: F.struct(e["slot"].alias("slot"), e["class"].alias("class"), e["texts"].alias("texts")))
    found = _survey(stored.select("host", bare, "sequence").join(known.select("host", asked.alias("known")), "host"))
    # orders of few pages tell no more than that these disagree
    often = F.when(F.col("class").isNotNull(), F.lit(0.05)).when(F.col("said").isNull(), F.lit(support)).otherwise(F.lit(support * always))
    found = found.join(known.select("host", "pages", F.col("pages").alias("all")).drop("pages"), "host").where(
        (F.col("pages") >= F.col("all") * often) & (F.col("class").isNotNull() | (F.col("pages") >= least_pages))
    )
    row = F.struct("class", "key", "said", "about", "pages", "chars", "linked")
    lists = found.groupBy("host").agg(F.collect_list(row).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [
                _template(*v, always, least_pages, stale)
                for v in zip(b.column("known").to_pylist(), b.column("found").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [b.column("host"), pa.array([o[0] for o in out], members), pa.array([o[1] for o in out], gaps)], ["host", "template", "slots"]
            )

    members = pa.list_(pa.struct([("at", pa.float64()), ("path", pa.string()), ("slot", pa.int64()), ("class", pa.int64()),
                                  ("place", pa.int32()), ("once", pa.bool_()), ("linked", pa.float64()), ("share", pa.float64())]))
    gaps = pa.list_(pa.struct([("slot", pa.int64()), ("linked", pa.float64()), ("texts", pa.list_(pa.int64()))]))
    shape = (
        "host string, template array<struct<at: double, path: string, slot: long, class: long, place: int, once: boolean, linked: double, "
        "share: double>>, slots array<struct<slot: long, linked: double, texts: array<long>>>"
    )
    return cut(known.join(lists, "host", "left").select("host", "known", "found").mapInArrow(run, shape))


def _template(known: list[dict], found: list[dict] | None, always: float, least_pages: int, stale: float) -> tuple[list[dict], list[dict]]:
    """The elements and slots of one host, from its elements and what its pages say of their classes."""
    paths = {e["slot"]: e["path"] for e in known}
    orders: dict[int, list] = {}
    slots, texts = [], {}
    for f in found or ():
        if f["class"] is not None:
            about = f["about"]
            orders.setdefault(f["class"], []).append(([(e, bool(end)) for e, end in zip(about[::2], about[1::2], strict=True)], f["pages"]))
        elif f["said"] is None:
            slots.append(f)
        else:
            texts.setdefault(f["key"], []).append(f)
    of_class = {e["class"]: e["with"] for e in known}
    places = {m: k for c, o in orders.items() for k, m in enumerate(ordered_members(o, of_class[c], always))}
    # an element that broke its class stands for itself: it has what is inside it, and nothing follows it
    slots = [f for f in slots if all(not end or m in places for m, end in zip(f["about"][1::2], f["about"][2::2], strict=True))]
    constant: dict[int, list[int]] = {}
    for f in slots:
        same = [t for t in texts.get(f["key"], ()) if t["pages"] >= max(least_pages, f["pages"] * always)]
        if same and sum(t["chars"] for t in same) >= f["chars"] * always:
            constant[f["key"]] = sorted(t["said"] for t in same)
    judged = [{"key": f["key"], "path": paths[f["about"][0]], "chars": f["chars"]} for f in slots if f["key"] in constant]
    gone = constant_slots(known, judged, stale)
    template = [{**{k: e[k] for k in ("at", "path", "slot", "class", "once", "linked", "share")}, "place": places.get(e["slot"], -1)} for e in known]
    return template, [
        {"slot": f["key"], "linked": f["linked"] / f["chars"] if f["chars"] else 0.0, "texts": constant[f["key"]] if f["key"] in gone else []}
        for f in sorted(slots, key=lambda f: f["key"])
    ]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, one row per input row.

    A null html has an empty text. Pages without a host share the host "";
    hosts of fewer than three pages have no template, and their pages are read
    by element names alone. Extra columns are not read.
    """
    rows = pages.select(
        "page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host(F.col("url")).alias("host")
    )
    found = templates(rows.select("host", "html"))
    release(pages.sparkSession, 1)
    kind = rows.schema["page_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            packed = pa.array([squeeze(t.encode()) for t in b.column("html").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "url", "host")), packed], ["page_id", "url", "host", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, places, elements, slots = None, {}, {}, {}
        unpack = zstandard.ZstdDecompressor().decompress
        for b in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            texts = []
            columns = [b.column(c) for c in ("host", "packed", "template", "slots")]
            for h, packed, template, gaps in zip(*(c.to_pylist() for c in columns[:2]), *columns[2:], strict=True):
                html = unpack(packed).decode()
                if h != last:
                    last, tokens = h, template.as_py() or []
                    once: dict[str, list[tuple[str, ...]]] = {}
                    for t in tokens:
                        if t["once"] and t["path"]:
                            path = tuple(t["path"].split("/"))
                            once.setdefault(path[-1], []).append(path[:-1])
                    places = {name: p[0] for name, p in once.items() if len(p) == 1}
                    elements = {tuple(t["path"].split("/")) if t["path"] else (): t for t in tokens}
                    slots = {t["slot"]: {**t, "texts": frozenset(t["texts"])} for t in gaps.as_py() or []}
                texts.append(Page(html, places).text(elements, slots))
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"]
            )

    # pages meet their host's template compressed
    sent = rows.mapInArrow(pack, f"page_id {kind}, url string, host string, packed binary")
    joined = sent.join(found, "host", "left").select("page_id", "url", "host", "packed", "template", "slots")
    out = joined.mapInArrow(run, f"page_id {kind}, url string, text string")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
