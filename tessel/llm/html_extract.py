"""Main text of web pages by wrapper induction.

Pages of a host share a template.  For each host, the trees of at most ``PAGES`` pages (one for each residue of a hash of
the identifier) are aligned by simple tree matching, after runs of like siblings have been folded, and give a skeleton of
places.  All pages of the host are then aligned with the skeleton; a node without partner has its place by its parent's
place and its label, so layouts that the skeleton lacks have places too.  Over all pages it is counted which texts stand
in which place: a text of nearly all pages that have the place is template (a block goes if it has no other text), what
varies is content.  The text of the slot stays: the branch where the places of this page hold most of the varying text, by
what they hold on average over the host's pages.  Where that branch is void on the page, the slot is the last one that
isn't; an article element in the slot narrows it.

What no page can mean as text (menus, forms, scripts, and the like by their elements, and by names of classes such as
``comments`` or ``sponsored``) is left out before the alignment.  Names that also occur in articles (``LOOSE``) say
something only where nothing else does: outside of an article on a host whose pages can't be aligned.

Nulls: a null page is empty, and so is its text; a null URL or one without host belongs to the host "".  Ties between
branches go to the first.  A place of fewer than ``LEAST`` different pages has no template, so a host of fewer pages has
none; its article element, or else its whole body, is taken.  Repeated rows are extracted each; pages of a host that are
whole repeats count once in a template.  Very long pages and ones of many thousand levels are taken whole.  An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import pickle
import re
import sys
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.llm.common import partitions, stored

PAGES = 12
#: Share of a host's pages that have the place, and the least number of them, in which template text stands.
CONSTANT, LEAST = 0.9, 4
#: Bytes of all wrappers together up to which they are broadcast; beyond, pages and wrappers are dealt by host.
BROADCAST_BYTES = 32 << 20
#: Most hosts whose sampled pages' identifiers are broadcast, and most groups of repeated pages that are.
BROADCAST_HOSTS, BROADCAST_REPEATS = 4_000, 300_000
#: Counts that a task holds before it hands them on.
HELD = 300_000
#: Nested calls, since trees may be deep.
DEEP = 100_000
#: Cells of one alignment that is held whole; those of longer child lists are made again, row by row, as they are needed.
CELLS = 40_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp"))
FURNITURE = frozenset("head script style noscript iframe template nav footer aside form button select option textarea input menu dialog svg canvas object audio video map title".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
#: Words of class, id and role that declare furniture.
DECLARED = frozenset("ad ads advert advertisement adverts adbox adsense sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices popup modal overlay share sharing related recommended newsletter subscribe signup login comment comments respond disqus replies pagination pager toolbar".split())
#: Words that may declare it, but also occur in articles.
LOOSE = frozenset("banner social widget widgets copyright legal disclaimer complementary contentinfo search alert".split())
#: What a start tag closes: the first open element of these, if none of the stops lies above it.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOPS = frozenset("ul ol dl table body article section div main".split())

_TAG = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_TOKEN = re.compile(r"[a-z]+")


class Node:
    """An element: label (tag and class), whether it is declared furniture (or may be), and children (nodes and texts) in
    order."""

    __slots__ = ("tag", "label", "furniture", "loose", "children", "place")

    def __init__(self, tag: str, label: str, furniture: bool, loose: bool = False):
        self.tag, self.label, self.furniture, self.loose, self.children, self.place = tag, label, furniture, loose, [], None


def _element(tag: str, attributes: str) -> Node:
    furniture, loose = tag in FURNITURE, False
    label = tag
    if attributes and not attributes.isspace():
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden":
                furniture = True
            elif value:
                if name == "class":
                    label += "." + value
                if not furniture and tag not in ("html", "body", "article", "main"):
                    words = _TOKEN.findall(value)
                    furniture = not DECLARED.isdisjoint(words)
                    loose = loose or not LOOSE.isdisjoint(words)
    return Node(tag, label, furniture, loose)


def parse(source: str) -> Node:
    """The tree of a page; end tags and implied ends are taken as browsers would, roughly."""
    root = Node("#", "#", False)
    stack, at = [root], 0
    while True:
        found = _TAG.search(source, at)
        text = source[at : found.start()] if found else source[at:]
        if text:
            stack[-1].children.append(text)
        if not found:
            return root
        at = found.end()
        tag = found[2]
        if tag is None:
            if found[0].startswith("<![CDATA["):
                stack[-1].children.append(html.escape(found[0][9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if found[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in BLOCK:  # a block ends an open paragraph
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in STOPS:
                    break
        if tag in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSES[tag]:
                    del stack[k:]
                    break
                if stack[k].tag in STOPS:
                    break
        node = _element(tag, found[3] or "")
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            body, at = (source[at : end.start()], end.end()) if end else (source[at:], len(source))
            node.children.append(body)
        elif tag not in VOID and not (found[3] or "").endswith("/"):
            stack.append(node)


def tidy(text: str) -> str:
    return " ".join(html.unescape(text).split())


# ------------------------------------------------------------------------------------------------------------ template


@dataclass
class Slot:
    """A node of a skeleton."""

    label: str
    children: list[Slot] = field(default_factory=list)
    number: int = 0


@dataclass
class Fold:
    """Like siblings in a row, as one node."""

    label: str
    members: list[Node]
    children: list[Fold]
    place: int | None = None  # none: declared furniture
    expected: float = 0.0
    own: int = 0


def fold(nodes: list[Node]) -> list[Fold]:
    """Element children, with runs of the same label folded and their children folded together."""
    out: list[Fold] = []
    for node in nodes:
        if isinstance(node, Node) and node.tag not in RAW:
            if out and out[-1].label == node.label:
                out[-1].members.append(node)
            else:
                out.append(Fold(node.label, [node], []))
    for f in out:
        f.children = fold([c for m in f.members for c in m.children])
    return out


def text_key(text: str) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def own_texts(f: Fold) -> set[int]:
    """Keys of the texts right below nodes that aren't furniture."""
    return {text_key(t) for m in f.members if not m.furniture for c in m.children if isinstance(c, str) and (t := tidy(c))}


def matching(a: list, b: list, memo: dict) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two child lists: the most nodes that can be paired in order, and the pairs at this level."""
    n, m = len(a), len(b)
    if not n or not m:
        return 0, []
    if n * m > CELLS:
        return long_matching(a, b, memo)
    value = [[0] * (m + 1) for _ in range(n + 1)]
    gains = {}
    for i in range(n):
        row, next_row, x = value[i], value[i + 1], a[i]
        for j in range(m):
            best = row[j + 1] if row[j + 1] >= next_row[j] else next_row[j]
            if x.label == b[j].label:
                gain = gains[i, j] = row[j] + 1 + subtree(x, b[j], memo)
                if gain > best:
                    best = gain
            next_row[j + 1] = best
    pairs, i, j = [], n, m
    while i and j:
        if value[i][j] == gains.get((i - 1, j - 1), -1):
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif value[i][j] == value[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return value[n][m], pairs[::-1]


def subtree(x, y, memo: dict) -> int:
    key = (id(x), id(y))
    if key not in memo:
        memo[key] = matching(x.children, y.children, memo)[0] if x.children and y.children else 0
    return memo[key]


def form(x, memo: dict) -> int:
    """A number for nodes of the same labels all the way down."""
    waiting = [x]
    while waiting:
        node = waiting[-1]
        if (id(node),) in memo:
            waiting.pop()
            continue
        lacking = [c for c in node.children if (id(c),) not in memo]
        if lacking:
            waiting += lacking
            continue
        memo[id(node),] = memo.setdefault((node.label, *[memo[id(c),] for c in node.children]), len(memo))
        waiting.pop()
    return memo[id(x),]


def long_matching(a: list, b: list, memo: dict) -> tuple[int, list[tuple[int, int]]]:
    """:func:`matching` by the same rule for long lists: of the rows of values about the square root is kept, and the
    gain of a pair is found once for all nodes of its forms."""
    n, m = len(a), len(b)
    where: dict[str, list[int]] = defaultdict(list)
    for j, y in enumerate(b):
        where[y.label].append(j)
    kinds = {}
    for label, at in where.items():
        forms: dict[int, int] = {}
        kind = [forms.setdefault(form(b[j], memo), len(forms)) for j in at]
        first = [at[kind.index(k)] for k in range(len(forms))]
        kinds[label] = np.array(at), np.array(kind), first
    gains: dict[int, np.ndarray] = {}

    def gain(x) -> np.ndarray:
        """Of pairing x with each node of its label."""
        _, kind, first = kinds[x.label]
        own = form(x, memo)
        if own not in gains:
            gains[own] = np.array([1 + subtree(x, b[j], memo) for j in first], np.int32)
        return gains[own][kind]

    def following(row: np.ndarray, x) -> np.ndarray:
        out = row.copy()
        if x.label in kinds:
            at = kinds[x.label][0]
            out[at + 1] = np.maximum(out[at + 1], row[at] + gain(x))
        return np.maximum.accumulate(out)

    step = math.isqrt(n) + 1
    row = np.zeros(m + 1, np.int32)
    kept = []
    for i, x in enumerate(a):
        if i % step == 0:
            kept.append(row)
        row = following(row, x)
    total, pairs, j = int(row[m]), [], m
    for block in range(len(kept) - 1, -1, -1):
        start = block * step
        rows = [kept.pop()]
        for x in a[start : start + step]:
            rows.append(following(rows[-1], x))
        for i in range(len(rows) - 1, 0, -1):
            x, row, above = a[start + i - 1], rows[i], rows[i - 1]
            own = dict(zip(kinds[x.label][0].tolist(), gain(x).tolist(), strict=True)) if x.label in kinds else {}
            while j:
                if j - 1 in own and row[j] == above[j - 1] + own[j - 1]:
                    pairs.append((start + i - 1, j - 1))
                    j -= 1
                    break
                if row[j] == above[j]:
                    break
                j -= 1
    return total, pairs[::-1]


def grow(slots: list[Slot], folds: list[Fold], memo: dict) -> None:
    """Adds a page to a skeleton; parts that it has more become optional nodes in their place."""
    _, pairs = matching(slots, folds, memo)
    met = {j: slots[i] for i, j in pairs}
    out, k = [], 0
    order = {id(s): n for n, s in enumerate(slots)}
    for j, f in enumerate(folds):
        slot = met.get(j)
        if slot is not None:
            stop = order[id(slot)] + 1
            out += slots[k:stop]
            k = stop
        else:
            slot = Slot(f.label)
            out.append(slot)
        grow(slot.children, f.children, memo)
    slots[:] = out + slots[k:]


def skeleton(pages: list[str]) -> list[Slot]:
    """The places of some pages of a host."""
    top: list[Slot] = []
    for page in sorted(dict.fromkeys(pages)):
        grow(top, fold([parse(page)]), {})
    last = 0
    level = list(top)
    while level:
        slot = level.pop()
        slot.number = last = last + 1
        level += slot.children
    return top


def written(top: list[Slot]) -> bytes:
    """A skeleton as flat lists, parents first: labels, numbers and parents."""
    labels, numbers, parents = [], [], []
    waiting = [(slot, -1) for slot in reversed(top)]
    while waiting:
        slot, parent = waiting.pop()
        waiting += [(c, len(labels)) for c in reversed(slot.children)]
        labels.append(slot.label)
        numbers.append(slot.number)
        parents.append(parent)
    return pickle.dumps((labels, numbers, parents), 5)


def read(data: bytes) -> list[Slot]:
    top: list[Slot] = []
    known: list[Slot] = []
    for label, number, parent in zip(*pickle.loads(data), strict=True):
        known.append(Slot(label, [], number))
        (known[parent].children if parent >= 0 else top).append(known[-1])
    return top


def beyond(parent: int, label: str) -> int:
    """The place of a node that the skeleton lacks."""
    return -1 - (text_key(f"{parent} {label}") + (1 << 63) >> 1)


def locate(folds: list[Fold], slots: list[Slot], memo: dict, parent: int = 0) -> list[Fold]:
    """Gives each node of a page its place; parents come first."""
    _, pairs = matching(slots, folds, memo)
    met = {j: slots[i] for i, j in pairs}
    out = []
    for j, f in enumerate(folds):
        if not all(m.furniture for m in f.members):
            slot = met.get(j)
            f.place = slot.number if slot else beyond(parent, f.label)
            out.append(f)
            out += locate(f.children, slot.children if slot else [], memo, f.place)
    return out


def places(source: str, slots: list[Slot]) -> dict[int, set[int]]:
    """The texts of each place of a page."""
    out: dict[int, set[int]] = defaultdict(set)
    for f in locate(fold([parse(source)]), slots, {}):
        out[f.place] |= own_texts(f)
    return out


# ---------------------------------------------------------------------------------------------------------- extraction


@dataclass
class Wrapper:
    """A host's skeleton, and for places of ``LEAST`` pages or more how many varying texts a page has there on average and
    which texts are template."""

    skeleton: list[Slot]
    places: dict[int, tuple[float, frozenset[int]]]


def weigh(located: list[Fold], own: Wrapper) -> dict[int, frozenset[int]]:
    """Sets what varies in each node and below, on the page and as expected; the template texts of each node."""
    known: dict[int, frozenset[int]] = {}
    for f in reversed(located):
        texts = own_texts(f)
        expected, constant = own.places.get(f.place, (len(texts), frozenset()))
        f.own = len(texts - constant) + sum(c.own for c in f.children)
        f.expected = expected + sum(c.expected for c in f.children)
        if constant:
            known.update((id(m), constant) for m in f.members)
    return known


def slot_of(top: list[Fold]) -> list[Node]:
    """The nodes that hold most of the varying text; those of a label among siblings belong together."""
    found: list[Node] = []
    level, whole = top, sum(f.expected for f in top)
    while whole:
        groups: dict[str, list[Fold]] = defaultdict(list)
        for f in level:
            if f.place is not None:
                groups[f.label].append(f)
        if not groups:
            break
        best = max(groups.values(), key=lambda g: sum(f.expected for f in g))
        tag = best[0].members[0].tag
        if sum(f.expected for f in best) < 0.7 * whole or tag in ("p", "h1", "h2", "h3", "li", "span", "b", "a"):
            break
        if not any(f.own for f in best) and any(f.own for f in level):
            break
        found = [m for f in best for m in f.members if not m.furniture]
        if tag in ("article", "main"):  # headings belong to it, whatever varies most
            break
        level = [c for f in best for c in f.children]
    return found


def roots(level: list[Node]) -> list[Node]:
    """Within the nodes the article elements, else main, if any, in page order."""
    for tag in ("article", "main"):
        found, waiting = [], list(reversed(level))
        while waiting:
            node = waiting.pop()
            if node.tag == tag:
                found.append(node)
            else:
                waiting += [c for c in reversed(node.children) if isinstance(c, Node) and not c.furniture]
        if found:
            return found
    return level


def blocks(root: Node, template: dict[int, frozenset[int]], inside: bool) -> list[str]:
    """The blocks' texts in order; a block all of whose texts are the template's goes.  What may be furniture by its name
    stays ``inside`` an article or slot."""
    out: list[str] = []
    held: list[str] = []
    varies = False

    def flush():
        nonlocal varies
        text = tidy("".join(held)) if varies else ""
        held.clear()
        varies = False
        if text:
            out.append(text)

    stack: list[tuple[Node, int]] = [(root, 0)]
    while stack:
        node, k = stack.pop()
        known = template.get(id(node))
        children = node.children
        while k < len(children):
            child = children[k]
            k += 1
            if isinstance(child, str):
                held.append(child)
                if not varies:
                    varies = not (known and text_key(tidy(child)) in known) and not child.isspace()
                continue
            if child.furniture or child.loose and not inside:
                if child.tag in BLOCK or child.tag in FURNITURE:
                    held.append(" ")
                continue
            if child.tag in ("br", "td", "th", "img", "hr"):
                held.append(" ")
            if child.tag in BLOCK:
                flush()
            stack.append((node, k))
            node, k, children, known = child, 0, child.children, template.get(id(child))
        if node.tag in BLOCK or node is root:
            flush()
        elif node.tag in ("td", "th"):
            held.append(" ")
    flush()
    return out


def main_text(source: str, own: Wrapper | None) -> str:
    if not source:
        return ""
    tree = parse(source)
    known, level = {}, [tree]
    if own:
        top = fold([tree])
        known = weigh(locate(top, own.skeleton, {}), own)
        level = slot_of(top) or level
    found = roots(level)
    inside = level[0] is not tree or found[0] is not tree
    return "\n\n".join(b for root in found for b in blocks(root, known, inside))


# ------------------------------------------------------------------------------------------------------------ operators


def with_host(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    host = F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[^:/?#]*://([^/?#]*)", 1)
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), F.lower(host).alias("host"))


def skeletons(rows: DataFrame, per_host: int = PAGES) -> DataFrame:
    """host, wrapper (its pickled skeleton) from at most ``per_host`` pages of each host; ``rows`` as of :func:`with_host`."""
    spread = F.xxhash64("page_id")
    chosen = rows.groupBy("host", F.pmod(spread, F.lit(per_host)).alias("part")).agg(F.min(F.struct(spread.alias("h"), F.col("page_id"))).alias("first")).select("host", F.col("first.page_id").alias("page_id"))
    chosen = stored(chosen, "wrapper-pages")
    if chosen.count() <= BROADCAST_HOSTS * per_host:  # a host and a number each
        chosen = F.broadcast(chosen)
    # Rows that repeat an identifier give one page: at most ``per_host`` of a host.
    sample = rows.select("host", "page_id", "html").join(chosen, ["host", "page_id"], "left_semi").groupBy("host", "page_id").agg(F.min("html").alias("html"))

    def run(group):
        import pandas as pd

        sys.setrecursionlimit(DEEP)
        own = written(skeleton(group["html"].tolist()))
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [own]})

    return sample.groupBy("host").applyInPandas(run, "host string, wrapper binary")


COUNTS = T.StructType([T.StructField("host", T.StringType()), T.StructField("place", T.LongType()), T.StructField("text", T.LongType()), T.StructField("n", T.DoubleType()), T.StructField("total", T.DoubleType())])


def counted(rows: DataFrame, known: DataFrame) -> DataFrame:
    """host, place, text, n: how many pages have this text in this place (no text: have the place, and with how many
    texts in all).  Whole repeats count once: each of c like pages as 1/c."""
    like = [F.xxhash64("html").alias("h1"), F.xxhash64("html", F.lit(1)).alias("h2")]
    hashed = rows.select("*", *like)
    repeats = stored(hashed.groupBy("host", "h1", "h2").agg(F.count("*").alias("copies")).where("copies > 1"), "repeated-pages")
    if repeats.count() <= BROADCAST_REPEATS:
        repeats = F.broadcast(repeats)
    weighted = hashed.join(repeats, ["host", "h1", "h2"], "left").select("page_id", "url", "html", "host", F.coalesce(1 / F.col("copies"), F.lit(1.0)).alias("weight"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(DEEP)
        held: dict[tuple, list[float]] = {}

        def out():
            keys, sums = list(held), list(held.values())
            held.clear()
            for k in range(0, len(keys), 50_000):
                columns = [*zip(*keys[k : k + 50_000], strict=True), *zip(*sums[k : k + 50_000], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], names=COUNTS.names)

        for host, source, weight, own in paged(batches):
            for place, texts in places(source, own).items() if own else ():
                for text, total in ((None, weight * len(texts)), *((t, 0.0) for t in texts)):
                    sums = held.setdefault((host, place, text), [0.0, 0.0])
                    sums[0] += weight
                    sums[1] += total
            if len(held) > HELD:
                yield from out()
        yield from out()

    frame, held = attached(weighted, known)

    def paged(batches):
        for batch, pages, wraps in paired(batches, held, read):
            at = {name: batch.column(name).take(pages).to_pylist() for name in ("host", "html", "weight")}
            yield from zip(at["host"], at["html"], at["weight"], wraps, strict=True)

    return frame.mapInArrow(run, COUNTS).groupBy("host", "place", "text").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def wrappers(rows: DataFrame) -> DataFrame:
    """host, wrapper (pickled) by the counts over all pages of each host."""
    bare = stored(skeletons(rows), "skeletons")
    counts = stored(counted(rows, bare).where(F.col("n") > LEAST - 1e-6), "place-counts")
    had = counts.where("text is null").select("host", "place", F.col("n").alias("pages"), "total")
    constant = counts.where("text is not null").join(had.select("host", "place", "pages"), ["host", "place"]).where(F.col("n") > CONSTANT * F.col("pages") - 1e-6)
    facts = had.withColumn("text", F.lit(None).cast("long")).unionByName(constant.select("host", "place", "text", F.col("n").alias("pages"), F.lit(0.0).alias("total")))

    def run(key, left, right):
        sys.setrecursionlimit(DEEP)
        if not left.num_rows:
            return pa.table({"host": pa.array([], pa.string()), "wrapper": pa.array([], pa.binary())})
        varying: dict[int, float] = {}
        pages: dict[int, float] = {}
        template: dict[int, list[int]] = defaultdict(list)
        taken: dict[int, float] = defaultdict(float)
        for place, text, n, total in zip(*(right.column(c).to_pylist() for c in ("place", "text", "pages", "total")), strict=True):
            if text is None:
                varying[place], pages[place] = total, n
            else:
                template[place].append(text)
                taken[place] += n
        known = {p: (max(0.0, total - taken[p]) / pages[p], frozenset(template[p])) for p, total in varying.items()}
        own = pickle.dumps((left.column("wrapper")[0].as_py(), known), 5)
        return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "wrapper": pa.array([own], pa.binary())})

    return bare.groupBy("host").cogroup(facts.groupBy("host")).applyInArrow(run, "host string, wrapper binary")


EXTRACTED = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType())])


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and the main text of every row."""
    rows = with_host(pages, id_col, url_col, html_col)
    frame, held = attached(rows, stored(wrappers(rows), "wrappers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(DEEP)
        for batch, pages, wraps in paired(batches, held, opened):
            sources = batch.column("html").take(pages).to_pylist()
            texts = [main_text(source, own) for source, own in zip(sources, wraps, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").take(pages), batch.column("url").take(pages), pa.array(texts, pa.string())], names=EXTRACTED.names)

    return frame.mapInArrow(run, EXTRACTED)


def attached(rows: DataFrame, known: DataFrame) -> tuple[DataFrame, object]:
    """Rows for :func:`paired`, and the broadcast wrappers unless each host's stands before its rows."""
    if (known.agg(F.sum(F.length("wrapper"))).first()[0] or 0) <= BROADCAST_BYTES:
        return rows, rows.sparkSession.sparkContext.broadcast({r["host"]: bytes(r["wrapper"]) for r in known.collect()})
    return dealt(rows, known), None


def dealt(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Pages behind the wrapper of their host (a row of its own), by host; a host of many pages is dealt to several
    groups, each behind a copy of its wrapper."""
    parts = partitions(rows.sparkSession)
    counted = stored(rows.groupBy("host").agg(F.count("*").alias("n")), "host-pages")
    share = max(1, (counted.agg(F.sum("n")).first()[0] or 0) // parts)
    groups = counted.select("host", F.ceil(F.col("n") / share).cast("long").alias("groups"))
    several = F.broadcast(groups.where("groups > 1"))  # no more than there are parts
    group = F.pmod(F.monotonically_increasing_id(), F.coalesce("groups", F.lit(1)))
    own = rows.join(several, "host", "left").select(*rows.columns, F.lit(None).cast("binary").alias("wrapper"), group.alias("group"))
    copies = known.join(groups, "host").select("host", "wrapper", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("group"))
    both = own.unionByName(copies, allowMissingColumns=True).repartition(parts, "host", "group")
    return both.sortWithinPartitions("host", "group", F.col("wrapper").isNull()).drop("group")


def opened(data: bytes) -> Wrapper:
    bare, known = pickle.loads(data)
    return Wrapper(read(bare), known)


def paired(batches: Iterator[pa.RecordBatch], held, opening) -> Iterator[tuple[pa.RecordBatch, pa.Array, list]]:
    """Batches, which of their rows are pages, and the opened wrapper of each page's host."""
    memory: dict[str, object] = {}
    for whole in batches:
        for k in range(0, whole.num_rows, 256):
            batch = whole.slice(k, 256)
            wrapped = None if held else batch.column("wrapper")
            pages, wraps = [], []
            for n, host in enumerate(batch.column("host").to_pylist()):
                if wrapped is not None and wrapped[n].is_valid:
                    memory = {host: opening(wrapped[n].as_py())}
                    continue
                if host not in memory:
                    if len(memory) > 500:
                        memory.clear()
                    data = held.value.get(host) if held else None
                    memory[host] = opening(data) if data else None
                pages.append(n)
                wraps.append(memory[host])
            yield batch, pa.array(pages, pa.int64()), wraps
