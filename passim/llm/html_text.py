"""HTML extraction as a minimum cut between content and boilerplate.

A page is a row of text blocks in a tree of elements. A trained classifier says
what each block costs on either side; blocks next to each other, and blocks and
the elements around them, are tied, so that a lone doubtful block goes with its
surroundings. The cheapest labelling is a minimum cut.
"""

import html
import re
from collections import deque
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passim.llm.arrow import filled

# Pages that the classifier is fitted on at most.
SAMPLE_PAGES = 4000
# Elements that hold no text to show, and elements that don't end a block.
RAW = frozenset("script style title textarea template noscript iframe svg math object".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements and names that say what a part of a page is for.
MAIN = frozenset(("article", "main"))
WHOLE = frozenset(("html", "body", "article", "main"))
ASIDE = frozenset("nav footer aside form header menu dialog select button option".split())
NAMED = re.compile(r"(?:^|[^a-z])(?:ads?|advert\w*|banner|menu|nav\w*|breadcrumb\w*|footer|header|sidebar|cookie\w*|notice|consent|promo\w*|share|social|related|comments?|reply|replies|newsletter|popup|subscribe)(?:[^a-z]|$)")
# Parts of readers, which an article of their own doesn't make main text.
READERS = re.compile(r"(?:^|[^a-z])(?:comments?|reply|replies|discussion)(?:[^a-z]|$)")
# Names that say what a layout has beside it, not what it is.
LAYOUT = re.compile(r"(?:^|\s)(?:has|with|without|no|hide|show)[-_]\S*")
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^<>]*>",
    re.S,
)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_SPACE = re.compile(r"\s+")
TIE_NEXT, TIE_TREE = 0.6, 1.0
# What the side that a block's elements speak for costs at least, beside what is learnt of it.
PURPOSE_COST = 6.0


class Blocks:
    """Text blocks of a page: text, features, and the element each stands in."""

    def __init__(self, page: str):
        self.text: list[str] = []
        self.links: list[int] = []
        self.parent: list[int] = []
        self.tag: list[str] = []
        # Elements: name, parent, and whether it or one around it is meant as main or aside.
        self.element: list[tuple[str, int]] = [("", -1)]
        self.side: list[int] = [0]
        # Whether an element stands in main text, or in a part of readers.
        self.settled: list[bool] = [False]
        self._read(page)

    def _read(self, page: str) -> None:
        stack, parts, linked, in_link, last = [0], [], 0, 0, 0

        def close() -> None:
            nonlocal parts, linked
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                self.text.append(text)
                self.links.append(min(linked, len(text)))
                self.parent.append(stack[-1])
                self.tag.append(self.element[stack[-1]][0])
            parts, linked = [], 0

        at, size = 0, len(page)
        while at < size:
            tag = _TAG.search(page, at)
            stop = tag.start() if tag else size
            if stop > at:
                parts.append(page[at:stop])
                linked += (stop - at) * bool(in_link)
            if not tag:
                break
            at = tag.end()
            name = (tag[2] or "").lower()
            if not name:
                continue
            if name in RAW:
                # What such an element holds is not read as tags; unclosed, it takes the rest.
                if not tag[1] and not tag[3].endswith("/"):
                    end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                    at = end.end() if end else size if name in ("script", "style") else at
                parts.append(" ")
                continue
            if name == "a":
                in_link = 0 if tag[1] else 1
            if name in INLINE:
                if name == "br":
                    parts.append(" ")
                continue
            close()
            if name in VOID or tag[3].endswith("/"):
                continue
            if tag[1]:
                for depth in range(len(stack) - 1, 0, -1):
                    if self.element[stack[depth]][0] == name:
                        del stack[depth:]
                        break
            else:
                # A paragraph or item ends where the next begins.
                if name in ("p", "li", "dt", "dd", "tr", "td", "th") and self.element[stack[-1]][0] == name:
                    stack.pop()
                elif self.element[stack[-1]][0] == "p":
                    stack.pop()
                names = " ".join(filter(None, (x for m in _NAMES.findall(tag[3] or "") for x in m))).lower()
                names = LAYOUT.sub(" ", names)
                around, settled = self.side[stack[-1]], self.settled[stack[-1]]
                named = (name not in WHOLE or name == "article") and bool(READERS.search(names)) or name not in WHOLE and bool(NAMED.search(names))
                aside = (name in ASIDE and not (name == "header" and around > 0)) or named
                # An article makes main text even of what is wrapped in a form or a sidebar's layout.
                main = name in MAIN and not aside and not settled
                self.element.append((name, stack[-1]))
                self.side.append(1 if main else -1 if aside or around < 0 else 1 if name in MAIN or around > 0 else 0)
                self.settled.append(settled or main or bool(READERS.search(names)))
                stack.append(len(self.element) - 1)
        close()

    def features(self, i: int) -> list[str]:
        text = self.text[i]
        words = text.count(" ") + 1
        return [
            f"tag:{self.tag[i]}",
            f"length:{min(8, len(text).bit_length())}",
            f"links:{4 * self.links[i] // max(1, len(text))}",
            f"ends:{text[-1] in '.!?:;'}",
            f"word:{min(12, len(text) // words)}",
            f"copy:{'©' in text or '|' in text or '·' in text}",
            f"purpose:{self.side[self.parent[i]]}",
        ]


def train_blocks(pages: DataFrame, page_id: str = "page_id", source: str = "html", sample_pages: int = SAMPLE_PAGES) -> dict[str, float]:
    """Log odds of content of each feature of a block, and of none (``""``).

    Blocks inside elements meant as main text are content, those inside
    elements meant for something else are not, and the rest is not learnt
    from. Fitted on about ``sample_pages`` pages picked by the hash of the id;
    without labelled blocks all odds are even.
    """
    rows = pages.select(F.col(f"`{page_id}`").cast("string").alias("id"), F.col(f"`{source}`").alias("html"))
    share = int(min(1.0, sample_pages / max(1, rows.count())) * (1 << 30))
    sample = rows.where(F.pmod(F.xxhash64(F.coalesce("id", F.lit("")), F.lit("blocks")), F.lit(1 << 30)) < share)

    @F.arrow_udf("array<struct<feature: string, content: int>>")
    def observed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for page in filled(batch):
                blocks, own = Blocks(page.as_py()), []
                for i in range(len(blocks.text)):
                    if side := blocks.side[blocks.parent[i]]:
                        own += [{"feature": f, "content": int(side > 0)} for f in ["", *blocks.features(i)]]
                out.append(own)
            yield pa.array(out, pa.list_(pa.struct([("feature", pa.string()), ("content", pa.int32())])))

    seen = sample.select(F.explode(observed("html")).alias("o")).groupBy("o.feature").agg(F.sum("o.content").alias("yes"), F.count("*").alias("n"))
    counts = {r["feature"]: (r["yes"], r["n"] - r["yes"]) for r in seen.collect()}
    yes, no = counts.get("", (0, 0))
    if not yes or not no:
        return {"": 0.0}
    odds = {f: log((a + 1) / (yes + 2)) - log((b + 1) / (no + 2)) for f, (a, b) in counts.items() if f}
    return odds | {"": log(yes / no)}


def minimum_cut(nodes: int, edges: list[tuple[int, int, float]], source: int, sink: int) -> set[int]:
    """The source's side of a minimum cut; edges carry their capacity both ways.

    Shortest augmenting paths in level graphs, walked with a stack.
    """
    to, room, out = [], [], [[] for _ in range(nodes)]
    for a, b, c in edges:
        out[a].append(len(to))
        to.append(b)
        room.append(c)
        out[b].append(len(to))
        to.append(a)
        room.append(c if a not in (source, sink) and b not in (source, sink) else 0.0)
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            x = queue.popleft()
            for e in out[x]:
                if room[e] > 1e-9 and to[e] not in level:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if sink not in level:
            return set(level)
        tried, path, x = [0] * nodes, [], source
        while True:
            if x == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                cut = next(i for i, e in enumerate(path) if room[e] <= 1e-9)
                x = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while tried[x] < len(out[x]):
                e = out[x][tried[x]]
                if room[e] > 1e-9 and level.get(to[e], -1) == level[x] + 1:
                    break
                tried[x] += 1
            if tried[x] < len(out[x]):
                path.append(out[x][tried[x]])
                x = to[path[-1]]
            elif path:
                x = to[path.pop() ^ 1]
                tried[x] += 1
            else:
                break


def main_text(page: str, odds: dict[str, float]) -> str:
    """The content blocks of a page in page order, one to a line."""
    blocks = Blocks(page)
    n = len(blocks.text)
    if not n:
        return ""
    # Terminals 0 and 1, then blocks, then the elements that hold any.
    places = {e: 2 + n + i for i, e in enumerate(_used(blocks))}
    edges = []
    for i in range(n):
        cost = sum(odds.get(f, 0.0) for f in ["", *blocks.features(i)]) + PURPOSE_COST * blocks.side[blocks.parent[i]]
        edges.append((0, 2 + i, cost) if cost > 0 else (2 + i, 1, -cost))
        if i and blocks.side[blocks.parent[i]] == blocks.side[blocks.parent[i - 1]]:
            edges.append((1 + i, 2 + i, TIE_NEXT))
        edges.append((2 + i, places[blocks.parent[i]], TIE_TREE))
    for e, place in places.items():
        around = blocks.element[e][1]
        if around in places and blocks.side[around] == blocks.side[e]:
            edges.append((place, places[around], TIE_TREE))
    content = minimum_cut(2 + n + len(places), edges, 0, 1)
    return "\n".join(blocks.text[i] for i in range(n) if 2 + i in content)


def _used(blocks: Blocks) -> list[int]:
    used = set()
    for e in blocks.parent:
        while e >= 0 and e not in used:
            used.add(e)
            e = blocks.element[e][1]
    return sorted(used)


def extract_text(pages: DataFrame, odds: dict[str, float], source: str = "html") -> DataFrame:
    """The rows with ``text`` and ``n_chars`` of each whole page.

    A null or empty page, or one without content, has an empty text. Columns
    of these names are replaced.
    """

    @F.arrow_udf("string")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(page.as_py(), odds) for page in filled(batch)], pa.string())

    kept = [F.col(f"`{c}`") for c in pages.columns if c not in ("text", "n_chars")]
    rows = pages.select(*kept, extract(F.col(f"`{source}`")).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
