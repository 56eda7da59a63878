"""Benchmark decontamination: pigeonhole edit matching over words.

Each item is cut into one more piece than the errors it allows, so a passage
within the budget holds one piece exactly. Piece hits are found by one automaton
over all pieces, and each hit is verified by bit-parallel edit distance.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passim.llm.arrow import filled, giving_back
from passim.session import BROADCAST_BYTES

# Word errors allowed, as a share of the item's words.
ERROR_SHARE = 0.2
_OTHER = re.compile(r"[\W_]+")


def plain(text: str) -> str:
    """Lower-case words between single spaces, with one at each end."""
    return f" {_OTHER.sub(' ', text.lower()).strip()} "


def pieces(words: list[str], errors: int) -> list[tuple[int, list[str]]]:
    """Place and words of ``errors + 1`` pieces of nearly equal length."""
    edges = [len(words) * i // (errors + 1) for i in range(errors + 2)]
    return [(s, words[s:e]) for s, e in zip(edges[:-1], edges[1:], strict=True)]


def best_match(item: list[str], window: list[str]) -> tuple[int, int]:
    """Least edit distance of the item to any run of the window, and the run's end.

    Myers' recurrence: the differences of a column of the table are held as
    bits of whole numbers, and a word of the window costs a few operations.
    """
    equal: dict[str, int] = {}
    for i, word in enumerate(item):
        equal[word] = equal.get(word, 0) | 1 << i
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    plus, minus, score = full, 0, len(item)
    best, end = score, 0
    for j, word in enumerate(window):
        same = equal.get(word, 0)
        across = same | minus
        down = (((same & plus) + plus) ^ plus) | same
        up, low = minus | (full & ~(down | plus)), plus & down
        score += bool(up & top) - bool(low & top)
        up, low = up << 1 & full, low << 1 & full
        plus, minus = low | (full & ~(across | up)), up & across
        if score < best:
            best, end = score, j + 1
    return best, end


class Items:
    """An automaton over the pieces of a block of items."""

    def __init__(self, items: list[tuple[int, str]], share: float = ERROR_SHARE):
        import ahocorasick

        self.words, self.errors, at = {}, {}, {}
        for item_id, text in items:
            words = plain(text).split()
            if not words:
                continue
            row = len(self.words)
            self.words[row], self.errors[row] = (item_id, words), int(len(words) * share)
            for place, piece in pieces(words, self.errors[row]):
                at.setdefault(" " + " ".join(piece) + " ", []).append((row, place))
        self.automaton = ahocorasick.Automaton()
        for piece, where in at.items():
            self.automaton.add_word(piece, (len(piece), where))
        if at:
            self.automaton.make_automaton()
        self.any = bool(at)

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """Item, distance and last word (exclusive) of the best match of each item in the text."""
        if not self.any:
            return []
        own, found, seen = plain(text), {}, set()
        words, done, counted = None, 0, 0
        for last, (length, where) in self.automaton.iter(own):
            if words is None:
                words = own.split()
            counted += own.count(" ", done, last - length + 1)
            done = last - length + 1
            for row, place in where:
                item_id, item = self.words[row]
                errors = self.errors[row]
                start = counted - place
                # Of the same line through the table there is one verification.
                if (row, start) in seen or found.get(row, (1, 0))[0] == 0:
                    continue
                seen.add((row, start))
                begin = max(0, start - errors)
                distance, end = best_match(item, words[begin : start + len(item) + errors])
                if distance <= errors and (row not in found or distance < found[row][0]):
                    found[row] = (distance, begin + end)
        return [(self.words[row][0], *match) for row, match in sorted(found.items())]


def item_matches(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    share: float = ERROR_SHARE,
    block_bytes: int = BROADCAST_BYTES // 16,
) -> Column:
    """For each row of ``docs`` an array of ``item_id, distance, end_word``.

    A match is a run of words that becomes the item's by at most ``share`` of
    the item's words in word insertions, deletions and changes, whatever the
    case, punctuation and spacing. Each item counts once for each row, at its
    least distance. Null and empty texts and items match nothing; repeated
    items each match. Items are sent to the tasks in blocks of ``block_bytes``
    of text, each block against all rows.
    """
    spark = docs.sparkSession
    listed = items.select(F.col(f"`{item_id}`").cast("long").alias("i"), F.col(f"`{item_text}`").alias("t")).where("t is not null")
    size = listed.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // block_bytes))
    dealt = listed.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(blocks)))
    kind = pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("end_word", pa.int64())])
    columns = []
    for b in range(blocks):
        sent = spark.sparkContext.broadcast([(r["i"], r["t"]) for r in dealt.where(F.col("b") == b).select("i", "t").collect()])
        columns.append(_matcher(sent, share, kind)(F.col(f"`{text}`")))
    return columns[0] if blocks == 1 else F.concat(*columns)


def _matcher(sent, share: float, kind: pa.DataType):
    @F.arrow_udf("array<struct<item_id: long, distance: int, end_word: long>>")
    @giving_back
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        items = Items(sent.value, share)
        for batch in batches:
            found = [[dict(zip(("item_id", "distance", "end_word"), m, strict=True)) for m in items.matches(x.as_py())] for x in filled(batch)]
            yield pa.array(found, pa.list_(kind))

    return run


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, item_id, distance, end_word``: a row for each row of the documents and item found in it."""
    found = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), item_matches(docs, items, text).alias("found"))
    return found.select("doc_id", F.explode("found").alias("m")).select("doc_id", "m.*")


def clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows that hold no item, with their own columns."""
    return docs.where(F.size(item_matches(docs, items, text)) == 0)
