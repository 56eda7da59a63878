"""Packing: first-fit decreasing over a tournament tree, in randomised groups."""

import re
import zlib
from collections.abc import Iterator
from functools import cached_property
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passim.llm.arrow import byte_slices, encoded, filled, giving_back
from passim.session import new_folder, small_batches

SEQUENCE_TOKENS = 1024
# Pieces that one task packs together, on average.
GROUP_PIECES = 4096
END_ID = 0
# Bytes of texts whose parts a task holds at once.
SLICE_BYTES = 1 << 20


# Parts of texts whose ids a task remembers before it forgets older ones, and the longest.
KEPT_PARTS = 100_000
KEPT_CHARS = 64


class Encoder:
    """Ids of a byte-level BPE file.

    Texts of Latin script go whole through the faster library, which has the
    same vocabulary and word pattern. Of other texts each distinct word of a
    slice is encoded once, by the file's own library if it is not Latin, and
    ids of words met lately are remembered over slices.
    """

    # In Python's expressions and in Arrow's.
    OTHER = re.compile("[^\u0000-\u007e\u00a1-\u024f\u2010-\u2027]")
    OTHER_BYTES = r"[^\x{0}-\x{7e}\x{a1}-\x{24f}\x{2010}-\x{2027}]"
    # Two or more characters of white space before another one; Latin texts as above hold no other white space.
    RUN = re.compile(r"[\t-\r ]{2,}(?=[^\t-\r ])")
    RUN_BYTES = r"[\t-\r ]{2}[^\t-\r ]"

    def __init__(self, file: str):
        import json

        import tiktoken

        self.file = file
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec["added_tokens"]]
        letters = {c: b for b, c in _byte_letters().items()}
        ranks = {bytes(letters[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in self.special}
        # The file's pattern without its look ahead, which `_latin` stands for.
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
        self.fast = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @cached_property
    def exact(self):
        """The file's own library, loaded when a text first needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.file)

    def _ids(self, part: str) -> bytes:
        known = self.young.get(part)
        if known is None:
            known = self.old.get(part)
            if known is None:
                known = (self._exact(part) if self.OTHER.search(part) else self._latin(part)).tobytes()
            if len(part) <= KEPT_CHARS:
                self.young[part] = known
        return known

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one row, and the offsets of the texts.

        A text that holds a special token is encoded whole by the file's own library.
        """
        special = np.zeros(len(texts), dtype=bool)
        for token in self.special:
            special |= np.asarray(pc.match_substring(texts, token))
        other = np.asarray(pc.match_substring_regex(texts, self.OTHER_BYTES)) & ~special
        own = dict(zip(np.flatnonzero(other).tolist(), self._by_words(texts.filter(pa.array(other))), strict=True)) if other.any() else {}
        runs = np.asarray(pc.match_substring_regex(texts, self.RUN_BYTES))
        rows = []
        for i, text in enumerate(texts.to_pylist()):
            if special[i]:
                rows.append(self._exact(text))
            elif other[i]:
                rows.append(own[i])
            else:
                rows.append(self._latin(text) if runs[i] else self.fast.encode_to_numpy(text))
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in rows], dtype=np.int64)])
        return np.concatenate([np.zeros(0, dtype=np.uint32), *rows]), bounds

    def _exact(self, text: str) -> np.ndarray:
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _latin(self, text: str) -> np.ndarray:
        """Cut before the last white space of each run, which belongs to what follows."""
        cuts = [m.end() - 1 for m in self.RUN.finditer(text)]
        if not cuts:
            return self.fast.encode_to_numpy(text)
        return np.concatenate([self.fast.encode_to_numpy(text[a:b]) for a, b in pairwise([0, *cuts, len(text)])])

    def _by_words(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, which is cut before spaces that stand alone between other characters.

        No word of the pattern reaches over such a cut.
        """
        marked = pc.replace_substring_regex(texts, r"([^\s]) ([^\s])", "\\1\x00 \\2")
        # Every second one-letter word is still uncut, which is as right.
        whole = np.asarray(pc.match_substring(texts, "\x00"))
        marked = pc.if_else(pa.array(whole), pa.scalar("", pa.large_string()), marked)
        offsets, index, distinct = encoded(pc.split_pattern(marked, "\x00"))
        if len(self.young) > KEPT_PARTS:
            # What was not met since the last change of dictionaries is forgotten.
            self.old, self.young = self.young, {}
        coded = [self._ids(part) for part in distinct]
        sizes = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded)) // 4
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        flat = np.frombuffer(b"".join(coded), dtype=np.uint32)
        lengths = sizes[index]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = flat[np.repeat(starts[index] - ends[:-1], lengths) + np.arange(ends[-1])]
        rows = np.split(ids, ends[offsets][1:-1])
        return [self._exact(texts[i].as_py()) if whole[i] else row for i, row in enumerate(rows)]


def _cut(ids: np.ndarray, bounds: np.ndarray, size: int, kind: pa.DataType) -> pa.Array:
    """The pieces of each document whose ids lie between bounds."""
    tokens = np.diff(bounds)
    counts = -(-tokens // size)
    ends = np.cumsum(counts)
    document = np.repeat(np.arange(len(tokens)), counts)
    start = (np.arange(len(document)) - (ends - counts)[document]) * size
    length = np.minimum(size, tokens[document] - start)
    first = (4 * (bounds[document] + start)).tolist()
    data = memoryview(ids.tobytes())
    sums = [zlib.crc32(data[a : a + n]) for a, n in zip(first, (4 * length).tolist(), strict=True)]
    entries = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (start, length, sums, tokens[document])], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), entries)


def _byte_letters() -> dict[int, str]:
    """The printable letter for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def cut_documents(docs: DataFrame, tokenizer_file: str, doc_id: str = "doc_id", text: str = "text", size: int = SEQUENCE_TOKENS) -> DataFrame:
    """Each document's ids and the end id, cut at every ``size`` ids.

    One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens``. A null
    or empty text is the end id alone. Repeated rows are separate documents.
    """

    @F.arrow_udf("array<struct<start: long, length: long, ids_crc32: long, doc_tokens: long>>")
    @giving_back
    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(tokenizer_file)
        kind = pa.struct([(c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens")])
        for batch in batches:
            for part in byte_slices(batch, SLICE_BYTES):
                ids, bounds = encoder.encode(filled(part))
                yield _cut(np.insert(ids, bounds[1:], END_ID).astype("<u4"), bounds + np.arange(len(bounds)), size, kind)

    listed = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), pieces(F.col(f"`{text}`")).alias("_pieces"))
    return listed.select("doc_id", F.explode_outer("_pieces").alias("p")).select("doc_id", "p.*")


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each piece.

    Longest first; each goes to the first bin with room, found by walking down
    a tree whose nodes hold the most room below them.
    """
    n = len(lengths)
    leaves = 1 << max(0, n - 1).bit_length()
    room = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[i]), 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - room[node]
        room[node] -= need
        while node > 1:
            node //= 2
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
    return bins, offsets


def pack(pieces: DataFrame, size: int = SEQUENCE_TOKENS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset`` in sequences of ``size`` tokens.

    Pieces are numbered as they are stored, and the number's hash deals them
    to groups of about ``group_pieces``, however many one document has.
    A piece longer than ``size`` fails.
    """
    spark = pieces.sparkSession
    path = new_folder(spark, "pieces")
    # The caller's columns lie in a structure of their own, so that no name can clash.
    pieces = pieces.drop("sequence_id", "offset")
    pieces.select(F.struct("*").alias("piece"), "length", F.monotonically_increasing_id().alias("number")).write.parquet(path)
    stored = spark.read.parquet(path)
    groups = max(1, -(-stored.count() // group_pieces))
    grouped = stored.select("length", "number", F.pmod(F.xxhash64("number"), F.lit(groups)).alias("group"))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("number")
        lengths = frame["length"].to_numpy()
        if (lengths > size).any():
            raise ValueError(f"a piece holds more than {size} tokens")
        bins, offsets = first_fit_decreasing(lengths, size)
        group = frame["group"].to_numpy()
        return pd.DataFrame({"number": frame["number"], "sequence_id": (group << 32) + bins, "offset": offsets})

    placed = grouped.groupBy("group").applyInPandas(fit, "number long, sequence_id long, offset long")
    return stored.select("piece", "number").join(placed, "number").select("piece.*", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_file: str, doc_id: str = "doc_id", text: str = "text", size: int = SEQUENCE_TOKENS) -> DataFrame:
    """Documents packed into sequences: a row per piece, columns as of both steps."""
    # The texts are cut while the pieces are stored, so inside.
    with small_batches(docs.sparkSession):
        return pack(cut_documents(docs, tokenizer_file, doc_id, text, size), size)
