"""Byte-level BPE: merges found through a segment tree of pair ranks."""

import base64
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passim.llm.arrow import SLICE_BYTES, byte_slices, filled

# Bytes of texts or ids that a task works on at once.
PART_BYTES = SLICE_BYTES // 2
# Matches whose ids a task remembers before it forgets older ones, and the longest that it remembers.
KEPT_MATCHES = 100_000
KEPT_CHARS = 64
# Longest match that is merged along with others, and how many at once.
TREE_BYTES = 64
STEP_WORDS = 4096
# A text of more characters is worked on in runs of matches.
LONG_CHARS = 1 << 20
RUN_MATCHES = 1 << 16


def read_ranks(file: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file of ``base64 rank`` lines."""
    with open(file, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one match.

    A leaf for each byte position holds the rank of the pair that the token
    beginning there makes with the next live one; a node holds the least rank
    below it and, of equal ones, the leftmost place, as one number. The root
    names the next merge, which changes three leaves and the nodes over them.
    """
    n = len(data)
    whole = ranks.get(data)
    if whole is not None or not n:
        return [] if whole is None else [whole]
    leaves = 1 << (n - 1).bit_length()
    none = len(ranks) * leaves << 2
    tree = [none] * (2 * leaves)
    # Live tokens: where each ends (and the next begins), and where the one before begins.
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    for i in range(n - 1):
        rank = ranks.get(data[i : i + 2])
        if rank is not None:
            tree[leaves + i] = rank * leaves + i
    for node in range(leaves - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left < right else right

    def put(place: int, value: int) -> None:
        node = leaves + place
        tree[node] = value
        node >>= 1
        while node:
            left, right = tree[2 * node], tree[2 * node + 1]
            least = left if left < right else right
            if tree[node] == least:
                return
            tree[node] = least
            node >>= 1

    def pair(place: int) -> int:
        follows = end[place]
        rank = ranks.get(data[place : end[follows]]) if follows < n else None
        return none if rank is None else rank * leaves + place

    while tree[1] < none:
        at = tree[1] % leaves
        gone = end[at]
        end[at] = end[gone]
        if end[at] < n:
            before[end[at]] = at
        put(gone, none)
        put(at, pair(at))
        if before[at] >= 0:
            put(before[at], pair(before[at]))
    ids, at = [], 0
    while at < n:
        ids.append(ranks[data[at : end[at]]])
        at = end[at]
    return ids


class Merger:
    """Ids of many matches at once, those of matches met before from memory."""

    def __init__(self, ranks: dict[bytes, int], kept: int = KEPT_MATCHES):
        self.ranks, self.kept = ranks, kept
        pairs = sorted(
            (ranks[token[:cut]] << 32 | ranks[token[cut:]], rank)
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        )
        # Every pair of ids whose bytes together are a token, and that token.
        self.pairs, self.joined = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(1, np.int64),) * 2
        self.letters = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.none = max(ranks.values()) + 1
        # Ids as little-endian bytes, far smaller than arrays.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[place] == key, self.joined[place], self.none)

    def merge_all(self, words: list[bytes], leaves: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words of 1 to ``leaves`` bytes in one row, and how many each has.

        As ``merge``, with one tree for each word: a step takes every word's
        next merge.
        """
        sizes = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(w.ljust(leaves, b"\0") for w in words), dtype=np.uint8).reshape(len(words), leaves)
        token, places = self.letters[data], np.arange(leaves)
        live = places < sizes[:, None]
        end, before = np.tile(places + 1, (len(words), 1)), np.tile(places - 1, (len(words), 1))
        none = self.none * leaves
        tree = np.full((len(words), 2 * leaves), none)
        rank = self._pair(token[:, :-1], token[:, 1:])
        tree[:, leaves:-1] = np.where((places[1:] < sizes[:, None]) & (rank < self.none), rank * leaves + places[:-1], none)
        for node in range(leaves - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
        rows = np.arange(len(words))
        while (rows := rows[tree[rows, 1] < none]).size:
            new, at = np.divmod(tree[rows, 1], leaves)
            gone = end[rows, at]
            after, prior = end[rows, gone], before[rows, at]
            token[rows, at], end[rows, at], live[rows, gone] = new, after, False
            right, left = after < sizes[rows], prior >= 0
            before[rows[right], after[right]] = at[right]
            rank = self._pair(new, token[rows, np.minimum(after, leaves - 1)])
            tree[rows, leaves + gone] = none
            tree[rows, leaves + at] = np.where(right & (rank < self.none), rank * leaves + at, none)
            rank = self._pair(token[rows, np.maximum(prior, 0)], new)
            own = rows[left]
            tree[own, leaves + prior[left]] = np.where(rank < self.none, rank * leaves + prior, none)[left]
            for changed, place in ((rows, gone), (rows, at), (own, prior[left])):
                node = (leaves + place) >> 1
                while node.size and node[0]:
                    tree[changed, node] = np.minimum(tree[changed, 2 * node], tree[changed, 2 * node + 1])
                    node = node >> 1
        return token[live], live.sum(axis=1)

    def _learn(self, matches: list[str]) -> None:
        by_leaves: dict[int, list[str]] = {}
        for match in matches:
            size = len(match.encode())
            if size > TREE_BYTES:
                self.young[match] = np.array(merge(match.encode(), self.ranks), dtype="<u4").tobytes()
            else:
                by_leaves.setdefault(max(2, 1 << (size - 1).bit_length()), []).append(match)
        for leaves, own in by_leaves.items():
            for s in range(0, len(own), STEP_WORDS):
                some = own[s : s + STEP_WORDS]
                data = [m.encode() for m in some]
                ids, counts = self.merge_all(data, leaves)
                flat, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
                for m, d, start, end in zip(some, data, [0, *ends], ends, strict=False):
                    # A token of the file stands for itself, whether or not merges reach it.
                    rank = self.ranks.get(d)
                    self.young[m] = flat[start:end] if rank is None else rank.to_bytes(4, "little")

    def ids(self, matches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all matches in one row, and how many each has."""
        if not matches:
            return np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)
        coded = pa.array(matches, pa.large_string()).dictionary_encode()
        distinct, index = coded.dictionary.to_pylist(), np.asarray(coded.indices)
        if len(self.young) > self.kept:
            # What was not met since the last change of dictionaries is forgotten.
            self.old, self.young = self.young, {}
        if met := [m for m in distinct if m in self.old and m not in self.young]:
            self.young |= {m: self.old[m] for m in met}
        self._learn([m for m in distinct if m not in self.young])
        found = [self.young[m] for m in distinct]
        for m in distinct:
            if len(m) > KEPT_CHARS:
                del self.young[m]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        starts, lengths = (np.cumsum(sizes) - sizes)[index], sizes[index]
        ends = np.cumsum(lengths)
        return np.frombuffer(b"".join(found), dtype="<u4")[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1])], lengths


def encode_texts(docs: DataFrame, ranks_file: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The rows with the ids of each whole text, as little-endian unsigned 32-bit integers in one binary.

    Each match of ``pattern`` is encoded on its own, and no string is special. A
    null or empty text has no ids. A column named like ``ids`` is replaced; all
    others and repeated rows stay. The file must be at the same path on every
    executor and hold every single byte.
    """

    @F.arrow_udf("binary")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import regex

        ranks, matches = read_ranks(ranks_file), regex.compile(pattern)
        if absent := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the ranks lack the bytes {absent[:5]}")
        merger = Merger(ranks)
        for batch in batches:
            # An answer for each part, so that a batch's ids are never held together.
            for part in byte_slices(filled(batch), PART_BYTES):
                texts = part.to_pylist()
                if len(texts) == 1 and len(texts[0]) > LONG_CHARS:
                    # A long text's matches are never all held.
                    found = (m.group() for m in matches.finditer(texts[0]))
                    runs = iter(lambda: list(islice(found, RUN_MATCHES)), [])
                    yield pa.array([b"".join(merger.ids(run)[0].tobytes() for run in runs)], pa.binary())
                    continue
                lists = [matches.findall(t) for t in texts]
                ids, lengths = merger.ids(list(chain.from_iterable(lists)))
                ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([0, *map(len, lists)])]
                yield pa.array([ids[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())

    kept = [F.col(f"`{c}`") for c in docs.columns if c != ids]
    return docs.select(*kept, encode(F.col(f"`{text}`")).alias(ids))


def decode_ids(docs: DataFrame, ranks_file: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The rows with the bytes that the ids stand for.

    Null or empty ids give no bytes; an id that the file lacks fails. A column
    named like ``decoded`` is replaced.
    """

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ranks = read_ranks(ranks_file)
        known = np.array(sorted(ranks.values()), dtype=np.int64)
        tokens = pa.array([t for t, _ in sorted(ranks.items(), key=lambda x: x[1])], pa.large_binary())
        for batch in batches:
            for part in _slices(batch):
                sizes = np.asarray(pc.binary_length(part), dtype=np.int64) // 4
                flat = np.frombuffer(b"".join(part.to_pylist()), dtype="<u4")
                place = np.searchsorted(known, flat)
                if (wrong := flat[known[np.minimum(place, len(known) - 1)] != flat]).size:
                    raise ValueError(f"unknown id {wrong[0]}")
                taken = tokens.take(pa.array(place))
                data = taken.buffers()[2]
                ends = np.frombuffer(taken.buffers()[1], dtype=np.int64)[taken.offset : taken.offset + len(taken) + 1]
                bounds = ends[np.concatenate([[0], np.cumsum(sizes)])]
                yield pa.array([data[a:b].to_pybytes() if b > a else b"" for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())

    kept = [F.col(f"`{c}`") for c in docs.columns if c != decoded]
    return docs.select(*kept, decode(F.col(f"`{ids}`")).alias(decoded))


def _slices(batch: pa.Array) -> Iterator[pa.Array]:
    if isinstance(batch, pa.ChunkedArray):
        batch = batch.combine_chunks()
    yield from byte_slices(pc.fill_null(batch, b"").cast(pa.large_binary()), PART_BYTES)
