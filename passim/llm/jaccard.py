"""N-gram Jaccard join by parity sketches.

The distinct word shingles of a text are hashed to 64 bits and dealt by the hash
to the parts of a sketch. A part is the XOR of its shingles' hashes, so the number
of parts in which two sketches differ is at most the number of shingles that only
one of the texts has. That number is bounded by the threshold and the sizes: of
more parts than the bound, some are equal, and name a bucket that both sets are
in. Parts of few shingles are often equal by chance and name none as long as
enough others are left. A second sketch of one bit for each shingle bounds the
difference of any two sets in a bucket, before whole sets are compared.

Sizes fall into bands that share one number of parts; a set near the upper end
of its band also takes part in the next one, as partner of the larger sets there.
"""

from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passim.llm.arrow import byte_slices, filled, giving_back
from passim.llm.components import components
from passim.session import checkpointed, new_folder, small_batches

SHINGLE_WORDS = 3
THRESHOLD = 0.9
BAND = 1.5
# Up to so many differences, a key joins two parts: a single one would hold few shingles.
PAIRED_DIFFERENCES = 6
# A part of so few shingles names a bucket only if the others are too few.
THIN = 2
FOLD_WORDS = 16
# Bits of the filter for the texts whose whole sets are made (8 MB).
MARK_BITS = 26
SLICE_BYTES = 1 << 20
# Bytes whose words are hashed at once; a longer word widens its own window.
WINDOW_BYTES = 1 << 18
# Members of a bucket that one task compares with as many others.
BLOCK = 8000
# Candidates that a set puts forward from one comparison of blocks, in the first
# round that compares blocks; each later round takes four times as many.
FORWARD = 4
_U = np.uint64
_MIX = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _MIX[2]
    x = (x ^ (x >> _U(27))) * _MIX[3]
    return x ^ (x >> _U(31))


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * _MIX[0])
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE[_SPACE] = 0
_powers: dict[int, np.ndarray] = {}


def _power(base: int, count: int) -> np.ndarray:
    """The first powers of an odd number, modulo 2^64."""
    if len(_powers.get(base, ())) < count:
        steps = np.full(max(count, WINDOW_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:count]


def _window_words(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of each word of these bytes; a word also begins at ``begins``.

    A word's hash is its polynomial in an odd base: a difference of running
    sums, moved to place 0 by the inverse of the base.
    """
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[begins] = inside[begins]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    base = int(_MIX[1])
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _power(base, len(data)), out=sums[1:])
    value = (sums[end] - sums[start]) * _power(pow(base, -1, 1 << 64), len(data) + 1)[start]
    return _mixed(value + (end - start).astype(np.uint64) * _MIX[3]), start


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and where each text's words begin and end among them."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, dtype=np.uint8)
    ends = ends - ends[0]
    found, places, at = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)], 0
    while at < len(raw):
        # A window ends behind white space, so that it cuts no word.
        stop = at + WINDOW_BYTES
        while stop < len(raw) and not (space := np.flatnonzero(_SPACE[raw[stop : stop + WINDOW_BYTES]])).size:
            stop += WINDOW_BYTES
        stop = min(len(raw), stop + int(space[0]) + 1) if stop < len(raw) else len(raw)
        inner = ends[np.searchsorted(ends, at) : np.searchsorted(ends, stop)] - at
        value, start = _window_words(raw[at:stop], inner)
        found.append(value)
        places.append(start + at)
        at = stop
    return np.concatenate(found), np.searchsorted(np.concatenate(places), ends)


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])]


def shingle_sets(texts: pa.Array, size: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles.

    Words are runs without ASCII white space, A-Z lower-cased. A text with
    fewer words than ``size`` has its word sequence as the only shingle.
    """
    word, ends = _words(texts)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(word) - size + 1), dtype=np.uint64)
        for k in range(size):
            rolled = _mixed(rolled * _MIX[0] + word[k : k + len(rolled)])
        out = []
        for s, e in zip(ends[:-1], ends[1:], strict=True):
            if e - s >= size:
                out.append(_distinct(rolled[s : e - size + 1]))
            else:
                value = np.zeros(1, dtype=np.uint64)
                for k in range(s, e):
                    value = _mixed(value * _MIX[0] + word[k] + _MIX[1])
                out.append(value if e > s else value[:0])
    return out


class Plan:
    """Bands, parts and bounds for one threshold."""

    def __init__(self, threshold: float = THRESHOLD):
        self.share = Fraction(str(threshold))
        # Of linked sets of sizes a and b, at most (a + b) times this share is in one alone.
        apart = (1 - self.share) / (1 + self.share)
        self.numerator, self.denominator = apart.numerator, apart.denominator
        # Smallest size at which two different sets can link.
        self.least = next(n for n in range(1, 10**6) if self.differences(n, n + 1) >= 1) if self.share < 1 else 1 << 62
        self.uppers = [self.least]
        while self.uppers[-1] < 1 << 40:
            self.uppers.append(int(self.uppers[-1] * BAND) + 1)
        self.bounds = [int((1 - self.share) * 2 * upper / (1 + self.share)) for upper in self.uppers]

    def differences(self, a: int, b: int) -> int:
        """The most shingles that only one of two linked sets of these sizes can have."""
        union = int((a + b) / (1 + self.share))
        return max(0, a + b - 2 * -(-(self.share * union).numerator // (self.share * union).denominator)) if union else 0

    def bands(self, n: int) -> list[tuple[int, int]]:
        """Number and difference bound of the bands that a set of ``n`` takes part in."""
        if n < self.least:
            return []
        first = bisect_left(self.uppers, n)
        last = bisect_left(self.uppers, n * self.share.denominator // self.share.numerator)
        return [(i, self.bounds[i]) for i in range(first, last + 1)]


def sketch(hashed: np.ndarray, parts: int) -> np.ndarray:
    """Parity words: each hash flips one bit of the part that its high half names."""
    part = (((hashed >> _U(32)) * _U(parts)) >> _U(32)).astype(np.int64)
    bit = _U(1) << (hashed & _U(63))
    out = np.zeros(parts, dtype=np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    out[part[starts]] = np.bitwise_xor.reduceat(bit, starts)
    return out


def part_keys(hashed: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each part the XOR of its shingles' hashes, with their number mixed in, and that number."""
    part = (((hashed >> _U(32)) * _U(parts)) >> _U(32)).astype(np.int64)
    counts = np.bincount(part, minlength=parts)
    value = np.zeros(parts, dtype=np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    value[part[starts]] = np.bitwise_xor.reduceat(hashed, starts)
    with np.errstate(over="ignore"):
        return _mixed(value + counts.astype(np.uint64) * _MIX[3]), counts


def keys(hashed: np.ndarray, plan: Plan) -> np.ndarray:
    """The buckets of a set: hashes of band, place and value of its equal-part keys.

    A linked set leaves all but ``bound`` parts as they are. With more than
    ``bound`` parts that are not thin, one of them is among these and names a
    bucket in both sets; a set with fewer of them uses thinner ones as well.
    """
    found = [np.zeros(0, dtype=np.uint64)]
    for band, bound in plan.bands(len(hashed)):
        paired = bound <= PAIRED_DIFFERENCES
        value, counts = part_keys(hashed, bound + 3 if paired else bound + 4 + bound // 12)
        if paired:
            # Two parts together, of which three at least are unchanged.
            pairs = np.array(list(combinations(range(len(value)), 2)), dtype=np.int64)
            place = (pairs[:, 0] * len(value) + pairs[:, 1]).astype(np.uint64)
            value = _mixed(value[pairs[:, 0]] + _MIX[1]) * _MIX[0] + value[pairs[:, 1]]
        else:
            least = next((t for t in (THIN, 0) if (counts > t).sum() > bound), -1)
            place = np.flatnonzero(counts > least).astype(np.uint64)
            value = value[counts > least]
        with np.errstate(over="ignore"):
            found.append(_mixed(_mixed(value + _U(band) * _MIX[0]) + place * _MIX[1]))
    return np.concatenate(found)


def folded(hashed: np.ndarray) -> np.ndarray:
    """A sketch of fixed size for a quick lower bound."""
    return sketch(hashed, FOLD_WORDS) if len(hashed) else np.zeros(FOLD_WORDS, dtype=np.uint64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.uint64)
    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))


def _class_of(hashed: np.ndarray) -> int:
    """One number for one set: equal sets, and only they (but for 64-bit chance), share it."""
    with np.errstate(over="ignore"):
        return int(_mixed(_mixed(hashed).sum(dtype=np.uint64) + _U(len(hashed)) * _MIX[0]).view(np.int64)) if len(hashed) else 0


def _sketched(docs: DataFrame, doc_id: str, text: str, threshold: float, size: int) -> DataFrame:
    plan = Plan(threshold)

    @F.arrow_udf("n long, node long, fold array<long>, keys array<long>")
    @giving_back
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # Copies of a text name their buckets once in a task.
        met: set[int] = set()
        for batch in batches:
            # An answer for each slice, so that a batch is never held as sets.
            for part in byte_slices(batch, SLICE_BYTES):
                n, node, fold, key = [], [], [], []
                for own in shingle_sets(filled(part), size):
                    n.append(len(own))
                    node.append(_class_of(own))
                    fold.append(folded(own))
                    key.append(own[:0] if node[-1] in met else keys(own, plan))
                    met.add(node[-1])
                yield pa.StructArray.from_arrays(
                    [pa.array(n, pa.int64()), pa.array(node, pa.int64()), _lists(fold), _lists(key)], ["n", "node", "fold", "keys"]
                )

    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), run(F.col(f"`{text}`")).alias("_s")).select("doc_id", "_s.*")


@giving_back
def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by bucket and node the distinct ones, without buckets of one node.

    The first and the last bucket of the partition may go on in the next one
    and stay.
    """
    kind = pa.schema([("k", pa.int64()), ("node", pa.int64())])
    # The last row so far, and whether it was given out.
    last: tuple[int, int] | None = None
    given = True
    for batch in batches:
        if not batch.num_rows:
            continue
        k, node = (np.asarray(batch.column(c)) for c in ("k", "node"))
        fresh = np.concatenate([[last != (k[0], node[0])], (k[1:] != k[:-1]) | (node[1:] != node[:-1])])
        first, k, node = last is None, k[fresh], node[fresh]
        if not len(k):
            continue
        before = np.concatenate([[last is not None and last[0] == k[0]], k[1:] == k[:-1]])
        shared = before | np.concatenate([k[1:] == k[:-1], [False]])
        shared[0] |= first
        if before[0] and not given:
            yield pa.RecordBatch.from_arrays([pa.array([last[0]]), pa.array([last[1]])], schema=kind)
        last, given = (int(k[-1]), int(node[-1])), bool(shared[-1])
        if shared.any():
            yield pa.RecordBatch.from_arrays([pa.array(k[shared]), pa.array(node[shared])], schema=kind)
    if not given:
        yield pa.RecordBatch.from_arrays([pa.array([last[0]]), pa.array([last[1]])], schema=kind)


def _compare(plan: Plan, turn: int):
    """Of each two blocks of a bucket, pairs that may link, of different components.

    Each set puts forward the first of its candidates, in order of their nodes;
    ``more`` says whether it had others, for the next turn.
    """
    most = FORWARD << 2 * turn

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        held = None
        for batch in chain(batches, [None]):
            if batch is not None:
                table = pa.Table.from_batches([batch])
                held = table if held is None else pa.concat_tables([held, table])
            if held is None or not held.num_rows:
                continue
            table = held.combine_chunks()
            mark = np.stack([np.asarray(table.column(c)) for c in ("k", "i", "j")])
            edges = np.concatenate([[0], np.flatnonzero((mark[:, 1:] != mark[:, :-1]).any(axis=0)) + 1, [table.num_rows]])
            # The last group may go on in the next batch.
            whole = edges if batch is None else edges[:-1]
            held = table.slice(int(whole[-1]))
            node, comp, n = (np.asarray(table.column(c)) for c in ("node", "comp", "n"))
            fold = np.asarray(pc.list_flatten(table.column("fold"))).view(np.uint64).reshape(-1, FOLD_WORDS)
            for start, stop in zip(whole[:-1].tolist(), whole[1:].tolist(), strict=True):
                own = slice(start, stop)
                yield node[own], comp[own], n[own], fold[own]

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = False
        for node, comp, n, fold in groups(batches):
            order = np.lexsort((node, n))
            node, comp, n, fold = node[order], comp[order], n[order], fold[order]
            # Sizes rise: partners of a set lie between the least and the largest it can link to.
            starts = np.searchsorted(n, -(-(n * plan.share.numerator) // plan.share.denominator))
            stops = np.searchsorted(n, n * plan.share.denominator // plan.share.numerator, side="right")
            a, b = [], []
            for x, (start, stop) in enumerate(zip(starts.tolist(), stops.tolist(), strict=True)):
                y = np.flatnonzero(comp[start:stop] != comp[x]) + start
                if not len(y):
                    continue
                bound = (n[x] + n[y]) * plan.numerator // plan.denominator
                y = y[np.bitwise_count(fold[y] ^ fold[x]).sum(axis=1) <= bound]
                more |= len(y) > most
                y = y[np.argsort(node[y])][:most]
                a += [node[x]] * len(y)
                b += node[y].tolist()
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([False] * len(a))], names=["a", "b", "more"])
        if more:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([True])], names=["a", "b", "more"])

    return run


def _near(pairs: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """The pairs whose sizes and folded sketches allow a link."""
    both = pairs
    for c in ("a", "b"):
        both = both.join(sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("fold").alias(f"fold_{c}")), c)
    apart = F.aggregate(F.zip_with("fold_a", "fold_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    total = F.col("n_a") + F.col("n_b")
    sizes = F.least("n_a", "n_b") * plan.share.denominator >= F.greatest("n_a", "n_b") * plan.share.numerator
    return both.where(sizes & (apart * plan.denominator <= total * plan.numerator)).select("a", "b")


def _block_rows(rows: DataFrame) -> DataFrame:
    """Each member of a bucket in its block, once for every block it is compared with."""
    counted = rows.groupBy("k").agg(F.count("*").alias("members"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("members") / BLOCK)).cast("long")
    rows = rows.join(counted, "k").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))


def _members(stored: DataFrame) -> DataFrame:
    """``k, node``: the buckets of two nodes or more.

    One shuffle by ranges of bucket and node, which also splits a crowded
    bucket; each task then drops the buckets of one node in passing.
    """
    parts = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    postings = stored.select(F.explode("keys").alias("k"), "node")
    ordered = postings.repartitionByRange(parts, "k", "node").sortWithinPartitions("k", "node")
    return ordered.mapInArrow(_runs, "k long, node long").distinct()


def _unsettled(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Members, with their component, of the buckets that hold several components."""
    named = members.join(comps.withColumnRenamed("component", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = named.groupBy("k").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("k")
    return named.join(mixed, "k", "left_semi").select("k", "node", "comp")


def linked_pairs(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, size: int = SHINGLE_WORDS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sketched rows, links that join every two linked sets by some path, and their components.

    Rows are ``doc_id, n, node``; ``node`` names a distinct set. Links ``a, b``
    are pairs of nodes that passed the exact test. First each set is tested with
    one other: of the sets that come first in its buckets, the one it shares
    most buckets with. That settles most groups of near copies. Then the members
    of buckets that still hold several components are compared, and each puts
    some candidates forward, more in each round until none has others; pairs
    that links join by then are not tried, and settled buckets are dropped. So
    the links of a large group of near copies stay in proportion to its members.
    """
    spark, plan = docs.sparkSession, Plan(threshold)
    path = new_folder(spark, "sketches")
    with small_batches(spark):
        _sketched(docs, doc_id, text, threshold, size).write.parquet(path)
    stored = spark.read.parquet(path)
    members = checkpointed(_members(stored))
    sets = stored.select("node", "n", "fold").join(members.select("node").distinct(), "node", "left_semi")
    sets = checkpointed(sets.groupBy("node").agg(F.first("n").alias("n"), F.first("fold").alias("fold")))
    firsts = members.groupBy("k").agg(F.min("node").alias("a"))
    shared = members.join(firsts, "k").where("a < node").groupBy("a", F.col("node").alias("b")).agg(F.count("*").alias("keys"))
    stars = shared.groupBy("b").agg(F.max_by("a", F.struct("keys", -F.col("a"))).alias("a")).select("a", "b")
    new = checkpointed(_near(stars, sets, plan))
    made: list[DataFrame] = []
    links, comps = stars.where("false"), components(stars.where("false"))
    tried, turn, more = None, 0, True
    while True:
        if not new.isEmpty():
            tested = _verified(docs, text, new, plan, size, made)
            tried = checkpointed(tested if tried is None else tried.unionByName(tested))
            links = tried.where("linked").select("a", "b")
            comps = components(links)
        if not more:
            break
        members = checkpointed(_unsettled(members.select("k", "node"), comps))
        if members.isEmpty():
            break
        compared = _block_rows(members.join(sets, "node")).select("k", "i", "j", "node", "comp", "n", "fold")
        compared = compared.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j")
        found = checkpointed(compared.mapInArrow(_compare(plan, turn), "a long, b long, more boolean"))
        more, turn = not found.where("more").isEmpty(), turn + 1
        pairs = found.where("not more").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        new = checkpointed(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
    return stored.select("doc_id", "n", "node"), links, comps


def _verified(docs: DataFrame, text: str, pairs: DataFrame, plan: Plan, size: int, made: list[DataFrame]) -> DataFrame:
    """The pairs with ``linked``, by the exact sizes of intersection and union.

    Whole sets are made again for the nodes of the pairs alone, unless ``made``
    has them from an earlier round.
    """
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    for sets in made:
        wanted = wanted.join(sets.select("node"), "node", "left_anti")
    wanted = checkpointed(wanted)
    if not wanted.isEmpty():
        made.append(_whole_sets(docs, text, wanted, size))
    sets = made[0]
    for more in made[1:]:
        sets = sets.unionByName(more)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashed").alias("x")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("hashed").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y")).cast("long")
    union = F.size("x") + F.size("y") - shared
    return both.select("a", "b", (shared * plan.share.denominator >= union * plan.share.numerator).alias("linked"))


def _marked(nodes: DataFrame) -> np.ndarray:
    """One bit, by its highest bits, for each node: a filter of fixed size that lets some others pass."""
    place = F.shiftrightunsigned("node", 64 - MARK_BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    words = nodes.select(F.shiftright(place, 6).alias("word"), bit.alias("bit"))
    table = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (MARK_BITS - 6), dtype=np.int64)
    out[np.asarray(table.column("word"))] = np.asarray(table.column("bits"))
    return out.view(np.uint64)


def _whole_sets(docs: DataFrame, text: str, wanted: DataFrame, size: int) -> DataFrame:
    """``node, hashed`` of the wanted nodes, made again where the texts lie."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(_marked(wanted))

    @F.arrow_udf("node long, hashed array<long>")
    @giving_back
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        met: set[int] = set()
        for batch in batches:
            for part in byte_slices(batch, SLICE_BYTES):
                node, kept = [], []
                for own in shingle_sets(filled(part), size):
                    name = _class_of(own)
                    place = (name & (1 << 64) - 1) >> (64 - MARK_BITS)
                    want = name not in met and bool(int(sent.value[place >> 6]) >> (place & 63) & 1)
                    if want:
                        met.add(name)
                    node.append(name if want else None)
                    # An empty slice of the set would keep all of it.
                    kept.append(own if want else np.zeros(0, dtype=np.uint64))
                yield pa.StructArray.from_arrays([pa.array(node, pa.int64()), _lists(kept)], ["node", "hashed"])

    made = docs.select(run(F.col(f"`{text}`")).alias("_s")).select("_s.*").where("node is not null")
    path = new_folder(spark, "sets")
    with small_batches(spark):
        made.join(wanted, "node", "left_semi").dropDuplicates(["node"]).write.parquet(path)
    return spark.read.parquet(path)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, size: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    The component is the smallest id that links reach. Equal sets are linked;
    a null text, or one without words, has no shingle and is its own
    component, as is a row that nothing links to. Rows of one id that are not
    alike are judged on their own. Null ids stay, and never name a component
    that holds another id.
    """
    rows, _, joined = linked_pairs(docs, doc_id, text, threshold, size)
    least = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    least = least.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = least.groupBy("component").agg(F.min("least").alias("component_id"))
    by_node = least.join(named, "component").select("node", "component_id")
    found = rows.join(by_node, "node", "left")
    return found.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
