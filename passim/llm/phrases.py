"""Phrase collocations: counts of the longest windows, marginalised to shorter ones.

Each word leads one window: itself and the words that follow it in its piece, up
to the longest phrase asked for, padded with nulls. A phrase occurs as often as
windows begin with it, so only windows are counted, and ROLLUP sums them to ever
shorter prefixes.

Phrases below a least count are never needed, nor is any phrase that holds one
below it. Words and pairs, and then triples of common pairs, are counted by hash
beforehand, in tables of fixed size; where the bucket of one stays below the least
count, no window goes over it. Buckets that several share only let more through.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passim.llm.arrow import SLICE_BYTES, byte_slices, filled, hashes
from passim.session import checkpointed

MAX_WORDS = 4
MIN_COUNT = 30
TOP = 2000
SCORE_SCALE = 2_000_000
# A phrase goes if a longer one is this much (in hundredths) as common.
COVERED = 80
UNKNOWN = "und"
# Orders that are counted by hash, in two passes, and the buckets of each: one
# bit of a bucket (8 MB for each order) is sent to the tasks.
PASSES = ((1, 2), (3,))
BUCKET_BITS = 26
BLOCK_BITS = 12
# Windows that a task counts by hash at once, and bytes of texts that it works on.
HELD_WINDOWS = 1 << 21
PART_BYTES = SLICE_BYTES // 4
_U = np.uint64
_MIX = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_SPACES, _BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
_BREAK = np.isin(np.arange(256), list(_BREAKS))
_INSIDE = ~np.isin(np.arange(256), list(_SPACES + _BREAKS))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _parts(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of some texts, where texts begin among them, and which they are; a long text is cut behind breaks."""
    at = 0
    for part in byte_slices(texts, PART_BYTES):
        _, offsets, data = part.buffers()
        ends = np.frombuffer(offsets, dtype=np.int64)[part.offset : part.offset + len(part) + 1]
        raw = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, dtype=np.uint8)
        rows, done = np.arange(at, at + len(part)), 0
        at += len(part)
        if len(raw) <= PART_BYTES:
            yield raw, ends[:-1] - ends[0], rows
            continue
        while done < len(raw):
            stop = done + PART_BYTES
            while stop < len(raw) and not (found := np.flatnonzero(_BREAK[raw[stop : stop + PART_BYTES]])).size:
                stop += PART_BYTES
            stop = min(len(raw), stop + int(found[0]) + 1) if stop < len(raw) else len(raw)
            yield raw[done:stop], np.zeros(1, dtype=np.int64), rows
            done = stop


def split_words(raw: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Of all words: the index among the distinct ones, these, the text's index, and whether the next word is in the same piece."""
    inside = _INSIDE[raw]
    begins = np.minimum(begins, len(raw))
    edges = begins[begins < len(raw)]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    lengths = np.concatenate([[0], np.cumsum(end - start)])
    data = pa.py_buffer(_LOWER[raw[inside]].tobytes())
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(lengths.astype(np.int64)), data).dictionary_encode()
    text = np.searchsorted(begins, start, side="right") - 1
    breaks = np.concatenate([[0], np.cumsum(_BREAK[raw])])
    joined = np.zeros(len(start), dtype=bool)
    joined[:-1] = (breaks[start[1:]] == breaks[end[:-1]]) & (text[1:] == text[:-1])
    return np.asarray(words.indices).astype(np.int64), words.dictionary, text, joined


class _Words:
    """The words of some texts, each as the index of a distinct one, with its language."""

    def __init__(self, raw: np.ndarray, begins: np.ndarray, language: np.ndarray, languages: pa.Array):
        self.index, self.distinct, text, self.joined = split_words(raw, begins)
        self.language, self.languages = language[text], languages

        self.word, self.own = hashes(self.distinct.to_pylist()), hashes(self.languages.to_pylist())

    def buckets(self, places: np.ndarray, order: int, bits: int) -> np.ndarray:
        """The bucket of the ``order`` words that begin at each place, by language."""
        key = self.own[self.language[places]]
        for k in range(order):
            key = (key ^ self.word[self.index[places + k]]) * _MIX[0]
            key = key ^ (key >> _U(29))
        return (key * _MIX[1]) >> _U(64 - bits)

    def common(self, tables: list[np.ndarray], bits: int) -> tuple[list[np.ndarray], np.ndarray]:
        """For each table (of words, pairs ...) whether so many words, common by it, begin at a place,
        and where words of the next order may begin, with all shorter ones common."""
        found, may = [], np.ones(len(self.index), dtype=bool)
        for order, table in enumerate(tables, 1):
            places = np.flatnonzero(may)
            bucket = self.buckets(places, order, bits).astype(np.int64)
            yes = np.zeros(len(may), dtype=bool)
            yes[places] = (table[bucket >> 3] >> (7 - (bucket & 7)) & 1).astype(bool)
            found.append(yes)
            may = self.joined & yes & np.append(yes[1:], False)
        return found, may

    def lengths(self, tables: list[np.ndarray], bits: int, most: int) -> np.ndarray:
        """How many words the window has that each word leads; 0 for a rare word."""
        found, _ = self.common(tables, bits)
        out = np.zeros(len(self.index), dtype=np.int64)
        for order, yes in enumerate(found, 1):
            out[yes] = min(order, most)
        # Beyond the highest table, as far as each further step is common by it.
        order, last = len(found), found[-1]
        for _ in range(most - order):
            reach = np.where(np.append(last[1:], False), np.append(out[1:], 0) + 1, order)
            out = np.where(last, np.minimum(reach, most), out)
        return out

    def windows(self, lengths: np.ndarray, most: int) -> list[pa.Array]:
        """Language, words (null beyond the window's length) and count of each distinct window."""
        place, size = np.arange(len(self.index)), len(self.distinct) + 1
        columns = [self.language]
        for k in range(most):
            # The leading word is in every window; the k-th next one in those that reach so far.
            columns.append(np.where(lengths > k, self.index[np.minimum(place + k, len(place) - 1)], -1))
        group, span = self.language, len(self.languages)
        for column in columns[1:]:
            if span * size >= 1 << 62:
                known, group = np.unique(group, return_inverse=True)
                span = len(known)
            group, span = group * size + column + 1, span * size
        _, first, counts = np.unique(group, return_index=True, return_counts=True)
        language, *words = (c[first] for c in columns)
        return [self.languages.take(pa.array(language)), *(self.distinct.take(pa.array(w, mask=w < 0)).cast(pa.string()) for w in words), pa.array(counts)]


def _worded(batch: pa.RecordBatch) -> Iterator[_Words]:
    pa.default_memory_pool().release_unused()
    names = batch.column("lang").dictionary_encode()
    codes = np.asarray(names.indices).astype(np.int64)
    for raw, begins, rows in _parts(filled(batch.column("text"))):
        yield _Words(raw, begins, codes[rows], names.dictionary)


def _common(texts: DataFrame, sent: list, orders: tuple[int, ...], min_count: int, bits: int) -> list[np.ndarray]:
    """For each order one bit for each bucket: whether its words occur ``min_count`` times together.

    Tables of lower orders, sent out already, leave out what cannot be common.
    """
    size, count_type = 1 << BLOCK_BITS, np.min_scalar_type(2 * min_count)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            bucket, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            block = (bucket >> _U(BLOCK_BITS)).astype(np.int64)
            starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else block
            places, counts = (bucket & _U(size - 1)).astype("<u2"), np.minimum(n, min_count).astype(count_type)
            packed = lambda x: [p.tobytes() for p in np.split(x, starts[1:])] if len(x) else []
            return pa.RecordBatch.from_arrays([pa.array(block[starts]), pa.array(packed(places), pa.binary()), pa.array(packed(counts), pa.binary())], names=["block", "places", "counts"])

        for batch in batches:
            for words in _worded(batch):
                _, may = words.common([t.value for t in sent], bits)
                for turn, order in enumerate(orders):
                    places = np.flatnonzero(may if not turn else words.joined)
                    held.append(words.buckets(places, order, bits) + _U(turn << bits))
                if sum(map(len, held)) >= HELD_WINDOWS:
                    yield counted()
        if held:
            yield counted()

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted, so that one block is held at a time."""
        at, total = None, np.zeros(size, dtype=count_type)
        done: tuple[list[int], list[bytes]] = ([], [])
        for batch in batches:
            for block, places, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "places", "counts")), strict=True):
                if block != at and at is not None:
                    done[0].append(at)
                    done[1].append(np.packbits(total >= min_count).tobytes())
                    total[:] = 0
                at, place = block, np.frombuffer(places, dtype="<u2")
                total[place] = np.minimum(total[place] + np.frombuffer(counts, dtype=count_type), min_count)
        if at is not None:
            done[0].append(at)
            done[1].append(np.packbits(total >= min_count).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.int64()), pa.array(done[1], pa.binary())], names=["block", "bits"])

    dealt = texts.mapInArrow(count, "block long, places binary, counts binary").repartition("block").sortWithinPartitions("block")
    out = np.zeros((len(orders) << (bits - BLOCK_BITS), size // 8), dtype=np.uint8)
    for batch in dealt.mapInArrow(combine, "block long, bits binary").toArrow().to_batches():
        rows = np.frombuffer(b"".join(batch.column("bits").to_pylist()), dtype=np.uint8).reshape(-1, size // 8)
        out[np.asarray(batch.column("block"))] = rows
    return [table.ravel() for table in np.split(out, len(orders))]


def count_phrases(
    docs: DataFrame, lang: str = "lang", text: str = "text", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, bucket_bits: int = BUCKET_BITS
) -> tuple[DataFrame, DataFrame]:
    """``lang, words, f`` of every phrase of up to ``max_words`` words that occurs
    ``min_count`` times, and ``lang, n`` with all word occurrences.

    A null language is ``und``, a null text empty; repeated rows count each.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(f"`{text}`").alias("text"))
    sent: list = []
    for orders in PASSES:
        if orders[-1] <= max(2, max_words - 1):
            sent += [spark.sparkContext.broadcast(table) for table in _common(texts, sent, orders, min_count, bucket_bits)]
    names = [f"w{k}" for k in range(1, max_words + 1)]

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [t.value for t in sent]
        for batch in batches:
            for words in _worded(batch):
                if len(words.index):
                    found = words.windows(words.lengths(tables, bucket_bits, max_words), max_words)
                    yield pa.RecordBatch.from_arrays(found, names=["lang", *names, "n"])

    found = texts.mapInArrow(windows, ", ".join(f"{c} string" for c in ("lang", *names)) + ", n long")
    # One shuffle of whole windows; their prefixes are then few.
    found = found.groupBy("lang", *names).agg(F.sum("n").alias("n"))
    level = F.grouping_id()
    rolled = found.rollup("lang", *names).agg(F.sum("n").alias("f"), level.alias("level"))
    # A prefix that reaches into the padding is not one; the filter runs before the sums.
    whole = F.lit(False)
    for k in range(max_words + 1):
        whole |= (F.col("level") == (1 << (max_words - k)) - 1) & (F.col(names[k - 1]).isNotNull() if k else F.lit(True))
    rolled = rolled.where(whole)
    total = (1 << max_words) - 1
    rolled = checkpointed(rolled.where((F.col("f") >= min_count) | (F.col("level") == total)))
    words = F.filter(F.array(*names), lambda w: w.isNotNull())
    return rolled.where(F.col("level") < total).select("lang", words.alias("words"), "f"), rolled.where(F.col("level") == total).select("lang", F.col("f").alias("n"))


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")


def mine_phrases(
    docs: DataFrame,
    lang: str = "lang",
    text: str = "text",
    max_words: int = MAX_WORDS,
    min_count: int = MIN_COUNT,
    top: int = TOP,
    covered: int = COVERED,
    bucket_bits: int = BUCKET_BITS,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of each language.

    Texts have A-Z lower-cased and are cut into pieces at ``. , ; : ! ?`` and
    line ends, pieces into words at spaces and tabs. A candidate of 2 or more
    words occurs ``a >= min_count`` times; of its cuts into a first part (``l``
    occurrences) and a rest (``r``) the one of least ``floor(2000000 a / (l + r))``
    counts, the shortest first part on a tie. A candidate that a longer one holds
    which is at least ``covered`` hundredths as common is dropped. Ranks go by
    score, ``a``, both falling, and the bytes of the phrase.

    Null languages are ``und`` and null texts empty; without words there is no row.
    """
    counts, totals = count_phrases(docs, lang, text, max_words, min_count, bucket_bits)
    size = F.size("words")
    parts = counts.select("lang", _joined(F.col("words")).alias("part"), F.col("f"))
    candidates = counts.where(size > 1).select("lang", "words", _joined(F.col("words")).alias("phrase"), F.col("f").alias("a"))
    cuts = candidates.select("lang", "words", "phrase", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "lang",
        "phrase",
        "a",
        "k",
        _joined(F.slice("words", F.lit(1), F.col("k"))).alias("first"),
        _joined(F.slice("words", F.col("k") + 1, F.lit(max_words))).alias("rest"),
    )
    cuts = cuts.join(parts.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    # Decimals, as products may pass 64 bits.
    score = F.expr(f"{SCORE_SCALE} * cast(a as decimal(24,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inner = candidates.where(size > 2).select("lang", "words", "a", F.explode(F.sequence(F.lit(2), size - 1)).alias("len"))
    inner = inner.select("lang", "words", "a", "len", F.explode(F.sequence(F.lit(1), size - F.col("len") + 1)).alias("from"))
    longer = inner.groupBy("lang", _joined(F.slice("words", F.col("from"), F.col("len"))).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | F.expr(f"100 * cast(longer as decimal(24,0)) < {int(covered)} * cast(a as decimal(24,0))")
    )
    kept = kept.select("lang", "phrase", "a", "cut.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The first of each part of a language, and of these the first: no task ranks a whole language.
    parts_of = F.pmod(F.xxhash64("phrase"), F.lit(docs.sparkSession.sparkContext.defaultParallelism))
    local = kept.withColumn("part", parts_of).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    ranked = local.where(F.col("rank") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.where(F.col("rank") <= top).join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
