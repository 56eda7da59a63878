"""Keyword search over blocks of passages with block maxima.

A block is about a thousand passages that lie together. Its index has one row for
each term, with the places, counts and lengths of the term's passages, and the
largest count and the least length among them: these bound the score that any
passage of the block can have for a query. Building it moves no row.

A search moves the blocks' rows of the asked terms once, whole, and scores a
block where all its rows are; no row for a query and a passage is ever shuffled.
First only bounds are read. The most promising block of each query is scored; its
k-th score is a threshold below which no block can add a hit, so blocks whose
bound is lower are not read, and within a block only the queries that can still
gain are scored.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passim.operators.lexical import B, K1, SCORE_DECIMALS, passage_tokens, query_terms
from passim.operators.nearest import _BLOCK_CELLS, _arrow_type, arrow_ids
from passim.operators.ranking import top_k
from passim.session import BROADCAST_BYTES, broadcast_within, checkpointed

BLOCK_ROWS = 1024
# Blocks whose rows are put in term order together when an index is built.
RUN_BLOCKS = 8
# Of a run, rows given out at once.
_RUN_ROWS = 16_384
# Passages whose blocks one task of a search has, whatever their number.
TASK_PASSAGES = 32_768
_ROWS = "block long, term string, docs array<int>, tfs array<int>, dls array<int>, most_tf int, least_dl int, passages int, tokens long"


@dataclass(frozen=True)
class TextIndex:
    """A stored index. ``rows`` has a row for each block and term, and one
    without a term for each block: its ``ids``, in order, and its size."""

    rows: DataFrame
    _sizes: list = field(default_factory=list, compare=False, repr=False)

    def terms(self) -> DataFrame:
        return self.rows.filter("term is not null").drop("ids", "tokens")

    def names(self) -> DataFrame:
        return self.rows.filter("term is null").select("block", "ids", "passages", "tokens")

    def size(self) -> tuple[int, float]:
        """Passages and their mean length."""
        if not self._sizes:
            row = self.names().agg(F.sum("passages").alias("n"), F.sum("tokens").alias("tokens")).first()
            self._sizes.append((row["n"] or 0, (row["tokens"] or 0) / (row["n"] or 1)))
        return self._sizes[0]


def _block_rows(ids: pa.Array, tokens: pa.Array, block: int, schema: pa.Schema) -> pa.RecordBatch:
    """The rows of one block; places follow the order of the ids."""
    order = np.argsort(arrow_ids(ids), kind="stable")
    ids, tokens = ids.take(pa.array(order)), tokens.take(pa.array(order))
    lengths = np.diff(np.asarray(tokens.offsets))
    coded = tokens.flatten().dictionary_encode()
    terms = coded.dictionary.cast(pa.string())
    rank = np.empty(len(terms), dtype=np.int64)
    rank[np.asarray(pc.sort_indices(terms))] = np.arange(len(terms))
    key, tf = np.unique(rank[np.asarray(coded.indices)] * len(ids) + np.repeat(np.arange(len(ids)), lengths), return_counts=True)
    term, doc = np.divmod(key, max(1, len(ids)))
    starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else term
    edges = pa.array(np.concatenate([starts, [len(term)]]).astype(np.int32))
    dl = lengths[doc]
    lists = [pa.ListArray.from_arrays(edges, pa.array(x.astype(np.int32))) for x in (doc, tf, dl)]
    most = np.maximum.reduceat(tf, starts) if len(starts) else tf
    least = np.minimum.reduceat(dl, starts) if len(starts) else dl
    n = len(starts)
    named = {
        "block": pa.array(np.full(n, block)),
        "term": pc.take(terms, pc.sort_indices(terms)),
        "docs": lists[0],
        "tfs": lists[1],
        "dls": lists[2],
        "most_tf": pa.array(most.astype(np.int32)),
        "least_dl": pa.array(least.astype(np.int32)),
        "passages": pa.array(np.diff(np.asarray(edges)).astype(np.int32)),
        "tokens": pa.nulls(n, pa.int64()),
        "ids": pa.nulls(n, schema.field("ids").type),
    }
    whole = {"block": [block], "passages": [len(ids)], "tokens": [int(lengths.sum())], "ids": [ids.to_pylist()]}
    parts = [pa.table(named).select(schema.names).cast(schema), pa.table([pa.array(whole.get(f.name, [None]), f.type) for f in schema], schema=schema)]
    return pa.concat_tables(parts).combine_chunks().to_batches()[0]


def write_text_index(passages: DataFrame, path: str, stop_words: list[str] | None = None, title_weight: int = 0, block_rows: int = BLOCK_ROWS) -> None:
    """Build the index of ``passages`` (``id`` unique, ``text``, ``title``), map-only.

    Files are runs of some blocks, each in term order: a task holds one run,
    however much it reads, and a reader of few terms skips the pages of others.
    """
    rows = passage_tokens(passages, stop_words, title_weight)
    fields = [*T._parse_datatype_string(_ROWS).fields, T.StructField("ids", T.ArrayType(rows.schema["id"].dataType))]
    schema = pa.schema([(f.name, _arrow_type(f.dataType)) for f in fields])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, made = TaskContext.get().partitionId() << 32, [], []

        def run() -> Iterator[pa.RecordBatch]:
            table = pa.concat_tables(pa.Table.from_batches([part]) for part in made)
            made.clear()
            order = pc.sort_indices(table, [("term", "ascending"), ("block", "ascending")], null_placement="at_start")
            for start in range(0, len(order), _RUN_ROWS):
                yield from table.take(order.slice(start, _RUN_ROWS)).combine_chunks().to_batches()

        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
            count = sum(b.num_rows for b in held)
            while count >= block_rows or (batch is None and count):
                table = pa.Table.from_batches(held).combine_chunks()
                part, rest = table.slice(0, block_rows), table.slice(block_rows)
                part = part.combine_chunks().to_batches()[0]
                made.append(_block_rows(part.column("id"), part.column("tokens"), block, schema))
                if len(made) == RUN_BLOCKS:
                    yield from run()
                block, count = block + 1, rest.num_rows
                held = rest.to_batches()
        if made:
            yield from run()

    rows.mapInArrow(build, T.StructType(fields)).write.mode("overwrite").parquet(path)


def open_text_index(spark: SparkSession, path: str) -> TextIndex:
    return TextIndex(spark.read.parquet(path))


@dataclass(frozen=True)
class _Asked:
    """Plain arrays of one batch of queries: of each term (sorted) its queries and weights."""

    qids: pa.Array
    terms: list[str]
    starts: np.ndarray
    queries: np.ndarray
    weights: np.ndarray

    def plain(self, avgdl: float, floor: np.ndarray) -> tuple:
        return dict(zip(self.terms, range(len(self.terms)), strict=True)), self.starts, self.queries, self.weights, avgdl, floor


def _saturation(tf: np.ndarray, dl: np.ndarray, avgdl: float) -> np.ndarray:
    return tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * dl / avgdl))


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each block, of batches sorted by block."""
    held: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        if batch is not None and not batch.num_rows:
            continue
        blocks = None if batch is None else np.asarray(batch.column("block"))
        start = 0
        edges = [] if batch is None else [*(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
        for stop in edges:
            if held and held[-1].column("block")[0].as_py() != blocks[start]:
                yield held[0].column("block")[0].as_py(), pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(start, stop - start))
            start = stop
        if batch is None and held:
            yield held[0].column("block")[0].as_py(), pa.Table.from_batches(held).combine_chunks()


def _bounds(table: pa.Table, plain: tuple) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The most that each query can score in the block, and (row, term) of its rows that count."""
    numbers, starts, queries, weights, avgdl, floor = plain
    most = _saturation(np.asarray(table.column("most_tf"), dtype=float), np.asarray(table.column("least_dl"), dtype=float), avgdl)
    bound, rows = np.zeros(len(floor)), []
    for row, term in enumerate(table.column("term").to_pylist()):
        at = numbers.get(term)
        if at is not None:
            own = slice(starts[at], starts[at + 1])
            bound[queries[own]] += weights[own] * most[row]
            rows.append((row, at))
    return bound, rows


def _scores(table: pa.Table, plain: tuple, wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of queries that can reach their floor, and their scores of all the block's passages."""
    _, starts, queries, weights, avgdl, floor = plain
    bound, rows = _bounds(table, plain)
    live = np.flatnonzero((bound > 0) & (np.round(bound, SCORE_DECIMALS) >= floor) if wanted is None else wanted & (bound > 0))
    if not len(live):
        return
    lists = [table.column(c).chunk(0) for c in ("docs", "tfs", "dls")]
    offsets = [np.asarray(x.offsets) for x in lists]
    docs, tfs, dls = (np.asarray(x.values) for x in lists)
    width = int(docs.max()) + 1
    step = max(1, _BLOCK_CELLS // width)
    place = np.full(len(floor), -1)
    for s in range(0, len(live), step):
        some = live[s : s + step]
        place[:] = -1
        place[some] = np.arange(len(some))
        total = np.zeros((len(some), width))
        for row, at in rows:
            own = slice(starts[at], starts[at + 1])
            line = place[queries[own]]
            if not (line >= 0).any():
                continue
            low, high = offsets[0][row], offsets[0][row + 1]
            gain = _saturation(tfs[low:high].astype(float), dls[low:high].astype(float), avgdl)
            total[line[line >= 0][:, None], docs[low:high][None, :]] += weights[own][line >= 0][:, None] * gain[None, :]
        yield some, np.round(total, SCORE_DECIMALS)


def _best(k: int, sent) -> Callable:
    """Of each task the passages that can be among the first k of a query: ``q, block, doc, score``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, starts, queries, weights, avgdl, floor = sent.value
        floor = floor.copy()
        best: dict[int, np.ndarray] = {}
        for block, table in _blocks_of(batches):
            out = []
            for some, total in _scores(table, (numbers, starts, queries, weights, avgdl, floor)):
                for q, score in zip(some.tolist(), total, strict=True):
                    cut = max(floor[q], np.partition(score, len(score) - k)[len(score) - k] if len(score) > k else 0.0)
                    doc = np.flatnonzero((score >= cut) & (score > 0))
                    doc = doc[np.lexsort((doc, -score[doc]))][:k]
                    if len(doc):
                        out.append((np.full(len(doc), q), doc, score[doc]))
                        held = np.concatenate([best.get(q, score[:0]), score[doc]])
                        best[q] = held = np.sort(held)[-k:]
                        if len(held) == k:
                            floor[q] = max(floor[q], held[0])
            if out:
                q, doc, score = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.full(len(q), block)), pa.array(doc), pa.array(score)], names=["q", "block", "doc", "score"])

    return run


def _bounding(sent) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in _blocks_of(batches):
            bound, _ = _bounds(table, sent.value)
            q = np.flatnonzero(bound)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.full(len(q), block)), pa.array(np.round(bound[q], SCORE_DECIMALS))], names=["q", "block", "bound"])

    return run


def _together(rows: DataFrame, index: TextIndex) -> DataFrame:
    """All rows of a block in one task, side by side; more tasks for more passages."""
    tasks = -(-index.size()[0] // TASK_PASSAGES)
    few = tasks <= int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.repartition("block") if few else rows.repartition(tasks, "block")).sortWithinPartitions("block")


def _batches(queries: DataFrame, index: TextIndex, stop_words: list[str] | None, budget: int) -> Iterator[_Asked]:
    """The queries with their weighted terms, in batches that fit the budget."""
    asked = query_terms(queries, stop_words)
    found = index.terms().select("term", "passages").join(asked.select("term").distinct(), "term", "left_semi")
    df = F.col("df")
    idf = F.log(1.0 + (F.lit(index.size()[0]) - df + 0.5) / (df + 0.5))
    weighted = checkpointed(asked.join(found.groupBy("term").agg(F.sum("passages").alias("df")), "term").select("qid", "term", idf.alias("idf")))
    parts = -(-weighted.count() // max(1, budget // 128))
    for part in range(parts):
        table = weighted.filter(F.pmod(F.xxhash64("qid"), F.lit(parts)) == part).toArrow()
        if not table.num_rows:
            continue
        qid, term = table.column("qid").combine_chunks().dictionary_encode(), table.column("term").combine_chunks().dictionary_encode()
        order = np.argsort(np.asarray(term.indices), kind="stable")
        starts = np.searchsorted(np.asarray(term.indices)[order], np.arange(len(term.dictionary) + 1))
        yield _Asked(qid.dictionary, term.dictionary.to_pylist(), starts, np.asarray(qid.indices)[order].astype(np.int64), np.asarray(table.column("idf"))[order])


def _hits(spark: SparkSession, asked: _Asked, index: TextIndex, avgdl: float, k: int) -> DataFrame:
    """``q, block, doc, score`` of passages among which are the first k of each query."""
    terms = spark.createDataFrame([(t,) for t in asked.terms], "term string")
    rows = index.terms().join(F.broadcast(terms), "term", "left_semi")
    floor = np.full(len(asked.qids), -np.inf)
    sent = spark.sparkContext.broadcast(asked.plain(avgdl, floor))
    scored = "q long, block long, doc long, score double"
    columns = ["block", "term", "docs", "tfs", "dls", "most_tf", "least_dl"]
    light = _together(rows.select("block", "term", "most_tf", "least_dl"), index)
    bounds = checkpointed(light.mapInArrow(_bounding(sent), "q long, block long, bound double"))
    # The block of the highest bound for each query, scored for all queries.
    lead = checkpointed(bounds.groupBy("q").agg(F.max_by("block", F.struct("bound", "block")).alias("block")).select("block").distinct())
    first = checkpointed(_together(rows.join(lead, "block", "left_semi").select(*columns), index).mapInArrow(_best(k, sent), scored))
    for r in top_k(first, ["q"], [F.col("score").desc()], k).filter(F.col("rank") == k).select("q", "score").collect():
        floor[r["q"]] = r["score"]
    sent = spark.sparkContext.broadcast(asked.plain(avgdl, floor))
    floors = spark.createDataFrame([(i, float(f)) for i, f in enumerate(floor)], "q long, floor double")
    live = bounds.join(F.broadcast(floors), "q").filter(F.col("bound") >= F.col("floor")).select("block").distinct()
    rest = rows.join(live.join(lead, "block", "left_anti"), "block", "left_semi").select(*columns)
    return first.unionByName(_together(rest, index).mapInArrow(_best(k, sent), scored))


def search_text(
    queries: DataFrame, index: TextIndex, k: int, stop_words: list[str] | None = None, budget: int = BROADCAST_BYTES
) -> DataFrame:
    """Top-k by BM25: ``qid, rank, id, score``, as ``lexical.bm25``. Ties go to the lower id.

    Queries whose weighted terms exceed the budget are answered batch by batch.
    """
    spark, avgdl = queries.sparkSession, index.size()[1]
    kinds = f"qid {queries.schema['qid'].dataType.simpleString()}, id {index.rows.schema['ids'].dataType.elementType.simpleString()}"
    found = spark.createDataFrame([], f"{kinds}, score double")
    for asked in _batches(queries, index, stop_words, budget):
        hits = checkpointed(_hits(spark, asked, index, avgdl, k))
        found = found.unionByName(_named(hits, asked, index))
    return top_k(found, ["qid"], [F.col("score").desc(), F.col("id")], k).select("qid", "rank", "id", "score")


def _named(hits: DataFrame, asked: _Asked, index: TextIndex) -> DataFrame:
    """``qid, id`` for ``q, block, doc``; only names of blocks with hits count."""
    spark = hits.sparkSession
    qids = spark.createDataFrame(pa.table({"q": pa.array(range(len(asked.qids)), pa.int64()), "qid": asked.qids}))
    small = broadcast_within(hits, hits.count(), 64)
    named = index.names().select("block", "ids").join(small, "block").select("q", F.get("ids", F.col("doc").cast("int")).alias("id"), "score")
    return named.join(F.broadcast(qids), "q").select("qid", "id", "score")


def text_places(
    pairs: DataFrame, queries: DataFrame, index: TextIndex, stop_words: list[str] | None = None, budget: int = BROADCAST_BYTES
) -> DataFrame:
    """``qid, id, rank`` of the pairs ``qid, id`` in the whole ranking of their query.

    One pass scores the pairs, another counts the passages before each. A pair
    without a common term has no rank and no row.
    """
    spark, avgdl = pairs.sparkSession, index.size()[1]
    places = index.names().select("block", F.posexplode("ids").alias("doc", "id"))
    placed = checkpointed(pairs.select("qid", "id").distinct().join(places, "id"))
    kinds = f"qid {pairs.schema['qid'].dataType.simpleString()}, id {pairs.schema['id'].dataType.simpleString()}"
    out = spark.createDataFrame([], f"{kinds}, rank long")
    for asked in _batches(queries.join(placed.select("qid").distinct(), "qid", "left_semi"), index, stop_words, budget):
        qids = spark.createDataFrame(pa.table({"q": pa.array(range(len(asked.qids)), pa.int64()), "qid": asked.qids}))
        own = checkpointed(placed.join(F.broadcast(qids), "qid"))
        # Pairs of these queries, a bounded number at a time.
        turns = max(1, -(-own.count() // max(1, budget // 128)))
        for turn in range(turns):
            some = own.filter(F.pmod(F.xxhash64("qid", "id"), F.lit(turns)) == turn)
            ranks = _ranked(spark, asked, index, avgdl, some)
            out = out.unionByName(ranks.join(F.broadcast(qids), "q").select("qid", "id", "rank"))
    return out


def _ranked(spark: SparkSession, asked: _Asked, index: TextIndex, avgdl: float, pairs: DataFrame) -> DataFrame:
    """``q, id, rank`` of ``q, block, doc, id``."""
    wanted = pairs.select("q", "block", "doc").toArrow()
    q, block, doc = (np.asarray(wanted.column(c)) for c in ("q", "block", "doc"))
    plain = asked.plain(avgdl, np.full(len(asked.qids), -np.inf))
    sent = spark.sparkContext.broadcast((plain, q, block, doc))
    terms = spark.createDataFrame([(t,) for t in asked.terms], "term string")
    columns = ["block", "term", "docs", "tfs", "dls", "most_tf", "least_dl"]
    rows = index.terms().join(F.broadcast(terms), "term", "left_semi").select(*columns)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, q, block, doc = sent.value
        for name, table in _blocks_of(batches):
            here = np.flatnonzero(block == name)
            wanted = np.zeros(len(plain[-1]), dtype=bool)
            wanted[q[here]] = True
            for some, total in _scores(table, plain, wanted):
                line = np.full(len(wanted), -1)
                line[some] = np.arange(len(some))
                own = here[(line[q[here]] >= 0) & (doc[here] < total.shape[1])]
                value = total[line[q[own]], doc[own]]
                own, value = own[value > 0], value[value > 0]
                yield pa.RecordBatch.from_arrays([pa.array(q[own]), pa.array(block[own]), pa.array(doc[own].astype(np.int64)), pa.array(value)], names=["q", "block", "doc", "score"])

    few = spark.createDataFrame(pa.table({"block": pa.array(np.unique(block), pa.int64())}))
    there = _together(rows.join(F.broadcast(few), "block", "left_semi"), index)
    scored = checkpointed(there.mapInArrow(score, "q long, block long, doc long, score double").join(pairs.withColumn("doc", F.col("doc").cast("long")), ["q", "block", "doc"]))
    held = scored.select("q", "id", "score").toArrow()
    number, value = np.asarray(held.column("q")), np.asarray(held.column("score"))
    marks = spark.sparkContext.broadcast((plain, number, value, held.column("id").combine_chunks()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, number, value, ids = marks.value
        names, before = arrow_ids(ids), np.zeros(len(number), dtype=np.int64)
        wanted = np.zeros(len(plain[-1]), dtype=bool)
        wanted[number] = True
        for _, table in _blocks_of(batches):
            whole = table.filter(pc.is_null(table.column("term"))).column("ids").combine_chunks()
            own = arrow_ids(whole.flatten())
            termed = table.filter(pc.is_valid(table.column("term"))).combine_chunks()
            if not termed.num_rows:
                continue
            for some, total in _scores(termed, plain, wanted):
                line = np.full(len(wanted), -1)
                line[some] = np.arange(len(some))
                for i in np.flatnonzero(line[number] >= 0).tolist():
                    score = total[line[number[i]]]
                    level = np.flatnonzero(score == value[i])
                    before[i] += (score > value[i]).sum() + (own[level] < names[i]).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(number))), pa.array(before)], names=["i", "before"])

    both = rows.withColumn("ids", F.lit(None).cast(index.rows.schema["ids"].dataType))
    named = index.names().select("block", "ids")
    both = both.unionByName(named.select(*[F.lit(None).cast(both.schema[c].dataType).alias(c) if c not in ("block", "ids") else F.col(c) for c in both.columns]))
    counted = _together(both, index).mapInArrow(count, "i long, before long").groupBy("i").agg(F.sum("before").alias("before"))
    which = spark.createDataFrame(pa.table({"i": pa.array(np.arange(len(number))), "q": held.column("q"), "id": held.column("id")}))
    return counted.join(F.broadcast(which), "i").select("q", "id", (F.col("before") + 1).alias("rank"))
