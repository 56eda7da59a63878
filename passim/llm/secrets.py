"""Secret scans: fixed patterns, and words that look random to character Markov models.

Everything is an expression over the row, so a scan is one pass without a shuffle.
"""

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# The two others hold their least length: a run that is too short holds no other match.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# A candidate for the models: a long run that is not a plain word.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]{0,200}[0-9])[A-Za-z0-9+/_=-]{20,}"
MIN_VALUE = 6
# Rows that ordinary identifiers are taken from, and the pairs of characters that each model keeps.
SAMPLE_ROWS = 20_000
SYMBOLS = 66
# Weight of the next symbol's own frequency in the chance of a pair.
LEAN = 10
# Mean log-likelihood ratio per pair of characters from which a candidate is a secret.
MIN_RATIO = 0.5


def _spans(text: Column, pattern: str, kind: str) -> Column:
    """``start, end, kind, found`` of leftmost non-overlapping matches, in code points.

    The pieces between matches and the matches themselves, in turn, add up to
    the places; texts without a match are read once.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.zip_with(between, found, lambda b, m: F.struct(F.length(b).alias("gap"), m.alias("m")))
    pairs = F.filter(pairs, lambda p: p["m"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,kind:string,found:string>>").alias("out"))
    walk = F.aggregate(
        pairs,
        start,
        lambda acc, p: F.struct(
            (acc["at"] + p["gap"] + F.length(p["m"])).alias("at"),
            F.concat(
                acc["out"],
                F.array(
                    F.struct(
                        (acc["at"] + p["gap"]).alias("start"),
                        (acc["at"] + p["gap"] + F.length(p["m"])).alias("end"),
                        F.lit(kind).alias("kind"),
                        p["m"].alias("found"),
                    )
                ),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(text.rlike(pattern), walk).otherwise(F.array().cast("array<struct<start:int,end:int,kind:string,found:string>>"))


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns by start, then by kind as listed."""
    assign = F.filter(_spans(text, ASSIGN, "0assign"), lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 1)) >= MIN_VALUE)
    return F.array_sort(F.concat(assign, _spans(text, ACCESS, "1access"), _spans(text, HEX, "2hex")), _order)


def _order(a: Column, b: Column) -> Column:
    by_kind = F.when(a["kind"] < b["kind"], -1).when(a["kind"] > b["kind"], 1).otherwise(0)
    return F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(by_kind)


def _pairs(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda i: F.substring(word, i, F.lit(2)))


class SecretModel:
    """Log-likelihood ratio of each pair of characters, random against ordinary."""

    def __init__(self, ratios: dict[str, float]):
        self.ratios = ratios

    def ratio(self, word: Column) -> Column:
        """Mean ratio of a word's pairs; pairs that neither model saw count 0."""
        table = F.from_json(F.lit(json.dumps(self.ratios)), "map<string,double>")
        total = F.aggregate(_pairs(word), F.lit(0.0), lambda acc, p: acc + F.coalesce(F.try_element_at(table, p), F.lit(0.0)))
        return F.when(F.length(word) > 1, total / (F.length(word) - 1)).otherwise(0.0)


def train_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> SecretModel:
    """Two models of which character follows which, from labelled samples.

    Random strings are the values of the fixed patterns; ordinary identifiers
    are the long words outside of them, which hold letters, ``-`` and ``_``
    alone. Both come from at most about ``sample_rows`` rows that hold a
    pattern, and as many others, picked by the hash of the id. Without random
    strings, the model finds nothing.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("string").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    marked = rows.withColumn("hit", F.col("text").rlike(ASSIGN) | F.col("text").rlike(ACCESS) | F.col("text").rlike(HEX))
    counts = {r["hit"]: r["n"] for r in marked.groupBy("hit").agg(F.count("*").alias("n")).collect()}
    drawn = F.pmod(F.xxhash64(F.coalesce("id", F.lit("")), F.lit("secrets")), F.lit(1 << 30))
    share = {hit: int(min(1.0, sample_rows / max(1, counts.get(hit, 0))) * (1 << 30)) for hit in (True, False)}
    sample = marked.where(drawn < F.when(F.col("hit"), share[True]).otherwise(share[False]))
    value = F.transform(
        base_spans(F.col("text")),
        lambda s: F.when(s["kind"] == "0assign", F.regexp_extract(s["found"], ASSIGN, 1)).otherwise(s["found"]),
    )
    secret = sample.where("hit").select(F.lit(1).alias("label"), F.explode(value).alias("word"))
    blank = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    ordinary = F.regexp_extract_all(blank, F.lit(r"[A-Za-z_-]{6,}"), F.lit(0))
    plain = sample.select(F.lit(0).alias("label"), F.explode(ordinary).alias("word"))
    pairs = secret.unionByName(plain).select("label", F.explode(_pairs(F.col("word"))).alias("pair"))
    # At most the square of the symbols comes back for each label.
    table = pairs.groupBy("label", "pair").agg(F.count("*").alias("n")).collect()
    return SecretModel(_ratios([(r["label"], r["pair"], r["n"]) for r in table]))


def _ratios(table: list[tuple[int, str, int]]) -> dict[str, float]:
    """Log P(next | this) of random strings less that of ordinary ones, for all
    pairs of symbols seen; rare pairs lean on how common the next symbol is."""
    import math

    count: dict[tuple[int, str], int] = {}
    first: dict[tuple[int, str], int] = {}
    second: dict[tuple[int, str], int] = {}
    total = [0, 0]
    for label, pair, n in table:
        count[label, pair] = n
        first[label, pair[0]] = first.get((label, pair[0]), 0) + n
        second[label, pair[1]] = second.get((label, pair[1]), 0) + n
        total[label] += n
    if not total[1]:
        return {}
    symbols = sorted({c for _, pair in count for c in pair})

    def chance(label: int, a: str, b: str) -> float:
        alone = (second.get((label, b), 0) + 0.5) / (total[label] + 0.5 * SYMBOLS)
        return (count.get((label, a + b), 0) + LEAN * alone) / (first.get((label, a), 0) + LEAN)

    return {a + b: math.log(chance(1, a, b) / chance(0, a, b)) for a in symbols for b in symbols}


def find_secrets(docs: DataFrame, model: SecretModel, text: str = "text", min_ratio: float = MIN_RATIO) -> DataFrame:
    """The rows with ``_base`` and ``_spans``: spans ``start, end, kind``, in order.

    Base spans are those of the fixed patterns. The models add spans of kind
    ``markov``: long runs with a digit, outside of all base spans, whose mean
    ratio is at least ``min_ratio``. A null text counts as empty.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    found = docs.withColumn("_base", base_spans(whole))
    if model.ratios:
        free = F.filter(_spans(whole, CANDIDATE, "3markov"), lambda s: model.ratio(s["found"]) >= min_ratio)
        free = F.filter(free, lambda s: ~F.exists(F.col("_base"), lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"])))
        found = found.withColumn("_spans", F.array_sort(F.concat("_base", free), _order))
    else:
        found = found.withColumn("_spans", F.col("_base"))
    return found


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.substring(s["kind"], 2, 100), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each run of overlapping spans replaced by ``mark``."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    walk = F.aggregate(
        spans,
        start,
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).alias("out")),
        ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, walk).otherwise(text)
