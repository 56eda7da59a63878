"""Language ID: known words first, then ever shorter character n-grams."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passim.llm.arrow import byte_slices, filled, giving_back, hashes, sums_by_row, words
from passim.session import checkpointed

UNDETERMINED = "und"
# Labelled texts that the model is fitted on, for each language.
SAMPLE_DOCS = 4000
# Words and n-grams of fewer of these texts and words, over all languages, are left out.
LEAST_COUNT = 2
GRAM_SIZES = (5, 4, 3, 2, 1)
# Words of evidence that the score counts at most.
EVIDENCE_WORDS = 20
SMOOTHING = 0.5


class LanguageModel:
    """Log frequencies of words and n-grams in each language.

    ``units`` has, for words (0) and each size of n-grams, the sorted hashes of
    the units and their rows of log frequencies: plain arrays, to be sent out.
    """

    def __init__(self, languages: list[str], word_counts: list[tuple[str, str, int]], gram_counts: list[tuple[str, str, int]]):
        self.languages = languages
        grams = _table(languages, gram_counts)
        self.units = _frequencies(_table(languages, word_counts), grams, len(languages))

    @classmethod
    def of(cls, languages: list[str], units: dict[int, tuple[np.ndarray, np.ndarray]]) -> "LanguageModel":
        model = cls.__new__(cls)
        model.languages, model.units = languages, units
        return model

    def word_scores(self, distinct: list[str]) -> np.ndarray:
        """Log probability of each word in each language.

        A word that the model lacks gets the mean of its longest n-grams that
        the model has, or 0 for every language.
        """
        out = np.zeros((len(distinct), len(self.languages)))
        row, known = self._find(0, distinct)
        out[known] = self.units[0][1][row[known]]
        left = np.flatnonzero(~known).tolist()
        for n in GRAM_SIZES:
            padded = [f"^{distinct[i]}$" for i in left]
            counts = np.array([max(0, len(p) - n + 1) for p in padded], dtype=np.int64)
            row, known = self._find(n, [p[k : k + n] for p, c in zip(padded, counts.tolist(), strict=True) for k in range(c)])
            word = np.repeat(np.arange(len(left)), counts)[known]
            found = np.bincount(word, minlength=len(left))
            for j in range(len(self.languages)):
                out[left, j] = np.bincount(word, weights=self.units[n][1][row[known], j], minlength=len(left)) / np.maximum(found, 1)
            left = [i for i, f in zip(left, found.tolist(), strict=True) if not f]
            if not left:
                break
        return out

    def _find(self, kind: int, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The row of each string, and whether there is one."""
        known, wanted = self.units[kind][0], hashes(strings)
        if not len(known):
            return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
        row = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
        return row, known[row] == wanted

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        offsets, index, distinct = words(texts)
        counts = np.diff(offsets)
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        means = sums_by_row(self.word_scores(distinct)[index], offsets) / np.maximum(counts, 1)[:, None]
        evidence = means * np.minimum(counts, EVIDENCE_WORDS)[:, None]
        share = np.exp(evidence - evidence.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        names = [self.languages[b] if n else UNDETERMINED for b, n in zip(best, counts, strict=True)]
        return names, np.where(counts > 0, share.max(axis=1), 0.0)


def _table(languages: list[str], counts: list[tuple[str, str, int]]) -> pa.Table:
    """``unit, counts``: the counts of each unit by language."""
    rows: dict[str, list[int]] = {}
    for language, unit, n in counts:
        rows.setdefault(unit, [0] * len(languages))[languages.index(language)] += n
    return pa.table({"unit": pa.array(list(rows), pa.string()), "counts": pa.array(list(rows.values()), pa.list_(pa.int64()))})


def _frequencies(words: pa.Table, grams: pa.Table, languages: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Hashes and log frequencies, by kind of unit."""
    sizes = pc.utf8_length(grams.column("unit"))
    kinds = {0: words} | {n: grams.filter(pc.equal(sizes, n)) for n in GRAM_SIZES}
    out = {}
    for kind, table in kinds.items():
        counts = np.asarray(table.column("counts").combine_chunks().flatten(), dtype=float).reshape(table.num_rows, languages)
        total = counts.sum(axis=0) + SMOOTHING * max(1, table.num_rows)
        parts = [hashes(c.to_pylist()) for c in table.column("unit").chunks]
        names = np.concatenate([np.zeros(0, dtype=np.uint64), *parts])
        order = np.argsort(names)
        out[kind] = names[order], np.log((counts + SMOOTHING) / total)[order]
    return out


def train_languages(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    sample_docs: int = SAMPLE_DOCS,
    least_count: int = LEAST_COUNT,
) -> LanguageModel:
    """A model from the rows whose text and language are not null.

    Fitted on about ``sample_docs`` rows of each language, picked by the hash
    of id and text (so that no id and no language can bring more), a word
    counting once for each text, an n-gram once for each word it is in and each
    text. Units that count less than ``least_count`` are left out, or none if a
    table would be empty. Without labelled rows it knows no language.
    """
    labelled = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("language")).where(
        "text is not null and language is not null"
    )
    sizes = {r["language"]: r["n"] for r in labelled.groupBy("language").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageModel([], [], [])
    share = F.from_json(F.lit(_json({k: min(1.0, sample_docs / n) for k, n in sizes.items()})), "map<string,double>")
    drawn = F.pmod(F.xxhash64(F.col("id").cast("string"), "text", F.lit("languages")), F.lit(1 << 30))
    sample = labelled.where(drawn < share[F.col("language")] * (1 << 30))
    listed = sample.select("language", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{M}]+"))).alias("unit")).where("unit != ''")
    counted = listed.groupBy("language", "unit").agg(F.count("*").alias("n"))
    padded = F.concat(F.lit("^"), "unit", F.lit("$"))
    grams = F.flatten(
        F.array(
            *(
                F.when(F.length(padded) >= n, F.transform(F.sequence(F.lit(1), F.length(padded) - (n - 1)), lambda i, n=n: F.substring(padded, i, F.lit(n)))).otherwise(
                    F.array().cast("array<string>")
                )
                for n in GRAM_SIZES
            )
        )
    )
    gram_counts = counted.select("language", "n", F.explode(grams).alias("unit"))
    languages = sorted(sizes)

    def table(counts: DataFrame) -> pa.Table:
        """One row for each unit, with the sums of all languages."""
        sums = [F.coalesce(F.sum(F.when(F.col("language") == language, F.col("n"))), F.lit(0)) for language in languages]
        rows = checkpointed(counts.groupBy("unit").agg(F.array(*sums).alias("counts"), F.sum("n").alias("n")))
        common = rows.where(F.col("n") >= least_count)
        return (rows if common.isEmpty() else common).select("unit", "counts").toArrow()

    return LanguageModel.of(languages, _frequencies(table(counted), table(gram_counts), len(languages)))


def _json(value) -> str:
    import json

    return json.dumps(value)


def identify_languages(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows with ``lang_pred`` and ``score`` (0 to 1) of each whole text.

    A null text, or one without a letter, is ``und`` with score 0, as is every
    text if the model knows no language. Equal scores go to the language first
    in the alphabet. Columns of these names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.units))

    @F.arrow_udf("lang_pred string, score double")
    @giving_back
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = LanguageModel.of(*sent.value)
        for batch in batches:
            names, scores = [], [np.zeros(0)]
            for part in byte_slices(batch):
                own, value = known.predict(filled(part))
                names += own
                scores.append(value)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores))], ["lang_pred", "score"])

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(*kept, predict(F.col(f"`{text}`")).alias("_predicted"))
    return rows.select(*kept, F.col("_predicted.lang_pred").alias("lang_pred"), F.col("_predicted.score").alias("score"))
