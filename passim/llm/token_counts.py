"""Token counts: batches of texts encoded in Arrow functions that return lengths only."""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passim.llm.arrow import byte_slices, encoded, filled

MAX_TOKENS = 4096
# A text with no plain spaces to split at is cut near so many characters.
CUT_CHARS = 1 << 16
MARK = "\u2581"


def _splits_at_spaces(model) -> bool:
    """Whether no piece of the vocabulary holds a space mark after another character."""
    return not any(MARK in model.id_to_piece(i).lstrip(MARK) for i in range(model.get_piece_size()))


def safe_cuts(text: str, every: int = CUT_CHARS) -> list[str]:
    """Parts that give the text's tokens when encoded one by one.

    A cut replaces the first space of a run, since the encoder puts one before
    each part. A text without such a space stays whole.
    """
    parts, start = [], 0
    space = re.compile(f"(?<=[^ {MARK}]) (?=.)", re.S)
    while len(text) - start > every and (found := space.search(text, start + every)):
        parts.append(text[start : found.start()])
        start = found.end()
    return [*parts, text[start:]]


def _lengths(model, strings: list[str]) -> np.ndarray:
    return np.fromiter((len(x) for x in model.encode(strings, num_threads=1)), dtype=np.int64, count=len(strings))


def token_lengths(texts: pa.Array, model, split: bool) -> np.ndarray:
    """Tokens of each text. Texts that hold single spaces only are cut at all of
    them, and each distinct part of the batch is encoded once."""
    if not split:
        return _lengths(model, texts.to_pylist())
    plain = np.asarray(pc.invert(pc.match_substring_regex(texts, f"  |^ | $|{MARK}")))
    out = np.zeros(len(texts), dtype=np.int64)
    if plain.any():
        offsets, index, distinct = encoded(pc.split_pattern(texts.filter(pa.array(plain)), " "))
        running = np.concatenate([[0], np.cumsum(_lengths(model, distinct)[index])])
        out[plain] = running[offsets[1:]] - running[offsets[:-1]]
    for i in np.flatnonzero(~plain):
        out[i] = sum(int(n) for n in _lengths(model, safe_cuts(texts[int(i)].as_py())))
    return out


def count_tokens(docs: DataFrame, model_file: str, text: str = "text", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """The rows with ``n_bytes``, ``n_tokens`` and ``over_limit`` of each whole text.

    A null text counts as empty (0, 0, false). Columns of these names are
    replaced; all others stay, repeated rows too. ``model_file`` must be at the
    same path on every executor.
    """

    @F.arrow_udf("n_bytes long, n_tokens long")
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        split = _splits_at_spaces(model)
        for batch in batches:
            texts = filled(batch)
            counts = [token_lengths(part, model, split) for part in byte_slices(texts)]
            tokens = np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64)
            yield pa.StructArray.from_arrays([pc.binary_length(texts).cast(pa.int64()), pa.array(tokens)], ["n_bytes", "n_tokens"])

    kept = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), measure(F.col(f"`{text}`")).alias("_measured"))
    return rows.select(
        *(F.col(f"`{c}`") for c in kept),
        F.col("_measured.n_bytes").alias("n_bytes"),
        F.col("_measured.n_tokens").alias("n_tokens"),
        (F.col("_measured.n_tokens") > max_tokens).alias("over_limit"),
    )
