"""What the packing spends on a text."""

import random

import pyarrow as pa

from passim.llm import packing
from passim.llm.arrow import filled
from passim.llm.queries import tokenizer

LATIN = ["the ", "a", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x1c", "\x00", "Über ", "naïve", "'s ", "'LL", "don't", "12 ", "½", "!!", "… ", "\xad", "“x”", "ẞ"]
OTHER = ["приве́т ", "мир", "漢字", "🙂 ", "\xa0", " ", "　 ", "\x85", "ﷺ", "﻿", "<|endoftext|>"]


def _texts(words, n=400):
    draw = random.Random(5)
    return ["", *("".join(draw.choice(words) for _ in range(draw.randint(1, 30))) for _ in range(n))]


def _same(encoder, texts):
    ids, bounds = encoder.encode(filled(pa.array([None, *texts], pa.string())))
    assert bounds[:2].tolist() == [0, 0] and len(bounds) == len(texts) + 2
    for text, start, stop in zip(texts, bounds[1:-1], bounds[2:], strict=True):
        assert ids[start:stop].tolist() == encoder.exact.encode(text, add_special_tokens=False).ids, text


def test_latin_texts_are_not_taken_apart_into_remembered_words():
    encoder = packing.Encoder(tokenizer("byte_bpe_50k.json"))
    texts = _texts([w for w in LATIN if w != "ẞ"])
    ids, bounds = encoder.encode(filled(pa.array(texts)))
    # Neither their words nor the slower library take any memory.
    assert not encoder.young and not encoder.old and "exact" not in vars(encoder)
    assert len(ids) == bounds[-1] > len(texts)
    _same(encoder, texts)


def test_ids_are_those_of_the_file_whatever_the_script():
    encoder = packing.Encoder(tokenizer("byte_bpe_50k.json"))
    _same(encoder, _texts(LATIN))
    _same(encoder, _texts(LATIN + OTHER))
    _same(encoder, [" " * 3000 + "a", "a" + "\n" * 3000, "a \n b", "\n\na\n\n\nb \n"])
    assert encoder.young


def test_no_texts_have_no_ids():
    ids, bounds = packing.Encoder(tokenizer("byte_bpe_50k.json")).encode(filled(pa.array([], pa.string())))
    assert len(ids) == 0 and bounds.tolist() == [0]
