"""Words remembered by the encoders."""

import random
import sys

import pyarrow as pa
import pytest

from rolecast.llm import queries, tokens

BPE = queries.tokenizer_file(queries.BYTE_BPE)
ODD = [None, "", " ", "\n", "a\n", "\na", "a\n\nb", "x\n y\nz", "x  y", "é\x00 \x00", "日本語 日 本\n語", "<|endoftext|> a", "a <|endoftext|>b", "don't\nI'll 12's", "w" * 300, "tab\tx y"]


def words(n, seed):
    draw = random.Random(seed)
    return ["".join(draw.choices("etaoinshrdlé", k=draw.randint(8, 14))) for _ in range(n)]


@pytest.mark.parametrize("cached", [1, 40, 500_000])
def test_ids_do_not_depend_on_what_is_remembered(monkeypatch, cached):
    monkeypatch.setattr(tokens, "CACHED_WORDS", cached)
    tokens.text_encoder.cache_clear()
    encoder = tokens.text_encoder(BPE)
    tokens.text_encoder.cache_clear()
    plain, draw = words(90, 1) + [",", "the", "a.b", "12", "\nthe"], random.Random(2)
    for _ in range(6):
        texts = [" ".join(draw.choices(plain, k=draw.randint(0, 30))) for _ in range(20)] + ODD
        draw.shuffle(texts)
        ids, lengths = encoder.column(pa.array(texts, pa.string()))
        expected = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert lengths.tolist() == [len(x) for x in expected] and ids.tolist() == sum(expected, [])


def test_bytes_outside_a_vocabulary_are_dropped_as_by_the_library():
    from tokenizers import Tokenizer, models, pre_tokenizers

    tokenizer = Tokenizer(models.BPE(vocab={"Ġ": 0, "a": 1, "b": 2, "ab": 3, "Ċ": 4}, merges=[("a", "b")]))
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    ids, lengths = tokens.TextEncoder(tokenizer, tokens.BYTE_LEVEL_PATTERN).column(pa.array(["abc ab\ncab b", "ab a"]))
    expected = [tokenizer.encode(t).ids for t in ("abc ab\ncab b", "ab a")]
    assert ids.tolist() == sum(expected, []) and lengths.tolist() == [len(x) for x in expected]


def test_remembered_words_are_not_python_objects():
    encoder = tokens.TextEncoder(tokens.text_encoder(BPE).tokenizer, tokens.BYTE_LEVEL_PATTERN)
    text = pa.array([" ".join(words(30_000, 3))])
    before = sys.getallocatedblocks()
    encoder.column(text)
    assert sys.getallocatedblocks() - before < 15_000
