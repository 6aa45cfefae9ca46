"""Byte-level BPE against tiktoken and against merging by its definition."""

import hashlib
import random
import sys
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rolecast.llm import bytepairs, queries

SF = "/root/testdata/sf0.001"
RANKS, PATTERN = queries.tokenizer_file(queries.BYTE_RANKS), public_tokenizers.PATTERN
ODD = [
    None, "", " ", "\n", "\n\n", "a", "a  b", " a", "a ", "a\n\nb", "a \n b", "a\n", "\na", "tab\tx", "x\x00y \x00", "<|endoftext|> <s>", "é ﬁ 日本語 🙂 ́x",
    "don't I'll 12's\r\nX'S", "word " * 4000, "ab" * 3000, "  lead", "x ", "ΑΒΓ абв ԱԲ", "".join(map(chr, range(1, 700))), "-" * 999 + " " * 99,
]


@lru_cache(maxsize=1)
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bytepairs.read_ranks(RANKS), special_tokens={})


def ids_of(text):
    import pyarrow as pa

    return bytepairs.byte_pairs(RANKS, PATTERN).encoder.column(pa.array([text], pa.string()))[0].tolist()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "a", "Zb", "'s", "é", "3", ".,", "　", "日本", "🙂", "\x00", "\x85", "the", "ing", "²", "ª", "\x1c"]), max_size=16))
def test_ids_are_those_of_the_library(parts):
    assert ids_of("".join(parts)) == library().encode_ordinary("".join(parts))


def test_all_kinds_of_signs_cut_alike():
    draw = random.Random(3)
    signs = [chr(c) for c in draw.sample(range(0x250, sys.maxunicode + 1), 6000) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0x250)]
    for c in signs:
        text = f"a {c}a x{c} 1{c}1 {c}{c} é{c}'s !{c}!"
        assert ids_of(text) == library().encode_ordinary(text), hex(ord(c))


def test_words_merge_by_definition():
    ranks, draw = bytepairs.read_ranks(RANKS), random.Random(5)
    for _ in range(300):
        word = "".join(draw.choices("etaoinshrd", k=draw.randint(1, 14)))
        assert ids_of(word) == [ranks[p] for p in bytepairs.merged(word.encode(), ranks)]


def test_a_table_that_is_not_made_by_merging_is_refused(tmp_path):
    import base64

    lines = [f"{base64.b64encode(bytes([b])).decode()} {b}" for b in range(256)]
    for extra, complaint in ((["YWJj 256"], "not a merge"), ([], None)):
        path = tmp_path / f"ranks-{len(extra)}"
        path.write_text("\n".join([*lines, *extra]))
        if complaint:
            with pytest.raises(ValueError, match=complaint):
                bytepairs.BytePairs(str(path), PATTERN)
        else:
            assert bytepairs.BytePairs(str(path), PATTERN).encoder.column(__import__("pyarrow").array(["ab c"]))[0].tolist() == list(b"ab c")
    path.write_text(lines[0])
    with pytest.raises(ValueError, match="single byte"):
        bytepairs.BytePairs(str(path), PATTERN)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "x", 1, "s") for k, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[6], rows[6], (None, "no key", "x", 1, "s")], "doc_id long, text string, ids string, starts int, decoded string")


def test_odd_rows_encode_decode_and_place(spark, odd):
    texts = sorted((str(r.doc_id), r.text or "") for r in odd.collect())
    encoded = bytepairs.encode_texts(odd, RANKS, PATTERN, offsets=True)
    rows = sorted(encoded.collect(), key=lambda r: str(r.doc_id))
    assert encoded.columns == ["doc_id", "ids", "starts", "ends"] and len(rows) == len(texts)
    table = {rank: token for token, rank in bytepairs.read_ranks(RANKS).items()}
    for (key, text), got in zip(texts, rows):
        ids = np.frombuffer(got.ids, "<u4").tolist()
        assert key == str(got.doc_id) and ids == library().encode_ordinary(text)
        of_byte = [k for k, c in enumerate(text) for _ in c.encode()]
        at = 0
        for i, start, end in zip(ids, got.starts, got.ends, strict=True):
            assert (start, end) == (of_byte[at], of_byte[at + len(table[i]) - 1] + 1)
            at += len(table[i])
    back = {str(r.doc_id): bytes(r.decoded) for r in bytepairs.decode_ids(encoded, RANKS, PATTERN).collect()}
    assert back == {k: t.encode() for k, t in texts}
    both = bytepairs.encode_decode(odd, RANKS, PATTERN)
    assert both.columns == ["doc_id", "ids", "decoded"] and all(bytes(r.decoded) == back[str(r.doc_id)] for r in both.collect())
    for made in (encoded, both, bytepairs.decode_ids(encoded, RANKS, PATTERN)):
        assert made.where("false").count() == 0
    assert bytepairs.encode_texts(odd.where("false"), RANKS, PATTERN).count() == 0


def test_split_characters_and_unknown_ids(spark):
    smile = library().encode_ordinary("🙂")
    assert len(smile) > 1
    rows = [(1, np.array(smile[:1], "<u4").tobytes()), (2, np.array(smile, "<u4").tobytes()), (3, None)]
    made = bytepairs.decode_ids(spark.createDataFrame(rows, "doc_id long, ids binary"), RANKS, PATTERN)
    found = {r.doc_id: (bytes(r.decoded), r.t) for r in made.selectExpr("*", "make_valid_utf8(cast(decoded as string)) t").collect()}
    assert found[1][0] == "🙂".encode()[: len(found[1][0])] and "�" in found[1][1]
    assert found[2] == ("🙂".encode(), "🙂") and found[3] == (b"", "")
    with pytest.raises(ValueError, match="not in the table"):
        bytepairs.byte_pairs(RANKS, PATTERN).decode(np.array([50256], np.uint32))


def test_query(spark):
    found = {r.doc_id: r for r in queries.QUERIES["op13_byte_bpe"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(found) == len(docs)
    for d in docs:
        ids, got = np.array(library().encode_ordinary(d.text or ""), "<u4"), found[d.doc_id]
        assert (got.n_tokens, got.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert got.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
