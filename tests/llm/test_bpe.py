import hashlib
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspan.llm import bpe

LETTERS = "aabcdeehiinorst  \n\t'’.,!0123<|>éüßñΣςİſ中文́😀\x85\xa0　\x1c\x1d_-²ⅧAZ​"
SPECIAL = ["<|endoftext|>", "a<|endoftext|> b <|startoftext|>x", "", " ", "  a  b ", "it's WE'LL", "x " * 40 + "\n", " \n x"]


@pytest.fixture(scope="module")
def libraries():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(bpe.vocabulary_path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


def random_texts(n):
    rnd = random.Random(1)
    return ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_encoder_equals_library_and_decodes(libraries):
    lib, mine = libraries["byte_bpe_50k.json"], bpe.byte_bpe("byte_bpe_50k.json")
    for text in random_texts(3000) + SPECIAL + ["a" * 3000, "ab" * 2000, "der" * 500]:
        want = lib.encode(text, add_special_tokens=False).ids
        packed = mine.encode(text)
        assert mine.decimals(packed) == ",".join(map(str, want)), text
        assert mine.decode(packed).decode() == lib.decode(want, skip_special_tokens=False)


def test_counter_equals_library(libraries):
    lib, mine = libraries["word_bpe_49k.json"], bpe.word_counter("word_bpe_49k.json")
    for text in random_texts(3000) + SPECIAL + ["a" * 3000, "ab" * 2000]:
        assert mine.count(text) == len(lib.encode(text, add_special_tokens=False).ids), text


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text_survives_the_round_trip(text):
    mine = bpe.byte_bpe("byte_bpe_50k.json")
    clean = text.encode("utf-8", "ignore").decode()
    assert mine.decode(mine.encode(clean)).decode() == clean


def test_frames_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None, "k"), (2, "", None), (3, "hello world", "k"), (3, "hello world", "k"), (None, "x" * 200_000, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = bpe.encode_texts(docs).collect()
    assert len(out) == 5 and [r.n_tokens for r in out if r.doc_id in (1, 2)] == [0, 0]
    assert all(r.decoded == (r.text or "") and len(r.ids) == r.n_tokens for r in out)
    counted = bpe.count_tokens(docs).collect()
    assert sorted((r.doc_id or 0, r.n_bytes) for r in counted) == [(0, 200_000), (1, 0), (2, 0), (3, 11), (3, 11)]
    assert bpe.encode_texts(docs.where("false")).count() == 0 and bpe.count_tokens(docs.where("false")).count() == 0


def test_long_pieces_take_linear_time():
    mine = bpe.byte_bpe("byte_bpe_50k.json")
    rnd, took = random.Random(3), []
    for n in (200_000, 800_000):
        piece = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=n)).encode()
        began = time.process_time()
        ids = mine.encode_piece(piece)
        took.append(time.process_time() - began)
        assert mine.decode(bpe.array("I", ids).tobytes()) == piece
    assert took[1] < 10 * took[0]  # four times the length; a quadratic scan takes sixteen times


@pytest.mark.parametrize("name", ["op6_bpe_roundtrip", "op8_token_counts"])
def test_queries_equal_the_libraries(spark, tmp_path, libraries, name):
    texts = [None, "", *SPECIAL, *random_texts(300), "w " * 5000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in getattr(bpe, name)(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, text in enumerate(texts):
        lib = libraries["byte_bpe_50k.json" if name.startswith("op6") else "word_bpe_49k.json"]
        ids, r = lib.encode(text or "", add_special_tokens=False).ids, got[i]
        assert r.n_tokens == len(ids)
        if name.startswith("op6"):
            assert r.ids_sha256 == sha(",".join(map(str, ids))) and r.decoded_sha256 == sha(lib.decode(ids, skip_special_tokens=False))
        else:
            assert r.n_bytes == len((text or "").encode()) and r.over_limit == (len(ids) > 2048)
