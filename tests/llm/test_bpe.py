import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe
from tessera.llm.queries import TOKENIZER

TEXTS = [
    None,
    "",
    " ",
    "a",
    "Hello, world's  don't\t\n  x ",
    "über çédille 日本語 \U0001f600 é",
    "\u0085   　\x1c\x1d x\x1f",
    "12 345½ Ⅷ ٣",
    "<|endoftext|>a<|endoftext|><|endoftext|> b <|endoftext",
    "x" * 5000,
    "ab" * 3000 + " " * 3000 + "\n" * 50,
]


@pytest.fixture(scope="module")
def codec():
    return bpe.ByteBPE(open(TOKENIZER, encoding="utf-8").read(), cache_size=50)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


@pytest.mark.parametrize("text", TEXTS)
def test_same_ids_as_the_library(codec, library, text):
    want = library.encode(text or "", add_special_tokens=False).ids
    assert ids(codec.encode(text)) == want
    assert codec.decode(codec.encode(text)) == library.decode(want, skip_special_tokens=False)


def test_random_characters_match_the_library(codec, library):
    rng = random.Random(1)
    blocks = [(0, 0x250), (0x370, 0x590), (0x2000, 0x2100), (0x3000, 0x3100), (0x1F600, 0x1F640)]
    for _ in range(400):
        text = "".join(chr(rng.randrange(*rng.choice(blocks))) for _ in range(rng.randrange(60)))
        want = library.encode(text, add_special_tokens=False).ids
        assert ids(codec.encode(text)) == want, repr(text)


def test_foreign_ids_decode_like_the_library(codec, library):
    rng = random.Random(2)
    for _ in range(50):
        some = [rng.randrange(50257) for _ in range(20)]
        packed = np.array(some, "<u4").tobytes()
        assert codec.decode(packed) == library.decode(some, skip_special_tokens=False)


def test_encode_and_decode_tables(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, "again", "x"), (None, "no id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    back = bpe.decode(bpe.encode(docs, TOKENIZER, slice_rows=3), TOKENIZER).collect()
    assert sorted((str(r.doc_id), r.text or "", r.decoded) for r in back) == sorted(
        (str(i), t or "", t or "") for i, t, _ in rows
    )
    for r in back:
        assert ids(r.ids) == library.encode(r.text or "", add_special_tokens=False).ids


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(docs, TOKENIZER), TOKENIZER).count() == 0
