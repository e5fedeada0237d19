import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from motes.llm import pair_index as pi
from motes.llm.catalog import QUERIES
from tests.llm.helpers import awkward, nothing

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
INDEX = pi.PairIndex(PATH)


def library_ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def own_ids(text):
    return [i for w in INDEX.encode_words(text.encode().split()) for i in np.frombuffer(w, "<u4").tolist()]


@pytest.mark.parametrize(
    "text",
    [
        "Σας ΟΔΥΣΣΕΥΣ", "éa É İx é, É", "a<|endoftext|>b <|startoftext|><|endoftext|>", "<|endoftext|", "don't I'll x's 12ab½",
        "\x1ca\x1cb c\x85d e f", "日本語 ǅ ß", "", " \n", "De,!! a$$$ é.", "aaaaaaaaaaaaaaaaaaaaaaa" * 40, "hahahahahahahaha", "́ ​", "ＡＢＣ 🎉🎉🎉",
    ],
)
def test_ids_are_the_librarys(text):
    ids = library_ids(text)
    assert own_ids(text) == ids
    assert INDEX.decode(np.array(ids, "<u4").tobytes()) == LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abehinrstAEΣσİ'’.,!0 \n\t<|>́"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(text):
    assert own_ids(text) == library_ids(text)


def test_a_block_shares_one_index():
    words = [w for w in "banana bananas anna nana nan an a bandana banan".split() for _ in range(3)]
    assert [i.tolist() for i in INDEX.encode(words)] == [library_ids(w) for w in words]


def test_rows(spark):
    df = awkward(spark).withColumn("n", F.monotonically_increasing_id())
    texts = {r.n: r.text or "" for r in df.collect()}
    tokens = pi.encode(df.repartition(3), PATH, block=1000, remembered=100)
    found = pi.decode(tokens.select("row.n", "ids", "n_tokens"), PATH).collect()
    assert sorted(r.row.n for r in found) == sorted(texts)
    for r in found:
        ids = library_ids(texts[r.row.n])
        assert r.row.ids == np.array(ids, "<u4").tobytes() and r.row.n_tokens == len(ids)
        assert r.decoded == LIBRARY.decode(ids, skip_special_tokens=False)
    assert pi.encode(nothing(spark), PATH).count() == 0
    odd = spark.createDataFrame([(bytearray(np.array([0, 10**6], "<u4").tobytes()),), (None,)], "ids binary")
    assert [r.decoded for r in pi.decode(odd, PATH).collect()] == ["!", ""]


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op12_bpe_pair_index"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library_ids(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
