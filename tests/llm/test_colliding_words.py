"""Two words whose polynomial hashes modulo 2**64 agree, whatever the values of their letters, are two words."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cadenza.llm import bpe, minhash, store
from cadenza.session import new_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


def thue_morse(n):
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 2048])
def test_thue_morse(spark, n):
    texts = dict(enumerate(thue_morse(n))) | {2: " ".join(thue_morse(n))}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert got == {0: (1, 0), 1: (1, 1), 2: (1, 2)}
    library = Tokenizer.from_file(PATH)
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    for r in bpe.encode(docs, PATH).collect():
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids[r.doc_id])).encode()).hexdigest()
    path = new_path(spark, "store")
    store.write(docs, path, PATH)
    for r in store.read_digests(spark, path).collect():
        assert r.ids_crc32 == zlib.crc32(np.array([*ids[r.doc_id], 0], "<u4").tobytes())


def test_pieces_are_told_apart_in_one_slice_and_between_slices():
    words = thue_morse(1024)
    splitter, _ = bpe.tools(PATH)
    assert len(bpe.Pieces(splitter, [*words, words[0]]).places) == 2
    library = Tokenizer.from_file(PATH)
    for text in words:
        assert store.encode_texts(PATH, [text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
