import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from fleetlens.llm import bpe

from .helpers import DOCS, clashing, frame

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.load_ranks(PATH), P.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


TEXTS = [None, "", " ", "a", "Thereou onand\n\n the  éàü 漢字 🙂 don't 12345 ...", "x" * 3000, "ab" * 2000 + "\n" * 50,
         "same row", "same row", "<|endoftext|> is text", "the " * 20000]


def test_perfect_hash_is_minimal(encoder):
    seen = {encoder.table.index(k) for k in encoder.keys}
    assert seen == set(range(len(encoder.keys)))
    assert encoder.lookup(b"no such token at all") is None


def test_texts_against_the_library(spark, encoder, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id")]
    got = {r.doc_id: r for r in bpe.encode_documents(frame(spark, rows, "doc_id long, text string"), PATH, P.PATTERN,
                                                     keep_ids=True).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_query_against_the_library(spark, library):
    from fleetlens.llm.queries import QUERIES
    from fleetlens.llm.text import documents

    sf = "/root/testdata/sf0.001"
    want = {r.doc_id: library.encode_ordinary(r.text or "") for r in documents(spark, sf).collect()}
    for r in QUERIES["op9_byte_bpe"](spark, sf).collect():
        assert r.n_tokens == len(want[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(np.array(want[r.doc_id], "<u4").tobytes()).hexdigest()


def test_empty_table(spark):
    assert bpe.encode_documents(frame(spark, [], "doc_id long, text string"), PATH, P.PATTERN).count() == 0


def test_other_columns_do_not_matter(spark, library):
    got = bpe.encode_documents(clashing(spark, DOCS), PATH, P.PATTERN).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), len(library.encode_ordinary(t or ""))) for i, t in DOCS)
