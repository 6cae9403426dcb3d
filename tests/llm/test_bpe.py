import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from patronage.llm.bpe import Codec, encode_decode
from tests.llm.conftest import EDGE

BYTES = public_tokenizers.path("byte_bpe_50k.json")
LETTERS = list("abtheinr  \n\t1!'.<|>\x1c\x1f\x85\xa0漢🙂éß́") + ["the", "ing", "aaaa", "<|endoftext|>", "'re", "　"]


@pytest.fixture(scope="module")
def both():
    return Codec(open(BYTES).read()), Tokenizer.from_file(BYTES)


@settings(max_examples=500, deadline=None)
@given(text=st.lists(st.sampled_from(LETTERS), max_size=60).map("".join))
def test_same_as_the_library(both, text):
    codec, library = both
    ids = library.encode(text, add_special_tokens=False).ids
    own = codec.encode(text)
    assert np.frombuffer(own, "<u4").tolist() == ids
    assert codec.decode(own) == library.decode(ids, skip_special_tokens=False)


def test_every_token_is_its_own_encoding(both):
    codec, _ = both
    v = codec.vocabulary
    for token, i in list(v.id_of.items())[::50]:
        left, right = v.halves.get(i, (None, None))
        assert v.encode_piece(token) == [i]
        assert left is None or not v.compatible(left, right)  # the pair would have merged


def test_edge_documents(edge, empty, both):
    _, library = both
    want = sorted(((d or -1, len(x.ids), hashlib.sha256(np.array(x.ids, dtype="<u4").tobytes()).hexdigest(),
                    hashlib.sha256(library.decode(x.ids, skip_special_tokens=False).encode()).hexdigest())
                   for (d, _), x in zip(EDGE, library.encode_batch([t or "" for _, t in EDGE], add_special_tokens=False))))
    got = sorted((r[0] or -1, *tuple(r)[1:]) for r in encode_decode(edge, BYTES, digest=True).collect())
    assert got == want
    plain = {r["doc_id"]: r["decoded"] for r in encode_decode(edge, BYTES).collect()}
    assert plain[1] == "one two three four" and plain[2] == ""
    assert encode_decode(empty, BYTES).count() == 0


def test_other_kinds_of_file_are_refused():
    with pytest.raises(ValueError):
        Codec(open(public_tokenizers.path("word_bpe_49k.json")).read())
