import bisect
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from patronage.llm.encoding import Encoder
from patronage.llm.packing import Capacities, best_fit, pack
from tests.llm.conftest import EDGE

WORDS = public_tokenizers.path("word_bpe_49k.json")


def one_by_one(lengths, seq_len):
    """Best-fit decreasing, an item at a time: remaining capacities of all bins."""
    free, full = [], 0
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(free, n)
        left = (free.pop(i) if i < len(free) else seq_len) - n
        if left:
            bisect.insort(free, left)
        else:
            full += 1
    return free, full


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=20), st.sampled_from([40, 41, 64]))
def test_runs_equal_one_by_one_packing(counts, seq_len):
    runs = best_fit(counts, seq_len)
    items = {}
    for length, first, n, first_bin, each, offset in runs:
        for i in range(n):
            place = (first_bin + i // each, offset + i % each * length)
            assert items.setdefault((length, first + i), place) == place
    assert sorted(items) == [(k, i) for k in sorted(counts) for i in range(counts[k])]
    bins = {}
    for (length, _), (which, offset) in items.items():
        bins.setdefault(which, []).append((offset, length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= seq_len
    free, full = one_by_one([k for k, n in counts.items() for _ in range(n)], seq_len)
    left = sorted(seq_len - sum(n for _, n in held) for held in bins.values())
    assert left == [0] * full + free


def test_tree_finds_the_tightest():
    tree = Capacities(20)
    for c in (3, 7, 20):
        tree.set(c, True)
    assert [tree.tightest(n) for n in (1, 3, 4, 7, 8, 20)] == [3, 3, 7, 7, 20, 20]
    tree.set(20, False)
    assert tree.tightest(8) is None


def library(texts):
    return [x.ids for x in Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("aBé'sre \n\t1!.<|>\x1c\x85\xa0漢Σİßµ´́") + ["<|endoftext|>", "<|STARTOFTEXT|>", "don't"]), max_size=40).map("".join))
def test_pieces_encode_like_the_library(text):
    global _ENCODER
    _ENCODER = globals().get("_ENCODER") or Encoder(open(WORDS).read())
    assert np.frombuffer(_ENCODER([text])[0], "<u4").tolist() == library([text])[0]


def test_encoder_that_forgets():
    encode = Encoder(open(WORDS).read(), keep=3)
    texts = ["a b c d e", "f g a b", "h i j k l m", "a b c"]
    assert [np.frombuffer(encode([t])[0], "<u4").tolist() for t in texts] == library(texts)


def test_edge_documents(edge):
    rows = [tuple(r)[:7] for r in pack(edge, WORDS, seq_len=64).collect()]
    want = []
    for (doc, _), ids in zip(EDGE, library([t or "" for _, t in EDGE])):
        ids = np.array([*ids, 0], dtype="<u4")
        want += [(doc, n, at, len(ids[at:at + 64]), zlib.crc32(ids[at:at + 64].tobytes())) for n, at in enumerate(range(0, len(ids), 64))]
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((r[:5] for r in rows), key=order) == sorted(want, key=order)
    bins = {}
    for r in rows:
        bins.setdefault(r[5], []).append((r[6], r[3]))
    for held in bins.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 64
    free, full = one_by_one([w[3] for w in want], 64)
    assert len(bins) == len(free) + full


def test_ids_on_request_and_empty_table(docs_frame, empty):
    row = pack(docs_frame([(1, "hello world")]), WORDS, with_ids=True).first()
    assert np.frombuffer(row["ids"], "<u4").tolist() == [*library(["hello world"])[0], 0]
    assert pack(empty, WORDS).count() == 0
