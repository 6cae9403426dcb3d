import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from patronage.llm.tokens import SequenceFile, _open, read_documents, write_sequences
from tests.llm.conftest import EDGE

WORDS = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    return np.array([*Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")


@pytest.mark.parametrize("partitions", [1, 3])
def test_files_read_back_whole(edge, partitions):
    manifest = write_sequences(edge, WORDS, seq_len=16, per_file=4, partitions=partitions)
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in read_documents(manifest).collect()))
    place = 0
    order = sorted(EDGE, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [g[1] for g in got] == [d for d, _ in order]
    for (start, _, n, crc), (_, text) in zip(got, order):
        ids = ids_of(text)
        assert (start, n, crc) == (place, len(ids), zlib.crc32(ids.tobytes()))
        place += n


def test_random_access_and_masks(docs_frame):
    texts = ["alpha beta gamma delta " * 20, "one", "two three"]
    manifest = write_sequences(docs_frame(list(enumerate(texts))), WORDS, seq_len=8, per_file=3, partitions=1).collect()
    assert len(manifest) == 1
    filesystem, base = _open(manifest[0]["folder"])
    file = SequenceFile(filesystem, f"{base}/{manifest[0]['file']}")
    flat = np.concatenate([ids_of(t) for t in texts])
    n = manifest[0]["n_sequences"]
    assert n == -(-len(flat) // 8)
    for i in (n - 1, 0, 5):
        ids, mask = file[i]
        real = flat[8 * i:8 * i + 8]
        assert ids[:len(real)].tolist() == real.tolist() and len(ids) == 8
        assert not ids.flags.owndata  # a view of the file
        assert mask.to_pylist() == [True] * len(real) + [False] * (8 - len(real))


def test_empty_table(empty):
    assert read_documents(write_sequences(empty, WORDS)).count() == 0
