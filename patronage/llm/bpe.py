"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

The canonical encoding of a text is put together from canonical encodings of
its prefixes: for every prefix exactly one token can come last. A token that
ends at position i comes last if the prefix before it ends in a token it is
compatible with, that is, if merging the pair's bytes gives back that pair. So
one pass over the positions stores the last token of each prefix, and following
those back from the end gives the ids, without ever applying a merge. The
tokens that end at a position come from an automaton over the vocabulary whose
suffix links list them all.

Tasks work on whole texts. A Python worker remembers the pieces of the
pre-tokenizer that it has encoded, up to a bound; then that memory starts afresh,
which changes time but no result.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import per_batch, per_worker, shared, texts_of, vocabulary
from patronage.llm.encoding import BYTE_LETTERS

BATCH = 200
KEEP_PIECES = 600_000
KEEP_PAIRS = 1_000_000
LONGEST_KEPT = 64
FOREVER = 1 << 60


class Vocabulary:
    """Tokens, their merge trees and the automaton of a byte-level tokenizers file."""

    def __init__(self, spec: str):
        import ahocorasick

        parsed = json.loads(spec)
        model, pre = parsed["model"], parsed.get("pre_tokenizer") or {}
        if (model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or parsed.get("normalizer")
                or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("ignore_merges")):
            raise ValueError("a plain byte-level BPE file is needed")
        letters = {chr(letter): byte for byte, letter in BYTE_LETTERS.items()}
        self.added = {a["content"]: a["id"] for a in parsed.get("added_tokens", [])}
        if any(a.get("lstrip") or a.get("rstrip") or a.get("single_word") for a in parsed.get("added_tokens", [])):
            raise ValueError("added tokens that take in their surroundings are not known here")
        self.id_of = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in self.added}
        self.bytes_of = {i: b for b, i in self.id_of.items()} | {i: t.encode() for t, i in self.added.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        raw = {t: i for t, i in model["vocab"].items()}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            whole = raw[left + right]
            if whole in self.halves:
                raise ValueError("a token with two merges is not known here")
            self.rank[raw[left], raw[right]] = rank
            self.halves[whole] = (raw[left], raw[right])
        if any(len(b) > 1 and i not in self.halves for b, i in self.id_of.items()):
            raise ValueError("a token without a merge is not known here")
        self.automaton = ahocorasick.Automaton()
        for token, i in self.id_of.items():
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.right_edge: dict[int, list[tuple[int, int]]] = {}
        self.left_edge: dict[int, list[tuple[int, int]]] = {}
        self.fits: dict[tuple[int, int], bool] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that lie at one edge of `token` while it is being merged, each with the rank that ends it."""
        known = (self.left_edge, self.right_edge)[side]
        if token not in known:
            out, ends, at = [], FOREVER, token
            while True:
                out.append((at, ends))
                if at not in self.halves:
                    break
                ends = self.rank[self.halves[at]]
                at = self.halves[at][side]
            known[token] = out
        return known[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of `left` and `right` gives this pair again.

        It does unless some token at the right edge of `left` and some token at the left
        edge of `right` stand side by side and merge before either is used up.
        Merges go by rank and, for one rank, from left to right: at an equal
        rank the inner merge of `left` comes before the crossing one, and
        the crossing one before the inner merge of `right`.
        """
        rank = self.rank.get
        for a, a_ends in self._edge(left, 1):
            for b, b_ends in self._edge(right, 0):
                crossing = rank((a, b), FOREVER)
                if crossing < a_ends and crossing <= b_ends and crossing != FOREVER:
                    return self._note(left, right, False)
        return self._note(left, right, True)

    def _note(self, left: int, right: int, fit: bool) -> bool:
        if len(self.fits) >= KEEP_PAIRS:
            self.fits.clear()
        self.fits[left, right] = fit
        return fit

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece of the pre-tokenizer; linear in its length."""
        whole = self.id_of.get(piece)
        if whole is not None:
            return [whole]
        last, sizes = [-1] * (len(piece) + 1), [0] * (len(piece) + 1)
        fits = self.fits
        for end, (token, size) in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            if size < end:
                before = last[end - size]
                if before < 0:
                    continue
                fit = fits.get((before, token))
                if fit is None:
                    fit = self.compatible(before, token)
                if not fit:
                    continue
            last[end], sizes[end] = token, size
        ids, at = [], len(piece)
        while at:
            ids.append(last[at])
            at -= sizes[at]
        ids.reverse()
        return ids


# Splitting as byte-level tokenizers do. White space is Unicode's, which for the regex
# module also has the separators 1C to 1F; texts with one of those take the strict form.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
STRICT_SPACE = r"\p{White_Space}"


class Pieces(dict):
    """Piece -> its ids, encoded when first asked for; starts afresh when full."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        ids = self.vocabulary.encode_piece(piece.encode())
        ids = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= KEEP_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Whole texts to ids and back, as the tokenizers library does for the same file."""

    def __init__(self, spec: str):
        import regex

        self.vocabulary = Vocabulary(spec)
        self.split = regex.compile(SPLIT).findall
        strict = SPLIT.replace(r"[^\s\p{L}\p{N}]", rf"[^{STRICT_SPACE}\p{{L}}\p{{N}}]").replace(r"(?!\S)", rf"(?=$|{STRICT_SPACE})")
        self.strict = regex.compile(strict.replace(r"\s+", STRICT_SPACE + "+").replace("$", r"\Z")).findall
        self.separators = re.compile("[\x1c-\x1f]").search
        added = sorted(self.vocabulary.added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.known = Pieces(self.vocabulary)

    def _plain(self, text: str) -> bytes:
        pieces = (self.strict if self.separators(text) else self.split)(text)
        return b"".join(map(self.known.__getitem__, pieces))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit."""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        added = self.vocabulary.added
        return b"".join(added[p].to_bytes(4, "little") if p in added else self._plain(p) for p in self.special.split(text) if p)

    def decode(self, ids: bytes) -> str:
        table = self.vocabulary.bytes_of
        return b"".join([table[i] for i in memoryview(ids).cast("I")]).decode("utf-8", "replace")


SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"


def encode_decode(docs: DataFrame, tokenizer: str, digest: bool = False) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded text.

    With `digest` the ids and the decoded text are given as ids_sha256 and decoded_sha256
    instead. Texts are whole, of any length.

    Defined cases: null and empty texts have no ids and decode to the empty text; a
    null doc_id is kept; repeated rows are encoded each; an empty table gives no
    rows; other columns are not looked at.
    """
    sent = shared(docs.sparkSession, vocabulary(tokenizer))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else SCHEMA
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = per_worker(("codec", tokenizer), lambda: Codec(sent.value))
        for batch in per_batch(BATCH, batches):
            ids = [codec.encode(t) for t in texts_of(batch)]
            decoded = [codec.decode(i) for i in ids]
            counts = pa.array([len(i) // 4 for i in ids], pa.int64())
            if digest:
                columns = [pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                           pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded])]
            else:
                columns = [pa.array(ids, pa.binary()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, *columns], names=names)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, schema)
