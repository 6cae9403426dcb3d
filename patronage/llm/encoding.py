"""Token ids of whole texts through the tokenizers library."""

from __future__ import annotations

import json
import os
import re
import struct

import numpy as np

# White space on which Python and the library may disagree, or that is rare: such texts go to the library whole.
ODD = [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200E), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]
ODD_SPACE = re.compile("[" + "".join(map(chr, ODD)) + "]")
LATIN = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"  # the lower-case letters of Latin-1
PIECES = re.compile(f"[^\\s{LATIN}]*[{LATIN}]+|[^\\s{LATIN}]+").findall
RUN = re.compile(f"[{LATIN}]+").fullmatch
#: A splitting pattern under which a run of letters always ends a piece, whatever follows it.
RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _first_split(parsed: dict) -> dict:
    pre = parsed.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    return first if first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True else {}


def words_apart(spec: str) -> bool:
    """Whether a tokenizer handles every stretch between white space by itself.

    True when it drops white space while splitting, so no token can reach over a gap.
    """
    parsed = json.loads(spec)
    strips = any(t.get("lstrip") or t.get("rstrip") or any(c.isspace() for c in t["content"]) for t in parsed.get("added_tokens", []))
    return r"[^\s" in _first_split(parsed).get("pattern", {}).get("Regex", "") and not strips


def runs_apart(spec: str) -> bool:
    """Whether, besides, case does not matter and a run of letters is handled apart from what follows it."""
    parsed = json.loads(spec)
    steps = [n.get("type") for n in (parsed.get("normalizer") or {}).get("normalizers", [])]
    return words_apart(spec) and _first_split(parsed)["pattern"]["Regex"] == RUNS and steps == ["NFC", "Replace", "Lowercase"]


def byte_letters() -> dict[int, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + n for n, b in enumerate(other)}


BYTE_LETTERS = byte_letters()


class Encoder:
    """Whole texts to ids, little-endian unsigned 32-bit.

    Where the tokenizer allows it, a text is cut where its tokens cannot reach across, the library encodes each
    distinct piece once, and texts are put together from pieces. At most `keep` pieces are
    remembered; beyond that the memory starts afresh, which changes time but no result.
    """

    def __init__(self, spec: str, keep: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.by_word, self.by_run = words_apart(spec), runs_apart(spec)
        self.added = [t["content"].lower() for t in json.loads(spec).get("added_tokens", [])]
        self.keep = keep
        self.known: dict[str, bytes] = {}

    def _learn(self, pieces: list[str]) -> None:
        """Remember pieces. A run of letters goes to the library's merges directly, which spares it the splitting."""
        runs = [p for p in pieces if RUN(p)] if self.by_run else []
        merge = self.library.model.tokenize
        for p in runs:
            own = merge(p if p.isascii() else p.encode().decode("latin-1").translate(BYTE_LETTERS))
            self.known[p] = struct.pack(f"<{len(own)}I", *[t.id for t in own])
        rest = [p for p in pieces if not RUN(p)] if self.by_run else pieces
        for at in range(0, len(rest), 20_000):
            part = rest[at:at + 20_000]
            self.known.update(zip(part, self._library(part)))

    def _library(self, texts: list[str]) -> list[bytes]:
        done = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in done]

    def _cut(self, text: str) -> list[str] | None:
        """Pieces that are encoded alike on their own; None where that is not sure."""
        if not self.by_word or ODD_SPACE.search(text):
            return None
        if self.by_run:
            lower = text.lower()
            try:
                lower.encode("latin-1")
            except UnicodeEncodeError:
                return text.split()
            if not any(t in lower for t in self.added):
                return PIECES(lower)
        return text.split()

    def __call__(self, texts: list[str]) -> list[bytes]:
        cut = [self._cut(t) for t in texts]
        wanted: set[str] = set()
        for pieces in cut:
            if pieces:
                wanted.update(pieces)
        if len(self.known) + len(wanted) > self.keep and not wanted <= self.known.keys():
            self.known = {}
        self._learn(list(wanted - self.known.keys()))
        look = self.known.__getitem__
        return [self._library([t])[0] if pieces is None else b"".join(map(look, pieces)) for t, pieces in zip(texts, cut)]
