"""Token ids of whole texts with a byte-level BPE file, as bytes of little-endian unsigned 32-bit ids.

Words repeat, so a worker keeps the ids of words it has met (a bounded memo; results never depend on
it). A space before a word always begins a new piece of the pre-tokenizer unless spaces follow each
other, so texts are cut at spaces and encoded word by word; texts with double spaces are encoded
whole, and texts that hold a special token's string go to the tokenizer itself.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import chain

import numpy as np

#: Fixed value: the pre-tokenizer pattern of this family of vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO_WORDS = 400_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_letter() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder(dict):
    """Maps a word to its ids; unknown words are encoded on first sight."""

    def __init__(self, path: str):
        super().__init__()
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]
        letter = _byte_of_letter()
        ranks = {bytes(letter[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in self.special}
        self._bpe = tiktoken.Encoding("narratives", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._whole = None

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self._bpe.encode_ordinary(word), "<u4").tobytes()
        if len(self) < MEMO_WORDS:
            self[word] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            if self._whole is None:
                from tokenizers import Tokenizer

                self._whole = Tokenizer.from_file(self.path)
            return np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.plain_ids(text)

    def plain_ids(self, text: str) -> bytes:
        """Ids of a text in which strings of special tokens are ordinary text."""
        if "  " in text:
            return np.array(self._bpe.encode_ordinary(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        get = self.__getitem__
        return b"".join(chain((get(first),) if first else (), map(get, [" " + w for w in rest])))

    def entries(self) -> list[bytes]:
        """The bytes of each id; none for special tokens."""
        ranks = self._bpe._mergeable_ranks
        out = [b""] * (max(ranks.values(), default=-1) + 1)
        for entry, i in ranks.items():
            out[i] = entry
        return out

    def count(self, text: str | None) -> int:
        return len(self.ids(text)) // 4


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One per worker process."""
    return Encoder(path)
