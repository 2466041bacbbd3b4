"""Byte-pair ids of whole texts from a public vocabulary file, cached by word.

The pre-tokenizer never joins two runs of non-space characters across a single space, and
that space opens the second run; so a text falls at such spaces into parts whose ids do not
depend on each other. Words repeat, so most parts come from a cache. The added tokens of the
file (its special strings) have ids of their own wherever they stand in a text, as in the
library that the file is for; what stands between them is encoded by itself.
"""

from __future__ import annotations

import json
import re

import numpy as np
import tiktoken

#: Entries of the cache of one task; a full cache starts anew.
CACHE_PARTS = 200_000
#: Longer parts are not kept.
LONG_PART = 48

#: A space next to further white space, or at an end of the text, belongs to a longer run.
_TWO = re.compile(r"\s\s")  # quick, and without a hit there is no such run inside
_RUN = re.compile(r"\s | \s")


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable bytes for
    themselves, the others in order from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in printable}
    rest = [b for b in range(256) if b not in set(printable)]
    return letters | {chr(0x100 + i): b for i, b in enumerate(rest)}


def load_encoding(path: str) -> tiktoken.Encoding:
    """The vocabulary of a byte-level BPE file; its merges are ranked by id."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    letters = _byte_letters()
    special = {x["content"] for x in content.get("added_tokens", ())}
    ranks = {
        bytes(letters[c] for c in token): number
        for token, number in content["model"]["vocab"].items()
        if token not in special
    }
    from public_tokenizers import PATTERN

    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def added_tokens(path: str) -> dict[str, int]:
    """The file's added tokens and their ids."""
    with open(path, encoding="utf-8") as file:
        return {x["content"]: x["id"] for x in json.load(file).get("added_tokens", ())}


class PartIds(dict):
    """Ids of a part as little-endian 16-bit words. New parts of a slice of texts are encoded
    in one go, and told apart by the bytes that their ids stand for."""

    def __init__(self, encoding: tiktoken.Encoding, added: dict[str, int] | None = None):
        super().__init__()
        self.added = {t: np.array([i], "<u2").tobytes() for t, i in (added or {}).items()}
        # The longest of several that begin at one place.
        names = sorted(self.added, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, names)) + ")").split if names else None
        self.encode = encoding.encode_ordinary
        if encoding.max_token_value >= 1 << 16:
            raise ValueError("the vocabulary does not fit 16-bit ids")
        size = encoding.max_token_value + 1
        self.widths = np.fromiter((len(encoding.decode_single_token_bytes(i)) for i in range(size)), np.int64, size)

    def __missing__(self, part: str) -> bytes:
        return np.array(self.encode(part), "<u2").tobytes()

    def together(self, parts: list[str]) -> list[bytes]:
        """The ids of parts that open with a space and do not end in one, encoded in one go."""
        if not parts:
            return []
        ids = np.array(self.encode("".join(parts)), "<u2")
        ends = np.cumsum(np.fromiter((len(p.encode()) for p in parts), np.int64, len(parts)))
        cuts = (2 * np.searchsorted(np.cumsum(self.widths[ids]), ends) + 2).tolist()
        data = ids.tobytes()
        return [data[start:cut] for start, cut in zip([0, *cuts], cuts)]

    def learn(self, parts: set[str]) -> None:
        """Add short parts that open with a space: such a space always opens a new run."""
        fresh = [p for p in parts - self.keys() if p[:1] == " " and len(p) < LONG_PART]
        self.update(zip(fresh, self.together(fresh)))

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts, two bytes each."""
        if len(self) >= CACHE_PARTS:
            self.clear()
        if self.split and any(a in t for a in self.added for t in texts):
            return [b"".join(self._pieces(t)) for t in texts]
        parts = [self._parts(t) for t in texts]
        self.learn(set().union(*parts))
        return [b"".join([self[p] for p in ps]) for ps in parts]

    def _pieces(self, text: str) -> list[bytes]:
        """Added tokens stand at the odd places of a split text."""
        cut = self.split(text)
        return [x for i, s in enumerate(cut) for x in ([self.added[s]] if i % 2 else [self[p] for p in self._parts(s)])]

    @staticmethod
    def _parts(text: str) -> list[str]:
        if not text:
            return []
        if "\0" in text or " " in (text[0], text[-1]) or (_TWO.search(text) and _RUN.search(text)):
            return [text]
        return text.replace(" ", "\0 ").split("\0")
