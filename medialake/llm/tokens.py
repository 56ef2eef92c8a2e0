"""Token ids of whole texts by a byte-level tokenizer, and a bounded store of what has been encoded."""

from __future__ import annotations

import json

import numpy as np

KNOWN = 200_000

# Byte-level vocabularies write a byte as itself if it is printable Latin-1, else as the next sign from U+0100 on.
_SHOWN = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b > 173]
BYTE_OF = {chr(b): b for b in _SHOWN} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class Store:
    """Values by key in two generations: when the young one holds half of ``most`` entries, the old one is dropped."""

    def __init__(self, most: int = KNOWN):
        self.most, self.young, self.old = most, {}, {}

    def missing(self, keys: set) -> list:
        """The keys that neither generation has; those of the old one become young."""
        if len(self.young) + len(keys) > self.most // 2:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        absent = keys.difference(young)
        again = absent.intersection(old)
        young.update(zip(again, map(old.__getitem__, again)))
        return list(absent.difference(again))


class ByteIds:
    """Ids of whole texts as little-endian unsigned 32-bit numbers, by the byte-level vocabulary in ``path``.

    The file of the ``tokenizers`` library is read, and its vocabulary is given as
    ranks to ``tiktoken``, which cuts words by the same pattern, merges by the same
    ranks and takes a fifth of the time; the ids are equal (tests compare both on every
    code point and on random words). A text that holds a special token's string is
    encoded by ``tokenizers`` itself. ``ByteIds.of(path)`` gives the one of this
    process, which later tasks of a worker use again.
    """

    _own: dict[str, ByteIds] = {}

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        ranks = {bytes(map(BYTE_OF.__getitem__, t)): i for t, i in self.tokenizer.get_vocab().items() if t not in self.special}
        self.ranks = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def of(cls, path: str) -> ByteIds:
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def _one(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        return [self._one(t) for t in texts]
