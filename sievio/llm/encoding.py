"""Token ids of whole texts by the tokenizers library.

The vocabulary's pre-tokenizer never lets a token span white space, so a text's
ids are the ids of its white-space separated chunks, one after another. Each
worker keeps the ids of the chunks that it has met; only new chunks reach the
library."""

from __future__ import annotations

import functools
import re
import struct

from .common import worker_threads_off

END = struct.pack("<I", 1)
#: Chunks, and words, whose ids a worker keeps; beyond that it starts anew.
KEPT = 500_000
_OTHER_SPACE = re.compile("[\x1c-\x1f]")
#: A run of Latin letters and the ASCII punctuation after it (no apostrophe, which may open a contraction).
_WORD = re.compile(r"([A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\[-`{-~]*)")


def _byte_characters() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in same]
    return {b: chr(b) for b in same} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Words(dict):
    """Ids of lower-case Latin words, which the vocabulary's model gets without the steps before it: these would leave them as they are."""

    def __init__(self, tokenizer):
        self.model, self.characters = tokenizer.model, _byte_characters()

    def __missing__(self, word: str) -> bytes:
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.characters)
        packed = _pack([t.id for t in self.model.tokenize(shown)])
        if len(word) <= 48:
            if len(self) >= KEPT:
                self.clear()
            self[word] = packed
        return packed


class _Chunks(dict):
    """Ids of chunks, packed as little-endian 32-bit integers."""

    def __init__(self, tokenizer):
        self.encode, self.words, self.marks = tokenizer.encode, _Words(tokenizer), {"": b""}

    def __missing__(self, chunk: str) -> bytes:
        m = _WORD.fullmatch(chunk)
        if m:
            word, mark = m.groups()
            after = self.marks.get(mark)
            if after is None:
                after = _pack(self.encode(mark, add_special_tokens=False).ids)
                if len(mark) <= 3:
                    self.marks[mark] = after
            packed = self.words[word.lower()] + after
        else:
            packed = _pack(self.encode(chunk, add_special_tokens=False).ids)
        if len(chunk) <= 48:
            if len(self) >= KEPT:
                self.clear()
            self[chunk] = packed
        return packed


class TextEncoder:
    """encode(text): the ids of the whole text, packed, without an end id."""

    def __init__(self, path: str):
        worker_threads_off()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.chunks = _Chunks(self.tokenizer)

    def encode(self, text: str) -> bytes:
        if _OTHER_SPACE.search(text):  # characters that str.split takes for white space and the vocabulary doesn't
            return _pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.chunks.__getitem__, text.split()))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
