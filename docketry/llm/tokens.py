"""Token ids of a public byte-level BPE vocabulary, a chunk of text at a time, with a bounded cache."""

from __future__ import annotations

import base64
import os
import re
import struct

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

#: Distinct chunks whose ids one Python worker remembers; later ones are encoded each time.
CACHE_CHUNKS = 400_000
#: A space inside a run of whitespace of any kind, unless it is the run's last before a word.
JOINED = re.compile(r"\s (?:\s|\Z)|  ")
#: A space between two characters that are not whitespace: no match of the splitting pattern reaches across its front.
SAFE = re.compile(r"(?<=\S)(?= \S)")
#: Below this character both libraries know the same letters, digits and blanks (see the tests).
SETTLED = "\u0250"


def default_vocabulary() -> str:
    """The tokenizer file of `byte_bpe_50k`."""
    return public_tokenizers.path("byte_bpe_50k.json")


class ByteBpe:
    """Encodes whole texts to little-endian 32-bit ids, as the tokenizer file does without special tokens added.

    The splitting pattern takes a space as the beginning of what follows it, but for a space
    inside a run of whitespace (U+00A0, line breaks and others alike). Texts without such a run
    are encoded one space-led chunk at a time, and any other text is cut only at spaces that
    stand between two characters that are not whitespace, so that a repeated word costs a
    dictionary look-up. A text that holds one of the file's special tokens is encoded as a
    whole, with the ids that the tokenizer gives them.

    Chunks of settled characters are encoded from the rank file beside the tokenizer's, where
    there is one: the same vocabulary, several times faster.
    """

    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self._tokenizer = Tokenizer.from_file(path)
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._cache: dict[str, bytes] = {}
        self._limit = cache_chunks
        self._ranks = None
        if os.path.exists(ranked := path.removesuffix(".json") + ".tiktoken"):
            with open(ranked, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self._ranks = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _encode(self, text: str) -> bytes:
        """The ids of a text by the tokenizer itself."""
        ids = self._tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, text: str) -> bytes:
        """The ids of a text without special tokens."""
        if self._ranks is None or not (text.isascii() or max(text) < SETTLED):
            return self._encode(text)
        ids = self._ranks.encode_ordinary(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """The ids of a text, four bytes each."""
        if any(s in text for s in self._special):
            return self._encode(text)
        if JOINED.search(text):
            head, *rest = SAFE.split(text)
            rest = [x[1:] for x in rest]
        else:
            head, *rest = text.split(" ")
        get = self._cache.get
        found = [get(x) for x in rest]
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    found[i] = x = self._chunk(" " + rest[i])
                    if len(self._cache) < self._limit and len(rest[i]) < 64:
                        self._cache[rest[i]] = x
        return self._chunk(head) + b"".join(found) if head else b"".join(found)


_LOADED: dict[str, ByteBpe] = {}


def load(path: str) -> ByteBpe:
    """The encoder of a vocabulary file, built once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]
