"""Tokenizer access with bounded per-worker caches.

Both vocabularies are only loaded, never trained. ``ByteBpe`` gives ids, ``PieceCounter`` counts; both cut a text
where no token can cross and look the parts up in a cache, so the library runs once for each new part.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterable
from functools import lru_cache

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"
CACHE_PARTS = 400_000
CACHE_CHARS = 48

_WS = r"\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: A space inside a longer run of white space: there the pre-tokenizer doesn't cut at each space.
_RUN = re.compile(f"[{_WS}] (?:[{_WS}]|$)|^ (?:[{_WS}]|$)")
#: Beyond these the two libraries' Unicode tables may be of different age.
_OTHER = re.compile("[^\x00-\u024f\u2010-\u2027]")
_CHUNK = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteBpe:
    """Ids of a byte-level BPE as little-endian unsigned 32-bit bytes.

    The pre-tokenizer glues one space to what follows it and otherwise starts a token where white space starts, so
    parts between single spaces are encoded on their own with the same ids. Texts with the special string, or with
    runs of white space, take slower paths with equal results. Where the same vocabulary is there as ranks too, Latin
    texts take the faster library for it, which gives the same ids.
    """

    def __init__(self, path: str, cache_parts: int = CACHE_PARTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.cache: dict[str, bytes] = {}
        self.limit = cache_parts
        self.fast = self._ranks(os.path.splitext(path)[0] + ".tiktoken")

    def _ranks(self, path: str):
        if not os.path.exists(path):
            return None
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        if len(ranks) + len(self.special) != self.tok.get_vocab_size():
            return None
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _batch(self, parts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tok.encode_batch(parts, add_special_tokens=False)]

    def _lookup(self, parts: list[str]) -> list[bytes]:
        cache = self.cache
        found = list(map(cache.get, parts))
        if None in found:
            missing = list({p for p, f in zip(parts, found) if f is None})
            fresh = dict(zip(missing, self._batch(missing)))
            if len(cache) + len(fresh) > self.limit:
                cache.clear()
            for p, b in fresh.items():
                if len(p) <= CACHE_CHARS and len(cache) < self.limit:
                    cache[p] = b
            found = [fresh[p] if f is None else f for p, f in zip(parts, found)]
        return found

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self._batch([text])[0]
        if self.fast and not _OTHER.search(text):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        if _RUN.search(text):
            return b"".join(self._lookup(_CHUNK.findall(text)))
        first, *rest = text.split(" ")
        return b"".join(self._lookup([first] + [" " + p for p in rest] if first else [" " + p for p in rest]))


class PieceCounter:
    """Token counts of a sentencepiece BPE without its begin and end tokens.

    No piece holds the word mark after another character, so the parts that start with a run of marks are counted
    alone. ``table`` is the broadcast first tier (part to count); the worker cache is the second.
    """

    def __init__(self, path: str, table: dict[str, int] | None = None, cache_parts: int = CACHE_PARTS):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.table = dict(table or {})
        self.tier1 = len(self.table)
        self.cache = dict(self.table)
        self.limit = max(cache_parts, 2 * self.tier1)
        mark = "▁"
        if any(mark in self.sp.id_to_piece(i).lstrip(mark) for i in range(self.sp.vocab_size())):
            raise ValueError("a piece holds the word mark after another character")

    @staticmethod
    def parts(text: str) -> list[str]:
        """Parts after their first mark; a part that is only one mark at the end is ''. A mark in a text is a space."""
        if not text:
            return []
        if "▁" in text:
            text = text.replace("▁", " ")
        if "  " not in text and text[0] != " ":
            return text.split(" ")
        return [p[1:] for p in re.findall(" +[^ ]*", " " + text)]

    def _encode(self, parts: list[str]) -> list[int]:
        return [len(ids) if p else 1 for p, ids in zip(parts, self.sp.encode(parts, num_threads=1))]

    def count(self, text: str) -> int:
        parts = self.parts(text)
        cache = self.cache
        found = list(map(cache.get, parts))
        try:
            return sum(found)
        except TypeError:
            missing = list({p for p, f in zip(parts, found) if f is None})
            fresh = dict(zip(missing, self._encode(missing)))
            if len(cache) + len(fresh) > self.limit:
                cache.clear()
                cache.update(self.table)
            for p, n in fresh.items():
                if len(p) <= CACHE_CHARS and len(cache) < self.limit:
                    cache[p] = n
            return sum(fresh[p] if f is None else f for p, f in zip(parts, found))


@lru_cache(2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def byte_ids(texts: Iterable[str], path: str) -> list[bytes]:
    bpe = byte_bpe(path)
    return [bpe.encode(t or "") for t in texts]
