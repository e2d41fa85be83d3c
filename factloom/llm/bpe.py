"""Byte-level BPE by distinct pre-tokens.

A space that is followed by a non-space always starts a new pre-token in the vocabulary's split
pattern, so a text is cut there first; a chunk (one word with its punctuation) is one pre-token or a few.
For counts, each distinct pre-token is counted once for each worker and each distinct short chunk has the sum of its
pre-tokens; of a long chunk, as in scripts without spaces, the pre-tokens' frequencies are taken instead. The
memos are bounded, in entries and in what one of them may hold, and refill after they are emptied.
"""

from __future__ import annotations

import base64
import functools
import os
import re
from collections import Counter as Frequencies
from operator import mul

import numpy as np
import public_tokenizers
import regex
import tiktoken
from tokenizers import Tokenizer

VOCABULARY = "byte_bpe_50k.json"
MEMO_ENTRIES, MEMO_LENGTH = 700_000, 64

_SPECIAL = "<|endoftext|>"
_SPECIAL_ID = 50256
#: Characters on which all Unicode versions of the splitting pattern agree.
_PLAIN = re.compile(r"[\x00-\x1b\x20-ɏ]*")
_LOOSE_SPACE = re.compile(r" (?:\s|\Z)")
_PRE_TOKEN = regex.compile(public_tokenizers.PATTERN)
_CUT = re.compile(r"(?= (?:\S|[\x1c-\x1f]))")


@functools.cache
def _json_tokenizer(path: str) -> Tokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Tokenizer.from_file(path)


@functools.cache
def _ranks(path: str) -> tiktoken.Encoding | None:
    """The same vocabulary as ranks, which encodes plain chunks faster; None where there is no such file."""
    if not os.path.exists(path):
        return None
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode_chunk(chunk: str, path: str) -> list[int]:
    """Ids of a chunk that holds no special string."""
    fast = _ranks(path.removesuffix(".json") + ".tiktoken")
    if fast is not None and _PLAIN.fullmatch(chunk):
        return fast.encode_ordinary(chunk)
    return _json_tokenizer(path).encode(chunk, add_special_tokens=False).ids


class _Memo(dict):
    """What is known of each chunk; lead stands before every chunk that is asked for."""

    def __init__(self, of, lead: str):
        self.of, self.lead = of, lead
        self.known = self.__getitem__

    def __missing__(self, chunk: str):
        found = self.of(self.lead + chunk)
        if len(chunk) <= MEMO_LENGTH:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[chunk] = found
        return found


def _chunks(text: str) -> tuple[str, list[str]]:
    """The first chunk, and the others without their leading space."""
    if _LOOSE_SPACE.search(text):
        first, *rest = _CUT.split(text)
        return first, [x[1:] for x in rest]
    first, *rest = text.split(" ")
    return first, rest


def _weighed(count, frequency: dict[str, int]) -> int:
    return sum(map(mul, map(count, frequency), frequency.values()))


class Counter:
    """Token counts from the frequencies of pre-tokens; no list of ids is made for a text."""

    def __init__(self, path: str):
        self.fast, self.slow = _ranks(path.removesuffix(".json") + ".tiktoken"), _json_tokenizer(path)
        self.plain = _Memo(lambda piece: len(self.fast.encode_ordinary(piece)), "")
        self.other = _Memo(lambda piece: len(self.slow.model.tokenize(piece)), "")
        self.first, self.rest = _Memo(self._chunk, ""), _Memo(self._chunk, " ")

    def _chunk(self, chunk: str) -> int:
        if self.fast is not None and (chunk.isascii() and chunk[1:].isalpha() or _PLAIN.fullmatch(chunk)):
            pieces = [chunk] if chunk[1:].isalpha() and chunk[0] == " " else _PRE_TOKEN.findall(chunk)
            if len(pieces) > 8:
                return _weighed(self.plain.known, Frequencies(pieces))
            return sum(map(self.plain.known, pieces)) if len(pieces) > 1 else len(self.fast.encode_ordinary(chunk))
        # its pre-tokens come as the model reads them, a letter for each byte
        return _weighed(self.other.known, Frequencies(piece for piece, _ in self.slow.pre_tokenizer.pre_tokenize_str(chunk)))

    def count(self, text: str) -> int:
        total = 0
        for k, part in enumerate(text.split(_SPECIAL)):
            first, rest = _chunks(part)
            total += (k > 0) + self.first.known(first) + _weighed(self.rest.known, Frequencies(rest))
        return total


class Encoder:
    """Ids of whole texts as arrays: plain parts in one call, others by chunks."""

    def __init__(self, path: str):
        self.fast = _ranks(path.removesuffix(".json") + ".tiktoken")
        of = lambda chunk: np.array(encode_chunk(chunk, path) if chunk else [], "<u4").tobytes()
        self.first, self.rest = _Memo(of, ""), _Memo(of, " ")

    def ids(self, text: str) -> np.ndarray:
        parts = []
        for k, part in enumerate(text.split(_SPECIAL)):
            if k:
                parts.append(np.array([_SPECIAL_ID], "<u4").tobytes())
            if self.fast is not None and _PLAIN.fullmatch(part):
                parts.append(self.fast.encode_to_numpy(part, disallowed_special=()).astype("<u4", copy=False).tobytes())
                continue
            first, rest = _chunks(part)
            parts += [self.first[first], *map(self.rest.__getitem__, rest)]
        return np.frombuffer(b"".join(parts), "<u4")


@functools.cache
def counter(path: str) -> Counter:
    return Counter(path)


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def vocabulary_path() -> str:
    return public_tokenizers.path(VOCABULARY)
