"""BPE with word ends: exact ids by dynamic programming over prefixes, and the text that ids stand for.

A word is a row of symbols, one for each byte, the last of which carries the word's end. Every prefix of a word has one
encoding, and so one last token. It is stored for each prefix: of the tokens that end there, which a suffix automaton of the
vocabulary gives, the one that may stand behind the last token of what lies before it. Whether two tokens may stand side by side
(compatible) depends on these two alone, and is remembered. The back-pointers, from the word's end, give its ids.

A task keeps the prefixes that it has seen in a tree, so that a word pays only for what no word before it began with, and what it
found for whole pieces between blanks (both bounded); no shuffle.

Null text: empty, no ids. Null doc_id: the row stays. Repeated rows, and rows that share a doc_id: one result each. Very long
texts and words: whole, in time that grows with their length. Other columns, whatever their names, are not read. Empty
table: no rows. Strings of special tokens inside texts are these tokens, as the library has it. A null list of ids decodes to
a null text, an empty one to an empty text; ids that the vocabulary lacks are passed over.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import unicodedata
from array import array
from operator import itemgetter

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .automaton import SuffixAutomaton
from .common import lean, table, texts

VOCABULARY = "word_bpe_49k.json"
MEMO_ENTRIES, MEMO_LENGTH = 400_000, 64
#: Compatible pairs, and prefixes of words, that a worker remembers.
MEMO_PAIRS, MEMO_NODES = 1_000_000, 1_000_000

#: Characters (to Latin Extended-B) on which the library's rules for case, composition and splitting agree with Python's, and what they are in lower case.
_LATIN, _LOWER = range(0x250), range(0x2B0)
_PLAIN = re.compile("[" + "".join(re.escape(chr(c)) for c in _LATIN if c not in range(0x1C, 0x20) and len(chr(c).lower()) == 1 and ord(chr(c).lower()) in _LOWER) + "]*")
_NEVER = 1 << 30
#: A word's last byte is a symbol of its own: so much more than that byte.
WORD_END = 256
_SYMBOLS = 2 * WORD_END


def _of(kind: str) -> str:
    """The plain characters of a general category, as they stand in a pattern's class."""
    return "".join(re.escape(chr(c)) for c in _LOWER if unicodedata.category(chr(c))[0] == kind)


def _letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is printable Latin-1, else the next free one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(256 + others.index(b)) for b in range(256)]


class _Memo(dict):
    """What `of` says of each key, for the shorter keys that came since it was last full."""

    def __init__(self, of):
        self.of = of

    def __missing__(self, key: str):
        found = self.of(key)
        if len(key) <= MEMO_LENGTH:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[key] = found
        return found


class WordBpe:
    """A vocabulary file of the tokenizers library: a byte-level BPE model whose last symbol of a word carries an ending.

    What normalises and splits a text is the file's own; texts of plain letters are split by its pattern alone, which gives the same.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.library, self.ending, vocabulary = Tokenizer.from_file(path), model["end_of_word_suffix"], model["vocab"]
        self.texts = {i: t for t, i in vocabulary.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.decimal = {i: str(i) for i in self.texts}
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        split = [x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"]
        self.plain = re.compile(split[0].replace(r"\p{L}", _of("L")).replace(r"\p{N}", _of("N")))
        self.byte = {c: b for b, c in enumerate(_letters())}
        self._learn(vocabulary, [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]])
        self.words, self.chunks = _Memo(self._plain_word), _Memo(self._chunk)
        self._forget()

    def _learn(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]) -> None:
        ids = sorted(vocabulary.values())
        listed = []
        for i in ids:
            token = self.texts[i]
            own = token.removesuffix(self.ending) if len(token) > len(self.ending) else token
            row = array("i", map(self.byte.__getitem__, own))
            if own != token:
                row[-1] += WORD_END
            listed.append(row)
        self.automaton = SuffixAutomaton(listed)
        self.size = dict(zip(ids, map(len, listed)))
        own = self.automaton
        #: Where a symbol leads from a state, by both in one number; and, of each state, the tokens that its longest string ends with, the longest first, with their sizes.
        self.goto = {own.owner[e] * _SYMBOLS + own.symbol[e]: own.to[e] for e in range(1, len(own.to))}
        token, self.ending_at = dict(zip(own.ends, ids)), [()] * len(own.link)
        for state in sorted(range(1, len(own.link)), key=own.length.__getitem__):
            above = self.ending_at[own.link[state]]
            self.ending_at[state] = ((token[state], own.length[state]), *above) if state in token else above
        self.links, self.lengths = own.link.tolist(), own.length.tolist()
        del self.automaton
        self.rank, self.parts = {}, {}
        for k, (a, b) in enumerate(merges):
            a, b = vocabulary[a], vocabulary[b]
            whole = vocabulary[self.texts[a] + self.texts[b]]
            self.rank[a, b] = k
            self.parts.setdefault(whole, (a, b, k))
        self._left, self._right = functools.cache(self._edge(0)), functools.cache(self._edge(1))
        self.whole = {i for i in ids if self._reachable(i)}
        self.compatible: dict[tuple[int, int], bool] = {}

    def _edge(self, side: int):
        def edge(token: int) -> list[tuple[int, int]]:
            """What stands at a token's left (0) or right (1) end while it is being made, each with the rank of the merge that ends it."""
            out, until = [(token, _NEVER)], None
            while made := self.parts.get(token):
                token, until = made[side], made[2]
                out.append((token, until))
            return out

        return edge

    def _side_by_side(self, a: int, b: int) -> bool:
        """Whether the tokens stay apart: no merge across them comes while both of its parts stand there. Of equal ranks the left one comes first."""
        for x, x_until in self._right(a):
            for y, y_until in self._left(b):
                k = self.rank.get((x, y))
                if k is not None and k < x_until and k <= y_until:
                    return False
        return True

    def _reachable(self, token: int) -> bool:
        """Whether a token's own text is encoded as that token: its parts are, and the merge of them comes before any other between them."""
        made = self.parts.get(token)
        if made is None:
            return self.size[token] == 1
        a, b, k = made
        for x, x_until in self._right(a):
            for y, y_until in self._left(b):
                other = self.rank.get((x, y))
                if other is not None and (x, y) != (a, b) and other < x_until and other <= y_until:
                    return False
        return self._reachable(a) and self._reachable(b)

    def _fits(self, a: int, b: int) -> bool:
        """Whether the tokens may stand side by side, remembered."""
        known = self.compatible
        if len(known) >= MEMO_PAIRS:
            known.clear()
        found = known[a << 20 | b] = self._side_by_side(a, b)
        return found

    def _forget(self) -> None:
        """The tree of prefixes: the node below another by a symbol; of each node the automaton's state and match, the last token, and the node before that token."""
        self.below, self.state, self.match, self.token, self.before = {}, [0], [0], [-1], [0]

    def encode_symbols(self, row: list[int]) -> list[int]:
        """Ids of a word's symbols: its bytes, the last one and WORD_END more.

        What is found for the prefixes stays in the tree for other words that begin like it, but for a very long word's, which has a tree of its own.
        """
        if len(row) > MEMO_LENGTH or len(self.token) > MEMO_NODES:
            self._forget()
        below, states, matches, tokens, before = self.below, self.state, self.match, self.token, self.before
        goto, links, lengths, ending_at, known, whole = self.goto, self.links, self.lengths, self.ending_at, self.compatible, self.whole
        node, path = 0, [0]
        for c in row:
            to = below.get(node * _SYMBOLS + c)
            if to is None:
                state, n = states[node], matches[node] + 1
                on = goto.get(state * _SYMBOLS + c)
                while on is None:  # the root knows every symbol
                    state = links[state]
                    n = lengths[state] + 1
                    on = goto.get(state * _SYMBOLS + c)
                at = len(path)
                for t, size in ending_at[on if lengths[on] == n else links[on]]:
                    if size == at:
                        if t in whole:
                            break
                    else:
                        a = tokens[path[at - size]]
                        fits = known.get(a << 20 | t)
                        if fits or fits is None and self._fits(a, t):
                            break
                to = below[node * _SYMBOLS + c] = len(tokens)
                states.append(on)
                matches.append(n)
                tokens.append(t)
                before.append(path[at - size])
            node = to
            path.append(to)
        out = []
        while node:
            out.append(tokens[node])
            node = before[node]
        out.reverse()
        if len(row) > MEMO_LENGTH:
            self._forget()
        return out

    def word(self, raw: bytes) -> list[int]:
        """Ids of a pre-token."""
        row = [*raw]
        row[-1] += WORD_END
        return self.encode_symbols(row)

    def _said(self, ids: list[int]) -> tuple[str, str]:
        """Ids as text, and decoded."""
        return " ".join([self.decimal[i] for i in ids]), " ".join([self.texts[i] for i in ids])

    def _plain_word(self, word: str) -> tuple[str, str]:
        return self._said(self.word(word.encode()))

    def _chunk(self, chunk: str) -> tuple[str, str]:
        """What stands between blanks and holds no special token, split by the library."""
        normal = self.library.normalizer.normalize_str(chunk)
        pieces = self.library.pre_tokenizer.pre_tokenize_str(normal)
        return self._said([i for p, _ in pieces for i in self.word(bytes(map(self.byte.__getitem__, p)))])

    def _parts(self, text: str) -> list[tuple[str, str]]:
        """(ids as text, decoded text) of the text's words in order."""
        out = []
        for part in self.cut.split(text) if self.cut else (text,):
            if part in self.special:
                out.append((self.decimal[self.special[part]], part))
            elif _PLAIN.fullmatch(part):
                out += map(self.words.__getitem__, self.plain.findall(part.lower()))
            else:
                for chunk in part.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "):
                    if _PLAIN.fullmatch(chunk):
                        out += map(self.words.__getitem__, self.plain.findall(chunk.lower()))
                    elif (found := self.chunks[chunk])[0]:
                        out.append(found)
        return out

    def ids(self, text: str) -> list[int]:
        return list(map(int, " ".join(map(itemgetter(0), self._parts(text))).split()))

    def digests(self, text: str) -> tuple[int, str, str]:
        """(n_tokens, sha256 of the decimal ids, sha256 of the decoded text): of what `ids` and `decode` give, each joined by a space."""
        parts = self._parts(text)
        ids, said = (" ".join(map(itemgetter(k), parts)).encode() for k in (0, 1))
        return (ids.count(b" ") + 1 if ids else 0), hashlib.sha256(ids).hexdigest(), hashlib.sha256(said).hexdigest()

    def decode(self, ids) -> str:
        return " ".join([self.texts[i] for i in ids if i in self.texts])


@functools.cache
def coder(path: str) -> WordBpe:
    return WordBpe(path)


def encoded(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) for each row of documents."""

    def encode(batches):
        of = coder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([of.ids(x) for x in batch.column("text").to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return texts(documents).mapInArrow(lean(encode), "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids)."""

    def decode(batches):
        of = coder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([None if x is None else of.decode(x) for x in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(lean(decode), "doc_id long, text string")


def encoding_digests(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of documents: what `encoded` and `decoded` give, without moving it."""

    def digest(batches):
        of = coder(path)
        for batch in batches:
            rows = [of.digests(x) for x in batch.column("text").to_pylist()]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(documents).mapInArrow(lean(digest), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
