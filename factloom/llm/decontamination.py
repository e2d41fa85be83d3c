"""Benchmark decontamination by a generalised suffix automaton over normalised test items.

The items' words make one automaton, held in flat arrays and broadcast; its size is bounded first, by the words that
it will hold (`max_bytes`). Each document's words stream through it, and the longest match that ends at each word
gives the words that any window covers. Stretches that cannot hold a window, as some n-gram in them is in no item,
are passed over without stepping the automaton; that changes no result.

Null or empty text: no words, not contaminated. Null item text: no windows. Null item_id: counted as the
id "null". Items with equal texts: each is counted, in order of their ids. Repeated documents: one result each, also
where they share a doc_id. Very long texts: whole, one pass. Other columns, whatever their names, are not read by the
scan and kept as they are by the cleaning. Empty tables: no documents give no rows; no items hit nothing.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .automaton import SPREAD, SuffixAutomaton
from .common import lean, table, texts

WINDOW = 10
#: What the automaton of a benchmark may take in the driver and in each worker, and what its parts take at most:
#: a word's two states, three transitions, their slots and its windows; a distinct word in the vocabulary; an item.
MAX_BYTES = 512 << 20
BYTES_A_WORD, BYTES_A_DISTINCT_WORD, BYTES_AN_ITEM = 160, 170, 400
#: Of a document's words that are hit: from this share on the whole document goes in the pipeline.
COVERAGE = 0.5

_LETTERS = set(range(48, 58)) | set(range(97, 123)) | set(range(128, 256))
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c in _LETTERS else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words: digits, a-z and whatever is not ASCII."""
    return text.encode().translate(_TO_WORDS).split()


class Automaton(SuffixAutomaton):
    """Suffix automaton over all items; states of windows know the items that hold them. Words are numbered from 1."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        self.names, listed = [], []
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text or "")]
            if ids:
                self.names.append(item_id)
                listed.append(array("i", ids))
        super().__init__(listed)
        pairs, short, shortest = (array("q"), array("q")), defaultdict(set), window
        for k, ids in enumerate(listed):
            if len(ids) < window:
                short[self.ends[k], len(ids)].add(k)
                shortest = min(shortest, len(ids))
            else:
                for state in self._windows(ids):
                    pairs[0].append(state)
                    pairs[1].append(k)
        #: Items by the state of a window that they hold, in order of states.
        both = np.unique(np.array([np.frombuffer(x, np.int64) for x in pairs]).reshape(2, -1), axis=1).astype(np.int32)
        self.window_states, self.window_items = both
        self.short: dict[int, list[tuple[int, set[int]]]] = defaultdict(list)
        for (state, n), held in short.items():
            self.short[state].append((n, held))
        self.gram = min(3, shortest)
        self.least = shortest - self.gram + 1
        self.grams = np.unique(np.concatenate([self._codes(np.array(ids, np.uint64)) for ids in listed if len(ids) >= self.gram])) if listed else np.empty(0, np.uint64)

    def _codes(self, ids: np.ndarray) -> np.ndarray:
        """A number for each gram; different grams that share one only make the scan look where nothing is."""
        code = np.zeros(len(ids) - self.gram + 1, np.uint64)
        for j in range(self.gram):
            code = code * np.uint64(SPREAD) + ids[j : len(ids) - self.gram + 1 + j]
        return code

    def _windows(self, ids):
        """The state of each window of an item."""
        for state, n in self.lengths(ids, self.window):
            if n == self.window:
                yield state

    def _held(self, state: int) -> list[int]:
        """The items that hold the window of a state; none for another state."""
        low, high = np.searchsorted(self.window_states, [state, state + 1])
        return self.window_items[low:high].tolist()

    def match(self, text: str) -> tuple[int, np.ndarray | None, set[str]]:
        """Number of words, which of them are hit (None: none), and the items found."""
        own = words(text)
        if len(own) < self.gram or not len(self.grams):
            return len(own), None, set()
        get = self.vocabulary.get
        ids = np.fromiter([get(w, 0) for w in own], np.int64, len(own))
        known = ids > 0
        whole = np.ones(len(ids) - self.gram + 1, bool)
        for j in range(self.gram):
            whole &= known[j : len(ids) - self.gram + 1 + j]
        at = np.flatnonzero(whole)
        code = self._codes(ids.astype(np.uint64))[at]
        at = at[self.grams[np.minimum(np.searchsorted(self.grams, code), len(self.grams) - 1)] == code]
        if len(at) < self.least:
            return len(own), None, set()
        hit, found, seen = np.zeros(len(own), bool), set(), {}
        for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
            if len(run) < self.least:
                continue
            start = int(run[0])
            for i, (state, n) in enumerate(self.lengths(ids[start : int(run[-1]) + self.gram].tolist(), self.window)):
                while state > 0:  # at most `window` links, as no match is longer
                    if n == self.window and seen.setdefault(state, None) is None:
                        seen[state] = bool(held := self._held(state))
                        found.update(held)
                    if n == self.window and seen[state]:
                        hit[start + i + 1 - self.window : start + i + 1] = True
                    for size, held in self.short.get(state, ()):
                        if size <= n:
                            found |= held
                            hit[start + i + 1 - size : start + i + 1] = True
                    if not self.short and self.length[state] < self.window:
                        break
                    state = self.link[state]
                    n = self.length[state]
        return len(own), hit if found else None, {self.names[k] for k in found}


#: The words as a column; the same letters as `words` takes.
_WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def automaton(benchmark: DataFrame, window: int = WINDOW, max_bytes: int = MAX_BYTES) -> Automaton:
    """The automaton of a benchmark table, which must fit max_bytes as it is broadcast; that is known before anything is collected."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = items.select(F.explode(F.regexp_extract_all(lower, F.lit(_WORD_PATTERN), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    size = own.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("distinct"), F.coalesce(F.sum(F.octet_length("w")), F.lit(0)).alias("b")).first()
    listed = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item_id")), F.lit(0)).alias("b")).first()
    needed = BYTES_A_WORD * size["n"] + BYTES_A_DISTINCT_WORD * size["distinct"] + size["b"] + BYTES_AN_ITEM * listed["n"] + 2 * listed["b"]
    if needed > max_bytes:
        raise ValueError(f"the benchmark's {size['n']} words take up to {needed} bytes as an automaton; at most {max_bytes} are broadcast, so run it in parts")
    return Automaton([(r["item_id"], r["text"]) for r in items.orderBy("item_id", "text").collect()], window)


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_bytes: int = MAX_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of documents."""
    held = documents.sparkSession.sparkContext.broadcast(automaton(benchmark, window, max_bytes))

    def scan(batches):
        for batch in batches:
            rows = [held.value.match(x) for x in batch.column("text").to_pylist()]
            hits = [0 if h is None else int(h.sum()) for _, h, _ in rows]
            columns = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in ([n for n, _, _ in rows], hits, [len(f) for _, _, f in rows]))]
            columns += [pa.array([hashlib.sha256(",".join(sorted(f)).encode()).hexdigest() for _, _, f in rows], pa.string()), pa.array([h > 0 for h in hits], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return texts(documents).mapInArrow(lean(scan), "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def without_hits(text: str, hit: np.ndarray) -> str:
    """The text without the stretches from the first to the last word of each run of hit words."""
    raw = text.encode()
    spaced = raw.translate(_TO_WORDS)
    inside = np.frombuffer(spaced, np.uint8) != 32
    starts = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    ends = np.flatnonzero(inside & ~np.r_[inside[1:], False]) + 1
    edge = np.diff(np.r_[0, hit.astype(np.int8), 0])
    kept, at = [], 0
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
        kept.append(raw[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*kept, raw[at:]]).decode()


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, max_bytes: int = MAX_BYTES) -> DataFrame:
    """documents without the words that windows hit; a document goes if they cover `coverage` of it or more.

    Other columns stay as they are, but n_chars is counted again where the text changes. Null texts stay.
    """
    held = documents.sparkSession.sparkContext.broadcast(automaton(benchmark, window, max_bytes))

    def clean(batches):
        for batch in batches:
            cleaned, keep, sizes = [], [], []
            for text in batch.column("text").to_pylist():
                n, hit, _ = held.value.match(text or "")
                keep.append(hit is None or int(hit.sum()) < coverage * n)
                while hit is not None and keep[-1]:  # a cut may join the parts of another window
                    text = without_hits(text, hit)
                    n, hit, _ = held.value.match(text)
                cleaned.append(text)
                sizes.append(None if text is None else len(text))
            columns = [pa.array(cleaned, pa.string()) if name == "text" else pa.array(sizes, batch.schema.field(name).type) if name == "n_chars" else batch.column(name) for name in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names).filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(lean(clean), documents.schema)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 10, 0) + 2), lambda i: array_to_string(w[i:i + 9], ' '))) AS g FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, sizes WHERE len(w) >= n),
grams AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM dw),
hits AS (SELECT doc_id, grams.n, i, item_id FROM grams JOIN windows USING (n, g)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
