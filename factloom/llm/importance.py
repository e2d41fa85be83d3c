"""Target-distribution importance resampling by an external sort-count.

Each batch of documents becomes a row of packed data in the shared folder: the buckets of its features as one stream of
uint16, and the place of each document in it. The counts come from the streams, each sorted and run-length encoded, summed
in the task and then over tasks. The gains, one for each bucket, go back to the streams, where each document's are
gathered and summed by np.add.reduceat. Texts are read once. The draw adds noise that depends on the id alone
and takes the highest scores, placed by ranges of the score, so that no task holds them all.

Null or empty text: no features, weight 0, never drawn. Null doc_id: the noise of `seed:`, last among ties. Ties of score: the smaller
doc_id first; rows that share that too in the order of their batches. Repeated rows: counted and scored each.
Very long texts: whole. Other columns, whatever their names, are not read. Empty tables: no documents give no
rows; an empty target gives its buckets no counts, as the formula has it.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.places import with_places

from .common import lean, table, texts, written
from .decontamination import words

BUCKETS, MOST_WORDS_A_FEATURE = 10_000, 1
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
#: Features whose bucket a worker remembers.
MEMO_ENTRIES = 500_000
#: A stream is closed once it holds so many features; a document is never split.
STREAM = 4_000_000

_STREAMS = "task int, number int, doc_id array<long>, n_words binary, starts binary, stream binary"


class _Bucket(dict):
    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        found = zlib.crc32(feature) % self.buckets
        if len(feature) <= 64:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[feature] = found
        return found


def features(own: list[bytes], most: int):
    """All runs of 1 to `most` words, joined by a space."""
    for n in range(1, most + 1):
        yield from own if n == 1 else (b" ".join(own[i : i + n]) for i in range(len(own) - n + 1))


def packed_streams(documents: DataFrame, buckets: int = BUCKETS, most: int = MOST_WORDS_A_FEATURE) -> DataFrame:
    """(task, number, doc_id, n_words, starts, stream) for each batch: little-endian uint16 buckets, int64 starts and word counts."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket must fit 16 bits")

    def pack(batches):
        task, number, bucket = TaskContext.get().partitionId(), 0, _Bucket(buckets)
        ids, sizes, starts, streams, held = [], [], [], [], 0

        def closed():
            arrays = [[task], [number], [ids], [np.array(sizes, "<i8").tobytes()], [np.array(starts, "<i8").tobytes()], [b"".join(streams)]]
            kinds = pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(arrays, kinds)], ["task", "number", "doc_id", "n_words", "starts", "stream"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                own = words(text)
                packed = np.fromiter(map(bucket.__getitem__, features(own, most)), "<u2")
                ids.append(doc_id)
                sizes.append(len(own))
                starts.append(held)
                streams.append(packed.tobytes())
                held += len(packed)
                if held >= STREAM or len(ids) >= 20_000:
                    yield closed()
                    number += 1
                    ids, sizes, starts, streams, held = [], [], [], [], 0
        if ids:
            yield closed()

    return texts(documents).mapInArrow(lean(pack), _STREAMS)


def bucket_counts(streams: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs: one number for each bucket comes to the driver, whatever the corpus."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in batch.column("stream"):
                ordered = np.sort(np.frombuffer(raw.as_buffer(), "<u2"))
                if len(ordered):
                    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
                    total[ordered[first]] += np.diff(np.r_[first, len(ordered)])
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in streams.select("stream").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares in target and source, floored."""
    b, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1) * (s + b) / ((x + 1) * (t + b)))) for x, y in zip(source.tolist(), target.tolist())], np.int64)


def noise(seed: int, doc_id: int | None) -> int:
    """A Gumbel number in thousandths, floored, by the id alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(streams: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, n_words, task, number, nth) for each document of the streams."""

    def weigh(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                stream, starts, sizes = (np.frombuffer(batch.column(c)[k].as_buffer(), kind) for c, kind in (("stream", "<u2"), ("starts", "<i8"), ("n_words", "<i8")))
                counts = np.diff(np.r_[starts, len(stream)])
                weight, full = np.zeros(len(starts), np.int64), counts > 0
                if full.any():
                    weight[full] = np.add.reduceat(gain[stream], starts[full])
                ids = batch.column("doc_id")[k].as_py()
                score = weight + np.array([noise(seed, i) for i in ids], np.int64)
                same = [np.full(len(ids), batch.column(c)[k].as_py(), np.int32) for c in ("task", "number")]
                columns = [pa.array(ids, pa.int64()), *(pa.array(x, pa.int64()) for x in (counts, weight, score, sizes)), *(pa.array(x, pa.int32()) for x in (*same, np.arange(len(ids))))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_features", "weight", "score", "n_words", "task", "number", "nth"])

    return streams.mapInArrow(lean(weigh), "doc_id long, n_features long, weight long, score long, n_words long, task int, number int, nth int")


def resampled(documents: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, most: int = MOST_WORDS_A_FEATURE) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each row of documents; the rank is null where it is not drawn.

    Of the N documents with `least_words` words, floor(percent * N / 100) are drawn.
    """
    streams = written(packed_streams(documents, buckets, most), "streams")
    items = packed_streams(target.select(F.lit(None).alias("doc_id"), "text"), buckets, most)
    gain = gains(bucket_counts(streams, buckets), bucket_counts(items, buckets))
    scored = weighed(streams, gain, seed).withColumn("out", (F.col("n_words") < least_words).cast("int"))
    placed = with_places(scored, ["out", F.desc("score"), F.asc_nulls_last("doc_id"), "task", "number", "nth"], written)
    drawn = placed.agg(F.floor(F.count_if(F.col("out") == 0) * percent / 100).alias("drawn")).first()["drawn"]
    rank = F.when((F.col("out") == 0) & (F.col("place") < F.lit(drawn)), F.col("place") + 1)
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: crc32 by its table, which is made by its rule, over the bytes of each distinct word.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (SELECT r, unnest(w) AS word FROM d),
bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
v AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
c AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM v, t),
sw AS (SELECT bucket, count(*) AS s FROM dw JOIN c USING (word) GROUP BY 1),
tw AS (SELECT bucket, count(*) AS t FROM bw JOIN c USING (word) GROUP BY 1),
n AS (SELECT (SELECT count(*) FROM dw) AS ss, (SELECT count(*) FROM bw) AS tt),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (ss + 10000) / ((s + 1) * (tt + 10000))))::BIGINT AS gain FROM sw LEFT JOIN tw USING (bucket), n),
p AS (SELECT r, sum(gain)::BIGINT AS weight FROM dw JOIN c USING (word) JOIN g USING (bucket) GROUP BY 1),
h AS (SELECT r, doc_id, len(w) AS n, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d),
z AS (SELECT r, doc_id, n, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM h LEFT JOIN p USING (r)),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, r) AS place, count(*) OVER () AS eligible FROM z WHERE n >= 20)
SELECT doc_id, n::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN place <= 10 * eligible // 100 THEN place END::BIGINT AS rank FROM z LEFT JOIN k USING (r)
"""
