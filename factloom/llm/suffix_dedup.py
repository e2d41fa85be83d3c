"""Exact substring dedup by suffix arrays.

Every byte that a string of `LENGTH` bytes covers which also starts earlier is removed. A corpus has far
too many suffixes for one array, so texts are first brought together where they can agree:

1. Copies of a whole text are known by their hash; only the first of them goes on.
2. Each string of LENGTH bytes has an anchor, the least hash of its 32-byte grams, leftmost at ties, which
   every occurrence of the string has in the same place. Neighbouring strings mostly share one, so a text is
   cut into runs, one for about 35 bytes, known by hashes of the anchor and of the run's whole stretch.
3. Runs meet by anchor, in buckets of bounded bytes. Those whose whole stretch came earlier are removed, by two
   independent 64-bit hashes of it, beside the anchor's; of the others, those that also agree beyond the anchor, on
   one side as far as each of its strings reaches, are asked for.
4. The stretches asked for are dealt by what they share, and each block gets a suffix array: suffixes that
   are smaller than their successors are sorted, the rest induced by bucket scans, and adjacent common
   prefixes of LENGTH bytes mark strings that came earlier. A key with many stretches is split by more
   of what they share, down to single strings, whose first is an aggregate by their bytes; no task gathers one.

Rows are told apart by doc_id. Null text: empty. Null doc_id: compared with nothing, nothing removed.
Repeated rows and rows that share a doc_id: one result, for the text with the smallest hash. Texts under
LENGTH bytes keep all. Very long texts are read whole. Ties: of equal strings the one of the smallest doc_id and
start is the first. Other columns, whatever their names, are not read. Empty table: no rows.
"""

from __future__ import annotations

import contextlib
import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.components import with_group_facts

from .common import shared_folder, shuffles_dropped, table, tasks, texts, written
from .suffix_array import shared_prefixes, suffix_array, words_at

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1  # places of the anchor in a string: 0 to SPAN - 1
HALF = (SPAN - 1) // 2
#: Texts whose runs leave a task together, and parts of them whose arrays fit a processor's cache, as do blocks of stretches.
BATCH_BYTES, PART_BYTES, BLOCK_BYTES = 4 << 20, 256 << 10, 256 << 10
MOST_OF_A_KEY = 20_000
#: Text whose runs one task meets, and buckets that it takes one after the other.
MEET_BYTES, BUCKETS_A_TASK = 128 << 20, 8

_RUN = np.dtype([("anchor", "<u8"), ("whole", "<u8"), ("check", "<u8"), ("right", "<u4"), ("left", "<u4"), ("doc", "<i8"), ("start", "<u4"), ("place", "u1"), ("more", "u1")])
_RANDOM = np.random.default_rng(5)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
_BYTE_CHECK = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE_CHECK = np.uint64(0xD1342543DE82EF95)
_INVERSE_CHECK = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_ODD = _RANDOM.integers(1, 1 << 63, GRAM // 8, dtype=np.uint64) | np.uint64(1)


def _mixed(x):
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def runs(docs: np.ndarray, raw: list[bytes]) -> np.ndarray:
    """The runs of texts (each of LENGTH bytes at least)."""
    t = np.frombuffer(b"".join(raw), np.uint8)
    sizes = np.array([len(x) for x in raw])
    ends = np.cumsum(sizes)
    word = words_at(t)
    n = len(t) - GRAM + 1
    code = np.zeros(n, np.uint64)
    for j in range(GRAM // 8):
        code = code + _mixed(word[8 * j : 8 * j + n] ^ _ODD[j]) * _ODD[j]
    code = _mixed(code)
    low = np.uint64((1 << 31) - 1)
    key = (code & ~low) | np.arange(n, dtype=np.uint64)  # leftmost at ties
    least, width = key, 1
    while 2 * width <= SPAN:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    if width < SPAN:
        more = SPAN - width
        least = np.minimum(least[: len(least) - more], least[more:])
    anchor = (least & low).astype(np.int64)  # of the string that starts at each position
    starts = ends - sizes
    owner = np.repeat(np.arange(len(raw)), np.maximum(sizes - LENGTH + 1, 0))
    own = np.arange(len(owner)) - np.repeat(np.cumsum(np.maximum(sizes - LENGTH + 1, 0)) - np.maximum(sizes - LENGTH + 1, 0), np.maximum(sizes - LENGTH + 1, 0)) + starts[owner]
    at = anchor[own]
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])])
    last = np.r_[first[1:], len(own)] - 1
    a, p0, p1, doc = at[first], own[first], own[last], owner[first]

    def hashes(byte, base, inverse):
        sums, back = np.zeros(len(t) + 1, np.uint64), _powers(inverse, len(t) + 1)
        np.cumsum(byte[t] * _powers(base, len(t)), out=sums[1:])
        return lambda s, e: _mixed((sums[e] - sums[s]) * back[s])

    of = hashes(_BYTE, _BASE, _INVERSE)
    out = np.zeros(len(first), _RUN)
    out["anchor"] = code[a]
    out["whole"] = _mixed(of(p0, p1 + LENGTH) + (a - p0).astype(np.uint64) * np.uint64(977) + (p1 - p0).astype(np.uint64))
    out["check"] = hashes(_BYTE_CHECK, _BASE_CHECK, _INVERSE_CHECK)(p0, p1 + LENGTH)
    has_right, has_left = a - p1 <= HALF, a - p0 > HALF
    out["right"] = np.where(has_right, of(a, np.where(has_right, a + LENGTH - HALF, a)) >> np.uint64(33) | np.uint64(1), 0)
    out["left"] = np.where(has_left, of(np.where(has_left, a - HALF - 1, a), a) >> np.uint64(33) | np.uint64(1), 0)
    out["doc"], out["start"], out["place"], out["more"] = docs[doc], p0 - starts[doc], a - p0, p1 - p0
    return out


def _firsts(run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by anchor, stretch and place; and which are not the first of their stretch."""
    run = run[np.lexsort((run["start"], run["doc"], run["check"], run["whole"], run["anchor"]))]
    same = [run[c][1:] == run[c][:-1] for c in ("anchor", "whole", "check")]
    return run, np.r_[False, same[0] & same[1] & same[2]] if len(run) else np.empty(0, bool)


_FOUND = "doc long, start long, stop long, key long, anchor_at long, low int, high int"


def _batch(columns):
    names = [x.split()[0] for x in _FOUND.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 5 else pa.int32()) for k, c in enumerate(columns)], names)


def _scanned(firsts: DataFrame, buckets: int) -> DataFrame:
    """Runs of all texts in blobs, dealt to buckets by anchor."""

    def scan(batches):
        def emit(docs, raw):
            ids, part = np.array(docs, np.int64), np.cumsum([len(x) for x in raw]) // PART_BYTES
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(raw)]
            run, again = _firsts(np.concatenate([runs(ids[a:b], raw[a:b]) for a, b in zip(cuts, cuts[1:])]))
            # What repeats within a batch is pre-aggregated: its copies need only say that they go.
            gone, run = run[again], run[~again]
            bucket = (run["anchor"] >> np.uint64(20)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            run, bucket = run[order], bucket[order]
            cuts = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
            blobs = [b"".join([x[f].tobytes() for f in _RUN.names]) for x in np.split(run, cuts)]
            numbers = [int(x) for x in bucket[np.r_[0, cuts]]] if len(run) else []
            if len(gone):
                numbers.append(int(gone["anchor"][0] % np.uint64(buckets)))
                blobs.append(b"".join([gone[f].tobytes() for f in _RUN.names]))
            kinds = [False] * (len(numbers) - bool(len(gone))) + [True] * bool(len(gone))
            return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(kinds, pa.bool_()), pa.array(blobs[: len(numbers)], pa.binary())], ["bucket", "gone", "blob"])

        docs, raw, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                own = text.encode()
                if len(own) >= LENGTH:
                    docs.append(doc)
                    raw.append(own)
                    size += len(own)
                if size >= BATCH_BYTES:
                    yield emit(docs, raw)
                    docs, raw, size = [], [], 0
        if docs:
            yield emit(docs, raw)

    return firsts.select("doc_id", "text").mapInArrow(scan, "bucket int, gone boolean, blob binary")


def _unpacked(blob: bytes) -> np.ndarray:
    n = len(blob) // _RUN.itemsize
    out, at = np.zeros(n, _RUN), 0
    for f in _RUN.names:
        size = _RUN[f].itemsize * n
        out[f] = np.frombuffer(blob[at : at + size], _RUN[f])
        at += size
    return out


def _met(scanned: DataFrame, partitions: int) -> DataFrame:
    """Stretches that go (low null) and stretches that are asked for, with the key of what they share."""

    def shared(run: np.ndarray, side: str) -> np.ndarray:
        """Whether another stretch has the same anchor and the same continuation on that side."""
        order = np.lexsort((run[side], run["anchor"]))
        a, s = run["anchor"][order], run[side][order]
        same = np.r_[False, (a[1:] == a[:-1]) & (s[1:] == s[:-1])] if len(run) else np.empty(0, bool)
        both = same | np.r_[same[1:], False] if len(run) else same
        out = np.zeros(len(run), bool)
        out[order] = both & (s > 0)
        return out

    def removal(run):
        n, start = len(run), run["start"].astype(np.int64)
        empty = pa.nulls(n, pa.int64())
        return _batch([run["doc"], start, start + run["more"] + LENGTH, empty, empty, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32())])

    def asked(run, side, low, high):
        start, place = run["start"].astype(np.int64), run["place"].astype(np.int64)
        at, end = start + place, start + run["more"]
        first, last = np.maximum(start, at - high), np.minimum(end, at - low)
        key = (_mixed(run["anchor"] ^ (run[side].astype(np.uint64) << np.uint64(32 * (side == "right")))) >> np.uint64(1)).astype(np.int64)
        return _batch([run["doc"], first, last + LENGTH, key, at, np.full(len(run), low, np.int32), np.full(len(run), high, np.int32)])

    def meet(batches):
        now, held = None, []

        def flush():
            run, again = _firsts(np.concatenate(held))
            yield removal(run[again])
            run = run[~again]
            right, left = shared(run, "right"), shared(run, "left")
            yield asked(run[right], "right", 0, HALF)
            yield asked(run[left], "left", HALF + 1, SPAN - 1)

        for batch in batches:
            for bucket, gone, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "gone", "blob"))):
                if gone:
                    yield removal(_unpacked(blob))
                    continue
                if bucket != now:
                    if held:
                        yield from flush()
                    now, held = bucket, []
                held.append(_unpacked(blob))
        if held:
            yield from flush()

    return scanned.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, _FOUND)


_PIECE = "key long, doc long, start long, anchor_at long, low int, high int, piece binary"


def _pieces(firsts: DataFrame, asked: DataFrame) -> DataFrame:
    """The bytes that are asked for."""
    lists = asked.groupBy("doc").agg(F.collect_list(F.struct("start", "stop", "key", "anchor_at", "low", "high")).alias("asked")).withColumnRenamed("doc", "doc_id")

    def cut(batches):
        for batch in batches:
            rows = []
            for doc, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "asked"))):
                raw = text.encode()
                rows += [(w["key"], doc, w["start"], w["anchor_at"], w["low"], w["high"], raw[w["start"] : w["stop"]]) for w in wanted]
            yield _piece_batch(rows)

    return firsts.join(lists, "doc_id").select("doc_id", "text", "asked").mapInArrow(cut, _PIECE)


def _piece_batch(rows):
    kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds)], [x.split()[0] for x in _PIECE.split(", ")])


def _halves(pieces: DataFrame) -> DataFrame:
    """Each piece as two, dealt by the longer stretch that all strings of a half share."""

    def halve(batches):
        for batch in batches:
            rows = []
            for key, doc, start, at, low, high, piece in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)):
                middle = (low + high) // 2
                for lo, hi in ((low, middle), (middle + 1, high)):
                    first, last = max(start, at - hi), min(start + len(piece) - LENGTH, at - lo)
                    if lo <= hi and first <= last:
                        shared = piece[at - lo - start : at - hi + LENGTH - start]
                        code = hashlib.blake2b(shared, digest_size=8, key=key.to_bytes(8, "little") + bytes([lo, hi])).digest()
                        rows.append((int.from_bytes(code, "little") >> 1, doc, first, at, lo, hi, piece[first - start : last + LENGTH - start]))
            yield _piece_batch(rows)

    return pieces.mapInArrow(halve, _PIECE)


def removed_windows(docs: np.ndarray, starts: np.ndarray, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of strings of LENGTH bytes in the pieces that came earlier in another place, or in the same document before."""
    t = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces])
    word = words_at(t)
    sa = suffix_array(t, LENGTH, word)
    offset = np.arange(len(t)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    owner = np.repeat(np.arange(len(pieces)), sizes)
    sa = sa[offset[sa] <= sizes[owner[sa]] - LENGTH]
    group = np.cumsum(~shared_prefixes(sa, word, LENGTH))
    doc, start = docs[owner[sa]], starts[owner[sa]] + offset[sa]
    order = np.lexsort((start, doc, group))
    group, doc, start = group[order], doc[order], start[order]
    head = np.r_[True, group[1:] != group[:-1]]
    lead = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
    gone = (doc != doc[lead]) | (start != start[lead])  # a string asked for twice is no copy of itself
    return doc[gone], start[gone]


def _joined(doc, start):
    """Spans of removed strings, those that touch as one."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    head = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + LENGTH)]) if len(doc) else np.empty(0, int)
    tail = np.r_[head[1:], len(doc)] - 1 if len(doc) else head
    return pa.RecordBatch.from_arrays([pa.array(doc[head], pa.int64()), pa.array(start[head], pa.int64()), pa.array(start[tail] + LENGTH, pa.int64())], ["doc", "start", "stop"])


def _sorted_blocks(pieces: DataFrame) -> DataFrame:
    def sort(batches):
        now, held, size = None, [], 0

        def flush():
            return _joined(*removed_windows(np.array([h[0] for h in held]), np.array([h[1] for h in held]), [h[2] for h in held]))

        for batch in batches:
            for key, doc, start, piece in zip(*(batch.column(c).to_pylist() for c in ("key", "doc", "start", "piece"))):
                if key != now and size >= BLOCK_BYTES:
                    yield flush()
                    held, size = [], 0
                now = key
                held.append((doc, start, piece))
                size += len(piece)
        if held:
            yield flush()

    return pieces.repartition("key").sortWithinPartitions("key").mapInArrow(sort, "doc long, start long, stop long")


def _resolved(pieces: DataFrame) -> DataFrame:
    """Spans that go, from all pieces; keys with many pieces are halved first, as often as need be."""
    out = []
    while True:
        size = pieces.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        hot = written(size.where(F.col("n") > MOST_OF_A_KEY), "hot")
        if hot.isEmpty():
            return _union([*out, _sorted_blocks(pieces.join(size, "key", "left_semi"))])
        out.append(_sorted_blocks(pieces.join(size.where(F.col("n") <= MOST_OF_A_KEY), "key", "left_semi")))
        many = pieces.join(hot, "key", "left_semi")
        single = many.where("low = high")
        # a single string is its piece: these are equal byte by byte
        first = single.groupBy("key", "piece").agg(F.min(F.struct("doc", "start")).alias("first"))
        out.append(single.join(first, ["key", "piece"]).where(F.struct("doc", "start") != F.col("first")).select("doc", "start", (F.col("start") + LENGTH).alias("stop")))
        pieces = written(_halves(many.where("low < high")), "halves")


def _union(frames):
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.union(f)
    return whole


def _kept(firsts: DataFrame, spans: DataFrame) -> DataFrame:
    """Per document what is left, from the union of its spans."""
    lists = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("spans")).withColumnRenamed("doc", "doc_id")

    def finish(batches):
        for batch in batches:
            removed, pieces, hashes, sizes = [], [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans")):
                raw, kept, at, count, gone = text.encode(), hashlib.sha256(), 0, 0, 0
                flat = spans.values if spans.is_valid else None
                if flat is not None:
                    start, stop = flat.field("start").to_numpy(), flat.field("stop").to_numpy()
                    order = np.argsort(start, kind="stable")
                    start, stop = start[order], np.maximum.accumulate(stop[order])
                    head = np.flatnonzero(np.r_[True, start[1:] > stop[:-1]])
                    for a, b in zip(start[head].tolist(), stop[np.r_[head[1:], len(stop)] - 1].tolist()):
                        kept.update(raw[at:a])
                        gone, count, at = gone + b - a, count + 1, b
                kept.update(raw[at:])
                removed.append(gone)
                pieces.append(count)
                hashes.append(kept.hexdigest())
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, removed, pieces)), pa.array(hashes, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return firsts.join(lists, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


@contextlib.contextmanager
def _by_document(df: DataFrame, buckets: int):
    """df, which is dealt to so many partitions by doc_id, as a table in the shared folder, bucketed alike: joins on it move the other side alone.

    The catalog forgets the table afterwards.
    """
    spark, name = df.sparkSession, f"suffix_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, "doc_id").sortBy("doc_id").option("path", f"{shared_folder(spark)}/{name}").format("parquet").saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def substring_dedup(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each document."""
    # Texts, runs and stretches are moved one after the other; what a step has moved is written, so that its shuffles need not wait for the last step.
    with shuffles_dropped(documents.sparkSession):
        return _deduplicated(documents)


def _deduplicated(documents: DataFrame) -> DataFrame:
    own = texts(documents).withColumn("h", F.sha2("text", 256))
    ids = own.select("doc_id", "h", F.octet_length("text").cast("long").alias("n_bytes"))
    known = ids.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("h", "n_bytes")).alias("x")).select("doc_id", "x.*")
    known = written(known, "known")
    copies = known.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    total, most = copies.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    known = written(with_group_facts(known, copies, "h", total, most), "known")
    size = known.where("doc_id = first").agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    partitions = max(tasks(documents.sparkSession), -(-size // MEET_BYTES))
    chosen = known.where("doc_id = first").select("doc_id", F.col("h").alias("own_h"))
    # The hashes are compared by an expression that the join does not take for a key: texts are dealt by doc_id once.
    same = F.when(F.col("h") == F.col("own_h"), True)
    firsts = own.repartition(partitions, "doc_id").join(chosen, "doc_id").where(same).select("doc_id", "text").dropDuplicates(["doc_id"])
    short = F.col("n_bytes") < LENGTH
    rest = known.where("doc_id <> first").select("doc_id", "n_bytes", F.when(short, 0).otherwise(F.col("n_bytes")).alias("n_removed"), F.when(short, 0).otherwise(1).cast("long").alias("n_spans"), F.when(short, F.col("h")).otherwise(F.sha2(F.lit(""), 256)).alias("kept_sha256"))
    nameless = ids.where("doc_id is null").select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("h").alias("kept_sha256"))
    with _by_document(firsts, partitions) as firsts:
        met = written(_met(_scanned(firsts, BUCKETS_A_TASK * partitions), partitions), "met")
        pieces = written(_pieces(firsts, met.where("low is not null")), "pieces")
        spans = met.where("low is null").select("doc", "start", "stop").union(_resolved(pieces))
        kept = written(_kept(firsts, spans), "kept")
    return kept.union(rest).union(nameless)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))
