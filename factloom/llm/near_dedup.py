"""MinHash near-dedup by a multi-index Hamming join.

Equal shingle sets, copies too, collapse to their smallest doc_id first. Each distinct set has a
signature of `SYMBOLS` b-bit minima. Two sets of similarity s differ in about (1 - s) of the symbols; the
join finds every pair that differs in at most `MOST_ERRORS` of them: the signature is split into chunks,
of which by pigeonhole one at least has no more than one error, and each chunk is listed with each of its
symbols left out. MOST_ERRORS lies over six standard deviations above the mean at the least similarity.
A `Measure` holds what belongs together: words a shingle, least similarity, symbols and errors.

Sets that share a key are candidates, whose signatures are compared before anything else: a bucket's members with
its smallest one, and those too far from it with all others of the bucket, in blocks. Pairs within the distance
make families (a spanning forest of them for each bucket, linear in its size), so that boilerplate, which lets
many signatures share a key or two, does not chain a corpus together.
Families are dealt in blocks of bounded size; within a block, and between blocks of which the members
are not yet known to be connected, all pairs are compared on their full shingle sets, and only a spanning
forest of the links leaves the task. A hot group thus costs several tasks, never one, and no pair is emitted
that adds nothing to the components.

Null or empty text, or one without words: an empty set, linked with nothing. Null doc_id: left out of all
groups, kept with a null component. Repeated rows: one result each; rows that share a doc_id are one
document, which links as any of its texts does. Ties at the least similarity: links. Very long texts: whole. Other
columns, whatever their names, are not read, and kept as they are by `first_of_each`. Empty table: no rows.
"""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators.components import components, with_group_facts

from .common import lean, table, texts, written

SHINGLE, PER_CENT = 3, 85
SYMBOLS, MOST_ERRORS = 64, 27
BLOCK_DOCUMENTS, BLOCK_SHINGLES = 4096, 4_000_000
#: Signatures of a bucket that one task compares with as many others.
BLOCK_SIGNATURES = 4096

_WORD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Measure:
    """Near-duplicates share at least per_cent of their shingles; signatures that differ in at most most_errors symbols meet."""

    shingle: int = SHINGLE
    per_cent: int = PER_CENT
    symbols: int = SYMBOLS
    most_errors: int = MOST_ERRORS

    @functools.cached_property
    def constants(self) -> tuple[np.ndarray, np.ndarray]:
        random = np.random.default_rng(11)
        odd = random.integers(1, 1 << 63, self.symbols, dtype=np.uint64) | np.uint64(1)
        return odd, random.integers(0, 1 << 63, self.symbols, dtype=np.uint64)

    @functools.cached_property
    def masks(self) -> list[tuple[int, list[int]]]:
        """(chunk, positions that stay) for each chunk and each of its symbols that may be wrong."""
        # one of so many chunks has one error at most
        chunks = np.array_split(np.arange(self.symbols), (self.most_errors + 2) // 2)
        return [(k, [int(x) for x in chunk if x != out]) for k, chunk in enumerate(chunks) for out in chunk]


OP8 = Measure()
#: For a corpus without a contract of its own. 80 symbols, as at 64 the keys for 32 errors would have two symbols only.
CORPUS = Measure(shingle=5, per_cent=80, symbols=80, most_errors=38)


class Shingler:
    """Sorted 64-bit hashes of a text's distinct word shingles; words are hashed once each for a while."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.known = size, {}

    def __call__(self, text: str) -> np.ndarray:
        own = text.encode().lower().split()
        if not own:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > 500_000:
            known.clear()
        for w in own:
            if w not in known:
                known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        ids = np.array([known[w] for w in own], np.uint64)
        size = min(self.size, len(ids))
        code = np.full(len(ids) - size + 1, size if len(ids) < self.size else 0, np.uint64)
        for j in range(size):
            code = _mixed(code * _WORD + ids[j : len(ids) - size + 1 + j])
        return np.unique(code)


def signature(shingles: np.ndarray, at_once: int = 1 << 16, measure: Measure = OP8) -> np.ndarray:
    """Minima of 16 bits; blocks of a very long set are taken one after the other."""
    odd, add = measure.constants
    low = np.full(measure.symbols, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), at_once):
        part = shingles[k : k + at_once]
        for j in range(measure.symbols):
            low[j] = min(low[j], ((part * odd[j]) ^ ((part + add[j]) >> np.uint64(29))).min())
    return (_mixed(low) & np.uint64(0xFFFF)).astype(np.uint64)


def chunk_keys(sig: np.ndarray, measure: Measure = OP8) -> np.ndarray:
    """A 63-bit key for each chunk and allowed error, for signatures in rows."""
    out = np.empty((len(sig), len(measure.masks)), np.uint64)
    for m, (_, stay) in enumerate(measure.masks):
        code = np.full(len(sig), m + 1, np.uint64)
        for p in stay:
            code = _mixed(code * _WORD + sig[:, p])
        out[:, m] = code
    return (out >> np.uint64(1)).astype(np.int64)


def _signed(documents: DataFrame, measure: Measure) -> DataFrame:
    """Per row: doc, number of shingles, a hash of the set, the signature, and the keys."""

    def sign(batches):
        of = Shingler(measure.shingle)
        for batch in batches:
            sets = [of(x) for x in batch.column("text").to_pylist()]
            signatures = np.array([signature(s, measure=measure) for s in sets]).reshape(len(sets), measure.symbols)
            keys = chunk_keys(signatures, measure)
            columns = [batch.column("doc_id"), pa.array(map(len, sets), pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())]
            columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel())))
            columns.append(pa.array([x.tobytes() for x in signatures.astype("<u2")], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["doc", "n_shingles", "set_hash", "keys", "signature"])

    return texts(documents).mapInArrow(lean(sign), "doc long, n_shingles long, set_hash binary, keys array<long>, signature binary")


class _Forest:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def linked(docs: list[int], sets: list[np.ndarray], groups: list[int], per_cent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between all members; those of equal group are known to be connected."""
    sizes = np.array([len(s) for s in sets])
    code = np.unique(np.concatenate(sets), return_inverse=True)[1] if sizes.sum() else np.empty(0, np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(docs)), sizes)
    holders = owner[np.argsort(code, kind="stable")]  # members by shingle, in order
    until = np.cumsum(np.bincount(code)) if len(code) else np.empty(0, np.int64)
    begin = until - np.diff(np.r_[0, until])
    forest, first = _Forest(len(docs)), {}
    for i, g in enumerate(groups):
        forest.join(first.setdefault(g, i), i)
    parts, out = len({forest.find(i) for i in range(len(docs))}), []
    for i in range(len(docs)):
        if not sizes[i]:
            continue
        if parts == 1:
            break
        own = code[ends[i] - sizes[i] : ends[i]]
        many = until[own] - begin[own]
        place = np.repeat(begin[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        shared = np.bincount(holders[place], minlength=len(docs))[i + 1 :]
        for j in np.flatnonzero((100 * shared >= per_cent * (sizes[i] + sizes[i + 1 :] - shared)) & (shared > 0)) + i + 1:
            if forest.join(i, int(j)):
                parts -= 1
                out.append((docs[i], docs[int(j)]))
    return out


def _compared(dealt: DataFrame, measure: Measure) -> DataFrame:
    """Links within each bin; a bin's rows come together and in order."""

    def compare(batches):
        of, now, members = Shingler(measure.shingle), None, []

        def flush():
            found = linked([m[0] for m in members], [m[1] for m in members], [m[2] for m in members], measure.per_cent) if len(members) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*found) if found else [(), ()])], ["src", "dst"])

        for batch in batches:
            for bin_, doc, group, text in zip(*(batch.column(c).to_pylist() for c in ("bin", "doc", "group", "text"))):
                if bin_ != now:
                    if members:
                        yield flush()
                    now, members = bin_, []
                members.append((doc, of(text), group))
        if members:
            yield flush()

    parts = dealt.repartition("bin").sortWithinPartitions("bin", "doc")
    return parts.select("bin", "doc", "group", "text").mapInArrow(lean(compare), "src long, dst long")


def _blocks(members: DataFrame) -> DataFrame:
    """members with a block: so many of a family, in order, that neither documents nor shingles pass the limits."""
    # The running sums go by slices of a large family, so that no task orders a whole one.
    slices = members.withColumn("slice", F.expr(f"pmod(xxhash64(doc), greatest(1, members div {16 * BLOCK_DOCUMENTS}))"))
    order = Window.partitionBy("family", "slice").orderBy("group", "doc").rowsBetween(Window.unboundedPreceding, -1)
    place = F.coalesce(F.sum(F.lit(1.0 / BLOCK_DOCUMENTS) + F.col("n_shingles") / BLOCK_SHINGLES).over(order), F.lit(0.0))
    return slices.withColumn("block", F.struct("slice", place.cast("long").alias("k"))).drop("slice")


def _unpacked(column, measure: Measure) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, measure.symbols)


def _distances(pairs: DataFrame, measure: Measure) -> DataFrame:
    """(src, dst, near) of pairs with both signatures."""

    def measured(batches):
        for batch in batches:
            errors = (_unpacked(batch.column("x"), measure) != _unpacked(batch.column("y"), measure)).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("src"), batch.column("dst"), pa.array(errors <= measure.most_errors)], ["src", "dst", "near"])

    return pairs.select("src", "dst", "x", "y").mapInArrow(lean(measured), "src long, dst long, near boolean")


def near_signatures(docs: np.ndarray, signatures: np.ndarray, far: np.ndarray, second: np.ndarray, most_errors: int) -> list[tuple[int, int]]:
    """A forest of the pairs that differ in at most so many symbols, one of each pair being far from its bucket's smallest.

    Where second marks some of them, pairs are of one that it marks and one that it does not.
    """
    forest, out = _Forest(len(docs)), []
    split = second.any() and not second.all()
    rows = np.flatnonzero(far)
    for k in range(0, len(rows), 64):
        part = rows[k : k + 64]
        near = (signatures[part][:, None, :] != signatures[None, :, :]).sum(2) <= most_errors
        if split:
            near &= second[part][:, None] != second[None, :]
        for i, j in zip(*np.nonzero(near)):
            if part[i] != j and forest.join(int(part[i]), int(j)):
                out.append((int(docs[part[i]]), int(docs[j])))
    return out


def _met(dealt: DataFrame, measure: Measure) -> DataFrame:
    """Near pairs of each bin (bucket, i, j): of block i with itself or with block j."""

    def meet(batches):
        now, held = None, []

        def flush():
            docs, far, second, signatures = (np.concatenate(x) for x in zip(*held))
            found = near_signatures(docs, signatures, far, second, measure.most_errors)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*found) if found else [(), ()])], ["src", "dst"])

        for batch in batches:
            if not batch.num_rows:
                continue
            bins, docs, far, second = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bin", "doc", "far", "second"))
            signatures = _unpacked(batch.column("signature"), measure)
            edges = [0, *(np.flatnonzero(bins[1:] != bins[:-1]) + 1).tolist(), len(bins)]
            for a, b in zip(edges, edges[1:]):
                if bins[a] != now:
                    if held:
                        yield flush()
                    now, held = bins[a], []
                held.append((docs[a:b], far[a:b], second[a:b], signatures[a:b]))
        if held:
            yield flush()

    parts = dealt.repartition("bin").sortWithinPartitions("bin")
    return parts.select("bin", "doc", "far", "second", "signature").mapInArrow(lean(meet), "src long, dst long")


def candidates(signed: DataFrame, measure: Measure) -> DataFrame:
    """(src, dst): pairs within the signature distance that connect whatever such pairs connect; signed has doc, keys and signature."""
    keys = signed.select("doc", F.explode("keys").alias("key"))
    members = [F.bit_xor(F.xxhash64("doc", F.lit(salt))).alias(f"of{salt}") for salt in (1, 2)]
    buckets = keys.groupBy("key").agg(F.min("doc").alias("least"), F.count("*").alias("n"), *members).where("n > 1")
    # Near copies share many keys: of buckets with the same members (by 128 bits) one is enough.
    buckets = buckets.groupBy("least", "n", "of1", "of2").agg(F.min("key").alias("key")).select("key", "least", "n")
    stars = written(keys.join(buckets, "key").where("doc <> least"), "stars")
    signature = signed.select("doc", "signature")
    pairs = stars.select(F.col("doc").alias("src"), F.col("least").alias("dst")).distinct()
    pairs = pairs.join(signature.select(F.col("doc").alias("src"), F.col("signature").alias("x")), "src").join(signature.select(F.col("doc").alias("dst"), F.col("signature").alias("y")), "dst")
    measured = written(_distances(pairs, measure), "distances")
    near, far = (measured.where(c).select("src", "dst") for c in ("near", "not near"))
    # Buckets of three or more with a member that is far from the smallest: whatever else is near in them.
    marked = stars.where("n > 2").join(far.select(F.col("src").alias("doc"), F.col("dst").alias("least"), F.lit(True).alias("far")), ["doc", "least"], "left")
    marked = marked.withColumn("far", F.coalesce("far", F.lit(False)))
    open_ = marked.groupBy("key").agg(F.bool_or("far").alias("open")).where("open").select("key")
    marked = marked.join(open_, "key", "left_semi").withColumn("blocks", F.ceil(F.col("n") / BLOCK_SIGNATURES).cast("int"))
    marked = marked.withColumn("own", F.pmod(F.xxhash64("doc", F.lit(3)), F.col("blocks")).cast("int"))
    dealt = marked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    dealt = dealt.select("doc", "far", F.xxhash64("key", low, high).alias("bin"), (F.col("own") > F.col("other")).alias("second"))
    return near.union(_met(dealt.join(signature, "doc"), measure))


def links(text: DataFrame, signed: DataFrame, measure: Measure) -> DataFrame:
    """(src, dst): links that connect whatever pairs of at least the measure's similarity connect, among distinct sets; text has doc and text."""
    family = components(candidates(signed, measure), written)
    members = family.select(F.col("node").alias("doc"), F.col("component").alias("family")).join(signed.select("doc", "n_shingles"), "doc")
    members = written(members.join(members.groupBy("family").agg(F.count("*").alias("members")), "family"), "families")
    blocks = written(_blocks(members.withColumn("group", F.col("doc"))), "blocks")
    own = blocks.select(F.xxhash64("family", "block").alias("bin"), "doc", "group", "family", F.lit(False).alias("pivot"))
    # Every block also holds its family's smallest member, which connects most blocks at once.
    pivots = blocks.groupBy("family", "block").agg(F.min("doc").alias("low")).where("low <> family").select(F.xxhash64("family", "block").alias("bin"), F.col("family").alias("doc"), F.col("family").alias("group"), "family", F.lit(True).alias("pivot"))
    # Written, so that the second round moves texts of the families it is about and not the corpus again.
    held = written(own.union(pivots).join(text, "doc"), "held")
    found = written(_compared(held, measure), "links")
    split = blocks.select("family", "block").distinct().groupBy("family").agg(F.count("*").alias("b")).where("b > 1").select("family")
    if split.isEmpty():
        return found
    # Families of several blocks: whatever pairs of blocks still hold two groups that may link.
    labels = components(found, written)
    rest = members.join(split, "family").join(labels.withColumnRenamed("node", "doc"), "doc", "left")
    rest = rest.withColumn("group", F.coalesce("component", "doc")).drop("component")
    many = rest.groupBy("family").agg(F.min("group").alias("a"), F.max("group").alias("b")).where("a < b").select("family")
    again = written(_blocks(rest.join(many, "family")), "blocks")
    ranges = again.groupBy("family", "block").agg(F.min("group").alias("low"), F.max("group").alias("high"))
    pair = ranges.alias("x").join(ranges.alias("y"), F.expr("x.family = y.family and (x.block < y.block or x.block = y.block and x.low < x.high) and not (x.low = x.high and y.low = y.high and x.low = y.low)"))
    pair = pair.select(F.col("x.family").alias("family"), F.explode(F.array_distinct(F.array("x.block", "y.block"))).alias("block"), F.xxhash64("x.family", "x.block", "y.block").alias("bin"))
    dealt = pair.join(again, ["family", "block"]).select("bin", "doc", "group")
    left = held.where("not pivot").join(again.select("family").distinct(), "family", "left_semi").select("doc", "text").hint("merge")
    return written(found.union(_compared(dealt.join(left, "doc"), measure)), "links")


def near_duplicates(documents: DataFrame, measure: Measure = OP8) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of documents."""
    signed = written(_signed(documents, measure), "signed")
    known = signed.where("n_shingles > 0 and doc is not null")
    same = written(known.groupBy("set_hash").agg(F.min("doc").alias("rep"), F.count("*").alias("n")), "same")
    firsts = known.join(same.select("set_hash", F.col("rep").alias("doc")), ["doc", "set_hash"], "left_semi").dropDuplicates(["doc", "set_hash"])
    # The same join at every size: a small corpus must not hide what a large one has to move.
    text = texts(documents).where("doc_id is not null").withColumnRenamed("doc_id", "doc").hint("merge")
    total, most = same.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    found = links(text, firsts, measure)
    # Copies do not go through the rounds: a set's first has its label. Only documents of several sets connect these.
    several = written(known.groupBy("doc").agg(F.min("set_hash").alias("x"), F.max("set_hash").alias("y")).where("x <> y").select("doc"), "several")
    if not several.isEmpty():
        sets = with_group_facts(known.join(several, "doc", "left_semi").select("doc", "set_hash"), same, "set_hash", total, most)
        found = found.union(sets.select(F.col("doc").alias("src"), F.col("rep").alias("dst")).where("src <> dst"))
    labels = components(found, written)
    placed = same.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("set_hash", F.coalesce("component", "rep").alias("component"), "n")
    labels = with_group_facts(known.select("doc", "set_hash"), written(placed, "placed"), "set_hash", total, most).where("doc <> component").select("doc", "component").distinct()
    out = signed.select(F.col("doc").alias("doc_id"), "n_shingles").join(labels.withColumnRenamed("doc", "doc_id"), "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def first_of_each(documents: DataFrame, measure: Measure = OP8) -> DataFrame:
    """The rows of documents that are the smallest of their group; rows without an id stay.

    Rows that share a doc_id stay or go together; of those whose texts are equal too one stays, the smallest by a hash of
    all columns (but maps, which have none).
    """
    kept = near_duplicates(documents, measure).where("kept and doc_id is not null").select(F.col("doc_id").alias("_kept_id"))
    hashed = [c for c, kind in documents.dtypes if "map<" not in kind]
    own = documents.where("doc_id is not null").withColumn("_row", F.xxhash64(*[F.col(f"`{c}`") for c in hashed]))
    rows = own.groupBy("doc_id", F.xxhash64("text").alias("_text")).agg(F.min("_row").alias("_kept_row"))
    rows = rows.join(kept, F.col("doc_id") == F.col("_kept_id"), "left_semi").select(F.col("doc_id").alias("_kept_id"), "_kept_row").hint("merge")
    ided = own.join(rows, (F.col("doc_id") == F.col("_kept_id")) & (F.col("_row") == F.col("_kept_row")), "left_semi").dropDuplicates(["doc_id", "_row"])
    columns = [F.col(f"`{c}`") for c in documents.columns]
    return ided.select(*columns).union(documents.where("doc_id is null").select(*columns))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS g FROM w),
n AS (SELECT doc_id, len(g)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.c = l.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id, n.doc_id = min(r.c) AS kept FROM n JOIN r USING (doc_id) GROUP BY n.doc_id, n.n
"""
