import hashlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from factloom.llm import bpe, decontamination, near_dedup, quality, secrets
from factloom.llm.queries import ORACLES, QUERIES

from ..oracle import differences

SF = "/root/testdata/sf0.001"


def test_stages_do_what_their_operators_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    good = {r["doc_id"] for r in quality.quality_scores(docs, labels).where("predicted = 1").collect()}
    one = corpus_pipeline.quality(spark, docs, SF)
    assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} == good
    two = corpus_pipeline.near_dedup(spark, one, SF)
    three = corpus_pipeline.decontamination(spark, two, SF)
    assert decontamination.contamination(three, bench).where("contaminated").count() == 0
    four = corpus_pipeline.secrets(spark, three, SF)
    assert not any(secrets.base_spans(r["text"]) for r in four.collect()) and four.columns == docs.columns
    five = corpus_pipeline.packing(spark, four, SF)
    assert {r["doc_id"] for r in five.select("doc_id").distinct().collect()} == {r["doc_id"] for r in four.collect()}
    whole = corpus_pipeline.run(spark, SF)
    key = lambda f: hashlib.sha256(str(sorted(tuple(r) for r in f.select("doc_id", "start", "length", "ids_crc32").collect())).encode()).hexdigest()
    assert whole.count() > 0 and whole.select("doc_id").distinct().count() == five.select("doc_id").distinct().count()
    assert key(whole.where("length = 1024")) == key(five.where("length = 1024"))


def test_registered(spark):
    assert {f"op{n}" for n in range(1, 11)} == {x.split("_")[0] for x in QUERIES}
    assert set(QUERIES) <= set(__spark_entry__.queries()) and "pipeline" in __spark_entry__.queries()


def test_oracles(spark):
    for name, sql in ORACLES.items():
        assert differences(QUERIES[name](spark, SF), sql, SF) is None, name


def test_near_dedup_stage_takes_five_words_and_80_per_cent(spark):
    """A copy with 22 per cent appended, one with 18 per cent cut off, and one just below the measure."""
    words = [f"w{i}" for i in range(1000)]
    texts = {1: words, 2: words + [f"n{i}" for i in range(220)], 3: [f"a{w}" for w in words], 4: [f"a{w}" for w in words[:820]], 5: [f"b{w}" for w in words], 6: [f"b{w}" for w in words] + [f"m{i}" for i in range(260)]}
    docs = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == {1, 3, 5, 6}


def test_corpus_measure_keeps_the_guarantee():
    r, m = np.random.default_rng(4), near_dedup.CORPUS
    mean = m.symbols * (1 - m.per_cent / 100)
    assert m.most_errors >= mean + 6 * (mean * m.per_cent / 100) ** 0.5
    sig = r.integers(0, 1 << 16, (200, m.symbols)).astype(np.uint64)
    other = sig.copy()
    for row in other:
        row[r.choice(m.symbols, m.most_errors, replace=False)] ^= np.uint64(1)
    assert (near_dedup.chunk_keys(sig, m) == near_dedup.chunk_keys(other, m)).any(1).all()


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, keys string, bin long, _row string, figures double, curve long"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables with nulls in every column, empty, repeated and very long texts, ties, and extra columns with the operators' own names."""
    d, word = str(tmp_path_factory.mktemp("odd")), lambda k: f"word{k % 977}x{k // 977}"
    prose = lambda a, n: " ".join(word(k) for k in range(a, a + n))
    items = [("b1", prose(50_000, 30)), ("b2", None), (None, prose(60_000, 12))]
    texts = {1: prose(0, 300), 2: prose(0, 300), 3: prose(0, 290), 4: None, 5: "", 6: prose(1000, 40_000), 7: prose(50_000, 30), 8: f"{prose(2000, 80)} {prose(50_005, 20)} {prose(2100, 80)}", 9: f'{prose(3000, 60)} password = "hunter2hunter2" {prose(3100, 60)}', 10: "x"}
    rows = [(k, t, "en", None, None if t is None else len(t), "k", 1, None, 0.5, None) for k, t in texts.items()]
    rows += [rows[0], rows[4], (None, texts[1], None, None, None, None, None, None, None, None), (None,) * 10]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows, items


def near_copies(a, b):
    sets = []
    for text in (a, b):
        w = (text or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return bool(sets[0] & sets[1]) and 100 * len(sets[0] & sets[1]) >= 80 * len(sets[0] | sets[1])


def test_stages_on_odd_rows(spark, odd):
    d, rows, items = odd
    docs = spark.read.parquet(f"{d}/documents.parquet")
    one = corpus_pipeline.quality(spark, docs, d)  # no positives: all are accepted
    assert sorted(map(str, one.collect())) == sorted(map(str, docs.collect()))
    two = corpus_pipeline.near_dedup(spark, one, d)
    named = {r[0]: r[1] for r in rows if r[0] is not None}
    kept = [k for k in sorted(named) if not any(near_copies(named[k], named[j]) for j in named if j < k)]
    assert kept == [1, 4, 5, 6, 7, 8, 9, 10] and sorted(r["doc_id"] for r in two.collect() if r["doc_id"] is not None) == kept
    assert two.columns == docs.columns and two.where("doc_id is null").count() == 2
    held = decontamination.Automaton([(k or "null", t) for k, t in items])
    three = corpus_pipeline.decontamination(spark, two, d).collect()
    assert {r["doc_id"] for r in three} == {*kept, None} - {7}
    assert all(held.match(r["text"] or "")[1] is None for r in three)
    eight = next(r for r in three if r["doc_id"] == 8)
    assert eight["text"].split() == [w for w in named[8].split() if w not in items[0][1].split()] and eight["n_chars"] == len(eight["text"])
    third = spark.createDataFrame(three, COLUMNS)
    four = corpus_pipeline.secrets(spark, third, d).collect()
    assert [(r["doc_id"], r["text"]) for r in four] == [(r["doc_id"], None if r["text"] is None else secrets.redacted(r["text"])) for r in three]
    assert secrets.REDACTED in next(r for r in four if r["doc_id"] == 9)["text"]
    pieces = corpus_pipeline.packing(spark, spark.createDataFrame(four, COLUMNS), d).toPandas()
    tok = Tokenizer.from_file(bpe.vocabulary_path())
    assert pieces.length.sum() == sum(len(tok.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in four)
    assert corpus_pipeline.run(spark, d).count() == len(pieces)


def test_pipeline_of_empty_tables(spark, odd, tmp_path):
    d = odd[0]
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{d}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
