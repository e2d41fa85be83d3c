"""Importance resampling, late arrivals and BPE with word ends against brute force, over odd rows and empty tables."""

import glob
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from datetime import datetime, timedelta

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from factloom.llm import importance, late_arrivals
from factloom.llm.decontamination import Automaton
from factloom.llm.word_bpe import VOCABULARY, coder, decoded, encoded, encoding_digests
from tests.oracle import differences

from .late import expected
from .test_operators import SF, TEXTS, documents, nothing  # noqa: F401

PATH = public_tokenizers.path(VOCABULARY)


def words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def resampled_by_brute_force(rows, target, percent, least, buckets, most):
    runs = lambda text: [b" ".join(w[i : i + n]) for w in [words(text)] for n in range(1, most + 1) for i in range(len(w) - n + 1)]
    bucket = lambda f: zlib.crc32(f) % buckets
    s, t = Counter(bucket(f) for _, x in rows for f in runs(x)), Counter(bucket(f) for x in target for f in runs(x))
    ss, tt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in s}
    out = []
    for doc, text in rows:
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in runs(text))
        out.append((doc, len(runs(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= least))
    drawn = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    drawn = drawn[: percent * len(drawn) // 100]
    ranks = Counter((x[:4], k) for k, x in enumerate(drawn, 1))
    return Counter(x[:4] for x in out), ranks


@pytest.mark.parametrize("most,buckets,percent", [(1, 10_000, 40), (2, 7, 100), (1, 65_536, 0)])
def test_resampling(spark, documents, nothing, monkeypatch, most, buckets, percent):  # noqa: F811
    monkeypatch.setattr(importance, "STREAM", 50)  # many streams, and one document over it
    target = spark.createDataFrame([("the of the and", 1), (None, 2), ("word x", 3)], "text string, doc_id int")
    found = importance.resampled(documents, target, percent, 2, 2024, buckets, most).collect()
    rows, ranks = resampled_by_brute_force([(r["doc_id"], r["text"]) for r in documents.collect()], ["the of the and", None, "word x"], percent, 2, buckets, most)
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in found) == rows
    drawn = [r for r in found if r["rank"] is not None]
    assert sorted(r["rank"] for r in drawn) == list(range(1, len(ranks) + 1))
    # rows that tie in score and id may stand in either order
    assert sorted((r["score"], r["rank"]) for r in drawn) == sorted((x[3], k) for x, k in ranks)
    assert importance.resampled(nothing, target).count() == 0
    assert importance.resampled(documents, target.limit(0)).count() == documents.count()


def test_resampling_says_what_sql_says(spark):
    assert differences(importance.op11_importance_resampling(spark, SF), importance.SQL, SF) is None


def digest_rows(frame):
    return {(r.day, r.file_no): (r.n_rows, r.cents, r.rows_crc, r.columns, r.ids_sha256, r.rewritten) for r in frame.collect()}


@pytest.mark.parametrize("odd", [False, True])
def test_late_arrivals(spark, tmp_path, odd):
    sales = spark.read.parquet(f"{SF}/sales.parquet")
    if odd:  # nulls everywhere, one sale of a third of the rows, one time for all, extra columns
        t = datetime(2024, 3, 1)
        rows = [(k if k % 3 else 7, 1, None, None if k % 5 == 0 else k / 7, None if k % 4 == 0 else t + timedelta(days=k % 2), t + timedelta(days=k % 40, seconds=k), None, "x", k) for k in range(600)]
        rows += [(None, None, None, None, None, t, None, None, None), (None, 2, None, 1.0, t, t + timedelta(days=1), 3, "y", None), (5000, 1, "done", 2.0, t, None, 1, "z", 1)]
        sales = spark.createDataFrame(rows, "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int, day string, file_no long")
    sales.coalesce(2).write.parquet(str(tmp_path / "sales.parquet"))
    found = late_arrivals.op12_late_arrivals(spark, str(tmp_path))
    assert digest_rows(found) == expected(sales.select(late_arrivals_columns()).collect())
    paths = [r.path.removeprefix("file:").replace("///", "/") for r in found.collect()]
    assert sorted(glob.glob(paths[0].split("/day=")[0] + "/**/*.parquet", recursive=True)) == sorted(paths)


def late_arrivals_columns():
    return ["sale_id", "client_id", "status", "total", "sold_at", "arrived_at", "priority"]


def test_late_arrivals_leave_other_files_alone(spark, tmp_path):
    t = datetime(2024, 3, 1)
    kind = "sale_id long, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz"
    rows = spark.createDataFrame([(k, 1.0, t + timedelta(days=k % 5), t) for k in range(50)], kind)
    layout = late_arrivals.DayLayout(spark, str(tmp_path / "days"), rows.schema, 4)
    layout.start(rows)
    read = lambda: {k: open(p.removeprefix("file:").replace("///", "/"), "rb").read() for k, p in layout.files().items()}
    before, first = read(), (t - datetime(1970, 1, 1)).days
    late = spark.createDataFrame([(0, 2.0, t + timedelta(days=1), t + timedelta(days=9)), (2, 9.0, t, t - timedelta(days=1)), (99, 3.0, t + timedelta(days=30), t), (4, 5.0, t + timedelta(days=4), None)], kind)
    assert layout.take_in(late) == [first, first + 1, first + 30]  # 2 is beaten by what stands, and so is a row without arrival
    after = read()
    assert {k for k in before if k[0] not in (first, first + 1)} == {k for k in before if after.get(k) == before[k]}
    assert layout.read().count() == 51 and layout.read().where("sale_id = 0").first()["total"] == 2.0
    # a day that loses all its rows loses its folder
    gone = spark.createDataFrame([(k, 1.0, t, t + timedelta(days=10)) for k in range(2, 50, 5)], kind)
    layout.write_index()
    assert layout.take_in(gone) == [first, first + 2] and first + 2 not in {d for d, _ in layout.files()}
    assert layout.read().count() == 51 and layout.read().where("sold_at = timestamp_ntz'2024-03-01'").count() == 19
    layout.drop_index()


def test_late_arrivals_of_no_rows(spark, tmp_path):
    spark.read.parquet(f"{SF}/sales.parquet").limit(0).write.parquet(str(tmp_path / "sales.parquet"))
    assert late_arrivals.op12_late_arrivals(spark, str(tmp_path)).count() == 0


def test_word_bpe_against_the_library():
    own, library, r = coder(PATH), Tokenizer.from_file(PATH), random.Random(5)
    tokens, letters = list(library.get_vocab()), "abcdefgh aeioustrn  ABC 0123.,'!?-éèüßÀÅñ\n\t\x1c\x85\xa0́İΣσ日本語ー😀👍🏽ﬁ²½ª’ẞ"
    for k in range(6000):
        text = (
            "".join(r.choice(letters) for _ in range(r.randint(0, 30)))
            if k % 4 == 0
            else "".join(r.choice(tokens).replace("</w>", r.choice([" ", ""])) for _ in range(r.randint(1, 6)))
            if k % 4 == 1
            else "".join(chr(r.choice([r.randint(1, 0x24F), r.randint(0x250, 0xD7FF), r.randint(0x10000, 0x1FFFF)])) for _ in range(r.randint(1, 12)))
            if k % 4 == 2
            else "".join(r.choice("aabeinrst") for _ in range(r.randint(1, 60))) + r.choice(["", " <|endoftext|>x", "<|startoftext|>", "<|endof"])
        )
        wanted = library.encode(text, add_special_tokens=False).ids
        assert own.ids(text) == wanted, repr(text)
        assert own.decode(wanted) == library.decode(wanted, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 100_000, "ab" * 50_000, "é" * 30_000, "word " * 30_000])
def test_word_bpe_in_time_that_grows_with_the_text(text):
    began = time.process_time()
    found = coder(PATH).ids(text)
    assert time.process_time() - began < 10
    assert found == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_word_bpe_rows(spark, documents, nothing):  # noqa: F811
    library = Tokenizer.from_file(PATH)
    wanted = {k: library.encode(t or "", add_special_tokens=False).ids for k, t in enumerate(TEXTS)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = encoding_digests(documents, PATH).collect()
    assert len(rows) == documents.count()
    for r in rows:
        if r["doc_id"] is not None:
            ids = wanted[r["doc_id"]]
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    ids = encoded(documents, PATH)
    assert all(r["ids"] == wanted[r["doc_id"]] for r in ids.collect() if r["doc_id"] is not None)
    back = decoded(ids.unionByName(spark.createDataFrame([(-1, None), (-2, [])], "doc_id long, ids array<int>")), PATH).collect()
    assert all(r["text"] == library.decode(wanted[r["doc_id"]], skip_special_tokens=False) for r in back if (r["doc_id"] or -1) >= 0)
    assert {r["doc_id"]: r["text"] for r in back if r["doc_id"] in (-1, -2)} == {-1: None, -2: ""}
    assert encoding_digests(nothing, PATH).count() == 0


def test_contamination_of_equal_words_in_time_that_grows_with_the_text():
    text = "x " * 40_000
    began = time.process_time()
    found = Automaton([("a", text), ("b", "x x"), ("c", "y x " * 500)])
    n, hit, items = found.match(text)
    assert time.process_time() - began < 2 and n == 40_000 and hit.all() and items == {"a", "b"}
