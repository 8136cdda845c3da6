"""Quality models: counts against brute force, held-out accuracy, odd input."""

import collections
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from invoiceloom.llm import features as ft
from invoiceloom.llm import quality_classifier, quality_rules
from invoiceloom.llm.labelled import held_out, labelled_sample

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tables(spark):
    sf = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def counts(text):
    words, lines = WORD.findall(text), text.split("\n")
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, doubled = set(), 0
    for line in lines:
        if WORD.search(line):
            doubled += line in seen
            seen.add(line)
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, doubled, len(covered)


def test_base_counts(spark, documents):
    model = quality_rules.fit([], np.zeros(0))
    extra = spark.createDataFrame([(1, "a b a b a b\n\nx\nx\n x\n \n \n#<>"), (2, "é　b | c\r\nc")], "doc_id long, text string")
    df = documents.select("doc_id", "text").union(extra).withColumn("kept", F.lit("clash"))
    rows = quality_rules.with_rules(df, model).collect()
    assert len(rows) == df.count()
    for r in rows:
        want = counts(r.text or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.text
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.base_failed and r.probability >= 0.5)
    assert quality_rules.with_rules(df.limit(0), model).count() == 0


def test_words_do_not_depend_on_pieces(monkeypatch):
    texts = ["", "one two  three", "x" * 90 + " y", "\n\na b\n", "é ü" * 40]
    whole = ft.words_of(*ft.string_bytes(pa.array(texts)))
    monkeypatch.setattr(ft, "RUN_BYTES", 16)
    pieces = ft.words_of(*ft.string_bytes(pa.array(texts)))
    for a, b in zip(vars(whole).values(), vars(pieces).values(), strict=True):
        assert np.array_equal(a, b)
    assert len(whole.hashes) == sum(len(WORD.findall(t)) for t in texts)
    data, offsets = ft.string_bytes(pa.array([None, "ab", "abc"]))
    assert offsets.tolist() == [0, 0, 2, 5]


def auc(score, y):
    rank = np.argsort(np.argsort(score)) + 1
    ones = y.sum()
    return (rank[y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones))


def test_classifier_on_held_out_rows(spark, tables, documents):
    docs, labels = tables
    model = quality_classifier.train(docs, labels)
    score = quality_classifier.quality_score(model, F.col("text"))
    rows = docs.where(held_out(F.col("doc_id"))).select("doc_id", score.alias("s")).join(labels, "doc_id").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id)
    y = rows.quality.to_numpy()
    assert auc(rows.s.to_numpy(), y) > 0.99
    assert ((rows.s >= 0.7) == (y == 1)).mean() > 0.98
    odd = documents.select(quality_classifier.quality_score(model, F.col("text")).alias("s")).collect()
    assert all(0 <= r.s <= 1 for r in odd)


def test_rules_on_held_out_rows(spark, tables):
    docs, labels = tables
    model = quality_rules.train(docs, labels)
    rows = quality_rules.with_rules(docs.where(held_out(F.col("doc_id"))), model).join(labels, "doc_id").toPandas()
    good, bad = rows[(rows.quality == 1) & ~rows.base_failed], rows[rows.quality == 0]
    assert good.kept.mean() > 0.98 and bad.kept.mean() < 0.05


def test_samples_leave_out_the_held_out_fold_and_odd_labels(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(40)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 0), (3, 7), (4, None), (None, 1), (99, 1)], "doc_id long, quality int")
    got = labelled_sample(docs, labels, "quality", 1000).collect()
    want = {i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2} - {1}
    assert {r.id for r in got} == want - {3} or {r.id for r in got} == want
    assert len(labelled_sample(docs, labels, "quality", 5).collect()) == 5
    model = quality_classifier.train(docs, labels.limit(0))
    assert docs.select(quality_classifier.quality_score(model, F.col("text")).alias("s")).distinct().collect()[0].s == pytest.approx(0.5)


def test_sample_is_bounded_in_rows_where_an_id_repeats(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(20)] + [(4, f"copy {i}") for i in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    got = labelled_sample(docs, labels, "quality", 1000).collect()
    assert len(got) == len({r.id for r in got}) <= 20 and 4 in {r.id for r in got}
    again = labelled_sample(docs.orderBy(F.desc("text")), labels, "quality", 1000).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


@pytest.mark.parametrize("run_bytes", [1, 7, 1 << 20])
def test_character_grams_are_of_code_points(monkeypatch, run_bytes):
    monkeypatch.setattr(ft, "RUN_BYTES", run_bytes)
    texts = ["Привет, мир", "", "ab", "ABCD abcd", "漢字漢字漢", "é😀é😀x", "ÿ\u07ff\u0800\uffff\U0010ffff"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    for n in (3, 4):
        found = list(ft.char_ngrams(data, offsets, n, 2))
        hashes, doc = (np.concatenate([f[i] for f in found]).tolist() for i in (0, 1))
        want = [(re.sub("[A-Z]+", lambda m: m[0].lower(), t)[k : k + n], d) for d, t in enumerate(texts) for k in range(len(t) - n + 1)]
        assert doc == [d for _, d in want]
        assert len(set(zip([g for g, _ in want], hashes, strict=True))) == len({g for g, _ in want}) == len(set(hashes))
    code = ft.code_points(np.frombuffer("aÿ\u07ff\u0800\uffff\U0010ffff".encode(), np.uint8))[1]
    assert code.tolist() == [0x61, 0xFF, 0x7FF, 0x800, 0xFFFF, 0x10FFFF]
