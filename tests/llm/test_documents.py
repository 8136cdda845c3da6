"""Operators on documents against brute force, on texts that hold every odd case."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from invoiceloom.llm import byte_bpe, license_scan, line_dedup, ngram_join, packing
from invoiceloom.llm.components import components

from .conftest import BLANK, UP

tokenizers = pytest.importorskip("public_tokenizers")


def plain(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def test_line_dedup(spark, documents):
    rows = plain(documents)
    key = lambda line: line.strip(BLANK).translate(UP)
    holders = collections.defaultdict(set)
    for i, text in rows:
        for line in text.split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(i)
    ids = {k: {i for i in v if i is not None} for k, v in holders.items()}
    want = collections.Counter()
    for i, text in rows:
        lines = text.split("\n")
        kept = [x for x in lines if len(ids.get(key(x), ())) < 3 or max(ids[key(x)]) == i]
        want[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    out = line_dedup.drop_shared_lines(documents)
    assert out.columns == [*documents.columns, "n_dropped"]  # n_lines takes the place of the input's
    got = collections.Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect())
    assert got == want and sum(k[2] for k in want) > 10
    assert line_dedup.drop_shared_lines(documents.limit(0)).count() == 0


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(UP))
    n = min(5, len(words))
    return frozenset(tuple(words[j : j + n]) for j in range(len(words) - n + 1)) if n else frozenset()


def test_ngram_join(spark, documents):
    rows = [(i, shingles(t)) for i, t in plain(documents)]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [(i, s) for i, s in rows if i is not None and s]
    for a, (i, s) in enumerate(known):
        for j, t in known[:a]:
            if 100 * len(s & t) >= 75 * len(s | t) and root(i) != root(j):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    want = collections.Counter((i, len(s), None if i is None else root(i)) for i, s in rows)
    got = ngram_join.similar_documents(documents)
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == want
    assert sum(i != c for i, _, c in want) > 10
    assert ngram_join.similar_documents(documents.limit(0)).count() == 0


def test_ids_with_a_copy_and_another_text_keep_all_links(spark):
    words = lambda start, n=60: [f"w{i}" for i in range(start, start + n)]
    one, two, three = words(0), words(1000), words(2000)
    rows = [(1, one), (5, one), (5, two), (3, two[:-3] + ["other"]), (9, three), (8, three), (7, three[2:]), (6, words(3000))]
    copies = [(100 + i, words(4000)) for i in range(40)] + [(60, words(4002))]
    near = [(200 + i, words(5000, 50 - 6 * i) + words(6000 + 100 * i, 6 * i)) for i in range(6)]  # each shares buckets, some too far apart
    table = [(i, " ".join(w)) for i, w in rows + copies + near]
    got = ngram_join.similar_documents(spark.createDataFrame(table, "doc_id long, text string"))
    sets = [(i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)}) for i, w in rows + copies + near]
    root = {i: i for i, _ in sets}
    for _ in sets:
        for i, s in sets:
            for j, t in sets:
                if 100 * len(s & t) >= 75 * len(s | t):
                    root[i] = root[j] = min(root[i], root[j])
    assert {r.doc_id: r.component_id for r in got.collect()} == root
    assert root[3] == root[5] == 1 and root[9] == 7 and root[139] == 60


def test_bands_and_sketches_are_lossless():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 4, 7, 20, 63, 64, 65, 200, 255, 256, 300, 1500):
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            drop = rng.integers(0, len(a) // 4 + 1)
            room = (4 * (len(a) - drop)) // 3 - len(a)
            more = rng.integers(0, 1 << 63, max(int(rng.integers(0, max(room, 0) + 1)), 0), dtype=np.uint64)
            b = np.unique(np.concatenate([np.delete(a, rng.permutation(len(a))[:drop]), more]))
            both = len(np.intersect1d(a, b))
            if len(b) == 0 or 100 * both < 75 * (len(a) + len(b) - both):
                continue
            found = []
            for s in (a, b):
                keys = set()
                for band, parts, difference in ngram_join.bands(len(s), 75):
                    keys |= set(np.sort(ngram_join.part_keys(s, band, parts))[: difference + 1].tolist())
                found.append(keys)
            assert found[0] & found[1], (len(a), len(b), both)
            x, y = (np.frombuffer(ngram_join.scaled_sketch(s), np.uint8) for s in (a, b))
            assert ngram_join.sketch_distance(x, y) <= len(a) + len(b) - 2 * both


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 180)] + [(500, i) for i in range(501, 700)] + [(7, 7), (900, 3), (None, 4)]
    got = dict(components(spark.createDataFrame(links, "u long, v long")).collect())
    want = {i: 100 for i in range(100, 181)} | {i: 500 for i in range(500, 700)} | {900: 3, 3: 3}
    assert got == want


def test_byte_bpe(spark, documents):
    tiktoken = pytest.importorskip("tiktoken")
    path = tokenizers.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    rng = random.Random(4)
    long = [(300, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8_000))), (301, "ab" * 400 + " é漢😀" * 90 + "!" * 256 + " " + "?" * 257)]
    more = spark.createDataFrame([(i, t, None, None, None) for i, t in long], documents.schema)
    few = documents.where("doc_id is null or doc_id > 55").union(more).coalesce(2)
    want = collections.Counter((i, " ".join(map(str, own.encode_ordinary(t))), t.encode()) for i, t in plain(few))
    for frequent in (0, 40):
        out = byte_bpe.encoded(few, path, tokenizers.PATTERN, frequent=frequent)
        told = out.select("doc_id", "ids", "n_tokens", "score", byte_bpe.decoder(path)(F.col("ids")).alias("raw")).collect()
        assert collections.Counter((r.doc_id, r.ids, bytes(r.raw)) for r in told) == want
        assert all(r.n_tokens == len(r.ids.split()) for r in told)
    assert byte_bpe.encoded(documents.limit(0), path, tokenizers.PATTERN, frequent=40).count() == 0
    with pytest.raises(ValueError, match="no merge"):
        byte_bpe.halves({b"a": 0, b"b": 1, b"c": 2, b"abc": 3})


def test_byte_bpe_of_mixed_signs_needs_no_shuffle(spark):
    tiktoken = pytest.importorskip("tiktoken")
    path = tokenizers.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    rng = random.Random(8)
    latin = [chr(c) for c in range(byte_bpe.LATIN_END)] + list("  \n'srtvmld" * 12)
    signs = [latin, [*latin, *"\u0301\u2028\u3000漢😀Σß\u212a٣"]]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 90))) for _ in range(200) for some in signs]
    texts += ["".join(rng.choice("abcdefghij") for _ in range(n)) for n in (63, 64, 65, 66, 500)] + ["a" * 300, "é" * 200]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for frequent in (0, 10, 400_000):
        out = byte_bpe.encoded(rows, path, tokenizers.PATTERN, frequent=frequent)
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        assert {r.doc_id: r.ids for r in out.collect()} == {i: " ".join(map(str, own.encode_ordinary(t))) for i, t in enumerate(texts)}


def test_a_word_is_made_once_while_it_is_remembered():
    asked = []
    words = byte_bpe.Remembered(lambda w: asked.append(w) or w.upper(), {})
    assert [words[w] for w in "abcab"] == list("ABCAB") and asked == list("abc")
    later = words.bounded(4)
    assert words.bounded(6) is words and later["a"] == "A" and later["d"] == "D" and asked == list("abcd")
    assert len(later) == 2 and later.bounded(2)["b"] == "B" and asked == list("abcdb")


def test_pieces_of_ids_are_joined_without_a_loop():
    import pyarrow as pa

    pieces = pa.array([b"a", None, b"bc", b"\xff"], pa.large_binary())
    for ids, want in ((["0 2 3", "", None, "3"], [b"abc\xff", b"", None, b"\xff"]), ([], []), ([None], [None]), ([""], [b""])):
        assert byte_bpe.joined_pieces(pa.array(ids, pa.string()), pieces).to_pylist() == want
        assert byte_bpe.joined_pieces(pa.array(["2", *ids], pa.string()).slice(1), pieces).to_pylist() == want
    for unknown in ("1", "9", "x"):
        with pytest.raises((ValueError, IndexError)):
            byte_bpe.joined_pieces(pa.array([unknown]), pieces)


def test_packing(spark, documents):
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    special = [(200, "a <|endoftext|> b"), (201, "x<|startoftext|>y<|endoftext|><|ENDOFTEXT|> <|endoftext"), (202, "one two " * 2047), (203, "one " * 4095)]
    documents = documents.select("doc_id", "text").union(spark.createDataFrame(special, "doc_id long, text string"))
    want = collections.Counter()
    for i, text in plain(documents):
        ids = np.array([*own.encode(text, add_special_tokens=False).ids, 0], "<u4")
        for number, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[i, number, at, len(part), zlib.crc32(part.tobytes())] += 1
    rows = packing.packed_documents(documents, path).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) == -(-sum(r.length for r in rows) // 2048)
    assert packing.packed_documents(documents.limit(0), path).count() == 0


def test_latin_texts_are_encoded_piece_by_piece():
    path = tokenizers.path("word_bpe_49k.json")
    encoder = packing.WordEncoder(open(path, encoding="utf-8").read())
    ids = lambda t: np.frombuffer(b"".join(encoder.encode(t)), "<u4").tolist()
    forms = [f"{a}{w}{b}" for w in ("house", "House", "HOUSE", "casa", "Größe") for a in ("", "(", "'") for b in ("", ",", ".", "!", "'s", "7")]
    assert ids(" ".join(forms)) == encoder.tokenizer.encode(" ".join(forms), add_special_tokens=False).ids
    assert len(encoder.cache) < len(forms) / 4  # a worker remembers pieces, not each form of a word
    rng = random.Random(9)
    latin = "abzAZ059'.,!|>-_#éÉßıſŉ×ĲįĮ \t\n"
    for signs in (latin, latin + "<\u0130\u0301²ªµ÷中Σσ\u212a\x01\x00\x1c\x1f\xa0"):
        for _ in range(400):
            text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 40)))
            assert ids(text) == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_a_piece_is_encoded_by_the_model_alone():
    path = tokenizers.path("word_bpe_49k.json")
    encoder = packing.WordEncoder(open(path, encoding="utf-8").read())
    for piece in ("house", "größe", "7", "!?", "'s", "\x02\x7f", "z" * 3_000):
        assert encoder.piece_ids(piece) == np.array(encoder.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()


def fewest(items, size):
    """The least number of sequences, by trying."""
    best = len(items)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for k in sorted({r: k for k, r in enumerate(rooms) if r >= items[i]}.values()):
            place(i + 1, [r - items[i] * (j == k) for j, r in enumerate(rooms)])
        place(i + 1, [*rooms, size - items[i]])

    items = sorted(items, reverse=True)
    place(0, [])
    return best


def test_plans_are_whole_and_short():
    rng = random.Random(2)
    over = 0
    for _ in range(60):
        items = [rng.randint(1, 20) for _ in range(rng.randint(1, 10))]
        counts = collections.Counter(items)
        plan = packing.plan_sequences(counts, 20)
        back = collections.Counter()
        for n, lengths in plan:
            assert sum(lengths) <= 20
            for x in lengths:
                back[x] += n
        assert back == counts
        over += sum(n for n, _ in plan) - fewest(items, 20)
    assert over <= 1
    many = {x: 50_000_000 + x for x in range(1, 2049)}
    used = sum(n for n, _ in packing.plan_sequences(many))
    assert used <= 1.001 * sum(x * n for x, n in many.items()) / 2048
    assert packing.plan_sequences({}) == []


def test_license_scan(spark, documents):
    mit = license_scan.TEMPLATES[1][1]
    texts = ["Licensed under the MIT License", "x\nReleased under the MIT license!!\ny", mit, mit.replace(". ", ".\n"), mit + " and more" * 200, "nothing here", None, "", "MIT"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("license_matches", F.lit("clash"))

    def grams(text):
        words = re.sub(license_scan.BETWEEN_WORDS, " ", text.translate(UP)).split()
        return {f"{a} {b}" for a, b in zip(words, words[1:])}  # noqa: B905

    for r in license_scan.scan(df).collect():
        lines = (r.text or "").split("\n")
        units = ([(-1, r.text)] if len(lines) > 1 else []) + list(enumerate(lines))
        want = []
        for at, unit in units:
            for name, template in license_scan.TEMPLATES:
                a, b = grams(unit), grams(template)
                if a and 200 * len(a & b) >= 75 * (len(a) + len(b)):
                    want.append((at, name, 2.0 * len(a & b) / (len(a) + len(b))))
        assert [(m.line, m.license, m.dice) for m in r.license_matches] == want
    assert license_scan.scan(documents).count() == documents.count()
    assert license_scan.scan(df.limit(0)).count() == 0


def test_license_passages_across_lines(spark, documents):
    import textwrap

    def words(text):
        return re.sub(license_scan.BETWEEN_WORDS, " ", text.translate(UP)).split()

    long = [(n, t) for n, t in license_scan.TEMPLATES if len(words(t)) > 20]
    story = "\n".join("some words of a readme that say how to build and to run it" for _ in range(12))
    texts = [f"{story}\n\n{textwrap.fill(t, 78)}\n\n{story}" for _, t in long]
    texts += ["Copyright 2021 by the authors. Licensed under CC BY-NC 4.0.", "x Licensed under\nthe MIT License y", story, None, "", "MIT"]
    texts += [f"{texts[0]}\n{texts[0]}", long[0][1].replace("free of charge", "at no cost").replace("Software", "thing", 1) + " and more" * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("license_passages", F.lit("clash"))
    got = {r.doc_id: r.license_passages for r in license_scan.passages(df).collect()}
    for i, text in enumerate(texts):
        own = words(text or "")
        pairs = [f"{a} {b}" for a, b in zip(own, own[1:])]  # noqa: B905
        want = []
        for name, template in license_scan.TEMPLATES:
            b, kept = set(license_scan.template_bigrams(template)), []
            hits = [k for k, g in enumerate(pairs) if g in b]
            for first in hits:
                runs = [(2.0 * len(set(pairs[first : k + 1]) & b) / (len(set(pairs[first : k + 1])) + len(b)), -k) for k in hits if first <= k < first + 125 * len(b) // 75]
                dice, last = max(runs)
                if 100 * dice < 75:
                    continue
                m = (first, 2 - last - first, name, dice)
                if not kept or first >= kept[-1][0] + kept[-1][1]:
                    kept.append(m)
                elif dice > kept[-1][3]:
                    kept[-1] = m
            want += kept
        assert [tuple(m) for m in got[i]] == sorted(want), i
    for i, (name, _) in enumerate(long):
        assert (name, 1.0) in [(m.license, m.dice) for m in got[i]]
    assert [m.license for m in got[len(long)]] == ["CC-BY-NC-4.0"]
    assert sum(m.license == long[0][0] and m.dice == 1.0 for m in got[len(long) + 6]) == 2
    assert license_scan.passages(documents).count() == documents.count()


def test_digest_of_lines_is_of_the_whole_text(spark):
    text = "\n".join(f"line number {i} of a long text" for i in range(20_000))
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    (r,) = line_dedup.drop_shared_lines(df).select("n_lines", F.sha2("text", 256).alias("h")).collect()
    assert (r.n_lines, r.h) == (20_000, hashlib.sha256(text.encode()).hexdigest())
