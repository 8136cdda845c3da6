"""Whitening, mixing and lexical search against plain versions, on odd input too."""

import collections
import itertools
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from invoiceloom.llm import lexical_search, mixing, whitening

from .conftest import UP

# Whitening


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
@pytest.mark.parametrize("kind", ["random", "rank", "cluster", "diagonal", "one", "zero", "wide"])
def test_components(n, kind):
    rng = np.random.default_rng(n)
    q, _ = np.linalg.qr(rng.standard_normal((n, n)))
    e = {
        "random": rng.random(n) * 100, "rank": np.r_[rng.random(max(n // 3, 1)), np.zeros(n - max(n // 3, 1))],
        "cluster": np.repeat([1.0, 2.0], [n // 2, n - n // 2]), "diagonal": rng.random(n), "one": np.ones(n), "zero": np.zeros(n),
        "wide": 10.0 ** np.linspace(-14, 3, n),
    }[kind]
    a = np.diag(e) if kind in ("diagonal", "one", "zero") else (q * e) @ q.T
    values, vectors = whitening.components(a)
    want = np.linalg.eigvalsh((a + a.T) / 2)[::-1]
    size = max(np.abs(want).max(), 1e-300)
    assert np.abs(values - want).max() <= 1e-13 * size
    assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-13
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-13 * size


def test_polar_factor():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((20, 20))
    a += a.T
    u, _, vt = np.linalg.svd(a)
    assert np.abs(whitening.polar_factor(a) - u @ vt).max() < 1e-12


def test_whitening(spark):
    rng = np.random.default_rng(4)
    mixed = rng.standard_normal((6, 6))
    rows = [(i, (rng.standard_normal(6) @ mixed + 3).tolist()) for i in range(200)]
    rows += [(300 + i, rows[0][1]) for i in range(50)] + [(None, rows[1][1]), (5, rows[5][1]), (5, rows[5][1])]
    bad = [(400, None), (401, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (402, [float("nan")] * 6), (403, [float("-inf")] + [0.0] * 5), (404, []), (405, [1e40] * 6)]
    short = [(500, [1.0, 2.0]), (501, [1.0, 2.0]), (502, [7.0])]
    df = spark.createDataFrame(rows + bad + short, "vec_id long, embedding array<double>").withColumn("n", F.lit("clash")).withColumn("id", F.lit(1))
    out = whitening.whitened(df, most=5)
    got = collections.defaultdict(list)
    for r in out.collect():
        got[r.vec_id].append(r)
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows])
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    want = (centred @ u[:, ::-1] / np.sqrt(e[::-1]))[:, :5]
    sign = None
    for (i, _), w, row in zip(rows, want, x.tolist(), strict=True):
        mine = sorted(got[i], key=lambda r: r.component)[:: 3 if i == 5 else 1][:5]
        assert [r.component for r in mine] == [1, 2, 3, 4, 5] and len(got[i]) == (15 if i == 5 else 5)
        values = np.array([r.whitened for r in mine])
        sign = np.sign(values * w) if sign is None else sign
        assert np.abs(values * sign - w).max() < 1e-10
        assert all(r.deviation == sum((n * a - int(b)) ** 2 for a, b in zip(row, s, strict=True)) and r.n == n for r in mine)
        assert np.abs([r.explained for r in mine] / (e[::-1][:5] / e.sum()) - 1).max() < 1e-10
        assert all(0 <= r.identity_error <= 1e-12 for r in mine)
    assert not any(i in got for i, _ in bad)
    flat = got[500] + got[501] + got[502]
    assert len(flat) == 5 and all(r.whitened is None and r.identity_error is None and r.deviation == 0 and r.explained == 0 for r in flat)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whitened(df.limit(0)).count() == 0


def test_whitening_of_far_values(spark):
    far = 2.0**44
    df = spark.createDataFrame([(1, [far, 0.0]), (2, [-far, 1.0]), (3, [0.5, 2.0]), (4, [far, 3.0])], "vec_id long, embedding array<double>")
    rows = whitening.whitened(df).collect()
    assert len(rows) == 8 and all(r.deviation is None for r in rows if r.vec_id in (1, 2, 4)) and all(r.identity_error < 1e-4 for r in rows)


# Mixing


def plain_targets(sizes, total):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    got = {s: Fraction(0) for s in order}
    left, open_ = Fraction(3 * total, 2), set(order)
    while left and open_:
        unit, spare = left / sum(weight[s] for s in open_), Fraction(0)
        for s in list(open_):
            got[s] += unit * weight[s]
            if got[s] > 2 * sizes[s]:
                spare += got[s] - 2 * sizes[s]
                got[s] = Fraction(2 * sizes[s])
                open_.discard(s)
        left = spare
    return got


def test_targets():
    rng = random.Random(2)
    for _ in range(50):
        sizes = {rng.choice("abcdefghij") + str(i) if i else None: rng.choice([0, 1, 10, 1000, 33333]) for i in range(rng.randint(1, 9))}
        got = mixing.targets(sizes, sum(sizes.values()))
        assert got == plain_targets(sizes, sum(sizes.values())) and sum(got.values()) == Fraction(3 * sum(sizes.values()), 2)
    assert mixing.targets({}, 0) == {}


def cheapest(capacity, members, quota, most):
    """(words given, least cost) by trying all whole amounts; patterns reach their sources if every set of sources can be served."""
    best = (-1, 0)
    for given in itertools.product(*[range(most * c + 1) for c in capacity]):
        served = all(
            sum(g for g, m in zip(given, members, strict=True) if set(m) <= set(part)) <= sum(quota[s] for s in part)
            for k in range(1, len(quota) + 1) for part in itertools.combinations(range(len(quota)), k)
        )
        if served:
            cost = sum(t * max(0, min(g - t * c, c)) for g, c in zip(given, capacity, strict=True) for t in range(most))
            best = max(best, (sum(given), -cost))
    return best


def test_min_cost_flow():
    rng = random.Random(6)
    for _ in range(60):
        sources = rng.randint(1, 3)
        members = [sorted(rng.sample(range(sources), rng.randint(1, sources))) for _ in range(rng.randint(1, 3))]
        capacity, quota = [rng.randint(0, 3) for _ in members], [rng.randint(0, 6) for _ in range(sources)]
        given = mixing.min_cost_flow(capacity, members, quota, 2)
        cost = sum(t * max(0, min(g - t * c, c)) for g, c in zip(given, capacity, strict=True) for t in range(2))
        assert (sum(given), -cost) == cheapest(capacity, members, quota, 2)
    many = mixing.min_cost_flow([10**6] * 300, [sorted({i % 40, i % 7}) for i in range(300)], [9 * 10**6 * (i % 3) for i in range(40)], 2)
    assert all(0 <= g <= 2 * 10**6 for g in many)


@pytest.fixture(scope="module")
def sourced(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["a", "a", "a", "Ä", "b", None, "z"])) for i in range(400)]
    rows += [(7, "same text here", "b")] * 40 + [(500, None, "a"), (501, "", None), (502, "long " * 20_000, "z"), (None, "no id", "b"), (503, "x", "only")]
    return rows


def check_mix(rows, got):
    words = collections.Counter()
    for _, t, s in rows:
        words[s] += len((t or "").split())
    want = plain_targets(dict(words), sum(words.values()))
    taken = collections.Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r.taken in (0, r["size"], 2 * r["size"]) and r.taken == r["size"] * r.copies
        assert r.source_size == words[r.source] and r.target == float(want[r.source])
        taken[r.source] += r.taken
    return words, want, taken


def test_mixing(spark, sourced):
    df = spark.createDataFrame(sourced, "doc_id long, text string, source string").withColumn("target", F.lit("clash")).withColumn("own", F.lit(1))
    got = mixing.mixed(df).collect()
    words, want, taken = check_mix(sourced, got)
    for s in words:
        near = max((len((t or "").split()) for _, t, x in sourced if x == s), default=0)
        assert abs(taken[s] - want[s]) <= (near if s in ("z", "only") else 3), s
    again = mixing.mixed(df.repartition(5)).collect()
    key = lambda rows: collections.Counter((r.doc_id, r.source, r["size"], r.taken) for r in rows)
    assert key(got) == key(again) and key(mixing.mixed(df, seed=1).collect()) != key(got)
    assert mixing.mixed(df.limit(0)).count() == 0
    only = mixing.mixed(spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")).collect()
    assert [(r["size"], r.target, r.taken) for r in only] == [(0, 0.0, 0)] * 2


def test_mixing_where_one_row_repeats(spark):
    rows = [(1, "five words are in here", "a")] * 900 + [(i, "one", "b") for i in range(2, 400)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)).collect()
    words, want, taken = check_mix(rows, got)
    assert all(abs(taken[s] - want[s]) <= 3 for s in words)


def test_mixing_of_overlapping_sources(spark):
    rng = random.Random(1)
    sets = [["a"], ["a", "b"], ["b", "c", "b"], ["c"], [], None, ["c", None]]
    rows = [(i, "w " * rng.randint(1, 9), rng.choice(sets)) for i in range(600)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source array<string>")).collect()
    own = lambda s: tuple(sorted(set(s or [None]), key=lambda x: (x is None, x or "")))
    words, taken = collections.Counter(), collections.Counter()
    for r in got:
        words[own(r.source)] += r["size"]
        taken[own(r.source)] += r.taken
    mix = mixing.plan_mix(dict(words), mixing.WEIGHTS, mixing.SHARE, 2)
    assert sum(mix.given) == sum(round(t) for t in mix.targets.values())  # here all quotas can be served
    assert all(abs(taken[x] - g) <= 2 for x, g in zip(mix.patterns, mix.given, strict=True))
    assert all(r.source_size == [mix.sizes[s] for s in own(r.source)] for r in got)


# Lexical search

TERM = re.compile(lexical_search.TERM)


def plain_search(documents, items, k):
    told = [(i, collections.Counter(TERM.findall((t or "").translate(UP)))) for i, t in documents]
    told = [(i, c, sum(c.values())) for i, c in told if c]
    n_docs, n_terms = len(told), sum(n for _, _, n in told)
    df = collections.Counter(t for _, c, _ in told for t in c)
    wanted = collections.defaultdict(collections.Counter)
    for i, t in items:
        wanted[i].update(TERM.findall((t or "").translate(UP)))
    out = {}
    for item, terms in wanted.items():
        scores = []
        for i, c, n in told:
            m = 75 + (25 * n * n_docs) // n_terms
            score = sum(
                q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
                for t, q in terms.items() if c[t]
            )
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out[item] = [(r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return out


@pytest.fixture(scope="module")
def searched():
    rng = random.Random(9)
    words = ["alpha", "Beta", "éü", "ΑΣ", "x1", "don't", "b_c", "日本", "q" * 300] + [f"w{i}" for i in range(60)]
    text = lambda n: rng.choice([" ", "\n", ", "]).join(rng.choice(words) for _ in range(n))
    documents = [(i, text(rng.randint(0, 40))) for i in range(300)]
    documents += [(i, "copy of alpha w1 w2") for i in range(300, 345)] + [(400, None), (401, ""), (402, " ,.\n"), (403, "beta " * 300_000), (404, "z" * 2_500_000)]
    documents += [(3, documents[3][1]), (None, "alpha w1"), (None, "alpha w1 w2 w3")]
    items = [(i, text(rng.randint(1, 12))) for i in range(30)] + [(50, "alpha w1 w2"), (51, None), (52, "..."), (53, "nowhere"), (3, "w5 w5"), (None, "w7 beta")]
    items += [(54, "alpha " * 20_000 + "w1"), (55, "Alpha ALPHA copy")]
    return documents, items


@pytest.mark.parametrize("entries", [500_000, 60])
def test_lexical_search(spark, searched, entries):
    documents, items = searched
    df = spark.createDataFrame(documents, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(5)
    wanted = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("clash"))
    got = collections.defaultdict(list)
    for r in lexical_search.ranked(df, wanted, entries_at_once=entries).collect():
        got[r.item_id].append((r.rank, r.doc_id, r.score))
    want = plain_search(documents, items, 20)
    assert {i: sorted(v) for i, v in got.items()} == {i: v for i, v in want.items() if v}
    assert max(len(v) for v in got.values()) == 20 and 53 not in got
    assert lexical_search.ranked(df.limit(0), wanted).count() == 0 and lexical_search.ranked(df, wanted.limit(0)).count() == 0


def test_sums_stay_exact():
    """Weights that would pass 2**53 in one product fall into several blocks, or are multiplied as integers."""
    rng = np.random.default_rng(0)
    weights = np.r_[rng.integers(1, 30_000, 500), rng.integers(4 * 10**9, 8 * 10**9, 5), 10**11]
    terms = np.arange(len(weights))
    (tile,) = lexical_search.tiles(np.zeros(len(weights), np.int64), terms, weights)
    assert len(tile.blocks) > 1 and len(tile.single) == 1
    impact = rng.integers(1, 1_000_000, (3, len(weights)))
    doc, term = np.repeat(np.arange(3), len(weights)), np.tile(terms, 3)
    got = lexical_search.tile_scores(tile, 3, doc, term, impact.ravel())
    assert got.tolist() == [[sum(int(w) * int(x) for w, x in zip(weights, row, strict=True)) for row in impact]]


def test_slices_end_between_terms(monkeypatch):
    monkeypatch.setattr(lexical_search, "SLICE_BYTES", 7)
    text = "One two,three " + "x" * 40 + " é１two TWO"
    total, found = lexical_search.term_counts(memoryview(text.encode()), {b"two": 0, b"x" * 40: 1, "é１two".encode(): 2, b"one": 3})
    assert total == 6 and found == {0: 2, 1: 1, 2: 1, 3: 1}
