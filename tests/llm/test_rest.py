"""Vectors, archives, conversations and the pipeline."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from invoiceloom.llm import chat_roles, embedding_dedup, warc


def test_embedding_dedup(spark):
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(30):
        centre = rng.standard_normal(16)
        centre /= np.linalg.norm(centre)
        for _ in range(rng.integers(2, 25)):
            rows.append((len(rows), (centre + rng.standard_normal(16) * rng.choice([0.03, 0.05, 0.07])).tolist()))
    rows += [(len(rows) + i, rows[5][1]) for i in range(40)]
    n = len(rows)
    rows += [(n, None), (n + 1, [0.0] * 16), (n + 2, [float("nan")] * 16), (n + 3, [None, *[1.0] * 15]), (n + 4, [1.0, 2.0]), (n + 5, [2.0, 4.0]), (n + 6, [])]
    rows += [(n + 7, [float("inf")] * 16), (None, rows[0][1]), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("component_id", F.lit("clash"))
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    sound = collections.defaultdict(list)
    for i, v in rows:
        x = np.array([np.nan if c is None else c for c in v or []], float)
        if i is not None and len(x) and np.isfinite(x).all() and x.any():
            sound[len(x)].append((i, x / np.linalg.norm(x)))
    links, parent = collections.Counter(), {i: i for i, _ in rows}
    root = lambda a: a if parent[a] == a else root(parent[a])
    for group in sound.values():
        for a, (i, x) in enumerate(group):
            for j, y in group[:a]:
                if x @ y >= 0.95:
                    links[i] += 1
                    links[j] += 1
                    parent[max(root(i), root(j))] = min(root(i), root(j))
    exact = sum(got[i].n_links == links[i] for i in got if i not in (None, 0))
    assert exact >= len(got) - 2 and all(got[i].component_id == root(i) for i in got if i is not None)
    assert got[None].component_id is None and got[None].n_links == 0 and got[None].kept
    assert all(r.kept == (r.component_id == i) for i, r in got.items() if i is not None)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def crowded_vectors(n=3000, dim=64, blobs=(0.7, 0.8, 0.88, 0.92)):
    """A third of the vectors around a few common directions with mutual cosines of 0.7 to 0.94; every tenth vector has a partner at 0.951 to 0.97."""
    rng = np.random.default_rng(5)
    direction = lambda: (lambda x: x / np.linalg.norm(x))(rng.standard_normal(dim))
    out, common = [], direction()
    while len(out) < n:
        if len(out) % 3 == 0:
            share = blobs[len(out) // 3 % len(blobs)]
            x = np.sqrt(share) * common + np.sqrt(1 - share) * direction()
        else:
            x = direction()
        x /= np.linalg.norm(x)
        out.append(x)
        if len(out) % 10 < 2:
            side = direction()
            side -= (side @ x) * x
            cosine = rng.uniform(0.951, 0.97)
            out.append(cosine * x + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side))
    return np.array(out)


def test_embedding_dedup_where_many_share_a_direction(spark):
    x = crowded_vectors()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    least = np.arange(len(x))
    while True:
        now = np.where(near | np.eye(len(x), dtype=bool), least, len(x)).min(axis=1)
        if (now == least).all():
            break
        least = now
    linked = near.any(axis=1)
    assert linked.sum() > 500
    found = sum(got[i].n_links for i in range(len(x)))
    print("links found", found, "of", near.sum(), "wrong components", sum(got[i].component_id != least[i] for i in got))
    assert all(got[i].n_links == near[i].sum() and got[i].component_id == least[i] and got[i].kept == (least[i] == i) for i in got)


def test_warc_round_trip(spark, tmp_path):
    odd = [
        (1, "u", "WARC/1.1\r\nabc\r\n\r\nWARC/1.1\r\nWARC/1.1"), (2, "u\r\nx y", None), (3, None, ""), (4, "u", "é" * 3000),
        (5, "u", "é" * 3000), (5, "u", "é" * 3000), (None, "u", "zz"), (None, "w", "zz"), (6, "u", "\r\n\r\nWARC/1.1"), (7, "u", "x" * 100_000 + "\r\n" * 50),
    ]
    df = spark.createDataFrame(odd, "page_id long, url string, html string").withColumn("record_type", F.lit("clash"))
    path = str(tmp_path / "warc")
    warc.write_warc(warc.plan_records(df), path, chunk_bytes=1000)
    same = collections.defaultdict(list)
    for i, _, h in odd:
        same[(h or "").encode()].append(i)
    want = collections.Counter()
    for i, _, h in odd:
        p = (h or "").encode()
        largest = max((x for x in same[p] if x is not None), default=None) if len(same[p]) > 1 else None
        to = None if largest == i else largest
        want[i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if to is None else "revisit", to] += 1
    assert collections.Counter(map(tuple, warc.read_records(spark, path).collect())) == want
    chunks = warc.read_chunks(spark, path)
    assert chunks.agg(F.max(F.octet_length("data"))).first()[0] <= 1000
    whole = chunks.where("page_id = 7").orderBy("chunk_no").collect()
    assert b"".join(bytes(r.data) for r in whole).decode() == odd[9][2] and len(whole) > 100
    warc.write_warc(warc.plan_records(df.limit(0)), str(tmp_path / "none"))
    assert warc.read_records(spark, str(tmp_path / "none")).count() == 0


def legal(seq):
    return all(
        (x == "system" and i == 0) or (x == "user" and (i == 0 or seq[i - 1] != "user")) or (x == "assistant" and i > 0 and seq[i - 1] == "user")
        for i, x in enumerate(seq)
    )


def cheapest(roles):
    best = 10**9

    def go(i, seq, cost):
        nonlocal best
        if cost >= best:
            return
        if i == len(roles):
            best = cost
            return
        if seq:
            go(i + 1, seq, cost + 1 + 2 * (seq[-1] != roles[i]))
        for q in ("system", "user", "assistant"):
            change = 2 * (q != roles[i])
            if legal([*seq, q]):
                go(i + 1, [*seq, q], cost + change)
            for x in ("system", "user", "assistant"):
                if legal([*seq, x, q]):
                    go(i + 1, [*seq, x, q], cost + change + 3)

    go(0, [], 0)
    return best


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_chat_roles(spark, adaptive):
    rng = random.Random(3)
    rows = []
    for c in range(40):
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "tool", None, " User"]), rng.choice(["a", "bb", None, ""])))
    rows += [(999, t, rng.choice(["user", "assistant"]), str(t)) for t in range(1500)] + [(None, None, "user", "x"), (5, 0, "user", "a"), (5, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit("clash"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        out = chat_roles.repaired(df).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(out) == len(rows)
    by, given = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        by[r.conv_id].append(r)
    for c, t, role, _ in rows:
        given[c].append(((t or 0), (role or "").strip().lower() or None))
    for c, turns in by.items():
        turns.sort(key=lambda r: r.place)
        text = "".join(r.segment for r in turns)
        roles = re.findall(r"<\|(system|user|assistant)\|>\n", text)
        assert legal(roles) and text.count("<|end|>\n") == len(roles) and text.endswith("<|end|>\n")
        if c not in (999, 5):
            assert sum(r.cost for r in turns) == cheapest([r for _, r in sorted(given[c], key=lambda x: x[0])])
    assert chat_roles.repaired(df.limit(0)).count() == 0


def test_pipeline_keeps_what_each_stage_should(spark, sf):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in cp.STAGES[:-1]:
        out = cp.written(stage(spark, docs, sf), "stage")
        assert out.columns == columns, name
        left = out.count()
        assert 0 < left <= n and (left == n or name != "line_dedup")
        docs, n = out, left
    packed = cp.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == n
