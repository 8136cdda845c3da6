"""Mixing overlapping sources to target weights by min-cost flow.

Documents are told by the set of sources they belong to (their pattern). Each pattern can give its words once, twice, up to a most number of
times, every repetition at a higher cost; sources take words up to their target. The min-cost flow from patterns to sources, planned on one
row per pattern, says how many words each pattern gives. A pattern's documents are then chosen in the order of a seeded hash: all of
them as often as the words allow, and once more those below a threshold, which is found by narrowing ranges of hashes
with aggregates, so no order of all documents is ever formed.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from invoiceloom.llm.rows import column, packed, unpacked, written

WEIGHTS = (5, 2, 1)
SHARE = Fraction(3, 2)
MOST = 2
SEED = 20_24
WORD = r"[^\x20\x09-\x0D]+"
STEP_BITS = 12
FITTED = 4

#: The plan has a row per source and per pattern; a corpus with more sets of sources than this needs coarser sources.
PATTERN_LIMIT = 200_000

Source = str | None


def in_order(sources: Sequence[Source]) -> list[Source]:
    """By code point, null last."""
    return sorted(sources, key=lambda s: (s is None, s or ""))


def targets(sizes: dict[Source, int], total: int, weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE, most: int = MOST) -> dict[Source, Fraction]:
    """Words wanted of each source: ``share`` of ``total`` split by weights that repeat over the sources in order.

    No target is above ``most`` times the source's size; what is above is shared again by weight among the others. Where all sources together can't
    give the share, each stands at its most.
    """
    weight = {s: weights[i % len(weights)] for i, s in enumerate(in_order(list(sizes)))}
    full: dict[Source, Fraction] = {}
    left = Fraction(total) * share
    open_ = list(weight)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if unit * weight[s] > most * sizes[s]]
        if not over:
            return full | {s: unit * weight[s] for s in open_}
        for s in over:
            full[s] = Fraction(most * sizes[s])
            left -= full[s]
        open_ = [s for s in open_ if s not in full]
    return full


def min_cost_flow(capacity: list[int], members: list[list[int]], quota: list[int], most: int) -> list[int]:
    """Words each pattern gives: a flow of the largest amount and, of those, the least cost.

    Pattern ``i`` reaches the sources ``members[i]``; its words cost 0 the first time, 1 the second and so on. Shortest augmenting paths with
    potentials: an arc from the start to a pattern for each repetition, arcs without bound to sources, arcs with the quotas to the end.
    """
    patterns, sources = len(capacity), len(quota)
    start, end = patterns + sources, patterns + sources + 1
    head: list[int] = []
    room: list[int] = []
    cost: list[int] = []
    out: dict[int, list[int]] = defaultdict(list)

    def arc(u: int, v: int, amount: int, price: int) -> int:
        for a, b, r, p in ((u, v, amount, price), (v, u, 0, -price)):
            out[a].append(len(head))
            head.append(b)
            room.append(r)
            cost.append(p)
        return len(head) - 2

    wanted = sum(quota)
    given = [[arc(start, i, n, times) for times in range(most)] for i, n in enumerate(capacity)]
    for i, own in enumerate(members):
        for s in own:
            arc(i, patterns + s, wanted, 0)
    for s, n in enumerate(quota):
        arc(patterns + s, end, n, 0)

    potential: dict[int, int] = defaultdict(int)
    while True:
        far, done, queue = {start: 0}, set(), [(0, start)]
        while queue:
            d, u = heapq.heappop(queue)
            if u in done:
                continue
            done.add(u)
            for e in out[u]:
                v = head[e]
                to = d + cost[e] + potential[u] - potential[v]
                if room[e] and v not in done and to < far.get(v, 1 << 60):
                    far[v] = to
                    heapq.heappush(queue, (to, v))
        if end not in far:
            break
        for v in range(end + 1):
            potential[v] += min(far.get(v, far[end]), far[end])
        # every path of this length: depth first along arcs of no reduced cost
        at, path, u, on_path = defaultdict(int), [], start, {start}
        while True:
            if u == end:
                amount = min(room[e] for e in path)
                for e in path:
                    room[e] -= amount
                    room[e ^ 1] += amount
                full = next(k for k, e in enumerate(path) if room[e] == 0)
                on_path.difference_update(head[e] for e in path[full:])
                u, path = head[path[full] ^ 1], path[:full]
            while at[u] < len(out[u]):
                e = out[u][at[u]]
                if room[e] and head[e] not in on_path and cost[e] + potential[u] == potential[head[e]]:
                    break
                at[u] += 1
            else:
                if u == start:
                    break
                on_path.discard(u)
                u = head[path.pop() ^ 1]
                at[u] += 1
                continue
            path.append(e)
            u = head[e]
            on_path.add(u)
    return [sum(room[e ^ 1] for e in arcs) for arcs in given]


@dataclass
class Mix:
    """Targets and sizes by source; words given by each pattern."""

    sizes: dict[Source, int]
    targets: dict[Source, Fraction]
    patterns: list[tuple[Source, ...]]
    words: list[int]
    given: list[int]


def plan_mix(words: dict[tuple[Source, ...], int], weights: Sequence[int], share: Fraction, most: int) -> Mix:
    """The plan for the words of each pattern."""
    sizes: dict[Source, int] = defaultdict(int)
    for own, n in words.items():
        for s in own:
            sizes[s] += n
    wanted = targets(dict(sizes), sum(words.values()), weights, share, most)
    number = {s: i for i, s in enumerate(in_order(list(sizes)))}
    patterns = sorted(words, key=lambda own: [number[s] for s in own])
    quota = [round(wanted[s]) for s in number]
    given = min_cost_flow([words[x] for x in patterns], [[number[s] for s in x] for x in patterns], quota, most)
    return Mix(dict(sizes), wanted, patterns, [words[x] for x in patterns], given)


def border(rows: DataFrame, key: str, wanted: dict[int, int]) -> dict[int, tuple[int, int, int]]:
    """(key, words below it, rows that hold it) where the words of a pattern, in the order of ``key``, first pass those ``wanted`` of it.

    Keys are not negative. Ranges of them are narrowed by some bits at a time: each step is one aggregate, and a row per pattern
    reaches the driver.
    """
    done: dict[int, tuple[int, int, int]] = {}
    now = {p: (0, 0, n) for p, n in wanted.items()}  # a key of the range, words below the range, words wanted within
    high = 64
    while now:
        low = max(high - STEP_BITS, 0)
        start = lambda k, bits: F.shiftrightunsigned(k, bits) if bits < 64 else F.lit(0).cast("long")
        ranges = rows.sparkSession.createDataFrame([(p, k >> high, n) for p, (k, _, n) in now.items()], "pattern int, above long, wanted long")
        inside = rows.where("size > 0").join(F.broadcast(ranges), "pattern").where(start(key, high) == F.col("above"))
        parts = inside.groupBy("pattern", "wanted", start(key, low).alias("part")).agg(
            F.sum("size").alias("words"), F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("rows")
        )
        # at most 2**STEP_BITS parts of a pattern
        upto = F.sum("words").over(Window.partitionBy("pattern").orderBy("part"))
        reached = parts.withColumn("upto", upto).where("upto > wanted")
        at = F.min(F.struct("part", "upto", "words", "first", "last", "rows")).alias("at")
        found = reached.groupBy("pattern").agg(at).select("pattern", "at.*").collect()
        following = {}
        for r in found:
            _, below, n = now[r["pattern"]]
            less = r["upto"] - r["words"]
            if r["first"] == r["last"]:
                done[r["pattern"]] = (r["first"], below + less, r["rows"])
            else:
                following[r["pattern"]] = (r["first"], below + less, n - less)
        now, high = following, low
    return done


def before() -> Column:
    """Whether a row comes before the border of its pattern."""
    return (F.col("order") < F.col("end_order")) | ((F.col("order") == F.col("end_order")) & (F.col("place") < F.col("end_place")))


def chosen(rows: DataFrame, wanted: dict[int, int]) -> dict[int, tuple[int, int, list[int]]]:
    """(order, place, more places) by pattern: rows before (order, place) and those in the places have about the words ``wanted``.

    What the row at the border leaves open is filled with the largest rows that fit, a few in turn, and at last with the nearest in size.
    """
    spark = rows.sparkSession
    by_order = border(rows, "order", wanted)
    left = {p: wanted[p] - below for p, (_, below, _) in by_order.items()}
    tied = {p: left[p] for p, (_, _, n) in by_order.items() if n > 1}
    by_place: dict[int, tuple[int, int, int]] = {}
    if tied:
        keys = spark.createDataFrame([(p, by_order[p][0]) for p in tied], "pattern int, tie long")
        same = rows.join(F.broadcast(keys), "pattern").where(F.col("order") == F.col("tie")).drop("tie")
        by_place = border(same, "place", tied)
    ends = {p: (key, by_place[p][0] if p in by_place else -1) for p, (key, _, _) in by_order.items()}
    left |= {p: left[p] - below for p, (_, below, _) in by_place.items()}
    more: dict[int, list[int]] = {p: [] for p in ends}
    for last in [False] * FITTED + [True]:
        open_ = [(p, *ends[p], left[p], more[p]) for p in ends if left[p]]
        if not open_:
            break
        facts = spark.createDataFrame(open_, "pattern int, end_order long, end_place long, left long, more array<long>")
        off = F.abs(F.col("left") - F.col("size"))
        outside = ~before() & ~F.array_contains("more", F.col("place")) & (F.col("size") > 0)
        fits = off < F.col("left") if last else F.col("size") <= F.col("left")
        nearest = rows.join(F.broadcast(facts), "pattern").where(outside & fits).groupBy("pattern").agg(F.min(F.struct(off.alias("off"), "order", "place", "size")).alias("at"))
        for p, at in nearest.collect():
            more[p].append(at["place"])
            left[p] -= at["size"]
    return {p: (*ends[p], more[p]) for p in ends}


def mixed(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: Fraction = SHARE,
    most: int = MOST,
    seed: int = SEED,
) -> DataFrame:
    """A row for each of ``df``: its columns but the text, size (words), source_size, target, copies and taken (words, repeats counted).

    ``source_column`` is a string, or an array of strings for documents that belong to several sources; source_size and target are then arrays in
    the order of the row's sources (by code point, null last). A null source, a null array and an empty one are a source of their own; repeated
    sources in an array count once. Whole documents are taken, each up to ``most`` times, so what a pattern gives differs from the plan by less
    than one document.

    Null and empty texts have size 0 and no words to take. Rows that repeat an id are documents of their own; equal rows share a hash and are
    told apart by their place, so which of them is taken doesn't show. The same table and seed give the same result. An empty table gives an
    empty one. Columns of ``df`` with the added names are replaced. More than ``PATTERN_LIMIT`` different sets of sources raise an error.
    """
    spark = df.sparkSession
    source, lists = column(source_column), df.schema[source_column].dataType.typeName() == "array"
    alone = F.array(F.lit(None).cast("string"))
    own = F.when(F.size(source) > 0, F.array_sort(F.array_distinct(source.cast("array<string>")))).otherwise(alone) if lists else F.array(source.cast("string"))
    size = F.coalesce(F.regexp_count(column(text_column), F.lit(WORD)), F.lit(0)).cast("long")
    digest = F.coalesce(F.xxhash64(column(text_column)), F.lit(0).cast("long"))
    order = F.shiftrightunsigned(F.xxhash64(F.lit(seed), column(id_column), digest), 1)
    columns = [c for c in df.columns if c.lower() != text_column.lower()]
    told = written(
        df.select(packed(df.select(*map(column, columns))), own.alias("own"), size.alias("size"), order.alias("order"), F.monotonically_increasing_id().alias("place")),
        "sizes",
    )

    summed = told.groupBy("own").agg(F.sum("size").alias("words")).limit(PATTERN_LIMIT + 1).collect()
    if len(summed) > PATTERN_LIMIT:
        raise ValueError(f"more than {PATTERN_LIMIT} sets of sources")
    mix = plan_mix({tuple(r["own"]): r["words"] for r in summed}, weights, share, most)
    whole = [n // w if w else 0 for n, w in zip(mix.given, mix.words, strict=True)]
    more = {i: n - whole[i] * w for i, (n, w) in enumerate(zip(mix.given, mix.words, strict=True)) if n > whole[i] * w}
    numbers = spark.createDataFrame([(list(x), i) for i, x in enumerate(mix.patterns)], "own array<string>, pattern int")
    cuts = chosen(told.select("own", "size", "order", "place").join(F.broadcast(numbers), "own"), more)

    facts = [
        (list(x), [mix.sizes[s] for s in x], [float(mix.targets[s]) for s in x], whole[i], *cuts.get(i, (-1, -1, [])))
        for i, x in enumerate(mix.patterns)
    ]
    plan = spark.createDataFrame(
        facts, "own array<string>, source_size array<long>, target array<double>, whole int, end_order long, end_place long, more array<long>"
    )
    rows = told.join(F.broadcast(plan), "own")
    copies = F.col("whole") + (before() | F.array_contains("more", F.col("place"))).cast("int")
    told_of = (lambda c: F.col(c)) if lists else (lambda c: F.get(c, 0))
    added = {
        "size": F.col("size"),
        "source_size": told_of("source_size"),
        "target": told_of("target"),
        "copies": F.when(F.col("size") > 0, copies).otherwise(0),
        "taken": F.col("size") * copies,
    }
    return unpacked(rows, columns, added)
