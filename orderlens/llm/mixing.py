"""Mixing sources to target weights by min-cost flow.

Documents may belong to several sources. They are aggregated by membership pattern, and the flow routes a pattern's tokens to the
quotas of its sources. A pattern's first pass costs nothing, its second 1 a token, its third 2: with convex costs the
cheapest flow repeats as little as it can. Of a pattern, whole passes take all documents; the rest of its flow is met by documents
in a seeded order up to the quota, the one at its edge in part. Where documents have to stay whole, single smaller ones fill what is left instead.

The flow has a node for each pattern and source, so only a row for each pattern reaches the driver, of a bounded number.

Defined results: a null text has no words; no sources is a pattern of its own and takes nothing; a null source is a source,
ordered last; a null id is an id; rows that repeat an id are told apart by their texts, equal ones count each; an empty table gives an
empty result; other columns are ignored, and kept by apply_mix(). Reruns agree, as the order is a hash of seed and id;
documents that tie there go by their texts' hashes. A text counts whole, however long.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free, keep, marked, whole

BUCKETS = 4096


def water_fill(sizes: dict, weights: dict, most: float) -> dict:
    """Targets that share all sizes by weight; none above most times its source's size, the excess shared again by weight."""
    left, open_, out = float(sum(sizes.values())), set(sizes), {}
    while open_:
        total = sum(weights[s] for s in open_)
        share = {s: left * weights[s] / total for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
            open_.discard(s)
    return out


def parts(patterns: dict) -> list[dict]:
    """The patterns cut into groups that share no source. A flow through one group never touches another."""
    parent: dict = {}

    def top(s):
        while parent.setdefault(s, s) != s:
            parent[s] = s = parent[parent[s]]
        return s

    for p in patterns:
        for s in p:
            parent[top(s)] = top(next(iter(p)))
    out: dict = defaultdict(dict)
    for p, tokens in patterns.items():
        if p:
            out[top(next(iter(p)))][p] = tokens
    return list(out.values())


def route(patterns: dict, quotas: dict, passes: int) -> dict:
    """Min-cost flow {(pattern, source): tokens} from patterns {members: tokens a pass} to quotas {source: tokens}.

    Groups of patterns that share no source are solved one by one, so the work for sources that don't overlap grows with their number only.
    """
    out: dict = {}
    for group in parts(patterns):
        out |= cheapest_flow(group, {s: quotas[s] for p in group for s in p if s in quotas}, passes)
    return out


def cheapest_flow(patterns: dict, quotas: dict, passes: int) -> dict:
    """route() for one network, by successive cheapest paths.

    The network: start to pattern, an edge for each pass with the pass as cost; pattern to each member; source to end.
    """
    edges: list[list] = []  # to, capacity, cost; the edge back is the next one
    out: dict = defaultdict(list)

    def edge(a, b, capacity: int, cost: int) -> int:
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            out[x].append(len(edges))
            edges.append([y, c, w])
        return len(edges) - 2

    members = {}
    for p, tokens in patterns.items():
        for k in range(passes):
            edge("start", ("pattern", p), tokens, k)
        for s in p:
            if s in quotas:
                members[p, s] = edge(("pattern", p), ("source", s), tokens * passes, 0)
    for s, quota in quotas.items():
        edge(("source", s), "end", quota, 0)
    potential: dict = defaultdict(int)
    while True:
        cost, via, heap, order = {"start": 0}, {}, [(0, 0, "start")], 0
        while heap:
            d, _, node = heapq.heappop(heap)
            if d > cost[node]:
                continue
            for e in out[node]:
                to, capacity, w = edges[e]
                new = d + w + potential[node] - potential[to]
                if capacity > 0 and new < cost.get(to, math.inf):
                    cost[to], via[to], order = new, e, order + 1
                    heapq.heappush(heap, (new, order, to))
        if "end" not in cost:
            return {k: edges[e + 1][1] for k, e in members.items()}
        for node in cost:
            potential[node] += cost[node]
        for node in out:
            if node not in cost:
                potential[node] += max(cost.values())
        path, node = [], "end"
        while node != "start":
            path.append(via[node])
            node = edges[via[node] ^ 1][0]
        amount = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= amount
            edges[e ^ 1][1] += amount


def fill_gaps(groups: pd.DataFrame) -> pd.DataFrame:
    """Of one pattern's candidates (one for each total of equal rows): the largest that fit into the gap, one after another."""
    left, chosen = int(groups["gap"].iloc[0]), []
    for size, key, mark in sorted(zip(groups["all"], groups["key"], groups["mark"]), reverse=True):
        if size <= left:
            left -= size
            chosen.append((key, mark))
    return pd.DataFrame({"pattern": groups["pattern"].iloc[0], "key": pd.Series([k for k, _ in chosen], dtype="int64"), "mark": pd.Series([m for _, m in chosen], dtype="int64")})


def pattern_of(members: Column) -> Column:
    return F.to_json(F.struct(members.alias("m")), {"ignoreNullFields": "false"})


def mix(
    docs: DataFrame, members: Column, weight_of=None, id_col: str = "doc_id", text_col: str = "text", most: int = 3, seed: int = 7,
    in_part: bool = True, max_patterns: int = 200_000, max_broadcast: int = 10_000, with_marks: bool = False,
) -> DataFrame:
    """One row per row of docs: id_col, size, pattern, source_size, target, taken (and id, mark, check, which name the row, with_marks).

    members is an array of sources; weight_of maps the ordered list of sources to weights (default 1, 2, 3, repeating). source_size
    and target are sums over a row's sources. taken is at most ``most`` times the size: with in_part the document at a quota's edge is taken in
    part, so that the words taken are the flow to the word; else whole documents only, and rows that repeat an id and a text are taken alike.
    The driver holds the flow network, a row for each pattern: more than max_patterns of them are refused, not cut.
    """
    weight_of = weight_of or (lambda sources: {s: i % 3 + 1 for i, s in enumerate(sources)})
    spark = docs.sparkSession
    size = F.regexp_count(whole(text_col), F.lit(WORD)).cast("long")
    _id, _mark, _check = free(docs, "id", "mark", "check")
    named = marked(docs, id_col, text_col, _id, _mark, _check)
    key = F.xxhash64(F.lit(seed), F.col(_id))
    sized = named.select(F.col(_id).alias("id"), F.col(_mark).alias("mark"), F.col(_check).alias("check"), pattern_of(members).alias("pattern"), members.alias("members"), size.alias("size"), key.alias("key"))
    sized = keep(sized.withColumn("bucket", F.shiftrightunsigned("key", 64 - int(math.log2(BUCKETS))).cast("int")))
    by_pattern = keep(sized.groupBy("pattern").agg(F.first("members").alias("members"), F.sum("size").alias("size")))
    if by_pattern.count() > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns: the flow network of so many is too large for the driver")
    groups = by_pattern.collect()
    sizes: dict = defaultdict(int)
    for g in groups:
        for s in set(g["members"] or ()):
            sizes[s] += g["size"]
    ordered = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = water_fill(dict(sizes), weight_of(ordered), most)
    by_members: dict = defaultdict(int)
    for g in groups:
        by_members[frozenset(g["members"] or ())] += g["size"]
    flow = route(by_members, {s: int(targets[s] + 0.5) for s in ordered}, most)
    plan = []
    for g in groups:
        p = frozenset(g["members"] or ())
        total = sum(flow.get((p, s), 0) for s in p) * g["size"] // max(1, by_members[p])
        passes = min(most, total // g["size"]) if g["size"] else 0
        plan.append((g["pattern"], passes, total - passes * g["size"], sum(sizes[s] for s in p), float(sum(targets[s] for s in p))))
    # A row for each pattern, counted here: few are broadcast, so that rows aren't dealt by pattern; many patterns have no third of all rows to deal.
    plan_df = spark.createDataFrame(plan, "pattern string, passes long, rest long, source_size long, target double")
    plan_df = F.broadcast(plan_df) if len(plan) <= max_broadcast else plan_df
    lots = sized.groupBy("pattern", "bucket").agg(F.sum("size").alias("lot"))
    before = F.sum("lot").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("lot")
    # Dealt anew by both keys: else the join would take over the window's partitioning and bring a source's rows into one task.
    lots = lots.withColumn("before", before).drop("lot").repartition("pattern", "bucket")
    rows = sized.drop("members").join(lots, ["pattern", "bucket"]).join(plan_df, "pattern")
    order = Window.partitionBy("pattern", "bucket").orderBy("key", "id", "mark", "check")
    repeats = F.col("passes") * F.col("size")
    if in_part:
        upto = F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
        last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - upto + F.col("size")))
        out = rows.withColumn("taken", repeats + last)
    else:
        # Equal rows are peers of a range: they share what their last one gets.
        upto = F.col("before") + F.sum("size").over(order.rangeBetween(Window.unboundedPreceding, 0))
        rows = keep(rows.withColumn("chosen", upto <= F.col("rest")))
        gaps = rows.groupBy("pattern").agg((F.first("rest") - F.coalesce(F.sum(F.when(F.col("chosen"), F.col("size"))), F.lit(0))).alias("gap"))
        peers = rows.where("not chosen and size > 0").groupBy("pattern", "key", "mark").agg(F.sum("size").alias("all"))
        spare = peers.groupBy("pattern", "all").agg(F.min(F.struct("key", "mark")).alias("name")).join(gaps, "pattern").where(F.col("all") <= F.col("gap"))
        # One candidate for each size of a pattern: as many rows as there are different text lengths.
        fillers = spare.select("pattern", "all", "name.*", "gap").groupBy("pattern").applyInPandas(fill_gaps, "pattern string, key long, mark long")
        filled = rows.join(fillers.withColumn("fills", F.lit(1)), ["pattern", "key", "mark"], "left")
        out = filled.withColumn("taken", repeats + F.when(F.col("chosen") | F.col("fills").isNotNull(), F.col("size")).otherwise(0))
    marks = ["id", "mark", "check"] if with_marks else [F.col("id").alias(id_col)]
    return out.select(*marks, "size", "pattern", "source_size", "target", "taken")


def by_source(docs: DataFrame, source_col: str = "source") -> Column:
    return F.array(F.col(source_col))


def apply_mix(docs: DataFrame, members: Column, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs as mixed, whole documents only: each row as often as the mix takes it. Rows without words take no part and stay once."""
    key = ["id", "mark", "check", "pattern"]
    *names, times = free(docs, *(f"mixed_{k}" for k in key), "times")
    taken = mix(docs, members, id_col=id_col, text_col=text_col, in_part=False, with_marks=True, **how)
    repeats = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(1).cast("int")
    # Rows of one id, text and pattern are taken alike, so a row for each of these is enough.
    told = taken.groupBy(*key).agg(F.max(repeats).alias("times")).where("times > 0").select(*[F.col(k).alias(n) for k, n in zip(key, names)], F.col("times").alias(times))
    rows = marked(docs, id_col, text_col, *names[:3]).withColumn(names[3], pattern_of(members))
    match = [F.col(f"d.{n}").eqNullSafe(F.col(f"t.{n}")) for n in names]
    joined = rows.alias("d").join(told.alias("t").hint("shuffle_hash"), match).select("d.*", f"t.{times}")
    return joined.withColumn(times, F.explode(F.array_repeat(F.lit(1), F.col(times)))).drop(*names, times)
