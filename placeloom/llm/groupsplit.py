"""Train, validation and test splits in which related records stay together.

Records are related that share a query or one of the names between the commas of name, over any number of steps.
Names are few against records, so the graph is built on names: every query's records hand their names to the query's
least name, and components are found on those links alone. Components of equal size and label profile form a bundle;
a min-cost flow gives each bundle's records to the splits (paying for deviation from the split quotas and from the
bundle's own proportions), the flow is rounded to whole components, and a component's place in its bundle is the rank of
its hash.

Defined cases: names and queries are compared in lower case, trimmed, runs of blanks (no-break ones too) as one; null and
blank ones share nothing; a record with neither is its own group; repeated rows of a record count once; an empty table
gives no groups.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.operators.components import components
from placeloom.runtime import collation_free_blank, cut, exact_rank, once


def record_keys(df: DataFrame, key: str = "request_id", query: str = "query", name: str = "name") -> DataFrame:
    """Distinct (key, q, names): the compared query and the sorted compared names; rows of one record are merged later."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col("named"), F.lit("")), ","), lambda p: F.lower(collation_free_blank(p))), lambda p: p != "")
    compared = once(df.select(F.col(key).alias("id"), F.col(query).alias("raw"), F.col(name).alias("named")).filter("id is not null"), v=F.lower(collation_free_blank("raw")), parts=parts)
    return compared.select("id", F.when(F.col("v") != "", F.col("v")).alias("q"), F.sort_array(F.array_distinct("parts")).alias("names")).distinct()


def related_groups(df: DataFrame, key: str = "request_id", query: str = "query", name: str = "name") -> DataFrame:
    """Columns id, group_id: the least id of the records related to each record."""
    rec = cut(record_keys(df, key, query, name))
    # several rows of one record tie their keys together: its id serves as one more query
    multi = rec.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")
    links = rec.select(F.concat(F.lit("q:"), "q").alias("via"), "names", "id").filter("via is not null").unionByName(rec.join(multi, "id").select(F.concat(F.lit("r:"), F.col("id").cast("string")).alias("via"), "names", "id"))
    # a hub is a query's least name; a query of nameless records only is its own hub
    hubs = links.groupBy("via").agg(F.min(F.get("names", F.lit(0))).alias("least")).select("via", F.coalesce(F.concat(F.lit("n:"), "least"), F.col("via")).alias("hub"))
    named = links.select("via", F.explode("names").alias("n")).select("via", F.concat(F.lit("n:"), "n").alias("n")).distinct()
    edges = named.join(hubs, "via").select("hub", "n").filter("hub <> n")
    # records of several names but no query, and nameless rows of records with several rows
    own = rec.filter("size(names) > 1").select(F.concat(F.lit("n:"), F.get("names", F.lit(0))).alias("hub"), F.explode("names").alias("n")).select("hub", F.concat(F.lit("n:"), "n").alias("n")).filter("hub <> n")
    nameless = rec.join(multi, "id").filter("size(names) = 0 and q is not null").select(F.concat(F.lit("r:"), F.col("id").cast("string")).alias("via"), F.concat(F.lit("q:"), "q").alias("q"))
    via_hub = nameless.join(hubs, "via").select(F.col("hub").alias("a"), "q").join(hubs.select(F.col("via").alias("q"), "hub"), "q").select(F.col("a").alias("hub"), F.col("hub").alias("n")).filter("hub <> n")
    roots = components(edges.unionByName(own).unionByName(via_hub), "hub", "n")
    # the hub of a record: its least name, else its query's hub, else itself
    with_name = rec.filter("size(names) > 0").select("id", F.concat(F.lit("n:"), F.get("names", F.lit(0))).alias("hub"))
    without = rec.filter("size(names) = 0").select("id", F.concat(F.lit("q:"), "q").alias("via"))
    without = without.join(hubs, "via", "left").select("id", F.coalesce("hub", "via").alias("hub"))
    placed = with_name.unionByName(without).join(roots, F.col("hub") == F.col("node"), "left").select("id", F.coalesce("root", "hub").alias("root"))
    placed = cut(placed.groupBy("id").agg(F.coalesce(F.min("root"), F.concat(F.lit("i:"), F.col("id").cast("string"))).alias("root")))
    least = placed.groupBy("root").agg(F.min("id").alias("group_id"))
    return placed.join(least, "root").select("id", "group_id")


def min_cost_flow(n: int, arcs: list[tuple[int, int, float, float]], source: int, sink: int) -> list[float]:
    """Flow on each arc (from, to, capacity, cost) of a maximum flow of least cost.

    Primal-dual: one Dijkstra for each different path cost, then all paths of that cost at once by a depth-first search
    over the arcs without reduced cost, so the number of searches doesn't grow with the number of bundles.
    """
    eps = 1e-7
    to, cap, cost, out = [], [], [], [[] for _ in range(n)]
    for u, v, c, w in arcs:
        for a, b, x, y in ((u, v, float(c), float(w)), (v, u, 0.0, -float(w))):
            out[a].append(len(to))
            to.append(b)
            cap.append(x)
            cost.append(y)
    pot = [0.0] * n
    while True:
        dist, heap = [float("inf")] * n, [(0.0, source)]
        dist[source] = 0.0
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u] + eps:
                continue
            for e in out[u]:
                if cap[e] > eps and (x := d + cost[e] + pot[u] - pot[to[e]]) < dist[to[e]] - eps:
                    dist[to[e]] = x
                    heapq.heappush(heap, (x, to[e]))
        if dist[sink] == float("inf"):
            return [cap[2 * i + 1] for i in range(len(arcs))]
        pot = [p + min(d, dist[sink]) for p, d in zip(pot, dist)]
        at, path, on_path = [0] * n, [], {source}
        u = source
        while True:
            if u == sink:
                push = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= push
                    cap[e ^ 1] += push
                path, on_path, u = [], {source}, source
                continue
            while at[u] < len(out[u]):
                e = out[u][at[u]]
                if cap[e] > eps and to[e] not in on_path and abs(cost[e] + pot[u] - pot[to[e]]) < eps:
                    break
                at[u] += 1
            if at[u] < len(out[u]):
                path.append(out[u][at[u]])
                u = to[path[-1]]
                on_path.add(u)
            elif path:
                on_path.discard(u)
                u = to[path.pop() ^ 1]
                at[u] += 1
            else:
                break


def allocate(bundles: list[tuple[int, str, int]], shares: dict[str, float]) -> list[list[int]]:
    """Components of each bundle (size, label, count) that go to each split.

    Flow network in records: source -> bundle -> split -> sink. A bundle's arc to a split costs nothing up to the split's
    share of it, one beyond; a split's arc to the sink costs nothing up to its quota, ten beyond. A component larger than
    a split's quota may not go there. The flow is rounded down to whole components; those left, largest first, go to the
    split with the largest deficit, so the total deviates by at most about the largest component.
    """
    splits = list(shares)
    total = sum(s * c for s, _, c in bundles)
    quota = {k: shares[k] * total for k in splits}
    nb = len(bundles)
    source, sink = nb + len(splits), nb + len(splits) + 1
    largest = max(splits, key=lambda k: shares[k])
    arcs, of = [], []
    for i, (size, _, count) in enumerate(bundles):
        arcs.append((source, i, size * count, 0.0))
        of.append(None)
        for j, k in enumerate(splits):
            if size <= quota[k] or k == largest:
                arcs.append((i, nb + j, shares[k] * size * count, 0.0))
                arcs.append((i, nb + j, size * count, 1.0))
                of += [(i, j), (i, j)]
    for j, k in enumerate(splits):
        arcs += [(nb + j, sink, quota[k], 0.0), (nb + j, sink, total, 10.0)]
        of += [None, None]
    flow = min_cost_flow(nb + len(splits) + 2, arcs, source, sink)
    got = [[0] * len(splits) for _ in bundles]
    for e, f in enumerate(flow):
        if of[e]:
            got[of[e][0]][of[e][1]] += f
    whole = [[int(f / bundles[i][0] + 1e-6) for f in row] for i, row in enumerate(got)]
    lack = [quota[k] - sum(whole[i][j] * bundles[i][0] for i in range(nb)) for j, k in enumerate(splits)]
    for i in sorted(range(nb), key=lambda i: (-bundles[i][0], bundles[i][1])):
        for _ in range(bundles[i][2] - sum(whole[i])):
            j = max(range(len(splits)), key=lambda j: (lack[j], -j))
            whole[i][j] += 1
            lack[j] -= bundles[i][0]
    return whole


def group_splits(df: DataFrame, targets: DataFrame, key: str = "request_id", query: str = "query", name: str = "name", label: str = "sample_source") -> DataFrame:
    """Columns key, group_id, split. A component's label profile is its most frequent label.

    Only the bundle table comes to the driver: sizes of components times labels, at most about sqrt(2 * records) * labels
    rows, as there can't be more different sizes.
    """
    groups = cut(related_groups(df, key, query, name))
    one = df.select(F.col(key).alias("id"), F.col(label).alias("label")).groupBy("id").agg(F.coalesce(F.min("label"), F.lit("")).alias("label"))
    by_label = groups.join(one, "id").groupBy("group_id", "label").agg(F.count(F.lit(1)).alias("n"))
    comps = by_label.groupBy("group_id").agg(F.sum("n").alias("size"), F.max_by("label", F.struct("n", "label")).alias("label"))
    comps = cut(comps)
    bundles = [(r["size"], r["label"], r["count"]) for r in comps.groupBy("size", "label").count().orderBy("size", "label").collect()]
    shares = {r["split"]: r["proportion"] for r in targets.select("split", "proportion").collect()}
    rows, splits = [], list(shares)
    for (size, lab, _), counts in zip(bundles, allocate(bundles, shares) if bundles else []):
        upto = 0
        for j, c in enumerate(counts):
            if c:
                rows.append((size, lab, upto, upto + c, splits[j]))
                upto += c
    cuts = df.sparkSession.createDataFrame(rows, "size bigint, label string, after bigint, upto bigint, split string")
    ranked = exact_rank(comps, ["size", "label"], ["group_id"], "rank")
    # as many rows as bundles times splits, bounded as above
    chosen = ranked.join(cuts, ["size", "label"]).filter("rank > after and rank <= upto").select("group_id", "split")
    return groups.join(chosen, "group_id").select(F.col("id").alias(key), "group_id", "split")
