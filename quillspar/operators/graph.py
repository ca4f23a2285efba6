"""Import graphs: cycles, walks, roll-ups and flows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspar.functions import rules, text
from quillspar.session import drop_table, write_table

MOST_CYCLES, LONGEST = 50, 20


def back_edges(order: list[str], out: dict[str, list[str]]) -> list[list[str]]:
    """A path, from a node back to itself, for each back edge of a depth-first search in the given order."""
    done: set[str] = set()
    found: list[list[str]] = []
    for root in order:
        if root in done:
            continue
        path, on_path, todo = [root], {root: 0}, [iter(out.get(root, ()))]
        while todo:
            for nxt in todo[-1]:
                if nxt in on_path:
                    cycle = [*path[on_path[nxt] :], nxt]
                    if len(cycle) <= LONGEST:
                        found.append(cycle)
                    if len(found) >= MOST_CYCLES:
                        return found
                elif nxt not in done:
                    on_path[nxt] = len(path)
                    path.append(nxt)
                    todo.append(iter(out.get(nxt, ())))
                    break
            else:
                todo.pop()
                node = path.pop()
                del on_path[node]
                done.add(node)
    return found


def _met(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join by shuffle whatever its sides' sizes: many rounds of small broadcasts would add up on the driver."""
    return left.join(right.hint("merge"), on, how)


def _least_ahead(edges: DataFrame, seed: int) -> DataFrame:
    """(node, least): of all nodes from which a path leads to a node, itself included, the one of least rank.

    Ranks are hashes by `seed`. What is known spreads along the edges and jumps: the least of a node's least counts too,
    so a long path takes about as many rounds as its length has bits.
    """
    own = lambda c: F.struct(F.xxhash64(F.lit(seed), c).alias("rank"), F.col(c).alias("node"))
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    known = write_table(ends.select("node", own("node").alias("least"), F.lit(True).alias("moved")), "least")
    while True:
        ahead = _met(edges, known, edges["src"] == known["node"]).select(F.col("dst").alias("node"), "least")
        spread = known.select("node", "least", F.col("least").alias("old")).unionByName(ahead, allowMissingColumns=True)
        spread = spread.groupBy("node").agg(F.min("least").alias("least"), F.max("old").alias("old"))
        via = known.select(F.col("node").alias("_via"), F.col("least").alias("_least"))
        jumped = _met(spread, via, spread["least"]["node"] == via["_via"], "left").select("node", F.least("least", "_least").alias("least"), "old")
        now = write_table(jumped.select("node", "least", (F.col("least") != F.col("old")).alias("moved")), "least")
        settled = now.filter("moved").isEmpty()
        drop_table(known)
        known = now
        if settled:
            return known.drop("moved")


def strong_components(edges: DataFrame, trims: int = 2) -> DataFrame:
    """(node, root, size) of the nodes that lie on a cycle of edges (src, dst): their strongly connected component's least node and size.

    In each round every node learns the node of least random rank that leads to it, and that it leads to. Where both are
    one, the node is of that one's component; edges whose ends learned different nodes lie on no cycle. The random ranks
    cut what is left near its middle, so some log2(nodes) rounds do. Before a round, nodes that nothing enters or
    leaves go, a few times. A node with an edge to itself is on a cycle. Nulls are no nodes.
    """
    whole = write_table(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct(), "edges")
    found = write_table(whole.filter("src = dst").select(F.col("src").alias("node"), F.col("src").alias("root")), "loops")
    loops = found.select("node", F.lit(True).alias("loop"))
    left, seed, used = whole.filter("src <> dst"), 0, [whole]
    while True:
        for _ in range(trims):
            left = _met(_met(left, left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"), left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        left = write_table(left.select("src", "dst"), "left")
        for df in used:
            drop_table(df)
        if left.isEmpty():
            break
        to = _least_ahead(left, seed)
        back = _least_ahead(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")), seed)
        both = write_table(_met(to.select("node", F.col("least.node").alias("to")), back.select("node", F.col("least.node").alias("back")), "node"), "both")
        done = both.filter("to = back").select("node", F.col("to").alias("root"))
        found = found.unionByName(write_table(done, "found"))
        open_ = both.filter("to <> back")
        ends = [open_.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}"), F.col("back").alias(f"back_{c}")) for c in ("src", "dst")]
        kept = _met(_met(left, ends[0], "src"), ends[1], "dst").filter("to_src = to_dst AND back_src = back_dst")
        kept = write_table(kept.select("src", "dst"), "left")
        for df in (to, back, both, left):
            drop_table(df)
        left, seed, used = kept, seed + 1, [kept]
    # a looped node may have been found twice, and a node alone in its component is on no cycle but its own loop
    sized = found.groupBy("root").agg(F.count_distinct("node").alias("size"), F.min("node").alias("least"))
    every = _met(_met(found, sized, "root"), loops, "node", "left").filter("size > 1 OR loop")
    return every.groupBy("node").agg(F.max_by(F.struct("least", "size"), "size").alias("c")).select("node", F.col("c.least").alias("root"), F.col("c.size").alias("size"))


def cycles(edges: DataFrame) -> DataFrame:
    """(repo, n, cycle) of edges (repo, src, dst, ord): depth-first inside each strongly connected component.

    Components come in the order of their first edges, and a component is walked from the source of its first edge; of a
    repository the first MOST_CYCLES cycles are given. A group is a component, not a repository.
    """
    named = edges.select(F.struct("repo", F.col("src").alias("key")).alias("src"), F.struct("repo", F.col("dst").alias("key")).alias("dst"), "ord")
    parts = strong_components(named).select("node", "root")
    inner = named.join(parts.select(F.col("node").alias("src"), "root"), "src").join(parts.select(F.col("node").alias("dst"), F.col("root").alias("dst_root")), "dst").filter("root = dst_root")
    inner = inner.select(F.col("src.repo").alias("repo"), F.col("root.key").alias("root"), F.col("src.key").alias("src"), F.col("dst.key").alias("dst"), "ord")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        out: dict[str, list[str]] = {}
        for s, d in zip(pdf["src"], pdf["dst"], strict=True):
            out.setdefault(s, []).append(d)
            out.setdefault(d, [])
        found = back_edges(list(out), out)
        return pd.DataFrame({"repo": [pdf["repo"].iloc[0]] * len(found), "at": [int(pdf["ord"].iloc[0])] * len(found), "n": range(len(found)), "cycle": [" > ".join(c) for c in found]})

    walked = inner.groupBy("repo", "root").applyInPandas(run, "repo string, at long, n long, cycle string")
    place = F.row_number().over(Window.partitionBy("repo").orderBy("at", "n")).cast("long") - 1
    return walked.withColumn("n", place).filter(F.col("n") < MOST_CYCLES).select("repo", "n", "cycle")


def reachable(edges: DataFrame, hops: int) -> DataFrame:
    """(src, dst): pairs joined by a path of up to `hops` edges, by doubling."""
    pairs = edges.select("src", "dst").distinct()
    while hops > 1:
        step = pairs.alias("a").join(pairs.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"))
        pairs = pairs.union(step).distinct()
        hops = (hops + 1) // 2
    return pairs


def greedy_walks(starts: DataFrame, edges: DataFrame, hops: int = 6) -> DataFrame:
    """(start, chain): from each start to the unvisited target with most importers, up to `hops` times; ties by edge order.

    edges: (src, dst, ord).
    """
    fan = edges.groupBy(F.col("dst").alias("dst")).agg(F.count("*").alias("fan_in"))
    out = edges.join(fan, "dst").select("src", "dst", "ord", "fan_in")
    walks = starts.select(F.col("key").alias("start"), F.array("key").alias("chain"))
    pick = Window.partitionBy("start").orderBy(F.col("dst").isNull(), F.desc("fan_in"), "ord")
    for _ in range(hops):
        ahead = walks.withColumn("src", F.element_at("chain", -1)).join(out, "src", "left")
        fresh = ahead.withColumn("dst", F.when(~F.array_contains("chain", F.col("dst")), F.col("dst")))
        best = fresh.withColumn("rank", F.row_number().over(pick)).filter("rank = 1")
        walks = best.select("start", F.when(F.col("dst").isNotNull(), F.array_append("chain", F.col("dst"))).otherwise(F.col("chain")).alias("chain"))
    return walks


def entry_points(measured: DataFrame) -> DataFrame:
    """Nodes (key, fan_in, fan_out) that begin flows: by name or without importers, two imports at least; two tests, five in all."""
    k = F.lower("key")
    named = k.contains("bin/") | k.contains("cli") | k.endswith("/index") | k.contains("pages/") | k.contains("app/") | (F.col("fan_in") == 0)
    test = k.contains("test")
    order = Window.partitionBy("is_test").orderBy(F.desc("fan_out"), "key")
    picked = measured.filter(named & (F.col("fan_out") >= 2)).withColumn("is_test", test).withColumn("rank", F.row_number().over(order))
    return picked.filter("NOT is_test OR rank <= 2").orderBy("is_test", F.desc("fan_out"), "key").limit(5)


def step_kind(position: Column, fan_in: Column, fan_out: Column) -> Column:
    return F.when(position == 0, "entry").when(fan_in >= 5, "shared").when(fan_out == 0, "leaf").otherwise("step")


def rolled_up(edges: DataFrame) -> DataFrame:
    """(src, dst, weight, type) between modules, from edges with src_module and dst_module."""
    apart = edges.filter("src_module IS NOT NULL AND dst_module IS NOT NULL AND src_module <> dst_module")
    counted = apart.groupBy(F.col("src_module").alias("src"), F.col("dst_module").alias("dst")).agg(F.count("*").alias("weight"))
    return counted.withColumn("type", F.when(text.first_match(F.col("dst"), rules.MAP_CATEGORIES, "other") == "test", "tests").otherwise("imports"))


FLOWS = (("Market Data Flow", ("stock", "market", "chart"), True), ("Authentication Flow", ("auth", "login", "session"), True), ("Content Delivery Flow", ("article", "content", "newsletter"), False))


def keyword_flows(modules: DataFrame) -> DataFrame:
    """(name, critical, modules): flows whose keywords a module's key holds, with these modules; modules: (key)."""
    k = F.lower("key")
    hits = F.array_compact(F.array(*[F.when(text.any_of([k.contains(x) for x in words]), F.struct(F.lit(name).alias("name"), F.lit(critical).alias("critical"))) for name, words, critical in FLOWS]))
    return modules.select("key", F.explode(hits).alias("f")).groupBy("f.name", "f.critical").agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("modules"))

