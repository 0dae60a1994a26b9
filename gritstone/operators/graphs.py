"""Graphs as edge lists, many small ones or one large one: edges from blocks, reachability, dominators, metrics.

Iterations write each round to the shared folder named in ``spark.checkpoint.dir``, so that the plan does
not grow and a lost executor costs one round.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from gritstone.functions.scalars import potency
from gritstone.functions.walks import dominator_tree, following, in_postorder, led_to
from gritstone.operators.aggregates import graph_size
from gritstone.operators.parsing import TAGS, blocks_of, code_blocks, in_slices
from gritstone.sources.scratch import cut_lineage, discard

MOST_TABLES = 16
SMALL = 1_000_000  # steps of a graph that one task walks


def build_edges(blocks: DataFrame) -> DataFrame:
    """G1: code_id, src, dst, kind from blocks: code_id, node, kind (Entry, Exit, Body), start_pc, control(tag, target, false_target).

    Entry goes to the first body block. Terminal goes to the exit, Fallthrough to the next block or the
    exit, Jump to a known target, Branch to its known target (BranchTrue) and to the next block or the exit
    (BranchFalse); an unknown target or tag gives no edge. Entry is node 0 and exit node 1.
    """
    w = Window.partitionBy("code_id").orderBy("start_pc")
    body = blocks.filter("kind = 'Body'").withColumn("_next", F.coalesce(F.lead("node").over(w), F.lit(1))).withColumn("_first", F.row_number().over(w) == 1)
    tag, target = F.col("control.tag"), F.col("control.target")
    edge = lambda src, dst, kind, when: F.when(when, F.struct(F.lit(src).alias("src") if isinstance(src, int) else src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind")))
    node = F.col("node")
    found = F.array(
        edge(0, node, "Fallthrough", F.col("_first")),
        edge(node, F.lit(1), "Fallthrough", tag == "Terminal"),
        edge(node, F.col("_next"), "Fallthrough", tag == "Fallthrough"),
        edge(node, target, "Jump", (tag == "Jump") & target.isNotNull()),
        edge(node, target, "BranchTrue", (tag == "Branch") & target.isNotNull()),
        edge(node, F.col("_next"), "BranchFalse", tag == "Branch"),
    )
    return body.select("code_id", F.inline(F.array_compact(found)))


def pointers_home(chain: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """(by, node, top) for links (by, node, top) of nodes to others: followed until a node without a link, by doubling. Second: those that never get there, as they lead into a circle."""
    chain = cut_lineage(chain.select(by, "node", "top"))
    rounds = max(1, chain.count()).bit_length() + 1
    for _ in range(rounds):
        hop = chain.select(by, F.col("node").alias("top"), F.col("top").alias("_on"))
        if chain.join(hop, [by, "top"], "left_semi").isEmpty():
            break
        step = cut_lineage(chain.join(hop, [by, "top"], "left").select(by, "node", F.coalesce("_on", "top").alias("top")))
        discard(chain)
        chain = step
    links = chain.select(by, F.col("node").alias("top"))
    return chain.join(links, [by, "top"], "left_anti"), chain.join(links, [by, "top"], "left_semi")


def regions(edges: DataFrame, roots: DataFrame, by: str) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """Graphs (by, src, dst) drawn together: a node, no root, that only one other leads to joins that one, until none is left.

    First, for each round, (by, node, top): which nodes joined and whom they belong to then; what joined these before
    belongs to it too. Second, (by, node, via): the smallest node of the first graph that leads to each of them. Third, what is
    left: (by, src, dst, via). A chain joins in one round by doubling, a loop once its body has joined its head, so rounds
    follow how deep loops are nested, not how long ways are. Circles that nothing leads to are dropped.
    """
    start = roots.select(by, F.col("node").alias("dst")).distinct()
    left = cut_lineage(edges.filter("src <> dst").select(by, "src", "dst", F.col("src").alias("via")).distinct())
    joined: list[DataFrame] = []
    via: list[DataFrame] = []
    while True:
        single = left.groupBy(by, "dst").agg(F.min("src").alias("top"), F.max("src").alias("_most"), F.min("via").alias("via")).filter("top = _most")
        single = cut_lineage(single.join(start, [by, "dst"], "left_anti").select(by, F.col("dst").alias("node"), "top", "via"))
        if single.isEmpty():
            return joined, via, left
        home, lost = pointers_home(single, by)
        home, lost = cut_lineage(home), cut_lineage(lost)
        joined.append(home)
        via.append(single.select(by, "node", "via"))
        gone = home.unionByName(lost).select(by, "node")
        rest = left.join(gone.withColumnRenamed("node", "dst"), [by, "dst"], "left_anti").join(lost.select(by, F.col("node").alias("src")), [by, "src"], "left_anti")
        moved = rest.join(home.select(by, F.col("node").alias("src"), "top"), [by, "src"], "left").select(by, F.coalesce("top", "src").alias("src"), "dst", "via")
        step = cut_lineage(moved.filter("src <> dst").groupBy(by, "src", "dst").agg(F.min("via").alias("via")))
        discard(left)
        left = step


def each_small(edges: DataFrame, start: DataFrame, by: str, limit: int, name: str, walk: Callable[[list[tuple], list], list[tuple]]) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(by, node, ``name``) that ``walk`` gives for the graphs (by, src, dst) with roots ``start`` (by, node) of at most ``limit`` steps: edges times roots.

    Each of these is walked in a task, as its size is checked. Second, the edges of the larger ones, None if there are none; third, their roots.
    """
    kind = start.schema["node"].dataType
    rows = cut_lineage(edges.select(by, F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst")).distinct().unionByName(start.select(by, F.col("node").alias("src"), F.lit(None).cast(kind).alias("dst"))))
    is_root = F.col("dst").isNull()
    steps = rows.groupBy(by).agg((F.count_if(~is_root) * F.count_if(is_root)).alias("steps"))
    large = cut_lineage(steps.filter(F.col("steps") > limit).select(by))
    none_large = large.isEmpty()
    small = rows if none_large else rows.join(large, by, "left_anti")
    schema = StructType([edges.schema[by], StructField("node", kind), StructField(name, kind)])
    arrow = to_arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        src, dst = table["src"].to_pylist(), table["dst"].to_pylist()
        found = walk([(a, b) for a, b in zip(src, dst, strict=True) if b is not None], [a for a, b in zip(src, dst, strict=True) if b is None])
        own = table[by][0].as_py()
        return pa.Table.from_arrays([pa.array([own] * len(found), arrow.field(0).type), *(pa.array([x[k] for x in found], arrow.field(1 + k).type) for k in (0, 1))], schema=arrow)

    out = small.groupBy(by).applyInArrow(run, schema)
    if none_large:
        return out, None, start
    rest = rows.join(large, by, "left_semi")
    return out, rest.filter(~is_root), rest.filter(is_root).select(by, F.col("src").alias("node"))


def ways_of(edges: list[tuple], roots: list) -> list[tuple]:
    after = following(edges)
    return [(x, root) for root in roots for x in in_postorder(after, root)]


def trees_of(edges: list[tuple], roots: list) -> list[tuple]:
    return [pair for root in roots for pair in dominator_tree(edges, root).items()]


def reachable(edges: DataFrame, roots: DataFrame, by: str = "code_id", node: str = "node", max_rounds: int = 10_000, limit: int = SMALL) -> DataFrame:
    """(by, root, node): everything reachable from each root, itself included; cycles end by themselves.

    Graphs of at most ``limit`` steps (edges times roots) are walked each in a task. Larger ones are drawn together first
    (``regions``), so rounds follow neither the length of chains nor loops; what is left is searched a level a round, and
    then the nodes that joined come back, the last ones first.
    """
    start = roots.select(by, F.col(node).alias("node")).distinct()
    small, edges, start = each_small(edges, start, by, limit, "root", ways_of)
    out = small.select(by, "root", F.col("node").alias(node))
    return out if edges is None else out.unionByName(reachable_by_rounds(edges, start, by, node, max_rounds))


def reachable_by_rounds(edges: DataFrame, start: DataFrame, by: str, node: str, max_rounds: int) -> DataFrame:
    joined, _, left = regions(edges, start, by)
    step = left.select(by, F.col("src").alias("_at"), F.col("dst").alias("node"))
    rounds = [cut_lineage(start.select(by, F.col("node").alias("root"), "node"))]
    for _ in range(max_rounds):
        seen = functools.reduce(DataFrame.unionByName, rounds)
        further = rounds[-1].withColumnRenamed("node", "_at").join(step, [by, "_at"]).select(by, "root", "node").distinct()
        new = cut_lineage(further.join(seen, [by, "root", "node"], "left_anti"))
        if new.isEmpty():
            break
        rounds.append(new)
        if len(rounds) == MOST_TABLES:  # few files a round, and a short plan
            rounds = [cut_lineage(functools.reduce(DataFrame.unionByName, rounds[:-1])), new]
    else:
        raise RuntimeError(f"not closed after {max_rounds} rounds")
    found = seen
    for members in reversed(joined):
        found = cut_lineage(found.unionByName(found.select(by, "root", F.col("node").alias("top")).join(members, [by, "top"]).select(by, "root", "node")))
    return found.select(by, "root", F.col("node").alias(node))


def lifted(tree: DataFrame, by: str) -> tuple[DataFrame, int]:
    """(by, node, depth, up) of trees (by, node, parent; a root's parent is itself), and how many entries ``up`` has: ancestors 1, 2, 4, ... steps up, the root where there are fewer."""
    table = cut_lineage(tree.select(by, "node", F.col("parent").alias("_at"), F.array("parent").alias("up"), (F.col("parent") != F.col("node")).cast("int").alias("depth")))
    size = 1
    while True:
        hop = table.select(by, F.col("node").alias("_at"), F.col("_at").alias("_on"), F.col("depth").alias("_more"))
        step = cut_lineage(table.join(hop, [by, "_at"]).select(by, "node", F.col("_on").alias("_at"), F.array_append("up", F.col("_on")).alias("up"), (F.col("depth") + F.col("_more")).alias("depth"), F.col("_more")))
        size += 1
        done = step.filter("_more > 0").isEmpty()
        discard(table)
        table = step.drop("_more")
        if done:
            return table.select(by, "node", "depth", "up"), size


def nearest_common(cursors: DataFrame, tree: DataFrame, size: int, by: str) -> DataFrame:
    """(by, node, common): the nearest common ancestor of each node's cursors (by, node, at; at least one) in lifted trees.

    In a round, cursors deeper than the highest of their node go up as far as they can towards it; cursors of one depth
    that differ go up as far as they still differ. So rounds follow the logarithm of the depth.
    """
    done: list[DataFrame] = []
    while True:
        met = cut_lineage(cursors.join(tree.select(by, F.col("node").alias("at"), "depth", "up"), [by, "at"]))
        sides = [c for k in range(size) for c in (F.min(F.col("up")[k]).alias(f"_lo{k}"), F.max(F.col("up")[k]).alias(f"_hi{k}"))]
        sums = cut_lineage(met.groupBy(by, "node").agg(F.min("at").alias("_lo"), F.max("at").alias("_hi"), F.min("depth").alias("_top"), F.max("depth").alias("_low"), *sides))
        one = F.col("_lo") == F.col("_hi")
        level = F.col("_top") == F.col("_low")
        parent = F.col("_lo0") == F.col("_hi0")
        done.append(cut_lineage(sums.filter(one | (level & parent)).select(by, "node", F.when(one, F.col("_lo")).otherwise(F.col("_lo0")).alias("common"))))
        apart = F.coalesce(*(F.when(F.col(f"_lo{k}") != F.col(f"_hi{k}"), F.lit(k)) for k in range(size - 1, -1, -1)), F.lit(0))
        open_ = sums.filter(~(one | (level & parent))).select(by, "node", "_top", "_low", apart.alias("_apart"))
        rest = met.join(open_, [by, "node"])
        steps = F.when(F.col("_top") == F.col("_low"), F.col("_apart")).otherwise(F.floor(F.log2((F.col("depth") - F.col("_top")).cast("double") + 0.5)).cast("int"))
        at = F.when((F.col("_top") < F.col("_low")) & (F.col("depth") == F.col("_top")), F.col("at")).otherwise(F.get("up", steps))
        new = cut_lineage(rest.select(by, "node", at.alias("at")).distinct())
        discard(met, sums)
        cursors = new
        if new.isEmpty():
            return functools.reduce(DataFrame.unionByName, done)


def immediate_dominators(edges: DataFrame, roots: DataFrame, by: str = "code_id", reverse: bool = False, max_rounds: int = 10_000, limit: int = SMALL) -> DataFrame:
    """(by, node, idom) for what each graph's root (one a graph) reaches; the root's idom is null. reverse: post-dominators.

    Graphs of at most ``limit`` edges are walked each in a task; larger ones together in rounds. For those a tree of ways from the root comes first (``regions``; a level a round for what those leave). In
    it every node's dominators lie above it. Then each node with several predecessors moves up to their nearest common
    ancestor, found by doubled pointers, until nothing moves: then a node's parent lies above all its predecessors, which only
    dominators do. A row holds as many ancestors as the depth has binary digits.
    """
    e = edges.select(by, F.col("dst").alias("src"), F.col("src").alias("dst")) if reverse else edges.select(by, "src", "dst")
    small, e, start = each_small(e, roots.select(by, "node").distinct(), by, limit, "idom", trees_of)
    return small if e is None else small.unionByName(dominators_by_rounds(e, start, by, max_rounds))


def dominators_by_rounds(e: DataFrame, start: DataFrame, by: str, max_rounds: int) -> DataFrame:
    reach = cut_lineage(reachable_by_rounds(e, start, by, "node", max_rounds).select(by, "node").distinct())
    e = cut_lineage(e.filter("src <> dst").distinct().join(reach.withColumnRenamed("node", "src"), [by, "src"]).join(start.withColumnRenamed("node", "dst"), [by, "dst"], "left_anti"))
    _, via, left = regions(e, start, by)
    trees = [start.select(by, "node", F.col("node").alias("parent")), *(v.select(by, "node", F.col("via").alias("parent")) for v in via)]
    level = seen = start.select(by, "node")
    for _ in range(max_rounds):
        found = left.join(level.withColumnRenamed("node", "src"), [by, "src"]).join(seen.withColumnRenamed("node", "dst"), [by, "dst"], "left_anti")
        new = cut_lineage(found.groupBy(by, F.col("dst").alias("node")).agg(F.min("via").alias("parent")))
        if new.isEmpty():
            break
        trees.append(new)
        level = new.select(by, "node")
        seen = cut_lineage(seen.unionByName(level))
    tree = cut_lineage(functools.reduce(DataFrame.unionByName, trees))
    several = e.groupBy(by, "dst").agg(F.min("src").alias("_a"), F.max("src").alias("_b")).filter("_a <> _b").select(by, "dst")
    ways = cut_lineage(e.join(several, [by, "dst"]).select(by, F.col("dst").alias("node"), F.col("src").alias("at")))
    for _ in range(max_rounds if not ways.isEmpty() else 0):
        table, size = lifted(tree, by)
        moved = nearest_common(ways, table, size, by).join(tree, [by, "node"]).filter("common <> parent").select(by, "node", "common")
        moved = cut_lineage(moved)
        if moved.isEmpty():
            break
        step = cut_lineage(tree.join(moved, [by, "node"], "left").select(by, "node", F.coalesce("common", "parent").alias("parent")))
        discard(tree, table)
        tree = step
    return tree.select(by, "node", F.when(F.col("parent") != F.col("node"), F.col("parent")).alias("idom"))


def dominator_overlap(dom: DataFrame, pdom: DataFrame, by: str = "code_id") -> DataFrame:
    """Share of the nodes with an immediate dominator whose immediate post-dominator is the same node; 0 if there is none."""
    both = dom.filter("idom is not null").join(pdom.select(by, "node", F.col("idom").alias("ipdom")), [by, "node"], "left")
    one = both.groupBy(by).agg((F.count_if(F.col("idom").eqNullSafe(F.col("ipdom"))) / F.count("*")).alias("overlap"))
    return dom.select(by).distinct().join(one, by, "left").select(by, F.coalesce("overlap", F.lit(0.0)).alias("overlap"))


def graph_metrics(codes: DataFrame, blocks: DataFrame, edges: DataFrame, exit_root: str = "last") -> DataFrame:
    """code_id, byte_len, blocks, edges, max_stack, overlap, potency. exit_root: post-dominators start from the ``last`` node or from the ``exit``."""
    size = graph_size(blocks, edges)
    entry = blocks.filter("kind = 'Entry'").select("code_id", "node")
    last = blocks.groupBy("code_id").agg(F.max("node").alias("node")) if exit_root == "last" else blocks.filter("kind = 'Exit'").select("code_id", "node")
    overlap = dominator_overlap(immediate_dominators(edges, entry), immediate_dominators(edges, last, reverse=True))
    joined = codes.select("code_id", F.length("code").alias("byte_len")).join(size, "code_id").join(overlap, "code_id", "left").withColumn("overlap", F.coalesce("overlap", F.lit(0.0)))
    return joined.filter("ok").select("code_id", "byte_len", "blocks", "edges", "max_stack", "overlap", potency(F.col("overlap"), F.col("blocks") + 2, F.col("edges")).alias("potency"))


def overlap_of(after: tuple[list[int], list[int]], before: tuple[list[int], list[int]], entry: int, last: int) -> float:
    """G4 of one graph, whose edges ``after`` and ``before`` have from either end, as ``led_to`` takes them."""
    up = {x: d for x, d in dominator_tree(led_to(*after, entry), entry).items() if d is not None}
    down = dominator_tree(led_to(*before, last), last)
    return sum(down.get(x) == d for x, d in up.items()) / len(up) if up else 0.0


def code_metrics(codes: DataFrame, exit_root: str = "last", limit: int = SMALL) -> DataFrame:
    """``graph_metrics`` of whole codes in one narrow pass: blocks, edges and dominators of a code are found in its task.

    Graphs of more than ``limit`` edges are only counted there; their overlap comes from ``graph_metrics``, in rounds.
    """

    def build(ids: pa.Array, codes: pa.Array) -> pa.RecordBatch:
        b = blocks_of(codes)
        n_blocks = np.bincount(b.own, minlength=len(b.sizes))
        base = np.cumsum(n_blocks + 2) - n_blocks - 2  # nodes of all codes have one numbering: each code's entry, exit, blocks
        node = base[b.own] + b.node
        begins = np.append(True, b.own[1:] != b.own[:-1])[: len(node)]
        further = np.where(np.append(begins[1:], True)[: len(node)], base[b.own] + 1, node + 1)
        jump, branch, terminal, fall = (b.kind == TAGS.index(x) for x in ("Jump", "Branch", "Terminal", "Fallthrough"))
        goes, on = jump | branch, branch | fall
        src = np.concatenate([base[b.own[begins]], node[terminal], node[goes], node[on]])
        dst = np.concatenate([node[begins], base[b.own[terminal]] + 1, base[b.own[goes]] + b.target[goes], further[on]])
        n_edges = n_blocks.astype(bool) + np.bincount(b.own[~(b.kind == 0)], minlength=len(b.sizes)) + np.bincount(b.own[branch], minlength=len(b.sizes))

        def side(a: np.ndarray, z: np.ndarray) -> tuple[list[int], list[int]]:
            order = np.argsort(a, kind="stable")
            return z[order].tolist(), np.searchsorted(a[order], np.arange(int(np.sum(n_blocks + 2)) + 1)).tolist()

        after, before = side(src, dst), side(dst, src)
        with_body = np.flatnonzero(n_blocks)
        overlap = [
            overlap_of(after, before, entry, entry + (1 if exit_root == "exit" else n + 1)) if edges <= limit else None
            for entry, n, edges in zip(base[with_body].tolist(), n_blocks[with_body].tolist(), n_edges[with_body].tolist(), strict=True)
        ]
        most = np.maximum.reduceat(b.deepest, np.flatnonzero(begins)) if len(node) else b.deepest
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(with_body)), pa.array(b.sizes[with_body].astype(np.int32)), pa.array(n_blocks[with_body]), pa.array(n_edges[with_body]), pa.array(most.astype(np.int32)), pa.array(overlap, pa.float64())],
            names=["code_id", "byte_len", "blocks", "edges", "max_stack", "overlap"],
        )

    rows = cut_lineage(in_slices(codes, build, "code_id long, byte_len int, blocks long, edges long, max_stack int, overlap double", "code_id", "code"))
    out = rows.withColumn("potency", potency(F.col("overlap"), F.col("blocks") + 2, F.col("edges")))
    large = rows.filter("overlap is null").select("code_id")
    if large.isEmpty():
        return out
    rest = cut_lineage(codes.join(large, "code_id", "left_semi"))
    blocks = cut_lineage(code_blocks(rest))
    return out.filter("overlap is not null").unionByName(graph_metrics(rest, blocks, cut_lineage(build_edges(blocks)), exit_root))
