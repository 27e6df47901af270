"""Splits that keep related records together.

Rows that share a writer (in ``id``) or an account (in ``input``), directly or through others, form a group. The nodes
of the graph are writers and accounts, coded as whole numbers without collisions; a row links its keys. Borůvka's
algorithm contracts it: each component takes its least edge, components joined by these edges become one, and edges
inside a component go. The edges taken are the spanning forest, kept in a table. A round at least halves the
components that still have edges; its roots are led to those of later rounds at the end. Every step is a join or an
aggregation with partial sums, so a key or a component of any size is never gathered.

Rows with neither key are groups of their own. Nulls have no key, repeated rows are members like any other, an empty table has no group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.text import side
from sieveline.operators.priority import priority
from sieveline.session import cut, cut_counted, written

WRITER = r"(?<![\p{L}\p{N}])[wW]([0-9]{8})(?!\p{N})"
ACCOUNT = r"(?<![\p{L}\p{N}])[A-Za-z]{2}[^\p{L}\p{N}]*+[0-9]{6}(?![\p{L}\p{N}])"
PROPORTIONS = (("train", 80), ("validation", 10), ("test", 10))
#: Groups dealt in one window partition.
DEALT = 100_000


def keyed(rows: DataFrame) -> DataFrame:
    """(row_id, side, keys): writers as their number, accounts as 10^8 plus letters and number in base 26 and 10."""
    writers = F.transform(F.coalesce(F.regexp_extract_all("id", F.lit(WRITER), 1), F.array().cast("array<string>")), lambda w: w.cast("long"))
    found = F.coalesce(F.regexp_extract_all("input", F.lit(ACCOUNT), 0), F.array().cast("array<string>"))

    def code(text):
        letter = lambda k: F.ascii(F.upper(F.substring(text, k, 1))).cast("long") - 65
        return F.lit(100_000_000) + (letter(1) * 26 + letter(2)) * 1_000_000 + F.right(text, F.lit(6)).cast("long")

    return rows.select("row_id", side(F.col("split")).alias("side"), F.array_distinct(F.concat(writers, F.transform(found, code))).alias("keys"))


def rooted(pointers: DataFrame, far: int) -> DataFrame:
    """``pointers`` (u, p, done), each led to its root; ``far`` may not be there yet. ``done``: p is known to be a root.

    Jumps double what a pointer spans, a job each. A root has no pointer or one to itself.
    """
    while far:
        up = pointers.select(F.col("u").alias("p"), F.col("p").alias("q"), F.col("done").alias("sure"))
        nearer = pointers.join(up.hint("merge"), "p", "left").select("u", F.coalesce("q", "p").alias("p"), (F.col("q").isNull() | F.col("sure")).alias("done"))
        pointers, far = cut_counted(nearer, "NOT done")
    return pointers


def contract(edges: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(node, root) of all nodes, and the spanning forest (a, b, w) as a written table; ``edges`` are ``n`` rows with a, b and a weight w, read several times.

    Weights may tie: (w, a, b) orders edges totally, as Borůvka's algorithm needs.
    """
    # Merged, not broadcast, and as few jobs as can be, each with its count: what jobs leave on the driver piles up.
    live = edges.select("a", "b", "w", F.col("a").alias("u"), F.col("b").alias("v"))
    rounds, forest = [], edges.select("a", "b", "w").where("false")
    while n:
        both = live.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("end"), "a", "b", "w")
        least = both.groupBy("end.u").agg(F.min(F.struct("w", "a", "b", "end.v")).alias("e")).select("u", "e.*")
        # Two components that chose the same edge point at each other; the smaller one becomes the root.
        other = least.select(F.col("u").alias("v"), F.col("v").alias("back"))
        same = F.col("back") == F.col("u")
        chosen = least.join(other.hint("merge"), "v").select("u", F.when(same & (F.col("u") < F.col("v")), F.col("u")).otherwise(F.col("v")).alias("p"), same.alias("done"), "a", "b", "w")
        hooks, far = cut_counted(chosen, "NOT done")
        # All but the root of a new component bring an edge of their own, as the root's is that of the one it points at.
        forest = forest.unionByName(hooks.where("u <> p").select("a", "b", "w"))
        parent = rooted(hooks.select("u", "p", "done"), far)
        rounds.append(parent)
        left, right = parent.select("u", F.col("p").alias("nu")), parent.select(F.col("u").alias("v"), F.col("p").alias("nv"))
        moved = live.join(left.hint("merge"), "u").join(right.hint("merge"), "v").where("nu <> nv")
        # Of parallel edges between two components only the least can be taken.
        low, high = F.least("nu", "nv").alias("u"), F.greatest("nu", "nv").alias("v")
        live, n = cut_counted(moved.groupBy(low, high).agg(F.min(F.struct("w", "a", "b")).alias("e")).select("e.a", "e.b", "e.w", "u", "v"), "true")
    return labelled(edges, rounds), written(forest, "spanning-forest")


def labelled(edges: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """(node, root) of the nodes of ``edges``. The first of the ``rounds`` has all nodes; a later one what were roots before, so that a component gets a pointer once."""
    if not rounds:
        return edges.where("false").select(F.col("a").alias("node"), F.col("a").alias("root"))
    first, *later = (r.select("u", "p") for r in rounds)
    if not later:
        return first.toDF("node", "root")
    pointers = [r.where("u <> p").withColumn("done", F.lit(r is later[-1])) for r in later]
    up = rooted(reduce(DataFrame.unionByName, pointers), len(later) - 1).select(F.col("u").alias("p"), F.col("p").alias("q"))
    return cut(first.join(up.hint("merge"), "p", "left").select(F.col("u").alias("node"), F.coalesce("q", "p").alias("root")))


def links(keys: DataFrame) -> DataFrame:
    """Edges (a, b, w) between the keys of a row of ``keys``, the first with each other one; w is the smallest row that has both.

    A row with one key gives a loop, so that its node is known.
    """
    k = F.col("keys")
    pairs = keys.where(F.size("keys") > 0).select("row_id", F.get(k, F.lit(0)).alias("first"), F.explode(k).alias("key")).where((F.col("first") != F.col("key")) | (F.size(k) == 1))
    return pairs.groupBy(F.least("first", "key").alias("a"), F.greatest("first", "key").alias("b")).agg(F.min("row_id").alias("w"))


def components(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, group_id, n_rows, tuning, heldout) of every key of ``keys``, which is read several times, and the spanning forest."""
    edges, n = cut_counted(links(keys), "a <> b")
    labels, forest = contract(edges.where("a <> b"), n)
    loops = edges.where("a = b").select(F.col("a").alias("node")).join(labels, "node", "left_anti").select("node", F.col("node").alias("root"))
    labels = labels.unionByName(loops)
    by_key = keys.where(F.size("keys") > 0).groupBy(F.get("keys", F.lit(0)).alias("node")).agg(
        F.min("row_id").alias("low"), F.count("*").alias("n"), F.count_if(F.col("side") == "tuning").alias("t"), F.count_if(F.col("side") == "heldout").alias("h")
    )
    groups = labels.join(by_key, "node").groupBy("root").agg(F.min("low").alias("group_id"), F.sum("n").alias("n_rows"), (F.sum("t") > 0).alias("tuning"), (F.sum("h") > 0).alias("heldout"))
    return labels.join(groups, "root").select("node", "group_id", "n_rows", "tuning", "heldout"), forest


def parted(rows: DataFrame) -> DataFrame:
    """(row_id, group_id): every row of each group that has rows on both sides."""
    keys = cut(keyed(rows))
    nodes, _ = components(keys)
    members = keys.where(F.size("keys") > 0).select("row_id", F.get("keys", F.lit(0)).alias("node"))
    return members.join(nodes.where("tuning AND heldout").select("node", "group_id"), "node").select("row_id", "group_id")


def assign(rows: DataFrame, proportions: tuple[tuple[str, int], ...] = PROPORTIONS, seed: str = "split-1") -> DataFrame:
    """(row_id, group_id, assigned): a split for each row, the same for all rows of a group.

    Groups are stratified by size (powers of two) and, within a size band and hash shard, dealt systematically in hash
    order: the k-th goes to the split in whose share of the cumulative proportions the k-th step of the golden ratio
    falls, which stays close to the proportions over every stretch of a shard.
    """
    keys = cut(keyed(rows))
    nodes = cut(components(keys)[0])
    have = keys.select("row_id", F.get("keys", F.lit(0)).alias("node"))
    known = have.where("node IS NOT NULL").join(nodes.select("node", "group_id", "n_rows"), "node").select("row_id", "group_id", "n_rows")
    alone = have.where("node IS NULL").select("row_id", F.col("row_id").alias("group_id"), F.lit(1).cast("long").alias("n_rows"))
    members = known.unionByName(alone)
    groups = members.where("row_id = group_id").select("group_id", F.floor(F.log2("n_rows")).alias("band"), priority(seed, F.col("group_id")).alias("priority"))
    sizes = cut(groups.groupBy("band").agg(F.count("*").alias("n_groups")))
    sharded = groups.join(F.broadcast(sizes), "band").withColumn("shard", F.pmod(F.xxhash64("group_id"), F.ceil(F.col("n_groups") / DEALT)))
    w = Window.partitionBy("band", "shard")
    ranked = sharded.withColumn("k", F.row_number().over(w.orderBy("priority", "group_id")))
    # A golden-ratio step deals the proportions evenly over any stretch, also in short bands.
    point = F.pmod((F.col("k") + F.col("band") * 3 + F.col("shard")) * 61.8033988749895, F.lit(100.0))
    choice, upto = None, 0
    total = sum(p for _, p in proportions)
    for name, share in proportions:
        upto += share
        rule = point < F.lit(100.0 * upto / total)
        choice = F.when(rule, name) if choice is None else choice.when(rule, name)
    dealt = ranked.select("group_id", choice.otherwise(proportions[-1][0]).alias("assigned"))
    return members.select("row_id", "group_id").join(dealt, "group_id")
