"""Groups that must stay together: components, folds and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.functions.hashing import hash32
from sitewise.operators.ordering import positions, running
from sitewise.session import checkpointed

MISSING_GROUP = "missing_gene"


def shared_value_edges(df: DataFrame, node: str, shared: str) -> DataFrame:
    """Link nodes that share a value: a star to the smallest node of each value.

    A star has one edge per member, so a value held by a third of all rows does
    not turn into all pairs of its members.
    """
    members = df.where(F.col(shared).isNotNull()).select(F.col(shared).alias("_v"), F.col(node).alias("u")).distinct()
    centre = members.groupBy("_v").agg(F.min("u").alias("v"))
    return members.join(centre, "_v").where("u <> v").select("u", "v").distinct()


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` where the component is its smallest node.

    Alternates the large-star and small-star steps (Kiveris et al., 2014) until
    the edges are stars. Each step is an aggregate of minima and a join back, so
    a hub costs one row per neighbour. Rounds grow with the log of the diameter.
    """
    edges = checkpointed(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = _edge_state(edges)
    for _ in range(max_rounds):
        edges = checkpointed(_small_star(_large_star(edges)), before[0])
        now = _edge_state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("_root"))
    return nodes.select("node").distinct().join(roots, "node", "left") \
        .select("node", F.coalesce("_root", "node").alias("component"))


def _edge_state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"),
                    F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def joint_groups(df: DataFrame, node: str, shared: str, name: str = "joint_group", digits: int = 5) -> DataFrame:
    """Label rows by the component of nodes linked through equal ``shared`` values.

    A missing node counts as one named group. Labels are numbered in order of the
    component's smallest node.
    """
    named = df.withColumn("_node", F.coalesce(F.col(node).cast("string"), F.lit(MISSING_GROUP)))
    comp = connected_components(named.select(F.col("_node").alias("node")), shared_value_edges(named, "_node", shared))
    labels = component_labels(comp, name, digits).select(F.col("node").alias("_node"), name)
    return named.join(labels, "_node").drop("_node")


def component_labels(components: DataFrame, name: str = "label", digits: int = 5) -> DataFrame:
    """``G00001``-style labels by ascending component root."""
    roots = positions(components.select("component").distinct(), [], ["component"], "_i")
    width = F.greatest(F.lit(digits), F.length(F.col("_i").cast("string")))
    return components.join(roots, "component").select(
        "node", "component", F.concat(F.lit("G"), F.lpad(F.col("_i").cast("string"), width, F.lit("0"))).alias(name))


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("size"))


def snake_seat(place: Column, folds: int) -> Column:
    """Fold of the 1-based ``place``, dealt forth and back."""
    turn, seat = F.floor((place - 1) / folds), (place - 1) % folds
    return (F.when(turn % 2 == 0, seat).otherwise(folds - 1 - seat) + 1).cast("int")


def snake_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """``group, size, fold``: groups by falling size, dealt forth and back over the folds."""
    ranked = positions(group_sizes(df, group), [], [F.col("size").desc(), F.col(group)], "_i")
    return ranked.select(group, "size", snake_seat(F.col("_i"), folds).alias("fold"))


def _phases(counts: list[tuple[int, int]], folds: int) -> list[tuple[int, int, list[int]]]:
    """``size, first place, folds in turn`` of the deal of ``counts`` (size, groups), largest size first.

    Each group goes to the lightest fold, the lowest of those. While groups of one size are
    dealt, a fold of load ``l`` takes its turns at ``l``, ``l + size``, ``l + 2 size`` and so
    on, and the deal is the merge of these sequences. So the lightest fold goes on alone until
    it reaches the next one; then both take turns until they reach the third, and so on.
    """
    load, out = [0] * folds, []
    for size, many in counts:
        order, place = sorted(range(folds), key=lambda f: (load[f], f)), 0
        for m in range(1, folds + 1):
            if place == many:
                break
            turn = sorted(order[:m], key=lambda f: (load[f], f))
            if m < folds:
                edge = order[m]
                takes = sum(max(0, -(-(load[edge] + (f < edge) - load[f]) // size)) for f in turn)
            else:
                takes = many
            takes = min(takes, many - place)
            if takes:
                out.append((size, place, [f + 1 for f in turn]))
                for i, f in enumerate(turn):
                    load[f] += size * (takes // m + (i < takes % m))
                place += takes
    return out


def lightest_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """``group, size, fold``: groups from the largest to the smallest, ties by name, each to the lightest fold.

    Only the distinct sizes with their numbers of groups reach the driver (fewer than the
    root of twice the rows); there whole runs of equal sizes are dealt at once.
    """
    sized = checkpointed(positions(group_sizes(df, group), ["size"], [group], "_i"))
    counts = sorted(((r["size"], r["n"]) for r in sized.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    dealt = df.sparkSession.createDataFrame([(s, first, turn) for s, first, turn in _phases(counts, folds)] or [(0, 0, [1])], "size long, _first long, _turn array<int>")
    of_size = dealt.groupBy("size").agg(F.array_sort(F.collect_list(F.struct("_first", "_turn"))).alias("_phases"))
    mine = F.element_at(F.filter("_phases", lambda p: p["_first"] < F.col("_i")), -1)
    placed = sized.join(of_size, "size").withColumn("_p", mine)
    return placed.select(group, "size", F.get("_p._turn", ((F.col("_i") - 1 - F.col("_p._first")) % F.size("_p._turn")).cast("int")).alias("fold"))


def group_folds(df: DataFrame, group: str, folds: int, deal: str = "lightest") -> DataFrame:
    """``group, size, fold`` with whole groups and balanced folds.

    Dealt from the largest to the lightest fold, or in ``snake`` order, which differs by at
    most one group's rows a turn. A null group is a group.
    """
    dealt = checkpointed((lightest_folds if deal == "lightest" else snake_folds)(df, group, folds))
    if (found := dealt.count()) < folds:
        raise ValueError(f"{found} groups cannot fill {folds} folds")
    return dealt


def with_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    table = group_folds(df, group, folds).select(F.col(group).alias("_g"), "fold")
    return df.join(table, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def group_split(df: DataFrame, group: str, test_fraction: float, seed: int) -> DataFrame:
    """``group, size, cumulative, split``: groups in hashed order, cut nearest to the target size."""
    sizes = group_sizes(df, group).withColumn("_h", hash32(F.lit(seed), F.col(group)))
    cum = running(sizes, [], ["_h", group], {"cumulative": ("sum", F.col("size"))})
    total = sizes.agg(F.sum("size").alias("t")).scalar()
    gap = F.abs(F.col("cumulative") - total * F.lit(test_fraction))
    cut = cum.agg(F.min_by("cumulative", F.struct(gap, F.col("cumulative"))).alias("c")).scalar()
    split = F.when(F.col("cumulative") <= cut, "test").otherwise("development")
    return cum.select(group, "size", "cumulative", split.alias("split"))
