"""Linking 2-D cells through sections: components, severing of long ones, and checks of the links."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lamella.functions.scalars import ratio
from lamella.operators.lineage import cut
from lamella.operators.project import with_params


#: Components of so many nodes and edges at most are severed as a whole in a task.
WHOLE = 32_768
#: Copies of a node's minimum in the joins of a round. They keep an exchange on both sides, so that a hub's edges are dealt
#: over several tasks and can be split further at run time.
SALTS = 2


def _with_least(edges: DataFrame, least: DataFrame, node: str, other: str) -> DataFrame:
    dealt = edges.withColumn("_salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int"))
    return dealt.join(least.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS))))), [node, "_salt"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Tie every larger neighbour of a node to the smallest node around it."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("_m"))
    return _with_least(both, least, "u", "v").filter("v > u").select(F.col("v").alias("a"), F.col("_m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie a node and its smaller neighbours to the smallest of them; edges run from the larger ``a`` to the smaller ``b``."""
    least = edges.groupBy("a").agg(F.min("b").alias("_m"))
    moved = _with_least(edges, least, "a", "b").filter("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    return moved.unionByName(least.select("a", F.col("_m").alias("b"))).distinct()


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, component)`` for ``nodes(node)`` and undirected ``edges(a, b)``; the smallest node names a component.

    Alternating star rounds, each a grouped minimum and an equi-join: the number of rounds follows the logarithm of the
    longest path, and a hub's edges are dealt over several tasks. Rounds are checkpointed; a node without an edge is its own
    component. Ends that ``nodes`` lacks take part and are left out of the result.
    """
    lined = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    current, seen = cut(lined), None
    while True:
        row = current.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        if not row["n"] or (row["n"], row["x"]) == seen:
            break
        seen = (row["n"], row["x"])
        current = cut(_small_star(_large_star(current)))
    named = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.select("node").distinct().join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def sever_components(nodes: DataFrame, edges: DataFrame, max_span: int | Mapping[str, int] = 5, key: str = "channel", other_span: int = 5) -> DataFrame:
    """Components of at most ``max_span`` sections: ``(node, component)`` for ``nodes(node, z)``, ``edges(a, b, weight)``.

    While a component is longer all its edges of smallest weight are cut at once and it is searched again. Components that
    fit leave the loop with their nodes, and so do those of at most ``WHOLE`` nodes and edges, which a task cuts to the end;
    only larger ones are cut by rounds of joins. A component without edges stays as it is. ``max_span`` may map the nodes'
    ``key`` (such as a channel, ``other_span`` for any other) to its own limit; the largest limit of a component's nodes holds.
    """
    given = isinstance(max_span, Mapping)
    limited = nodes.select("node", "z", *([key] if given else []))
    limited = with_params(limited, max_span, key, "most", other_span).drop(key) if given else limited.withColumn("most", F.lit(max_span))
    rest_nodes, rest_edges = cut(limited), cut(edges.select("a", "b", "weight"))
    labels = connected_components(rest_nodes, rest_edges)
    whole = WHOLE if isinstance(rest_nodes.schema["node"].dataType, T.AtomicType) else 0
    done = None
    while True:
        placed = cut(rest_nodes.join(labels, "node"))
        long = placed.groupBy("component").agg((F.max("z") - F.min("z") + 1).alias("span"), F.max("most").alias("most"), F.count("*").alias("_n")).filter("span > most").select("component", "_n")
        inner = cut(rest_edges.join(placed.select(F.col("node").alias("a"), "component"), "a").join(long, "component"))
        open_ = cut(inner.groupBy("component").agg(F.min("weight").alias("_least"), F.greatest(F.count("*"), F.max("_n")).alias("_size")))
        fits = placed.join(open_.select("component"), "component", "left_anti").select("node", "component")
        done = fits if done is None else done.unionByName(fits)
        sizes = open_.agg(F.min("_size").alias("least"), F.max("_size").alias("most")).first()
        if sizes["most"] is None:
            return done
        if sizes["least"] <= whole:
            done = done.unionByName(_severed_whole(placed, inner, open_.filter(F.col("_size") <= whole).select("component")))
        if sizes["most"] <= whole:
            return done
        large = open_.filter(F.col("_size") > whole)
        rest_edges = cut(inner.join(large, "component").filter("weight > _least").select("a", "b", "weight"))
        rest_nodes = placed.join(large.select("component"), "component", "left_semi").select("node", "z", "most")
        labels = connected_components(rest_nodes, rest_edges)


def _severed_whole(placed: DataFrame, inner: DataFrame, small: DataFrame) -> DataFrame:
    """``(node, component)`` of the components in ``small``, a row of lists each, after all their cuts."""
    members = placed.join(small, "component", "left_semi").groupBy("component").agg(F.collect_list(F.struct("node", "z", "most")).alias("_nodes"))
    lines = inner.join(small, "component", "left_semi").groupBy("component").agg(F.collect_list(F.struct("a", "b", "weight")).alias("_edges"))
    kind = placed.schema["node"].dataType.simpleString()

    def severed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nodes, edges in zip(batch.column("_nodes"), batch.column("_edges")):
                ids, z, most = (nodes.values.field(c) for c in ("node", "z", "most"))
                a, b, weight = (edges.values.field(c) for c in ("a", "b", "weight"))
                named = _pieces(*(c.to_pylist() for c in (ids, z, most, a, b, weight)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(named, ids.type)], names=["node", "component"])

    return members.join(lines, "component").select("_nodes", "_edges").mapInArrow(severed, f"node {kind}, component {kind}")


def _pieces(ids: list, z: list, most: list, a: list, b: list, weight: list) -> list:
    """The smallest id of each node's piece of one component, after all cuts.

    The edges are joined from the heaviest weight down, so a component of the edges above a weight is a branch of a tree.
    Cuts go down that tree from its root, so a node's piece is the highest branch around it that fits, or itself.
    """
    known = {v: i for i, v in enumerate(sorted({*ids, *a, *b}))}
    names = list(known)
    # Of each branch: first and last section, limit, smallest member; what it is part of. Nodes without a section count for none.
    first, last, limit = ([v] * len(names) for v in (math.inf, -math.inf, -math.inf))
    for i, at, most_ in zip(map(known.get, ids), z, most):
        if at is not None:
            first[i], last[i] = (first[i], math.inf) if at != at else (min(first[i], at), max(last[i], at))
        if most_ is not None:
            limit[i] = max(limit[i], most_)
    least, above = [*range(len(names))], [*range(len(names))]
    root, parts = [*range(len(names))], set()  # from a node to a branch, shortened on the way; what is no branch of its own
    # Edges without a weight go at the first cut; NaN is the largest weight.
    given = [w for w in weight if w is not None and w == w]
    lowest = min(given) if given else math.nan
    order: dict[object, list[tuple[int, int]]] = {}
    for u, v, w in zip(a, b, weight):
        w = lowest if w is None else w
        order.setdefault("nan" if w != w else w, []).append((known[u], known[v]))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for w in sorted(order, key=lambda w: (w == "nan", 0 if w == "nan" else w), reverse=True):
        fresh = len(root)
        for u, v in order[w]:
            u, v = top(u), top(v)
            if u == v:
                continue
            u, v = max(u, v), min(u, v)
            if v >= fresh:  # both are parts of one branch, whose edges weigh the same
                parts.add(v)
            if u < fresh:  # two branches of heavier edges: a new one holds both
                u, v = len(root), (u, v)
                for column, value in ((first, math.inf), (last, -math.inf), (limit, -math.inf), (least, len(names)), (above, u), (root, u)):
                    column.append(value)
            else:
                v = (v,)
            for part in v:
                first[u], last[u], limit[u], least[u] = min(first[u], first[part]), max(last[u], last[part]), max(limit[u], limit[part]), min(least[u], least[part])
                above[part] = root[part] = u
    piece: list[int | None] = [None] * len(root)
    for i in reversed(range(len(root))):
        over = above[i]
        fits = i not in parts and (limit[i] == -math.inf or last[i] - first[i] + 1 <= limit[i])
        piece[i] = piece[over] if over != i and piece[over] is not None else i if fits or i < len(names) else None
    return [names[least[piece[known[v]]]] for v in ids]


def assign_cell_ids(labels: DataFrame, keys: Sequence[str] = ("core",)) -> DataFrame:
    """Dense 3-D ids from 1 within each group, in the order of the smallest member; ``labels(keys, node, component)``.

    Components are dealt over tasks by ranges of (keys, smallest member) and numbered within their share; the shares before
    are counted and added, so no task sorts a group. The shares are written down first: a second deal may differ. So are
    the labels, which would be worked out for the sample of ranges, for the shares and for the result.
    """
    keys, labels = [*keys], cut(labels)
    firsts = labels.groupBy(*keys, "component").agg(F.min("node").alias("_first"))
    dealt = cut(firsts.repartitionByRange(*keys, "_first").withColumn("_share", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*keys, "_share").agg(F.count("*").alias("_n")).select(*keys, "_share", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = dealt.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_share").orderBy("_first")))
    ranked = own.join(starts, [*keys, "_share"]).select(*keys, "component", (F.col("_before") + F.col("_r")).cast("long").alias("cell_id_3d"))
    return labels.join(ranked, [*keys, "component"]).select(*keys, "node", "component", "cell_id_3d")


def link_overlap_qc(links: DataFrame, areas: DataFrame, keys: Sequence[str] = ("core",), weak: float = 0.10) -> DataFrame:
    """Shared part of the smaller section of each link, and whether it is weak; ``areas(keys, z, label, area_px)``."""
    sized = _ends(links, areas, keys, "area_px")
    frac = F.coalesce(ratio(F.col("n_shared"), F.least("area_px_a", "area_px_b")), F.lit(0.0))
    return sized.withColumn("overlap_fraction", frac).withColumn("weak", F.col("overlap_fraction") < weak)


def _ends(links: DataFrame, stats: DataFrame, keys: Sequence[str], *values: str) -> DataFrame:
    for end in ("a", "b"):
        side = stats.select(*keys, F.col("z").alias(f"z_{end}"), F.col("label").alias(f"label_{end}"), *[F.col(v).alias(f"{v}_{end}") for v in values])
        links = links.join(side, [*keys, f"z_{end}", f"label_{end}"], "left")
    return links


def link_drift_qc(links: DataFrame, stats: DataFrame, keys: Sequence[str] = ("core",), flag: float = 30.0) -> DataFrame:
    """Distance in pixels between the centroids of each link, and whether it is flagged."""
    both = _ends(links, stats, keys, "centroid_x", "centroid_y")
    drift = F.hypot(F.col("centroid_x_b") - F.col("centroid_x_a"), F.col("centroid_y_b") - F.col("centroid_y_a"))
    return both.withColumn("drift_px", drift).withColumn("flagged", F.col("drift_px") > flag)


def link_area_qc(links: DataFrame, areas: DataFrame, keys: Sequence[str] = ("core",), flag: float = 3.0) -> DataFrame:
    """Larger over smaller area of each link, links with an empty side left out, and whether it is flagged."""
    both = _ends(links, areas, keys, "area_px").filter("area_px_a > 0 AND area_px_b > 0")
    quotient = F.greatest("area_px_a", "area_px_b") / F.least("area_px_a", "area_px_b")
    return both.withColumn("area_ratio", quotient).withColumn("flagged", F.col("area_ratio") > flag)


def span_distribution(features: DataFrame, keys: Sequence[str] = ("core",)) -> DataFrame:
    return features.groupBy(*keys, "z_span_slices").agg(F.count("*").alias("n_cells"))


def linking_summary(features: DataFrame, keys: Sequence[str] = ("core",), min_confirmed: int = 2) -> DataFrame:
    """Confirmed cells (seen in enough sections) and singletons per group."""
    confirmed = (F.col("z_span_slices") >= min_confirmed).cast("long")
    return features.groupBy(*keys).agg(F.count("*").alias("n_cells"), F.sum(confirmed).alias("n_confirmed"), F.sum((F.col("z_span_slices") == 1).cast("long")).alias("n_singletons"), F.avg("z_span_slices").alias("mean_span"))


def dedupe_members(mapping: DataFrame, keys: Sequence[str] = ("core",), cell: str = "cell_id_3d") -> tuple[DataFrame, DataFrame]:
    """Members without repeats of (cell, z, label), and how many rows went per group."""
    unique = mapping.dropDuplicates([*keys, cell, "z", "label"])
    counts = mapping.groupBy(*keys, cell, "z", "label").agg((F.count("*") - 1).alias("_extra"))
    return unique, counts.groupBy(*keys).agg(F.sum("_extra").alias("n_dropped"))
