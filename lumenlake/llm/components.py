"""Connected components of an edge table by hooking and contraction, all in joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import cut, drop_cut


def _compressed(hooks: DataFrame) -> DataFrame:
    """Parent pointers (node, root), root < node, followed to their ends by pointer doubling."""
    while True:
        up = hooks.select(F.col("node").alias("root"), F.col("root").alias("upper"))
        nxt = cut(hooks.join(up, "root", "left").select("node", F.coalesce("upper", "root").alias("root"), F.col("upper").isNotNull().alias("moved")))
        moved = nxt.filter("moved").limit(1).count()
        drop_cut(hooks)
        hooks = nxt
        if not moved:
            return hooks.drop("moved")


def components(edges: DataFrame) -> DataFrame:
    """Component of each node that has an edge.

    edges: two columns of one orderable type, in either direction, repeats and loops allowed;
    rows with a null end are no edges. Returns (node, root), root the smallest node that node
    reaches; nodes without edges are absent, and no edges give no rows.

    Every round hooks each node on its smallest neighbour below it, follows the pointers to
    their ends and contracts the edges, which at least halves the nodes that are left in each
    component. Rounds are cut to tables, so lost executors redo one round at most. Aggregates
    combine before their shuffle, so a hub with very many neighbours costs one row a task.
    """
    a, b = edges.columns
    e = cut(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (F.col(a).isNotNull() & F.col(b).isNotNull()).alias("ok"))
        .filter("ok and u <> v").select("u", "v").distinct()
    )
    all_nodes = cut(e.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    roots = None
    while e.limit(1).count():
        hooks = _compressed(cut(e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))))
        hu, hv = hooks.toDF("u", "ru"), hooks.toDF("v", "rv")
        nxt = cut(
            e.join(hu, "u", "left").join(hv, "v", "left")
            .select(F.coalesce("ru", "u").alias("a"), F.coalesce("rv", "v").alias("b"))
            .filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        )
        if roots is None:
            new = cut(all_nodes.join(hooks, "node", "left").select("node", F.coalesce("root", "node").alias("root")))
            drop_cut(all_nodes)
        else:
            new = cut(roots.join(hooks.toDF("root", "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root")))
            drop_cut(roots)
        roots = new
        drop_cut(e)
        drop_cut(hooks)
        e = nxt
    return roots if roots is not None else all_nodes.select("node", F.col("node").alias("root"))
