"""Service graph from traces, cascade root and cascade path."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MIN_EDGE_WEIGHT = 3
NO_ONSET = "9999-12-31 00:00:00"


def trace_first_seen(logs: DataFrame) -> DataFrame:
    """First time of each service in each trace."""
    return (
        logs.where((F.coalesce("trace_id", F.lit("")) != "") & (F.coalesce("service", F.lit("")) != ""))
        .groupBy("trace_id", "service")
        .agg(F.min("timestamp").alias("first_ts"))
    )


def service_graph(first_seen: DataFrame, min_weight: int = MIN_EDGE_WEIGHT) -> DataFrame:
    """Edges between services that follow each other in a trace.

    Rarer edges than the built-in minimum are never kept, whatever ``min_weight`` says.
    """
    w = Window.partitionBy("trace_id").orderBy("first_ts", "service")
    pairs = first_seen.select(F.col("service").alias("src"), F.lead("service").over(w).alias("dst"))
    return (
        pairs.where(F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("weight"))
        .where(F.col("weight") >= max(min_weight, MIN_EDGE_WEIGHT))
    )


def node_stats(edges: DataFrame) -> DataFrame:
    """Fan-out and criticality per service of stored edges (source, target, criticality)."""
    edges = edges.where((F.col("source_service") != "") & (F.col("target_service") != ""))
    crit = F.coalesce("criticality", F.lit(0.5))
    crit = F.when(crit == 0, F.lit(0.5)).otherwise(crit)

    def clamped(c):
        return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))

    ends = edges.select(
        F.inline(
            F.array(
                F.struct(F.col("source_service").alias("service"), F.lit(1).alias("out"), clamped(crit).alias("crit")),
                F.struct(F.col("target_service").alias("service"), F.lit(0).alias("out"), clamped(crit * 0.8).alias("crit")),
            )
        )
    )
    return ends.groupBy("service").agg(
        F.sum("out").alias("fanout"), F.greatest(F.max("crit"), F.lit(0.5)).alias("criticality")
    )


def neighbors(edges: DataFrame) -> DataFrame:
    """Undirected neighbour pairs."""
    both = edges.select("source_service", "target_service").unionByName(
        edges.select(
            F.col("target_service").alias("source_service"), F.col("source_service").alias("target_service")
        )
    )
    return both.distinct().toDF("service", "neighbor")


def _incident_edges(affected: DataFrame, edges: DataFrame) -> DataFrame:
    """Graph edges both of whose ends are affected services of the same incident."""
    src = affected.select("incident_id", F.col("service").alias("src"), F.col("onset").alias("src_onset"))
    dst = affected.select("incident_id", F.col("service").alias("dst"), F.col("onset").alias("dst_onset"))
    return edges.select("src", "dst").join(src, "src").join(dst, ["incident_id", "dst"])


def cascade_root(affected: DataFrame, edges: DataFrame) -> DataFrame:
    """Most likely origin per incident.

    ``affected`` has incident_id, service and onset (null when the service never fired).
    Services triggered by an earlier affected caller are set aside; of the rest, those with
    an affected callee come first, then the earliest onset, then the name.
    """
    known = affected.withColumn(
        "onset", F.coalesce(F.col("onset"), F.lit(NO_ONSET).cast("timestamp"))
    ).dropDuplicates(["incident_id", "service"])
    pairs = _incident_edges(known, edges)
    blocked = (
        pairs.where(F.col("src_onset") < F.col("dst_onset"))
        .select("incident_id", F.col("dst").alias("service"), F.lit(True).alias("blocked"))
        .distinct()
    )
    calling = pairs.select("incident_id", F.col("src").alias("service"), F.lit(True).alias("calls")).distinct()
    keys = ["incident_id", "service"]
    ranked = known.join(blocked, keys, "left").join(calling, keys, "left")
    order = F.struct(F.coalesce("blocked", F.lit(False)), F.col("calls").isNull(), "onset", "service")
    return ranked.groupBy("incident_id").agg(F.min_by("service", order).alias("root_service"))


def cascade_path(roots: DataFrame, affected: DataFrame, edges: DataFrame, max_depth: int = 8) -> DataFrame:
    """First deepest path from the root through affected callees, each service reached once.

    An incident's edge list is bounded by the service graph, so the walk runs inside one row:
    every step extends the whole frontier, keeping the first path to each new service.
    """
    known = affected.withColumn("onset", F.lit(None).cast("timestamp"))
    lists = (
        _incident_edges(known.dropDuplicates(["incident_id", "service"]), edges)
        .groupBy("incident_id")
        .agg(F.array_sort(F.collect_set(F.struct("src", "dst"))).alias("edges"))
    )
    start = roots.join(lists, "incident_id", "left").withColumn(
        "edges", F.coalesce("edges", F.array().cast("array<struct<src:string,dst:string>>"))
    )

    def step(state, _):
        grown = F.flatten(
            F.transform(
                state["frontier"],
                lambda path: F.transform(
                    F.filter(
                        F.col("edges"),
                        lambda e: (e["src"] == F.element_at(path, -1))
                        & ~F.array_contains(state["visited"], e["dst"]),
                    ),
                    lambda e: F.concat(path, F.array(e["dst"])),
                ),
            )
        )
        ends = F.transform(grown, lambda path: F.element_at(path, -1))
        first = F.filter(grown, lambda path, i: F.array_position(ends, F.element_at(path, -1)) == i + 1)
        return F.struct(
            F.array_union(state["visited"], ends).alias("visited"),
            first.alias("frontier"),
            F.coalesce(F.get(first, F.lit(0)), state["best"]).alias("best"),
        )

    root = F.array("root_service")
    zero = F.struct(root.alias("visited"), F.array(root).alias("frontier"), root.alias("best"))
    rounds = F.sequence(F.lit(1), F.lit(max(max_depth - 1, 1)))
    walked = F.aggregate(rounds, zero, step)["best"] if max_depth > 1 else root
    return start.select("incident_id", "root_service", walked.alias("cascade_path"))
