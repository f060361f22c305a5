"""The transfer network: edges, nodes, cycles, chains, components and anomalies."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.columns import ago, count_if, rounded, total
from ledgerlark.functions.storage import materialize
from ledgerlark.operators.components import connected_components
from ledgerlark.operators.rules import MICROS


def graph_edges(txns: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    a, b = F.col("from_customer_id"), F.col("to_customer_id")
    rows = txns.filter((F.col("created_at") >= ago(as_of, days=days)) & (a != b))
    return rows.groupBy(a.alias("src"), b.alias("dst")).agg(total(F.col("amount")).alias("amount"), F.count("*").alias("n"))


def graph_nodes(edges: DataFrame) -> DataFrame:
    ends = F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.col("amount").alias("s"), F.lit(0.0).alias("r")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.lit(0.0).alias("s"), F.col("amount").alias("r")))
    return edges.select(F.inline(ends)).groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), total(F.col("s")).alias("total_sent"), total(F.col("r")).alias("total_received"))


def prune_to_cycles(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """Leaves out edges whose end can't go on or whose start can't be reached: none of them is on a cycle."""
    for _ in range(rounds):
        edges = edges.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst")
    return edges


def graph_cycles(edges: DataFrame, most: int = 5) -> DataFrame:
    """Directed simple cycles of 2 to ``most`` edges, one per set of nodes.

    A cycle grows once, from its node with the most partners (of equal ones, the largest): a path only goes on to nodes
    below its start in that order, so a hub is passed through by no path but those of greater hubs, and starts no more than
    one for each partner. A path closes by a join on both of its ends, which tells whether that edge exists; none is grown
    to find out. Paths of each length are written once. Edges without an end and loops are no part of a cycle; repeated
    edges count once; an empty table gives no rows."""
    pairs = edges.select("src", "dst").filter(F.col("src") != F.col("dst")).distinct()
    steps = materialize(prune_to_cycles(pairs), "cycle-edges")
    degree = materialize(steps.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("k")), "cycle-degrees")
    rank = lambda end: degree.select(F.col("node").alias(end), F.struct("k", "node").alias(f"{end}_rank"))
    ranked = materialize(steps.join(rank("src"), "src").join(rank("dst"), "dst").filter(F.col("dst_rank") != F.col("src_rank")), "cycle-steps")
    falling = ranked.filter(F.col("dst_rank") < F.col("src_rank"))
    paths = falling.select(F.col("src").alias("root"), F.col("src_rank").alias("top"), F.col("dst").alias("last"), F.array("src", "dst").alias("path"))
    back = steps.select(F.col("src").alias("last"), F.col("dst").alias("root"))
    onward = ranked.select(F.col("src").alias("last"), F.col("dst").alias("next"), "dst_rank")
    found = []
    for length in range(2, most + 1):
        found.append(paths.join(back, ["last", "root"], "left_semi").select(F.array_sort("path").alias("nodes"), F.lit(length).alias("length")))
        if length < most:
            grown = paths.join(onward, "last").filter((F.col("dst_rank") < F.col("top")) & ~F.array_contains("path", F.col("next")))
            paths = materialize(grown.select("root", "top", F.col("next").alias("last"), F.concat("path", F.array("next")).alias("path")), "cycle-paths")
    return reduce(DataFrame.unionByName, found).distinct().select("length", F.array_join(F.transform("nodes", lambda n: n.cast("string")), ",").alias("nodes"))


def graph_hubs(nodes: DataFrame, customers: DataFrame, least: int = 5) -> DataFrame:
    rows = nodes.withColumn("degree", F.col("out_degree") + F.col("in_degree")).filter(F.col("degree") >= least)
    return rows.join(customers.select(F.col("customer_id").alias("node"), "full_name", "risk_level"), "node", "left").select("node", "degree", "out_degree", "in_degree", "full_name", "risk_level")


def chains(txns: DataFrame, hours: int, close: Column, within: float, least: int, most: int | None, strict: bool, dense: int = 2048) -> Iterator[tuple[int, DataFrame]]:
    """(length, chains) of ``least`` to ``most`` transactions (without ``most``, until none grows): each sent by the last
    one's receiver, no earlier than it and at most ``hours`` later (``strict``: later, and less than that), amounts close,
    no customer twice. ``close`` compares ``amount`` with ``amount_next``, which differ by at most the share ``within``.
    Chains of one length grow from those before, which are written.

    A step joins on the customer, a bucket of time as long as the span, and a bucket of the amount's logarithm as wide as
    the share. A path looks into its own bucket of time and the next, and into its own bucket of amounts and those beside
    it: an account with very many transactions spreads over its amounts, and no pair farther apart is ever compared. A cell of
    one account, bucket of time and bucket of amounts with more than ``dense`` transactions is dealt into parts by their ids;
    a path that looks into it is sent to each of them, so no task meets more than about ``dense`` of them for a path."""
    width = -math.log(1 - within) * 1.001
    span = hours * MICROS
    at = F.unix_micros(F.col("created_at").cast("timestamp"))
    rows = txns.filter(F.col("from_customer_id").isNotNull() & F.col("to_customer_id").isNotNull() & (F.col("amount") > 0) & (F.col("from_customer_id") != F.col("to_customer_id"))).select("id", "from_customer_id", "to_customer_id", "amount", at.alias("at"))
    step = F.floor(F.log("amount") / width)
    following = rows.select(F.col("from_customer_id").alias("last"), F.floor(F.col("at") / span).alias("bucket"), step.alias("step"), F.col("id").alias("id_next"), F.col("to_customer_id").alias("to_next"), F.col("amount").alias("amount_next"), F.col("at").alias("at_next"))
    cell = ["last", "bucket", "step"]
    sizes = following.groupBy(*cell).agg(F.ceil(F.count("*") / dense).cast("int").alias("parts"))
    large = materialize(sizes.filter(F.col("parts") > 1), "chain-cells")
    following = materialize(following.join(large, cell, "left").withColumn("part", F.pmod(F.xxhash64("id_next"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts").sortWithinPartitions(*cell, "part"), "chain-steps")
    paths = rows.select(F.col("id").alias("start_id"), F.array("id").alias("ids"), F.array("from_customer_id", "to_customer_id").alias("path"), F.col("to_customer_id").alias("last"), "amount", "at", F.col("amount").alias("total"))
    gap = F.col("at_next") - F.col("at")
    timely = (gap > 0) & (gap < span) if strict else (gap >= 0) & (gap <= span)
    length = 1
    while True:
        if length >= least:
            yield length, paths
        if length == most or (length > 1 and paths.isEmpty()):
            return
        bucket = F.floor(F.col("at") / span)
        probe = paths.withColumn("bucket", F.explode(F.array(bucket, bucket + 1))).withColumn("step", F.explode(F.array(step - 1, step, step + 1)))
        probe = probe.join(large, cell, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        grown = probe.join(following, [*cell, "part"]).filter(timely & close & ~F.array_contains("path", F.col("to_next")))
        paths = grown.select("start_id", F.concat("ids", F.array("id_next")).alias("ids"), F.concat("path", F.array("to_next")).alias("path"), F.col("to_next").alias("last"), F.col("amount_next").alias("amount"), F.col("at_next").alias("at"), (F.col("total") + F.col("amount_next")).alias("total"))
        length += 1
        if length != most:
            paths = materialize(paths, "chains")


def pattern_layering(txns: DataFrame, hops: int = 3, most: int | None = None) -> DataFrame:
    """Layering chains within 48 hours and 20%, of at least ``hops`` transactions: customers along the way and the
    transactions, as texts."""
    close = F.abs(F.col("amount_next") - F.col("amount")) / F.col("amount") <= 0.20
    found = reduce(DataFrame.unionByName, (paths for _, paths in chains(txns, 48, close, 0.20, hops, most, strict=False)))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return found.select("start_id", text("ids").alias("txn_ids"), text("path").alias("customers"), rounded(F.col("total")).alias("total_amount"))


def layering_confidence(txns: DataFrame, hops: int = 3, most: int | None = None) -> DataFrame:
    """Per customer who starts chains: how many, and min(100, 25 for each)."""
    rows = pattern_layering(txns, hops, most).withColumn("customer_id", F.split("customers", ",")[0].cast("long")).groupBy("customer_id").agg(F.count("*").alias("chains"))
    return rows.withColumn("confidence", F.least(F.lit(100.0), F.col("chains") * 25.0))


def graph_layering_chains(txns: DataFrame, as_of: str, hops: int = 9, days: int = 30) -> DataFrame:
    """Chains within 24 hours and 15%, of 2 to ``hops`` transactions, one for each start and length: the first by ids."""
    recent = txns.filter(F.col("created_at") >= ago(as_of, days=days))
    close = F.abs(F.col("amount_next") - F.col("amount")) / F.col("amount") < 0.15
    out = []
    for length, found in chains(recent, 24, close, 0.15, 2, hops, strict=True):
        out.append(found.groupBy("start_id").agg(F.min(F.struct("ids", "total")).alias("m")).select("start_id", F.lit(length).alias("length"), F.element_at("m.ids", -1).alias("end_id"), rounded(F.col("m.total")).alias("total_amount")))
    return reduce(DataFrame.unionByName, out)


def graph_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    whole = F.broadcast(nodes.agg(F.count("*").alias("_n")))
    share = edges.select(F.explode(F.array("src", "dst")).alias("node"), "n").groupBy("node").agg(F.sum("n").alias("taken"))
    most = F.broadcast(share.agg(F.max("taken").alias("_most")))
    rows = nodes.join(share, "node", "left").crossJoin(whole).crossJoin(most)
    part = lambda c: F.when(F.col("_n") > 1, rounded(c / (F.col("_n") - 1), 4)).otherwise(0.0)
    return rows.select("node", part(F.col("out_degree") + F.col("in_degree")).alias("degree"), part(F.col("in_degree")).alias("in_degree"), part(F.col("out_degree")).alias("out_degree"), rounded(F.col("taken") / F.col("_most"), 4).alias("participation"))


def graph_components(edges: DataFrame) -> DataFrame:
    """Component, size and whether it is the largest, of each node."""
    found = connected_components(edges)
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    largest = sizes.agg(F.max("size").alias("_m"))
    return found.join(sizes, "component").crossJoin(F.broadcast(largest)).select("node", "component", "size", (F.col("size") == F.col("_m")).alias("in_largest"))


FEATURES = ["out_degree", "in_degree", "log_sent", "log_received", "degree_ratio", "amount_ratio"]


def node_features(nodes: DataFrame) -> DataFrame:
    top = F.broadcast(nodes.agg(F.greatest(F.max("out_degree"), F.lit(1)).alias("_o"), F.greatest(F.max("in_degree"), F.lit(1)).alias("_i")))
    c = F.col
    values = [c("out_degree") / c("_o"), c("in_degree") / c("_i"), F.log1p("total_sent"), F.log1p("total_received"), c("out_degree") / (c("in_degree") + 1), c("total_sent") / (c("total_received") + 1)]
    return nodes.crossJoin(top).select("node", *(rounded(v, 4).alias(f"f_{n}") for n, v in zip(FEATURES, values, strict=True)))


def _stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row of means and sample deviations (0 counts as 1), from exact decimal sums."""
    d = lambda x: F.col(x).cast("decimal(18,4)")
    row = df.agg(F.count("*").alias("_n"), *(x for k in columns for x in (F.sum(d(k)).cast("double").alias(f"{k}_s"), F.sum((d(k) * d(k)).cast("decimal(38,6)")).cast("double").alias(f"{k}_q"))))
    std = lambda k: F.when(F.col("_n") > 1, F.sqrt(F.greatest(F.lit(0.0), (F.col(f"{k}_q") - F.col(f"{k}_s") * F.col(f"{k}_s") / F.col("_n")) / (F.col("_n") - 1)))).otherwise(1.0)
    return row.select("_n", *(x for k in columns for x in ((F.col(f"{k}_s") / F.col("_n")).alias(f"{k}_mean"), F.when(std(k) == 0, 1.0).otherwise(std(k)).alias(f"{k}_std"))))


def node_anomalies(features: DataFrame, limit: float = 2.5) -> DataFrame:
    columns = [f"f_{n}" for n in FEATURES]
    rows = features.crossJoin(F.broadcast(_stats(features, columns)))
    z = {n: F.abs(F.col(f"f_{n}") - F.col(f"f_{n}_mean")) / F.col(f"f_{n}_std") for n in FEATURES}
    reasons = F.concat_ws(",", *(F.when(v > limit, n) for n, v in z.items()))
    worst = F.greatest(*(F.when(v > limit, v).otherwise(0.0) for v in z.values()))
    return rows.select("node", reasons.alias("reasons"), rounded(worst, 3).alias("max_z")).filter("reasons <> ''").withColumn("severity", F.when(F.col("max_z") > 5, "high").otherwise("medium"))


def edge_anomalies(edges: DataFrame, limit: float = 2.5) -> DataFrame:
    rows = edges.crossJoin(F.broadcast(_stats(edges, ["amount", "n"]))).filter(F.col("_n") >= 3)
    za, zn = (F.abs(F.col(k) - F.col(f"{k}_mean")) / F.col(f"{k}_std") for k in ("amount", "n"))
    kind = F.when(za > zn, "high_amount").otherwise("high_frequency")
    return rows.filter((za > limit) | (zn > limit)).select("src", "dst", "amount", "n", rounded(za, 3).alias("amount_z"), rounded(zn, 3).alias("count_z"), kind.alias("kind"))


def isolation_depth_scores(features: DataFrame, contamination: float = 0.1) -> DataFrame:
    """Depth at which midpoint splits leave a node alone, all nodes level by level. A cell is split by the feature of its
    depth at the middle of its values, until it has one node, equal values, or the depth limit floor(log2 n) + 1 is
    reached. Each level is one aggregation by cell."""
    columns = [f"f_{n}" for n in FEATURES]
    n = features.count()
    most = n.bit_length() if n else 0
    now = features.select("node", *columns, F.lit("r").alias("cell"), F.lit(None).cast("int").alias("depth"))
    for depth in range(most):
        x = columns[depth % len(columns)]
        cells = now.filter("depth IS NULL").groupBy("cell").agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.count("*").alias("_k"))
        joined = now.join(cells, "cell", "left")
        stop = F.col("depth").isNull() & ((F.col("_k") <= 1) | (F.col("_lo") == F.col("_hi")))
        side = F.when(F.col(x) < (F.col("_lo") + F.col("_hi")) / 2, "0").otherwise("1")
        now = materialize(joined.select("node", *columns, F.when(F.col("depth").isNull() & ~stop, F.concat("cell", side)).otherwise(F.col("cell")).alias("cell"), F.when(stop, F.lit(depth)).otherwise(F.col("depth")).alias("depth")), "isolation")
    score = F.pow(F.lit(2.0), -F.coalesce("depth", F.lit(most)) / F.lit(max(1, most) / 2.0))
    return now.select("node", F.coalesce("depth", F.lit(most)).alias("depth"), rounded(score, 4).alias("score")).withColumn("is_anomaly", F.col("score") > 1 - contamination)
