"""Splits that keep related records together (problem 6).

Hash-to-Min components.  A node's cluster is held as rows (node, member), never as one collection:
in each round the smallest member m of every cluster is found by a partial aggregate, the cluster is
sent to m and m is sent to every member.  Rows of hot keys meet their minimum by broadcast of those few
keys, without a shuffle.  Rounds go on until nothing changes; each is written to the shared folder, and
the one before is removed.

Components go to splits by weighted rendezvous hashing with the stated weights, each by itself: where one goes depends on its
first record and its own share of all rows only, so records stay where they are when other components grow.
A component that is larger than the whole of a split is hashed among the splits it fits in (the largest
split, if it fits in none).  There are at most as many such components as the smallest split goes into 100 percent.
``report`` gives how far the shares are from the targets.

Defined results: null and empty paper ids and missing or placeholder authors link nothing; a record
linked with no other is a component of its own.  Records with a null id are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrove.operators.packed import authors_of
from veritrove.sources.scratch import Scratch

#: A key is hot with more rows than HOT, and more than one part in HOT_PARTS of all rows.
HOT, HOT_PARTS = 50_000, 1000


def links(papers: DataFrame) -> DataFrame:
    """``value`` and ``node``: what a record shares with others, a paper id or an author string."""
    ids = papers.where("paper_id is not null and paper_id <> ''").select(F.concat(F.lit("p:"), "paper_id").alias("value"), F.col("record_id").alias("node"))
    names = authors_of(papers).select(F.concat(F.lit("a:"), "author").alias("value"), F.col("record_id").alias("node"))
    return ids.unionByName(names).where("node is not null").distinct()


def _with_least(big: DataFrame, least: DataFrame, key: str, total: int) -> DataFrame:
    """``big`` joined with ``least`` (``key``, further columns, ``n``: the rows of ``big`` with that key).

    Keys with very many rows, at most ``HOT_PARTS`` of them as each holds more than that part of all rows,
    are broadcast, so their rows stay where they are; the others are joined by a shuffle.
    """
    bound = max(HOT, total // HOT_PARTS)
    most = least.agg(F.max("n")).first()[0] or 0
    if most <= bound:
        return big.join(least.drop("n"), key)
    hot = least.where(F.col("n") > bound).drop("n")
    cold = big.join(F.broadcast(hot.select(key)), key, "left_anti").join(least.where(F.col("n") <= bound).drop("n"), key)
    return big.join(F.broadcast(hot), key).unionByName(cold)


def components(pairs: DataFrame, label: str = "components") -> DataFrame:
    """``node`` and ``first``, the smallest node of its component, for every node that shares a value.

    ``pairs`` has ``value`` and ``node`` (BIGINT).  A value joins its nodes to the smallest of them;
    a value that very many nodes share gives one row a node, never pairs of nodes.
    """
    scratch = Scratch(pairs.sparkSession, label)
    pairs, source = scratch.keep(pairs)
    least, least_path = scratch.keep(pairs.groupBy("value").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1"))
    star = _with_least(pairs, least, "value", pairs.count()).where("node <> first").select("node", F.col("first").alias("member")).distinct()
    both = star.unionByName(star.select(F.col("member").alias("node"), F.col("node").alias("member")))
    clusters, path = scratch.keep(both)
    scratch.drop(source)
    scratch.drop(least_path)
    # The number of rows and a sum over them tell whether a round changed anything.
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("node", "member").cast("decimal(38,0)"))).first()
    before = mark(clusters)
    while True:
        # A cluster holds its node itself too; that row is implied.
        least = clusters.groupBy("node").agg(F.min("member").alias("m"), F.count("*").alias("n")).select("node", F.least("node", "m").alias("m"), "n")
        least, least_path = scratch.keep(least)
        # Rows of the node's own (node, node) come from ``least``, the rest from the cluster.
        own = least.where("m <> node").select("node", "m")
        sent = _with_least(clusters, least, "node", before[0]).select("m", "member").where("m <> member")
        up = sent.unionByName(own.select("m", F.col("node").alias("member")))
        up = up.groupBy("m", "member").agg(F.lit(1).alias("one")).select("m", "member")
        both = F.explode(F.array(F.struct(F.col("m").alias("node"), F.col("member").alias("member")), F.struct(F.col("member").alias("node"), F.col("m").alias("member"))))
        later, new_path = scratch.keep(up.select(both.alias("s")).select("s.node", "s.member").distinct())
        scratch.drop(path)
        scratch.drop(least_path)
        clusters, path = later, new_path
        if (after := mark(clusters)) == before:
            break
        before = after
    return clusters.groupBy("node").agg(F.min("member").alias("m")).select("node", F.least("node", "m").alias("first"))


def assign(papers: DataFrame, targets: DataFrame, seed: str = "split") -> DataFrame:
    """``record_id``, ``first_id`` (of its component) and ``split_name`` for every record."""
    spark = papers.sparkSession
    scratch = Scratch(spark, "splits")
    found = components(links(papers))
    rows = papers.where("record_id is not null").select("record_id")
    placed = rows.join(found, rows["record_id"] == found["node"], "left").select("record_id", F.coalesce("first", "record_id").alias("first_id"))
    placed, _ = scratch.keep(placed)
    total = placed.count()
    wish = {r.split_name: r.target_pct for r in targets.collect() if r.split_name is not None and (r.target_pct or 0) > 0}
    if not wish:
        return placed.select("record_id", "first_id", F.lit(None).cast("string").alias("split_name"))
    room = {k: total * v / sum(wish.values()) for k, v in sorted(wish.items())}
    # At most as many rows as the smallest split goes into the whole.
    large = placed.groupBy("first_id").agg(F.count("*").alias("size")).where(F.col("size") > min(room.values()))
    hashed = lambda k: -F.log((F.pmod(F.xxhash64("first_id", F.lit(f"{seed}:{k}")), F.lit(1 << 52)) + 0.5) / float(1 << 52)) / wish[k]
    draws = [F.when(F.coalesce("size", F.lit(0)) <= room[k], F.struct(hashed(k).alias("cost"), F.lit(k).alias("name"))) for k in room]
    largest = max(room, key=lambda k: (room[k], k))
    chosen = F.coalesce(F.array_min(F.array_compact(F.array(*draws)))["name"], F.lit(largest))
    return placed.join(F.broadcast(large), "first_id", "left").select("record_id", "first_id", chosen.alias("split_name"))


def report(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """``split_name``, ``target_pct``, ``n_records``, ``share_pct`` and how far it is from the target."""
    have = assigned.groupBy("split_name").agg(F.count("*").alias("n_records"))
    total = F.sum("n_records").over(Window.partitionBy())  # of the splits, a row each
    rows = targets.select("split_name", "target_pct").where("split_name is not null").join(have, "split_name", "left").withColumn("n_records", F.coalesce("n_records", F.lit(0)))
    shared = rows.withColumn("share_pct", 100.0 * F.col("n_records") / total)
    return shared.withColumn("deviation", F.col("share_pct") - F.col("target_pct"))
