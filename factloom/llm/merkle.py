"""A Merkle manifest of a dataset over a radix-ranked trie.

A leaf's rank in its group is exact without a sort of all rows: the ids' 64 bits are cut into digits, histograms count the
rows under each prefix, and what stands before a prefix is what stands before its parent and under its smaller siblings.
Only rows under one longest prefix are ordered among themselves. The rank's digits in base ``fanout`` are a key in a trie:
nodes under one longest prefix make the node above, level by level, until a group has one node; the groups' nodes, ranked
by the group's name, make the root in the same way. Every node's siblings are read off its run, so each leaf's proof
and a fold over it need a join for each level with a table that is ``fanout`` times smaller than the one below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace, require

#: Bits of a digit of the id, and rows with different leaves under one longest prefix beyond which ids are told apart by leaf digits.
DIGIT, MANY = 10, 1 << 15
#: Equal rows that one generator makes at most: 2^COPY.
COPY = 12


def _sized(value: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and itself; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame, columns: tuple[str, ...], tampered: Column, text_col: str) -> DataFrame:
    """Adds leaf and, where ``tampered`` holds, the leaf after the text's A-Z are lower-cased."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    leaf = lambda text: F.sha2(F.concat(*[_sized(text if c == text_col else F.col(c)) for c in columns]), 256)
    changed = leaf(F.translate(F.col(text_col), upper, upper.lower()))
    return docs.withColumn("leaf", leaf(F.col(text_col))).withColumn("tampered", F.when(F.coalesce(tampered, F.lit(False)), changed))


def _starts(counts: DataFrame, group: list[str], order: str) -> DataFrame:
    """Adds start: the sum of n before a row, by ``order`` inside ``group``."""
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))


def _prefix_starts(work: Workspace, rows: DataFrame, low: int, high: int) -> DataFrame:
    """``(name, p, start)``: what stands before each longest prefix of a name's keys, from the digits' histograms.

    rows: name, p (the key without its last digit) and n. Windows hold one prefix's digits, 2^DIGIT of them at most.
    """
    histograms = [work.table(rows.groupBy("name", "p").agg(F.sum("n").alias("n")), "digits")]
    while low != high:
        low, high = low >> DIGIT, high >> DIGIT
        above = histograms[-1].groupBy("name", F.shiftright("p", DIGIT).alias("p")).agg(F.sum("n").alias("n"))
        histograms.append(work.table(above, "digits"))
    starts = histograms.pop().select("name", "p", F.lit(0).cast("long").alias("start"))  # one prefix for each name
    while histograms:
        inner = _starts(histograms.pop().withColumn("up", F.shiftright("p", DIGIT)), ["name", "up"], "p").select("name", "p", "up", F.col("start").alias("inner"))
        above = starts.select("name", F.col("p").alias("up"), "start")
        starts = inner.join(above, ["name", "up"]).select("name", "p", (F.col("start") + F.col("inner")).alias("start"))
    return starts


def ranked(work: Workspace, rows: DataFrame) -> DataFrame:
    """A row for each copy of ``rows`` (name, doc_id, leaf, tampered) with its rank among the name's, by doc_id (null first) and leaf.

    Equal rows are counted before anything else, so that copies of one row never meet. Ids that have very many different
    leaves stand as one row under their prefix; inside such an id, the first bits of the leaf are one more digit.
    """
    counted = rows.groupBy("name", "doc_id", "leaf", "tampered").agg(F.count("*").alias("n"))
    # Prefixes count from 0 for null; the smallest id has 1.
    prefix = F.coalesce(F.shiftright("doc_id", DIGIT) + F.lit((1 << (63 - DIGIT)) + 1), F.lit(0))
    counted = work.table(counted.withColumn("p", prefix), "counted")
    low, high = counted.agg(F.coalesce(F.min("p"), F.lit(0)), F.coalesce(F.max("p"), F.lit(0))).first()
    starts = _prefix_starts(work, counted, low, high)

    crowded = counted.groupBy("name", "p").agg(F.count("*").alias("leaves")).where(F.col("leaves") > MANY)
    heavy = work.table(counted.join(crowded.select("name", "p"), ["name", "p"]).groupBy("name", "p", "doc_id").agg(F.sum("n").alias("n"), F.count("*").alias("leaves")).where(F.col("leaves") > MANY).drop("leaves"), "heavy")
    single = counted.withColumn("whole", F.lit(False))
    if not heavy.isEmpty():
        same = (counted["name"] == heavy["name"]) & counted["doc_id"].eqNullSafe(heavy["doc_id"])
        single = single.join(heavy, same, "left_anti").unionByName(heavy.select("name", "p", "doc_id", "n", F.lit("").alias("leaf"), F.lit(None).cast("string").alias("tampered"), F.lit(True).alias("whole")))
    before = Window.partitionBy("name", "p").orderBy("doc_id", "leaf").rowsBetween(Window.unboundedPreceding, -1)
    inner = single.withColumn("inner", F.coalesce(F.sum("n").over(before), F.lit(0))).join(starts, ["name", "p"])
    placed = inner.select("name", "doc_id", "leaf", "tampered", "n", (F.col("start") + F.col("inner")).alias("rank"), "whole")
    if heavy.isEmpty():
        placed = placed.drop("whole")
    else:
        placed = work.table(placed, "placed")
        digit = F.conv(F.substring("leaf", 1, 4), 16, 10).cast("long")
        inside = counted.join(heavy, same, "left_semi").withColumn("digit", digit)
        id_key = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))  # a null id matches itself in joins
        tallies = _starts(inside.groupBy("name", id_key.alias("id"), "digit").agg(F.sum("n").alias("n")), ["name", "id"], "digit").drop("n")
        at = Window.partitionBy("name", "id", "digit").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
        inside = inside.withColumn("id", id_key).withColumn("inner", F.coalesce(F.sum("n").over(at), F.lit(0))).join(tallies, ["name", "id", "digit"])
        bases = placed.where("whole").select("name", id_key.alias("id"), "rank")
        inside = inside.join(bases, ["name", "id"]).select("name", "doc_id", "leaf", "tampered", "n", (F.col("rank") + F.col("start") + F.col("inner")).alias("rank"))
        placed = placed.where("not whole").drop("whole").unionByName(inside)
    few = placed.where(F.col("n") <= 1 << COPY).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    runs = placed.where(F.col("n") > 1 << COPY).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("n") - 1, COPY))))
    runs = runs.repartition("name", "doc_id", "leaf", "run")
    many = runs.withColumn("copy", F.explode(F.sequence(F.shiftleft("run", COPY), F.least(F.col("n"), F.shiftleft(F.col("run") + 1, COPY)) - 1))).drop("run")
    return few.unionByName(many).select("name", (F.col("rank") + F.col("copy")).alias("rank"), "doc_id", "leaf", "tampered")


def _digest(kids: Column) -> Column:
    return F.sha2(F.array_join(kids, ""), 256)


def _siblings(kids: Column, at: Column) -> Column:
    """What stands left and right of place ``at`` (from 0) in a run."""
    left = F.array_join(F.slice(kids, F.lit(1), at), "")
    right = F.array_join(F.slice(kids, at + 2, F.size(kids)), "")
    return F.struct(left.alias("l"), right.alias("r"))


def _climb(work: Workspace, runs: DataFrame, levels: int, bits: int) -> list[DataFrame]:
    """The runs of each level, lowest first: ``(name, run, nodes, kids)``; nodes: how many the level has in its group."""
    out = [runs]
    for _ in range(1, levels):
        below = out[-1].where(F.col("nodes") > 1 << bits)
        up = below.select("name", F.shiftright("run", bits).alias("up"), F.shiftright(F.col("nodes") + ((1 << bits) - 1), bits).alias("nodes"), F.struct("run", _digest(F.col("kids")).alias("digest")).alias("kid"))
        grouped = up.groupBy("name", F.col("up").alias("run")).agg(F.max("nodes").alias("nodes"), F.array_sort(F.collect_list("kid")).alias("kids"))
        out.append(work.table(grouped.withColumn("kids", F.transform("kids", lambda k: k["digest"])), "runs"))
    return out


def _tops(levels: list[DataFrame], bits: int) -> DataFrame:
    """``(name, digest)``: the last node of each group; a group's only node is itself."""
    tops = [r.where(F.col("nodes") <= 1 << bits).select("name", F.when(F.col("nodes") > 1, _digest(F.col("kids"))).otherwise(F.col("kids")[0]).alias("digest")) for r in levels]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out


def _tails(levels: list[DataFrame], tops: DataFrame, bits: int, last: DataFrame) -> DataFrame:
    """``last`` with tail: the siblings that a node made of a lowest run meets on its way to the root, and the columns of ``tops``.

    tops: name, tail, and more. last: the lowest runs, with any further columns.
    """
    more = [c for c in tops.columns if c not in ("name", "tail")]
    above = None
    for runs in [*levels[:0:-1], last]:
        done = runs.where(F.col("nodes") <= 1 << bits).join(tops, "name")
        if above is None:
            above = done
            continue
        up = above.select("name", F.col("run").alias("up"), F.col("kids").alias("above"), "tail", *more)
        at = F.col("run").bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
        rest = runs.where(F.col("nodes") > 1 << bits).withColumn("up", F.shiftright("run", bits)).join(up, ["name", "up"])
        rest = rest.withColumn("tail", F.concat(F.array(_siblings(F.col("above"), at)), "tail")).drop("up", "above")
        above = done.unionByName(rest)
    return above


def _levels(most: int, bits: int) -> int:
    """Levels of runs over ``most`` nodes, one at least."""
    n = 1
    while most > 1 << bits:
        most, n = -(-most >> bits), n + 1
    return n


def manifest(
    docs: DataFrame,
    tampered: Column,
    bits: int = 4,
    id_col: str = "doc_id",
    group_col: str = "source",
    columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` for each row; digests as lower-case hex.

    A leaf is the digest of ``columns`` in order. A group's leaves ascend by id; each run of ``2^bits`` consecutive nodes
    becomes their digest, until one is left: the subroot. Subroots by the group's name make the root likewise. proof: the
    siblings of all levels, lowest first, left to right. tampered: a condition on the columns; where it holds, the fold starts
    from the leaf of the text with A-Z lower-cased.

    Null ids come before others, equal ids are ordered by leaf, equal rows have neighbouring ranks; a null group is the
    first, the empty text next. A null text stays null. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "merkle")
    base = leaves(require(docs, *columns), columns, tampered, text_col)
    # A name that is never null: a null group is the first, and others keep their bytewise order.
    name = F.coalesce(F.concat(F.lit("="), F.col(group_col)), F.lit(""))
    rows = base.select(name.alias("name"), F.col(id_col).cast("long").alias("doc_id"), "leaf", "tampered")
    members = work.table(ranked(work, rows), "ranks")
    groups = work.table(members.groupBy("name").agg(F.count("*").alias("nodes")), "groups")
    most = groups.agg(F.max("nodes")).first()[0]
    out = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if not most:
        return spark.createDataFrame([], out)

    run = members.groupBy("name", F.shiftright("rank", bits).alias("run")).agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "leaf", "tampered"))).alias("members"))
    run = work.table(run.join(groups, "name").withColumn("kids", F.transform("members", lambda m: m["leaf"])), "runs")
    levels = _climb(work, run.drop("members"), _levels(most, bits), bits)
    # Groups by name: a sort by ranges, whose parts have their counts summed; a row for each part.
    ordered = _tops(levels, bits).orderBy("name").withColumn("at", F.monotonically_increasing_id())
    ordered = work.table(ordered.withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND(F.lit((1 << 33) - 1))), "subroots")
    parts = _starts(ordered.groupBy("part").agg(F.count("*").alias("n")).withColumn("all", F.lit(0)), ["all"], "part").select("part", "start")
    n_groups = ordered.count()
    tops = ordered.join(F.broadcast(parts), "part").withColumn("rank", F.col("start") + F.col("at"))
    top_runs = tops.groupBy(F.lit("").alias("top"), F.shiftright("rank", bits).alias("run")).agg(F.array_sort(F.collect_list(F.struct("rank", "name", "digest"))).alias("members"))
    top_runs = work.table(top_runs.select(F.col("top").alias("name"), "run", "members", F.lit(n_groups).cast("long").alias("nodes")).withColumn("kids", F.transform("members", lambda m: m["digest"])), "top_runs")
    top_levels = _climb(work, top_runs.drop("members"), _levels(n_groups, bits), bits)
    root = _tops(top_levels, bits).first()["digest"]

    none = F.array().cast("array<struct<l:string,r:string>>")
    end = top_runs.select("name").distinct().withColumn("tail", none)
    # A level's only node is what remains: no run of its own.
    path = F.when(F.col("nodes") > 1, F.concat(F.array(_siblings(F.col("kids"), F.col("at"))), "tail")).otherwise(F.col("tail"))
    top = _tails(top_levels, end, bits, top_runs).select("kids", "nodes", "tail", F.posexplode("members").alias("at", "m"))
    top = work.table(top.select("m.name", F.col("m.digest").alias("subroot"), path.alias("tail")), "tops")

    member = _tails(levels, top, bits, run).select("kids", "nodes", "tail", "subroot", F.posexplode("members").alias("at", "m"))
    member = member.select("m.doc_id", "m.leaf", "m.tampered", "subroot", path.alias("path"))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), ""), 256)
    folded = F.aggregate("path", F.coalesce("tampered", "leaf"), lambda h, s: F.sha2(F.concat(s["l"], h, s["r"]), 256))
    done = member.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))
