"""Mixing sources to target weights by hierarchical budgeting.

A tree (domain, language, source) carries weights. The token budget is propagated from the root; a node
that cannot spend its share gives the rest to its siblings, and only what no sibling can take goes up to
the ancestors' siblings. Each leaf then takes the token prefix of its documents in seeded epochs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Tables, cut, read, settle_executors, unused

BITS, DEPTH = 8, 3  # of a leaf's order, 2**8 slices are summed at each of three levels before any row is ranked
TOKEN = r"[^\x20\x09-\x0D]+"


def shares(tree: dict, budget: int) -> dict[tuple, int]:
    """Whole-number budgets of the leaves.

    ``tree`` maps a leaf's path to (weights along the path, capacity). At each node the budget is split by
    the children's weights; a child takes at most its capacity (the sum of its leaves'), and what is left is
    split again among the siblings that can take more, by weight, before it counts as unspent at the
    parent, whose own siblings then get it. Weights of zero get tokens only when no weighted sibling
    can take them. Fractions go to the largest remainder, ties to the smaller name.
    """
    out: dict[tuple, int] = {}

    def spend(paths: dict, depth: int, amount: int) -> None:
        groups: dict = {}
        for p, v in paths.items():
            groups.setdefault(p[depth], {})[p] = v
        names = sorted(groups, key=lambda x: (x is not None, str(x)))
        room = {g: sum(v[1] for v in groups[g].values()) for g in names}
        weight = {g: next(iter(groups[g].values()))[0][depth] for g in names}
        given = dict.fromkeys(names, 0)
        amount = min(amount, sum(room.values()))
        for positive in (True, False):
            while amount > 0 and (live := [g for g in names if given[g] < room[g] and (weight[g] > 0) == positive]):
                total = sum(weight[g] for g in live) if positive else len(live)
                part = {g: amount * ((weight[g] if positive else 1) / total) for g in live}
                full = [g for g in live if part[g] >= room[g] - given[g]]
                if full:
                    for g in full:
                        amount -= room[g] - given[g]
                        given[g] = room[g]
                    continue
                whole = {g: int(part[g]) for g in live}
                rest = amount - sum(whole.values())
                for g in sorted(live, key=lambda g: (whole[g] - part[g], names.index(g)))[:rest]:
                    whole[g] += 1
                for g in live:
                    given[g] += whole[g]
                amount = 0
        for g in names:
            if depth + 1 == len(next(iter(groups[g]))):
                for p in groups[g]:
                    out[p] = given[g]
            else:
                spend(groups[g], depth + 1, given[g])

    if tree:
        spend(tree, 0, int(budget))
    return out


def ordered(content: Column, seed: int, epoch: Column) -> Column:
    """Place of a row in an epoch's order, from 0 below 2**63; rows of equal place follow by their content hash."""
    return F.shiftrightunsigned(F.xxhash64(content, F.lit(seed), epoch), 1)


def content_of(docs: DataFrame) -> Column:
    """64-bit hash of a whole row; columns that hold maps count as their JSON."""
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{f.name}`").alias("x"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema])


def mix(docs: DataFrame, levels: dict[str, Column], weights: dict[tuple, float] | None = None, budget: float = 0.5, max_epochs: int = 2, seed: int = 17, tokens: Column | None = None, max_leaves: int = 100_000) -> DataFrame:
    """``docs`` (all columns) with ``mix_epoch`` and ``mix_tokens``: the rows that the mixture takes, once an epoch.

    ``levels`` names the tree's levels, top first, with their columns (a null value is a branch of its own).
    ``weights`` gives the weight of a node by its path (1 where absent); ``budget`` is the number of tokens, or
    as a fraction up to 1 the share of all tokens; a leaf is read at most ``max_epochs`` times. In each epoch
    a leaf's rows come in a new seeded order of their content hash; it takes rows while the tokens
    before them are below its budget, so the row that crosses the line is taken whole. Rows without
    tokens (null or empty texts) are taken while their leaf's epoch lasts. Equal rows tie, and as many of them are taken as the
    budget reaches. A text may be of any length; an empty table stays empty. Should the input have columns of the two added names, these get
    underscores at their end until they differ.

    Where a budget ends is found by sums over ever finer slices of the order (2 ** ``BITS`` a level, ``DEPTH`` levels), so no leaf,
    however large, meets in one task; equal rows at the line are counted, and one of them repeated. The tree of leaf sums is resolved on the driver: it has a row a leaf,
    and more than ``max_leaves`` leaves are refused.
    """
    spark, tables = docs.sparkSession, Tables(docs.sparkSession)
    names = docs.columns
    tokens = tokens if tokens is not None else F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(TOKEN)).cast("long")
    path = F.struct(*[F.coalesce(c.cast("string"), F.lit("\0null")).alias(k) for k, c in levels.items()])
    content = content_of(docs)
    keyed = tables.cut(docs.select(path.alias("leaf"), tokens.alias("t"), content.alias("h")))
    leaves = keyed.groupBy("leaf").agg(F.sum("t").alias("t")).limit(max_leaves + 1).collect()
    if len(leaves) > max_leaves:
        raise ValueError(f"more than {max_leaves} leaves")
    total = sum(r["t"] for r in leaves)
    goal = int(budget * total) if budget <= 1 else int(budget)
    weights = weights or {}
    tree = {tuple(r["leaf"]): (tuple(float(weights.get(tuple(r["leaf"])[: d + 1], 1.0)) for d in range(len(levels))), r["t"] * max_epochs) for r in leaves}
    size = {tuple(r["leaf"]): r["t"] for r in leaves}
    plan = [(*p, n // size[p] if size[p] else 0, n % size[p] if size[p] else 0) for p, n in shares(tree, goal).items()]
    schema = ", ".join(f"`{k}` string" for k in levels) + ", `full epochs` long, `rest of one` long"
    small = F.broadcast if len(leaves) <= 20_000 else lambda x: x  # a row a leaf
    plan = spark.createDataFrame(plan, schema).select(F.struct(*[F.col(f"`{k}`") for k in levels]).alias("leaf"), F.col("full epochs").alias("full"), F.col("rest of one").alias("rest"))

    # The last epoch of each leaf is cut at its rest: find the slice of the order in which it ends, level by level.
    last = keyed.join(small(plan), "leaf").where("rest > 0").withColumn("v", ordered(F.col("h"), seed, F.col("full").cast("int")))
    last = last.select("leaf", "t", "h", "v", "rest", F.lit(0).cast("long").alias("before"))
    for level in range(1, DEPTH + 1):
        slice_of = F.pmod(F.shiftrightunsigned(F.col("v"), 63 - BITS * level), F.lit(1 << BITS))
        sums = last.groupBy("leaf", slice_of.alias("s")).agg(F.sum("t").alias("t"), F.first("rest").alias("rest"), F.first("before").alias("before"))
        w = Window.partitionBy("leaf").orderBy("s")
        ends = sums.withColumn("before", F.col("before") + F.sum("t").over(w) - F.col("t")).where("before < rest")
        ends = tables.cut(ends.groupBy("leaf").agg(F.max_by(F.struct("s", "before"), "s").alias("e")).select("leaf", "e.*"))
        last = last.drop("before").withColumn("s", slice_of).join(small(ends), ["leaf", "s"]).drop("s")
    # What is left of the leaf, a handful of rows, is ranked one by one.
    w = Window.partitionBy("leaf").orderBy("v", "h")
    same = last.groupBy("leaf", "v", "h").agg(F.sum("t").alias("t"), F.count("*").alias("n"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    same = same.withColumn("at", F.col("before") + F.sum("t").over(w) - F.col("t")).where("at < rest")
    limit = same.groupBy("leaf").agg(F.max_by(F.struct("v", "h", "at", "rest", "t", "n"), F.struct("v", "h")).alias("c"))
    take = F.when(F.col("c.t") > 0, F.ceil((F.col("c.rest") - F.col("c.at")) / (F.col("c.t") / F.col("c.n")))).otherwise(F.col("c.n"))
    limit = cut(limit.select("leaf", "c.v", "c.h", take.cast("long").alias("take"), "c.n"))
    tables.drop()

    leaf_, t_, h_, v_, cut_, row_, epoch_, tokens_ = unused(names, "_leaf", "_t", "_h", "_v", "_cut", "_row", "mix_epoch", "mix_tokens")
    bounds = plan.join(limit, "leaf", "left").select(F.col("leaf").alias(leaf_), F.struct("full", "v", "h", "take", "n").alias(cut_))
    own = [F.col(f"`{c}`") for c in names]
    rows = docs.select(*own, path.alias(leaf_), tokens.alias(t_), content.alias(h_)).join(small(bounds), leaf_)
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias(epoch_)).withColumn(v_, ordered(F.col(h_), seed, F.col(epoch_)))
    here = F.struct(F.col(v_).alias("v"), F.col(h_).alias("h"))
    line = F.struct(F.col(f"{cut_}.v").alias("v"), F.col(f"{cut_}.h").alias("h"))
    partly = (F.col(epoch_) == F.col(f"{cut_}.full")) & F.col(f"{cut_}.v").isNotNull()
    rows = rows.where((F.col(epoch_) < F.col(f"{cut_}.full")) | (partly & (here <= line)))
    tied = partly & (here == line) & (F.col(f"{cut_}.take") < F.col(f"{cut_}.n"))
    out = [*own, F.col(epoch_), F.col(t_).alias(tokens_)]
    if limit.where("take < n").limit(1).count():
        # Equal rows at the very line: one stands for all, as often as it takes.
        one = rows.where(tied).groupBy(leaf_).agg(F.first(F.struct(*out)).alias(row_), F.first(f"{cut_}.take").alias(t_))
        few = one.select(row_, F.explode(F.sequence(F.lit(1).cast("long"), F.col(t_)))).select(f"{row_}.*")
        return rows.where(~tied).select(*out).union(few)
    return rows.select(*out)


def domain(source: Column) -> Column:
    """A domain for each source: the number at its end, by 4."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1).try_cast("long")
    return F.concat(F.lit("domain"), F.pmod(F.coalesce(number, F.lit(0)), F.lit(4)))


def levels() -> dict[str, Column]:
    return {"domain": domain(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}


#: Target weights by path; nodes that are not named have weight 1.
WEIGHTS = {("domain0",): 4.0, ("domain1",): 3.0, ("domain2",): 2.0, ("domain3",): 1.0}


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixture of 60 % of all tokens by domain, language and source, each leaf read up to twice."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = mix(docs, levels(), WEIGHTS, budget=0.6, max_epochs=2)
    return out.select("doc_id", F.col("mix_epoch").alias("epoch"), "lang", "source", F.col("mix_tokens").alias("n_tokens"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: 60 % of the tokens that are left, by target weights, no document twice (nulls, ties and repeats as in ``mix``)."""
    settle_executors(spark)
    return mix(docs, levels(), WEIGHTS, budget=0.6, max_epochs=1).select(*[F.col(f"`{c}`") for c in docs.columns])
