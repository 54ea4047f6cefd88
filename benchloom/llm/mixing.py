"""Mixing sources to target weights: budgets down a tree, then a seeded prefix per leaf."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free, store

PREFIX = 3  # hex digits of the order key that cut a leaf into parts for prefix sums


def blank_words(text: str) -> Column:
    """Words of a text as the number of blanks and line feeds plus one; 0 for no text."""
    body = F.coalesce(F.col(text), F.lit(""))
    return F.when(body == "", F.lit(0)).otherwise(
        F.length(body) - F.length(F.translate(body, " \n", "")) + 1).cast("bigint")


def weight_of(name: Column, weights: dict[str, int], default: int = 1) -> Column:
    """Whole-number weight of a node by its name; ``default`` for names not listed."""
    found = F.lit(default)
    for key, weight in weights.items():
        found = F.when(name == key, weight).otherwise(found)
    return found.cast("bigint")


def fill(children: DataFrame, parent: list[str], child: list[str]) -> DataFrame:
    """Share each parent's ``budget`` among its children by ``weight`` up to their ``cap``.

    A child that cannot hold its share gets its capacity, and its siblings share the rest by
    weight; a parent whose children cannot hold its budget was itself capped one level up,
    so a shortage reaches siblings first and ancestors' siblings after that.  Closed form:
    children sorted by capacity per weight are full up to the first one that is not.
    """
    order = Window.partitionBy(*parent).orderBy(
        F.try_divide(F.col("cap").cast("double"), "weight").asc_nulls_last(), *child)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*parent)
    left = F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)).cast("double")
    full = (F.col("weight") > 0) & (
        F.col("cap").cast("double") * F.sum("weight").over(after).cast("double")
        <= F.col("weight").cast("double") * left)
    return (children.withColumn("full", full)
            .withColumn("full", F.min(F.col("full").cast("int")).over(
                order.rowsBetween(Window.unboundedPreceding, 0)) == 1)
            .withColumn("level", F.try_divide(
                F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole),
                                             F.lit(0)).cast("double"),
                F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole).cast("double")))
            .withColumn("target", F.when(F.col("full"), F.col("cap").cast("double"))
                        .when(F.col("weight") > 0, F.col("weight").cast("double") * F.col("level"))
                        .otherwise(0.0))
            .drop("full", "level"))


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: list[dict[str, int]],
                 share: float, max_epochs: int) -> DataFrame:
    """``target`` tokens of every leaf; ``leaves`` has the level columns and ``tokens``.

    The root's budget is ``share`` of all tokens.  A node can hold the tokens below it
    ``max_epochs`` times.
    """
    nodes = leaves.groupBy(*levels).agg((F.sum("tokens") * max_epochs).alias("cap"))
    above = nodes.agg(F.floor(F.coalesce(F.sum("cap"), F.lit(0)) / max_epochs * share)
                      .cast("double").alias("budget")).withColumn("root", F.lit(0))
    parent = ["root"]
    for depth in range(1, len(levels) + 1):
        own = levels[:depth]
        rows = (nodes.groupBy(*own).agg(F.sum("cap").alias("cap")).withColumn("root", F.lit(0))
                .withColumn("weight", weight_of(F.col(own[-1]), weights[depth - 1]))
                .join(above, parent))
        above = fill(rows, parent, own).select("root", *own, F.col("target").alias("budget"))
        parent = ["root", *own]
    return above.select(*levels, F.floor("budget").alias("target"))


def plan_mix(docs: DataFrame, levels: dict[str, Column], weights: list[dict[str, int]],
             share: float, max_epochs: int, seed: str, id_column: str = "doc_id",
             tokens: Column | None = None) -> tuple[DataFrame, Column, DataFrame]:
    """The rows with leaf, ``tokens`` and order ``key``, and the leaf table with its cuts.

    Each leaf is read in seeded epochs: all of it ``full`` times, then the documents whose
    order key in that epoch, MD5 of (seed, epoch, id), is at most ``cut``: the shortest prefix
    of the epoch's order that reaches what is left of the target.  The document that crosses
    the target is taken, so a leaf is never short and at most that document over (see
    :func:`leaf_report`).  Prefix sums use sums by
    the key's first digits; only the part in which the prefix ends is ordered, so a leaf with
    a third of all rows is spread over all tasks.  Rows with equal keys (the same id) are
    taken together.
    """
    names = list(levels)
    rows = docs.select(F.col(id_column).alias("id"),
                       *[F.coalesce(c, F.lit("unknown")).alias(n) for n, c in levels.items()],
                       tokens.alias("tokens"))
    rows = store(rows, "mix")
    sums = rows.groupBy(*names).agg(F.sum("tokens").alias("tokens"))
    leaves = store(
        leaf_budgets(sums, names, weights, share, max_epochs).join(sums, names)
        .withColumn("full", F.when(F.col("tokens") > 0, F.floor(F.col("target") / F.col("tokens")))
                    .otherwise(0).cast("bigint"))
        .withColumn("rest", F.col("target") - F.col("full") * F.col("tokens")), "leaves")
    keyed = (rows.join(leaves.select(*names, "full", "rest"), names)
             .withColumn("key", order_key(seed, F.col("full"), F.col("id")))
             .withColumn("part", F.substring("key", 1, PREFIX)))
    running = Window.partitionBy(*names).orderBy("part")
    ends = (keyed.groupBy(*names, "rest", "part").agg(F.sum("tokens").alias("sum"))
            .withColumn("upto", F.sum("sum").over(running))
            .where("upto >= rest").groupBy(*names)
            .agg(F.min(F.struct("part", (F.col("upto") - F.col("sum")).alias("before")))
                 .alias("end")).select(*names, "end.*"))
    # Up to the key before: rows of one key are taken together.
    own = Window.partitionBy(*names, "key")
    inside = Window.partitionBy(*names).orderBy("key")
    cuts = (keyed.drop("full").join(ends, [*names, "part"])
            .withColumn("passed", F.col("before") + F.sum("tokens").over(inside) - F.sum("tokens").over(own))
            .where("passed < rest").groupBy(*names).agg(F.max("key").alias("inner")))
    # without an end everything fits: 'g' is above every hex digit
    table = store(
        leaves.join(ends, names, "left").join(cuts, names, "left")
        .withColumn("cut", F.coalesce("inner", "part", F.lit("g")))
        .select(*names, "target", "full", "cut"), "cuts")
    epochs = F.col("full") + (order_key(seed, F.col("full"), F.col("id")) <= F.col("cut")).cast("int")
    return rows, epochs, table


def order_key(seed: str, epoch: Column, identity: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"),
                          F.coalesce(identity.cast("string"), F.lit("null"))))


def mix(docs: DataFrame, levels: dict[str, Column], weights: list[dict[str, int]], share: float,
        max_epochs: int, seed: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: leaf, ``tokens``, and ``epochs``, how often the mix takes it."""
    rows, epochs, leaves = plan_mix(docs, levels, weights, share, max_epochs, seed, id_column,
                                    blank_words(text))
    return (rows.join(leaves, list(levels)).withColumn("epochs", epochs.cast("bigint"))
            .select("id", *levels, "tokens", "epochs"))


def leaf_report(mixed: DataFrame, leaves: DataFrame, levels: list[str]) -> DataFrame:
    """``levels, target, reached`` per leaf, of :func:`mix` rows and the plan's leaf table."""
    reached = mixed.groupBy(*levels).agg(F.sum(F.col("tokens") * F.col("epochs")).alias("reached"))
    return leaves.select(*levels, "target").join(reached, levels)


def mixed_documents(docs: DataFrame, levels: dict[str, Column], weights: list[dict[str, int]],
                    share: float, max_epochs: int, seed: str, id_column: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """The rows of ``docs`` the mix takes, each as many times as it takes them.

    The leaf table (one row per leaf) decides; the texts are not shuffled if Spark finds
    that table small.
    """
    _, epochs, leaves = plan_mix(docs, levels, weights, share, max_epochs, seed, id_column,
                                 blank_words(text))
    *names, full, cut, times = free(docs.columns, *[f"__{n}" for n in levels], "__full", "__cut", "__times")
    leaves = leaves.select(*[F.col(n).alias(new) for n, new in zip(levels, names)],
                           F.col("full").alias(full), F.col("cut").alias(cut))
    same = [F.coalesce(c, F.lit("unknown")) == F.col(n) for n, c in zip(names, levels.values())]
    condition = same[0]
    for more in same[1:]:
        condition &= more
    taken = F.col(full) + (order_key(seed, F.col(full), F.col(id_column)) <= F.col(cut)).cast("int")
    return (docs.join(leaves, condition).withColumn(times, taken.cast("int"))
            .where(F.col(times) > 0)
            .withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times))))
            .select(*docs.columns))
