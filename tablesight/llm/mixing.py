"""Mixing sources to target weights by weighted sampling without replacement. DataFrame functions only.

Every document gets an exponential key, ``-ln(u) / weight`` with ``u`` drawn from its identity: the documents
with the smallest keys of a source are a weighted sample (Efraimidis and Spirakis). A source is taken in
complete epochs as often as its target holds it, and the rest of the target is filled in the order of the keys.

Defined results: a null text has size 0; null sources form one source, ordered last; rows with the same identity and
size share one key and follow in the order of a digest of their texts, equal texts in any order, so that the mix can end between
them; a source without words has target 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tablesight.functions.storage import store

SHARE = 1.5  # words of the mix by words of all documents
MOST_EPOCHS = 2
WEIGHTS = (5, 2, 1)
# Cells per unit of ln(key) on the first level, and within each of those on the second.
COARSE, FINE = 256, 4096
# Rows of one key are dealt by so many hexadecimal digits of the digest of their texts.
DIGITS, CELL_DIGITS = 16, 5
SALTS = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """Between 0 and 1: how near the mean length of a word is to six characters."""
    return 1.0 / (1.0 + F.abs(F.coalesce(F.length(text), F.lit(0)) / F.greatest(size, F.lit(1)) - 6.0))


def draw(identity: Column) -> Column:
    """A number above 0 and below 1 from the first 52 bits of a digest: the same in every run."""
    bits = F.conv(F.substring(F.md5(identity.cast("binary")), 1, 13), 16, 10).cast("long")
    return (bits + 0.5) / F.lit(float(1 << 52))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
            most_epochs: float = MOST_EPOCHS) -> DataFrame:
    """Add ``target`` to one row per source with its ``source_size``.

    A source gets ``weight * level`` words, at most ``most_epochs`` times its size, with the level at which
    all targets add up. Sources reach their cap in the order of cap by weight, so the level follows from running sums.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, from_here = by_cap.rowsBetween(W.unboundedPreceding, -1), by_cap.rowsBetween(0, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).partitionBy()
    return (
        sources.withColumn("weight", cycle).withColumn("cap", F.col("source_size") * float(most_epochs))
        .withColumn("level", (F.sum("source_size").over(everything) * float(share)
                              - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(from_here))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(
            F.col("cap") / F.col("weight"), "level"))).over(everything)["level"])
        .withColumn("target", F.least("cap", F.coalesce(F.col("weight") * F.col("level"), F.col("cap"))))
        .drop("cap", "level"))


def _at_cut(rows: DataFrame, budgets: DataFrame, level: Column) -> DataFrame:
    """Per source, the rows of the first cell of ``level`` in which the running sum of sizes reaches the budget; ``before`` is the sum before that cell."""
    rows = rows.withColumn("level", level)
    running = W.partitionBy("source_key").orderBy("level").rowsBetween(W.unboundedPreceding, W.currentRow)
    cells = (rows.groupBy("source_key", "level").agg(F.sum("size").alias("words"), F.first("before").alias("before")).join(budgets, "source_key")
             .withColumn("sum_to", F.sum("words").over(running) + F.col("before")))
    first = (cells.where(F.col("sum_to") >= F.col("budget")).groupBy("source_key").agg(F.min(F.struct("level", "sum_to", "words")).alias("at"))
             .select("source_key", F.col("at.level").alias("level"), (F.col("at.sum_to") - F.col("at.words")).alias("before")))
    # Joined on source and cell: the rows of a hot source meet only at the cell that is cut.
    return rows.drop("before").join(first, ["source_key", "level"]).drop("level")


def _keyed(docs: DataFrame, identity_col: str, text_col: str, source_col: str) -> DataFrame:
    """``docs`` as one struct column, with size, source and place in the order of each row. Stored by callers, so that all jobs see the same numbers."""
    identity = F.concat_ws(":", F.coalesce(F.col("row")[identity_col].cast("string"), F.lit("")), F.col("size").cast("string"))
    text = F.col("row")[text_col]
    return (
        docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
        .withColumn("source", F.col("row")[source_col].cast("string")).withColumn("size", word_count(text))
        .withColumn("source_key", F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), "source")))
        .withColumn("key", -F.log(draw(identity)) / quality_weight(text, F.col("size")))
        .withColumn("content", F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, DIGITS))
        .withColumn("number", F.monotonically_increasing_id()))


def _times(keyed: DataFrame, cuts: DataFrame) -> DataFrame:
    """Add the columns of ``cuts``, and how often the mix holds each row.

    The one row per source is repeated for every salt, so that a hot source meets it in many tasks.
    """
    salted = cuts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    place = F.struct("key", "content", "number")
    chosen = F.coalesce((place < F.col("cut")) | ((place == F.col("cut")) & F.col("with_cut")), F.lit(True))
    return (keyed.withColumn("salt", F.pmod(F.xxhash64("key", "number"), F.lit(SALTS)).cast("int")).join(salted, ["source_key", "salt"])
            .withColumn("times", (F.col("epochs") + F.when((F.col("budget") > 0) & chosen, 1).otherwise(0)).cast("int")))


def _cuts(keyed: DataFrame, weights: tuple[int, ...], share: float, most_epochs: float) -> DataFrame:
    """Per source its size, target, complete epochs, the budget beyond them, and the row at which that is used up.

    No window spans a source: the running sum goes over cells of the keys (all documents of one coarse cell, then those of one fine
    cell), then over the keys of a single fine cell, with those of one key by digits of the digest of the text, then over whole digests and
    the parts that hold their copies, and only rows of one text in one part are sorted. Statistics per source are one row each.
    """
    sized = store(
        keyed.withColumn("scaled", F.log("key") * COARSE).withColumn("coarse", F.floor("scaled"))
        .withColumn("fine", F.floor((F.col("scaled") - F.col("coarse")) * FINE)).withColumn("before", F.lit(0).cast("long"))
        .select("source", "source_key", "size", "key", "content", "number", "coarse", "fine", "before"))
    per_source = targets(sized.groupBy("source", "source_key").agg(F.sum("size").alias("source_size")), weights, share, most_epochs)
    plan = store(
        per_source.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
        .select("source_key", "source_size", "target", "epochs", "budget"))
    budgets = plan.select("source_key", "budget")

    inside = store(_at_cut(_at_cut(sized.drop("source"), budgets, F.col("coarse")), budgets, F.col("fine")))
    inside = store(_at_cut(inside, budgets, F.struct("key", F.substring("content", 1, CELL_DIGITS))))
    inside = _at_cut(inside, budgets, F.struct("content", F.shiftright("number", 33)))
    cut = _at_cut(inside, budgets, F.col("number")).select("source_key", F.struct("key", "content", "number").alias("cut"), "before", "size")
    # The document at the cut is taken when that brings the sum nearer to the budget.
    return store(plan.join(cut, "source_key", "left").select(
        "source_key", "source_size", "target", "epochs", "budget", "cut",
        (F.col("before") + F.col("size") - F.col("budget") < F.col("budget") - F.col("before")).alias("with_cut")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most_epochs: float = MOST_EPOCHS) -> DataFrame:
    """``(id, size, source_size, target, taken, times)`` for every row; ``times`` is how often the mix holds it."""
    keyed = _keyed(docs.select(id_col, text_col, source_col), id_col, text_col, source_col)
    keyed = store(keyed.withColumn("row", F.struct(F.col("row")[id_col].alias(id_col))))
    return (_times(keyed, _cuts(keyed, weights, share, most_epochs))
            .select(F.col("row")[id_col].alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"), "times"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most_epochs: float = MOST_EPOCHS) -> DataFrame:
    """The mix itself: the rows, with all their columns, each as often as it is taken."""
    keyed = store(_keyed(docs, id_col, text_col, source_col))
    return _times(keyed, _cuts(keyed, weights, share, most_epochs)).where(F.col("times") > 0).select("row", F.explode(F.expr("sequence(1, times)"))).select("row.*")
