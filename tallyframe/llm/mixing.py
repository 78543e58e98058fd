"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.llm._common import WORD, Scratch, uniform

#: Classes of the ranking variable that are summed before single documents are looked at.
STEPS = 4_096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weight: Column, share: float, most: float) -> DataFrame:
    """(source, source_size, target): ``share`` of all sizes, split by weight, no source above ``most`` times its size.

    sizes: source, source_size, place (0, 1, ... in the order of sources). Resharing the excess until no source
    is above its limit ends at one common amount per unit of weight; sources whose limit lies below that amount
    stop at their limit. Sorted by limit per weight, running sums find that amount without iterating. These
    windows see one row for each source, never documents.
    """
    limits = sizes.withColumn("w", weight.cast("double")).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    order = W.orderBy(F.col("limit") / F.col("w"), "place")
    everything = W.partitionBy()
    run = limits.select("*", (F.sum("source_size").over(everything) * F.lit(share)).alias("total"), F.sum("w").over(everything).alias("all_w"), F.sum("limit").over(order.rowsBetween(W.unboundedPreceding, -1)).alias("full"), F.sum("w").over(order.rowsBetween(W.unboundedPreceding, -1)).alias("gone"))
    level = (F.col("total") - F.coalesce("full", F.lit(0.0))) / (F.col("all_w") - F.coalesce("gone", F.lit(0.0)))
    run = run.withColumn("level", F.max(F.when(level * F.col("w") <= F.col("limit"), level)).over(everything))
    return run.select("source", "source_size", F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("level") * F.col("w"))).alias("target"))


def cyclic_weight(weights: tuple[float, ...] = (3.0, 1.0, 2.0)) -> Column:
    """Weights repeated over the order of sources."""
    return F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))


def _ranked(rows: DataFrame, plan: DataFrame, most: int, seed: str) -> DataFrame:
    """rows (id, source, value, ...) with whole (certain copies), rank (odds of a random number over the odds of
    what remains; null where no more copy is allowed) and step (the class of the rank)."""
    known = rows.alias("d").join(plan.alias("t"), F.expr("d.source <=> t.source")).select("d.*", *[f"t.{c}" for c in plan.columns if c != "source"])
    expected = F.least(F.lit(float(most)), F.col("rate") * F.col("value"))
    whole = F.floor(expected + 1e-12)
    part = F.least(F.greatest(expected - whole, F.lit(1e-9)), F.lit(1 - 1e-9))
    random = uniform(F.coalesce(F.col("id").cast("string"), F.col("alt")), seed=seed)
    known = known.withColumns({"whole": whole.cast("int"), "rank": F.when(whole < most, (random / (1 - random)) / (part / (1 - part)))})
    return known.withColumn("step", F.floor(F.col("rank") / (1 + F.col("rank")) * STEPS).cast("int"))


def _value(value: Column | None) -> Column:
    return (F.lit(1.0) if value is None else F.greatest(F.coalesce(value.cast("double"), F.lit(1.0)), F.lit(0.0))).alias("value")


def _alt(id_col: str, text_col: str) -> Column:
    """What stands for the id of a row without one when random numbers are drawn."""
    return F.when(F.col(id_col).isNull(), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))).alias("alt")


def rates(sized: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """(source, rate): the expected copies per unit of value at which each source's words come to its target.

    Documents whose rate times value passes ``most`` are held there, and what they leave goes to the others of their
    source: each round holds more of them, until the rates are such that none is added.
    """
    by = sized.alias("d").join(F.broadcast(targets.alias("t")), F.expr("d.source <=> t.source")).select("d.source", "d.size", "d.value", "t.target")  # one row for each source
    now = by.groupBy("source").agg(F.max("target").alias("target"), F.sum(F.col("size") * F.col("value")).alias("free"))
    now = {r.source: (r.target / r.free if r.free else 0.0, 0) for r in now.collect()}
    spark = sized.sparkSession
    kind = f"source {dict(sized.dtypes)['source']}, rate double"
    while True:
        table = spark.createDataFrame([(k, v) for k, (v, _) in now.items()], kind)
        held = by.alias("d").join(F.broadcast(table.alias("r")), F.expr("d.source <=> r.source")).select("d.*", (F.col("rate") * F.col("value") >= most).alias("full"))
        sums = held.groupBy("source").agg(F.max("target").alias("target"), F.coalesce(F.sum(F.when(~F.col("full"), F.col("size") * F.col("value"))), F.lit(0.0)).alias("free"), F.coalesce(F.sum(F.when(F.col("full"), F.col("size"))), F.lit(0)).alias("full"), F.count(F.when(F.col("full"), 1)).alias("n")).collect()
        new = {r.source: ((r.target - most * r.full) / r.free if r.free > 0 and r.n > now[r.source][1] else now[r.source][0], r.n) for r in sums}
        if all(new[k][1] == now[k][1] for k in now):
            return table
        now = new


def source_plan(sized: DataFrame, weight: Column, share: float, most: int, seed: str, unequal: bool = False) -> DataFrame:
    """Per source: source_size, target, rate (expected copies per unit of value), and up to where ranks get one copy more.

    sized: id, source, size, value. Words are summed by class of ranks (pre-aggregated before the shuffle); the
    running sum over at most STEPS classes tells in which class the target is reached, and only that class, about
    1 / STEPS of a source's documents, is sorted.
    """
    scratch = Scratch(sized.sparkSession, "mix")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("value")).alias("valued"))
    by_source = scratch.save(by_source.withColumn("place", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1))
    targets = source_targets(by_source, weight, share, most)
    plan = by_source.alias("s").join(targets.alias("t"), F.expr("s.source <=> t.source")).select("s.source", "s.source_size", "t.target", F.when(F.col("valued") > 0, F.col("target") / F.col("valued")).otherwise(0.0).alias("rate"))
    if unequal:
        plan = plan.alias("p").join(rates(sized, targets, most).alias("r"), F.expr("p.source <=> r.source")).select("p.source", "p.source_size", "p.target", "r.rate")
    plan = rated = scratch.save(plan)
    known = scratch.save(_ranked(sized, plan, most, seed))
    certain = known.groupBy("source").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("rest"))
    classes = known.where("step is not null").groupBy("source", "step").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(W.partitionBy("source").orderBy("step").rowsBetween(W.unboundedPreceding, -1))
    classes = classes.withColumn("before", F.coalesce(before, F.lit(0))).alias("c").join(certain.alias("r"), F.expr("c.source <=> r.source")).select("c.*", "r.rest")
    classes = scratch.save(classes.where("before < rest"))
    last = classes.where("before + words <= rest").groupBy("source").agg(F.max("step").alias("all_to"))
    split = classes.where("before + words > rest")
    inside = W.partitionBy("source").orderBy("rank", "id", "size").rowsBetween(W.unboundedPreceding, 0)
    cut = known.alias("d").join(split.alias("c"), F.expr("d.source <=> c.source and d.step = c.step")).select("d.source", "d.id", "d.size", "d.rank", "c.before", "c.rest")
    cut = cut.withColumn("upto", F.col("before") + F.sum("size").over(inside)).where(F.col("upto") - F.col("size") / 2.0 <= F.col("rest"))
    cut = cut.groupBy("source").agg(F.max(F.struct("rank", "id")).alias("cut"))
    plan = plan.alias("p").join(last.alias("l"), F.expr("p.source <=> l.source"), "left").join(cut.alias("c"), F.expr("p.source <=> c.source"), "left")
    done = scratch.save(plan.select("p.*", "l.all_to", "c.cut"))
    for used in (by_source, rated, known, classes):
        scratch.drop(used)
    return done


def _copies(ranked: DataFrame) -> Column:
    return F.col("whole") + F.coalesce((F.col("step") <= F.col("all_to")) | (F.struct("rank", "id") <= F.col("cut")), F.lit(False)).cast("int")


def mix(docs: DataFrame, weight: Column | None = None, share: float = 1.5, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", value: Column | None = None, seed: str = "mix") -> DataFrame:
    """Per document: id, size (words), source_size, target (of its source), copies, and taken (copies times size).

    ``weight`` is a column over ``place``, the rank of the source by code point with null last (from 0); default:
    3, 1, 2 repeating. A document's expected copies are target / source_size, in proportion to ``value`` (a
    positive column; null counts as 1) where given, and ``most`` at most. The whole part is taken for certain.
    Documents then are ranked by the odds of a random number over the odds of what remains, and the least ranks
    get one copy more until the words are nearest to the target: the sum is fixed, the choice is random. What a
    document at ``most`` copies can't take goes to the others of its source. The random number comes from the id (of a
    null id the text) and the seed, so reruns agree; equal ranks go by id and size.

    Null and wordless texts have size 0 and add nothing. A null source is a source of its own. Repeated rows are
    each a document (with like ranks). An empty table gives an empty result. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sized = scratch.save(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), _value(value), _alt(id_col, text_col)))
    ranked = _ranked(sized, source_plan(sized, weight if weight is not None else cyclic_weight(), share, most, seed, value is not None), most, seed)
    ranked = ranked.withColumn("copies", _copies(ranked))
    return ranked.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weight: Column | None = None, share: float = 1.5, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", value: Column | None = None, seed: str = "mix") -> DataFrame:
    """``docs`` with each row as often as the mix takes it. Rows meet only the plan, one row for each source."""
    scratch = Scratch(docs.sparkSession, "mix")
    sized = scratch.save(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), _value(value), _alt(id_col, text_col)))
    plan = source_plan(sized, weight if weight is not None else cyclic_weight(), share, most, seed, value is not None)
    whole = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), _value(value), _alt(id_col, text_col), F.struct(*docs.columns).alias("doc"))
    ranked = _ranked(whole, plan, most, seed)
    return ranked.withColumn("copies", _copies(ranked)).where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
