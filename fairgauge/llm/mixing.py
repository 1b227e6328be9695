"""Mixing sources to target weights by capped water-filling (native: DataFrame functions only).

Every source has a size (its words) and a weight. Targets share a budget by weight; a source may be repeated at most
``max_epochs`` times, so its target stops there and what it leaves over is shared again, by weight, among the rest,
until no target is above its ceiling. A target of e sizes takes every document floor(e) times and a seeded sample of
documents once more, so that the source's taken words meet the target within half of the document at the cut.

Cases: a null text counts 0 words and is taken 0 words; a null source is a source of its own (last in code point
order); repeated rows are rows of their own; an empty table gives an empty result; other columns are carried along
by ``mixed_rows`` and may have any name. The same rows give the same result in any partitioning: the sample goes by a
hash of the row's id, text and seed; rows equal in these are interchangeable and tied rows are parted by a second
distributed sort only where the cut falls among them.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairgauge.llm.common import carried, cut, dense_positions, free_name, word_count

#: Columns of the result; a carried column called like one of them gets underscores.
RESULT = ["doc_id", "source", "size", "source_size", "target", "epochs", "repeats", "taken"]

#: Bits of the sampling hash that one search level resolves (4096 cells a source and level).
LEVEL_BITS = 12
LEVELS = 5


def source_totals(sized: DataFrame) -> DataFrame:
    """``source, source_size`` from rows with ``source, size``; one row a source, a null source included."""
    return sized.groupBy("source").agg(F.sum("size").alias("source_size"))


def cyclic_weights(totals: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``totals`` with ``weight``: the cycle dealt out over the sources by code point, null last."""
    ranked = dense_positions(totals, [F.col("source").isNull(), F.col("source")], "_n")
    picked = F.element_at(F.array(*[F.lit(float(c)) for c in cycle]), (F.col("_n") % len(cycle) + 1).cast("int"))
    return ranked.withColumn("weight", picked).drop("_n")


def water_fill(totals: DataFrame, max_epochs: float = 3.0, budget: float | None = None) -> DataFrame:
    """``totals(source, source_size, weight)`` with ``target`` and ``epochs``.

    The budget defaults to all sizes. Each round clamps the sources whose share exceeds their ceiling and shares the
    rest anew; a round is one aggregate over the sources whose single row reaches the driver. Clamped sources stay
    clamped, because the level only rises."""
    ceiling = F.col("source_size") * max_epochs
    total = totals.agg(F.sum("source_size")).first()[0] or 0
    budget = float(total if budget is None else budget)
    budget = min(budget, float(total) * max_epochs)
    level, clamped = 0.0, -1
    while True:
        over = (F.col("weight") * F.lit(level) >= ceiling)
        row = totals.agg(F.sum(F.when(over, ceiling).otherwise(0.0)).alias("fixed"), F.count(F.when(over, 1)).alias("n"),
                         F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("w")).first()
        if row.n == clamped or not row.w:
            break
        clamped, level = row.n, (budget - row.fixed) / row.w
    over = (F.col("weight") * F.lit(level) >= ceiling)
    return (totals.withColumn("target", F.when(over, ceiling).otherwise(F.col("weight") * F.lit(level)).cast("double"))
            .withColumn("epochs", F.when(F.col("source_size") == 0, 0.0)
                        .otherwise(F.least(F.lit(max_epochs), F.col("target") / F.greatest("source_size", F.lit(1))))))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _join_source(df: DataFrame, by_source: DataFrame) -> DataFrame:
    """Left join on ``source``, null matching null. One row a source on the right; AQE broadcasts it if it is small and
    splits a hot source's partition otherwise."""
    right = by_source.withColumnRenamed("source", "_s")
    return df.join(right, _same(df["source"], right["_s"]), "left").drop("_s")


def _cut_points(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per source, the hash value at which the running sum of sizes in hash order passes ``rest``:
    ``source, cut, before`` (sum of sizes below the cut).

    A prefix search over 60 bits of the hash, 12 a level: each level sums sizes by (source, cell), at most 4096 cells a
    source, and keeps the cell in which the sum passes. No source's rows ever meet in one task."""
    state = wanted.select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    live = rows
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        cell = F.shiftright("u", shift)
        cells = live.groupBy("source", cell.alias("cell")).agg(F.sum("size").alias("words"))
        order = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
        run = _join_source(cells, state.drop("prefix")).withColumn("upto", F.col("before") + F.sum("words").over(order))
        hit = run.where(F.col("upto") > F.col("rest")).groupBy("source", "rest").agg(
            F.min(F.struct("cell", (F.col("upto") - F.col("words")).alias("before"))).alias("hit"))
        state = cut(hit.select("source", "rest", F.col("hit.cell").alias("prefix"), F.col("hit.before").alias("before")), "cut")
        chosen = state.select("source", F.col("prefix").alias("_p"))
        live = _join_source(rows, chosen).where(F.shiftright("u", shift) == F.col("_p")).drop("_p")
    return state.select("source", F.col("prefix").alias("cut"), "before", "rest")


def mix(docs: DataFrame, weights: DataFrame | None = None, max_epochs: float = 3.0, budget: float | None = None,
        seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        carry: list[str] | None = None) -> DataFrame:
    """Per document: ``doc_id, source, size, source_size, target, epochs, repeats, taken`` and the ``carry`` columns.

    ``weights(source, weight)`` sets the weights (a source it lacks weighs 0); without it the sources weigh 1, 2, 3,
    repeating, by code point. The narrow projection (id, source, size, hash) is written once; every later step reads
    it, never the texts (unless ``carry`` names them)."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"), F.col(text_col)))
    u = F.conv(F.substring(digest, 1, LEVEL_BITS * LEVELS // 4), 16, 10).cast("long")
    extra = [F.col(c).alias(f"_c{i}") for i, c in enumerate(carry or [])]
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                           word_count(F.col(text_col)).alias("size"), u.alias("u"), *extra), "sized")
    totals = cut(source_totals(rows), "totals")
    if weights is None:
        totals = cyclic_weights(totals)
    else:
        totals = _join_source(totals, weights.select("source", F.col("weight").cast("double"))).fillna(0.0, ["weight"])
    filled = cut(water_fill(totals, max_epochs, budget), "targets")
    wanted = filled.withColumn("whole", F.floor("epochs")).withColumn(
        "rest", F.col("target") - F.col("whole") * F.col("source_size"))
    cuts = _cut_points(rows.select("source", "size", "u"), wanted.where("rest > 0"))
    plan = cut(_join_source(wanted, cuts.drop("rest")).select(
        "source", "source_size", "target", "epochs", "whole", "rest", "cut", "before"), "plan")
    joined = _join_source(rows, plan)
    # Rows that share the cut value (nearly always one): taken in a fixed order while each brings the sum nearer.
    edge = joined.where(F.col("u") == F.col("cut"))
    edge = dense_positions(cut(edge, "edge"), [F.col("source"), F.col("doc_id"), F.col("size")], "_n")
    firsts = edge.groupBy("source").agg(F.min("_n").alias("_first"))
    edge = _join_source(edge, firsts)
    # Rows tied at one cut value have one id and text, hence one size: how many fit is a division.
    fits = F.floor((F.col("rest") - F.col("before")) / F.greatest(F.col("size"), F.lit(1)) + F.lit(0.5))
    edge_extra = (F.col("_n") - F.col("_first") < fits).cast("long")
    below = joined.where(~F.coalesce(F.col("u") == F.col("cut"), F.lit(False)))
    below = below.withColumn("_more", F.when(F.col("rest") <= 0, 0).otherwise(
        F.coalesce((F.col("u") < F.col("cut")).cast("long"), F.lit(1))))
    out = below.unionByName(edge.withColumn("_more", edge_extra).drop("_n", "_first"))
    out = out.withColumn("repeats", F.coalesce(F.col("whole") + F.col("_more"), F.lit(0)).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "epochs", "repeats",
                      (F.col("repeats") * F.col("size")).alias("taken"),
                      *[F.col(f"_c{(carry or []).index(c)}").alias(n) for c, n in carried(carry, RESULT).items()])


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document row as often as it is taken, with the columns of ``docs``."""
    held = free_name(docs, "row")
    packed = docs.withColumn(held, F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    mixed = mix(packed, carry=[held], **options)
    return mixed.where("repeats > 0").select(held, F.explode(F.array_repeat(F.lit(1), F.col("repeats").cast("int")))) \
        .select(f"{held}.*")
