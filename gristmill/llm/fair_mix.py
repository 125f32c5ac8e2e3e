"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cells, cut, lookup, running_sum


def words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Add rank, weight and target to sources (source, source_size).

    Sources in code point order, null last, take the weights in turn. A share of all sizes is dealt by weight; a target
    stops at `most` times its source's size and the excess is dealt again, until none is above. With r the level at
    which a source stops (most * size / weight) and sources in the order of r, the level over all that don't stop
    before source k is (budget - sum of the stops before) / (sum of the weights from k on): the first k whose level is
    not above r_k fixes the level. One row per source goes through these windows, whatever the number of documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_level = Window.orderBy("stop", "rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sources.withColumn("rank", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    top = F.lit(most) * F.col("source_size")
    ranked = ranked.withColumn("stop", top / F.col("weight"))
    stopped, weighed = F.coalesce(F.sum(top).over(before), F.lit(0.0)), F.coalesce(F.sum("weight").over(before), F.lit(0))
    budget, weight = F.lit(share) * F.sum("source_size").over(whole), F.sum("weight").over(whole)
    ranked = ranked.withColumn("level", (budget - stopped) / (weight - weighed))
    level = F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", "rank", "level"))).over(whole)["level"]
    return ranked.withColumn("target", F.coalesce(F.least(top, level * F.col("weight")), top)).drop("stop", "level")


def _queued(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows (_gm_source, _gm_id, _gm_h, size, ...) with their source's row and _gm_cum, the running size in the shuffled order."""
    rows = lookup(rows, sources, "_gm_source", F.col("_gm_h"))
    rows = rows.withColumn("_gm_cell", F.expr("shiftrightunsigned(_gm_h, 63 - _gm_bits)"))
    return running_sum(rows, ["_gm_rank"], "_gm_cell", [F.col("_gm_h"), F.col("_gm_id"), F.col("size")], F.col("size"), "_gm_cum")


def _finish(copy: int) -> Column:
    return (F.lit(copy) * F.col("_gm_size") + F.col("_gm_cum")) / F.col("_gm_target")


def _place(copy: int) -> Column:
    """A copy's place in the order over all sources."""
    return F.struct(_finish(copy).alias("finish"), F.col("_gm_rank").alias("rank"), F.col("_gm_h").alias("h"), F.col("_gm_id").alias("id"), F.lit(copy).alias("copy"))


def _cutoff(queued: DataFrame, most: int, budget: float, n_cells: int):
    """The last place within the budget; None if all fit. Copies are sorted within one range of finish time only: the one the budget ends in."""
    copies = queued.where("size > 0").select("size", F.explode(F.array(*map(_place, range(most)))).alias("at"))
    time = F.col("at.finish")
    cell = F.when(time <= 1, F.floor(time * n_cells)).otherwise(n_cells + F.floor(n_cells * F.log2(time)))
    copies = copies.withColumn("cell", cell.cast("long"))
    sums = copies.groupBy("cell").agg(F.sum("size").alias("size"))
    upto = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = sums.withColumn("cum", F.sum("size").over(upto)).where(F.col("cum") > F.lit(budget)).orderBy("cell").first()
    if full is None:
        return None
    inner = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = copies.where(F.col("cell") == full["cell"]).withColumn("cum", F.sum("size").over(inner) + F.lit(full["cum"] - full["size"]))
    last = edge.where(F.col("cum") <= F.lit(budget)).agg(F.max("at").alias("at")).first()["at"]
    if last is None:  # not even the range's first copy fits: the order is cut before it
        last = copies.where(F.col("cell") < full["cell"]).agg(F.max("at").alias("at")).first()["at"]
    return last if last is not None else (-1.0, 0, 0, "", 0)


def mix(docs: DataFrame, size: Column | None = None, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs with the columns size, source_size, target, copies, taken and finish (the first copy's virtual time).

    Each source's documents are shuffled by a seeded hash of their id. A document's copy e (0 to most - 1) has the
    virtual finish time (e * source's size + running size in the shuffled order) / target of the source. All copies
    of all sources are put in the order of finish time, cut into ranges of it, and those stay whose running size
    is within the budget, `share` of all sizes. Copies are taken whole: no document is taken more than `most` times.

    Null and empty texts have size 0 and take nothing. Null ids and sources are values like any other. Repeated rows
    are documents of their own; which of several equal rows is taken more often is open. An empty table gives no rows.
    Columns of docs stay, but for the six named above, which replace those of the same name.
    """
    own = ["size", "source_size", "target", "copies", "taken", "finish"]
    names = [c for c in docs.columns if c not in own]
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col).cast("string")), 1)
    n_words = words(F.col(text_col)) if size is None else F.coalesce(size, F.lit(0)).cast("long")
    whole = docs.select(*names, n_words.alias("size"), F.col(source_col).alias("_gm_source"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_gm_id"), key.alias("_gm_h"))
    slim = whole.select("_gm_source", "_gm_id", "_gm_h", "size")
    only = set(names) <= {id_col, source_col}
    slim = cut(whole if only else slim, "mix-sizes")
    sums = slim.groupBy(F.col("_gm_source").alias("source")).agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    sources = cut(targets(sums, weights, share, most).select(F.col("source").alias("_gm_source"), F.col("source_size").alias("_gm_size"), F.col("target").alias("_gm_target"), F.col("rank").alias("_gm_rank"), F.greatest(F.lit(0), F.least(F.lit(20), F.ceil(F.log2(F.col("rows") / 512)))).cast("int").alias("_gm_bits"), "rows"), "mix-targets")
    total = sources.agg(F.sum("_gm_size").alias("size"), F.sum("rows").alias("rows")).first()
    sources = sources.drop("rows")
    last = _cutoff(_queued(slim, sources), most, share * (total["size"] or 0), cells(most * (total["rows"] or 0)))
    rows = _queued(slim if only else whole, sources)
    if last is None:
        copies = F.when(F.col("size") > 0, most).otherwise(0)
    else:
        bound = F.struct(F.lit(float(last[0])), F.lit(int(last[1])), F.lit(int(last[2])).cast("long"), F.lit(last[3]), F.lit(int(last[4])))
        copies = sum(F.when((F.col("size") > 0) & (_place(e) <= bound), 1).otherwise(0) for e in range(most))
    return rows.select(*names, "size", F.col("_gm_size").alias("source_size"), F.col("_gm_target").alias("target"), copies.cast("int").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), _finish(0).alias("finish"))


def mixed_corpus(docs: DataFrame, ordered: bool = False, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mixture itself: each document as often as it is taken, columns as in docs, whatever their names; ordered: sorted by virtual finish time."""
    other = {c: f"_c{k}" for k, c in enumerate(docs.columns) if c.startswith("_gm_") or c in ("size", "source_size", "target", "copies", "taken", "finish")}
    mixed = mix(docs.withColumnsRenamed(other), id_col=id_col, source_col=source_col, text_col=text_col, **options).where("copies > 0")
    rows = mixed.withColumn("_gm_copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    if ordered:
        rows = rows.orderBy(F.col("finish") + F.col("_gm_copy") * F.col("source_size") / F.col("target"))
    return rows.select(*(F.col(other.get(c, c)).alias(c) for c in docs.columns))
