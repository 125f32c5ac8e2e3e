"""Profiles, summaries, comparisons, samples and shards."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.work import cut


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def profile(df: DataFrame, label: str) -> DataFrame:
    """Rows, labelled rows, classes, task type and confidence."""
    one = df.agg(F.count("*").alias("rows"), F.count(label).alias("labelled"), F.array_sort(F.collect_set(F.col(label).cast("string"))).alias("classes"))
    n = F.size("classes")
    task = F.when(n == 2, "binary").when(n > 2, "multi-class").otherwise("none")
    return one.select("rows", "labelled", F.array_join("classes", ",").alias("classes"), task.alias("task_type"), F.when(F.col("rows") == 0, 1.0).when(n >= 2, 1.0).otherwise(0.4).alias("confidence"))


def positions(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with each row's place, from 0, in the order of a column: ranges of it are sorted apart, and a range's start is the
    sum of the counts before it. Null orders come first; of equal orders any comes first. Rows are written to a work table."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, order).sortWithinPartitions(order)
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = cut(ranged.withColumns({"_part": F.spark_partition_id(), "_local": local}), "positions")
    counts = placed.groupBy("_part").agg(F.count("*").alias("n"))  # a row per range
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_local")).drop("_part", "_local", "_start")


def representative_sample(df: DataFrame, order: str, limit: int) -> DataFrame:
    """Evenly spaced rows; a limit of 1 takes the middle one. Places come from counts per range of the order; only the order column is ranked."""
    n = df.count()
    if n <= limit:
        return df
    at = [n // 2] if limit == 1 else sorted({round(k * (n - 1) / (limit - 1)) for k in range(limit)})
    chosen = positions(df.select(F.col(order).alias("_order")), "_order", "_rank").where(F.col("_rank").isin(at)).select("_order")
    return df.join(F.broadcast(chosen), df[order] == chosen["_order"], "left_semi")


def stratified_shard(df: DataFrame, label: str, order: str, n: int, name: str = "shard") -> DataFrame:
    """df with the shard of each row: rows of each label take the shards in turn, by order (nulls first, of equal ones any first); a null label is one."""
    return label_positions(df, label, order, name).withColumn(name, F.pmod(name, F.lit(n)).cast("int"))


def label_positions(df: DataFrame, label: str, order: str, name: str) -> DataFrame:
    """df with a row's place, from 0, among the rows of its label (null is one) by order (nulls first). Ranges of (label, order) are
    ranked apart and each label's own rows in the ranges before are added, so a label that most rows have is no hot key."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("_gm_label", F.col(label).cast("string"))
    ranged = rows.repartitionByRange(parts, "_gm_label", order).sortWithinPartitions("_gm_label", order)
    placed = cut(ranged.withColumns({"_gm_part": F.spark_partition_id(), "_gm_row": F.monotonically_increasing_id()}), "labels")
    counts = placed.groupBy("_gm_label", "_gm_part").agg(F.count("*").alias("n"), F.min("_gm_row").alias("least"))  # few rows: a label's ranges are neighbours
    before = Window.partitionBy("_gm_label").orderBy("_gm_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("_gm_label").alias("_gm_l"), F.col("_gm_part").alias("_gm_p"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("least")).alias("_gm_start"))
    here = placed.join(starts, placed["_gm_label"].eqNullSafe(starts["_gm_l"]) & (placed["_gm_part"] == starts["_gm_p"]))
    return here.select(*(placed[c] for c in df.columns), (F.col("_gm_row") + F.col("_gm_start")).alias(name))


def stratified_cap(df: DataFrame, label: str, key: str, per_label: int) -> DataFrame:
    """The first per_label rows of each label, by a hash of the key. Tasks keep their own first ones before rows meet."""
    by = Window.partitionBy(label).orderBy(F.md5(F.col(key).cast("string")), key)  # a rank limit, which Spark applies below the shuffle too
    return df.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= per_label).drop("_n")


def balanced_cap(df: DataFrame, label: str, key: str, limit: int) -> DataFrame:
    """At most `limit` rows: each label (null is one, the first) has the same quota, and the first labels one more where it
    doesn't divide; all rows if they are that few."""
    if df.count() <= limit:
        return df
    labels = df.select(F.col(label).cast("string").alias("_gm_l")).distinct()
    each, more = divmod(limit, labels.count())
    favoured = labels.orderBy(F.col("_gm_l").asc_nulls_first()).limit(more).withColumn("_gm_more", F.lit(1))  # fewer than limit
    by = Window.partitionBy(label).orderBy(F.md5(F.col(key).cast("string")), key)
    ranked = df.withColumn("_gm_n", F.row_number().over(by)).where(F.col("_gm_n") <= each + 1)  # a rank limit, applied below the shuffle too
    quota = each + F.coalesce("_gm_more", F.lit(0))
    return ranked.join(favoured, F.col(label).cast("string").eqNullSafe(F.col("_gm_l")), "left").where(F.col("_gm_n") <= quota).select(*(ranked[c] for c in df.columns))


def hygiene(df: DataFrame, content: str, label: str) -> DataFrame:
    """Duplicate groups and rows, groups and rows with conflicting labels, empty texts."""
    groups = df.groupBy(content).agg(F.count("*").alias("n"), F.count_distinct(label).alias("labels"))
    total = lambda c, v=F.lit(1): F.coalesce(F.sum(F.when(c, v)), F.lit(0)).cast("long")
    n, conflict = F.col("n"), F.col("labels") > 1
    return groups.agg(total(n > 1).alias("duplicate_groups"), total(n > 1, n - 1).alias("duplicate_rows"), total(conflict).alias("conflict_groups"), total(conflict, n).alias("conflict_rows"), total(F.trim(content) == "", n).alias("empty_rows"))


def compare(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows whose key is unique on both sides, and how many of them changed in each column."""
    one = lambda df: df.join(df.groupBy(key).count().where("count = 1").select(key), key)
    a, b = one(before), one(after).select(key, *(F.col(c).alias(f"new_{c}") for c in columns))
    changed = [F.sum((~F.col(c).eqNullSafe(F.col(f"new_{c}"))).cast("long")).alias(f"changed_{c}") for c in columns]
    return a.join(b, key).agg(F.count("*").alias("matched"), *changed)


def multiset_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.exceptAll(new).withColumn("side", F.lit("removed")).unionByName(new.exceptAll(old).withColumn("side", F.lit("added")))


def vocabulary(df: DataFrame, text: str, n: int) -> DataFrame:
    tokens = df.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_']+)"))).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(n)


def naive_bayes(df: DataFrame, text: str, label: str) -> DataFrame:
    """label, token, n, total: the counts of a multinomial model; smoothing is applied when it is used."""
    tokens = df.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.explode(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_']+)"))).alias("token"))
    counts = tokens.groupBy("label", "token").agg(F.count("*").alias("n"))
    return counts.join(counts.groupBy("label").agg(F.sum("n").alias("total")), "label")


def bigram_counts(df: DataFrame, words: Column) -> DataFrame:
    """prev, next, n."""
    rows = df.select(words.alias("w"))
    pairs = F.explode(F.arrays_zip(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))).alias("a"), F.expr("slice(w, 2, greatest(size(w) - 1, 0))").alias("b")))
    return rows.select(pairs.alias("p")).groupBy(F.col("p.a").alias("prev"), F.col("p.b").alias("next")).agg(F.count("*").alias("n"))


def usage_summary(runs: DataFrame, provider: str, amount: str) -> DataFrame:
    return runs.groupBy(F.coalesce(provider, F.lit("unknown")).alias("provider")).agg(F.count("*").alias("runs"), F.round(F.sum(amount), 4).alias("amount"))


def lineage(edges: DataFrame, root, parent: str = "parent", child: str = "child", most: int | None = None) -> DataFrame:
    """node, depth of everything reachable from root (0): descendants have a positive depth, ancestors a negative one.

    Rounds over the edges, one work table each, of nodes that were not met before; so cycles end, and the number of levels
    is not limited. A node that is both takes the descendant's depth. `most` keeps so many nodes of each side, the first by
    depth and name.
    """
    kind = edges.schema[parent].dataType
    links = cut(edges.select(F.col(parent).cast(kind).alias("p"), F.col(child).cast(kind).alias("c")).where("p is not null and c is not null").distinct(), "lineage")
    start = edges.sparkSession.range(1).select(F.lit(root).cast(kind).alias("node"), F.lit(0).alias("depth"))

    def walk(a: str, b: str, step: int) -> DataFrame:
        met = front = start
        while True:
            found = links.join(front.select(F.col("node").alias(a), "depth"), a).select(F.col(b).alias("node"), (F.col("depth") + step).alias("depth")).distinct()
            front = cut(found.join(met, "node", "left_anti"), "lineage")
            if front.isEmpty():
                return met.where("depth <> 0")
            met = met.unionByName(front)

    down, up = walk("p", "c", 1), walk("c", "p", -1)
    sides = [x if most is None else x.orderBy(F.abs("depth"), "node").limit(most) for x in (down, up.join(down, "node", "left_anti"))]
    return start.unionByName(sides[0]).unionByName(sides[1])


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0

    def handle_data(self, data):
        if not self.skip and data.strip():
            self.out.append(data.strip())


def html_text(df: DataFrame, html: str = "html", name: str = "text") -> DataFrame:
    """df with the visible text of a page."""

    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        def one(page):
            parser = _Text()
            parser.feed(page or "")
            return " ".join(parser.out)

        return pages.map(one)

    return df.withColumn(name, extract(html))
