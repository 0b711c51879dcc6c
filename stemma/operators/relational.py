"""Joins, aggregations and set operators beyond single DataFrame calls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shared_pairs(rows: DataFrame, group: str, place: str, name: str) -> DataFrame:
    """group, a, b, shared, names: what two places hold both, for places a < b of a group.

    Rows are made distinct first, so that the self-join meets each (group, name, place) once; its rows are bounded by the
    square of the number of places, not of the rows.
    """
    distinct = rows.select(F.col(group).alias("group"), F.col(place).alias("a"), F.col(name).alias("name")).where("name is not null").distinct()
    pairs = distinct.join(distinct.withColumnRenamed("a", "b"), ["group", "name"]).where("a < b")
    return pairs.groupBy("group", "a", "b").agg(F.count("*").alias("shared"), joined_set("name", "; ").alias("names"))


def joined_set(value: Column | str, separator: str) -> Column:
    """Distinct values, sorted and joined."""
    return F.array_join(F.array_sort(F.collect_set(value)), separator)


def conflicting(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows of those groups that hold more than one value; one aggregation and a semi-join in place of a three-way self-join."""
    several = rows.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high")).where("_low <> _high")
    return rows.join(several.select(*keys), list(keys), "left_semi")


def measures_beside(facts: DataFrame, measures: DataFrame, keys: Sequence[str], label: str, value: str, names: dict[str, str]) -> DataFrame:
    """facts with a column for each name in names (by label), null where there is none: one pivot and one outer join.

    Measures that occur more than once for a key make a row each, as separate outer joins would.
    """
    wanted = measures.where(F.col(label).isin(*names.values()))
    lists = [F.collect_list(F.when(F.col(label) == text, F.col(value))).alias(f"_{column}") for column, text in names.items()]
    wide = wanted.groupBy(*keys).agg(*lists)
    out = facts.join(wide, list(keys), "left")
    for column in names:
        out = out.withColumn(column, F.explode_outer(f"_{column}")).drop(f"_{column}")
    return out


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key; Spark limits each partition to it before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def top_per_group(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def look_up_first(rows: DataFrame, best: DataFrame, key: str, order: Sequence[Column | str], columns: Sequence[str]) -> DataFrame:
    """columns of the first row of best with the same key, else those that rows has itself."""
    first = keep_first(best, [key], order).select(key, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_hit"))
    out = rows.join(first, key, "left")
    for c in columns:
        out = out.withColumn(c, F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)))
    return out.drop("_hit", *(f"_{c}" for c in columns))


def second_pass(rows: DataFrame, answers: DataFrame, keys: tuple[str, str], classify) -> DataFrame:
    """answer, match and pass: the answer to the hinted key where the first one is none or higherrank and the second is not."""
    weak = ("none", "higherrank")
    a = answers.select(F.col("cache_key").alias(keys[0]), F.col("answer").alias("_first"))
    b = answers.select(F.col("cache_key").alias(keys[1]), F.col("answer").alias("_second"))
    out = rows.join(a, keys[0], "left").withColumn("_match", classify(F.col("_first")))
    out = out.join(b, keys[1], "left").withColumn("_again", classify(F.col("_second")))
    better = F.col("_match").isin(*weak) & ~F.col("_again").isin(*weak) & F.col("_second").isNotNull()
    return out.select(
        *rows.columns,
        F.when(better, F.col("_second")).otherwise(F.col("_first")).alias("answer"),
        F.when(better, F.col("_again")).otherwise(F.col("_match")).alias("match"),
        F.when(better, 2).otherwise(1).alias("pass"),
    )


def nearest_column(position: Column, columns: Column, tolerance: float = 4.5) -> Column:
    """Name of the column (array of structs x, name) nearest to a position, the first of those that tie; null beyond the tolerance."""
    ranked = F.transform(columns, lambda c, i: F.struct(F.abs(c["x"] - position).alias("d"), i.alias("i"), c["name"].alias("name")))
    best = F.array_min(ranked)
    return F.when(best["d"] <= tolerance, best["name"])


def cells_by_column(marks: Column, columns: Column, tolerance: float = 4.5) -> Column:
    """Array of (name, mark): by order if there is a mark (struct x, mark) for each column, by position else."""
    by_order = F.zip_with(F.array_sort(columns), F.array_sort(marks), lambda c, m: F.struct(c["name"].alias("name"), m["mark"].alias("mark")))
    by_place = F.transform(marks, lambda m: F.struct(nearest_column(m["x"], columns, tolerance).alias("name"), m["mark"].alias("mark")))
    return F.when(F.size(marks) == F.size(columns), by_order).otherwise(F.filter(by_place, lambda x: x["name"].isNotNull()))


def repaired_by_lexicon(damaged: DataFrame, lexicon: DataFrame, key: str, pattern: str, word: str) -> DataFrame:
    """damaged with `repaired`: the only word of its key's lexicon that fits the pattern, else null."""
    hits = damaged.join(lexicon.select(key, F.col(word).alias("_word")).distinct(), key).where(F.col("_word").isNotNull() & F.rlike(F.lower("_word"), F.col(pattern)))
    one = hits.groupBy(key, pattern).agg(F.min("_word").alias("_low"), F.max("_word").alias("_high")).where("_low = _high")
    return damaged.join(one.select(key, pattern, F.col("_low").alias("repaired")), [key, pattern], "left")


def densified(rows: DataFrame, keys: Sequence[str], sizes: DataFrame, cells: DataFrame, column: str, value: str, missing) -> DataFrame:
    """A row for each of the 1..n columns of each key (n in sizes), with the cell's value or `missing`."""
    every = rows.join(sizes, [c for c in sizes.columns if c != "n"]).where("n > 0").withColumn(column, F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n")
    return every.join(cells, [*keys, column], "left").withColumn(value, F.coalesce(value, F.lit(missing)))


def with_aliases(rows: DataFrame, column: str, aliases: dict[str, str]) -> DataFrame:
    """rows and, for each alias, those of the key that it stands for."""
    out = rows
    for alias, key in aliases.items():
        out = out.unionByName(rows.where(F.col(column) == key).withColumn(column, F.lit(alias)))
    return out


def sorensen(shared: Column, a: Column, b: Column) -> Column:
    return F.bround(2 * shared / (a + b), 3)


def scores(rows: DataFrame, keys: Sequence[str], predicted: str, gold: str) -> DataFrame:
    """n_pred, n_gold, tp and P, R, F1 of two flags of distinct items, 0 where nothing is there to divide by."""
    flag = lambda c: F.count_if(F.col(c))
    out = rows.groupBy(*keys).agg(flag(predicted).alias("n_pred"), flag(gold).alias("n_gold"), F.count_if(F.col(predicted) & F.col(gold)).alias("tp"))
    share = lambda n, d: F.when(d > 0, n / d).otherwise(F.lit(0.0))
    p, r = share(F.col("tp"), F.col("n_pred")), share(F.col("tp"), F.col("n_gold"))
    return out.select(*out.columns, F.bround(p, 3).alias("P"), F.bround(r, 3).alias("R"), F.bround(share(2 * p * r, p + r), 3).alias("F1"))


def key_counts(rows: DataFrame, keys: Sequence[str], entries: str) -> DataFrame:
    """keys, key, n: how often each key of a map column occurs."""
    return rows.select(*keys, F.explode(entries).alias("key", "value")).groupBy(*keys, "key").agg(F.count("*").alias("n"))


def last_values(rows: DataFrame, keys: Sequence[str], name: str, value: str, order: str) -> DataFrame:
    """keys, entries: a map of each name's value in the last row that has the name."""
    last = rows.groupBy(*keys, name).agg(F.max_by(value, order).alias("_value"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "_value")))).alias("entries"))


def first_with_prefix(entries: Column, *prefixes: str) -> Column:
    """The first value of a map whose key begins with one of the prefixes."""
    fits = lambda e: F.expr("false") if not prefixes else _any(e["key"].startswith(p) for p in prefixes)
    return F.get(F.filter(F.map_entries(entries), fits), F.lit(0))["value"]


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def matched_positions(a: Column, b: Column) -> Column:
    """At how many positions two arrays agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
