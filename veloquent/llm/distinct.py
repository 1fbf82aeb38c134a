"""Distinct counts of identifiers for any combination of groups, exact, from mergeable membership patterns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veloquent.functions.udf import let


def memberships(df: DataFrame, identifier: str, groups: dict[str, Column]) -> DataFrame:
    """(identifier, cells): the sorted set of the group combinations each identifier occurs in.

    Equal (identifier, combination) pairs collapse before the first shuffle, which goes by both, so an
    identifier with any share of the rows is spread; the second moves distinct pairs only. A set is as long
    as there are combinations, not rows. Null identifiers are none; a null group is a group of its own.
    """
    cell = F.struct(*[c.alias(n) for n, c in groups.items()])
    pairs = df.filter(F.col(identifier).isNotNull()).select(F.col(identifier).alias("identifier"), cell.alias("cell")).distinct()
    return pairs.groupBy("identifier").agg(F.sort_array(F.collect_list("cell")).alias("cells"))


def merge_memberships(*parts: DataFrame) -> DataFrame:
    """Partial memberships (of days, files, regions) as one; identifiers may occur in several parts."""
    all_parts = parts[0]
    for p in parts[1:]:
        all_parts = all_parts.unionByName(p)
    pairs = all_parts.select("identifier", F.explode("cells").alias("cell")).distinct()
    return pairs.groupBy("identifier").agg(F.sort_array(F.collect_list("cell")).alias("cells"))


def patterns(members: DataFrame) -> DataFrame:
    """(cells, n): how many identifiers have exactly this set. Totals over disjoint identifiers simply add."""
    return members.groupBy("cells").agg(F.count(F.lit(1)).alias("n"))


def merge_patterns(*parts: DataFrame) -> DataFrame:
    """Pattern totals of disjoint sets of identifiers (say, by hash of the identifier) as one."""
    x = parts[0]
    for p in parts[1:]:
        x = x.unionByName(p)
    return x.groupBy("cells").agg(F.sum("n").alias("n"))


def _each_once(xs: Column) -> Column:
    """The different elements of an array, in order: sorted, then each compared with the one before, however many."""
    return let(F.sort_array(xs), lambda ys: F.filter(ys, lambda y, i: (i == 0) | ~y.eqNullSafe(F.get(ys, i - 1))))


def by_sets(totals: DataFrame, sets: Sequence[tuple[str, Sequence[str]]], names: Sequence[str]) -> DataFrame:
    """Distinct identifiers per value of each grouping set: (kind, *names, n_distinct), as by GROUPING SETS.

    A pattern names each group of a set once, however many of its cells lie in it, so adding up the totals
    counts no identifier twice. Columns that are not in a row's set are null. The set without columns has a row
    in any case, as in SQL: 0 where nobody was seen.
    """
    cell_types = {f.name: f.dataType for f in totals.schema["cells"].dataType.elementType}

    def entries(kind: str, keep: Sequence[str]) -> Column:
        one = lambda c: F.struct(F.lit(kind).alias("kind"), *[(c[n] if n in keep else F.lit(None).cast(cell_types[n])).alias(n) for n in names])
        return _each_once(F.transform("cells", one))

    rows = totals.select("n", F.explode(F.concat(*[entries(k, keep) for k, keep in sets])).alias("g")).select("g.*", "n")
    if whole := [k for k, keep in sets if not keep]:
        nobody = totals.sparkSession.range(0, 1, 1, 1).select(F.explode(F.array(*[F.lit(k) for k in whole])).alias("kind"), *[F.lit(None).cast(cell_types[n]).alias(n) for n in names], F.lit(0).cast("bigint").alias("n"))
        rows = rows.unionByName(nobody)
    return rows.groupBy("kind", *names).agg(F.sum("n").alias("n_distinct"))


def coarser(totals: DataFrame, groups: Callable[[Column], Column], name: str) -> DataFrame:
    """Distinct identifiers per coarser group of cells (weeks of days, say): (name, n_distinct)."""
    rows = totals.select("n", F.explode(_each_once(F.transform("cells", groups))).alias(name))
    return rows.groupBy(name).agg(F.sum("n").alias("n_distinct"))


def count_where(totals: DataFrame, any_of: Sequence[Callable[[Column], Column]] = (), all_of: Sequence[Callable[[Column], Column]] = (), none_of: Sequence[Callable[[Column], Column]] = ()) -> DataFrame:
    """Identifiers seen in one of ``any_of``, in each of ``all_of`` and in none of ``none_of``: one row, n_distinct.

    Each is a predicate on a cell, so unions, intersections and differences of any groups come from the totals.
    """
    has = lambda p: F.exists("cells", lambda c: F.coalesce(p(c), F.lit(False)))  # noqa: E731 - a null group fails every test
    cond = F.lit(True)
    if any_of:
        either = F.lit(False)
        for p in any_of:
            either = either | has(p)
        cond = cond & either
    for p in all_of:
        cond = cond & has(p)
    for p in none_of:
        cond = cond & ~has(p)
    return totals.filter(cond).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_distinct"))
