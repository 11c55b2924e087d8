"""The difference of two tables, by key columns or by row number."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions import text_form
from stratalens.operators.profile import any_of
from stratalens.operators.rows import ROW
from stratalens.operators.viewspec import quoted

MAX_EXAMPLES = 500


@dataclass(frozen=True)
class Compared:
    """Two tables joined: k0.. and r0.. the keys, l_ and r_ the compared columns as texts, in_left and in_right; sizes: one row of their numbers of rows."""

    joined: DataFrame
    sizes: DataFrame
    keys: int
    columns: list[str]
    only_left: list[str]
    only_right: list[str]

    def _changed(self) -> Column:
        return any_of([~quoted(f"l_{c}").eqNullSafe(quoted(f"r_{c}")) for c in self.columns])

    def summary(self) -> DataFrame:
        """One row: left_rows, right_rows, only_left, only_right, changed, identical."""
        count = lambda c: F.count(F.when(c, F.lit(1)))
        both = F.col("in_left") & F.col("in_right")
        return self.joined.agg(
            count(~F.col("in_right")).alias("only_left"), count(~F.col("in_left")).alias("only_right"),
            count(both & self._changed()).alias("changed"), count(both & ~self._changed()).alias("identical")).crossJoin(F.broadcast(self.sizes)).select("left_rows", "right_rows", "only_left", "only_right", "changed", "identical")

    def by_column(self) -> DataFrame:
        """(column, changed): how many rows of both tables differ in each column; one aggregation."""
        both = F.col("in_left") & F.col("in_right")
        one = self.joined.agg(*(F.count(F.when(both & ~quoted(f"l_{c}").eqNullSafe(quoted(f"r_{c}")), F.lit(1))).alias(f"c{i}") for i, c in enumerate(self.columns)))
        entries = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("changed")) for i, c in enumerate(self.columns)))
        return one.select(F.explode(entries).alias("x")).select("x.*")

    def examples(self, limit: int = 100) -> DataFrame:
        """(kind, key, left, right, changed_columns) of the first rows that differ: changed ones, then those of the left alone, then of the right; by key."""
        kind = F.when(~F.col("in_right"), "only-left").when(~F.col("in_left"), "only-right").otherwise("changed")
        key = F.concat_ws(" | ", *(F.coalesce(F.col(f"k{i}").cast("string"), F.col(f"r{i}").cast("string"), F.lit("∅")) for i in range(self.keys)))
        side = lambda s: F.create_map(*(x for c in self.columns for x in (F.lit(c), quoted(f"{s}_{c}"))))
        changed = F.filter(F.array(*(F.when(~quoted(f"l_{c}").eqNullSafe(quoted(f"r_{c}")), F.lit(c)) for c in self.columns)), lambda x: x.isNotNull())
        out = self.joined.where(~F.col("in_left") | ~F.col("in_right") | self._changed())
        out = out.select(kind.alias("kind"), key.alias("key"), F.when(F.col("in_left"), side("l")).alias("left"), F.when(F.col("in_right"), side("r")).alias("right"), changed.alias("changed_columns"))
        return out.orderBy("kind", "key").limit(max(1, min(int(limit), MAX_EXAMPLES)))


def compare(left: DataFrame, right: DataFrame, keys: list[str] | None = None, columns: list[str] | None = None) -> Compared:
    """Both tables' rows by equal keys, as texts and nulls equal to nulls, or where no key is shared by row number; a full outer join that shuffles by key. Whether a row is on a side is told by a flag, so that a null key is a key like others; repeated keys meet each other many to many. No shared column is an error."""
    names = lambda d: [c for c in d.columns if c != ROW]
    a, b = names(left), names(right)
    shared = [c for c in a if c in b]
    wanted = [c for c in (columns or shared) if c in shared]
    if not wanted:
        raise ValueError("the two tables share no column that can be compared")
    by = [k for k in (keys or []) if k in shared]

    def side(d: DataFrame, tag: str, key: str) -> DataFrame:
        cells = [text_form(quoted(c), d.schema[c].dataType).alias(f"{tag}_{c}") for c in wanted]
        ks = [text_form(quoted(k), d.schema[k].dataType).alias(f"{key}{i}") for i, k in enumerate(by)] or [F.col(ROW).alias(f"{key}0")]
        return d.select(*ks, *cells, F.lit(True).alias(f"__{tag}"))

    n = max(1, len(by))
    x, y = side(left, "l", "k"), side(right, "r", "r")
    on = F.col("k0").eqNullSafe(F.col("r0")) if by else F.col("k0") == F.col("r0")
    for i in range(1, n):
        on = on & F.col(f"k{i}").eqNullSafe(F.col(f"r{i}"))
    joined = x.join(y, on, "full").withColumns({"in_left": F.col("__l").isNotNull(), "in_right": F.col("__r").isNotNull()}).drop("__l", "__r")
    sizes = left.agg(F.count(F.lit(1)).alias("left_rows")).crossJoin(right.agg(F.count(F.lit(1)).alias("right_rows")))
    return Compared(joined, sizes, n, wanted, [c for c in a if c not in b], [c for c in b if c not in a])


def schema_diff(left: DataFrame, right: DataFrame) -> dict[str, list[str]]:
    a, b = ([c for c in d.columns if c != ROW] for d in (left, right))
    return {"shared": [c for c in a if c in b], "only_left": [c for c in a if c not in b], "only_right": [c for c in b if c not in a]}
