"""Running values of ordered groups that may be large: a crowded group is cut into pieces of time, and only the pieces' summaries meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A group is crowded if it has more rows than this, and more than one in MOST_CROWDED of all rows; so there are fewer than that many.
CROWD, MOST_CROWDED = 100_000, 1 << 16


def with_previous(rows: DataFrame, key: str, order: tuple[str, ...], piece: str, carried: tuple[str, ...], crowd: int = CROWD) -> DataFrame:
    """rows with `_number`, a row's place in its group from 1; `_first`, the group's least value of order[0]; and `_before`, a struct of
    the carried columns in the row before (null for the first).

    Groups are the rows of one key, ordered by `order`, nulls first; rows that agree in all of it stand in any order. A group of more
    than `crowd` rows is cut into pieces, each what date_trunc(piece, order[0]) joins: a window runs inside pieces, another one over
    one row per piece. So a task holds a piece or a group's pieces, not a crowded group. Nulls of the key are a group, nulls of order[0]
    its first piece. The keys of crowded groups are a broadcast of fewer than MOST_CROWDED."""
    sizes = rows.groupBy(F.col(key).alias("_crowded")).agg(F.count("*").alias("_n"))
    all_rows = F.broadcast(sizes.agg(F.sum("_n").alias("_all")))  # one row
    crowded = sizes.join(all_rows).where((F.col("_n") > crowd) & (F.col("_n") * MOST_CROWDED > F.col("_all"))).select("_crowded", F.lit(True).alias("_cut"))
    own = rows.join(F.broadcast(crowded), _same(key, "_crowded"), "left").drop("_crowded")
    own = own.withColumn("_piece", F.when(F.col("_cut"), F.date_trunc(piece, order[0])))
    inside, kept = Window.partitionBy(key, "_piece").orderBy(*order), F.struct(*carried)
    pieces = Window.partitionBy("_key").orderBy("_of")
    ends = own.where("_cut").groupBy(F.col(key).alias("_key"), F.col("_piece").alias("_of")).agg(
        F.count("*").alias("_rows"),
        F.max_by(kept, F.struct(*order)).alias("_last"),
        F.min(F.struct(order[0])).alias("_least"),
    )
    ends = ends.select(
        "_key",
        "_of",
        F.lit(True).alias("_with"),
        (F.sum("_rows").over(pieces) - F.col("_rows")).alias("_so_far"),
        F.lag("_last").over(pieces).alias("_last_before"),
        F.first("_least").over(pieces)[order[0]].alias("_start"),
    )
    numbered = own.withColumns({"_at": F.row_number().over(inside), "_inside": F.lag(kept).over(inside), "_own": F.first(order[0]).over(inside)})
    both = numbered.join(ends, F.col("_cut").eqNullSafe(F.col("_with")) & _same(key, "_key") & _same("_piece", "_of"), "left")
    both = both.withColumns({
        "_number": F.coalesce("_so_far", F.lit(0)) + F.col("_at"),
        "_first": F.when(F.col("_with"), F.col("_start")).otherwise(F.col("_own")),
        "_before": F.when(F.col("_at") == 1, F.col("_last_before")).otherwise(F.col("_inside")),
    })
    return both.select(*rows.columns, "_number", "_first", "_before")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))
