"""Looking at the next row of a sequence that may be arbitrarily long."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def next_value(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    value: str,
    into: str,
    chunk: str,
) -> DataFrame:
    """``value`` of the following row of the same key, NULL on the last one.

    ``chunk`` is a column that never decreases along the order, is never missing, and holds
    a bounded number of rows (a file split, a range of ordinals). Windows run per key and
    chunk, so a single key with a third of all rows still spreads over many tasks. The last
    row of a chunk takes the first value of the key's next chunk. Rows are dealt out once:
    the same exchange serves the windows, the first rows of the chunks and the join.
    """
    place = {}
    for n, key in enumerate(keys):
        # never missing, so that windows and join agree on one hash partitioning
        place[f"_k{n}"] = F.coalesce(F.col(key).cast("string"), F.lit(""))
        place[f"_m{n}"] = F.col(key).isNull()
    spots = [*place, "_chunk"]
    rows = df.withColumns({**place, "_chunk": F.col(chunk)}).repartition(*spots)
    within = Window.partitionBy(*spots).orderBy(*order_by)
    seen = rows.withColumn("_held", F.lead(F.struct(F.col(value).alias("v"))).over(within))

    # whole rows, so that both branches read the same columns and share the exchange
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    order = F.col(order_by[0]) if len(order_by) == 1 else F.struct(*order_by)
    heads = rows.groupBy(*spots).agg(F.min_by(whole, order).alias("_first"))
    along = Window.partitionBy(*place).orderBy("_chunk")
    following = heads.select(
        *spots, F.lead(F.struct(F.col("_first").getField(value).alias("v"))).over(along).alias("_next")
    )
    joined = seen.join(following, spots, "left")
    found = F.coalesce("_held", "_next").getField("v")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], found.alias(into))
