"""Training table: filled features, centred ranks, labelled rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstide.functions.basics import fill_zero
from crosstide.operators import cross_section, ranking


def prepare(
    df: DataFrame, features: Sequence[str], label: str, hot_rows: int = ranking.HOT_ROWS
) -> DataFrame:
    """Fill, rank features over all rows of a date, drop rows without a label,
    then rank the label among the rows left."""
    biggest = ranking.largest_group(df, ["datetime"])
    filled = df.withColumns({f: fill_zero(f) for f in features})
    ranked = cross_section.with_centred_ranks(
        filled, {f"_r_{f}": f for f in features}, hot_rows=hot_rows, biggest=biggest
    )
    labelled = ranked.where(F.col(label).isNotNull())
    done = cross_section.with_centred_ranks(labelled, {"_r_label": label}, hot_rows, biggest, dealt=True)
    return done.select(
        "datetime",
        "instrument",
        *[F.col(f"_r_{f}").alias(f) for f in features],
        F.col("_r_label").alias(label),
    )
