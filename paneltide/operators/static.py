"""Static (time-invariant) entity features, X3 = F6, F8-F14, W11, P4.

Table-level statistics (75th percentiles, city sizes, row total) are
aggregates joined back, not unpartitioned windows:

* percentiles and the row total come from one 1-row aggregate read as a
  scalar sub-query (computed once, shipped to every task as a literal);
* city sizes come from ``groupBy(city).count()`` -- partial aggregation
  absorbs a city holding a third of all rows -- joined back on city (AQE
  broadcasts the count table at run time when it is small, and splits a
  skewed city partition otherwise).  A ``count(*) OVER (PARTITION BY
  city)`` window would instead send that whole city to one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from .ranks import quantile_values

# Raw text / high-cardinality columns dropped from the output.
DROP_COLUMNS = [
    "restaurant_name", "address", "locality", "locality_verbose",
    "rating_color", "rating_text", "currency", "cuisines",
]
YES_NO_COLUMNS = ["has_table_booking", "has_online_delivery", "is_delivering_now"]


def static_features(master: DataFrame, method: str = "exact") -> DataFrame:
    """X3.  ``method``: the two 75th percentiles are ``exact`` or ``approx``."""
    cols = master.columns
    qcols = [c for c in ("average_cost_for_two", "votes") if c in cols]
    found = quantile_values(master, qcols, [0.75], method)

    def q75(c: str):
        return F.lit(found[c][0] if c in qcols else None).cast("double")

    stats = {"cost_q75": q75("average_cost_for_two"), "votes_q75": q75("votes"), "n_rows": master.select(F.count(F.lit(1))).scalar()}

    out = []
    # 1. boolean flags (switch_to_order_menu is dropped)
    for c in cols:
        if c == "switch_to_order_menu":
            continue
        if c in YES_NO_COLUMNS:
            out.append(S.yes_no_flag(c).alias(c))
        elif c not in DROP_COLUMNS:
            out.append(F.col(c))
    # 2. cuisine features
    flags = S.cuisine_flags("cuisines")
    out.append(S.cuisine_count("cuisines").alias("cuisine_count"))
    out.extend(flags)
    out.append(S.entropy_of_flags(flags).alias("cuisine_diversity"))
    # 3. cost features
    if "average_cost_for_two" in cols:
        out += [
            S.log1p_clipped("average_cost_for_two").alias("log_cost"),
            S.guarded_ratio("average_cost_for_two", "price_range").alias("cost_per_price_range"),
            S.above("average_cost_for_two", stats["cost_q75"]).alias("is_high_cost"),
        ]
    # 4. rating features
    if "aggregate_rating" in cols:
        tier = S.rating_tier("aggregate_rating")
        out += [
            tier.alias("rating_tier"),
            F.coalesce(F.col("aggregate_rating") == 0, F.lit(False)).cast("int").alias("is_unrated"),
        ]
        if "votes" in cols:
            out.append((F.col("aggregate_rating") * S.log1p_clipped("votes")).alias("rating_x_votes"))
    # 5. popularity features
    if "votes" in cols:
        out += [
            S.log1p_clipped("votes").alias("log_votes"),
            S.guarded_ratio("votes", S.cuisine_count("cuisines")).alias("votes_per_cuisine"),
            S.above("votes", stats["votes_q75"]).alias("is_popular"),
        ]
    shaped = master.select(*out)

    # 6. geographic features
    if "city" in cols:
        counts = (master.where(F.col("city").isNotNull()).groupBy("city")
                  .agg(F.count(F.lit(1)).alias("city_restaurant_count")))
        shaped = shaped.join(counts, "city", "left")
        extra = [
            F.col("city_restaurant_count"),
            (F.col("city_restaurant_count") / stats["n_rows"]).alias("city_freq"),
        ]
        if "country_code" in cols:
            extra.append(F.coalesce(F.col("country_code") == 1, F.lit(False)).cast("int").alias("is_india"))
        # keep the master's column order (the join moved city first)
        base = [c for c in shaped.columns if c not in ("city", "city_restaurant_count")]
        shaped = shaped.select(*_restore_order(base, cols), *extra)
    # 7. encoded tier
    if "aggregate_rating" in cols:
        shaped = shaped.withColumn("rating_tier_encoded", S.rating_tier_code(F.col("rating_tier")))
    return shaped


def _restore_order(base: list[str], master_cols: list[str]) -> list[str]:
    """Put ``city`` back at its place in the master column order."""
    out = []
    for c in master_cols:
        if c == "city":
            out.append("city")
            break
        if c in base:
            out.append(c)
    rest = [c for c in base if c not in out]
    return out + rest
