"""J2: keep only the finest regional level per (date, country)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def leaf_level_extract(covid: DataFrame) -> DataFrame:
    """Per (date, country_code) the finest level present - 2 if any
    sub-region-2 code exists, 1 if any sub-region-1 code, else 0 - and the rows
    at that level, renamed, with ``active = confirmed - recovered - deaths``.

    The per-(date, country) levels come from a partial aggregation and are
    joined back on (date, country, level); rows with a NULL date or country
    never match, as with the equality join of the original.
    """
    levels = covid.groupBy(F.col("date").alias("leaf_date"), F.col("country_code").alias("leaf_country")).agg(
        F.when(F.min("subregion2_code").isNotNull(), F.lit(2))
        .when(F.min("subregion1_code").isNotNull(), F.lit(1))
        .otherwise(F.lit(0))
        .alias("leaf_aggregation_level")
    )
    joined = covid.join(
        levels,
        (covid["date"] == levels["leaf_date"])
        & (covid["country_code"] == levels["leaf_country"])
        & (covid["aggregation_level"] == levels["leaf_aggregation_level"]),
    )
    return joined.select(
        covid["subregion1_name"].alias("province_state"),
        covid["country_name"].alias("country_region"),
        covid["date"],
        covid["latitude"],
        covid["longitude"],
        covid["subregion1_name"].alias("sub_region1_name"),
        covid["location_geometry"].alias("location_geom"),
        covid["cumulative_confirmed"].alias("confirmed"),
        covid["cumulative_deceased"].alias("deaths"),
        covid["cumulative_recovered"].alias("recovered"),
        (covid["cumulative_confirmed"] - covid["cumulative_recovered"] - covid["cumulative_deceased"]).alias("active"),
        covid["subregion2_code"].alias("fips"),
        covid["subregion2_name"].alias("admin_2"),
        covid["location_key"].alias("combined_key"),
    )
