"""Area dimensions (M17): settlement list and district list.

Both are small lookup tables.  They are projected to the columns the join
needs and de-duplicated on their key before joining, so a repeated district
row cannot multiply observations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.functions import exprs as X
from souk.functions import names as N


def district_centroid(settlements: DataFrame, district: str,
                      district_col: str = "DISTRICT", name_col: str = "NAME0") -> DataFrame:
    """Mean longitude/latitude of one district's settlements, as a settlement row
    named after the district (A12)."""
    return (settlements.where(F.col(district_col) == district)
            .select(district_col, "Longitude", "Latitude")
            .groupBy(district_col)
            .agg(X.mean_skip_na("Longitude").alias("Longitude"),
                 X.mean_skip_na("Latitude").alias("Latitude"))
            .withColumn(name_col, F.lit(district)))


def prepare_settlements(settlements: DataFrame, centroid_district: str | None = None,
                        name_col: str = "NAME0") -> DataFrame:
    """Settlement list + optional district centroid row; the name column becomes
    ``settlement``, all names lower case (U3, P4, P5)."""
    df = settlements
    if centroid_district is not None:
        df = df.unionByName(district_centroid(settlements, centroid_district, name_col=name_col),
                            allowMissingColumns=True)
    df = df.withColumnRenamed(name_col, "settlement")
    return N.lower_names(df)


def prepare_districts(districts: DataFrame, name_col: str = "DName2019") -> DataFrame:
    """District list keyed by the lower-cased sentence-case district name."""
    return districts.withColumn("district", F.lower(X.sentence_case(F.col(name_col))))


def settlement_lookup(settlements: DataFrame) -> DataFrame:
    """settlement -> district, one row per settlement (the smallest district
    name if a list repeats a settlement)."""
    return settlements.groupBy("settlement").agg(F.min("district").alias("district"))


def district_lookup(districts: DataFrame) -> DataFrame:
    """district -> (F15Regions, DName2019), de-duplicated on the key."""
    return (districts.select("district", "F15Regions", "DName2019", "OBJECTID")
            .groupBy("district")
            .agg(F.min_by(F.struct("F15Regions", "DName2019"), "OBJECTID").alias("d"))
            .select("district", "d.F15Regions", "d.DName2019"))
