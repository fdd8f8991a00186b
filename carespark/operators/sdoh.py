"""Social-determinant seed tables from zip codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..refdata import sdoh as ref


def zip_to_fips(zips: DataFrame, state: str = "GA") -> DataFrame:
    """Distinct zip codes with their county, a default county where unknown."""
    known = zips.sparkSession.createDataFrame(
        [(z, fips, name) for (fips, name), codes in ref.COUNTIES.items() for z in codes],
        "zip string, county_fips string, county_name string",
    )
    fips, name = ref.DEFAULT_COUNTY
    return (
        zips.select("zip").distinct()
        .join(F.broadcast(known), "zip", "left")
        .fillna({"county_fips": fips, "county_name": name})
        .select(
            F.concat(F.lit(f"{state}-"), "zip").alias("id"), "zip", F.lit(state).alias("state"),
            "county_fips", "county_name", F.lit(ref.SOURCE).alias("source_table"),
        )
    )


def sdoh_dimensions(spark) -> dict[str, DataFrame]:
    """Category, unit and county rows; fixed small tables with stable keys."""
    counties = sorted(fips for fips, _ in ref.COUNTIES)
    return {
        "sdoh_category": spark.createDataFrame(
            [(i, n, d, i * 10, n, d) for i, n, d in ref.CATEGORIES],
            "category_id int, category_name string, category_description string, subcategory_id int, "
            "subcategory_name string, subcategory_description string",
        ),
        "sdoh_unitofmeasure": spark.createDataFrame(
            ref.UNITS, "unit_of_measure_id int, name string, abbreviation string, description string"
        ),
        "sdoh_fips": spark.createDataFrame([(f, "county") for f in counties], "fips_code string, location_type string"),
    }


def character_sum(text: Column) -> Column:
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(0), lambda acc, c: acc + F.ascii(c))


def social_determinants(places: DataFrame) -> DataFrame:
    """Six measures per zip from a character-sum seed; keyed by zip and name."""
    seed = F.col("seed")
    rows = F.array(
        *[
            F.struct(
                F.lit(category).alias("category_id"),
                F.lit(unit).alias("unit_of_measure_id"),
                F.lit(name).alias("name"),
                F.lit(text).alias("description"),
                (F.lit(base) + (seed % modulus) * factor).alias("value"),
            )
            for category, unit, text, name, base, modulus, factor in ref.MEASURES
        ]
    )
    return (
        places.withColumn("seed", character_sum(F.col("zip")))
        .select("zip", "county_fips", F.inline(rows))
        .select(
            F.xxhash64("zip", "name").alias("social_determinant_id"),
            "category_id",
            "unit_of_measure_id",
            "name",
            "description",
            F.col("value").cast("string").alias("value"),
            F.col("value").cast("double").alias("value_as_number"),
            F.lit("zip").alias("location_type"),
            F.col("zip").alias("location_value"),
            F.to_json(F.struct("zip", F.col("county_fips").alias("countyFips"))).alias("location_json"),
            F.concat_ws(":", "zip", "name").alias("harmonization_key"),
        )
    )
