"""Entity resolution of employers against a licence registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions.text import company_key, unaccent

#: Fixed by the registry: the form of a licence number.
LICENCE = r"^\d{4}-\d{4}-\d{2}$"


def registry_index(registry: DataFrame) -> DataFrame:
    """(name_key, licence, municipality, region) of active, well-formed licences; of each pair the first row in `ord`. registry: licence, status, name, other_name, municipality, region, ord."""
    rows = registry.where((F.lower("status") == "active") & F.trim("licence").rlike(LICENCE)).select(F.trim("licence").alias("licence"), "municipality", "region", "ord", F.posexplode(F.array("name", "other_name")).alias("which", "name"))
    keyed = rows.withColumn("name_key", company_key(F.col("name"))).where(F.length("name_key") >= 3)
    best = F.min_by(F.struct(F.lower(F.coalesce("municipality", F.lit(""))).alias("municipality"), F.lower(F.coalesce("region", F.lit(""))).alias("region")), F.struct("ord", "which"))
    return keyed.groupBy("name_key", "licence").agg(best.alias("x")).select("name_key", "licence", "x.*")


def resolve_licences(employers: DataFrame, index: DataFrame, fold_registry_region: bool = True) -> DataFrame:
    """(id, licence, outcome) of employers without a licence: assigned, disambiguated, ambiguous or no match.

    Several licences of a name are told apart by a region that contains the other's name, if that leaves one."""
    missing = employers.where(F.trim(F.coalesce("rbq", F.lit(""))) == "").select("id", company_key(F.col("name")).alias("name_key"), unaccent(F.lower(F.coalesce("region", F.lit("")))).alias("own_region"))
    theirs = unaccent(F.col("region")) if fold_registry_region else F.col("region")
    joined = missing.join(index.select("name_key", "licence", theirs.alias("their_region")), "name_key", "left")
    near = (F.col("own_region") != "") & (F.col("their_region") != "") & (F.contains("their_region", "own_region") | F.contains("own_region", "their_region"))
    found = joined.groupBy("id").agg(F.count("licence").alias("hits"), F.max("licence").alias("only"), F.count_if(near).alias("near"), F.max(F.when(near, F.col("licence"))).alias("near_one"))
    outcome = F.when(F.col("hits") == 0, "no match").when(F.col("hits") == 1, "assigned").when(F.col("near") == 1, "disambiguated").otherwise("ambiguous")
    return found.select("id", F.when(F.col("hits") == 1, F.col("only")).when(F.col("near") == 1, F.col("near_one")).alias("licence"), outcome.alias("outcome"))


def outcome_counts(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("outcome").agg(F.count("*").alias("n"))


def unique_match(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Pairs of rows whose key has exactly one partner on the right."""
    counted = right.withColumn("partners", F.count("*").over(Window.partitionBy(key))).where("partners = 1").drop("partners")
    return left.join(counted, key)
