"""Company and skill dimensions: loading, checks, lookup tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions.text import match_key, strip
from tidemark.schemas import COMPANY, SKILL


def load_companies(spark: SparkSession, path: str) -> DataFrame:
    """Company boards from JSON lines, names and tokens trimmed."""
    rows = spark.read.schema(COMPANY).option("mode", "FAILFAST").json(path)
    return rows.select(*[strip(F.col(c)).alias(c) for c in ("name", "hq", "board", "token")])


def load_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """Reviewed skills from JSON lines: id, category, aliases."""
    rows = spark.read.schema(SKILL).option("mode", "FAILFAST").json(path)
    return rows.withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def _counted(rows: DataFrame, rule: str, key) -> DataFrame:
    return rows.groupBy(key.alias("key")).agg(F.count("*").alias("n")).select(
        F.lit(rule).alias("rule"), "key", "n"
    )


def company_violations(companies: DataFrame) -> DataFrame:
    """(rule, key, n) for every broken rule; empty means the dimension is sound."""
    empty = F.lit(False)
    for column in ("name", "hq", "token"):
        empty = empty | F.coalesce(strip(F.col(column)) == "", F.lit(True))
    board_key = F.concat_ws("/", "board", "token")
    return (
        _counted(companies, "duplicate board", board_key).where("n > 1")
        .unionByName(_counted(companies, "duplicate name", F.lower("name")).where("n > 1"))
        .unionByName(_counted(companies.where(empty), "empty field", board_key))
        .unionByName(
            _counted(
                companies.where(~F.coalesce(F.col("board").isin(*fv.BOARDS), F.lit(False))),
                "unknown board",
                board_key,
            )
        )
    )


def lookup_terms(taxonomy: DataFrame) -> DataFrame:
    """(match_key, skill_id), one row per distinct spelling of a skill."""
    spelling = F.explode(F.concat(F.array("id"), F.coalesce("aliases", F.array().cast("array<string>"))))
    return (
        taxonomy.select(F.col("id").alias("skill_id"), spelling.alias("spelling"))
        .select(match_key(F.col("spelling")).alias("match_key"), "skill_id")
        .distinct()
    )


def taxonomy_violations(taxonomy: DataFrame, categories=None) -> DataFrame:
    """(rule, key, n) for every broken rule of the skill taxonomy."""
    owners = lookup_terms(taxonomy).groupBy(F.col("match_key").alias("key")).agg(
        F.count("*").alias("n")
    )
    found = (
        _counted(taxonomy, "duplicate id", F.col("id")).where("n > 1")
        .unionByName(
            _counted(
                taxonomy.where(F.col("id") != strip(F.lower("id"))), "id not lower case", F.col("id")
            )
        )
        .unionByName(
            owners.where("n > 1").select(F.lit("spelling owned twice").alias("rule"), "key", "n")
        )
    )
    if categories:
        found = found.unionByName(
            _counted(taxonomy.where(~F.col("category").isin(*categories)), "unknown category", F.col("id"))
        )
    return found
