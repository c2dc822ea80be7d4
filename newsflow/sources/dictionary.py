"""The entity dictionary and its surface policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.functions.text import or_empty, strip
from newsflow.operators.entities import add_block_key

POLICY_VERSION = 2
MIN_SURFACE = 2
DEFAULT_GAP = 12

ENTITY_SCHEMA = "en string, aliases_en array<string>, weight double"
RULE = "struct<before:array<string>,after:array<string>,max_gap_chars:bigint>"
POLICY_SCHEMA = f"version int, entities map<string, struct<role:string, contextual_surfaces:map<string,{RULE}>>>"


class DictionaryError(ValueError):
    """The dictionary or its policy breaks a rule; nothing is loaded."""


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(position, en, aliases_en, weight) of a dictionary file."""
    whole = spark.read.schema(f"entities array<struct<{ENTITY_SCHEMA.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')}>>")
    return whole.option("multiLine", True).json(path).select(F.posexplode("entities").alias("position", "e")).select(
        "position", "e.*"
    )


def read_policy(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POLICY_SCHEMA).option("multiLine", True).json(path)


def _violations(entities: DataFrame, policy: DataFrame) -> DataFrame:
    """(problem, subject) rows; an empty table means the input is sound."""

    def rows(df: DataFrame, problem: str, subject) -> DataFrame:
        return df.select(F.lit(problem).alias("problem"), subject.cast("string").alias("subject"))

    blank = lambda c: strip(or_empty(c)) == ""
    cfg = policy.select(F.explode("entities").alias("canonical", "c"))
    rules = cfg.select("canonical", F.explode("c.contextual_surfaces").alias("surface", "r"))
    surfaces = entities.select(
        F.col("en").alias("canonical"),
        F.explode(F.concat(F.array("en"), F.coalesce("aliases_en", F.array().cast("array<string>")))).alias("s"),
    ).select("canonical", F.lower("s").alias("surface")).distinct()
    size = F.size(F.coalesce("r.before", F.array())) + F.size(F.coalesce("r.after", F.array()))
    words = F.concat(F.coalesce("r.before", F.array().cast("array<string>")), F.coalesce("r.after", F.array().cast("array<string>")))
    usable = surfaces.where(F.length("surface") >= MIN_SURFACE).join(
        rules.select("canonical", F.lower("surface").alias("surface")), ["canonical", "surface"], "left_anti"
    ).select("canonical").unionByName(rules.select("canonical"))
    parts = [
        rows(policy.where(~F.col("version").eqNullSafe(POLICY_VERSION)), "unsupported policy version", F.col("version")),
        rows(policy.where(F.col("entities").isNull()), "policy entities missing", F.lit(None)),
        rows(entities.where(blank(F.col("en"))), "entity without a name", F.col("position")),
        rows(entities.where(F.col("aliases_en").isNull() | F.exists("aliases_en", blank)), "bad aliases", F.col("en")),
        rows(entities.where(F.col("weight").isNull() | F.isnan("weight")), "no finite weight", F.col("en")),
        rows(cfg.where(F.col("c.role").isNotNull() & ~F.col("c.role").isin("qualifying", "supporting")), "invalid role", F.col("canonical")),
        rows(cfg.join(entities.select(F.col("en").alias("canonical")), "canonical", "left_anti"), "policy entity unknown", F.col("canonical")),
        rows(
            rules.withColumn("surface", F.lower("surface")).join(surfaces, ["canonical", "surface"], "left_anti"),
            "contextual surface unknown", F.concat_ws("/", "canonical", "surface"),
        ),
        rows(rules.where((F.col("surface") == "") | (size == 0) | F.exists(words, blank)), "bad contextual rule", F.concat_ws("/", "canonical", "surface")),
        rows(rules.where(F.col("r.max_gap_chars") < 0), "bad gap", F.concat_ws("/", "canonical", "surface")),
        rows(entities.select(F.col("en").alias("canonical")).join(usable, "canonical", "left_anti"), "no usable surface", F.col("canonical")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def load_surfaces(entities: DataFrame, policy: DataFrame) -> DataFrame:
    """Surface table: canonical, role, weight, surface, surface_pos, match_type, before, after, max_gap, block_key.

    Fails closed: any broken rule raises, naming the first few.
    """
    bad = _violations(entities, policy)
    found = bad.limit(20).collect()
    if found:
        raise DictionaryError("; ".join(f"{r.problem}: {r.subject}" for r in found))
    cfg = policy.select(F.explode("entities").alias("canonical", "c"))
    rules = cfg.select("canonical", F.explode("c.contextual_surfaces").alias("surface", "r")).withColumn("surface", F.lower("surface"))
    roles = cfg.select("canonical", F.col("c.role").alias("role"))
    base = entities.select(F.col("en").alias("canonical"), "weight", "aliases_en").join(roles, "canonical", "left").withColumn(
        "role", F.coalesce("role", F.lit("qualifying"))
    )
    none = F.array().cast("array<string>")
    strong = base.select(
        "canonical", "role", "weight", F.posexplode(F.concat(F.array("canonical"), "aliases_en")).alias("surface_pos", "s")
    ).withColumn("surface", F.lower("s")).where(F.length("surface") >= MIN_SURFACE)
    strong = strong.join(rules.select("canonical", "surface"), ["canonical", "surface"], "left_anti").select(
        "canonical", "role", "weight", "surface", "surface_pos", F.lit("strong").alias("match_type"),
        none.alias("before"), none.alias("after"), F.lit(DEFAULT_GAP).alias("max_gap"),
    )
    low = lambda c: F.transform(F.coalesce(c, none), lambda x: F.lower(x))
    contextual = rules.join(base.select("canonical", "role", "weight"), "canonical").select(
        "canonical", "role", "weight", "surface", F.lit(0).alias("surface_pos"), F.lit("contextual").alias("match_type"),
        low(F.col("r.before")).alias("before"), low(F.col("r.after")).alias("after"),
        F.coalesce(F.col("r.max_gap_chars").cast("int"), F.lit(DEFAULT_GAP)).alias("max_gap"),
    )
    return add_block_key(strong.unionByName(contextual))
