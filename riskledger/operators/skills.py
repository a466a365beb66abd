"""Skill directories and skill grades."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskledger.catalog import labels as L
from riskledger.functions import paths
from riskledger.functions.scoring import lookup
from riskledger.operators.corpus import salted_join, with_path_parts


def skill_directory_files(files: DataFrame) -> DataFrame:
    """Files below each skill file's directory: ``scan_id, skill_path, path, rel_path, is_text``.

    Files are joined through their ancestor directories, an equality on ``(scan_id, dir)``.
    """
    parts = with_path_parts(files)
    skills = parts.where(F.lower("name") == "skill.md").select(
        "scan_id", F.col("dir").alias("skill_dir"), F.col("path").alias("skill_path"))
    below = parts.select("scan_id", "path", "name",
                         F.explode(paths.ancestor_dirs(F.col("dir"))).alias("skill_dir"))
    rel = paths.relative_to(F.col("path"), F.col("skill_dir"))
    return (salted_join(below, skills, ["scan_id", "skill_dir"], ["path"])
            .withColumn("rel_path", rel)
            .select("scan_id", "skill_path", "path", "rel_path", paths.is_text_file(F.col("name")).alias("is_text")))


def grade_of(critical: Column, high: Column, medium: Column, low: Column) -> Column:
    return (F.when((critical > 0) | (high >= 3), "F").when((high > 0) | (medium >= 3), "C")
            .when((medium > 0) | (low >= 4), "B").otherwise("A"))


def trust_of(grade: Column) -> Column:
    return lookup(L.GRADE_TRUST, grade, "Conditional")


def grade_skills(findings: DataFrame, key: str) -> DataFrame:
    """Grade and trust per key from ``severity`` rows of an external scanner."""
    n = {s: F.count_if(F.col("severity") == s) for s in ("critical", "high", "medium", "low")}
    return findings.groupBy(key).agg(*[c.alias(s) for s, c in n.items()]).withColumn(
        "grade", grade_of(*[F.col(s) for s in n])).withColumn("trust", trust_of(F.col("grade")))
