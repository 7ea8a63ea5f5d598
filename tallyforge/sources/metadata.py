"""Workspace metadata (one JSON document a workspace) and review records as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEPENDENCY = "struct<name:string,source:string,req:string,kind:string,rename:string,optional:boolean,path:string>"
TARGET = "struct<name:string,kind:array<string>,src_path:string,edition:string>"
PACKAGE = f"struct<name:string,version:string,id:string,manifest_path:string,edition:string,dependencies:array<{DEPENDENCY}>,targets:array<{TARGET}>,features:map<string,array<string>>>"
METADATA = f"struct<packages:array<{PACKAGE}>,workspace_members:array<string>,workspace_root:string>"


def parse(documents: DataFrame, json_col: str = "value") -> DataFrame:
    """(workspace_root, member, and the package's fields): a row a package; documents that are no JSON give none."""
    read = documents.select(F.from_json(json_col, METADATA).alias("m")).where("m is not null")
    rows = read.select(F.col("m.workspace_root").alias("workspace_root"), F.col("m.workspace_members").alias("members"), F.explode("m.packages").alias("p"))
    return rows.select("workspace_root", F.array_contains("members", F.col("p.id")).alias("member"), "p.*")


def dependencies(packages: DataFrame) -> DataFrame:
    """A row a dependency of a package; a renamed one goes by its new name as alias."""
    rows = packages.select("workspace_root", F.col("id").alias("package"), F.explode("dependencies").alias("d"))
    return rows.select("workspace_root", "package", F.col("d.name").alias("name"), F.coalesce("d.rename", "d.name").alias("alias"), F.col("d.source").alias("source"), F.col("d.req").alias("req"), F.coalesce("d.kind", F.lit("normal")).alias("kind"), F.col("d.optional").alias("optional"), F.col("d.path").alias("path"))


def targets(packages: DataFrame) -> DataFrame:
    """A row a target, its kinds as a list, and the edition of its own or its package's."""
    rows = packages.select("workspace_root", F.col("id").alias("package"), "edition", F.explode("targets").alias("t"))
    return rows.select("workspace_root", "package", F.col("t.name").alias("name"), F.col("t.kind").alias("kinds"), F.col("t.src_path").alias("path"), F.coalesce("t.edition", "edition").alias("edition"))


def features(packages: DataFrame) -> DataFrame:
    """(package, feature, activates): a row a feature and what it activates; one that activates nothing has a null."""
    rows = packages.select("workspace_root", F.col("id").alias("package"), F.explode("features").alias("feature", "listed"))
    return rows.select("workspace_root", "package", "feature", F.explode_outer("listed").alias("activates"))


def inventory(compiler, walk, roots, compiled_whole, walked_whole):
    """(files, complete): what the compiler saw before what a walk found before the targets' roots; the latter are never all."""
    complete = F.when(compiler.isNotNull(), compiled_whole).when(walk.isNotNull(), walked_whole).otherwise(False)
    return F.coalesce(compiler, walk, roots), complete


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines with a fixed schema; a line that doesn't fit fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
