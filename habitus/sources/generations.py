"""Tables of references in generations.

A write adds a generation beside the earlier ones and names it in one last
row, the commit.  Readers follow commits only: a writer that is lost at any
point leaves rows that nobody reads, and its references keep their old tables
as a whole, never some old and some new.

    <path>/<table>/generation=<g>/      the rows written
    <path>/references/generation=<g>/   the references they replace
    <path>/commits/                     one row per finished generation
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from habitus.operators.trace import KEY

COMMITS = "number bigint, generation string"
#: Names of the folders that hold no table of the caller.
OWN = ("references", "commits")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(number, generation) of the finished generations, the newest with the greatest number."""
    if not _exists(spark, f"{path}/commits"):
        return spark.createDataFrame([], COMMITS)
    return spark.read.schema(COMMITS).parquet(f"{path}/commits")


def stage(tables: Mapping[str, DataFrame], path: str, references: DataFrame | None = None) -> str:
    """Write a generation that no reader sees yet; returns its name.

    ``references`` (skill, project_type) are the references replaced, by default
    those that occur in a table.  One without rows in a table has none there.
    """
    if not tables or set(tables) & set(OWN):
        raise ValueError(f"needs tables, none of them called {' or '.join(OWN)}")
    spark = next(iter(tables.values())).sparkSession
    generation = f"g{uuid.uuid4().hex}"
    found = references.select(*KEY) if references is not None else None
    for name, table in tables.items():
        place = f"{path}/{name}/generation={generation}"
        table.write.parquet(place)
        if references is None:
            keys = spark.read.schema(table.schema).parquet(place).select(*KEY)
            found = keys if found is None else found.unionByName(keys)
    found.distinct().write.parquet(f"{path}/references/generation={generation}")
    return generation


def commit(spark: SparkSession, path: str, generation: str) -> int:
    """Make a staged generation the newest one; a repeated call changes nothing.

    The commit is one row in one file, which a file system shows whole or not
    at all.  Of two writers that commit at once the greater name counts as newer.
    """
    known = commits(spark, path)
    done = known.filter(F.col("generation") == generation).first()
    if done is not None:
        return done["number"]
    number = (known.agg(F.max("number")).first()[0] or 0) + 1
    spark.createDataFrame([(number, generation)], COMMITS).coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return number


def write_generation(tables: Mapping[str, DataFrame], path: str, references: DataFrame | None = None) -> int:
    """Replace the tables of some references at once; returns the generation's number."""
    spark = next(iter(tables.values())).sparkSession
    return commit(spark, path, stage(tables, path, references))


def generations_of(spark: SparkSession, path: str) -> DataFrame:
    """(skill, project_type, generation, age) of each reference: age 1 is current, 2 previous."""
    if not _exists(spark, f"{path}/references"):
        return spark.createDataFrame([], "skill string, project_type string, generation string, age int")
    newest = Window.partitionBy(*KEY).orderBy(F.desc("number"), F.desc("generation"))
    schema = "skill string, project_type string, generation string"
    # a row per reference and write, not per rule
    return (
        spark.read.schema(schema).parquet(f"{path}/references")
        .join(commits(spark, path), "generation")
        .select(*KEY, "generation", F.row_number().over(newest).alias("age"))
    )


def read_generation(spark: SparkSession, path: str, name: str, age: int = 1) -> DataFrame:
    """Rows of table ``name``: current ones, or with ``age`` 2 those each reference had before.

    A reference written once has no rows of age 2.  Nulls in the two key columns
    are a reference of their own.
    """
    wanted = generations_of(spark, path).filter(F.col("age") == age)
    rows = spark.read.parquet(f"{path}/{name}")
    same = rows["generation"] == wanted["generation"]
    for key in KEY:
        same = same & rows[key].eqNullSafe(wanted[key])
    return rows.join(wanted, same, "left_semi").drop("generation")
