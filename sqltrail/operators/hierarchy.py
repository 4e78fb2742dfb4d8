"""Parent-child hierarchies and SQL texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqltrail.operators.sizing import scaled_join
from sqltrail.session import cut_lineage

# Same question as `domain_paths`, as a SQL text over the view `domain`.
DOMAIN_PATHS_SQL = """
WITH RECURSIVE tree (code, name, description, level, path) AS (
  SELECT code, name, description, 0, CAST(code AS STRING) FROM domain WHERE parent_code IS NULL
  UNION ALL
  SELECT child.code, child.name, child.description, tree.level + 1, tree.path || '->' || child.code
  FROM domain child JOIN tree ON child.parent_code = tree.code
)
SELECT code, name, description, level, path FROM tree ORDER BY path"""


def domain_paths(domain: DataFrame, max_level: int | None = None) -> DataFrame:
    """Every way from a root down to a node: the node, its level (roots 0) and the `root->…->node` path, by path.

    A code may have several rows and so several parents; each way gives a row, as in `DOMAIN_PATHS_SQL`. A way ends
    before it would come to a code a second time, so a cycle that a root leads to ends too. Nodes that no root leads to
    do not appear. A null code gives a null path and has no children. With `max_level`, a deeper tree is an error.

    Rounds grow with the logarithm of the depth: one round has all ways down of fewer than 2^k levels, and all stretches
    of exactly 2^k; it puts stretches below the ways, which doubles the levels, and stretches below stretches. Each round
    is written as one table to the checkpoint folder. Stretches are made for all rows, reached or not: a row has one for
    each way up of that length, so one where no code above it has several rows.
    """
    nodes = domain.select("code", "name", "description", "parent_code")
    own = F.array("code").alias("codes")
    found = cut_lineage(nodes.filter(F.col("parent_code").isNull()).select("code", "name", "description", F.lit(0).alias("level"), own))
    stretches = cut_lineage(
        nodes.filter(F.col("parent_code").isNotNull() & ~F.col("code").eqNullSafe(F.col("parent_code"))).select("code", "name", "description", F.col("parent_code").alias("above"), own)
    )
    length = 1
    while True:
        below = _continued(found, stretches, "level").withColumn("level", F.col("level") + length)
        below = cut_lineage(below.select(*found.columns))
        deepest = below.agg(F.max("level")).first()[0]
        if deepest is None:
            break
        if max_level is not None and deepest > max_level:
            raise ValueError(f"more than {max_level} levels")
        found = cut_lineage(found.unionByName(below))
        stretches = cut_lineage(_continued(stretches, stretches, "above").filter(~F.coalesce(F.array_contains("codes", F.col("above")), F.lit(False))).select(*stretches.columns))
        length *= 2
    path = F.when(~F.exists("codes", F.isnull), F.array_join("codes", "->"))
    return found.select("code", "name", "description", "level", path.alias("path")).orderBy("path")


def _continued(ways: DataFrame, stretches: DataFrame, *kept: str) -> DataFrame:
    """`stretches` put below the `ways` whose last code they begin under, where no code comes twice."""
    above = ways.select(F.col("code").alias("_last"), F.col("codes").alias("_codes"), *kept)
    below = stretches.withColumnRenamed("above", "_last").drop("level")
    return (
        scaled_join(below, above, ["_last"])
        .filter(~F.coalesce(F.arrays_overlap("_codes", "codes"), F.lit(False)))
        .withColumn("codes", F.concat("_codes", "codes"))
    )


def unreachable(domain: DataFrame, paths: DataFrame) -> DataFrame:
    """Nodes that no root leads to: members of cycles, children of missing parents, and all below them."""
    return domain.join(paths.select("code"), "code", "left_anti")


def run_sql(spark: SparkSession, text: str, max_levels: int = 1000, max_rows: int | None = None) -> DataFrame:
    """Run one SQL text over the registered views. Recursion is bounded in levels, and in rows if asked.

    The bounds are settings of the session, which Spark reads when rows are made. So the rows are made here, and kept in
    the checkpoint folder; then the settings are what they were.
    """
    bounds = {"spark.sql.cteRecursionLevelLimit": max_levels, "spark.sql.cteRecursionRowLimit": -1 if max_rows is None else max_rows}
    before = {key: spark.conf.get(key, None) for key in bounds}
    try:
        for key, value in bounds.items():
            spark.conf.set(key, str(value))
        return cut_lineage(spark.sql(text))
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def run_sql_file(spark: SparkSession, path: str, **bounds) -> DataFrame:
    with open(path, encoding="utf-8") as file:
        return run_sql(spark, file.read(), **bounds)
