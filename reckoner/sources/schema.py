"""A report's schema file as catalogue tables.

The file is a tree of nodes. A node has attributes (``ATTRIBUTES``), and its children stand in
"fields", in "items" (one, of an array), or beside the attributes. The tree is read as
leaves, each leaf belongs to the node around its attribute, and one grouping gives a row a
node. A node's tier is its own source or that of the nearest node around it: each node meets
the nodes whose path begins its own, by equality of paths.

Defined results: a node without a type is an object; children that are no objects, and
attributes of other names, aren't read; a schema without nodes gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reckoner.functions import scalars as S
from reckoner.operators import tree

# The attributes of a node.
ATTRIBUTES = (
    "type",
    "required",
    "source",
    "depends_on",
    "allowed_values",
    "description",
    "infer_from",
    "default",
    "validation",
)


def nodes(leaves: DataFrame, root: str = "expense_report") -> DataFrame:
    """template, type, required, required_expression, allowed, depends_on, source, tier and what follows for a form, of
    every node below ``root``.

    ``leaves``: those of the schema file (see ``tree.leaves``).
    """
    steps = F.col("steps")
    # The first attribute of a node ends its path; what is behind it is the attribute's value.
    names = F.transform(steps, lambda s: F.substring(s, F.lit(2), F.length(s)))
    in_schema = F.get(steps, F.lit(0)) == f".{root}"
    is_list = F.startswith(F.try_element_at(steps, F.lit(-1)), F.lit("["))
    depth = F.size(steps) - F.when(is_list, 2).otherwise(1)
    attribute = F.get(names, depth)
    own = F.slice(steps, F.lit(1), depth)
    path = F.array_join(F.transform(F.filter(own, lambda s: s != ".fields"), lambda s: F.when(s == ".items", "[]").otherwise(s)), "")
    each = leaves.where(in_schema & attribute.isin(*ATTRIBUTES)).select(F.substring(path, F.lit(2), F.length(path)).alias("template"), attribute.alias("a"), "pos", "kind", "value")
    one = lambda name: F.max(F.when(F.col("a") == name, F.col("value")))
    several = lambda name: F.array_sort(F.collect_list(F.when((F.col("a") == name) & (F.col("kind") != "array"), F.struct("pos", "value"))))
    required = F.max(F.when(F.col("a") == "required", F.struct("kind", "value")))
    found = each.groupBy("template").agg(
        F.min("pos").alias("pos"), F.coalesce(one("type"), F.lit("object")).alias("type"), one("source").alias("source"), one("description").alias("description"), one("infer_from").alias("infer_from"),
        required.alias("_r"), several("allowed_values").alias("_allowed"), several("depends_on").alias("_on"),
    )
    found = found.withColumns({
        "required": F.coalesce((F.col("_r.kind") == "boolean") & (F.col("_r.value") == "true"), F.lit(False)),
        "required_expression": F.when(F.col("_r.kind") == "string", F.col("_r.value")),
        "allowed": F.when(F.size("_allowed") > 0, F.col("_allowed.value")),
        "depends_on": F.col("_on.value"),
    })
    # A node and those around it: their paths are what is before each point or bracket of its own.
    parts = F.split(F.replace("template", F.lit("[]"), F.lit(".[]")), r"\.")
    around = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.replace(F.array_join(F.slice(parts, F.lit(1), k), "."), F.lit(".[]"), F.lit("[]")))
    tiers = found.where("source is not null").select(F.col("template").alias("_around"), F.col("source").alias("_source"))
    tier = found.select("template", F.posexplode(around).alias("_depth", "_around")).join(tiers, "_around").groupBy("template").agg(F.max_by("_source", "_depth").alias("tier"))
    shown = found.join(tier, "template", "left").withColumns({
        "control": S.control_type(F.col("type"), F.col("template")),
        "entry_mode": S.entry_mode(F.col("tier")),
        "priority": S.review_priority(F.col("template"), F.col("required"), F.col("required_expression")),
    })
    return shown.select("template", "pos", "type", "required", "required_expression", "allowed", "depends_on", "source", "tier", "description", "infer_from", "control", "entry_mode", "priority")


def field_types(schema_nodes: DataFrame) -> DataFrame:
    """template, type and allowed of the fields, as edits are judged by."""
    return schema_nodes.where(~F.col("type").isin("object", "array")).select("template", "type", "allowed")


def rules(schema_nodes: DataFrame) -> DataFrame:
    """path, required and required_expression of every node, as validation reads them."""
    return schema_nodes.select(F.col("template").alias("path"), "required", "required_expression")


def read_schema(spark: SparkSession, path: str, root: str = "expense_report") -> DataFrame:
    """The nodes of a schema file in JSON."""
    text = spark.read.text(path, wholetext=True).select(F.lit(0).alias("document_id"), F.col("value").alias("json"))
    return nodes(tree.leaves(text), root)
