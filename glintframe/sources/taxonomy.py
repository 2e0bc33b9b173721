"""A two-level taxonomy read from lines of JSON: categories in their order, each with its prompts in theirs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintframe.sources.lines import text_lines

LINE = "name string, icon string, subs array<string>"
# Fixed value: what a prompt is put into before it is embedded.
TEMPLATE = "一张%s的照片"


def prompts(lines: DataFrame) -> DataFrame:
    """(cat_idx, sub_idx, category, icon, sub, prompt) of lines (id, line), one JSON object of name, icon and subs each.

    cat_idx is a line's place among all, sub_idx a prompt's among its line's; a line that is blank or no
    such object, and a null sub, keep their places and give no row.
    """
    known = lines.select(F.col("id").alias("cat_idx"), F.from_json("line", LINE).alias("c")).where("c.name is not null")
    each = known.select("cat_idx", F.col("c.name").alias("category"), F.coalesce("c.icon", F.lit("")).alias("icon"), F.posexplode("c.subs").alias("sub_idx", "sub")).where("sub is not null")
    return each.select("cat_idx", "sub_idx", "category", "icon", "sub", F.format_string(TEMPLATE, "sub").alias("prompt"))


def taxonomy(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """prompts() of the text files under a path."""
    return prompts(text_lines(spark, path, glob))
