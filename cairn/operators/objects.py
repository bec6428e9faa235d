"""Object stores as tables: key, size and what else an object has; one row a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.scalars import valid_key
from cairn.sources.stores import HIDDEN


def put(objects: DataFrame, new: DataFrame) -> DataFrame:
    """Objects after a put: those of ``new`` under valid keys replace what had their keys."""
    new = new.filter(valid_key(F.col("key")))
    return objects.join(new.select("key"), "key", "left_anti").unionByName(new)


def put_if_absent(objects: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of ``new`` that a conditional create adds: their keys are valid and not taken."""
    return new.filter(valid_key(F.col("key"))).join(objects.select("key"), "key", "left_anti")


def stat(objects: DataFrame, keys: DataFrame) -> DataFrame:
    """Each asked key, whether there is such an object, and its size; a folder is none."""
    there = objects.select("key", "size", F.lit(True).alias("there"))
    return keys.join(there, "key", "left").withColumn("there", F.coalesce("there", F.lit(False)))


def listed(objects: DataFrame, prefix: str = "") -> DataFrame:
    """Objects whose keys begin with ``prefix``, unfinished ones left out."""
    name = F.substring_index("key", "/", -1)
    return objects.filter(F.startswith("key", F.lit(prefix)) & ~F.startswith(name, F.lit(HIDDEN)))


def delete(objects: DataFrame, keys: DataFrame) -> DataFrame:
    """Objects after a delete; keys that aren't there change nothing."""
    return objects.join(keys.select("key"), "key", "left_anti")


def prefixed(objects: DataFrame, prefix: str) -> DataFrame:
    """The view of a store below a prefix: keys without it."""
    root = prefix.strip("/") + "/"
    return objects.filter(F.startswith("key", F.lit(root))).withColumn("key", F.substring(F.col("key"), F.lit(len(root) + 1), F.length("key")))
