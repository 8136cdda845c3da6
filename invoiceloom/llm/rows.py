"""Small helpers the operators share: packed rows, ASCII rules and the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``[\x20\x09-\x0D]``, what separates words and is stripped from lines.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def column(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, name: str = "row") -> Column:
    """All columns of ``df`` as one struct, so that added names can't clash with them."""
    return F.struct(*[column(c) for c in df.columns]).alias(name)


def unpacked(df: DataFrame, columns: list[str], added: dict[str, Column], name: str = "row") -> DataFrame:
    """The packed columns in their order, then ``added``; an added name takes the place of an equal one."""
    lower = {k.lower(): k for k in added}
    kept = [added[lower[c.lower()]].alias(c) if c.lower() in lower else F.col(name)[c].alias(c) for c in columns]
    there = {c.lower() for c in columns}
    return df.select(*kept, *[v.alias(k) for k, v in added.items() if k.lower() not in there])


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder in ``spark.checkpoint.dir``, which every executor can reach.

    Only a session that runs in one process may leave it unset: it gets a temporary folder.
    """
    context = spark.sparkContext
    root = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        root = context.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder as Parquet and read from there.

    Later steps neither compute it again nor depend on what an executor holds.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
