"""The tables of an index. Each has a leading ``repo``: one value of it is what one project's index was."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType()}


def fields(text: str) -> T.StructType:
    return T.StructType([T.StructField(name, KINDS[kind]) for name, kind in (f.split() for f in text.split(","))])


FILES = fields("repo string, file_path string, hash string, language string, last_indexed bigint, node_count bigint")
NODES = fields("repo string, file_path string, id string, name string, type string, signature string, start_line int, end_line int, start_col int, end_col int, parent_id string, language string, body_text string")
EDGES = fields("repo string, file_path string, caller_id string, callee_id string, callee_name string, line int")
COMMENTS = fields("repo string, node_id string, text string, source string, generated_at bigint")
SYNTAX = fields("repo string, file_path string, language string, node_id bigint, parent_node_id bigint, child_index int, kind string, field string, start_row int, start_col int, end_row int, end_col int, last_desc bigint, text string")
#: The layout's version, written beside the tables and checked when they are opened.
SCHEMA_VERSION = 1


@dataclass(frozen=True)
class Index:
    """An index as four tables."""

    files: DataFrame
    nodes: DataFrame
    edges: DataFrame
    comments: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {"files": self.files, "nodes": self.nodes, "edges": self.edges, "comments": self.comments}

    def with_(self, **tables: DataFrame) -> Index:
        return replace(self, **tables)


def empty_index(spark) -> Index:
    return Index(*(spark.createDataFrame([], s) for s in (FILES, NODES, EDGES, COMMENTS)))


def node_order() -> Column:
    """Which of several nodes is the first: path by path, inside a file outer before inner."""
    return F.struct("file_path", "start_line", "start_col", (-F.col("end_line")).alias("up_line"), (-F.col("end_col")).alias("up_col"), "id")


def node_order_columns() -> list[Column]:
    return [F.col("file_path"), F.col("start_line"), F.col("start_col"), F.desc("end_line"), F.desc("end_col"), F.col("id")]


def check_range(name: str, value: int, low: int, high: int) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} must be from {low} to {high}, not {value}")
    return value
