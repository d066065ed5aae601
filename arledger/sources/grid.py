"""Raw cell grids: a header row and ragged data rows -> one table.

A grid frame has ``sheet_name``, ``row_pos`` (0 is the header row) and ``cells``, an array
of texts; ``sheet_pos`` is carried along when present.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arledger.functions.headers import distinct_names, standard_name
from arledger.operators.columns import sheet_keys


def read_grids(spark: SparkSession, root: str, glob: str = "*.json") -> DataFrame:
    """Grid frame of JSON payloads ``{"values": [[...], ...]}``, one file per sheet, as a
    spreadsheet service returns them. The sheet is named by the file."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.json)?$", 1)
    payload = (
        spark.read.schema("values array<array<string>>")
        .option("multiLine", "true")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .json(root)
    )
    # Decoded twice: once for the URI form, once for the escapes in the name itself.
    decoded = F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
    decoded = F.url_decode(F.replace(decoded, F.lit("+"), F.lit("%2B")))
    return payload.select(
        decoded.alias("sheet_name"), F.posexplode("values").alias("row_pos", "cells")
    ).withColumn("row_pos", F.col("row_pos").cast("bigint"))


def header_names(cells: list[str | None], width: int) -> list[str]:
    """Final column names of a sheet: widened to the longest row, blanks named by place."""
    names = [standard_name(cell if cell is not None else "") for cell in cells]
    names += [""] * (width - len(names))
    return distinct_names([name or f"column_{i}" for i, name in enumerate(names)])


def grid_to_table(grid: DataFrame) -> DataFrame:
    """One table of all sheets, columns matched by name, short rows filled with nulls.

    Only the header row and the width of each sheet come to the driver, which needs them
    for the schema. The data rows are read once, whatever number of different headers.
    """
    heads = grid.groupBy("sheet_name").agg(
        F.max(F.size("cells")).alias("width"),
        F.max(F.when(F.col("row_pos") == 0, F.col("cells"))).alias("header"),
    )
    # Column name -> place of the column -> sheets that have it there.
    places: dict[str, dict[int, list[str]]] = {}
    for row in heads.collect():
        for i, name in enumerate(header_names(row["header"] or [], row["width"])):
            places.setdefault(name, {}).setdefault(i, []).append(row["sheet_name"])
    columns = [_cell(by_place).alias(name) for name, by_place in places.items()]
    return grid.filter(F.col("row_pos") > 0).select(*sheet_keys(grid), "row_pos", *columns)


def _cell(by_place: dict[int, list[str]]) -> Column:
    cell = F.lit(None).cast("string")
    for place, sheets in by_place.items():
        here = F.col("sheet_name").isin(*sheets)
        cell = F.when(here, F.get("cells", F.lit(place))).otherwise(cell)
    return cell
