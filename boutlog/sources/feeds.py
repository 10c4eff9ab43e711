"""Delimited files whose columns drift from file to file, read as one table.

All files are one scan of lines. A file's header is the line that names the key column; headers (one line per file) come from
a pass that only filters lines. Each distinct header is one way of taking a line apart, chosen by the line's file, so a new
header costs an expression and not a scan. Columns are found by name, under an older name too; what a file lacks is null. A
line that does not have as many fields as its header is kept in the corrupt column, with what could be read; so is every line
of a file without a header.
"""

from __future__ import annotations

import csv
import re
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The year in a file's path: before the extension of the file or its folder, or in a partition's folder.
YEAR = r"(?:_(?=\d{4}\.)|season=(?=\d{4}/))(\d{4})(?:\.[a-z]+)?(?:/[^/]*)?$"


@dataclass(frozen=True)
class Feed:
    """The columns of a feed (name -> type), the one that every header names, older names (old -> new), and how to tell dates."""

    columns: Mapping[str, str]
    key: str
    renamed: Mapping[str, str] = field(default_factory=dict)
    date_formats: Sequence[str] = ("yyyyMMdd", "yyyy-MM-dd")

    def names(self, column: str) -> list[str]:
        """The names under which a column may stand, the present one first."""
        return [column, *[old for old, new in self.renamed.items() if new == column]]


def whole(x: Column) -> Column:
    """Text without the ".0" that integers get where a column had gaps."""
    return F.regexp_replace(F.trim(x), r"\.0$", "")


def typed(x: Column, kind: str, date_formats: Sequence[str]) -> Column:
    """A text as the type; null where it is none."""
    if kind == "date":
        return F.coalesce(*[F.try_to_date(whole(x), f) for f in date_formats])
    if kind in ("int", "bigint"):
        return whole(x).try_cast(kind)
    return x if kind == "string" else F.trim(x).try_cast(kind)


def _fields(line: str) -> list[str]:
    return [name.strip() for name in next(csv.reader([line.lstrip("﻿")]), [])]


def _headed(lines: DataFrame, key: str) -> Column:
    """Whether a line is a header: one of its fields is the key's name."""
    plain = F.regexp_replace("value", '[﻿"]', "")
    return F.array_contains(F.transform(F.split(plain, ","), lambda f: F.trim(f)), key)


def read_feed(spark: SparkSession, paths: Sequence[str], feed: Feed, columns: Sequence[str] | None = None, corrupt: str | None = None, year_pattern: str = YEAR) -> DataFrame:
    """The feed's columns (or some of them) and season, the year in the file's path; a missing file raises FileNotFoundError.

    ``corrupt`` names a column for lines that did not fit their header. Empty files and files with a header only give no rows.
    """
    try:
        lines = spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("_file"))
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(str(e)) from e
        raise
    heads = lines.where(_headed(lines, feed.key)).groupBy("_file").agg(F.min("value").alias("head")).collect()  # a row per file
    variants = sorted({r["head"] for r in heads})
    # a row per file, so bounded by the number of paths that were listed
    files = spark.createDataFrame([(r["_file"], variants.index(r["head"])) for r in heads], "_file string, _variant int")
    rows = lines.where(~_headed(lines, feed.key) & (F.trim("value") != "")).join(F.broadcast(files), "_file", "left")
    wanted = list(columns or feed.columns)

    taken = F.lit(None)
    for v, head in enumerate(variants):
        fields = _fields(head)
        parsed = F.from_csv("value", ", ".join([*(f"c{i} string" for i in range(len(fields))), "_corrupt string"]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "escape": "\""})
        places = {name: [fields.index(n) for n in feed.names(name) if n in fields] for name in wanted}
        text = lambda z, name: F.coalesce(*[z[f"c{i}"] for i in places[name]], F.lit(None).cast("string"))
        # by way of an array, so that a line is taken apart once and not once for each of its columns
        one = F.transform(F.array(parsed), lambda z: F.struct(*[text(z, name).alias(name) for name in wanted], z["_corrupt"].alias("_corrupt")))[0]
        taken = F.when(F.col("_variant") == v, one).otherwise(taken) if v else F.when(F.col("_variant") == v, one)
    if not variants:
        taken = F.struct(*[F.lit(None).cast("string").alias(name) for name in wanted], F.col("value").alias("_corrupt"))
    out = rows.withColumn("_row", taken)
    season = F.regexp_extract("_file", year_pattern, 1).try_cast("int").alias("season")
    bad = [F.when(F.col("_variant").isNull(), F.col("value")).otherwise(F.col("_row._corrupt")).alias(corrupt)] if corrupt else []
    return out.select(*[typed(F.col(f"_row.`{name}`"), feed.columns[name], feed.date_formats).alias(name) for name in wanted], season, *bad)


def read_years(spark: SparkSession, folder: str, name: str, years: Sequence[int], feed: Feed, columns: Sequence[str] | None = None, required: bool = True) -> DataFrame | None:
    """read_feed of a file per year, ``name`` with ``{year}`` in it. A missing file raises where required, else it is left out with a warning; None without any."""
    if required:
        return read_feed(spark, [f"{folder}/{name.format(year=y)}" for y in years], feed, columns)
    try:
        out = read_feed(spark, [f"{folder}/{name.format(year='{' + ','.join(map(str, years)) + '}')}"], feed, columns)
        found = {int(m.group(1)) for f in out.inputFiles() if (m := re.search(YEAR, f))}
    except FileNotFoundError:
        out, found = None, set()
    if missing := sorted(set(years) - found):
        warnings.warn(f"no file for {missing} in {folder}: left out", stacklevel=2)
    return out
