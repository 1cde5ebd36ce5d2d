"""Landed files and headers: classify, discover, peek."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardgate.functions import vocab as v


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path``, ``n_bytes`` of the files under a folder; contents are not read."""
    files = spark.read.format("binaryFile").options(pathGlobFilter=glob, recursiveFileLookup=True)
    return files.load(path).select("path", F.col("length").alias("n_bytes"))


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; empty when the file name has none or starts with it."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def _lookup(key: Column, values: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for x in chain(*values.items())])
    return F.try_element_at(pairs, key)


def classify(files: DataFrame, path: str = "path") -> DataFrame:
    """Format label and reader of every file; a null reader means the format is not supported."""
    ext = extension(F.col(path))
    unknown = F.concat(F.lit("Unknown ("), F.upper(ext), F.lit(")"))
    return files.withColumns(
        {
            "extension": ext,
            "format": F.coalesce(_lookup(ext, v.FORMAT_LABELS), unknown),
            "reader": _lookup(ext, v.READER_BY_EXTENSION),
        }
    )


def discover(files: DataFrame, root: str, path: str = "path") -> DataFrame:
    """Supported files of the landing root and its known folders, with their priority.

    A Spark job takes them all; :func:`next_file` names the one a one-at-a-time intake would take.
    """
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    name = F.substring_index(path, "/", -1)
    folders = [root, *[f"{root}/{f}" for f in v.LANDING_FOLDERS]]
    ext_rank = _lookup(F.col("extension"), {e: str(i) for i, e in enumerate(v.READER_BY_EXTENSION)})
    dir_rank = _lookup(folder, {f: str(i) for i, f in enumerate(folders)})
    return (
        classify(files, path)
        .filter(F.col("reader").isNotNull() & (name != v.OWN_OUTPUT_FILE))
        .withColumns({"format_rank": ext_rank.cast("int"), "folder_rank": dir_rank.cast("int")})
        .filter(F.col("folder_rank").isNotNull())
    )


def next_file(discovered: DataFrame, path: str = "path") -> DataFrame:
    """The first file of the priority order."""
    order = F.struct("format_rank", "folder_rank", path)
    return discovered.agg(F.min(F.struct(order.alias("o"), "format", "reader")).alias("m")).select(
        F.col(f"m.o.{path}").alias(path), "m.format", "m.reader"
    )


def peek(
    batch: DataFrame, source: str, position: str, synonyms: dict[str, str], chars: int = v.SNIPPET_CHARS
) -> DataFrame:
    """Per landed source and column: the field it maps to and a snippet of the first record.

    ``batch`` holds many sources; the first record of each is found by a partial aggregate, so no
    source's rows are brought together.
    """
    columns = [c for c in batch.columns if c not in (source, position)]
    first = batch.groupBy(source).agg(
        F.min_by(F.struct(*[F.col(c).cast("string").alias(c) for c in columns]), position).alias("f")
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("source_col"),
                F.lit(synonyms.get(c.lower())).alias("canonical"),
                F.coalesce(F.left(F.col(f"f.{c}"), F.lit(chars)), F.lit("None")).alias("snippet"),
            )
            for c in columns
        ]
    )
    return first.select(source, F.inline(rows))
