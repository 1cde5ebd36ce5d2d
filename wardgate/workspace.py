"""Where jobs may write between steps, and the few file-system calls Spark's readers do not offer."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``, else the warehouse every session has."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/wardgate-{label}-{uuid.uuid4().hex}"


def landed(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back, for what several steps read: it is worked out once, and its size is known."""
    folder = new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def is_committed(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the sub-folders."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


# --- replacing folders in two phases ----------------------------------------------------------

NEXT, INTENT = "_next", "_intent"


def prepared(root: str) -> str:
    """Where the new contents of folders under ``root`` are written; readers of ``root`` do not see it."""
    return f"{root}/{NEXT}"


def settle(spark: SparkSession, root: str) -> None:
    """Finish a replacement that broke off after its intent was written; drop one that broke off before.

    Every step can be done again: a folder whose new contents are still prepared is replaced, one without is in place.
    """
    fs, intent = _fs(spark, f"{root}/{INTENT}")
    if not fs.exists(intent):
        delete_path(spark, prepared(root))
        return
    path = spark._jvm.org.apache.hadoop.fs.Path
    held = fs.open(intent)
    lines = spark._jvm.org.apache.commons.io.IOUtils.toString(held, "UTF-8").split("\n")
    held.close()
    for kind, name in ((line[0], line[1:]) for line in lines):
        old, new = path(f"{root}/{name}"), path(f"{root}/{NEXT}/{name}")
        if kind == "-":
            fs.delete(old, True)
        elif fs.exists(new):
            fs.delete(old, True)
            fs.mkdirs(old.getParent())
            if not fs.rename(new, old):
                raise OSError(f"{new} cannot be moved to {old}")
    fs.delete(intent, True)
    delete_path(spark, prepared(root))


def replace_folders(spark: SparkSession, root: str, replaced: list[str], removed: list[str]) -> None:
    """Put the prepared folders ``replaced`` in place of those under ``root`` and drop the folders ``removed``.

    First the intent is written and given its name at once, then the folders are moved one by one.  A driver lost before
    the intent leaves the old contents, one lost after it the new ones as soon as :func:`settle` runs.
    """
    lines = [f"+{n}" for n in sorted(replaced)] + [f"-{n}" for n in sorted(removed)]
    if not lines:
        delete_path(spark, prepared(root))
        return
    fs, intent = _fs(spark, f"{root}/{INTENT}")
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{NEXT}{INTENT}")
    out = fs.create(draft, True)
    out.write(bytearray("\n".join(lines).encode()))
    out.close()
    if not fs.rename(draft, intent):
        raise OSError(f"{intent} cannot be written")
    settle(spark, root)
