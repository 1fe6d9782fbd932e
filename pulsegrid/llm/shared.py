"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id.
LAST = (1 << 63) - 1
#: ASCII white space: the separators of a word everywhere in this package.
WORD_GAP = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only where the setting is absent and all runs on this machine, as in tests, a temporary
    folder is made; on a cluster that raises, for executors would not see the folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if made.isEmpty() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = made.get() if made.isDefined() else tempfile.mkdtemp(prefix="pulsegrid-")
        if made.isEmpty():
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``checkpoint()`` into the shared folder: lineage ends there and survives a lost executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def keyed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """(id, k0, k1, text, *more): internal names, so that no other column of the input clashes.

    ``k0, k1`` identify a row's content without nulls: the id (the largest long for null,
    so that null ids come last) and a hash over "id is null" and the text. Rows with equal
    keys are equal rows. A null text counts as empty.
    """
    id_, text = docs[id_col], docs[text_col]
    return docs.select(
        id_.alias("id"),
        F.coalesce(id_.cast("long"), F.lit(LAST)).alias("k0"),
        F.xxhash64(id_.isNull(), text).alias("k1"),
        F.coalesce(text, F.lit("")).alias("text"),
        *more,
    )


def row_key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """``k0, k1`` of ``keyed`` over the documents' own columns."""
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return F.coalesce(id_.cast("long"), F.lit(LAST)), F.xxhash64(id_.isNull(), text)


def beside(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, how: str = "left") -> DataFrame:
    """The documents, as one struct column ``row``, joined to ``found`` on (__k0, __k1)."""
    k0, k1 = row_key(id_col, text_col)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), k0.alias("__k0"), k1.alias("__k1"))
    return whole.join(found, ["__k0", "__k1"], how)


def semi(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, how: str = "left_semi") -> DataFrame:
    """The documents' rows whose key is (or, for left_anti, isn't) in ``found``."""
    return beside(docs, found, id_col, text_col, how).select("row.*")


def remove_dir(spark: SparkSession, folder: str) -> None:
    """Deletes a folder in whatever store it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
