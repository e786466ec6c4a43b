"""The documents as files on disk, so that listing, reading and refreshing run on real folders."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import bounded_batches, new_folder
from workload import bindings as B


def write_tree(rows: DataFrame, folder: str) -> str:
    """Write (path below ``B.HOME``, text, mtime) as files below ``folder``; a null text removes the file. Returns the root."""
    root = folder.removeprefix("file://").removeprefix("file:")
    bounded_batches(rows.sparkSession)

    def write(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                target = root + row.path.removeprefix(B.HOME)
                if row.text is None:
                    os.remove(target)
                    continue
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(target, "wb") as out:
                    out.write(row.text.encode())
                os.utime(target, (row.s, row.s))
            yield pd.DataFrame({"n": [len(batch)]})

    rows.select("path", "text", F.unix_seconds("mtime").alias("s")).mapInPandas(write, "n long").agg(F.sum("n")).first()
    return root


def documents_tree(t) -> str:
    return write_tree(B.files(t), new_folder(t.spark, "tree"))


def roots(root: str) -> list[str]:
    """The folders of the binding, and one that does not exist."""
    return [f"{root}/{f}" for f in B.FOLDERS] + [f"{root}/missing"]


def below_home(path: str, root: str):
    """The path as the binding names it."""
    return F.concat(F.lit(B.HOME), F.substring(path, F.lit(len(root) + 1), F.length(path)))
