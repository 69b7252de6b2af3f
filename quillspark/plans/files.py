"""One file for each row, written by tasks that may run twice.

An attempt writes to a folder of its own and reports what it wrote; only reports of attempts
that succeeded count. A second pass then moves their files to the final names, which may also
be done twice, and files that no row names any more are pruned.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded, cut, qualified, storage

WROTE = "name string, staged string, bytes long, sha256 string"


def staged(rows: DataFrame, out: str) -> DataFrame:
    """name, staged, bytes and sha256 of rows (name, content) that one attempt wrote below _attempts."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, top = storage(out)
        folder = f"{top}/_attempts/{uuid.uuid4().hex}"
        fs.create_dir(folder, recursive=True)
        n = 0
        for b in batches:
            done = []
            for name, content in zip(b["name"], b["content"]):
                data, path, n = content.encode(), f"{folder}/{n}", n + 1
                with fs.open_output_stream(path, compression=None) as f:
                    f.write(data)
                done.append((name, path, len(data), hashlib.sha256(data).hexdigest()))
            yield pd.DataFrame(done, columns=["name", "staged", "bytes", "sha256"])

    bounded(rows.sparkSession)
    return rows.select("name", F.coalesce("content", F.lit("")).alias("content")).mapInPandas(write, WROTE)


def moved(wrote: DataFrame, out: str) -> DataFrame:
    """The reported files under their final names; one that is there already was moved by an earlier attempt."""

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, top = storage(out)
        for b in batches:
            for name, path, size in zip(b["name"], b["staged"], b["bytes"]):
                final = f"{top}/{name}"
                if fs.get_file_info(path).type == pyarrow.fs.FileType.File:
                    fs.create_dir(posixpath.dirname(final), recursive=True)
                    fs.move(path, final)
                if fs.get_file_info(final).size != size:
                    raise OSError(f"{final} is not the file that was written")
            yield b

    return wrote.mapInPandas(move, WROTE)


def existing(spark, out: str, folder: str = "") -> DataFrame:
    """name of every file below a folder of out, attempts apart."""
    fs, top = storage(qualified(spark, out))
    where = pyarrow.fs.FileSelector(f"{top}/{folder}".rstrip("/"), recursive=True, allow_not_found=True)
    names = [i.path.removeprefix(top).lstrip("/") for i in fs.get_file_info(where) if i.type == pyarrow.fs.FileType.File]
    return spark.createDataFrame([(n,) for n in names if not n.startswith(("_", "."))], "name string")


def write_files(rows: DataFrame, out: str, prune: str | None = None) -> DataFrame:
    """name, bytes and sha256 of the files of rows (name, content) below out.

    Names are relative; rows without one, or with one that leaves the folder, are an error, and
    so are two rows of one name. A null content is an empty file; a file that is there is
    replaced. prune: a folder in which files that no row names are deleted after.
    """
    spark = rows.sparkSession
    out = qualified(spark, out)
    bad = rows.filter(F.col("name").isNull() | F.col("name").rlike(r"^$|^/|^_|(^|/)\.\.?(/|$)")).limit(1).count()
    if bad or rows.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
        raise ValueError("every row needs a name of its own inside the folder")
    wrote = cut(staged(rows, out))
    done = cut(moved(wrote, out)).select("name", "bytes", "sha256")
    fs, top = storage(out)
    if prune is not None:
        lost = existing(spark, out, prune).join(done.select("name"), "name", "left_anti")
        for r in lost.toLocalIterator():
            fs.delete_file(f"{top}/{r['name']}")
    if fs.get_file_info(f"{top}/_attempts").type == pyarrow.fs.FileType.Directory:
        fs.delete_dir(f"{top}/_attempts")
    return done
