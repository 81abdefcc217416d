"""A tree of files as a DataFrame: one row a file, content read by the tasks and only where it is asked for.

The listing is what version control shows (tracked and untracked but not ignored), or a walk without ``.git`` and ``__pycache__`` outside a
work tree. Symbolic links are listed, never followed. The tree must be reachable by the same path from all executors.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import paths


def visible_files(root: str) -> list[str] | None:
    """Paths relative to root of the files that git shows there; None outside a work tree."""
    git = lambda *a: subprocess.run(["git", "-C", root, *a], capture_output=True, check=False)
    listed = git("ls-files", "--cached", "--others", "--exclude-standard", "-z", "--", ".")
    if git("rev-parse", "--is-inside-work-tree").stdout.strip() != b"true" or listed.returncode:
        return None
    found = {os.fsdecode(p) for p in listed.stdout.split(b"\0") if p}
    return sorted((p for p in found if os.path.isfile(os.path.join(root, p)) or os.path.islink(os.path.join(root, p))), key=lambda p: p.split("/"))


def walked_files(root: str) -> list[str]:
    found = []
    for folder, folders, names in os.walk(root):
        links = [d for d in folders if os.path.islink(os.path.join(folder, d))]
        folders[:] = [d for d in folders if d not in (".git", "__pycache__") and d not in links]
        found += [os.path.relpath(os.path.join(folder, n), root) for n in [*names, *links] if n not in (".git", "__pycache__")]
    return sorted((p for p in found if os.path.isfile(os.path.join(root, p)) or os.path.islink(os.path.join(root, p))), key=lambda p: p.split("/"))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, is_symlink, parts, name, suffix) of the files under root; names that aren't UTF-8 show replacement characters."""
    files = visible_files(root)
    files = walked_files(root) if files is None else files
    rows = [(p.encode("utf-8", "replace").decode(), os.path.islink(os.path.join(root, p))) for p in files]
    df = spark.createDataFrame(rows, "path string, is_symlink boolean")
    return df.withColumn("parts", F.split("path", "/")).withColumn("name", F.element_at("parts", -1)).withColumn("suffix", F.lower(paths.suffix(F.col("name"))))


def with_content(files: DataFrame, root: str) -> DataFrame:
    """files with ``content`` (binary) and ``read_error``."""
    at = files.columns.index("path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, errors = [], []
            for path in batch.column(at).to_pylist():
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        content.append(f.read())
                    errors.append(None)
                except OSError as e:
                    content.append(None)
                    errors.append(f"{type(e).__name__}: {e.strerror or type(e).__name__}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(content, pa.binary()), pa.array(errors, pa.string())], [*batch.schema.names, "content", "read_error"])

    return files.mapInArrow(read, files.selectExpr("*", "CAST(NULL AS BINARY) AS content", "CAST(NULL AS STRING) AS read_error").schema)
