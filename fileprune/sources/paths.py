"""Names and places of what is stored."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

from fileprune.conf import storage_path


def validated(name: str) -> str:
    if name is None or not name.strip():
        raise ValueError("a name must not be blank")
    if name.startswith(".") or ".." in name or re.search(r"[/\\\x00]", name):
        raise ValueError(f"not a name: {name!r}")
    return name


def index_path(spark: SparkSession, name: str) -> str:
    return f"{storage_path(spark)}/indexes/{validated(name)}"


def file_list_name(name: str) -> str:
    return f"fileprune_index__{validated(name)}"


def file_list_path(spark: SparkSession, list_name: str) -> str:
    return f"{storage_path(spark)}/filelists/{validated(list_name)}"


def clean_file_name(name: str) -> str:
    """Runs of anything but letters and digits as one underscore, none at the ends."""
    return re.sub(r"[^A-Za-z0-9]+", "_", name).strip("_")


def working_root(spark: SparkSession) -> str:
    """A folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only where it is unset, on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.fileprune.workDir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="fileprune-work-")
        spark.conf.set("spark.fileprune.workDir", root)
    return root.rstrip("/")
