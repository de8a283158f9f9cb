"""Session helpers: table access and lineage cuts."""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data directory ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    Read from ``spark.checkpoint.dir``.  Only a session in local mode that names none gets a folder of its own, which is
    removed when the program ends; what is written to a named folder is left to its owner's rules.  On a cluster a
    machine-local folder would lose data with the machine, so that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not named:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a shared folder")
            named = tempfile.mkdtemp(prefix="marginalia-checkpoints-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: lineage ends here."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stamp(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A name for the present state of a table's files: changes when one is written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files = [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path)]
    return hashlib.sha256(repr(sorted(files)).encode()).hexdigest()[:24]
