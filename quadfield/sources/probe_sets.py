"""Saved probe sets: JSON files with definitions, lines, boundaries and a pinned probe.

A file is one JSON object with a version under a key that ends in ``_session``.
Many files are read at once into tables that feed the operators.
"""

from __future__ import annotations

import posixpath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1  # newest version understood

_DATASET = "struct<path:string,step:int>"
_CALC = "struct<defs:array<struct<name:string,expr:string>>>"
_LINES = "array<struct<id:bigint,kind:string,x0:double,y0:double,x1:double,y1:double,visible:boolean>>"
_BOUNDARIES = "array<struct<name:string,source:string,closed:boolean,visible:boolean,edges:array<array<bigint>>>>"
_FORCES = "struct<selection:array<string>,config:map<string,string>>"
_PROBE = "struct<pinned:struct<x:double,y:double>>"


def _absolute(folder, path):
    """Dataset path counted from the folder of its file (one short string per file)."""

    @F.arrow_udf("string")
    def join(folders: pa.Array, paths: pa.Array) -> pa.Array:
        both = zip(folders.to_pylist(), paths.to_pylist())
        return pa.array([p if p is None or posixpath.isabs(p) or "://" in p else posixpath.normpath(posixpath.join(f, p)) for f, p in both], pa.string())

    return join(folder, path)


def read_probe_sets(spark: SparkSession, path) -> DataFrame:
    """One row per file, checked: ``set, dataset, step`` and the parsed parts.

    A file without version key, of a newer version, or without a dataset path fails the
    job.  A relative dataset path counts from the file; the step defaults to 0.
    """
    c = F.col
    raw = spark.read.text(path, wholetext=True).select(F.regexp_replace(c("_metadata.file_path"), "^file:/+", "/").alias("set"), F.from_json("value", "map<string,string>").alias("m"))
    key = F.get(F.filter(F.map_keys("m"), lambda k: k.endswith("_session")), F.lit(0))
    raw = raw.select("set", "m", F.element_at("m", key).cast("int").alias("version"))
    part = lambda k, t: F.from_json(F.element_at("m", F.lit(k)), t).alias(k)
    raw = raw.select("set", "version", part("dataset", _DATASET), part("calc", _CALC), part("lines", _LINES), part("boundaries", _BOUNDARIES), part("forces", _FORCES), part("probe", _PROBE))
    fail = lambda text: F.raise_error(F.concat(c("set"), F.lit(": " + text)))
    version = F.when(c("version").isNull(), fail("not a saved probe set").cast("int")).when(c("version") > VERSION, fail("written by a newer version").cast("int")).otherwise(c("version"))
    source = F.when(F.coalesce(c("dataset.path"), F.lit("")) == "", fail("no dataset path")).otherwise(c("dataset.path"))
    folder = F.regexp_replace("set", "/[^/]*$", "")
    return raw.select("set", version.alias("version"), _absolute(folder, source).alias("dataset"), F.coalesce("dataset.step", F.lit(0)).alias("step"), "calc", "lines", "boundaries", "forces", "probe")


def probe_lines(sets: DataFrame) -> DataFrame:
    """``set, dataset, step, line, kind, x0, y0, x1, y1, visible`` (visible by default)."""
    e = sets.select("set", "dataset", "step", F.posexplode("lines").alias("k", "l"))
    return e.select("set", "dataset", "step", F.coalesce(F.col("l.id"), F.col("k") + 1).cast("string").alias("line"), F.coalesce("l.kind", F.lit("line")).alias("kind"), *[F.col(f"l.{k}").alias(k) for k in ("x0", "y0", "x1", "y1")], F.coalesce("l.visible", F.lit(True)).alias("visible"))


def definitions(sets: DataFrame) -> DataFrame:
    """``set, seq, name, expr`` in the order they were made."""
    return sets.select("set", F.posexplode("calc.defs").alias("seq", "d")).select("set", "seq", F.col("d.name").alias("name"), F.col("d.expr").alias("expr"))


def probe_boundaries(sets: DataFrame) -> DataFrame:
    """``set, boundary, closed, seq, elem, side`` of the saved boundaries."""
    b = sets.select("set", F.explode("boundaries").alias("b")).select("set", F.col("b.name").alias("boundary"), F.coalesce("b.closed", F.lit(False)).alias("closed"), F.posexplode("b.edges").alias("seq", "e"))
    return b.select("set", "boundary", "closed", "seq", F.get("e", F.lit(0)).alias("elem"), F.get("e", F.lit(1)).cast("int").alias("side"))


def pinned_probes(sets: DataFrame) -> DataFrame:
    """``set, dataset, step, x, y`` of the pinned points."""
    return sets.where("probe.pinned is not null").select("set", "dataset", "step", F.col("probe.pinned.x").alias("x"), F.col("probe.pinned.y").alias("y"))


def force_settings(sets: DataFrame) -> DataFrame:
    """``set, boundary, <settings map>`` of the force requests."""
    return sets.where("forces.selection is not null").select("set", F.explode("forces.selection").alias("boundary"), F.col("forces.config").alias("config"))
