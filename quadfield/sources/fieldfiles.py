"""Field files of spectral-element solvers (the public Nek5000 binary format) to tables.

A file is a 132-byte text header, a 4-byte endian mark, the global element ids, and
then per variable the element blocks (``X`` and ``U`` with one block per component).
Everything after the header sits at a computable offset, so one file is read by
many tasks, each seeking to its own range of elements.  A step may be stored in
several files (parts); their headers say how many, and the elements of a step are
numbered through its parts.
"""

from __future__ import annotations

import posixpath
import re
import warnings

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadfield.operators.scans import checkpointed

HEADER = 132
ENDIAN_MARK = 6.54321       # fixed value of the format
META_SUFFIX = ".nek5000"    # fixed value of the format
STEP_FILE = r"^(.*)(\d)\.f(\d{5})$"
BYTES_PER_READ = 1 << 26    # of the chosen arrays, in double precision
BYTES_PER_FILE = 1 << 27    # of a part written by one task

STEPS = T.StructType([
    T.StructField("case", T.StringType()), T.StructField("step", T.IntegerType()), T.StructField("file", T.StringType()),
    T.StructField("time", T.DoubleType()), T.StructField("istep", T.IntegerType()), T.StructField("nelv", T.LongType()),
    T.StructField("n", T.IntegerType()), T.StructField("has_mesh", T.BooleanType()), T.StructField("variables", T.StringType()),
    T.StructField("wdsz", T.IntegerType()), T.StructField("lz", T.IntegerType()), T.StructField("part", T.IntegerType()),
    T.StructField("parts", T.IntegerType()), T.StructField("total", T.LongType()), T.StructField("first_elem", T.LongType()),
])


def _hadoop(spark: SparkSession, path: str):
    """Spark's own filesystem for a path, and the path in it."""
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark gives it, so that every executor means the same place."""
    system, there = _hadoop(spark, path)
    return system.makeQualified(there).toString()


def _open(uri: str):
    """Filesystem and path of a qualified URI (``file:/x``, ``hdfs://...``, ``s3://...``), on an executor."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://"))


def parse_header(raw: bytes) -> dict:
    tok = raw.decode("ascii", "replace").split()
    if not tok or tok[0] != "#std":
        raise ValueError("the file does not start with the mark of a field file")
    return {
        "wdsz": int(tok[1]), "n": int(tok[2]), "ly": int(tok[3]), "lz": int(tok[4]), "nelv": int(tok[5]),
        "total": int(tok[6]), "time": float(tok[7]), "istep": int(tok[8]), "part": int(tok[9]), "parts": max(1, int(tok[10])),
        "variables": tok[11] if len(tok) > 11 else "",
    }


def variable_blocks(variables: str) -> list[tuple[str, list[str]]]:
    """Order of the data after the ids: ``(kind, column names)``; vectors have two components."""
    out = []
    text = variables.upper()
    if "X" in text:
        out.append(("X", ["x", "y"]))
    if "U" in text:
        out.append(("U", ["u", "v"]))
    if "P" in text:
        out.append(("P", ["p"]))
    if "T" in text:
        out.append(("T", ["t"]))
    m = re.search(r"S(\d+)", text)
    out += [("S", [f"s{k}"]) for k in range(int(m.group(1)))] if m else []
    return out


def list_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Paths below a directory or glob (a listing; contents are not read)."""
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    try:
        return reader.load(path).select(F.col("path").alias("file"))
    except AnalysisException as exc:
        raise FileNotFoundError(path) from exc


def _number(files: DataFrame, case: str) -> DataFrame:
    order = Window.partitionBy("case").orderBy("file")
    return files.select(F.lit(case).alias("case"), "file").withColumn("step", F.row_number().over(order) - 1)


def read_metafile(spark: SparkSession, path: str) -> DataFrame:
    """Steps named by a metafile of ``key: value`` lines; missing files are dropped with a warning.

    Keys: ``filetemplate`` (required), ``firsttimestep`` (0), ``numtimesteps`` (1).
    """
    base = posixpath.basename(path)
    case = base[: -len(META_SUFFIX)] if base.endswith(META_SUFFIX) else posixpath.splitext(base)[0]
    try:
        lines = spark.read.text(path)
    except AnalysisException as exc:
        raise FileNotFoundError(path) from exc
    pairs = lines.where(F.instr("value", ":") > 0).select(
        F.lower(F.trim(F.substring_index("value", ":", 1))).alias("k"), F.trim(F.expr("substring(value, instr(value, ':') + 1)")).alias("v")
    )
    wanted = ("filetemplate", "firsttimestep", "numtimesteps")
    row = pairs.agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in wanted]).first()
    if row["filetemplate"] is None:
        raise ValueError(f"{path} has no line 'filetemplate: ...'")
    template = row["filetemplate"].replace("%s", case, 1)
    first, count = int(row["firsttimestep"] or 0), int(row["numtimesteps"] or 1)
    slots = template.count("%")
    step = F.col("k").cast("int")
    name = F.format_string(template, F.lit(0), step) if slots >= 2 else F.format_string(template, step) if slots == 1 else F.lit(template)
    inner = posixpath.dirname(template)
    folder = inner if inner.startswith("/") else posixpath.join(posixpath.dirname(path) or ".", inner).rstrip("/")
    named = spark.range(first, first + count).select(F.col("id").alias("k")).select("k", name.alias("name"))
    named = named.withColumn("base", F.element_at(F.split("name", "/"), -1))
    there = list_files(spark, folder).withColumn("base", F.element_at(F.split("file", "/"), -1))
    hits = named.join(there, "base")
    kept = hits.count()
    if kept == 0:
        raise FileNotFoundError(f"{path} names {count} step files, and not one is in {folder}")
    if kept < count:
        warnings.warn(f"{path}: {count - kept} of {count} step files are missing", stacklevel=2)
    order = Window.partitionBy("case").orderBy("k")
    return hits.select(F.lit(case).alias("case"), "k", "file").withColumn("step", F.row_number().over(order) - 1).select("case", "file", "step")


def resolve_case(spark: SparkSession, path: str) -> DataFrame:
    """``(case, file, step)`` for a metafile, a directory with one metafile, a glob, or a step file.

    A single step file brings its siblings (same base name and file number); any
    other existing file is a case of one step.  The case is named by the file without its
    last digit; :func:`read_headers` knows better where part numbers have several digits.
    """
    base = posixpath.basename(path.rstrip("/"))
    if path.endswith(META_SUFFIX):
        return read_metafile(spark, path)
    if any(ch in path for ch in "*?["):
        files = list_files(spark, path)
        first = files.agg(F.min("file")).first()[0]
        if first is None:
            raise FileNotFoundError(path)
        return _number(files, re.sub(r"\d\.f.*$", "", posixpath.basename(first)))
    system, there = _hadoop(spark, path)
    if not system.exists(there):
        raise FileNotFoundError(path)
    if system.getFileStatus(there).isDirectory():
        metas = [r.file for r in list_files(spark, path, "*" + META_SUFFIX).limit(2).collect()]
        if len(metas) != 1:
            raise ValueError(f"{path}: a folder stands for a case only if it holds exactly one metafile")
        return read_metafile(spark, metas[0])
    m = re.match(STEP_FILE, base)
    if m:
        folder = posixpath.dirname(path) or "."
        return _number(list_files(spark, folder, f"{m[1]}{m[2]}.f[0-9][0-9][0-9][0-9][0-9]"), m[1])  # the part's number is cut off later
    return _number(list_files(spark, path), base)


def _scan_headers(files: DataFrame) -> DataFrame:
    """Header facts of ``(case, step, file)``: each task reads the first 132 bytes of its files."""

    def scan(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                system, path = _open(r["file"])
                with system.open_input_file(path) as fh:
                    h = parse_header(fh.read(HEADER))
                rows.append({**{k: r[k] for k in ("case", "step", "file")}, **{k: h[k] for k in ("time", "istep", "nelv", "n", "variables", "wdsz", "lz", "part", "parts", "total")}, "has_mesh": "X" in h["variables"].upper(), "first_elem": 0})
            yield pa.RecordBatch.from_pylist(rows, schema=_arrow(STEPS))

    wide = files.sparkSession.sparkContext.defaultParallelism
    return files.select("case", F.col("step").cast("int").alias("step"), "file").repartition(wide, "file").mapInArrow(scan, STEPS)


def part_layouts(name: str, part: int) -> list[tuple[str, int]]:
    """Ways to read a file name as (name of the case, width of the part number); width 0 is a number without leading zeros.

    ``box012.f00001`` as part 12 is part 12 of ``box0``, or of ``box`` with numbers of three digits; ``run20.f00001`` as part 0
    can only be a part of ``run2``.
    """
    m = re.match(r"^(.*?)(\d+)\.f\d{5}$", name)
    if not m or not m[2].endswith(str(part)):
        return []
    cut = lambda w: m[1] + m[2][: len(m[2]) - w]
    least = len(str(part))
    zeros = len(m[2]) - least - len(m[2][: len(m[2]) - least].rstrip("0"))
    return [(cut(least), 0), *[(cut(least + k), least + k) for k in range(0, zeros + 1)]]


def _layouts(listed: DataFrame) -> DataFrame:
    """(case, file, head, width, tail, files): for every file of a step in parts the layout that its parts really have.

    Each way to read the name gives the names of all parts; the one whose files are there is taken (numbers without zeros
    first, then narrow ones), or the one with most files.  ``files`` are the parts found, ``absent`` the names of the others.  Works on file metadata only.
    """
    spark, c = listed.sparkSession, F.col
    kind = T.ArrayType(T.StructType([T.StructField("head", T.StringType()), T.StructField("width", T.IntegerType())]))

    @F.udf(kind)
    def ways(name, part):
        return part_layouts(name, part)

    folder = F.regexp_extract("file", "^(.*/)[^/]*$", 1)
    base = F.regexp_extract("file", "([^/]*)$", 1)
    read = listed.select("case", "file", "parts", folder.alias("folder"), F.regexp_extract("file", "[.]f[0-9]{5}$", 0).alias("tail"), F.explode(ways(base, "part")).alias("w"))
    read = checkpointed(read.select("case", "file", "parts", "folder", "tail", "w.head", "w.width"))
    key = ["case", "folder", "head", "width", "tail", "parts"]
    number = F.when(c("width") > 0, F.lpad(c("k").cast("string"), F.greatest("width", F.length(c("k").cast("string"))), F.lit("0"))).otherwise(c("k").cast("string"))
    named = read.select(*key).distinct().withColumn("k", F.explode(F.sequence(F.lit(0), c("parts") - 1))).withColumn("file", F.concat("folder", "head", number, "tail"))
    there = None
    for r in read.select("folder").distinct().collect():  # folders of one opened case: a handful
        more = list_files(spark, r.folder, "*.f[0-9][0-9][0-9][0-9][0-9]").select(F.regexp_replace("file", "^file:/+", "file:/").alias("file"))
        there = more if there is None else there.unionByName(more)
    plain = F.regexp_replace("file", "^file:/+", "file:/")
    seen = named.withColumn("plain", plain).join(there.select(c("file").alias("plain"), F.lit(True).alias("there")).distinct(), "plain", "left")
    base = F.when(c("there").isNull(), F.regexp_extract("file", "([^/]*)$", 1))
    held = seen.groupBy(*key).agg(F.collect_list(F.when(c("there"), c("file"))).alias("files"), F.concat_ws(", ", F.array_sort(F.collect_list(base))).alias("absent"))
    rank = F.struct((F.size("files") < c("parts")).alias("a"), (-F.when(F.size("files") < c("parts"), F.size("files")).otherwise(0)).alias("b"), "width", "head")
    return read.join(held, key).groupBy("case", "file").agg(F.min_by(F.struct("folder", "head", "width", "tail", "files", "absent"), rank).alias("l")).select("case", "file", "l.*")


def read_headers(files: DataFrame) -> DataFrame:
    """``steps`` metadata of ``(case, step, file)``: one row per file, all parts of every step.

    Files whose headers name several parts bring the parts that are not listed and share one step; part numbers may be padded
    with zeros, and case names may end in digits.  ``first_elem`` is the number of elements in the
    parts before.  Steps are counted in the order of their first files.  Fails where a part
    is missing or the parts do not add up to the step's number of elements.  The windows
    run over file metadata: one row per file of a case.
    """
    listed, c = checkpointed(_scan_headers(files)), F.col
    several = c("parts") > 1
    base = F.regexp_extract("file", "([^/]*)$", 1)
    if listed.where(several).isEmpty():
        found = listed.withColumns({"_g": c("file"), "absent": F.lit(None).cast("string")})
    else:
        layout = checkpointed(_layouts(listed.where(several)))
        group = F.concat_ws("/", "folder", "head", c("width").cast("string"), "tail")
        # a case named by its files takes the name that the layout gives
        own = c("case") == F.regexp_replace(base, "[0-9][.]f[0-9]{5}$", "")
        whole = listed.where(several).join(layout, ["case", "file"], "left")
        whole = whole.withColumns({"_g": F.coalesce(group, c("file")), "_name": F.when(own & c("head").isNotNull(), c("head")).otherwise(c("case"))})
        known = whole.select("case", "_name", "_g", "step", "files")
        wanted = known.groupBy("case", "_name", "_g").agg(F.min("step").alias("step"), F.first("files").alias("files")).withColumn("file", F.explode("files"))
        more = wanted.join(listed.select("case", "file"), ["case", "file"], "left_anti")
        scanned = checkpointed(_scan_headers(more.select("case", "step", "file")))
        added = scanned.join(more.select("case", "file", "_name", "_g"), ["case", "file"])
        columns = [f.name for f in STEPS.fields]
        parts = whole.select(*columns, "_name", "_g", "absent").unionByName(added.select(*columns, "_name", "_g"), allowMissingColumns=True)
        single = listed.where(~several).withColumn("_g", c("file"))
        found = checkpointed(single.unionByName(parts.withColumn("case", c("_name")).drop("_name"), allowMissingColumns=True))
    name = F.element_at(F.split("file", "/"), -1)
    along = Window.partitionBy("case", "_g").orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("case", "_g")
    found = found.withColumns({
        "first_elem": F.coalesce(F.sum("nelv").over(along), F.lit(0)), "_held": F.sum("nelv").over(whole), "_files": F.count(F.lit(1)).over(whole), "_first": F.min("step").over(whole), "_absent": F.max("absent").over(whole),
    })
    complete = ~several | ((c("_held") == c("total")) & (c("_files") == c("parts")))
    problem = F.concat(name, F.lit(": parts of the step hold "), c("_held").cast("string"), F.lit(" of "), c("total").cast("string"), F.lit(" elements"), F.coalesce(F.concat(F.lit("; not there: "), F.nullif(c("_absent"), F.lit(""))), F.lit("")))
    found = found.withColumn("nelv", F.when(complete, c("nelv")).otherwise(F.raise_error(problem).cast("long")))
    number = F.dense_rank().over(Window.partitionBy("case").orderBy("_first")) - 1
    return found.withColumn("step", number.cast("int")).select(*[f.name for f in STEPS.fields])


def _arrow(schema: T.StructType) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema.fields])


def read_steps_table(spark: SparkSession, path: str) -> DataFrame:
    """Resolve a case and read its headers."""
    return read_headers(resolve_case(spark, path))


def stored_names(steps: DataFrame) -> list[str]:
    """Field names of a case; runs a distinct over the header codes (a handful of values)."""
    codes = [r.variables for r in steps.select("variables").distinct().collect()]
    names: list[str] = []
    for code in sorted(codes):
        for kind, cols in variable_blocks(code):
            names += [c for c in cols if kind != "X" and c not in names]
    return names


def read_elements(steps: DataFrame, names: list[str]) -> DataFrame:
    """Element rows of the steps: ``case step time elem gid n`` and the chosen arrays.

    ``names`` may include ``x`` and ``y``; arrays a file does not hold are NULL.  Only
    the bytes of the chosen variables are read.
    """
    schema = T.StructType(
        [T.StructField("case", T.StringType()), T.StructField("step", T.IntegerType()), T.StructField("time", T.DoubleType()), T.StructField("elem", T.LongType()), T.StructField("gid", T.IntegerType()), T.StructField("n", T.IntegerType())]
        + [T.StructField(k, T.ArrayType(T.DoubleType())) for k in names]
    )

    def read(batches):
        for b in batches:
            for r in b.to_pylist():
                yield _read_range(r, names, schema)

    size = F.lit(8 * max(1, len(names))) * F.col("n") * F.col("n")
    per = F.greatest(F.lit(1), F.floor(F.lit(BYTES_PER_READ) / size)).cast("long")
    ranges = steps.where("nelv > 0").withColumn("per", per).withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nelv") - 1, F.col("per"))))
    ranges = ranges.repartition("file", "start")
    return ranges.mapInArrow(read, schema)


def _read_range(r: dict, names: list[str], schema: T.StructType) -> pa.RecordBatch:
    if r["lz"] > 1:
        raise ValueError(f"{r['file']}: a 3-D file (lz = {r['lz']}); only 2-D data (lz = 1) is supported")
    start, stop = r["start"], min(r["nelv"], r["start"] + r["per"])
    rows, n, word = stop - start, r["n"], r["wdsz"]
    system, path = _open(r["file"])
    cols: dict[str, np.ndarray] = {}
    with system.open_input_file(path) as fh:
        fh.seek(HEADER)
        mark = fh.read(4)
        order = "<" if abs(np.frombuffer(mark, "<f4")[0] - ENDIAN_MARK) < 1e-4 else ">"
        fh.seek(HEADER + 4 + 4 * start)
        gid = np.frombuffer(fh.read(4 * rows), order + "i4").astype(np.int32)
        at = HEADER + 4 + 4 * r["nelv"]
        for _, parts in variable_blocks(r["variables"]):
            block = len(parts) * n * n * word
            if any(p in names for p in parts):
                fh.seek(at + start * block)
                data = np.frombuffer(fh.read(rows * block), f"{order}f{word}").astype(float).reshape(rows, len(parts), n * n)
                cols.update({p: data[:, k] for k, p in enumerate(parts)})
            at += r["nelv"] * block
    kinds = _arrow(schema)
    fixed = {"case": pa.array([r["case"]] * rows), "step": pa.array(np.full(rows, r["step"], np.int32)), "time": pa.array(np.full(rows, r["time"])), "elem": pa.array(np.arange(start, stop) + r["first_elem"]), "gid": pa.array(gid), "n": pa.array(np.full(rows, n, np.int32))}
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * np.int32(n * n))
    arrays = []
    for f in kinds:
        if f.name in fixed:
            arrays.append(fixed[f.name])
        elif f.name in cols:
            arrays.append(pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(cols[f.name]).ravel())))
        else:
            arrays.append(pa.nulls(rows, f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=kinds)


def read_mesh(steps: DataFrame, mesh_file: str | None = None) -> DataFrame:
    """Shared mesh ``(case, elem, gid, n, x, y)`` of each case: the first step with coordinates.

    ``mesh_file`` names another file (or case) whose first step with coordinates is the
    mesh of every case in ``steps``.  Fails if there are no coordinates at all.
    """
    source = steps if mesh_file is None else read_steps_table(steps.sparkSession, mesh_file)
    with_xy = source.where("has_mesh")
    if with_xy.isEmpty():
        raise ValueError("no file holds coordinates; name one that does as mesh_file")
    first = with_xy.groupBy("case").agg(F.min("step").alias("step"))
    mesh = read_elements(with_xy.join(first, ["case", "step"], "left_semi").select(*source.columns), ["x", "y"]).drop("step", "time")
    if mesh_file is None:
        return mesh
    names = [r.case for r in steps.select("case").distinct().collect()]  # cases opened by name: a handful
    return mesh.withColumn("case", F.explode(F.array(*[F.lit(k) for k in names])))


def write_field_file(
    step: DataFrame, folder: str, case: str, number: int, time: float = 0.0, names: list[str] | None = None, elements_per_file: int | None = None, part_digits: int = 0, bytes_per_file: int = BYTES_PER_FILE,
) -> DataFrame:
    """Write one step as single-precision field files with the mesh; returns ``(file, elements)``.

    ``step`` has ``elem, x, y`` and fields (``gid`` defaults to ``elem + 1``).  Velocity
    comes first, ``p`` and ``t`` keep their slots, all others become scalars in name
    order.  A large step is written by many tasks, one file of the multi-file layout
    each; a file holds at most ``bytes_per_file`` (or ``elements_per_file``).  Gaps in ``elem`` leave no empty
    part: files are counted over the elements that are there.  ``part_digits`` pads part numbers with zeros.
    """
    names = [c for c, t in step.dtypes if t.startswith("array") and c not in ("x", "y")] if names is None else list(names)
    vector = all(k in names for k in ("u", "v"))
    known = [k for k in ("p", "t") if k in names]
    scalars = sorted(k for k in names if k not in known and not (vector and k in ("u", "v")))
    code = "X" + ("U" if vector else "") + "".join(k.upper() for k in known) + (f"S{len(scalars):02d}" if scalars else "")
    folder = qualified(step.sparkSession, folder)
    total, nodes = step.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    blocks = [["x", "y"]] + ([["u", "v"]] if vector else []) + [[k] for k in known + scalars]
    if elements_per_file is None:
        elements_per_file = max(1, bytes_per_file // (4 * max(1, nodes or 1) * sum(map(len, blocks))))
    rows = step if "gid" in step.columns else step.withColumn("gid", (F.col("elem") + 1).cast("int"))
    flat = rows.select(F.floor(F.col("elem") / elements_per_file).alias("block"), "elem", "gid", "x", "y", *names)
    # one row per file: blocks that hold elements, numbered without gaps
    held = checkpointed(flat.groupBy("block").agg(F.count(F.lit(1)).alias("_n")))
    files = held.count()
    part = held.select("block", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("block")) - 1).alias("fid"))
    flat = flat.join(part, "block").drop("block")

    def write(table: pa.Table) -> pa.Table:
        table = table.sort_by("elem")
        rows_n = table.num_rows
        fid = table.column("fid")[0].as_py()
        mats = {k: table.column(k).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows_n, -1) for b in blocks for k in b}
        n = int(round(mats["x"].shape[1] ** 0.5))
        head = f"#std 4 {n:2d} {n:2d}  1 {rows_n:10d} {total:10d} {time:20.13E} {0:9d} {fid:6d} {files:6d} {code}"
        path = posixpath.join(folder, f"{case}{fid:0{part_digits}d}.f{number:05d}" if part_digits else f"{case}{fid}.f{number:05d}")
        system, local = _open(path)
        with system.open_output_stream(local) as out:
            out.write(head.ljust(HEADER)[:HEADER].encode("ascii"))
            out.write(np.array([ENDIAN_MARK], "<f4").tobytes())
            out.write(table.column("gid").to_numpy().astype("<i4").tobytes())
            for b in blocks:
                out.write(np.stack([mats[k] for k in b], axis=1).astype("<f4").tobytes())
        return pa.table({"file": [path], "elements": pa.array([rows_n], pa.int64())})

    return flat.groupBy("fid").applyInArrow(write, "file string, elements long")
