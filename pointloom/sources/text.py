"""Text formats: run manifests, STAR loops, XYZ clouds, PDB atoms, result documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import file_index, id_list, required_key
from ..functions.numeric import finite

#: Path parts of the standard layout: set, tomogram and alignment folder above the file's own folder.
LAYOUT = r"/([^/]+)/TOP_TOMOS/([^/]+)/([^/]+)/"


def manifest(spark: SparkSession, path: str, set_name: str | None = None) -> DataFrame:
    """tomogram_name, set_name, alignment_dir, cleft_ids (array or NULL for all); header names in any case.

    Missing required columns raise at once, blank alignment folders when read.
    """
    raw = spark.read.option("header", True).csv(path)
    by = {c.strip().lower(): c for c in raw.columns}
    missing = {"tomoname", "set", "alignment_dir"} - by.keys()
    if missing:
        raise ValueError(f"the manifest lacks {sorted(missing)}")
    ids = id_list(F.col(f"`{by['cleft_ids']}`")) if "cleft_ids" in by else F.lit(None).cast("array<int>")
    out = raw.select(
        F.trim(F.col(f"`{by['tomoname']}`")).alias("tomogram_name"), F.trim(F.col(f"`{by['set']}`")).alias("set_name"), required_key(F.col(f"`{by['alignment_dir']}`")).alias("alignment_dir"), ids.alias("cleft_ids")
    )
    return out.filter(F.col("set_name") == set_name) if set_name else out


def rows_from(manifest_df: DataFrame, first: int) -> DataFrame:
    """Rows of a manifest from a row number (from 0) in file order; needs a column row_number."""
    return manifest_df.filter(F.col("row_number") >= first)


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Whole files as (file, line number, line); a file is one row, as these files are small."""
    whole = spark.read.text(path, wholetext=True).select(F.col("value"), F.col("_metadata.file_path").alias("file"))
    return whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))


def with_layout(df: DataFrame, file_col: str = "file") -> DataFrame:
    """set_name, tomogram_name and alignment_dir from the path."""
    return df.select("*", *[F.regexp_extract(file_col, LAYOUT, i).alias(n) for i, n in ((1, "set_name"), (2, "tomogram_name"), (3, "alignment_dir"))])


def _whole(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("file_name"))


def _loops(whole: DataFrame) -> DataFrame:
    """file, row, values of the first loop of each file; a file is split once and stays one row until its body is."""
    lines = whole.select("file", F.transform(F.split("value", r"\r?\n"), lambda x: F.trim(x)).alias("l"))
    loop = lines.filter(F.array_contains("l", "loop_")).withColumn("l", F.expr("slice(l, array_position(l, 'loop_') + 1, size(l))"))
    labels = F.transform(F.filter("l", lambda x: x.startswith("_")), lambda x: F.substring_index(F.regexp_replace(x, r"^_", ""), " ", 1))
    ends = F.coalesce(F.expr("array_position(transform(l, x -> x = 'loop_' or startswith(x, 'data_')), true)"), F.lit(0))
    body = F.when(ends > 0, F.slice("l", 1, (ends - 1).cast("int"))).otherwise(F.col("l"))
    cut = loop.select("file", labels.alias("labels"), body.alias("l"))
    rows = cut.select("file", "labels", F.posexplode(F.filter("l", lambda x: (x != "") & ~x.startswith("_") & ~x.startswith("#"))).alias("row", "line"))
    return rows.select("file", "row", F.map_from_arrays("labels", F.slice(F.split("line", r"\s+"), F.lit(1), F.size("labels"))).alias("values"))


def star_loop(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, row, values map<string, string> of the first loop of each STAR file, by label without the underscore."""
    return _loops(_whole(spark, path))


def picks(spark: SparkSession, path: str | list[str], pattern: str, indices: list[int] | None = None) -> DataFrame:
    """Particles of STAR files: layout columns, cleft (the file's index), particle_idx, x, y, z in nm, extras.

    Only files whose name fits the pattern, and with indices only those with
    these numbers, are read: the filter is on the file's name, which Spark
    applies to the list of files.
    """
    index = file_index(F.col("_metadata.file_name"), pattern)
    files = spark.read.text(path, wholetext=True).filter(index.isNotNull())
    if indices is not None:
        files = files.filter(index.isin(indices))
    whole = files.select("value", F.col("_metadata.file_path").alias("file"))
    loop = _loops(whole).withColumn("cleft", file_index(F.element_at(F.split("file", "/"), -1), pattern))
    xyz = [finite(F.try_element_at("values", F.lit(f"faCoordinate{k.upper()}")).try_cast("double")).alias(k) for k in "xyz"]
    extras = F.map_filter("values", lambda k, v: ~k.isin("faCoordinateX", "faCoordinateY", "faCoordinateZ")).alias("extras")
    return with_layout(loop.select("file", "cleft", F.col("row").alias("particle_idx"), *xyz, extras))


def two_kinds(monomers: DataFrame | None, dimers: DataFrame | None) -> DataFrame:
    """Picks of both kinds with aunp_kind and a running aunp_index within their file group, monomers first; either may be missing."""
    from pyspark.sql import Window

    parts = [df.withColumn("aunp_kind", F.lit(k)) for k, df in (("monomer", monomers), ("dimer", dimers)) if df is not None]
    if not parts:
        raise ValueError("neither kind has a file")
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    w = Window.partitionBy("tomogram_name", "alignment_dir", "cleft").orderBy(F.desc("aunp_kind"), "particle_idx")
    return both.withColumn("aunp_index", F.row_number().over(w) - 1)


def xyz(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, segment (number in the file name), point_idx, x, y, z of clouds with blank-separated numbers; other lines are left out."""
    parts = _lines(spark, path).withColumn("p", F.split(F.trim("line"), r"[\s,]+"))
    v = [F.try_element_at("p", F.lit(i + 1)).try_cast("double").alias(k) for i, k in enumerate("xyz")]
    n = F.regexp_extract(F.element_at(F.split("file", "/"), -1), r"(\d+)\D*$", 1)
    return parts.select("file", F.when(n != "", n.cast("int")).alias("segment"), F.col("line_no").alias("point_idx"), *v).filter("x is not null and y is not null and z is not null")


def cleft_surfaces(spark: SparkSession, path: str | list[str], facings: tuple[str, ...] = ("outer", "inner")) -> DataFrame:
    """zone, side (pre or post), facing (outer or inner), id, x, y, z of the clouds <zone>_<side>_<facing>.txt, with layout columns.

    A zone needs both outer clouds; inner ones are optional. facings picks the
    clouds that come back: both give the whole patch.
    """
    name = F.regexp_extract(F.element_at(F.split("file", "/"), -1), r"^(.*)_(pre|post)_(outer|inner)\.txt$", 1)
    part = lambda i: F.regexp_extract(F.element_at(F.split("file", "/"), -1), r"^(.*)_(pre|post)_(outer|inner)\.txt$", i)
    rows = xyz(spark, path).withColumn("zone", name).withColumn("side", part(2)).withColumn("facing", part(3)).filter("side <> ''")
    rows = with_layout(rows).drop("segment").withColumnRenamed("point_idx", "id")
    on = ["set_name", "tomogram_name", "alignment_dir", "zone"]
    whole = rows.filter("facing = 'outer'").groupBy(*on).agg(F.count_distinct("side").alias("_n")).filter("_n = 2").select(*on)
    return rows.filter(F.col("facing").isin(list(facings))).join(whole, on, "left_semi").select(*on, "side", "facing", "id", "x", "y", "z")


def optional_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header, or an empty one if nothing is there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(conf).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).csv(path)


def cached_table(spark: SparkSession, path: str, tag: int, compute) -> DataFrame:
    """The table at path/tag=<tag>, made by compute() if it is not there whole; tags are whole numbers, so that none is nearly another."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/tag={tag}/_SUCCESS")
    if not done.getFileSystem(conf).exists(done):
        compute().write.mode("overwrite").parquet(f"{path}/tag={tag}")
    return spark.read.parquet(f"{path}/tag={tag}")


def pdb_atoms(spark: SparkSession, path: str) -> DataFrame:
    """file, atom, x, y, z of ATOM and HETATM lines, by fixed columns."""
    lines = _lines(spark, path).filter(F.col("line").rlike("^(ATOM|HETATM)"))
    v = [F.trim(F.substring("line", at, 8)).try_cast("double").alias(k) for k, at in (("x", 31), ("y", 39), ("z", 47))]
    return lines.select("file", F.col("line_no").alias("atom"), *v).filter("x is not null and y is not null and z is not null")


def results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result documents with a declared schema; NaN is read as NULL where a column is a number, a broken document is a NULL row."""
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("allowNonNumericNumbers", True).json(path)
    return df.select(*[finite(c).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def missing_files(expected: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    """Expected rows without a file."""
    return expected.join(present, on, "left_anti")


def longest_base(names: DataFrame, bases: DataFrame) -> DataFrame:
    """name, base: the longest base that starts each name, so that a base does not take what a longer one owns.

    Prefixes of every name up to its length meet the bases in an equi-join.
    """
    from pyspark.sql import Window

    prefix = names.select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("n")).select("name", F.expr("substring(name, 1, n)").alias("base"))
    w = Window.partitionBy("name").orderBy(F.length("base").desc())
    return prefix.join(bases.select("base").distinct(), "base").withColumn("_k", F.row_number().over(w)).filter("_k = 1").select("name", "base")
