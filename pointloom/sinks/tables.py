"""Keyed upserts, result documents, status, flattening and text exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import with_unit

KEY = ("tomogram_name", "alignment_dir")


def without_keys(df: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of df whose keys do not occur in gone; nulls in keys are equal to each other."""
    names = {k: f"_gone_{i}" for i, k in enumerate(keys)}
    other = gone.select(*[F.col(k).alias(n) for k, n in names.items()]).distinct()
    same = F.lit(True)
    for k, n in names.items():
        same = same & df[k].eqNullSafe(F.col(n))
    return df.join(other, same, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """old without the keys that new has, and new; columns that one lacks are NULL. Doing it twice changes nothing, also with null keys."""
    for k in keys:
        if k not in old.columns:
            old = old.withColumn(k, F.lit(""))
    return without_keys(old, new, keys).unionByName(new, allowMissingColumns=True)


def store(results: DataFrame, new: DataFrame, overwrite: bool = False, keys: Sequence[str] = (*KEY, "analysis")) -> DataFrame:
    """Result documents with new ones: an existing completed one stays unless overwrite; one that failed is replaced."""
    if overwrite:
        return upsert(results, new, keys)
    return upsert(results, without_keys(new, results.filter(F.col("status") == "completed"), keys), keys)


def completed(results: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """keys, analyses: sorted names of the completed analyses."""
    return results.filter(F.col("status") == "completed").groupBy(*keys).agg(F.sort_array(F.collect_set("analysis")).alias("analyses"))


def status_of(status: Column) -> Column:
    """not_run for NULL, failed for error states, else completed."""
    return F.when(status.isNull(), "not_run").when(F.lower(status).isin("error", "failed"), "failed").otherwise("completed")


def status_table(manifest: DataFrame, results: DataFrame, analyses: Sequence[str], keys: Sequence[str] = KEY) -> DataFrame:
    """analysis, completed, failed, not_run: counts over the manifest."""
    wanted = manifest.select(*keys).withColumn("analysis", F.explode(F.array(*[F.lit(a) for a in analyses])))
    joined = wanted.join(results.select(*keys, "analysis", "status"), [*keys, "analysis"], "left").withColumn("state", status_of(F.col("status")))
    return joined.groupBy("analysis").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("completed", "failed", "not_run")])


def delete(results: DataFrame, manifest: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """results without the manifest's keys; sibling alignments stay."""
    return without_keys(results, manifest, keys)


def zone_export(areas: DataFrame, widths: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Zones that either table has, in order of the keys."""
    return areas.join(widths, list(keys), "full_outer").orderBy(*keys)


def last_write_wins(old: DataFrame, new: DataFrame, keys: Sequence[str], stamp: str = "updated_at") -> DataFrame:
    """Assignments by key: the latest row of old and new."""
    both = old.unionByName(new.withColumn(stamp, F.current_timestamp()) if stamp not in new.columns else new, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(stamp)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}") for c in rest]).orderBy(*keys)


#: Parts of a result document that are left out, and parts whose fields get no prefix.
DROPPED, BARE = ("individual_zone_results",), ("cleft", "cleft_width", "membrane_volumes")


def flattened(df: DataFrame, units: bool = True, dropped: Sequence[str] = DROPPED, bare: Sequence[str] = BARE, listed: int = 5) -> DataFrame:
    """Nested columns as flat ones with names joined by _.

    A list of numbers gives its count and its first values; a list of strings
    its first values as text; other lists go. Numbers get a unit by name,
    booleans do not. Of columns whose names meet, the first stays.
    """
    out: dict[str, Column] = {}

    def name(prefix: str, n: str, number: bool) -> str:
        full = f"{prefix}_{n}" if prefix else n
        return with_unit(full) if units and number else full

    def walk(kind: T.DataType, value: Column, prefix: str, n: str) -> None:
        if n in dropped:
            return
        if isinstance(kind, T.StructType):
            inner = "" if n in bare else (f"{prefix}_{n}" if prefix else n)
            for f in kind.fields:
                if not (n == "cleft_width" and f.name == "total_measurements"):
                    walk(f.dataType, value[f.name], inner, f.name)
        elif isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, T.NumericType):
                out.setdefault(name(prefix, f"{n}_count", False), F.size(value))
                for i in range(listed):
                    out.setdefault(name(prefix, f"{n}_value_{i}", True), F.get(value, F.lit(i)))
            elif isinstance(kind.elementType, T.StringType):
                out.setdefault(name(prefix, n, False), F.concat_ws(", ", F.slice(value, 1, listed)))
        else:
            out.setdefault(name(prefix, n, isinstance(kind, T.NumericType)), value)

    for f in df.schema.fields:
        walk(f.dataType, F.col(f"`{f.name}`"), "", f.name)
    return df.select(*[c.alias(k) for k, c in out.items()])


def export(df: DataFrame, path: str, by: str = "analysis") -> None:
    """One CSV folder for each analysis."""
    df.write.partitionBy(by).option("header", True).mode("overwrite").csv(path)


def write_xyz(df: DataFrame, path: str, form: str = "%.6e") -> None:
    """x y z lines in order of id, readable again as a cloud."""
    df.orderBy("id").select(F.format_string(" ".join([form] * 3), "x", "y", "z").alias("value")).write.mode("overwrite").text(path)


def star_lines(df: DataFrame, columns: Sequence[str], order: str = "id") -> DataFrame:
    """(n, value) lines of a STAR loop: header, labels, rows in order."""
    head = ["", "data_", "", "loop_", *[f"_{c} #{i + 1}" for i, c in enumerate(columns)]]
    spark = df.sparkSession
    lines = spark.createDataFrame([(i - len(head), h) for i, h in enumerate(head)], "n long, value string")
    rows = df.select(F.col(order).cast("long").alias("n"), F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns]).alias("value"))
    return lines.union(rows).orderBy("n")


def write_star(df: DataFrame, path: str, columns: Sequence[str], order: str = "id") -> None:
    star_lines(df, columns, order).select("value").write.mode("overwrite").text(path)


def pdb_lines(df: DataFrame, scale: float = 1.0) -> DataFrame:
    """(n, value) ATOM lines of points (n, x, y, z), scaled to angstrom."""
    line = F.format_string("ATOM  %5d  CA  ALA A%4d    %8.3f%8.3f%8.3f  1.00  0.00           C", (F.col("n") % 100000).cast("int"), (F.col("n") % 10000).cast("int"), *[F.col(k) * scale for k in "xyz"])
    return df.select("n", line.alias("value"))


def sphere_atoms(df: DataFrame, radius: float) -> DataFrame:
    """Eight points on each sphere: the corners of its inscribed cube."""
    h = radius / 3**0.5
    corners = [F.struct(*[(F.col(k) + s * h).alias(k) for k, s in zip("xyz", (a, b, c), strict=True)]) for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)]
    return df.select("id", F.posexplode(F.array(*corners)).alias("corner", "p")).select("id", "corner", "p.x", "p.y", "p.z")
