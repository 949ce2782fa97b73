"""Readers and writers of albums and reports as JSON, CSV, Markdown and Parquet."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTITY = "struct<surface:string,entity_type:string,source:string,confidence:double>"
PHOTO = (
    f"struct<photo_id:string,year_month:string,timestamp:string,caption:string,visible_text:array<string>,text_entities:array<{ENTITY}>,"
    "visible_face_ids:array<string>,metadata:struct<gps_city:string,gps_location:string,device:string>>"
)
ALBUM = f"user_id string, photos array<{PHOTO}>, _bad string"


def read_albums(spark: SparkSession, pattern: str, users: list[str] | None = None, strict: bool = True) -> DataFrame:
    """Photos of album documents, one JSON file per album: user_id, ord (place in the album), then the photo's fields.

    The album's id is that in the document, else the ``user_####`` folder of its path; ``users`` keeps only these albums. A
    file that is no JSON object raises an error, or is left out where ``strict`` is off. Missing fields are null."""
    raw = spark.read.schema(ALBUM).option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(pattern)
    folder = F.regexp_extract(F.input_file_name(), r"(user_[0-9]+)", 1)
    named = raw.withColumn("user_id", F.coalesce("user_id", F.nullif(folder, F.lit(""))))
    if strict:
        named = named.withColumn("photos", F.when(F.col("_bad").isNotNull(), F.raise_error(F.concat(F.lit("no album document: "), F.input_file_name()))).otherwise(F.col("photos")))
    else:
        named = named.where("_bad is null")
    if users is not None:
        named = named.where(F.col("user_id").isin(users))
    return named.select("user_id", F.posexplode("photos").alias("ord", "p")).select("user_id", "ord", "p.*")


def write_albums(photos: DataFrame, path: str) -> None:
    """One JSON line per album with its photos in order of time and id, in folders by user."""
    fields = [c for c in photos.columns if c != "user_id"]
    first = [c for c in ("timestamp", "photo_id") if c in fields]
    grouped = photos.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct(*first, *[c for c in fields if c not in first]))).alias("photos"))
    grouped.withColumn("folder", F.col("user_id")).write.mode("overwrite").partitionBy("folder").json(path)


def read_optional(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A JSON-lines table that may not exist: then it is empty."""
    reader = spark.read.schema(schema)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    exists = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    if exists is None or len(exists) == 0:
        return spark.createDataFrame([], schema)
    return reader.json(path)


def first_of(tables: list[DataFrame], key: str) -> DataFrame:
    """Per key, the row of the first table that has it."""
    ranked = [t.withColumn("__priority", F.lit(i)) for i, t in enumerate(tables)]
    every = ranked[0]
    for t in ranked[1:]:
        every = every.unionByName(t, allowMissingColumns=True)
    whole = F.struct(*[c for c in every.columns])
    best = every.groupBy(key).agg(F.min_by(whole, "__priority").alias("r"))
    return best.select("r.*").drop("__priority")


def write_csv(tables: list[DataFrame], path: str) -> None:
    """One CSV with a header that is the sorted union of all columns."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    out.select(*sorted(out.columns)).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def markdown(df: DataFrame, most: int = 10_000) -> str:
    """A small report as a Markdown table; more than ``most`` rows raise an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows])


def write_profiles(df: DataFrame, path: str) -> None:
    """Parquet, a folder per user."""
    df.repartition("user_id").write.mode("overwrite").partitionBy("user_id").parquet(path)


def checksums(spark: SparkSession, pattern: str, wanted: DataFrame | None = None) -> DataFrame:
    """(file, length, sha256[, ok]) of files; with ``wanted`` (file, sha256), also whether each is there and unchanged."""
    got = spark.read.format("binaryFile").load(pattern).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha2("content", 256).alias("sha256"))
    if wanted is None:
        return got
    w = wanted.select("file", F.col("sha256").alias("expected"))
    return w.join(got, "file", "left").withColumn("ok", F.coalesce(F.col("sha256") == F.col("expected"), F.lit(False)))


def read_texts(spark: SparkSession, pattern: str) -> DataFrame:
    """(file, text): whole text files."""
    return spark.read.option("wholetext", True).text(pattern).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("text"))


def table_paths(root: str) -> dict[str, str]:
    """Parquet tables of a folder by name."""
    return {f[: -len(".parquet")]: os.path.join(root, f) for f in sorted(os.listdir(root)) if f.endswith(".parquet")}


def read_reports(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """(user_id, fields of schema): one JSON report per user, found by a glob; the user is the ``user_####`` folder of its path."""
    folder = F.regexp_extract(F.input_file_name(), r"(user_[0-9]+)", 1)
    rows = spark.read.schema(schema).option("multiLine", True).json(pattern)
    return rows.select(folder.alias("user_id"), *[c for c in rows.columns if c != "user_id"])


def write_csv_as_first(tables: list[DataFrame], path: str) -> None:
    """One CSV whose header is that of the first table; columns only others have are left out, missing ones are empty."""
    columns = tables[0].columns
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t.select(*[c for c in columns if c in t.columns]), allowMissingColumns=True)
    out.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def expanded(value, environment: dict[str, str] | None = None):
    """``${NAME}`` and ``${NAME:default}`` in the texts of a configuration replaced by the environment; unset names without a
    default are empty."""
    env = os.environ if environment is None else environment
    if isinstance(value, dict):
        return {k: expanded(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [expanded(v, env) for v in value]
    if isinstance(value, str):
        return re.sub(r"\$\{([A-Za-z_][A-Za-z0-9_]*)(?::([^}]*))?\}", lambda m: env.get(m.group(1), m.group(2) or ""), value)
    return value


def read_config(path: str, defaults: dict, environment: dict[str, str] | None = None) -> dict:
    """A JSON configuration over its defaults: keys without a default are dropped, values take the default's type; a missing file
    gives the defaults."""
    found = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            found = expanded(json.load(f), environment)
    if not isinstance(found, dict):
        raise ValueError(f"no configuration object: {path}")

    def typed(value, default):
        if value is None or default is None:
            return default if value is None else value
        if isinstance(default, bool):
            return value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes", "on")
        return type(default)(value)

    return {k: typed(found.get(k), d) for k, d in defaults.items()}


def text_list(c: Column) -> Column:
    """A list of texts from a text that is a JSON array, or else one value; blank values and null give an empty list."""
    array = F.from_json(c, "array<string>", {"allowSingleQuotes": "false"})
    many = F.when(c.rlike(r"^\s*\["), array)
    one = F.when(F.trim(c) != "", F.array(c))
    return F.filter(F.coalesce(many, one, F.array().cast("array<string>")), lambda x: F.trim(x) != "")
