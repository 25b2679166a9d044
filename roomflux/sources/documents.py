"""JSON documents as tables: files, versions, and documents within other text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_documents(df: DataFrame, path: str) -> None:
    """One JSON document a row, in files below ``path``, which must not exist; nulls are written too, so that every row has every field."""
    df.write.option("ignoreNullFields", "false").json(path)


def read_documents(spark: SparkSession, path: str, schema: str, whole: bool = False) -> DataFrame:
    """Documents below ``path``: one a line or, if ``whole``, one array or document a file. Fields that are absent are null; broken documents fail."""
    return spark.read.schema(schema).option("multiLine", whole).option("mode", "FAILFAST").json(path)


def read_current(spark: SparkSession, paths: list[str], schema: str, required: list[str], whole: bool = False) -> DataFrame:
    """The documents of the first of ``paths`` (a kept copy, then its sources) whose format has the ``required`` fields.

    Only the format is looked at here; rows are read when the frame is. If every copy is of an old format, that is an error.
    """
    for path in paths:
        found = spark.read.option("multiLine", whole).json(path).schema.names
        if set(required) <= set(found):
            return read_documents(spark, path, schema, whole)
    raise ValueError(f"no document of {paths} has the fields {required}")


def listing(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """``name``, ``bytes`` of the files right below ``path`` whose names start with ``prefix``, by name; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", prefix + "*").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes")).orderBy("name")


def embedded(text: Column, name: str, schema: str) -> Column:
    """The JSON document that a script within ``text`` assigns to the constant ``name``, up to the next ``;`` that ends a line or the script; null if there is none."""
    found = F.regexp_extract(text, r"(?s)\bconst\s+" + name + r"\s*=\s*(\{.*?\})\s*;\s*(?:\n|</script>|$)", 1)
    return F.when(found != "", F.from_json(found, schema))


def cards(html: Column) -> Column:
    """Array of the register cards of a page: name, capacity, url, slug and titles, in markup as it stands."""
    card = F.lit(r'(?s)<h2[^>]*>(.*?)</h2>\s*<h3[^>]*>Férőhelyek:\s*([0-9][0-9\s]*)fő</h3>(.*?)href="([^"]*/terem/([^"/]+))"')
    parts = {"name": 1, "capacity": 2, "between": 3, "url": 4, "slug": 5}
    return F.arrays_zip(*(F.regexp_extract_all(html, card, F.lit(k)).alias(n) for n, k in parts.items()))
