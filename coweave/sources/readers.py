"""Readers: typed CSV, JSON columns, page caches, GeoJSON, and a catalogue of tables some of which may be missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.papers import first_by

#: Columns that are never numbers, whatever they look like.
TEXT_COLUMNS = ("node_id", "teacher_id", "institution_code", "paper_id")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header; line ends inside quotes; a byte-order mark is dropped; without a schema all columns are strings.
    Only an empty field is null, so a text such as NA survives."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8")
    return reader.csv(path, schema=schema) if schema else reader.csv(path)


def typed(rows: DataFrame, numbers: tuple[str, ...] = (), flags: tuple[str, ...] = ()) -> DataFrame:
    """Strings to numbers (null if they are none) and 'True' or '1' to booleans."""
    out = {c: F.expr(f"try_cast(nullif(`{c}`, '') AS double)") for c in numbers if c not in TEXT_COLUMNS}
    return rows.withColumns(out | {c: F.col(c).isin("True", "true", "1") for c in flags})


def decode_json_columns(rows: DataFrame) -> DataFrame:
    """Every column that ends in _json, as an array of strings named without it; empty where there is nothing."""
    empty = F.array().cast("array<string>")
    found = [c for c in rows.columns if c.endswith("_json")]
    return rows.withColumns({c.removesuffix("_json"): F.coalesce(F.from_json(c, "array<string>"), empty) for c in found}).drop(*found)


def optional(spark: SparkSession, read, schema: str) -> DataFrame:
    """The table, or an empty one of the schema if it is not there."""
    from pyspark.errors import AnalysisException

    try:
        return read()
    except AnalysisException:
        return spark.createDataFrame([], schema)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """url, text of a page cache of JSON files {url, status, text}: fetched pages only, the last file of each url."""
    raw = spark.read.schema("url string, status string, text string").option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    return first_by(raw.filter("status = '200' AND coalesce(text, '') <> ''"), ["url"], F.desc("file")).select("url", "text")


def read_geojson(spark: SparkSession, path: str, name: str) -> DataFrame:
    """ord, name, rings (arrays of x, y) of each polygon of a feature collection."""
    ring = "array<array<double>>"
    schema = "features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>"  # coordinates as text: their depth depends on the type
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("features").alias("ord", "f"))
    one = F.from_json("f.geometry.coordinates", f"array<{ring}>")
    many = F.from_json("f.geometry.coordinates", f"array<array<{ring}>>")
    polygons = F.when(F.col("f.geometry.type") == "MultiPolygon", many).otherwise(F.array(one))
    rows = f.select("ord", F.try_element_at("f.properties", F.lit(name)).alias("name"), F.posexplode(polygons).alias("part", "p"))
    points = F.transform("p", lambda r: F.transform(r, lambda q: F.struct(F.get(q, F.lit(0)).alias("x"), F.get(q, F.lit(1)).alias("y"))))
    return rows.select((F.col("ord") * 1000 + F.col("part")).alias("ord"), "name", points.alias("rings"))


def build_info(spark: SparkSession, path: str) -> dict:
    """The stamp of a build; empty if there is none."""
    rows = optional(spark, lambda: spark.read.option("multiLine", True).json(path), "built string").limit(1).collect()
    return rows[0].asDict(recursive=True) if rows else {}


def read_pdf_text(spark: SparkSession, path: str, pages: int = 1) -> DataFrame:
    """path, text of the first pages of PDF files; empty where a file cannot be read, or pypdf is not installed."""

    @F.pandas_udf("string")
    def text(content):
        import io

        def first(data: bytes) -> str:
            try:
                from pypdf import PdfReader

                return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages[:pages])
            except Exception:  # a broken file is a page without text
                return ""

        return content.map(first)

    return spark.read.format("binaryFile").load(path).select("path", text("content").alias("text"))


def read_cards(pages: DataFrame, opening: str, fields: dict[str, str]) -> DataFrame:
    """A row for each block of a page that begins with ``opening`` and ends at the next or at the end of the body; fields: name and
    pattern, whose first group is the value. pages: url, html."""
    body = F.regexp_replace("html", "(?is)</body.*$", "")
    blocks = F.slice(F.split(body, opening), 2, 1 << 30)
    cards = pages.select("url", F.posexplode(blocks).alias("ord", "card"))
    return cards.select("url", "ord", *[F.trim(F.regexp_replace(F.regexp_extract("card", pattern, 1), "<[^>]+>", "")).alias(name) for name, pattern in fields.items()])


def split_master(master: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Roster members and external authors of one table."""
    return master.filter("node_type = 'roster'"), master.filter("node_type <> 'roster'")


class Catalog:
    """Lazy tables of a folder of CSV files, by name."""

    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, str] | None = None):
        self.spark, self.folder, self.schemas = spark, folder, schemas or {}

    def __getitem__(self, name: str) -> DataFrame:
        read = lambda: read_csv(self.spark, f"{self.folder}/{name}.csv", self.schemas.get(name))
        return optional(self.spark, read, self.schemas[name]) if name in self.schemas else read()
