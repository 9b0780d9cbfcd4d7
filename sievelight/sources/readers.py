"""Readers of query logs, records and model answers, all with fixed schemas."""

from __future__ import annotations

import io
import re
import zipfile
from functools import reduce
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelight.functions import text as tx
from sievelight.sources import xls

LOG = "query_key string, query string, source string, site string, source_file string, device string, clicks long, impressions long, ctr double, position double, found long, lang string, date_start string, date_end string, last_searched string, last_year long"
#: File name patterns of both kinds of logs.
PATTERNS = {"ga4": "*ga4*.csv", "internal": "*search_log*.{csv,xls,xlsx}"}


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """kind and path of the logs in a folder, by their names' patterns."""
    found = None
    for kind, pattern in PATTERNS.items():
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option(
            "recursiveFileLookup", "true"
        ).load(folder).select(
            F.lit(kind).alias("kind"), "path"
        )
        found = files if found is None else found.union(files)
    return found.distinct()


def read_ga4(spark: SparkSession, path: str, source: str = "site1_ga4", site: str = "site1") -> DataFrame:
    """A GA4 export as a log.

    A preamble of comments and blank lines comes first and holds the dates of the report.
    Columns after the query are known by their place, as their names depend on the
    locale: an optional device, then clicks, impressions, rate and position.  Lines with
    another number of columns are skipped, and so are rows without a query.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("source_file"), "value")
    comments = lines.filter(F.col("value").startswith("#")).groupBy("source_file").agg(
        F.concat_ws(" ", F.array_sort(F.collect_list("value"))).alias("head")
    )
    dates = comments.select("source_file", tx.header_dates(F.col("head")).alias("d"))
    data = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    schema = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(7)])
    cells = data.withColumn(
        "c",
        F.from_csv("value", schema.simpleString()[7:-1].replace(":", " ").replace(",", ", "), {"mode": "PERMISSIVE"}),
    )
    cells = cells.withColumn("n", sum((F.col(f"c.c{k}").isNotNull().cast("int") for k in range(7)), F.lit(0)))
    # The header is the line that states no number where the clicks are.
    with_device = tx.number(F.col("c.c1")).isNull()
    at = lambda k: F.when(with_device, F.col(f"c.c{k + 1}")).otherwise(F.col(f"c.c{k}"))
    rows = cells.filter(F.col("n").isin(5, 6) & tx.number(at(1)).isNotNull()).select(
        "source_file",
        tx.clean_query(F.col("c.c0")).alias("query"),
        F.when(with_device, F.col("c.c1")).alias("device"),
        *(tx.number(at(k)).alias(name) for k, name in ((1, "clicks"), (2, "impressions"), (3, "ctr"), (4, "position"))),
    )
    rows = rows.filter("query is not null").join(F.broadcast(dates), "source_file", "left")  # a row a file
    return rows.select(
        tx.normalize_key("query").alias(
            "query_key"
        ), "query", F.lit(source).alias("source"), F.lit(site).alias("site"), "source_file", "device",
        F.coalesce("clicks", F.lit(0)).cast("long").alias("clicks"), F.coalesce(
            "impressions", F.lit(0)
        ).cast("long").alias("impressions"), "ctr", "position",
        F.lit(None).cast("long").alias("found"), F.lit(None).cast("string").alias("lang"), F.col("d.start").alias(
            "date_start"
        ), F.col("d.end").alias("date_end"), F.lit(None).cast("string").alias(
            "last_searched"
        ), F.lit(None).cast("long").alias("last_year"),
    )


def read_internal(spark: SparkSession, path: str, source: str = "site1_internal", site: str = "site1") -> DataFrame:
    """An internal search log (query, lang, clicks, found, last_searched) as a log; rows without a query go."""
    schema = "query string, lang string, clicks string, found string, last_searched_raw string"
    rows = spark.read.schema(schema).option("header", "true").option("mode", "DROPMALFORMED").csv(path).select(
        "*", F.col("_metadata.file_name").alias("source_file")
    )
    return internal_log(rows, source, site)


def internal_log(rows: DataFrame, source: str, site: str) -> DataFrame:
    day = tx.day_month_year(F.col("last_searched_raw"))
    kept = rows.withColumns({"query": tx.clean_query(F.col("query")), "day": day}).filter("query is not null")
    return kept.select(
        tx.normalize_key("query").alias(
            "query_key"
        ), "query", F.lit(source).alias(
            "source"
        ), F.lit(site).alias("site"), "source_file", F.lit(None).cast("string").alias("device"),
        F.coalesce(
            tx.number(F.col("clicks")), F.lit(0)
        ).cast("long").alias("clicks"), F.lit(0).cast("long").alias(
            "impressions"
        ), F.lit(None).cast("double").alias("ctr"), F.lit(None).cast("double").alias("position"),
        tx.number(
            F.col("found")
        ).cast("long").alias("found"), "lang", F.lit(None).cast("string").alias(
            "date_start"
        ), F.lit(None).cast("string").alias("date_end"), F.col("day").cast("string").alias(
            "last_searched"
        ), F.year("day").cast("long").alias("last_year"),
    )


def read_internal_xls(
    spark: SparkSession, path: str, names: dict[str, str], source: str = "site1_internal", site: str = "site1"
) -> DataFrame:
    """An internal log in spreadsheets with localised headers, which ``names`` maps to the log's columns.

    The first sheet of each file is read, in the task that reads the file, and cells as they
    are written, of either kind (.xlsx and the older .xls).
    """
    wanted = ["query", "lang", "clicks", "found", "last_searched_raw"]

    def rows(frames):
        import pandas as pd

        for frame in frames:
            for name, content in zip(frame["source_file"], frame["content"], strict=True):
                content = bytes(content)
                header, *body = (xls.first_sheet if xls.is_compound(content) else sheet_rows)(content) or [[]]
                places = {names.get(title, title): k for k, title in enumerate(header)}
                at = [places.get(c) for c in wanted]
                cells = [[row[k] if k is not None and k < len(row) else None for k in at] for row in body]
                yield pd.DataFrame(cells, columns=wanted, dtype=object).assign(source_file=name)

    files = spark.read.format("binaryFile").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("source_file"), "content"
    )
    schema = ", ".join(f"{c} string" for c in (*wanted, "source_file"))
    return internal_log(files.mapInPandas(rows, schema), source, site)


def sheet_rows(content: bytes) -> list[list[str | None]]:
    """The cells of the first sheet of an .xlsx file, as text; empty ones are null, and so are rows' missing ends."""
    with zipfile.ZipFile(io.BytesIO(content)) as parts:
        tag = lambda node: node.tag.rpartition("}")[2]
        text_of = lambda node: "".join(t.text or "" for t in node.iter() if tag(t) == "t")
        shared = []
        if "xl/sharedStrings.xml" in parts.namelist():
            shared = [text_of(node) for node in ElementTree.fromstring(parts.read("xl/sharedStrings.xml"))]
        sheets = sorted(n for n in parts.namelist() if n.startswith("xl/worksheets/sheet"))
        sheet = ElementTree.fromstring(parts.read(sheets[0]))
    rows = []
    for row in (node for node in sheet.iter() if tag(node) == "row"):
        cells: list[str | None] = []
        for cell in row:
            letters = re.match("[A-Z]*", cell.get("r", "")).group()
            place = reduce(lambda n, c: 26 * n + ord(c) - 64, letters, 0) - 1 if letters else len(cells)
            cells += [None] * (place - len(cells) + 1)
            value = next((node.text for node in cell if tag(node) == "v"), None)
            if cell.get("t") == "s" and value is not None:
                value = shared[int(value)]
            elif cell.get("t") == "inlineStr":
                value = text_of(cell)
            cells[place] = value or None
        rows.append(cells)
    return rows


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """A CSV export of annotations, all columns as text; quoted cells may hold line breaks."""
    return spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)


def packages_titled(packages: DataFrame, part: str, title: str = "title") -> DataFrame:
    """The packages whose title holds ``part``, in any case."""
    return packages.filter(F.contains(F.lower(title), F.lit(part.lower())))


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema; blank lines give no rows."""
    return spark.read.schema(schema).json(path)


def read_employees(spark: SparkSession, path: str) -> DataFrame:
    """firstname and lastname from a JSON document {"data": [...]}."""
    schema = "data array<struct<firstname:string,lastname:string>>"
    return spark.read.schema(schema).option("multiLine", "true").json(path).select(
        F.explode("data").alias("e")
    ).select("e.*")


def read_responses(spark: SparkSession, folder: str, schema: str, keys: list[str], order: str) -> DataFrame:
    """The latest response of each key over the JSON files of a folder."""
    rows = spark.read.schema(schema).option("multiLine", "true").json(f"{folder}/*.json")
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("r")).select(*keys, "r.*")


def json_fields(df: DataFrame, column: str, schema: str, keep: list[str]) -> DataFrame:
    """Fields of a JSON column by a fixed schema; null where a document doesn't have them."""
    return df.select(*keep, F.from_json(column, schema).alias("_j")).select(*keep, "_j.*")
