"""Readers of landed files: GeoJSON, paged service answers, transit tables, returns with preambles."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from fieldloom.functions import geo


def json_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file or folder under an explicit schema; a missing path gives an empty table of that schema."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def features(spark: SparkSession, path: str, properties: str, geometry: str = "string") -> DataFrame:
    """A FeatureCollection's properties as columns, with kind and coordinates (as JSON text, see `ring_of`, `line_of`, `point_of`)."""
    schema = f"type string, features array<struct<type:string, geometry:struct<type:string, coordinates:{geometry}>, properties:struct<{properties}>>>"
    f = json_table(spark, path, schema).select(F.explode("features").alias("f"))
    return f.select("f.properties.*", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))


def _points(c):
    return F.transform(c, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def point_of(c):
    p = F.from_json(c, "array<double>")
    return F.struct(p[0].alias("x"), p[1].alias("y"))


def line_of(c):
    return _points(F.from_json(c, "array<array<double>>"))


def ring_of(c):
    """The outer ring of a polygon."""
    return _points(F.get(F.from_json(c, "array<array<array<double>>>"), F.lit(0)))


def rings_of(kind, c):
    """The outer rings of a polygon or multi-polygon."""
    many = F.transform(F.from_json(c, "array<array<array<array<double>>>>"), lambda p: _points(F.get(p, F.lit(0))))
    return F.when(kind == "MultiPolygon", many).when(kind == "Polygon", F.array(ring_of(c)))


def csv_after(spark: SparkSession, path: str, starts: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """A CSV below a preamble: in each file the header is the first line that starts with `starts`, and all lines behind it are rows. All columns are strings.

    A record is one line; empty fields are null and rows with any of them stay. Lines
    are told by the place of their split and their place in it, so files are read in parallel.
    Names come from any of the headers; files without one give no rows.
    """
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    # The CSV reader with a separator no line has, as the text reader knows no encodings.
    lines = spark.read.schema("value string").options(encoding=encoding, sep="\u0001", quote="", escape="").csv(path).select("value", F.col("_metadata.file_path").alias("file"), at.alias("at"))
    heads = lines.where(F.col("value").startswith(starts)).groupBy("file").agg(F.min("at").alias("head"), F.min_by("value", "at").alias("names"))
    first = heads.limit(1).collect()
    if not first:
        return spark.createDataFrame([], "value string").select()
    schema = ", ".join(f"`{n.strip()}` string" for n in first[0].names.split(","))
    # A row for each file.
    body = lines.join(F.broadcast(heads), "file").where((F.col("at") > F.col("head")) & (F.trim("value") != ""))
    return body.select(F.from_csv("value", schema).alias("r")).select("r.*")


def paged_features(spark: SparkSession, pattern: str, fields: str) -> DataFrame:
    """Features of a paged service's landed answers, points or polygons, in its own form or as GeoJSON; pages are read in parallel.

    pattern holds {offset}, where the pages' offsets stand. Pages count up to the first, by
    offset, that is empty or doesn't say that there are more. An answer with an error
    raises it. Columns: `fields`, x and y (points), rings (polygons, outer and inner, in the service's order), page.
    """
    prefix, suffix = pattern.split("{offset}")
    ring = "array<array<array<double>>>"
    geometry = f"struct<x:double, y:double, rings:{ring}, type:string, coordinates:string>"
    more = "exceededTransferLimit:boolean"
    schema = f"error string, {more.replace(':', ' ')}, properties struct<{more}>, features array<struct<attributes:struct<{fields.replace(' ', ':')}>, properties:struct<{fields.replace(' ', ':')}>, geometry:{geometry}>>"
    import re

    name = re.escape(prefix.rsplit("/", 1)[-1]) + r"(\d+)" + re.escape(suffix) + "$"
    raw = spark.read.option("wholetext", True).text(f"{prefix}*{suffix}").select(F.regexp_extract("_metadata.file_path", name, 1).cast("long").alias("page"), F.from_json("value", schema).alias("a"))
    a = raw.select("page", F.when(F.col("a.error").isNotNull(), F.raise_error(F.col("a.error"))).otherwise(F.col("a")).alias("a"))
    on = F.coalesce("a.exceededTransferLimit", "a.properties.exceededTransferLimit", F.lit(False))
    last = a.where((F.coalesce(F.size("a.features"), F.lit(0)) < 1) | ~on).agg(F.min("page").alias("last"))
    f = a.join(F.broadcast(last), F.col("last").isNull() | (F.col("page") <= F.col("last"))).select("page", F.explode("a.features").alias("f"))  # `last` is one row
    g = F.col("f.geometry")
    point = F.from_json(F.when(g["type"] == "Point", g["coordinates"]), "array<double>")
    whole = F.coalesce(g["rings"], F.from_json(F.when(g["type"] == "Polygon", g["coordinates"]), ring), F.flatten(F.from_json(F.when(g["type"] == "MultiPolygon", g["coordinates"]), f"array<{ring}>")))
    rows = f.select(F.coalesce("f.attributes", "f.properties").alias("p"), F.coalesce(g["x"], F.get(point, F.lit(0))).alias("x"), F.coalesce(g["y"], F.get(point, F.lit(1))).alias("y"), F.transform(whole, _points).alias("rings"), "page")
    return rows.select("p.*", "x", "y", "rings", "page")


def xlsx_table(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """A workbook's sheet as strings; its first row names the columns. Workbooks are small (a million rows by their form) and read on the driver."""
    import re
    import zipfile
    from xml.etree import ElementTree

    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{main}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{main}si")]
        rows = []
        for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml")).iter(f"{main}row"):
            cells = {}
            for c in row.iter(f"{main}c"):
                col = 0
                for ch in re.match(r"[A-Z]+", c.get("r")).group():
                    col = col * 26 + ord(ch) - 64
                v = c.find(f"{main}v")
                text = "".join(t.text or "" for t in c.iter(f"{main}t")) if c.get("t") == "inlineStr" else v.text if v is not None else None
                cells[col - 1] = shared[int(text)] if c.get("t") == "s" and text is not None else text
            rows.append(cells)
    if not rows:
        return spark.createDataFrame([], "value string").select()
    names = [rows[0].get(k) or f"column{k + 1}" for k in range(max(rows[0], default=-1) + 1)]
    return spark.createDataFrame([tuple(r.get(k) for k in range(len(names))) for r in rows[1:]], ", ".join(f"`{n}` string" for n in names))


def cut_to_box(nodes: DataFrame, ways: DataFrame, box: tuple[float, float, float, float]) -> tuple[DataFrame, DataFrame]:
    """(nodes in the box, ways with any node in it). nodes: (node, x, y); ways: (way_id, refs, ...)."""
    inside = nodes.where(geo.in_box(F.col("x"), F.col("y"), box))
    hit = ways.select("way_id", F.explode("refs").alias("node")).join(inside.select("node"), "node", "left_semi").select("way_id").distinct()
    return inside, ways.join(hit, "way_id", "left_semi")


def since(df: DataFrame, column: str, today: str, years: int) -> DataFrame:
    """Rows whose date (ISO text or a date) is at most so many years of 365 days before `today`; compared with a constant, so scans are pruned."""
    from datetime import date, timedelta

    day = (date.fromisoformat(today) - timedelta(days=365 * years)).isoformat()
    return df.where(F.col(column) >= F.lit(day).cast(dict(df.dtypes)[column]))


def by_shape(df: DataFrame, kind: str = "kind", level: str = "level") -> tuple[DataFrame, DataFrame]:
    """(points, all other shapes) of the rows that have a level."""
    some = df.where(F.col(level).isNotNull() & F.col(kind).isNotNull())
    return some.where(F.col(kind) == "Point"), some.where(F.col(kind) != "Point")


def transit(spark: SparkSession, folder: str, name: str, columns: list[str], types: dict[str, str] | None = None) -> DataFrame:
    """Columns of a transit feed's table, strings but for those with a type; what isn't of its type, and columns the file lacks, are null."""
    t = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(f"{folder}/{name}.txt")
    kind = lambda c: (types or {}).get(c, "string")
    return t.select(*((F.trim(c).try_cast(kind(c)) if kind(c) != "string" else F.col(c)).alias(c) if c in t.columns else F.lit(None).cast(kind(c)).alias(c) for c in columns))


def tagged(df: DataFrame, wanted: dict[str, list[str] | None], tags: str = "tags", kinds: list[str] | None = None) -> DataFrame:
    """Rows whose tag map has any wanted key (None) or key with one of its values, of the given geometry kinds, if any; null kinds of elements are nodes."""
    ok = F.lit(False)
    for k, vs in wanted.items():
        v = F.try_element_at(F.col(tags), F.lit(k))
        ok = ok | (v.isNotNull() if vs is None else F.coalesce(v.isin(vs), F.lit(False)))
    out = df.where(ok if kinds is None else ok & F.col("kind").isin(kinds))
    return out.withColumn("osm_type", F.coalesce("osm_type", F.lit("node"))) if "osm_type" in df.columns else out


def named_places(df: DataFrame, kinds: list[str], box: tuple[float, float, float, float], pad_m: float = 2000.0) -> DataFrame:
    """(name, place, x, y): points tagged as one of the kinds of place, with a name, in a box grown by so many metres."""
    tag = lambda k: F.try_element_at(F.col("tags"), F.lit(k))
    p = tagged(df, {"place": kinds}).select(tag("name").alias("name"), tag("place").alias("place"), "x", "y")
    return p.where(F.col("name").isNotNull() & geo.in_box(F.col("x"), F.col("y"), geo.padded_box(*box, pad_m)))


def layers(df: DataFrame, wanted: dict[str, dict[str, list[str] | None]]) -> dict[str, DataFrame]:
    """Named layers of one table, each by its tags."""
    return {name: tagged(df, w) for name, w in wanted.items()}


def tiles(spark: SparkSession, box: tuple[float, float, float, float], size: float) -> DataFrame:
    """(w, s, e, n) of the tiles that cover a box."""
    w, s, e, n = box
    nx, ny = max(1, -int(-(e - w) // size)), max(1, -int(-(n - s) // size))
    t = spark.range(nx * ny).select((F.lit(w) + (F.col("id") % nx) * size).alias("w"), (F.lit(s) + F.floor(F.col("id") / nx) * size).alias("s"))
    return t.select("w", "s", F.least(F.col("w") + size, F.lit(float(e))).alias("e"), F.least(F.col("s") + size, F.lit(float(n))).alias("n"))


class Page(InputPartition):
    def __init__(self, path: str):
        self.path = path


class PagedAnswers(DataSource):
    """Landed answers of a paged feature service: a partition for each page, read until one says it is the last.

    Option: path, a pattern with {offset}; all pages there are, whatever their number.
    An answer with an error ends the read with that error. `spark.read.format
    ("paged").schema(...)`: attributes by name, and _x, _y of point geometries. For files on a
    shared file system, polygons and last-page flags see `paged_features`.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "attributes string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(schema, dict(self.options))


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.fields, self.options = schema.fieldNames(), options

    def partitions(self):
        import glob
        import re

        prefix, suffix = self.options["path"].split("{offset}")
        offset = re.compile(re.escape(prefix) + r"(\d+)" + re.escape(suffix) + "$")
        found = [(int(m.group(1)), p) for p in glob.glob(f"{glob.escape(prefix)}*{glob.escape(suffix)}") if (m := offset.match(p))]
        return [Page(p) for _, p in sorted(found)] or [Page("")]

    def read(self, partition: Page) -> Iterator[tuple]:
        if not partition.path:
            return
        with open(partition.path, encoding="utf-8") as f:
            answer = json.load(f)
        if "error" in answer:
            raise RuntimeError(str(answer["error"]))
        for x in answer.get("features", []):
            row = {**x.get("attributes", {}), **{f"_{k}": v for k, v in (x.get("geometry") or {}).items() if k in ("x", "y")}}
            yield tuple(json.dumps(row) if n == "attributes" else row.get(n) for n in self.fields)


def located(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rows with x and y from the first pair of columns that has neither null nor 0."""
    x = F.coalesce(*(F.when((F.col(a) != 0) & (F.col(b) != 0), F.col(a)) for a, b in pairs))
    y = F.coalesce(*(F.when((F.col(a) != 0) & (F.col(b) != 0), F.col(b)) for a, b in pairs))
    return df.withColumns({"x": x, "y": y}).where("x IS NOT NULL AND y IS NOT NULL")


def smallest_cover(boxes: dict[str, tuple[float, float, float, float]], want: tuple[float, float, float, float]) -> str | None:
    """The name of the smallest box that holds the wanted one."""
    w, s, e, n = want
    fit = [((b[2] - b[0]) * (b[3] - b[1]), k) for k, b in boxes.items() if b[0] <= w and b[1] <= s and b[2] >= e and b[3] >= n]
    return min(fit)[1] if fit else None


__all__ = ["PagedAnswers", "by_shape", "csv_after", "cut_to_box", "features", "paged_features", "since", "xlsx_table", "geo", "json_table", "layers", "line_of", "named_places", "located", "point_of", "ring_of", "rings_of", "smallest_cover", "tagged", "tiles", "transit"]
