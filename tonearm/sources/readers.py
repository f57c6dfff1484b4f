"""Sources: file listings, want-lists, indexes, routing maps, logs and staged responses. Schemas are stated, never inferred."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as X
from ..operators.dedup import last_wins

AUDIO = (*C.LOSSLESS_EXT, *C.LOSSY_EXT)
WANTS = "Artist string, Title string, Album string, Length string, Year string, Source string, SourceUrl string"
INDEX = "filepath string, artist string, title string, length string, state string, failurereason string"
REPLACE = "Priorite string, Tier string, Dossier string, Artiste string, Titre string, Fichier string"


def audio_files(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), content: bool = False, recursive: bool = True) -> DataFrame:
    """Path, name, ext, length, modificationTime (and content) of audio files below root.

    A file is left out if a folder below root on its path is named in exclude, whatever the case. Without content the
    files aren't opened. Spark lists no files or folders whose names begin with _ or a dot; such a folder has to be given
    as a root of its own.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    out = files.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("ext"), "length", "modificationTime", *(["content"] if content else []))
    out = out.where(F.col("ext").isin(*AUDIO))
    if exclude:
        folders = F.split(F.lower(F.regexp_replace("path", r"^.*?" + re.escape(root.split(":")[-1].rstrip("/")), "")), "/")
        out = out.where(~F.exists(F.slice(folders, F.lit(1), F.size(folders) - 1), lambda p: p.isin(*(e.lower() for e in exclude))))
    return out


def library_keys(files: DataFrame, path: str = "path") -> DataFrame:
    """The distinct keys of a library's names."""
    p = X.parse_name(F.col(path))
    n = X.normalize(p["artist"], p["title"])
    return files.where(p["parseable"]).select(X.match_key(n["artist"], n["title"]).alias("key")).distinct()


def csv(spark: SparkSession, path: str, schema: str, sep: str = ",", places: bool = False) -> DataFrame:
    """places: with _file and _line, which order the rows. Such files aren't split, so within one the numbers rise with its lines, however files are dealt."""
    out = spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', sep=sep, enforceSchema=False)
    return out.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_line")) if places else out


def want_list(spark: SparkSession, path: str) -> DataFrame:
    """A want-list; Length as whole seconds or null."""
    return csv(spark, path, WANTS).withColumn("Length", to_int(F.col("Length")))


def report_or_wants(spark: SparkSession, path: str) -> DataFrame:
    """Artist, title of a report's NOT_FOUND rows if there is a column action, else of all rows."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    by_name = {c.lower(): c for c in df.columns}
    if "action" in by_name:
        df = df.where(F.col(by_name["action"]) == "NOT_FOUND")
    return df.select(*(X.text(F.col(by_name[c])).alias(c) for c in ("artist", "title"))).where("title <> ''")


def to_int(c: Column) -> Column:
    """Text as a number, cut to a whole one; anything else, and what an int can't hold, is null."""
    return c.try_cast("double").try_cast("int")


def download_index(spark: SparkSession, path: str, places: bool = False) -> DataFrame:
    """S10; places as in csv()."""
    return csv(spark, path, INDEX, places=places).withColumn("length", to_int(F.col("length")))


def merged_indexes(indexes: list[DataFrame], order: tuple[str, ...] = ("_file", "_line")) -> DataFrame:
    """Rows of all indexes by file path, later tables and later rows (by the order columns, which go) win, rows without a path go."""
    parts = [d.withColumn("_table", F.lit(i)) for i, d in enumerate(indexes)]
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    df = df.where(X.text(F.col("filepath")) != "")
    return last_wins(df, [F.col("filepath")], ["_table", *order]).drop("_table", *order)


def to_replace(spark: SparkSession, path: str, only_tier: int = 0) -> DataFrame:
    """The semicolon list with French headers, by priority, folder and title; only_tier: rows of that priority alone."""
    rows = csv(spark, path, REPLACE, sep=";").withColumn("Priorite", to_int(F.col("Priorite")))
    return (rows.where(F.col("Priorite") == only_tier) if only_tier > 0 else rows).orderBy("Priorite", "Dossier", "Titre")


def routing_map(spark: SparkSession, path: str) -> DataFrame:
    """Key (lower case), dossier, origFile, priorite, tier."""
    docs = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, struct<dossier: string, origFile: string, priorite: string, tier: string>>").alias("m"))
    return docs.select(F.explode("m").alias("key", "v")).select(F.lower("key").alias("key"), "v.*")


def missed_keys(lines: DataFrame) -> DataFrame:
    """The distinct keys in log lines (column value) about tracks that weren't found."""
    key = F.regexp_extract("value", r"(?:Not found:|All downloads failed:)\s*(.+?)\s*$", 1)
    return lines.select(F.lower(key).alias("key")).where("key <> ''").distinct()


def fake_count(lines: DataFrame) -> DataFrame:
    """The number after Fake/Suspicious: in a report's lines."""
    return lines.select(F.regexp_extract("value", r"Fake/Suspicious:\s*(\d+)", 1).alias("n")).where("n <> ''").agg(F.sum(F.col("n").cast("long")).alias("fakes"))


def newest(files: DataFrame) -> DataFrame:
    """The file modified last."""
    return files.orderBy(F.desc("modificationTime"), "path").limit(1)
