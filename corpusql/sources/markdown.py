"""Markdown collections: documents with front matter, read from folders, and the catalogue rebuilt from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.operators.search import front_field

# Languages of file endings.
LANGUAGES = {"py": "python", "f90": "fortran", "for": "fortran", "c": "c", "h": "c", "cpp": "cpp", "jl": "julia", "r": "r", "js": "javascript", "ts": "typescript", "go": "go", "rs": "rust", "java": "java", "m": "matlab", "sh": "shell"}


def read_markdown(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """path (below the root), file_name, front, body, raw of every matching file, one row a file."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_name").alias("file_name"))
    base = root.removeprefix("file://").rstrip("/") + "/"
    path = F.substring_index(F.url_decode("uri"), base, -1)
    front = r"(?s)^---\s*\n(.*?)\n---\s*\n?"
    return files.select(path.alias("path"), "file_name", F.regexp_extract("raw", front, 1).alias("front"), F.regexp_replace("raw", front, "").alias("body"), "raw")


def rebuild_catalogue(markdown: DataFrame) -> DataFrame:
    """id, type, path, title, topic, doi, added, files: an entry for each file whose front matter names a type.

    Hidden files and ``catalog.md`` are left out. Without an id it is ``type-name`` or ``type-folder``; a title is taken
    from the file's name if need be; ``files`` are all files of the same folder.
    """
    shown = markdown.filter(~F.col("path").rlike(r"(^|/)\.") & (F.col("file_name") != "catalog.md"))
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    field = lambda c: front_field(F.col("raw"), c)
    unquoted = lambda c: F.regexp_replace(field(c), "^[\"']|[\"']$", "")
    stem = F.initcap(F.regexp_replace(F.regexp_replace("file_name", r"\.[^.]*$", ""), "[-_]", " "))
    with_folder = shown.withColumn("folder", folder)
    siblings = with_folder.groupBy("folder").agg(F.array_sort(F.collect_list("path")).alias("files"))
    entries = with_folder.filter(field("type") != "").join(siblings, "folder", "left")
    name = F.coalesce(F.nullif(unquoted("name"), F.lit("")), F.regexp_extract("folder", r"([^/]*)$", 1))
    return entries.select(
        F.coalesce(F.nullif(unquoted("id"), F.lit("")), F.concat_ws("-", unquoted("type"), name)).alias("id"), unquoted("type").alias("type"), "path",
        F.coalesce(F.nullif(unquoted("title"), F.lit("")), stem).alias("title"), unquoted("topic").alias("topic"), unquoted("doi").alias("doi"), unquoted("added").alias("added"), "files",
    )


def read_code(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """path, language, text of source files; files and folders that an ignore pattern (``*.pyc``, ``build/``) names are left out."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.col("value").alias("text"), F.url_decode("_metadata.file_path").alias("uri"))
    base = root.removeprefix("file://").rstrip("/") + "/"
    code = files.select(F.substring_index("uri", base, -1).alias("path"), "text").withColumn("ending", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    for glob in ignore or []:
        inner = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if c in ".+()[]{}^$|\\" else c for c in glob.strip("/"))
        code = code.filter(~F.col("path").rlike(f"(^|/){inner}/" if glob.endswith("/") else f"(^|/){inner}($|/)"))
    language = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))[F.col("ending")]
    return code.select("path", language.alias("language"), "text").filter("language IS NOT NULL")
