"""A source tree as a table of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions of the languages and folders that are never scanned.
LANGUAGES = {"py": "python", "go": "go", "java": "java", "ts": "ts", "tsx": "ts", "js": "ts", "jsx": "ts", "rs": "rust", "kt": "kotlin", "swift": "swift", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp"}
EXCLUDED = ("node_modules", "vendor", "third_party", "Pods", "Carthage", "build", "dist", "target", "__pycache__", "venv", ".venv", "DerivedData")


def language(path):
    """Language by extension; null for other files."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(*(F.when(ext == k, F.lit(v)) for k, v in LANGUAGES.items()))


def is_test(path):
    return path.rlike(r"(^|/)(tests?|spec|__tests__|testdata)/|(^|/)test_[^/]*\.py$|_test\.(go|py|rs)$|\.(spec|test)\.[jt]sx?$|Tests?\.(java|kt|swift)$")


def is_generated(path, text):
    return path.rlike(r"\.pb\.go$|_pb2\.py$|\.g\.(ts|dart)$|\.min\.js$|_generated\.") | text.rlike(r"(?i)(//|#|/\*)\s*code generated .* do not edit|@generated")


def read_tree(spark: SparkSession, root: str, repo: str = "", excluded: tuple[str, ...] = EXCLUDED, max_bytes: int | None = None) -> DataFrame:
    """Files below a root: (repo, file_path, rel_path, language_id, is_test, is_generated, bytes, modified, content).

    Hidden and excluded folders are left out by path predicates; every file has its
    whole content unless a caller sets ``max_bytes``, above which a file keeps its
    row with null content; empty files give no row.
    """
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    rel = F.regexp_replace("path", "^(file:)?/*" + "/".join(["", *base.strip("/").split("/")]).replace(".", r"\.") + "/", "")
    f = raw.withColumn("rel_path", rel).filter(~F.col("rel_path").rlike(r"(^|/)\.[^/]+/"))
    if excluded:
        f = f.filter(~F.arrays_overlap(F.split("rel_path", "/"), F.array(*map(F.lit, excluded))))
    text = F.decode("content", "UTF-8") if max_bytes is None else F.when(F.col("length") <= max_bytes, F.decode("content", "UTF-8"))
    return f.select(F.lit(repo).alias("repo"), F.col("path").alias("file_path"), "rel_path", language(F.col("rel_path")).alias("language_id"), is_test(F.col("rel_path")).alias("is_test"), is_generated(F.col("rel_path"), F.coalesce(text, F.lit(""))).alias("is_generated"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), text.alias("content"))


def module_roots(files: DataFrame, depth: int = 6) -> DataFrame:
    """Folders that hold a manifest, down to a depth: (repo, root)."""
    marker = r"(^|/)(go\.mod|package\.json|pyproject\.toml|setup\.py|Cargo\.toml|pom\.xml|build\.gradle(\.kts)?|Package\.swift|CMakeLists\.txt)$"
    return files.filter(F.col("rel_path").rlike(marker) & (F.size(F.split("rel_path", "/")) <= depth + 1)).select("repo", F.regexp_replace("rel_path", r"/?[^/]*$", "").alias("root")).distinct()


def nearest_root(files: DataFrame, roots: DataFrame) -> DataFrame:
    """The deepest root above each file, by an equi-join on exploded ancestors: (repo, rel_path, root)."""
    from lodestrata.functions.text import ancestors

    up = files.select("repo", "rel_path", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), ancestors("rel_path")))).alias("root"))
    j = up.join(roots, ["repo", "root"])
    return j.groupBy("repo", "rel_path").agg(F.max_by("root", F.length("root")).alias("root"))
