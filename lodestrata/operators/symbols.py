"""Declarations, imports, unused names, folders: what lines of code declare and use."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Per language the pattern of a declared type and of a function; the name is the last group.
TYPE_PATTERN = {"python": r"^\s*class\s+(\w+)", "go": r"^\s*type\s+(\w+)\s+(?:struct|interface)\b", "java": r"\b(?:class|interface|enum|record)\s+(\w+)", "ts": r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:class|interface|enum)\s+(\w+)", "rust": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|union)\s+(\w+)"}
FUNCTION_PATTERN = {"python": r"^\s*(?:async\s+)?def\s+(\w+)", "go": r"^func\s+(?:\([^)]*\)\s*)?(\w+)", "java": r"^\s*(?:(?:public|protected|private|static|final|abstract|synchronized)\s+)+[\w<>\[\], ?.]+?\s(\w+)\s*\(", "ts": r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)", "rust": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+(\w+)"}
IMPORT_PATTERN = {"python": r"^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))", "go": r"^\s*(?:import\s+)?(?:\w+\s+)?\"([\w./-]+)\"\s*$", "java": r"^\s*import\s+(?:static\s+)?([\w.]+)", "ts": r"^\s*import\b.*?from\s+[\"']([^\"']+)[\"']", "rust": r"^\s*use\s+([\w:]+)"}


def _by_language(patterns: dict[str, str], text: str, group: int = 1):
    return F.coalesce(*(F.when(F.col("language_id") == k, F.regexp_extract(text, p, group)) for k, p in patterns.items()))


def declarations(lines: DataFrame) -> DataFrame:
    """(file_id, language_id, kind, name, line_no) of types and functions. Narrow."""
    both = F.array(F.struct(F.lit("type").alias("kind"), _by_language(TYPE_PATTERN, "stripped").alias("name")), F.struct(F.lit("function").alias("kind"), _by_language(FUNCTION_PATTERN, "stripped").alias("name")))
    return lines.filter(~F.col("comment")).select("file_id", "language_id", "line_no", F.explode(both).alias("d")).filter("d.name <> ''").select("file_id", "language_id", "d.kind", "d.name", "line_no")


def imports(lines: DataFrame) -> DataFrame:
    """(file_id, language_id, import_name, line_no)."""
    first = _by_language(IMPORT_PATTERN, "raw", 1)
    python = F.regexp_extract("raw", IMPORT_PATTERN["python"], 2)
    name = F.when((F.col("language_id") == "python") & (first == ""), python).otherwise(first)
    return lines.filter(~F.col("comment")).select("file_id", "language_id", "line_no", name.alias("import_name")).filter("import_name <> ''")


def unused_symbols(lines: DataFrame, keys: tuple[str, ...] = ("repo",)) -> DataFrame:
    """Declared functions whose name occurs once in all code of their repo.

    Words are counted per repo and word with partial aggregation; declarations are
    joined with the words counted once.
    """
    words = lines.select(*keys, F.explode(F.regexp_extract_all("raw", F.lit(r"[A-Za-z_]\w+"), F.lit(0))).alias("name"))
    once = words.groupBy(*keys, "name").agg(F.count("*").alias("n")).filter("n = 1").drop("n")
    declared = lines.filter(~F.col("comment")).select(*keys, "file_id", "line_no", _by_language(FUNCTION_PATTERN, "stripped").alias("name")).filter("name <> ''")
    return declared.join(once, [*keys, "name"], "left_semi")


def unused_imports(lines: DataFrame) -> DataFrame:
    """Imported names of Python and TypeScript that no other line of the file mentions."""
    names = F.when(F.col("language_id") == "python", F.regexp_extract("stripped", r"^\s*(?:from\s+\S+\s+)?import\s+(.+)$", 1)).when(F.col("language_id") == "ts", F.regexp_extract("stripped", r"^\s*import\s+(?:type\s+)?(?:\w+\s*,\s*)?\{?([^}]*?)\}?\s+from\b", 1))
    listed = F.transform(F.split(names, ","), lambda x: F.regexp_extract(F.trim(x), r"(\w+)$", 1))
    bound = lines.filter(~F.col("comment") & F.coalesce(names, F.lit("")).rlike(r"\w")).select("file_id", "line_no", F.explode(listed).alias("name")).filter("name <> ''")
    used = lines.filter(~F.col("comment") & ~F.col("stripped").rlike(r"^\s*(import|from)\b")).select("file_id", F.explode(F.array_distinct(F.regexp_extract_all("stripped", F.lit(r"[A-Za-z_]\w*"), F.lit(0)))).alias("name")).distinct()
    return bound.join(used, ["file_id", "name"], "left_anti")


def commented_code(lines: DataFrame, least: int = 3) -> DataFrame:
    """Runs of at least ``least`` comment lines that look like code: gaps and islands over a file's lines."""
    body = F.regexp_replace("raw", r"^\s*(//+|#+|\*)\s?", "")
    code = F.col("comment") & body.rlike(r"[;{}]\s*$|^\s*\w[\w.\[\]]*\s*(=|\+=|:=)\s*\S|^\s*(if|for|while|return|def|func|fn|const|let|var)\b.*[(:{=]|^[\w.]+\(.*\)\s*$")
    w = Window.partitionBy("file_id").orderBy("line_no")
    c = lines.filter(code).select("file_id", "line_no", (F.col("line_no") - F.row_number().over(w)).alias("island"))
    return c.groupBy("file_id", "island").agg(F.min("line_no").alias("line_no"), F.count("*").alias("lines")).filter(F.col("lines") >= least).drop("island")


def unreachable(lines: DataFrame) -> DataFrame:
    """Lines that follow a return, throw, break or continue at the same depth."""
    w = Window.partitionBy("file_id").orderBy("line_no")
    depth = F.length(F.regexp_extract("raw", r"^[ \t]*", 0))
    text = F.trim("stripped")
    s = lines.filter((F.trim("raw") != "") & ~F.col("comment")).select("file_id", "language_id", "line_no", "raw", text.alias("t"), depth.alias("depth"))
    s = s.withColumn("before", F.lag("t").over(w)).withColumn("before_depth", F.lag("depth").over(w))
    ends = F.col("before").rlike(r"^(return\b.*|throw\b.*;|raise\b.*|break|continue)\s*;?$") & ~F.col("before").rlike(r"[({\[,+\-*/=.&|]$")
    return s.filter(ends & (F.col("depth") == F.col("before_depth")) & ~F.col("t").rlike(r"^([})\]]|case\b|default\b|else\b|elif\b|except\b|finally\b|catch\b|#|//|\.|\?|:|\|)")).select("file_id", "line_no", F.col("t").alias("text"))


def folder_smells(files: DataFrame) -> DataFrame:
    """Folders with more than 30 files of their own, and parents of more than 10 folders of one file: (repo, folder, smell, n)."""
    f = files.select("repo", F.regexp_replace("rel_path", r"/?[^/]*$", "").alias("folder"), "file_id").distinct()
    n = f.groupBy("repo", "folder").agg(F.count("*").alias("n"))
    crowded = n.filter("n > 30").select("repo", "folder", F.lit("crowded").alias("smell"), "n")
    single = n.filter("n = 1").groupBy("repo", F.regexp_replace("folder", r"/?[^/]*$", "").alias("folder")).agg(F.count("*").alias("n")).filter("n > 10").select("repo", "folder", F.lit("scattered").alias("smell"), "n")
    return crowded.unionByName(single)


# Layers in the order in which they are asked, with the folder or file names that tell them.
LAYERS = (
    ("Tests", "test tests testdata __tests__"),
    ("CLI / Entry", "cmd cli command commands main.go main.py __main__.py"),
    ("Config / Settings", "config conf configuration settings constants"),
    ("Auth / Security", "auth authentication authorization security jwt"),
    ("API / Handlers", "handler handlers controller controllers api apis route routes router endpoint endpoints http rest transport views viewsets urls"),
    ("Models / Schemas", "model models entity entities domain schema schemas dto dtos"),
    ("Persistence", "repository repositories store stores dao persistence db database migrations orm"),
    ("Services / Domain", "service services usecase usecases interactor logic"),
    ("Jobs / Tasks", "task tasks job jobs worker workers queue celery"),
    ("Infrastructure / Utils", "util utils helper helpers common pkg lib infra infrastructure middleware"),
)
#: Files that are tests or API descriptions by their names.
TEST_NAME, API_NAME = r"_test\.[^/]*$|\.(test|spec)\.ts$", r"\.proto$"
OTHER_LAYER = "Other"


def layer(path):
    """The layer of a path: of the layers in their order the first that a part of the whole path tells; else Other."""
    low = F.lower(path)
    parts = F.split(low, "/")
    out = F.lit(OTHER_LAYER)
    for name, words in reversed(LAYERS):
        told = F.arrays_overlap(parts, F.array(*map(F.lit, words.split())))
        out = F.when(told | low.rlike(TEST_NAME) if name == "Tests" else told, F.lit(name)).otherwise(out)
        if name == "CLI / Entry":
            out = F.when(low.rlike(API_NAME), F.lit("API / Handlers")).otherwise(out)
    return out


def layer_bars(files: DataFrame) -> DataFrame:
    """Files and lines by layer."""
    return files.withColumn("layer", layer(F.col("rel_path"))).groupBy("layer").agg(F.count("*").alias("files"), F.sum(F.coalesce("line_count", F.lit(0))).cast("long").alias("lines"))


def comment_share(lines: DataFrame) -> DataFrame:
    """Share of comment lines among lines with content, by language."""
    return lines.filter(F.trim("raw") != "").groupBy("language_id").agg(F.count("*").alias("lines"), F.round(F.avg(F.col("comment").cast("int")), 4).alias("share"))


def complexity_points(lines: DataFrame) -> DataFrame:
    """Branch points of each file in code: keywords and short-circuit signs of stripped lines."""
    n = F.size(F.regexp_extract_all("stripped", F.lit(r"\b(?:if|elif|for|while|case|catch|except|when)\b|&&|\|\|"), F.lit(0)))
    return lines.filter(~F.col("comment")).groupBy("file_id").agg(F.sum(n).cast("long").alias("points"), F.count("*").alias("lines"))


def loop_depth(lines: DataFrame) -> DataFrame:
    """Deepest nesting of loops in each file by the indent of loop heads: a fold over the file's loop heads.

    The heads of one file, not its lines, are gathered; a file is one record.
    """
    heads = lines.filter(~F.col("comment") & F.trim("stripped").rlike(r"^(for|while|loop)\b"))
    depth = F.length(F.regexp_replace(F.regexp_extract("raw", r"^[ \t]*", 0), "\t", "    "))
    g = heads.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("line_no", depth.alias("d")))).alias("h"))
    step = lambda s, x: F.struct(F.concat(F.filter(s["open"], lambda o: o < x["d"]), F.array(x["d"])).alias("open"), F.greatest(s["deep"], F.size(F.filter(s["open"], lambda o: o < x["d"])) + 1).alias("deep"))
    start = F.struct(F.array().cast("array<int>").alias("open"), F.lit(0).alias("deep"))
    return g.select("file_id", F.size("h").alias("loops"), F.aggregate("h", start, step, lambda s: s["deep"]).alias("depth"))
