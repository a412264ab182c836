"""The shape of a code base: architecture patterns, domain modelling, technologies and shared-state topology."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Role suffixes of types, by the client pattern they speak for.
ROLES = {
    "VIPER": ("Presenter", "Interactor", "Router", "Entity", "Wireframe"), "MVVM": ("ViewModel", "Coordinator"), "MVP": ("Presenter", "Contract"), "MVC": ("Controller", "ViewController"), "Redux": ("Reducer", "Store", "Action", "Middleware"),
    "Clean": ("UseCase", "Repository", "Gateway", "DataSource"), "RIBs": ("Interactor", "Router", "Builder", "Component"),
}
# Suffixes of tactical patterns of domain models.
TACTICAL = ("Entity", "Aggregate", "AggregateRoot", "ValueObject", "Repository", "Factory", "Specification", "DomainEvent", "DomainService", "Policy")
# Import names and the technology they mean.
TECHNOLOGIES = {
    "flask": "Flask", "django": "Django", "fastapi": "FastAPI", "sqlalchemy": "SQLAlchemy", "celery": "Celery", "numpy": "NumPy", "pandas": "pandas", "requests": "Requests", "react": "React", "express": "Express", "vue": "Vue", "angular": "Angular", "axios": "Axios",
    "springframework": "Spring", "hibernate": "Hibernate", "gin-gonic": "Gin", "gorm": "GORM", "grpc": "gRPC", "kafka": "Kafka", "redis": "Redis", "tokio": "Tokio", "serde": "Serde", "actix_web": "Actix", "axum": "Axum",
}


def _ends(name: str, suffixes):
    return F.greatest(*(F.col(name).endswith(s).cast("int") for s in suffixes), F.lit(0))


def pattern_scores(types: DataFrame, *keys: str) -> DataFrame:
    """Share of a scope's types that carry a role of each pattern, times the share of the pattern's roles seen; patterns below 0.15 are left out.

    types: keys and name. One aggregate for all patterns, then an unpivot.
    """
    aggs = [F.count("*").alias("types")]
    for p, roles in ROLES.items():
        aggs.append(F.sum(_ends("name", roles)).alias(f"n_{p}"))
        aggs.append((sum(F.max(F.col("name").endswith(r).cast("int")) for r in roles) / len(roles)).alias(f"s_{p}"))
    wide = types.groupBy(*keys).agg(*aggs) if keys else types.agg(*aggs)
    scored = F.array(*(F.struct(F.lit(p).alias("pattern"), F.round(F.col(f"n_{p}") / F.col("types") * F.col(f"s_{p}"), 4).alias("score")) for p in ROLES))
    return wide.select(*keys, F.explode(scored).alias("x")).select(*keys, "x.pattern", "x.score").filter("score >= 0.15")


def domain_model(types: DataFrame, files: DataFrame) -> DataFrame:
    """One row: rich and anemic types, tactical kinds present, layer evidence, the score of 100 and its verdict.

    types: name, methods (number), fields (number). files: rel_path. Weights .40 richness, .35 tactics, .25 layers.
    """
    rich = F.sum(((F.col("methods") > 0) & (F.col("fields") > 0)).cast("int"))
    anemic = F.sum(((F.col("methods") == 0) & (F.col("fields") > 1)).cast("int"))
    tactics = sum(F.max(F.col("name").endswith(t).cast("int")) for t in TACTICAL)
    t = types.agg(F.coalesce(rich, F.lit(0)).alias("rich"), F.coalesce(anemic, F.lit(0)).alias("anemic"), F.coalesce(tactics, F.lit(0)).alias("tactics"))
    path = F.lower("rel_path")
    has = lambda p: F.coalesce(F.max(path.rlike(p)), F.lit(False))
    f = files.agg(has(r"(^|/)domains?/").alias("domain"), has(r"(^|/)infra(structure)?/").alias("infra"), has(r"(^|/)(app|application)/").alias("app"), has(r"(^|/)(ports?|adapters?)/").alias("hex"), has(r"(^|/)daos?/").alias("dao"))
    layers = 0.4 * F.col("domain").cast("int") + 0.3 * F.col("infra").cast("int") + 0.2 * F.col("app").cast("int") + 0.1 * F.col("hex").cast("int") + F.when(F.col("dao"), -0.30).otherwise(0.05) - F.when(F.col("domain"), 0.0).otherwise(0.20)
    layers = F.greatest(F.lit(0.0), F.least(F.lit(1.0), layers))
    share = F.when(F.col("rich") + F.col("anemic") == 0, F.lit(0.0)).otherwise(F.col("rich") / (F.col("rich") + F.col("anemic")))
    score = F.round(100 * (0.40 * share + 0.35 * F.least(F.lit(1.0), 0.2 * F.col("tactics")) + 0.25 * layers), 2)
    out = t.crossJoin(F.broadcast(f)).withColumn("score", score)  # one row each
    verdict = F.lit("anemic")
    for limit, name in ((25, "mostly anemic"), (40, "mixed"), (50, "leaning rich"), (65, "rich")):
        verdict = F.when(F.col("score") >= limit, name).otherwise(verdict)
    return out.select("rich", "anemic", "tactics", "score", verdict.alias("verdict"))


def protocol_orientation(decls: DataFrame) -> DataFrame:
    """One row from declarations (kind, has_base): .55 protocol + .30 value + .15 composition shares, of 100."""
    n = lambda c: F.sum(c.cast("int"))
    k = F.col("kind")
    a = decls.agg(n(k == "protocol").alias("protocols"), n(k.isin("struct", "enum")).alias("values"), n(k == "class").alias("classes"), n((k == "class") & F.col("has_base")).alias("inheriting"))
    types = F.col("values") + F.col("classes")
    part = lambda x, y: F.when(F.coalesce(y, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), x / y))
    return a.select("*", F.round(100 * (0.55 * part(2 * F.col("protocols"), types) + 0.30 * part(F.col("values"), types) + 0.15 * (1 - part(F.col("inheriting"), F.col("classes")))), 2).alias("score"))


def technologies(imports: DataFrame) -> DataFrame:
    """Technologies by the imports that name them: files and mentions. No join: the catalogue is the expression."""
    hit = F.lit(None).cast("string")
    for word, name in TECHNOLOGIES.items():
        hit = F.when(F.lower("import_name").rlike(rf"(^|[./@-]){word}($|[./_-])"), name).otherwise(hit)
    return imports.withColumn("technology", hit).filter("technology IS NOT NULL").groupBy("technology").agg(F.count("*").alias("mentions"), F.count_distinct("file_id").alias("files"))


#: Uses of shared state in code: (kind, pattern, group of the key).
TOPOLOGY = (
    ("task", r"@(?:app|celery|shared)\.?_?task\b(?:\(.*name\s*=\s*[\"']([^\"']+)[\"'])?", 1), ("task call", r"\b(\w+)\.(?:delay|apply_async)\(", 1), ("queue", r"queue(?:_name)?\s*=\s*[\"']([^\"']+)[\"']", 1), ("redis key", r"\b(?:redis|r|cache)\.(?:get|set|hget|hset|incr|expire|lpush|rpush|sadd)\(\s*f?[\"']([^\"'{:]+)", 1),
    ("topic", r"\b(?:publish|subscribe|produce|send)\(\s*[\"']([\w.-]+)[\"']", 1), ("transaction", r"\b(?:transaction\.atomic|session\.begin|BEGIN|beginTransaction)\b()", 1),
)


def topology(lines: DataFrame) -> DataFrame:
    """(kind, key, places, files): tasks, queues, keys and topics that code shares."""
    hits = F.array_compact(F.array(*(F.when(F.col("raw").rlike(p), F.struct(F.lit(k).alias("kind"), F.regexp_extract("raw", p, g).alias("key"))) for k, p, g in TOPOLOGY)))
    found = lines.filter(~F.col("comment")).select("file_id", F.explode_outer(hits).alias("h")).filter("h IS NOT NULL").select("file_id", "h.*")
    return found.groupBy("kind", "key").agg(F.count("*").alias("places"), F.count_distinct("file_id").alias("files"))


def drift(declared: DataFrame, live: DataFrame) -> DataFrame:
    """Keys declared in code but not live, and live but not declared: a full outer anti-join on (kind, key)."""
    a, b = declared.select("kind", "key").distinct().withColumn("in_code", F.lit(True)), live.select("kind", "key").distinct().withColumn("in_dump", F.lit(True))
    j = a.join(b, ["kind", "key"], "full_outer")
    return j.filter("in_code IS NULL OR in_dump IS NULL").select("kind", "key", F.when(F.col("in_dump").isNull(), "not running").otherwise("not declared").alias("drift"))
