"""Connections of code: inbound routes, outbound URLs and clients, and the match of routes with a specification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import masked_url, route_key

# Schemes and the protocols they mean.
PROTOCOLS = {"http": "REST", "https": "REST", "ws": "WebSocket", "wss": "WebSocket", "grpc": "gRPC", "postgres": "PostgreSQL", "postgresql": "PostgreSQL", "mysql": "MySQL", "redis": "Redis", "rediss": "Redis", "mongodb": "MongoDB", "amqp": "AMQP", "amqps": "AMQP", "kafka": "Kafka", "nats": "NATS", "smtp": "SMTP", "tcp": "TCP", "sqlite": "SQLite", "ssh": "SSH"}
#: (language, pattern with verb and path groups, group of the verb, group of the path)
ROUTES = (
    ("python", r"@\w+\.(get|post|put|patch|delete|route)\(\s*[\"']([^\"']+)[\"']", 1, 2),
    ("python", r"\bpath\(\s*()[\"']([^\"']+)[\"']", 1, 2),
    ("go", r"\.(GET|POST|PUT|PATCH|DELETE|HandleFunc|Handle|Get|Post|Put|Delete)\(\s*\"([^\"]+)\"", 1, 2),
    ("java", r"@(Get|Post|Put|Patch|Delete|Request)Mapping\(\s*(?:value\s*=\s*|path\s*=\s*)?\"([^\"]+)\"", 1, 2),
    ("java", r"@()Path\(\s*\"([^\"]+)\"", 1, 2),
    ("ts", r"\b(?:app|router|server)\.(get|post|put|patch|delete|all|use)\(\s*[\"'`]([^\"'`]+)[\"'`]", 1, 2),
    ("ts", r"@(Get|Post|Put|Patch|Delete)\(\s*[\"'`]([^\"'`]*)[\"'`]", 1, 2),
    ("rust", r"#\[(get|post|put|patch|delete)\(\s*\"([^\"]+)\"", 1, 2),
    ("rust", r"\.()route\(\s*\"([^\"]+)\"", 1, 2),
)
#: Client calls that name no URL: (language, pattern, protocol).
CLIENTS = (
    ("go", r"grpc\.(Dial|NewClient)\(", "gRPC"), ("go", r"sql\.Open\(\s*\"postgres", "PostgreSQL"), ("go", r"redis\.NewClient\(", "Redis"), ("go", r"kafka\.New(Reader|Writer)\(", "Kafka"), ("go", r"nats\.Connect\(", "NATS"),
    ("python", r"grpc\.(insecure|secure)_channel\(", "gRPC"), ("python", r"psycopg2?\.connect\(", "PostgreSQL"), ("python", r"redis\.(Strict)?Redis\(", "Redis"), ("python", r"Kafka(Consumer|Producer)\(", "Kafka"), ("python", r"pika\.\w*Connection\(", "AMQP"),
    ("java", r"ManagedChannelBuilder\.", "gRPC"), ("java", r"KafkaTemplate|KafkaListener", "Kafka"), ("java", r"RabbitTemplate|RabbitListener", "AMQP"), ("java", r"(Redis|String)RedisTemplate|RedisTemplate", "Redis"),
    ("ts", r"new WebSocket\(", "WebSocket"), ("ts", r"new Kafka\(", "Kafka"), ("ts", r"createClient\(.*redis", "Redis"), ("rust", r"reqwest::", "REST"), ("rust", r"tonic::", "gRPC"),
)
_URL = r"\b([a-z][a-z0-9+]{1,11})://([^\s\"'`<>\\)\]]+)"


def outbound(lines: DataFrame) -> DataFrame:
    """(file_id, line_no, uri, host, port, protocol, direction): URLs of known schemes in code, passwords masked."""
    urls = F.transform(F.regexp_extract_all("raw", F.lit(_URL), F.lit(0)), lambda u: F.struct(F.regexp_extract(u, _URL, 1).alias("scheme"), masked_url(u).alias("uri"), F.regexp_extract(u, r"://(?:[^@/\s]*@)?([^:/?#\s]+)", 1).alias("host"), F.regexp_extract(u, r"://(?:[^@/\s]*@)?[^:/?#\s]+:(\d+)", 1).alias("port")))
    known = F.create_map(*(x for k, v in PROTOCOLS.items() for x in (F.lit(k), F.lit(v))))
    out = lines.filter(~F.col("comment") & F.col("raw").contains("://")).select("file_id", "line_no", F.explode(urls).alias("u"))
    return out.select("file_id", "line_no", "u.uri", "u.host", "u.port", F.try_element_at(known, F.col("u.scheme")).alias("protocol"), F.lit("outbound").alias("direction")).filter("protocol IS NOT NULL AND host <> ''")


def clients(lines: DataFrame) -> DataFrame:
    """(file_id, line_no, protocol) of client constructors."""
    hits = F.array_compact(F.array(*(F.when((F.col("language_id") == lang) & F.col("raw").rlike(p), F.lit(proto)) for lang, p, proto in CLIENTS)))
    return lines.filter(~F.col("comment")).select("file_id", "line_no", F.explode(F.array_distinct(hits)).alias("protocol"))


def inbound(lines: DataFrame) -> DataFrame:
    """(file_id, line_no, verb, path, key): routes that code serves; verb ANY where the call names none."""
    hits = F.array_compact(F.array(*(F.when((F.col("language_id") == lang) & F.col("raw").rlike(p), F.struct(F.regexp_extract("raw", p, v).alias("verb"), F.regexp_extract("raw", p, w).alias("path"))) for lang, p, v, w in ROUTES)))
    out = lines.filter(~F.col("comment")).select("file_id", "line_no", F.explode(hits).alias("r"))
    verb = F.when(F.lower("r.verb").isin("get", "post", "put", "patch", "delete"), F.upper("r.verb")).otherwise("ANY")
    return out.select("file_id", "line_no", verb.alias("verb"), "r.path", route_key("r.path").alias("key"))


def connections(found: DataFrame) -> DataFrame:
    """Connections once for each (uri, protocol), with the number of places and the first."""
    return found.groupBy("uri", "protocol").agg(F.count("*").alias("places"), F.min(F.struct("file_id", "line_no")).alias("first")).select("uri", "protocol", "places", F.col("first.file_id").alias("file_id"), F.col("first.line_no").alias("line_no"))


def hosts(found: DataFrame) -> DataFrame:
    """Outbound hosts: protocols and places."""
    return found.groupBy("host").agg(F.count("*").alias("places"), F.count_distinct("protocol").alias("protocols"), F.count_distinct("file_id").alias("files"))


def spec_coverage(spec: DataFrame, code: DataFrame) -> DataFrame:
    """Operations by state: covered, missing (specified only) and extra (in code only).

    Both sides have verb and key. A route for ANY verb covers every verb of its key.
    """
    s, c = spec.select("verb", "key").distinct(), code.select("verb", "key").distinct()
    exact, wide = c.filter("verb <> 'ANY'"), c.filter("verb = 'ANY'").select("key").distinct()
    by_verb = s.join(exact, ["verb", "key"], "left_semi")
    by_any = s.join(exact, ["verb", "key"], "left_anti").join(wide, "key", "left_semi").select("verb", "key")
    covered = by_verb.unionByName(by_any)
    missing = s.join(exact, ["verb", "key"], "left_anti").join(wide, "key", "left_anti").select("verb", "key")
    extra = exact.join(s, ["verb", "key"], "left_anti").unionByName(wide.join(s.select("key").distinct(), "key", "left_anti").select(F.lit("ANY").alias("verb"), "key"))
    return covered.withColumn("state", F.lit("covered")).unionByName(missing.withColumn("state", F.lit("missing"))).unionByName(extra.withColumn("state", F.lit("extra")))


def coverage_percent(states: DataFrame) -> DataFrame:
    """One row: covered, missing, extra and both percentages."""
    n = lambda s: F.sum((F.col("state") == s).cast("long"))
    return states.agg(n("covered").alias("covered"), n("missing").alias("missing"), n("extra").alias("extra")).withColumn("spec_percent", F.round(100 * F.col("covered") / (F.col("covered") + F.col("missing")), 2)).withColumn("code_percent", F.round(100 * F.col("covered") / (F.col("covered") + F.col("extra")), 2))
