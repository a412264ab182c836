"""Checks of infrastructure artefacts: container files, compose files, environment files and cluster manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Checks on container files: (metric, severity, pattern, True if it should be there).
CONTAINER = (
    ("pinned base image", "medium", r"(?im)^FROM\s+\S+(:(?!latest)[\w.-]+|@sha256:)", True), ("no latest tag", "medium", r"(?im)^FROM\s+\S+:latest\b", False), ("non-root user", "high", r"(?im)^USER\s+(?!root\b|0\b)\S+", True), ("health check", "low", r"(?im)^HEALTHCHECK\b", True),
    ("no secrets in ENV", "critical", r"(?im)^(ENV|ARG)\s+\w*(PASSWORD|PASSWD|SECRET|TOKEN|API_?KEY|PRIVATE_?KEY)\w*\s*[=\s]\s*(?![$\"']?\s*$|\$\{?)\S+", False), ("no ADD of remote files", "medium", r"(?im)^ADD\s+https?://", False), ("no curl piped to a shell", "high", r"(?i)curl[^\n|]*\|\s*(ba|z)?sh\b", False),
    ("no sudo", "low", r"(?im)^RUN\s+.*\bsudo\b", False), ("exec form of CMD", "low", r"(?im)^(CMD|ENTRYPOINT)\s+\[", True), ("package lists removed", "low", r"(?i)apt-get install(?![\s\S]*rm -rf /var/lib/apt)", False), ("multi-stage build", "low", r"(?im)^FROM\s+\S+\s+AS\s+", True),
)
COMPOSE = (
    ("no privileged container", "critical", r"(?m)^\s+privileged:\s*true", False), ("no host network", "high", r"(?m)^\s+network_mode:\s*[\"']?host", False), ("restart policy", "low", r"(?m)^\s+restart:", True), ("no mounted container socket", "critical", r"/var/run/docker\.sock", False),
    ("resource limits", "low", r"(?m)^\s+(mem_limit|cpus|limits):", True), ("health checks", "low", r"(?m)^\s+healthcheck:", True), ("pinned images", "medium", r"(?m)^\s+image:\s*[^\s:]+(:latest)?\s*$", False),
)
CLUSTER = (
    ("no privileged container", "critical", r"(?m)^\s*privileged:\s*true", False), ("no privilege escalation", "high", r"(?m)allowPrivilegeEscalation:\s*false", True), ("runs as non-root", "high", r"(?m)runAsNonRoot:\s*true", True), ("read-only root file system", "medium", r"(?m)readOnlyRootFilesystem:\s*true", True),
    ("memory limit", "medium", r"(?m)limits:[\s\S]{0,120}memory:", True), ("cpu request", "low", r"(?m)requests:[\s\S]{0,120}cpu:", True), ("liveness probe", "medium", r"livenessProbe:", True), ("readiness probe", "medium", r"readinessProbe:", True), ("no host network", "high", r"(?m)^\s*hostNetwork:\s*true", False),
    ("no host path", "high", r"(?m)^\s*hostPath:", False), ("no latest tag", "medium", r"(?m)image:\s*\S+:latest\b", False), ("drops capabilities", "medium", r"drop:\s*(\[\s*[\"']?ALL|\s*\n\s*-\s*[\"']?ALL)", True), ("no default service account token", "low", r"automountServiceAccountToken:\s*false", True),
)


def _kind(path, text):
    return (
        F.when(path.rlike(r"(?i)(^|/)([\w.-]*dockerfile[\w.-]*|[\w-]+\.dockerfile)$"), "container")
        .when(path.rlike(r"(?i)(^|/)(docker-)?compose[\w.-]*\.ya?ml$"), "compose")
        .when(path.rlike(r"(?i)\.ya?ml$") & text.rlike(r"(?m)^kind:\s*(Deployment|StatefulSet|DaemonSet|Pod|Job|CronJob)\b"), "cluster")
    )


def checks(files: DataFrame, path: str = "rel_path", text: str = "content") -> DataFrame:
    """(file_id, artefact, metric, severity, status) of every artefact: one narrow pass, checks as expressions."""
    f = files.filter(F.col("language_id").isNull() & (F.length(text) > 0)).withColumn("artefact", _kind(F.col(path), F.col(text))).filter("artefact IS NOT NULL")
    sets = {"container": CONTAINER, "compose": COMPOSE, "cluster": CLUSTER}
    rows = F.array_compact(F.array(*(F.when(F.col("artefact") == kind, F.struct(F.lit(m).alias("metric"), F.lit(s).alias("severity"), F.when(F.col(text).rlike(p) == F.lit(good), "pass").otherwise("fail" if s in ("critical", "high") else "warn").alias("status"))) for kind, rules in sets.items() for m, s, p, good in rules)))
    return f.select("file_id", "artefact", F.explode(rows).alias("c")).select("file_id", "artefact", "c.*")


def dotenv_credentials(files: DataFrame) -> DataFrame:
    """Lines of environment files that set a credential to a literal: (file_id, line_no, name)."""
    p = r"(?i)^\s*(?:export\s+)?([\w.]*(?:password|passwd|secret|token|api_?key|private_?key|access_?key)\w*)\s*=\s*[\"']?(?!\$|<|\*|x{4}|\s*[\"']?$)[^\s\"'#]{4,}"
    f = files.filter(F.col("rel_path").rlike(r"(^|/)[\w.-]*\.env$|(^|/)\.env[\w.-]*$") & F.col("content").isNotNull())
    return f.select("file_id", F.posexplode(F.split("content", "\r?\n")).alias("pos", "raw")).filter(F.col("raw").rlike(p)).select("file_id", (F.col("pos") + 1).alias("line_no"), F.regexp_extract("raw", p, 1).alias("name"))


def quantity(text):
    """A cluster quantity as a number: millis of CPU for 250m, bytes for 64Mi, plain otherwise."""
    n = F.regexp_extract(text, r"^([0-9.]+)", 1).cast("double")
    unit = F.regexp_extract(text, r"^[0-9.]+([A-Za-z]*)$", 1)
    factor = F.coalesce(*(F.when(unit == k, F.lit(v)) for k, v in {"m": 0.001, "": 1.0, "k": 1e3, "M": 1e6, "G": 1e9, "T": 1e12, "Ki": 1024.0, "Mi": 1024.0**2, "Gi": 1024.0**3, "Ti": 1024.0**4}.items()))
    return n * factor


def cluster_findings(objects: DataFrame) -> DataFrame:
    """Findings across cluster objects (kind, namespace, name, spec json): exposed balancers, ingress without TLS, secrets in config maps, admin bindings, namespaces without a network policy."""
    o = objects.withColumn("ns", F.coalesce("namespace", F.lit("default")))
    lb = o.filter((F.col("kind") == "Service") & (F.get_json_object("spec", "$.type") == "LoadBalancer") & F.get_json_object("spec", "$.loadBalancerSourceRanges").isNull())
    ingress = o.filter((F.col("kind") == "Ingress") & F.get_json_object("spec", "$.tls").isNull())
    secret = o.filter((F.col("kind") == "ConfigMap") & F.coalesce("spec", F.lit("")).rlike(r'(?i)"[^"]*(password|secret|token|api_?key)[^"]*"\s*:\s*"[^"$]{4,}"'))
    admin = o.filter((F.col("kind") == "ClusterRoleBinding") & (F.get_json_object("spec", "$.roleRef.name") == "cluster-admin"))
    covered = o.filter("kind = 'NetworkPolicy'").select("ns").distinct()
    naked = o.filter(F.col("kind").isin("Deployment", "StatefulSet", "DaemonSet", "Pod")).select("ns").distinct().join(covered, "ns", "left_anti").select(F.lit("no network policy").alias("finding"), F.lit("medium").alias("severity"), "ns", F.lit("").alias("name"))
    row = lambda df, f, s: df.select(F.lit(f).alias("finding"), F.lit(s).alias("severity"), "ns", "name")
    return row(lb, "unrestricted load balancer", "high").unionByName(row(ingress, "ingress without TLS", "high")).unionByName(row(secret, "secret in a config map", "high")).unionByName(row(admin, "cluster-admin binding", "critical")).unionByName(naked)
