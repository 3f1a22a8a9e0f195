"""Trace logs: JSONL scan, record classes, projection, look-back, caps and sinks.

A line is a map from key to JSON text: key presence, which decides classes and aliases, is
then a map look-up, and a present null is told from an absent key. Batch and streaming
reads share every function; only the reader differs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guardlake.functions.paths import trimmed

#: Classes, platforms, caps of a baked snapshot and of a live one.
CLASSES = ("events", "rules", "results", "subprocesses")
PLATFORMS = ("claude", "codex", "opencode", "cursor", "pi")
PLATFORM_SOURCES = ("explicit", "defaulted", "normalized", "unknown")
BAKED_CAPS = {"events": 6_000, "rules": 6_000, "results": 6_000, "subprocesses": 2_000}
LIVE_CAPS = {"events": 120_000, "rules": 240_000, "results": 120_000, "subprocesses": 10_000}
METADATA = (
    "platform_capability", "degraded_reason", "enforcement_mode", "resolved_repo_root", "session_title", "session_title_source", "session_identity_source", "opencode_session_id", "codex_session_id",
    "secondary_session_ids", "parent_session_id", "root_session_id", "origin_platform", "origin_session_id", "platform_source", "subagent_type", "spawn_description", "lineage_role",
)
ALSO = {"session_title": ("thread_title", "conversation_title"), "codex_session_id": ("thread_id", "conversation_id")}
PLAIN = ("platform_capability", "degraded_reason", "enforcement_mode", "resolved_repo_root")


def spellings(name: str) -> list[str]:
    """A snake-case key and its camel-case forms; ids also end in capitals."""
    head, *rest = name.split("_")
    camel = head + "".join(x.capitalize() for x in rest)
    return [name, camel] + ([camel[:-2] + "ID"] if name.endswith("_id") else [])


def aliases(key: str, bare_title: bool = False) -> list[str]:
    if key in PLAIN:
        return [key]
    out = [s for name in (key, *ALSO.get(key, ())) for s in spellings(name)]
    return out + ["title"] * (bare_title and key == "session_title")


def scan(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``line, m``: lines that are JSON objects; blank, malformed and other lines are skipped."""
    return parsed(spark.read.text(path).withColumnRenamed("value", "line"))


def follow(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The same rows as a stream of a growing folder."""
    return parsed(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).withColumnRenamed("value", "line"))


def parsed(lines: DataFrame) -> DataFrame:
    whole = F.ltrim("line").startswith("{")
    m = F.when(whole, F.from_json("line", "map<string,string>", {"mode": "PERMISSIVE"}))
    return lines.withColumn("m", m).where("m is not null")


def has(key: str) -> Column:
    return F.map_contains_key("m", key)


def classified(rows: DataFrame) -> DataFrame:
    """``category`` by the keys that are present; rows of none are dropped."""
    category = (
        F.when(has("command") & has("returncode"), "subprocesses").when(has("findings") & F.coalesce(F.col("m")["findings"].startswith("["), F.lit(False)), "results")
        .when(has("rule_id"), "rules").when(has("event_name") & has("session_id"), "events")
    )
    return rows.withColumn("category", category).where("category is not null")


def is_metric_row() -> Column:
    """A rule row without decision or severity is a metric, not a finding."""
    return has("rule_id") & ~has("decision") & ~has("severity")


def picked(key: str, bare_title: bool = False) -> Column:
    """The value under the first alias that is present, even if it is null."""
    out = F.lit(None).cast("string")
    for name in reversed(aliases(key, bare_title)):
        out = F.when(has(name), F.col("m")[name]).otherwise(out)
    return out


def platform(value: Column) -> Column:
    return F.when(value.isin(*PLATFORMS), value).otherwise("unknown")


def _text(key: str, limit: int | None = None, default: str | None = None) -> Column:
    value = F.col("m")[key]
    value = trimmed(value, limit) if limit else value
    return (F.coalesce(value, F.lit(default)) if default is not None else value).alias(key)


def _strings(key: str) -> Column:
    return F.coalesce(F.from_json(F.col("m")[key], "array<string>"), F.array().cast("array<string>")).alias(key)


def _metadata(bare_title: bool = False) -> list[Column]:
    out = []
    given = F.col("m")["platform"]
    for key in METADATA:
        value = picked(key, bare_title)
        if key == "secondary_session_ids":
            value = F.coalesce(F.from_json(value, "array<string>"), F.when(F.trim(value) != "", F.array(value)))
        elif key == "origin_platform":
            value = F.when(value.isNotNull(), platform(value))
        elif key == "platform_source":
            known = F.when(value.isin(*PLATFORM_SOURCES), value)
            value = F.coalesce(known, F.when(given.isNull() | (given == ""), "unknown").when(platform(given) != "unknown", "explicit").otherwise("normalized"))
        out.append(value.alias(key))
    return out


def _base() -> list[Column]:
    return [_text("timestamp", default=""), platform(F.col("m")["platform"]).alias("platform"), *(_text(k, default="") for k in ("event_name", "session_id", "tool_name"))]


def _calls() -> list[Column]:
    return [_text("model"), _text("provider"), _text("command", 1000), _text("tool_output", 1000), _text("tool_input", 20_000)]


def events(rows: DataFrame) -> DataFrame:
    return rows.where("category = 'events'").select(*_base(), _strings("candidate_paths"), _strings("languages"), *_calls(), *_metadata(True))


def rules(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("category") == "rules").where(~is_metric_row()).select(*_base(), _text("rule_id", default=""), _text("severity", default="LOW"), _text("decision"), _text("message", 180), _text("additional_context", 180), *_calls(), *_metadata())


FINDING = "array<struct<rule_id:string,severity:string,decision:string,message:string,additional_context:string,metadata:string>>"


def results(rows: DataFrame) -> DataFrame:
    found = F.transform(F.from_json(F.col("m")["findings"], FINDING), lambda f: F.struct(
        F.coalesce(f["rule_id"], F.lit("")).alias("rule_id"), F.coalesce(f["severity"], F.lit("LOW")).alias("severity"), f["decision"].alias("decision"), trimmed(f["message"], 180).alias("message"),
        trimmed(f["additional_context"], 180).alias("additional_context"), F.get_json_object(f["metadata"], "$.path").alias("path")))
    return rows.where("category = 'results'").select(*_base(), found.alias("findings"), F.transform(_strings("errors"), lambda e: trimmed(e, 180)).alias("errors"), F.coalesce(F.expr("try_cast(m['skipped'] as boolean)"), F.lit(False)).alias("skipped"), _text("reason", 180), *_calls(), *_metadata())


def subprocesses(rows: DataFrame) -> DataFrame:
    number = lambda key, kind, default: F.coalesce(F.expr(f"try_cast(m['{key}'] as {kind})"), F.lit(default)).alias(key)
    return rows.where("category = 'subprocesses'").select(*(_text(k, default="") for k in ("timestamp", "event_name", "session_id")), _text("command", 180, ""), _text("cwd", 120, ""), number("returncode", "int", 0), _text("stdout", 120, ""), _text("stderr", 180, ""), number("duration_ms", "double", 0.0))


def when(timestamp: Column | str = "timestamp") -> Column:
    c = F.col(timestamp) if isinstance(timestamp, str) else timestamp
    return F.try_to_timestamp(c)


def since(rows: DataFrame, days: int, now: Column, keep_bad: bool = True) -> DataFrame:
    """Rows of the last days; a timestamp that cannot be read is kept, as on the command line."""
    t = when(F.col("m")["timestamp"])
    return rows.where((t >= now - F.expr(f"interval {int(days)} days")) | (t.isNull() if keep_bad else F.lit(False)))


def look_back(rows: DataFrame, hours: int) -> DataFrame:
    """Rows at most ``hours`` (1 to 720) older than the newest row: one small aggregate, broadcast."""
    hours = min(max(int(hours), 1), 720)
    t = when(F.col("m")["timestamp"])
    latest = rows.agg(F.max(t).alias("_latest"))
    return rows.crossJoin(F.broadcast(latest)).where(t.isNull() | F.col("_latest").isNull() | (t >= F.col("_latest") - F.expr(f"interval {hours} hours"))).drop("_latest")


def capped(rows: DataFrame, caps: dict[str, int], category: str = "category", seq: str = "seq") -> DataFrame:
    """The newest rows of each category: per category a top-k, which never gathers a whole category in one task."""
    parts = [rows.where(F.col(category) == c).orderBy(F.desc(seq)).limit(n) for c, n in caps.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def deduplicated(rows: DataFrame) -> DataFrame:
    """Exact copies dropped, whatever the order of their keys."""
    canonical = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("m"))))
    return rows.withColumn("_key", F.sha2(canonical, 256)).dropDuplicates(["_key"]).drop("_key")


def append(df: DataFrame, path: str) -> None:
    """JSONL append sink."""
    df.write.mode("append").json(path)


def replace(df: DataFrame, path: str) -> None:
    """JSON replace sink; the write commits as a whole."""
    df.write.mode("overwrite").json(path)


def files(spark: SparkSession, path: str, glob: str = "*.py", exclude: str = r"(^|/)(\.venv|venv|node_modules|build|dist|\.git)(/|$)") -> DataFrame:
    """Source files of a tree as ``path, text``."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return raw.where(~F.col("path").rlike(exclude)).select("path", F.decode("content", "UTF-8").alias("text"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("content_hash"))


def coverage_json(spark: SparkSession, path: str) -> DataFrame:
    """Percent covered per file of a coverage report in JSON."""
    raw = spark.read.text(path, wholetext=True)
    report = F.from_json("value", "files map<string, struct<summary: struct<percent_covered: double>>>")
    return raw.select(F.explode(report["files"]).alias("path", "f")).select("path", F.floor(F.col("f.summary.percent_covered") + 0.5).cast("int").alias("percent"))


def coverage_xml(spark: SparkSession, path: str) -> DataFrame:
    """Percent covered per file of a coverage report in XML."""
    raw = spark.read.format("xml").option("rowTag", "class").schema("_filename string, `_line-rate` double").load(path)
    return raw.select(F.col("_filename").alias("path"), F.floor(F.col("_line-rate") * 100 + 0.5).cast("int").alias("percent"))


ISSUE = ("file", "line", "column", "severity", "code", "message", "source")


def lint_pyrefly(raw: DataFrame) -> DataFrame:
    """Issues of a type checker's JSON report; ``raw`` has one report per row in ``value``."""
    e = F.from_json("value", "errors array<struct<path:string,line:int,column:int,severity:string,name:string,concise_description:string,description:string>>")["errors"]
    d = lambda c, v: F.coalesce(c, F.lit(v))
    x = F.col("e")
    return raw.select(F.explode(e).alias("e")).select(d(x["path"], "unknown").alias("file"), d(x["line"], 1).alias("line"), d(x["column"], 1).alias("column"), d(x["severity"], "error").alias("severity"), d(x["name"], "unknown").alias("code"), F.coalesce(x["concise_description"], x["description"], F.lit("")).alias("message"), F.lit("pyrefly").alias("source"))


def lint_biome(raw: DataFrame) -> DataFrame:
    """Issues of a linter's JSON report: a list, or an object with ``diagnostics``."""
    item = "struct<location:struct<path:struct<file:string>,span:array<int>>,line:int,column:int,severity:string,category:string,message:string>"
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{item}>")).otherwise(F.from_json("value", f"diagnostics array<{item}>")["diagnostics"])
    x = F.col("e")
    severity = F.lower(F.coalesce(x["severity"], F.lit("error")))
    return raw.select(F.explode(listed).alias("e")).select(F.coalesce(x["location"]["path"]["file"], F.lit("unknown")).alias("file"), F.coalesce(x["line"], F.lit(1)).alias("line"), F.coalesce(x["column"], F.try_element_at(x["location"]["span"], F.lit(1)), F.lit(0)).alias("column"), F.when(severity.isin("error", "warning", "info"), severity).otherwise("warning").alias("severity"), F.coalesce(x["category"], F.lit("unknown")).alias("code"), F.coalesce(x["message"], F.lit("")).alias("message"), F.lit("biome").alias("source"))


def lint_clippy(raw: DataFrame) -> DataFrame:
    """Issues of a compiler's JSON lines; the primary span, else the first, places them."""
    m = F.from_json("value", "reason string, message struct<level:string,message:string,code:struct<code:string>,spans:array<struct<file_name:string,line_start:int,column_start:int,is_primary:boolean>>>")
    r = raw.select(m.alias("m")).where("m.reason = 'compiler-message'").select("m.message.*").withColumn("level", F.coalesce("level", F.lit("warning")))
    r = r.where(F.col("level").isin("error", "warning") & (F.size("spans") > 0))
    primary = F.filter("spans", lambda s: F.coalesce(s["is_primary"], F.lit(False)))
    s = F.when(F.size(primary) > 0, primary[0]).otherwise(F.col("spans")[0])
    return r.select(F.coalesce(s["file_name"], F.lit("unknown")).alias("file"), F.coalesce(s["line_start"], F.lit(1)).alias("line"), F.coalesce(s["column_start"], F.lit(1)).alias("column"), F.col("level").alias("severity"), F.coalesce("code.code", F.lit("unknown")).alias("code"), F.coalesce("message", F.lit("")).alias("message"), F.lit("clippy").alias("source"))
