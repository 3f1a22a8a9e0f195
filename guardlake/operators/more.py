"""Further joins, windows and roll-ups over traces and the source corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardlake.functions.decisions import ENFORCEMENT, SESSION_ORDER, first_of, is_in
from guardlake.storage import saved


def group_merge(summaries: DataFrame, roots: DataFrame) -> DataFrame:
    """Session summaries merged by their root; a session without a root is its own."""
    rooted = summaries.join(roots, "session_id", "left").withColumn("root", F.coalesce("root", "session_id"))
    return rooted.groupBy("root").agg(
        F.count("*").alias("members"), F.sum("n_events").cast("long").alias("n_events"), F.max("duration_ms").alias("longest_ms"), first_of(F.collect_set("outcome"), SESSION_ORDER).alias("outcome"), F.min("session_id").alias("first_member"),
    )


def snapshot_summary(events: DataFrame, findings: DataFrame, runs: DataFrame) -> DataFrame:
    """One long table of the snapshot's counts: platforms, decisions, failed commands."""
    part = lambda df, name, key: df.groupBy(F.coalesce(key, F.lit("unknown")).alias("key")).agg(F.count("*").alias("n")).select(F.lit(name).alias("section"), "key", "n")
    return part(events, "platform", F.col("platform")).union(part(findings, "decision", F.coalesce("decision", F.lit("allow")))).union(part(runs.where("returncode <> 0"), "failure", F.col("command")))


def baseline_summary(violations: DataFrame) -> DataFrame:
    """Violations by rule and file, from the ids."""
    parts = F.split("stable_id", r"\|")
    return violations.select("rule", parts[1].alias("file")).groupBy("rule", "file").agg(F.count("*").alias("n"))


def visible_advisories(rows: DataFrame, group: str, ratio: str, id_col: str = "seq") -> DataFrame:
    """The strongest advisory of each group and the number that it suppresses."""
    best = rows.groupBy(group).agg(F.max_by(id_col, F.struct(ratio, (-F.col(id_col)).alias("i"))).alias(id_col), (F.count("*") - 1).alias("suppressed"))
    return best


def changed_rows(rows: DataFrame, key: str, signature: Column) -> DataFrame:
    """Rows whose signature differs from the one before of the same key."""
    w = Window.partitionBy(key).orderBy("seq")
    s = rows.withColumn("_s", signature).withColumn("_before", F.lag("_s").over(w))
    return s.where(F.col("_before").isNotNull() & (F.col("_before") != F.col("_s"))).drop("_s", "_before")


def page_of(rows: DataFrame, order: list[Column], size: int = 15) -> DataFrame:
    """The page each row stands on. Ranks come from a range sort, written once: a partition's rows are
    counted, and only the counts meet in one task."""
    ordered = saved(rows.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()))
    before = ordered.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = before.withColumn("_offset", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = ordered.join(F.broadcast(before), "_part")
    page = F.floor((F.col("_offset") + F.col("_id") - F.col("_first")) / size).cast("long")
    return placed.withColumn("page", page).drop("_part", "_id", "_n", "_first", "_offset")


def locked(attempts: DataFrame, locks: DataFrame) -> DataFrame:
    """Attempts of a session that break a locked rule again, with those rules."""
    both = attempts.join(locks, "session_id").withColumn("broken", F.array_sort(F.array_intersect("rule_ids", "locked_ids")))
    return both.where(F.size("broken") > 0).select("seq", "session_id", F.array_join("broken", ",").alias("broken"))


def repair_signal(prompt: Column) -> Column:
    """A prompt that announces a repair plan, names a constraint or rule, and a reading."""
    p = F.lower(prompt)
    return F.coalesce(p.contains("repair plan") & (p.contains("constraint") | p.contains("rule")) & (p.contains("reread") | p.contains("re-read") | p.contains("read")), F.lit(False))


def cleared(hits: DataFrame, touches: DataFrame) -> DataFrame:
    """Counters (session, path) whose path is touched later without another denial of it."""
    last = hits.groupBy("session_id", "path").agg(F.max("seq").alias("last_hit"), F.count("*").alias("hits"))
    touched = touches.groupBy("session_id", "path").agg(F.max("seq").alias("last_touch"))
    return last.join(touched, ["session_id", "path"]).where("last_touch > last_hit")


def obsolete_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Imports of modules that are neither there nor the package of one that is."""
    parts = F.split("module", r"\.")
    known = modules.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))).alias("module")).distinct()
    return imports.join(known, "module", "left_anti")


def constant_for(literals: DataFrame, constants: DataFrame) -> DataFrame:
    """Each literal with the constant that already holds it: the first by path, line and name."""
    first = constants.groupBy("value").agg(F.min(F.struct("path", "line", "name")).alias("c"))
    return literals.join(first, "value", "left").select(*literals.columns, F.col("c.name").alias("constant"), F.col("c.path").alias("constant_path"))


def counterparts(rules: DataFrame) -> DataFrame:
    """The inverse of rule -> collectors: collector -> rules."""
    return rules.select("rule_id", F.explode("collectors").alias("collector")).groupBy("collector").agg(F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("rules"))


def error_rules(errors: DataFrame, rules: DataFrame, pattern: str = r"([A-Za-z]+-[A-Za-z0-9-]*[0-9]+)") -> DataFrame:
    """The rule that an error text names, whatever its case; else its longest prefix that is a rule family."""
    found = errors.withColumn("_id", F.upper(F.regexp_extract("text", pattern, 1)))
    exact = rules.select(F.upper("rule_id").alias("_id"), "rule_id")
    family = rules.select(F.regexp_extract(F.upper("rule_id"), r"^(.*)-[^-]*$", 1).alias("_f"), "rule_id").groupBy("_f").agg(F.min("rule_id").alias("family_rule"))
    joined = found.join(exact, "_id", "left").withColumn("_f", F.regexp_extract("_id", r"^(.*)-[^-]*$", 1)).join(family, "_f", "left")
    return joined.select(*errors.columns, F.coalesce("rule_id", F.when(F.col("_id") != "", F.col("family_rule"))).alias("rule_id"))


def long_lines(files: DataFrame, id_col: str, text_col: str, limit: int = 120, strings: DataFrame | None = None) -> DataFrame:
    """Lines over the limit that are no comment, import or address; with the ``strings`` of ``flow_facts``, none that a literal stands on."""
    line = F.rtrim("raw")
    split = files.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("at", "raw")).withColumn("raw", line)
    skip = F.ltrim("raw").startswith("#") | F.ltrim("raw").rlike(r"^(import|from)\s") | F.col("raw").rlike(r"https?://")
    found = split.where((F.length("raw") > limit) & ~skip).select(id_col, (F.col("at") + 1).cast("long").alias("line"), F.length("raw").cast("long").alias("length"))
    if strings is None:
        return found
    held = strings.where("kind = 'string'").select(F.col("path").alias(id_col), F.explode(F.sequence("line", "end_line")).alias("line")).distinct()
    return found.join(held, [id_col, "line"], "left_anti")


def feature_envy(accesses: DataFrame, least: int = 6, share: float = 0.6) -> DataFrame:
    """Functions that reach into one other object for most of their accesses."""
    per = accesses.groupBy("fn", "root").agg(F.count("*").alias("n"))
    total = per.groupBy("fn").agg(F.sum("n").cast("long").alias("total"), F.max(F.struct("n", "root")).alias("m"))
    return total.select("fn", F.col("m.root").alias("root"), F.col("m.n").alias("n"), "total").where((F.col("n") >= least) & (F.col("n") / F.col("total") > share))


def coverage_gaps(symbols: DataFrame, covered: DataFrame, least: float = 50.0) -> DataFrame:
    """Files of whose symbols less than ``least`` percent are named in tests."""
    hit = symbols.join(covered.select("name").distinct().withColumn("hit", F.lit(1)), "name", "left")
    g = hit.groupBy("path").agg(F.count("*").alias("symbols"), F.sum(F.coalesce("hit", F.lit(0))).cast("long").alias("named"))
    return g.withColumn("percent", F.floor(100.0 * F.col("named") / F.col("symbols") + 0.5).cast("long")).where(100.0 * F.col("named") / F.col("symbols") < least)


def stale(sources: DataFrame, asof: Column, steps: tuple[tuple[int, str], ...] = ((60, "fresh"), (360, "aging"), (1440, "stale"))) -> DataFrame:
    """How old each source's newest row is, on a ladder of minutes."""
    age = F.floor((F.unix_micros(asof.cast("timestamp")) - F.unix_micros(F.max(F.col("ts").cast("timestamp")))) / 60_000_000).cast("long")
    g = sources.groupBy("platform").agg(age.alias("age_minutes"))
    level = F.lit("dead")
    for minutes, name in reversed(steps):
        level = F.when(F.col("age_minutes") <= minutes, name).otherwise(level)
    return g.withColumn("level", level)


def near_events(findings: DataFrame, events: DataFrame) -> DataFrame:
    """Each denial's path from the latest event of its session at or before it: the two kinds are
    merged in time order per session, so nothing is joined pairwise."""
    e = events.select("session_id", "ts", "seq", F.col("path").alias("event_path"), F.lit(0).alias("kind"))
    f = findings.where(is_in(F.col("decision"), ENFORCEMENT)).select("session_id", "ts", "seq", F.lit(None).cast("string").alias("event_path"), F.lit(1).alias("kind"))
    w = Window.partitionBy("session_id").orderBy("ts", "kind", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return e.union(f).withColumn("near_path", F.last("event_path", ignorenulls=True).over(w)).where("kind = 1").select("seq", "session_id", "near_path")
