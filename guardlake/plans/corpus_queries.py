"""Rule, text, detector and calibration queries, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from guardlake.functions import paths as P
from guardlake.operators import calibration as K
from guardlake.operators import detect as D
from guardlake.operators import metrics as M
from guardlake.operators import rules as R
from guardlake.operators.parse import dealt
from guardlake.plans import proxies as X
from guardlake.plans.proxies import HE, HR, RF
from guardlake.sources import traces

ENF = "decision in ('deny', 'block')"


def targets(s, d):
    docs = X.table(s, d, "documents")
    return docs.select("doc_id", F.concat("source", F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"), "source", "lang")


def _records(s, d):
    """Events as maps, the keys of every other one in another order."""
    e = X.hook_events(s, d)
    pairs = [(F.lit(c), F.col(c)) for c in ("session_id", "event_name", "tool_name", "path")]
    flat = lambda p: F.create_map(*(x for kv in p for x in kv))
    return e.select(F.when(F.col("seq") % 2 == 0, flat(pairs)).otherwise(flat(pairs[::-1])).alias("m"))


def _errors():
    """Errors that name a rule in either case, an unknown rule with and without a known beginning, none, and null."""
    texts = (F.concat("rule_id", F.lit(": boom")), F.concat(F.lower("rule_id"), F.lit(":a\nb")), F.lit("py-new-1: x"), F.lit("Odd-Thing: y"), F.lit("no rule here: z"), F.lit(None).cast("string"))
    return F.array(F.get(F.array(*texts), (F.col("k") % 6).cast("int")))


def _input():
    """A call's input in four spellings of two values, told apart by a number."""
    spellings = ('{"a": N, "b": {"c": [1, {"x": 1, "y": 0}], "d": "e"}}', '{"b":{"d":"e","c":[1,{"y":0,"x":1}]},"a":N}', '{"a":N,"b":{"d":"e","c":[1,{"x":1,"y":0}]}}', '{"a":N,"b":{"d":"e","c":[{"x":1,"y":0},1]}}')
    return F.replace(F.get(F.array(*map(F.lit, spellings)), (F.col("k") % 4).cast("int")), F.lit("N"), (F.col("k") % 5).cast("string"))


def _symbols(s, d):
    p = X.table(s, d, "part")
    key = F.col("p_partkey").cast("string")
    return p.select(F.concat(F.lit("sym"), key).alias("name"), F.concat(F.lit("mod."), F.lit("sym"), key).alias("qualname"), F.concat(F.lit("f"), (F.col("p_partkey") % 50).cast("string"), F.lit(".py")).alias("path"), "p_name", "p_size")


def _references(s, d):
    n = F.col("l_suppkey") * 20 + F.col("l_linenumber")
    return X.table(s, d, "lineitem").select(F.concat(F.when(n % 2 == 0, "SYM").otherwise("mod.Sym"), n.cast("string")).alias("token"), F.concat(F.lit("test_"), (F.col("l_suppkey") % 40).cast("string"), F.lit(".py")).alias("test_path"))


SYM = """sym as (select 'sym' || p_partkey as name, 'mod.sym' || p_partkey as qualname, 'f' || (p_partkey % 50) || '.py' as path, p_name from part),
 ref as (select case when (l_suppkey * 20 + l_linenumber) % 2 = 0 then 'SYM' else 'mod.Sym' end || (l_suppkey * 20 + l_linenumber) as token, 'test_' || (l_suppkey % 40) || '.py' as test_path from lineitem)"""


def _sources(s, d):
    """Generated Python files: a function per part whose size, arguments and nesting follow its columns."""
    p = dealt(X.table(s, d, "part").select("p_partkey", "p_size"), "p_partkey")
    args = F.array_join(F.transform(F.sequence(F.lit(0), (F.col("p_size") % 7).cast("int")), lambda i: F.concat(F.lit("a"), i.cast("string"))), ", ")
    body = F.array_join(F.transform(F.sequence(F.lit(1), F.col("p_size").cast("int") + 10), lambda i: F.concat(F.lit("    if a0 > "), i.cast("string"), F.lit(":\n        a0 += "), i.cast("string"))), "\n")
    text = F.concat(F.lit("import os\n\n\ndef fn"), F.col("p_partkey").cast("string"), F.lit("("), args, F.lit("):\n"), body, F.lit("\n    return a0\n"), F.when(F.col("p_partkey") % 97 == 0, "def broken(:\n").otherwise(""))
    return p.select(F.concat(F.lit("src/m"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), text.alias("text"))


def _fires(rule: R.Rule) -> str:
    flags = "(?" + ("" if rule.case_sensitive else "i") + "ms)"
    hit = " or ".join("regexp_matches(text, '" + flags + p.replace("'", "''") + "')" for p in rule.patterns)
    extra = " and source <> 'src1'" if rule.exclude_globs else ""
    return f"select doc_id, '{rule.rule_id}' as rule_id, '{rule.action}' as decision, '{rule.severity}' as severity, '{rule.message}' as message from documents where ({hit}){extra}"


QUERIES = {
    "regex_rule_hits": (lambda s, d: R.evaluate(targets(s, d), R.TEXT_RULES, ("doc_id",)), " union all ".join(map(_fires, R.TEXT_RULES))),
    "glob_filter": (
        lambda s, d: X.hook_events(s, d).where(P.matches_glob(F.col("path"), "*/DIR3/*1?.py") | P.matches_glob(F.col("path"), "f7*.py") | P.matches_glob(F.col("path"), "repo2/dir1/")).groupBy("path").agg(F.count("*").alias("n")),
        f"with {HE} select path, count(*) as n from he where regexp_matches(path, '^.*/dir3/.*1.\\.py$') or regexp_matches(regexp_extract(path, '[^/]*$'), '^f7.*\\.py$') or regexp_matches(path, '(^|/)repo2/dir1/') group by 1",
    ),
    "explorer_glob": (
        lambda s, d: X.hook_events(s, d).where(F.col("path").rlike(P.glob_regex("/home/u/repos/*/dir1/*.py", False))).groupBy("path").agg(F.count("*").alias("n")),
        f"with {HE} select path, count(*) as n from he where regexp_matches(path, '^/home/u/repos/[^/]*/dir1/[^/]*\\.py$') group by 1",
    ),
    "path_query": (
        lambda s, d: M.counts_by(X.hook_events(s, d).where(P.path_query(F.col("path"), ".PY") & P.path_query(F.col("path"), "Dir2")), "path"),
        f"with {HE} select path, count(*) as n from he where ends_with(lower(path), '.py') and contains(lower(path), 'dir2') group by 1",
    ),
    "path_scope": (
        lambda s, d: X.hook_events(s, d).select("seq", P.path_scope(F.concat(F.lit(".//"), F.translate("path", "/", "\\"), F.lit("//"))).alias("scope")),
        f"with {HE} select seq, regexp_replace(substr(path, 1), '^/', '') as scope from he",
    ),
    "language_detect": (
        lambda s, d: M.counts_by(targets(s, d).withColumn("p", F.concat(F.regexp_replace("path", "txt$", ""), F.element_at(F.array(*map(F.lit, ("py", "ts", "rs", "md"))), (F.col("doc_id") % 4 + 1).cast("int")))).select(P.language(F.col("p")).alias("language")), "language"),
        "select case doc_id % 4 when 0 then 'python' when 1 then 'typescript' when 2 then 'rust' end as language, count(*) as n from documents group by 1",
    ),
    "enforcement_modes": (
        lambda s, d: M.counts_by(X.hook_events(s, d).select(R.enforcement_mode(F.col("k") % 5 != 0, F.col("k") % 3 == 0, F.col("k") % 2 == 0).alias("mode")), "mode"),
        f"with {HE} select case when k % 5 = 0 then 'outside' when k % 3 = 0 and k % 2 = 0 then 'strict' else 'relaxed' end as mode, count(*) as n from he group by 1",
    ),
    "tool_intents": (
        lambda s, d: M.counts_by(
            R.intents(X.hook_events(s, d).withColumn("command", F.when(F.col("k") % 3 == 0, "ls -l").when(F.col("k") % 3 == 1, "git status; rm x").otherwise("make"))
                      .withColumn("content", F.lit(None).cast("string"))), "intent", "intent_reason"),
        f"""with {HE}, i as (select *, case when event_name in ('SessionStart', 'SessionEnd', 'Stop', 'SubagentStop', 'UserPromptSubmit', 'PreCompact') then 'lifecycle'
when tool_name = 'Bash' then case k % 3 when 0 then 'list' when 1 then 'mutate' else 'execute' end when tool_name in ('Write', 'Edit') then 'mutate'
when tool_name = 'Read' then 'read' when tool_name = 'Grep' then 'search' when tool_name = 'Glob' then 'list' else 'unknown' end as intent from he)
select intent, case intent when 'lifecycle' then 'lifecycle_event:' || event_name when 'mutate' then 'mutation_evidence:' || tool_name when 'execute' then 'shell_execute:' || tool_name
when 'unknown' then 'unknown_tool_intent' else 'read_only_tool:' || tool_name end as intent_reason, count(*) as n from i group by 1, 2""",
    ),
    "rule_categories": (
        lambda s, d: M.counts_by(X.rule_findings(s, d).select(R.category(F.col("rule_id"), [("R-1", "one"), ("R-", "any")]).alias("category")), "category"),
        f"with {RF} select case when starts_with(rule_id, 'R-1') then 'one' else 'any' end as category, count(*) as n from rf group by 1",
    ),
    "config_overrides": (
        lambda s, d: M.counts_by(R.overridden(X.rule_findings(s, d), s.createDataFrame([("R-1", "warn", None), ("R-2", "critical", None), ("R-3", None, "context")], "rule_id string, severity string, action string")), "rule_id", "decision", "severity"),
        f"""with {RF}, o as (select rule_id, case rule_id when 'R-1' then null when 'R-3' then null else decision end as decision, case rule_id when 'R-1' then 'LOW' when 'R-2' then 'CRITICAL' else severity end as severity from rf)
select rule_id, decision, severity, count(*) as n from o group by 1, 2, 3""",
    ),
    "rule_applicability": (
        lambda s, d: M.counts_by(R.applicable(X.hook_events(s, d).select("seq", "event_name"), s.createDataFrame([("A", True, ["PreToolUse", "PostToolUse"]), ("B", True, ["PreToolUse"]), ("C", False, ["PreToolUse"]), ("D", True, ["SessionStart"])], "rule_id string, enabled boolean, events array<string>"), s.createDataFrame([("B",)], "rule_id string")), "rule_id", "event_name"),
        f"with {HE}, r(rule_id, event_name) as (values ('A', 'PreToolUse'), ('A', 'PostToolUse'), ('D', 'SessionStart')) select rule_id, event_name, count(*) as n from he join r using (event_name) group by 1, 2",
    ),
    "trim_project": (
        lambda s, d: X.table(s, d, "documents").select("doc_id", P.trimmed(F.col("text"), 180).alias("preview")),
        "select doc_id, case when length(text) > 180 then substr(text, 1, 180) || '…[trimmed]' else text end as preview from documents",
    ),
    "tail_n": (
        lambda s, d: traces.capped(X.hook_events(s, d), {e: 600 for e in X.EVENT_NAMES.values()}, "event_name").select("seq", "event_name"),
        f"with {HE} select seq, event_name from (select *, row_number() over (partition by event_name order by seq desc) as p from he) where p <= 600",
    ),
    "exact_dedupe": (
        lambda s, d: traces.deduplicated(_records(s, d)).agg(F.count("*").alias("n")),
        f"with {HE} select count(*) as n from (select distinct session_id, event_name, tool_name, path from he)",
    ),
    "constant_names": (
        lambda s, d: X.table(s, d, "supplier").select("s_suppkey", P.constant_name(F.concat(F.lit("maxRetry "), F.col("s_name"))).alias("name")),
        "select s_suppkey, substr(upper(regexp_replace(regexp_replace(regexp_replace('maxRetry ' || s_name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')), 1, 48) as name from supplier",
    ),
    "last_assistant_turn": (
        lambda s, d: X.table(s, d, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.sha2(F.max_by("text", "turn"), 256).alias("hash")),
        "select conv_id, max(turn) as turn, sha256(arg_max(text, turn)) as hash from conversations where role = 'assistant' group by 1",
    ),
    "duplicate_groups": (
        lambda s, d: D.duplicate_groups(X.table(s, d, "documents"), "doc_id", "text"),
        "select substr(sha256(text), 1, 16) as hash, count(*) as n, min(doc_id) as first_id from documents group by sha256(text) having count(*) > 1",
    ),
    "repeated_blocks": (
        lambda s, d: D.repeated_blocks(X.table(s, d, "documents"), "doc_id", "text"),
        """with l as (select doc_id, unnest(range(0, len(p))) as pos, unnest(p) as raw from (select doc_id, string_split(text, chr(10)) as p from documents)), t as (select doc_id, pos, trim(raw, ' ') as line from l where trim(raw, ' ') <> ''),
w as (select doc_id, line, lead(line, 1) over (partition by doc_id order by pos) as l1, lead(line, 2) over (partition by doc_id order by pos) as l2 from t),
b as (select doc_id, sha256(line || chr(10) || l1 || chr(10) || l2) as block from w where l2 is not null) select block, count(*) as n, count(distinct doc_id) as files from b group by 1 having count(*) >= 2""",
    ),
    "repeated_literals": (
        lambda s, d: D.repeated_literals(X.table(s, d, "documents").select(F.col("doc_id").alias("path"), F.explode(F.split("text", " ")).alias("literal")), 100),
        "with t as (select doc_id as path, unnest(string_split(text, ' ')) as literal from documents) select literal, count(distinct path) as files, count(*) as n, min(path) as first_path from t group by 1 having count(distinct path) > 100",
    ),
    "call_sequences": (
        lambda s, d: D.call_sequences(X.table(s, d, "lineitem").select(F.col("l_orderkey").alias("fn"), F.struct("l_linenumber", "l_partkey").alias("at"), F.concat("l_returnflag", "l_linestatus").alias("name"))),
        "with f as (select l_orderkey as fn, string_agg(l_returnflag || l_linestatus, '>' order by l_linenumber, l_partkey, l_returnflag || l_linestatus) as seq, count(*) as k from lineitem group by 1 having count(*) >= 3) select seq, count(*) as functions, min(fn) as first_fn from f group by 1 having count(*) >= 2",
    ),
    "untested_symbols": (
        lambda s, d: D.untested(_symbols(s, d), _references(s, d)).select("name", "path"),
        f"with {SYM} select name, path from sym where lower(name) not in (select lower(token) from ref) and lower(qualname) not in (select lower(token) from ref)",
    ),
    "unique_callers": (
        lambda s, d: D.unique_callers(X.table(s, d, "customer").select(F.concat(F.lit("c"), (F.col("c_custkey") % 900).cast("string")).alias("name"), F.col("c_name").alias("qualname")), X.table(s, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("name"), F.col("o_orderkey").alias("site"))),
        "with u as (select 'c' || (c_custkey % 900) as name, min(c_name) as qualname from customer group by 1 having count(*) = 1) select name, qualname, callers from u join (select 'c' || o_custkey as name, count(distinct o_orderkey) as callers from orders group by 1) using (name)",
    ),
    "changed_to_tests": (
        lambda s, d: D.changed_to_tests(_symbols(s, d).where("path in ('f4.py', 'f8.py')").select("path"), _symbols(s, d), _references(s, d)),
        f"with {SYM}, h as (select distinct lower(name) as token from sym where path in ('f4.py', 'f8.py')) select test_path, count(distinct lower(token)) as symbols from ref where lower(token) in (select token from h) group by 1",
    ),
    "flat_siblings": (
        lambda s, d: D.flat_siblings(targets(s, d).select(F.concat("source", F.lit("/"), "lang", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))),
        "select source as folder, lang as prefix, count(*) as n from documents group by 1, 2 having count(*) >= 3",
    ),
    "calibration_advisory": (
        lambda s, d: K.advisory(X.rule_findings(s, d), X.hook_results(s, d)),
        f"""with {HR}, sd as (select session_id, coalesce(arg_max(decision, seq) filter ({ENF}), arg_min(decision, seq)) as final from hr group by 1),
p as (select rule_id, session_id, count(*) as n, count(*) filter (coalesce(decision, 'context') in ('warn','context','ask','info')) as w from rf group by 1, 2),
g as (select rule_id, count(*) as sessions, cast(sum(n) as bigint) as total, cast(sum(w) as bigint) as warnings, count(*) filter (w > 0 and coalesce(final not in ('block','deny','ask'), true)) as allow_after_warn from p left join sd using (session_id) group by 1)
select *, cast(least(floor((cast(allow_after_warn as double) / sessions * 60 + cast(warnings as double) / total * 40) * least(sessions / 5.0::double, 1.0) + 0.5), 100) as bigint) as advisory_pressure,
case when sessions >= 8 and total >= 10 then 'high' when sessions >= 3 and total >= 4 then 'medium' else 'low' end as confidence from g""",
    ),
    "calibration_repetition": (
        lambda s, d: K.repetition(X.rule_findings(s, d)),
        f"""with {RF}, p as (select rule_id, session_id, count(*) as n, count(distinct ts) as times from rf group by 1, 2), g as (select rule_id, count(*) as sessions, count(*) filter (times > 1) as repeating, avg(n) as mean from p group by 1)
select rule_id, sessions, repeating, cast(floor(cast(repeating as double) / sessions * (45 + 35 * (1 - exp(-mean / 20.0::double)) + 20 * (1 - exp(-sessions / 20.0::double))) + 0.5) as bigint) as repeat_score from g""",
    ),
    "calibration_errors": (
        lambda s, d: K.error_pressure(X.rule_findings(s, d).select(_errors().alias("errors")), X.rule_findings(s, d)),
        f"""with {RF}, e as (select case k % 6 when 0 then rule_id when 1 then rule_id when 2 then 'PY-NEW-1' when 3 then 'odd-thing' end as rule_id from rf),
n as (select rule_id, count(*) as errors from e where rule_id is not null group by 1),
p as (select rule_id, session_id, count(*) as n, count(distinct ts) as times from rf group by 1, 2), g as (select rule_id, count(*) as sessions, count(*) filter (times > 1) as repeating, avg(n) as mean from p group by 1),
r as (select rule_id, cast(floor(cast(repeating as double) / sessions * (45 + 35 * (1 - exp(-mean / 20.0::double)) + 20 * (1 - exp(-sessions / 20.0::double))) + 0.5) as bigint) as repeat_score from g),
b as (select rule_id, coalesce(errors, 0) as errors, coalesce(repeat_score, 0) as repeat_score from n full join r using (rule_id)),
c as (select *, case when errors > 0 then least(100, 30 + cast(floor((1 - exp(-errors / 5.0::double)) * 70 + 0.5) as bigint)) else 0 end as error_score from b)
select rule_id, errors, error_score, repeat_score, greatest(error_score, repeat_score) as pressure from c""",
    ),
    "calibration_scopes": (
        lambda s, d: X.hook_events(s, d).select("event_name", K.scope_key(F.col("event_name"), F.col("tool_name"), F.lit(None).cast("string"), _input()).alias("scope")).groupBy("event_name").agg(F.count_distinct("scope").alias("scopes")),
        f"with {HE} select event_name, count(distinct (tool_name, k % 5, case when k % 4 = 3 then 1 else 0 end)) as scopes from he group by 1",
    ),
    "calibration_persistence": (
        lambda s, d: K.persistence(X.rule_findings(s, d).withColumn("ts", F.date_trunc("day", "ts")), ["event_name", "tool_name"]),
        f"""with {RF}, p as (select rule_id, event_name, tool_name, date_trunc('day', ts) as ts, count(*) as n from rf group by 1, 2, 3, 4), e as (select rule_id, arg_min(n, ts) as f, arg_max(n, ts) as l, count(*) as k from p group by rule_id, event_name, tool_name having count(*) > 1),
g as (select rule_id, cast(sum(f) as bigint) as first, cast(sum(l) as bigint) as last from e group by 1) select *, cast(floor(least(cast(last as double) / first, 1.0) * 100 + 0.5) as bigint) as persistence from g""",
    ),
    "similar_functions": (
        lambda s, d: D.similar_texts(X.table(s, d, "documents"), "doc_id", "text"),
        r"""with t as (select text, min(doc_id) as id from documents where text is not null group by 1), w as (select id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') as ws from t),
s as (select id, unnest(case when len(ws) >= 5 then list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) else [array_to_string(ws, ' ')] end) as x from w), n as (select id, count(*) as k from s group by 1),
p as (select a.id as a, b.id as b, count(*) as c from s a join s b on a.x = b.x and a.id < b.id group by 1, 2)
select a, b, c / (na.k + nb.k - c) as ratio from p join n na on na.id = a join n nb on nb.id = b where c >= 0.8 * (na.k + nb.k - c)""",
    ),
}
