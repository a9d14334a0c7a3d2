"""Plans and the proposals made under them: answers and risks of a plan text, and the contract between plan, proposal and changes.

Plans and proposals are JSON texts with a key; observed changes are (key, path) rows. The contract is checked for all keys at
once: what is wrong is rows (key, level, issue, detail), and the outcome one row per key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canonical
from ..functions import text as T

# Prompts of a plan by section, schemas, and words that name invariants (fixed values).
PROMPTS = ("action_definition", "boundary_declaration", "persistence_analysis", "erasure_cost", "displacement_ownership", "preconditions", "execution_constraints", "postconditions", "accountability", "acceptance_criteria", "refusal_conditions", "final_check")
PLAN_SCHEMA, MANIFEST_SCHEMA = "plan-artifact/0", "proposal-manifest/0"
INVARIANTS = ("attribution", "decomposition", "governance", "irreversibility")

PLAN = (
    "struct<schema_id:string,plan_id:string,intent:string,scope_targets:array<string>,expected_changed_paths:array<string>,stop_conditions:array<string>,validation_steps:array<struct<id:string,command:string>>,"
    "risk_routes:array<struct<bucket:string,unit:string,rationale:string,cost_estimate:double>>,confidence:double,generated_by:struct<provider:string,model:string,surface:string,timestamp:string>>"
)
MANIFEST = "struct<schema_id:string,manifest_id:string,plan_id:string,base_sha:string,head_sha:string,changed_paths:array<string>,commands_run:array<string>,test_results:array<struct<command:string,status:string>>>"


def _number(line: Column) -> Column:
    """The number in a heading of a section; null for any other line."""
    return F.when(F.contains(line, F.lit("###")), F.regexp_extract(F.trim(line), r"^\ufeff?###+\s*(\d+)\s*\.", 1).try_cast("int"))


def sections(text: Column) -> Column:
    """(section, answer) of a plan text: what is answered under headings ``### n. title``, in order of lines. Lines, headings
    and parts are each made once."""

    def under(rows: Column, heads: Column) -> Column:
        end = lambda k: F.coalesce(F.get(heads, k + 1)["at"], F.size(rows) + 1)
        made = F.transform(heads, lambda h, k: F.struct(h["section"].alias("section"), answer_text(F.slice(rows, h["at"] + 1, end(k) - h["at"] - 1)).alias("answer")))
        return F.filter(made, lambda m: m["section"].between(1, len(PROMPTS)))

    heads = lambda rows: F.filter(F.transform(rows, lambda line, k: F.struct((k + 1).alias("at"), _number(line).alias("section"))), lambda h: h["section"].isNotNull())
    return T.let(T.lines(F.coalesce(text, F.lit(""))), lambda rows: T.let(heads(rows), lambda found: under(rows, found)))


def answer_text(lines: Column) -> Column:
    """A section's answer: what follows a line ``answer:`` (or all of it), up to a rule, without comments, prompt ids and
    guidance; text after ``answer:`` on its line is the whole answer. Null where nothing is left."""
    marks = lambda line: line.isin("answer:", "**answer:**", "answer") | F.startswith(line, F.lit("answer:"))
    place = lambda rows: F.array_position(F.transform(rows, lambda line: T.let(T.ascii_lower(F.trim(line)), marks)), True).cast("int")
    inline = lambda rows, at: F.when(at > 0, F.trim(F.regexp_extract(F.trim(F.get(rows, at - 1)), r"(?i)^answer:(.*)$", 1))).otherwise(F.lit(""))
    until = lambda rest: T.let(F.array_position(F.transform(rest, lambda line: F.trim(line)), "---").cast("int"), lambda rule: F.when(rule > 0, F.slice(rest, 1, rule - 1)).otherwise(rest))
    kept = lambda rest: F.filter(until(rest), lambda line: ~F.trim(line).rlike(r"(?i)^(<!--.*-->|prompt id:.*|guidance:.*)$"))
    body = lambda rows, at: F.regexp_replace(F.array_join(T.let(F.slice(rows, at + 1, F.size(rows)), kept), "\n"), r"^\s+|\s+$", "")
    answer = lambda rows, at: T.let(inline(rows, at), lambda said: F.when(said != "", said).otherwise(body(rows, at)))
    return T.let(lines, lambda rows: T.let(place(rows), lambda at: T.let(answer(rows, at), lambda said: F.when(said != "", said))))


def answers(texts: DataFrame, key: str = "plan") -> DataFrame:
    """(key, prompt_id, answer, problem) of plan texts, a row per prompt: a section that is missing, empty or there twice has
    a problem instead of an answer. Sections are told apart within the row, so that only they are shuffled, once."""
    found = texts.select(key, sections(F.col("text")).alias("found")).groupBy(key).agg(F.count(F.lit(1)).alias("texts"), F.flatten(F.collect_list("found")).alias("found"))
    said = lambda n: F.transform(F.filter("found", lambda m: m["section"] == n), lambda m: m["answer"])
    prompts = F.array(*[F.struct(F.lit(p).alias("prompt_id"), said(k + 1).alias("said")) for k, p in enumerate(PROMPTS)])
    rows = found.select(key, F.explode_outer(F.flatten(F.array_repeat(prompts, F.col("texts").cast("int")))).alias("p")).select(key, "p.prompt_id", "p.said")
    answer = F.get("said", F.lit(0))
    problem = F.when(F.size("said") == 0, "missing").when(F.size("said") > 1, "duplicate").when(answer.isNull(), "empty")
    return rows.select(key, "prompt_id", F.when(problem.isNull(), answer).alias("answer"), problem.alias("problem"))


def derived_risks(said: DataFrame, key: str = "plan") -> DataFrame:
    """(key, erasure_grade, risk_label, invariants) of answers: the highest grade in the answer on erasure, what that means,
    and the invariants that any answer names."""
    text = F.lower(F.coalesce("answer", F.lit("")))
    grade = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"(?<![a-z0-9_])grade\s*([0-3])(?![a-z0-9_])"), F.lit(1)), lambda g: g.cast("int"))), F.lit(0))
    rows = said.groupBy(key).agg(F.max(F.when(F.col("prompt_id") == "erasure_cost", grade).otherwise(F.lit(0))).alias("erasure_grade"), *[F.bool_or(F.contains(text, F.lit(w))).alias(w) for w in INVARIANTS])
    named = F.concat_ws(",", *[F.when(F.col(w), F.lit(w)) for w in INVARIANTS])
    label = F.when(F.col("erasure_grade") == 3, "mutation_destructive").when(F.col("erasure_grade") > 0, "mutation_non_destructive").otherwise("none")
    return rows.select(key, "erasure_grade", label.alias("risk_label"), named.alias("invariants"))


def secret_like(path: Column) -> Column:
    """Whether a path looks as if it held secrets."""
    low = T.ascii_lower(path)
    return low.rlike(r"\.(pem|key|env)$") | F.contains(low, F.lit("/.env.")) | F.contains(low, F.lit("/secrets/"))


def sensitive(path: Column, control_dir: str | None = None) -> Column:
    """Whether a path is one that steers checks: workflows, the action's definition, or the control folder."""
    control = F.startswith(path, F.lit(f"{control_dir}/")) if control_dir else F.lit(False)
    return F.startswith(path, F.lit(".github/workflows/")) | (path == "action.yml") | control


def stop_reasons(path: Column, control_dir: str | None = None) -> Column:
    """Why a change of a path must stop for a person; empty if it need not."""
    of = lambda part: F.startswith(path, F.lit(f"{control_dir}/{part}"))
    control = F.when(of("schemas/"), "meta_schema_change").when(of("prompts/"), "meta_prompt_change").when(of(""), "meta_registry_change") if control_dir else F.lit(None).cast("string")
    reasons = F.array(F.when(F.startswith(path, F.lit(".github/workflows/")), "touches_github_workflows"), F.when(path == "action.yml", "touches_action_definition"), control, F.when(secret_like(path), "secrets_detected"))
    return F.filter(reasons, lambda r: r.isNotNull())


def normal_paths(paths: Column) -> Column:
    """Paths of a list with slashes, without leading ``./`` and blanks, each once and in order."""
    made = F.transform(F.coalesce(paths, F.array()), lambda p: F.trim(F.regexp_replace(F.replace(p, F.lit("\\"), F.lit("/")), r"^(\./)+", "")))
    return F.array_sort(F.array_distinct(F.filter(made, lambda p: p != "")))


def _rows(frame: DataFrame, key: str, level: str, checks: list[tuple[Column, str]]) -> DataFrame:
    found = F.filter(F.array(*[F.when(F.coalesce(when, F.lit(False)), F.lit(issue)) for when, issue in checks]), lambda i: i.isNotNull())
    return frame.select(key, F.lit(level).alias("level"), F.explode(found).alias("issue"), F.lit(None).cast("string").alias("detail"))


def _named(issue: str):
    return lambda path: F.struct(F.lit(issue).alias("issue"), path.alias("detail"))


def contract_issues(plans: DataFrame, manifests: DataFrame, observed: DataFrame, *, key: str = "key", enforce: bool = False, control_dir: str | None = None) -> DataFrame:
    """(key, level error, warning or stop, issue, detail) of plans (key, json), proposals (key, json) and changes (key, path)."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) < 1
    p = plans.select(key, F.from_json("json", PLAN).alias("p"), canonical.identity_sha256(F.col("json"), "plan_id").alias("hash"))
    m = manifests.select(key, F.from_json("json", MANIFEST).alias("m"), canonical.identity_sha256(F.col("json"), "manifest_id").alias("hash"))
    readable, c = F.col("hash").isNotNull(), F.col
    own = _rows(p, key, "error", [
        (~readable, "plan_unreadable"), (readable & ~c("p.schema_id").eqNullSafe(F.lit(PLAN_SCHEMA)), "plan_schema_mismatch"), (readable & ~c("p.plan_id").eqNullSafe(F.concat(F.lit("plan:"), "hash")), "plan_id_mismatch"),
        (readable & blank(c("p.intent")), "plan_without_intent"), (readable & none("p.scope_targets"), "plan_without_targets"), (F.exists("p.validation_steps", lambda s: blank(s["id"]) | blank(s["command"])), "plan_step_incomplete"),
        (F.exists("p.risk_routes", lambda r: blank(r["bucket"]) | blank(r["unit"]) | blank(r["rationale"]) | r["cost_estimate"].isNull()), "plan_route_incomplete"),
        (readable & (blank(c("p.generated_by.provider")) | blank(c("p.generated_by.model")) | blank(c("p.generated_by.surface")) | blank(c("p.generated_by.timestamp"))), "plan_origin_incomplete"), (~c("p.confidence").between(0, 1), "plan_confidence_out_of_range"),
    ])
    own = own.unionByName(_rows(p, key, "warning", [(readable & none("p.stop_conditions"), "plan_without_stop_conditions")]))
    own = own.unionByName(_rows(m, key, "error", [
        (~readable, "manifest_unreadable"), (readable & ~c("m.schema_id").eqNullSafe(F.lit(MANIFEST_SCHEMA)), "manifest_schema_mismatch"), (readable & ~c("m.manifest_id").eqNullSafe(F.concat(F.lit("manifest:"), "hash")), "manifest_id_mismatch"),
        (readable & blank(c("m.base_sha")), "manifest_without_base"), (readable & blank(c("m.head_sha")), "manifest_without_head"), (readable & none("m.commands_run"), "manifest_without_commands"), (F.exists("m.test_results", lambda t: blank(t["command"]) | blank(t["status"])), "manifest_result_incomplete"),
    ]))
    seen = observed.groupBy(key).agg(normal_paths(F.collect_set("path")).alias("seen"))
    every = plans.select(key).union(manifests.select(key)).union(observed.select(key)).distinct()
    rows = every.join(p.select(key, "p"), key, "left").join(m.select(key, "m"), key, "left").join(seen, key, "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    rows = rows.withColumn("claimed", normal_paths(c("m.changed_paths"))).withColumn("expected", normal_paths(c("p.expected_changed_paths")))
    level = "error" if enforce else "warning"
    both = [_rows(rows, key, "error", [(c("p.plan_id") != c("m.plan_id"), "manifest_of_another_plan")]), _rows(rows, key, level, [(c("p").isNull(), "plan_missing"), (c("m").isNull(), "manifest_missing")])]
    stated = F.size("expected") > 0
    differences = [("observed_not_claimed", F.array_except("seen", "claimed"), F.lit(True)), ("claimed_not_observed", F.array_except("claimed", "seen"), F.lit(True)), ("observed_not_expected", F.array_except("seen", "expected"), stated), ("expected_not_observed", F.array_except("expected", "seen"), stated)]
    named = F.concat(*[F.transform(F.when(when, paths).otherwise(F.array().cast("array<string>")), _named(issue)) for issue, paths, when in differences])
    both.append(rows.select(key, F.lit("warning").alias("level"), F.explode(named).alias("d")).select(key, "level", "d.issue", "d.detail"))
    stops = rows.select(key, F.explode("seen").alias("detail"), F.lit(False).alias("only_claimed"))
    if enforce:
        stops = stops.unionByName(rows.select(key, F.explode(F.array_except("claimed", "seen")).alias("detail"), F.lit(True).alias("only_claimed")))
        both.append(_rows(rows, key, "stop", [(F.size("seen") == 0, "changed_paths_unavailable")]))
    held = ~c("only_claimed") | sensitive(c("detail"), control_dir) | secret_like(c("detail"))
    why = F.concat(stop_reasons(c("detail"), control_dir), F.when(c("only_claimed"), F.array(F.lit("claimed_sensitive_path_unverified"))).otherwise(F.array().cast("array<string>")))
    both.append(stops.where(held).select(key, F.lit("stop").alias("level"), F.explode(why).alias("issue"), "detail"))
    return reduce(DataFrame.unionByName, [own, *both])


def contract_outcomes(issues: DataFrame, keys: DataFrame, *, key: str = "key", enforce: bool = False) -> DataFrame:
    """(key, errors, warnings, stops, manual, failure, exit_code) of all (key) rows: what is wrong decides whether a person must
    approve, what kind of failure it is, and whether the check fails."""
    counted = issues.groupBy(key).agg(*[F.count_if(F.col("level") == level).alias(f"{level}s") for level in ("error", "warning", "stop")], F.bool_or((F.col("level") == "error") & F.col("issue").rlike("schema|unreadable|mismatch|another")).alias("mechanical"))
    rows = keys.select(key).distinct().join(counted, key, "left").fillna(0, ["errors", "warnings", "stops"])
    failure = F.when((F.col("errors") == 0) & (F.col("stops") == 0), "none").when(F.coalesce("mechanical", F.lit(False)), "mechanical").otherwise("unknown")
    violated = (F.col("errors") > 0) | (F.col("stops") > 0)
    return rows.select(key, "errors", "warnings", "stops", (F.col("stops") > 0).alias("manual"), failure.alias("failure"), F.when(F.lit(enforce) & violated, F.lit(2)).otherwise(F.lit(0)).alias("exit_code"))
