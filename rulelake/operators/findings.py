"""Findings, the rows that every predicate gives, and rulesets over them."""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import severity_rank

FINDING_SCHEMA = "rule_id string, severity string, invariant string, path string, line int, col int, message string, evidence string"
SEVERITIES = ("info", "warning", "error")


def findings(rows: DataFrame, rule_id: str, *, path: Column, message: Column | str, severity: str = "error", line: Column | None = None, evidence: Column | None = None, invariant: str | None = None) -> DataFrame:
    """One finding per row."""
    return rows.select(
        F.lit(rule_id).alias("rule_id"),
        F.lit(severity).alias("severity"),
        F.lit(invariant).cast("string").alias("invariant"),
        path.cast("string").alias("path"),
        (F.lit(None) if line is None else line).cast("int").alias("line"),
        F.lit(None).cast("int").alias("col"),
        (F.lit(message) if isinstance(message, str) else message).alias("message"),
        (F.lit(None) if evidence is None else evidence).cast("string").alias("evidence"),
    )


def no_findings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FINDING_SCHEMA)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def finding_order() -> list[Column]:
    """The order in which findings are reported."""
    return [F.col("rule_id"), severity_rank(F.col("severity")), F.col("path"), F.coalesce("line", F.lit(0)), F.coalesce("col", F.lit(0)), F.col("message")]


def severity_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(*[F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in SEVERITIES])


def by_file(rows: DataFrame) -> DataFrame:
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("findings"), F.max(severity_rank(F.col("severity"))).alias("worst"))


def invariant_profile(facts: DataFrame) -> DataFrame:
    """Per invariant (constraints with constraint_id, findings without): triggered and found, and the constraints."""
    from ..functions.text import normalize_invariant

    named = facts.where("invariant is not null").withColumn("invariant", normalize_invariant(F.col("invariant")))
    return named.groupBy("invariant").agg(
        F.count_if(F.col("constraint_id").isNotNull()).alias("triggered_count"),
        F.count_if(F.col("constraint_id").isNull()).alias("finding_count"),
        F.array_sort(F.collect_set("constraint_id")).alias("constraint_ids"),
    )


@dataclass(frozen=True)
class PredicateResult:
    """Findings of a predicate, and a one-row (triggered) frame where it is not simply that there are some."""

    findings: DataFrame
    triggered: DataFrame | None = None


@dataclass(frozen=True)
class RowFinding:
    """What a predicate finds in a fact: when, and the finding's columns."""

    when: Column
    rule_id: str
    path: Column
    message: Column | str
    severity: str = "error"
    line: Column | None = None

    def row(self) -> Column:
        none = F.lit(None)
        line, message = none if self.line is None else self.line, F.lit(self.message) if isinstance(self.message, str) else self.message
        values = (F.lit(self.rule_id), F.lit(self.severity), none.cast("string"), self.path.cast("string"), line.cast("int"), none.cast("int"), message, none.cast("string"))
        return F.struct(*[v.alias(part.split()[0]) for v, part in zip(values, FINDING_SCHEMA.split(", "), strict=True)])


class ProviderError(RuntimeError):
    """What a provider can't do: its scope, the phase and why."""

    def __init__(self, scope_id: str, phase: str, message: str):
        super().__init__(f"{scope_id} ({phase}): {message}")
        self.scope_id, self.phase = scope_id, phase


class Provider(ABC):
    """A scope: takes snapshots of its subject as fact tables, and evaluates predicates over facts."""

    scope_id: str
    version: int = 1

    @abstractmethod
    def predicates(self) -> dict[str, Callable[[DataFrame, dict[str, Any]], PredicateResult]]:
        """Predicates by name; each takes the facts and parameters."""

    def row_predicates(self) -> dict[str, Callable[[dict[str, Any]], RowFinding]]:
        """Those predicates that look at one fact at a time, as what they find in it: any number of them is evaluated in one
        pass over the facts. Others, and all that are not named here, go through ``predicates``."""
        return {}

    def describe(self) -> dict[str, Any]:
        schemas = self.param_schemas()
        return {"scope_id": self.scope_id, "version": self.version, "predicates": [{"name": n, "params": schemas.get(n)} for n in sorted(self.predicates())]}

    def snapshot(self, spark: SparkSession, source: Any) -> DataFrame:
        """Facts of what the scope sees."""
        raise ProviderError(self.scope_id, "snapshot", "snapshot not supported")

    def plan(self, intent: dict[str, Any], inputs: list[DataFrame]) -> dict[str, Any]:
        """A plan from an intent and earlier snapshots."""
        raise ProviderError(self.scope_id, "plan", "plan not supported")

    def execute(self, plan_hash: str) -> dict[str, Any]:
        """Carry out the plan of a digest."""
        raise ProviderError(self.scope_id, "execute", "execute not supported")

    def verify(self, artifacts: DataFrame) -> DataFrame:
        """(kind, sha256, ok) of (kind, sha256, content) rows, whose digests are made anew."""
        return artifacts.select("kind", "sha256", (F.sha2(F.col("content").cast("binary"), 256) == F.col("sha256")).alias("ok"))

    def evaluate(self, name: str, facts: DataFrame, params: dict[str, Any]) -> PredicateResult:
        known = self.predicates()
        if name not in known:
            raise ProviderError(self.scope_id, "snapshot", f"predicate {name!r} not supported")
        self.check_params(name, params)
        return known[name](facts, params)

    def param_schemas(self) -> dict[str, dict[str, Any]]:
        """JSON schemas of predicates' parameters by name; a predicate without one takes any."""
        return {}

    def check_params(self, name: str, params: dict[str, Any]) -> None:
        """Hold parameters against their schema: required ones, unknown ones where no more are allowed, and types."""
        schema = self.param_schemas().get(name)
        if schema is None:
            return
        kinds = {"integer": int, "string": str, "array": (list, tuple), "boolean": bool, "number": (int, float), "object": dict}
        known = schema.get("properties", {})
        faults = [f"{p} is missing" for p in schema.get("required", ()) if p not in params]
        faults += [f"{p} is unknown" for p in params if p not in known and not schema.get("additionalProperties", True)]
        faults += [f"{p} is no {known[p]['type']}" for p, v in params.items() if p in known and "type" in known[p] and (not isinstance(v, kinds[known[p]["type"]]) or (known[p]["type"] == "integer" and isinstance(v, bool)))]
        if faults:
            raise ProviderError(self.scope_id, "snapshot", f"{name}: {', '.join(faults)}")


class ProviderRegistry:
    """Providers by scope; a scope is registered once."""

    def __init__(self, providers: list[Provider] | None = None):
        self._by_scope: dict[str, Provider] = {}
        for provider in providers or []:
            self.register(provider)

    def register(self, provider: Provider) -> None:
        if provider.scope_id in self._by_scope:
            raise ValueError(f"scope {provider.scope_id} is registered already")
        self._by_scope[provider.scope_id] = provider

    def get(self, scope_id: str) -> Provider:
        if scope_id not in self._by_scope:
            raise KeyError(f"scope {scope_id} is not registered")
        return self._by_scope[scope_id]

    def scopes(self) -> list[str]:
        return sorted(self._by_scope)

    def pack_hash(self) -> str:
        """A digest of all scopes and predicates that does not depend on the order of registration."""
        import hashlib

        described = [self._by_scope[s].describe() for s in self.scopes()]
        return hashlib.sha256(json.dumps(described, sort_keys=True).encode()).hexdigest()


@dataclass(frozen=True)
class Binding:
    """A rule: a predicate of a scope with parameters, and how severe it is when it triggers."""

    rule_id: str
    severity: str
    scope_id: str
    predicate: str
    params: dict[str, Any] = field(default_factory=dict)

    def order(self) -> tuple:
        return self.rule_id, SEVERITIES.index(self.severity), self.scope_id, self.predicate, json.dumps(self.params, sort_keys=True, default=str)


@dataclass(frozen=True)
class RuleSet:
    ruleset_id: str
    bindings: tuple[Binding, ...]
    enabled_rules: tuple[str, ...] = ()
    fail_on: str = "error"

    def selected(self) -> list[Binding]:
        """Enabled bindings (all, where none are named) in order of evaluation."""
        return sorted((b for b in self.bindings if not self.enabled_rules or b.rule_id in self.enabled_rules), key=Binding.order)

    @classmethod
    def from_json(cls, text: str) -> RuleSet:
        raw = json.loads(text)
        bindings = tuple(Binding(b["rule_id"], b["severity"], b["when"]["scope_id"], b["when"]["predicate"], b["when"].get("params") or {}) for b in raw["bindings"])
        return cls(raw["ruleset_id"], bindings, tuple(raw.get("enabled_rules") or ()), raw.get("fail_on", "error"))


@dataclass(frozen=True)
class RulesetOutcome:
    """Findings with the binding they belong to, one result row per binding, and the verdict row."""

    findings: DataFrame
    rule_results: DataFrame
    verdict: DataFrame


def evaluate_ruleset(spark: SparkSession, ruleset: RuleSet, registry: ProviderRegistry, bundles: dict[str, DataFrame], overlays: dict[str, dict[str, Any]] | None = None) -> RulesetOutcome:
    """Evaluate the selected bindings over the fact tables of their scopes.

    Overlays by rule id win over a binding's own parameters. The verdict is inadmissible if a triggered binding, or any
    single finding, is as severe as ``fail_on``.
    """
    parts, triggers, heads = [], [], []
    together: dict[str, list[Column]] = {}
    for number, binding in enumerate(ruleset.selected()):
        params = binding.params | (overlays or {}).get(binding.rule_id, {})
        facts = bundles.get(binding.scope_id, no_findings(spark))
        provider = registry.get(binding.scope_id)
        if binding.scope_id in bundles and binding.predicate in provider.row_predicates():
            provider.check_params(binding.predicate, params)
            found = provider.row_predicates()[binding.predicate](params)
            together.setdefault(binding.scope_id, []).append(F.when(found.when, F.struct(F.lit(number).alias("binding"), found.row().alias("finding"))))
            heads.append((number, binding.rule_id, binding.severity, binding.scope_id, binding.predicate))
            continue
        result = provider.evaluate(binding.predicate, facts, params)
        parts.append(result.findings.withColumn("binding", F.lit(number)))
        if result.triggered is not None:
            triggers.append(result.triggered.select(F.lit(number).alias("binding"), F.col("triggered").alias("own")))
        heads.append((number, binding.rule_id, binding.severity, binding.scope_id, binding.predicate))
    for scope_id, found in together.items():  # one pass over the facts of a scope
        rows = bundles[scope_id].select(F.explode(F.filter(F.array(*found), lambda f: f.isNotNull())).alias("f"))
        parts.append(rows.select("f.finding.*", F.col("f.binding").alias("binding")))
    schema = "binding int, rule_id string, severity string, scope_id string, predicate string"
    found = union(parts) if parts else no_findings(spark).withColumn("binding", F.lit(0))
    counted = found.groupBy("binding").agg(F.count(F.lit(1)).alias("n"), F.max(severity_rank(F.col("severity"))).alias("worst"))
    results = spark.createDataFrame(heads, schema).join(counted, "binding", "left")
    own = union(triggers) if triggers else spark.createDataFrame([], "binding int, own boolean")
    results = results.join(own, "binding", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    results = results.withColumn("triggered", F.coalesce("own", F.col("n") > 0))
    least = SEVERITIES.index(ruleset.fail_on)
    fails = (F.col("triggered") & (severity_rank(F.col("severity")) >= least)) | (F.coalesce("worst", F.lit(-1)) >= least)
    verdict = results.agg(F.coalesce(F.bool_or(fails), F.lit(False)).alias("failed"), F.sum("n").cast("long").alias("findings"))
    verdict = verdict.select(
        F.lit(ruleset.ruleset_id).alias("ruleset_id"),
        F.when(F.col("failed"), "inadmissible").otherwise("admissible").alias("verdict"),
        F.concat(F.lit(f"ruleset {ruleset.ruleset_id} "), F.when(F.col("failed"), "failed").otherwise("passed")).alias("reason"),
        F.coalesce("findings", F.lit(0)).alias("findings"),
    )
    rows = results.select("rule_id", "severity", "triggered", F.col("n").alias("findings_count"), "scope_id", "predicate")
    return RulesetOutcome(found, rows, verdict)


def scope_rules(spark: SparkSession, ruleset: RuleSet) -> DataFrame:
    """Scopes with their distinct rules in order."""
    rows = spark.createDataFrame([(b.scope_id, b.rule_id) for b in ruleset.selected()], "scope_id string, rule_id string")
    return rows.groupBy("scope_id").agg(F.array_sort(F.collect_set("rule_id")).alias("rules"))
