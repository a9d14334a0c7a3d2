"""Provenance graphs: references, reachability, cycles, scope rules."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cbor_columns as CB
from ..session import shared_folder

#: Frontiers that are kept apart before they are written as one.
UNION_ROUNDS = 16

EDGE_KINDS = ("build_depends", "witness_of", "authority_depends", "mutation_commitment", "cost_displacement")
RISKS = ("read_only", "local_ephemeral", "local_persistent", "external_reversible", "external_irreversible")


def cut(df: DataFrame) -> DataFrame:
    """An eager checkpoint in the session's shared folder; a local one only where none is set on one machine."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def ensure_nodes(known: DataFrame, more: DataFrame) -> DataFrame:
    """Nodes with those of ``more`` that are not known; an id is inserted once."""
    fresh = more.dropDuplicates(["id"]).join(known.select("id"), "id", "left_anti")
    return known.unionByName(fresh)


def of_kind(edges: DataFrame, kind: str) -> DataFrame:
    return edges.where(F.col("kind") == kind)


def missing_references(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, missing, id) of edges whose source, target or witness is no node."""
    ids = nodes.select("id")
    parts = []
    for column in ("src", "dst", "witness_ref"):
        wanted = edges.where(F.col(column).isNotNull()).withColumn("id", F.col(column))
        parts.append(wanted.join(ids, "id", "left_anti").select("src", "dst", F.lit(column).alias("missing"), "id"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def reachable(roots: DataFrame, edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(id, depth) of all nodes that (id) roots reach over (src, dst) edges, cycles included.

    A frontier join per round; nodes that were met are left out, so each node is expanded once. Each round checkpoints its
    own frontier alone; what was met before is their union.
    """
    edges = cut(edges.select("src", "dst").distinct())
    fronts = [cut(roots.select("id").distinct().withColumn("depth", F.lit(0)))]
    for depth in range(1, max_rounds + 1):
        seen = reduce(DataFrame.union, fronts)
        step = fronts[-1].join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        front = cut(step.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)))
        if not front.limit(1).count():
            return seen
        fronts.append(front)
        if len(fronts) > UNION_ROUNDS:  # so that plans stay small however deep a graph is
            fronts = [cut(reduce(DataFrame.union, fronts[:-1])), front]
    raise RuntimeError(f"not all reached in {max_rounds} rounds")


def requires_authority(scope):
    """Scopes other than the pure core and meta scopes need authority."""
    return ~(F.startswith(scope, F.lit("scope:core.pure")) | F.startswith(scope, F.lit("scope:meta.")))


def authority_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (id, scope, is_root) that need authority and that no authority root reaches."""
    reached = reachable(nodes.where("is_root").select("id"), of_kind(edges, "authority_depends"))
    return nodes.where(requires_authority(F.col("scope")) & ~F.col("is_root")).join(reached.select("id"), "id", "left_anti").select("id", "scope")


def cycle_residual(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(id) of the nodes that lie on cycles or between them: what is left when nodes without incoming, and then without
    outgoing edges are peeled until none is. Empty exactly when there is no cycle."""
    left = cut(edges.select("src", "dst").distinct())
    count = left.count()
    for _ in range(max_rounds):
        inner = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        inner = cut(inner.join(inner.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
        after = inner.count()
        if after == count:
            return inner.select(F.col("src").alias("id")).union(inner.select("dst")).distinct()
        left, count = inner, after
    raise RuntimeError(f"not all peeled in {max_rounds} rounds")


def within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges both of whose ends are among (id) nodes."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")


def first_cycle(edges: list[tuple[str, str]]) -> list[str]:
    """The first cycle in node order of a small (residual) edge list, as a closed path; empty without one."""
    after: dict[str, list[str]] = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    done: set[str] = set()
    for start in sorted(after):
        path, on = [], set()
        stack = [(start, iter(sorted(after.get(start, []))))] if start not in done else []
        if stack:
            path, on = [start], {start}
        while stack:
            node, rest = stack[-1]
            nxt = next(rest, None)
            if nxt is None:
                stack.pop()
                done.add(node)
                on.discard(path.pop())
            elif nxt in on:
                return [*path[path.index(nxt) :], nxt]
            elif nxt not in done:
                stack.append((nxt, iter(sorted(after.get(nxt, [])))))
                path.append(nxt)
                on.add(nxt)
    return []


def topological_levels(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(id, level) of an acyclic graph: a node's level is one more than the highest of what points at it."""
    left = cut(edges.select("src", "dst").distinct())
    nodes = cut(left.select(F.col("src").alias("id")).union(left.select("dst")).distinct())
    done = None
    for level in range(max_rounds):
        ready = nodes.join(left.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
        ready = cut(ready.withColumn("level", F.lit(level)))
        if not ready.limit(1).count():
            if nodes.limit(1).count():
                raise ValueError("the graph has a cycle")
            return done if done is not None else ready
        done = ready if done is None else cut(done.unionByName(ready))
        nodes = cut(nodes.join(ready, "id", "left_anti"))
        left = cut(left.join(ready.select(F.col("id").alias("src")), "src", "left_anti"))
    raise RuntimeError("too many levels")


def topological_order(edges: list[tuple[str, str]], nodes: list[str]) -> list[str]:
    """Dependencies first (an edge is (dependency, dependent)), equals in order of name; cycles come last, in order."""
    import heapq

    count = dict.fromkeys(nodes, 0)
    after: dict[str, set[str]] = {n: set() for n in nodes}
    for a, b in edges:
        if b not in after[a]:
            after[a].add(b)
            count[b] += 1
    heap = [n for n in nodes if not count[n]]
    heapq.heapify(heap)
    out = []
    while heap:
        node = heapq.heappop(heap)
        out.append(node)
        for nxt in after[node]:
            count[nxt] -= 1
            if not count[nxt]:
                heapq.heappush(heap, nxt)
    return out + sorted(set(nodes) - set(out))


@dataclass(frozen=True)
class ScopeRule:
    """A rule over scope prefixes; ``least_risk`` narrows mutations to that class and above."""

    from_prefix: str
    to_prefix: str
    kind: str
    allowed: bool = True
    needs_witness: bool = False
    severity: str = "error"
    least_risk: str | None = None


# The default boundary rules, in order of precedence (fixed values).
SCOPE_RULES = (
    ScopeRule("scope:core.pure", "scope:core.pure", "build_depends"),
    ScopeRule("scope:core.pure", "scope:fs.write", "mutation_commitment", needs_witness=True, least_risk="local_persistent"),
    ScopeRule("scope:fs.write", "scope:external.", "mutation_commitment", needs_witness=True),
    ScopeRule("scope:external.", "scope:", "mutation_commitment", needs_witness=True),
    ScopeRule("scope:", "scope:", "witness_of"),
    ScopeRule("scope:", "scope:", "cost_displacement"),
)


def scope_violations(nodes: DataFrame, edges: DataFrame, rules: tuple[ScopeRule, ...] = SCOPE_RULES) -> DataFrame:
    """(src, dst, rule, violation, severity) of edges that break the first rule that applies, or that none applies to.

    The rules are a short literal list, so they become one case expression per edge rather than a join.
    """
    scopes = nodes.select("id", "scope")
    placed = edges.join(scopes.withColumnsRenamed({"id": "src", "scope": "from_scope"}), "src").join(scopes.withColumnsRenamed({"id": "dst", "scope": "to_scope"}), "dst")
    rank = F.array_position(F.array(*[F.lit(r) for r in RISKS]), F.col("risk"))
    first = F.lit(None).cast("int")
    for number in reversed(range(len(rules))):
        rule = rules[number]
        applies = F.startswith("from_scope", F.lit(rule.from_prefix)) & F.startswith("to_scope", F.lit(rule.to_prefix)) & (F.col("kind") == rule.kind)
        if rule.least_risk:
            applies = applies & (rank > RISKS.index(rule.least_risk))
        first = F.when(F.coalesce(applies, F.lit(False)), F.lit(number)).otherwise(first)
    placed = placed.withColumn("rule", first)
    forbidden = F.col("rule").isin(*[k for k, r in enumerate(rules) if not r.allowed]) if any(not r.allowed for r in rules) else F.lit(False)
    witness = F.col("rule").isin(*[k for k, r in enumerate(rules) if r.needs_witness]) & F.col("witness_ref").isNull()
    severity = F.element_at(F.array(*[F.lit(r.severity) for r in rules]), F.col("rule") + 1)
    violation = F.when(F.col("rule").isNull(), "undefined").when(forbidden, "forbidden").when(witness, "missing_witness")
    out = placed.withColumn("violation", violation).where("violation is not null")
    return out.select("src", "dst", "rule", "violation", F.when(F.col("rule").isNull(), "warning").otherwise(severity).alias("severity"))


def unwitnessed_mutations(edges: DataFrame) -> DataFrame:
    """Mutations of persistent effect or more that carry no witness."""
    rank = F.array_position(F.array(*[F.lit(r) for r in RISKS]), F.col("risk"))
    return edges.where((F.col("kind") == "mutation_commitment") & (rank > RISKS.index("local_persistent")) & F.col("witness_ref").isNull())


def mutation_order(edges: DataFrame) -> DataFrame:
    """Mutations numbered along their timeline."""
    mutations = of_kind(edges, "mutation_commitment")
    return mutations.withColumn("place", F.row_number().over(W.partitionBy("timeline").orderBy("seq", "src", "dst")))


def edge_order() -> list[Column]:
    """The canonical order of edges (timeline, seq, src, dst, kind, detail, scope, witness_ref): by timeline and step, then
    by what they join and what they are; no witness comes first."""
    rank = F.array_position(F.array(*[F.lit(k) for k in EDGE_KINDS]), F.col("kind"))
    return [F.col("timeline"), F.col("seq"), F.col("src"), F.col("dst"), rank, F.coalesce("detail", F.lit("")), F.col("scope"), F.col("witness_ref")]


def add_edges(known: DataFrame, more: DataFrame) -> DataFrame:
    """Edges with those of ``more``; an edge that is there in all its columns is not added again."""
    return known.unionByName(more.distinct().join(known.distinct(), [known[c].eqNullSafe(more[c]) for c in known.columns], "left_anti"))


def checked_edges(edges: DataFrame) -> DataFrame:
    """Edges as they may be built: a witness link carries no witness, and a mutation of persistent effect or more must carry
    one; anything else is an error."""
    rank = F.array_position(F.array(*[F.lit(r) for r in RISKS]), F.col("risk"))
    fault = F.when((F.col("kind") == "witness_of") & F.col("witness_ref").isNotNull(), "a witness link carries a witness: ").when((F.col("kind") == "mutation_commitment") & (rank > RISKS.index("local_persistent")) & F.col("witness_ref").isNull(), "a mutation needs a witness: ").when(~F.col("kind").isin(*EDGE_KINDS), "no such kind of edge: ")
    return edges.withColumn("kind", F.when(fault.isNotNull(), F.raise_error(F.concat(fault, F.col("src").cast("string")))).otherwise(F.col("kind")))


#: Domain of node ids; who must match the ids of another system passes its own.
NODE_TAG = "dag_node_v1"


def node_ids(nodes: DataFrame, kind_fields: dict[str, str], tag: str = NODE_TAG) -> DataFrame:
    """Content ids of nodes (type, inputs array of ids, params binary, and the fields of their kind): the digest of the
    canonical CBOR of tag, kind, sorted inputs and parameters. ``kind_fields`` maps fields of the kind to string columns."""
    kind = CB.mapping({"type": CB.text(F.col("type"))} | {name: CB.text(F.col(column)) for name, column in kind_fields.items()})
    said = {"tag": CB.text(F.lit(tag)), "kind": kind, "inputs": CB.array(F.array_sort("inputs")), "params": CB.text(F.lower(F.hex("params")))}
    return nodes.withColumn("node_id", CB.sha256(CB.mapping(said)))


def cycle_paths(edges: DataFrame) -> DataFrame:
    """(component, path) of a cycle in each component that has any: from its smallest node on a cycle along the smallest
    nodes that stay on cycles. What is left after peeling is walked per weak component, in one task each."""
    left = cut(within(edges, cycle_residual(edges)).select(F.col("src").cast("string"), F.col("dst").cast("string")).distinct())
    labels = cut(left.select(F.col("src").alias("id")).union(left.select("dst")).distinct().withColumn("component", F.col("id")))
    both = cut(left.union(left.select("dst", "src")).toDF("a", "b").distinct())
    while True:
        heard = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("heard"))
        step = cut(labels.join(heard, "id", "left").select("id", F.col("component").alias("was"), F.least("component", F.coalesce("heard", "component")).alias("component")))
        if not step.where("component < was").limit(1).count():
            break
        labels = step.select("id", "component")

    def walk(rows: pa.Table) -> pa.Table:
        found = first_cycle(sorted(zip(rows.column("src").to_pylist(), rows.column("dst").to_pylist(), strict=True)))
        return pa.table({"component": rows.column("component")[:1], "path": pa.array([found], pa.list_(pa.string()))})

    grouped = left.join(labels.withColumnRenamed("id", "src"), "src").groupBy("component")
    return grouped.applyInArrow(walk, "component string, path array<string>")


def graph_frame(spark: SparkSession, edges: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(edges, "src string, dst string")
