"""Exact numbers with units: rationals as numerator and denominator columns, and a calculator over them."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let

MOST, LEAST = 2**63 - 1, -(2**63)


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor by Euclid's steps, of which there are at most five for each digit of the smaller number, and one
    to put the larger first. Numbers that fit 63 bits are divided as such, only others as decimals."""

    def euclid(p: Column, kind: str) -> Column:
        start = F.struct(p["x"].cast(kind).alias("x"), p["y"].cast(kind).alias("y"))
        step = lambda s, _: F.struct(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).alias("x"), F.when(s["y"] == 0, s["y"]).otherwise((s["x"] % s["y"]).cast(kind)).alias("y"))
        steps = F.sequence(F.lit(1), 5 * F.length(F.least(p["x"], p["y"]).cast("string")) + 1)
        return F.aggregate(steps, start, step, lambda s: s["x"].cast("decimal(38,0)"))

    pair = F.struct(F.abs(a).cast("decimal(38,0)").alias("x"), F.abs(b).cast("decimal(38,0)").alias("y"))
    return let(pair, lambda p: F.when((p["x"] <= MOST) & (p["y"] <= MOST), euclid(p, "long")).otherwise(euclid(p, "decimal(38,0)")))


def rational(num: Column, den: Column) -> Column:
    """Lowest terms with a positive denominator; a zero denominator or an overflow of 64 bits is an error."""
    whole = "decimal(38,0)"

    def lowest(p: Column) -> Column:
        divisor = F.when(p["d"] == 0, F.raise_error(F.lit("division by zero")).cast(whole)).otherwise(F.greatest(gcd(p["n"], p["d"]), F.lit(1).cast(whole)))
        return F.struct(p["n"].alias("n"), p["d"].alias("d"), divisor.alias("g"), F.when(p["d"] < 0, F.lit(-1)).otherwise(F.lit(1)).alias("sign"))

    def guarded(p: Column) -> Column:
        fits = (p["num"] <= MOST) & (p["num"] >= LEAST) & (p["den"] <= MOST)
        return F.struct(F.when(fits, p["num"]).otherwise(F.raise_error(F.lit("number exceeds 64 bits")).cast(whole)).alias("num"), p["den"].alias("den"))

    pair = F.struct(num.cast(whole).alias("n"), den.cast(whole).alias("d"))
    reduced = lambda p: F.struct((p["n"] * p["sign"] / p["g"]).cast(whole).alias("num"), (p["d"] * p["sign"] / p["g"]).cast(whole).alias("den"))
    return let(let(let(pair, lowest), reduced), guarded)


def _both(a: Column, b: Column, use: Callable[[Column, Column], Column]) -> Column:
    return let(F.struct(a.alias("a"), b.alias("b")), lambda p: use(p["a"], p["b"]))


def add(a: Column, b: Column) -> Column:
    return _both(a, b, lambda x, y: rational(x["num"] * y["den"] + y["num"] * x["den"], x["den"] * y["den"]))


def subtract(a: Column, b: Column) -> Column:
    return _both(a, b, lambda x, y: rational(x["num"] * y["den"] - y["num"] * x["den"], x["den"] * y["den"]))


def multiply(a: Column, b: Column) -> Column:
    return _both(a, b, lambda x, y: rational(x["num"] * y["num"], x["den"] * y["den"]))


def divide(a: Column, b: Column) -> Column:
    return _both(a, b, lambda x, y: rational(x["num"] * y["den"], x["den"] * y["num"]))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1."""
    return F.signum(a["num"] * b["den"] - b["num"] * a["den"]).cast("int")


class CalcError(ValueError):
    """An expression that has no value."""


@dataclass(frozen=True)
class Amount:
    """An exact value with a unit, or without."""

    value: Fraction
    unit: str | None = None

    def checked(self) -> Amount:
        if not (LEAST <= self.value.numerator <= MOST and self.value.denominator <= MOST):
            raise CalcError("number exceeds 64 bits")
        return self

    def _same(self, other: Amount, what: str) -> None:
        if self.unit != other.unit:
            raise CalcError(f"{what} needs equal units, not {self.unit} and {other.unit}")

    def __add__(self, other: Amount) -> Amount:
        self._same(other, "add")
        return Amount(self.value + other.value, self.unit).checked()

    def __sub__(self, other: Amount) -> Amount:
        self._same(other, "subtract")
        return Amount(self.value - other.value, self.unit).checked()

    def __mul__(self, other: Amount) -> Amount:
        if self.unit and other.unit:
            raise CalcError("multiply takes one unit at most")
        return Amount(self.value * other.value, self.unit or other.unit).checked()

    def __truediv__(self, other: Amount) -> Amount:
        if other.unit:
            raise CalcError("divide takes a divisor without unit")
        if not other.value:
            raise CalcError("division by zero")
        return Amount(self.value / other.value, self.unit).checked()

    def compare(self, other: Amount, op: str) -> bool:
        self._same(other, "compare")
        a, b = self.value, other.value
        return {"eq": a == b, "neq": a != b, "gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b}[op]


def evaluate(expr: dict, inputs: dict[str, Amount], rates: dict[tuple[str, str], Fraction] | None = None, trace: list | None = None) -> Amount | bool:
    """The value of an expression tree of literal, input_ref, add, subtract, multiply, divide, compare and convert_unit
    nodes; ``trace`` gets (operation, result) in order of evaluation."""
    op = expr["op"]
    if op == "literal":
        out = Amount(Fraction(str(expr["value"])), expr.get("unit")).checked()
    elif op == "input_ref":
        if expr["name"] not in inputs:
            raise CalcError(f"no input {expr['name']}")
        out = inputs[expr["name"]]
    elif op == "convert_unit":
        value = evaluate(expr["value"], inputs, rates, trace)
        rate = (rates or {}).get((value.unit, expr["to"]))
        if value.unit == expr["to"]:
            rate = Fraction(1)
        if rate is None:
            raise CalcError(f"no rate from {value.unit} to {expr['to']}")
        out = Amount(value.value * rate, expr["to"]).checked()
    else:
        a, b = (evaluate(expr[side], inputs, rates, trace) for side in ("left", "right"))
        if op == "compare":
            out = a.compare(b, expr["cmp"])
        elif op in ("add", "subtract", "multiply", "divide"):
            out = {"add": a.__add__, "subtract": a.__sub__, "multiply": a.__mul__, "divide": a.__truediv__}[op](b)
        else:
            raise CalcError(f"no operation {op}")
    if trace is not None:
        trace.append((op, out))
    return out


def compiled(expr: dict, inputs: dict[str, Column]) -> Column:
    """The same tree, without units, as a column of rationals (or of booleans for a comparison)."""
    op = expr["op"]
    if op == "literal":
        value = Fraction(str(expr["value"]))
        return F.struct(F.lit(value.numerator).cast("decimal(38,0)").alias("num"), F.lit(value.denominator).cast("decimal(38,0)").alias("den"))
    if op == "input_ref":
        return inputs[expr["name"]]
    a, b = compiled(expr["left"], inputs), compiled(expr["right"], inputs)
    if op == "compare":
        c = compare(a, b)
        return {"eq": c == 0, "neq": c != 0, "gt": c > 0, "gte": c >= 0, "lt": c < 0, "lte": c <= 0}[expr["cmp"]]
    return {"add": add, "subtract": subtract, "multiply": multiply, "divide": divide}[op](a, b)


def inputs_of(expr: dict) -> list[str]:
    """Names of the inputs of an expression, each once, in order."""
    if expr["op"] == "input_ref":
        return [expr["name"]]
    return sorted({n for side in ("left", "right", "value") if isinstance(expr.get(side), dict) for n in inputs_of(expr[side])})


def plan(expr: dict) -> dict:
    """A calculation's plan: its expression, its inputs, and the digest of both as canonical JSON."""
    made = {"expr": expr, "inputs": inputs_of(expr)}
    return made | {"plan_hash": hashlib.sha256(json.dumps(made, sort_keys=True, separators=(",", ":")).encode()).hexdigest()}


SIGNS = {"add": "+", "subtract": "-", "multiply": "*", "divide": "/", "eq": "==", "neq": "!=", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}


def describe(expr: dict) -> str:
    """An expression as it is usually written."""
    op = expr["op"]
    if op == "literal":
        return f"{expr['value']} {expr['unit']}" if expr.get("unit") else str(expr["value"])
    if op == "input_ref":
        return expr["name"]
    if op == "convert_unit":
        return f"convert({describe(expr['value'])} to {expr['to']})"
    return f"({describe(expr['left'])} {SIGNS[expr['cmp'] if op == 'compare' else op]} {describe(expr['right'])})"


def traces_of(rows: DataFrame, expr: dict, id_col: str, inputs: list[str]) -> DataFrame:
    """(id, step, op, value) of an expression for each row: what every operation gave, in order of evaluation. A row without a
    value ends with a step ``error`` that says why."""
    import pyarrow as pa

    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = []
            for k, key in enumerate(batch.column(0).to_pylist()):
                trace: list = []
                try:
                    evaluate(expr, {n: Amount(Fraction(batch.column(n)[k].as_py())) for n in inputs}, trace=trace)
                    said = [(op, str(v.value) if isinstance(v, Amount) else str(v).lower()) for op, v in trace]
                except (CalcError, TypeError) as error:
                    said = [("error", str(error))]
                out += [(key, step, *one) for step, one in enumerate(said)]
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())], [id_col, "step", "op", "value"])

    return rows.select(id_col, *inputs).mapInArrow(run, f"`{id_col}` {kind}, step int, op string, value string")


def amounts_of(rows: DataFrame, operations: tuple[str, ...]) -> DataFrame:
    """(op, unit, num, den, error) of whole amounts (a, ua, b, ub) by operations: sums and differences need equal units, a product
    takes one unit at most, a divisor none. What units refuse has the error ``unit``, and a division by 0 ``zero``."""
    same, either, op = F.col("ua").eqNullSafe(F.col("ub")), F.coalesce("ua", "ub"), F.col("op")
    fits = F.when(op.isin("add", "subtract"), same).when(op == "multiply", F.col("ua").isNull() | F.col("ub").isNull()).otherwise(F.col("ub").isNull())
    error = F.when(~fits, "unit").when((op == "divide") & (F.col("b") == 0), "zero")
    a, b = F.col("a").cast("decimal(38,0)"), F.col("b").cast("decimal(38,0)")
    above = F.when(op == "add", a + b).when(op == "subtract", a - b).when(op == "multiply", a * b).otherwise(a)
    made = rows.withColumn("op", F.explode(F.array(*[F.lit(o) for o in operations]))).withColumn("error", error)
    made = made.withColumn("value", F.when(F.col("error").isNull(), rational(above, F.when(op == "divide", b).otherwise(F.lit(1)))))
    unit = F.when(F.col("error").isNull(), F.when(op == "multiply", either).otherwise(F.col("ua")))
    return made.select("op", unit.alias("unit"), F.col("value.num").cast("long").alias("num"), F.col("value.den").cast("long").alias("den"), "error")


def lowest_terms(num: int, den: int) -> tuple[int, int]:
    divisor = math.gcd(num, den) or 1
    return num // divisor, den // divisor
