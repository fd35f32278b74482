"""JSON workflows compiled to DataFrame plans.

A definition is ``{"steps": [{"id", "op", "input", ...}], "output": id}``; a
step reads an input table or an earlier step. Everything is checked before any
plan is made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_STEPS = 8
OPS = {"pick": {"fields"}, "filter": {"field", "test", "value"}, "sort": {"field"}, "unique": {"field"}, "join": {"with", "on"}, "replace": {"field", "find", "by"}, "template": {"name", "text"}, "split": {"field", "by"}, "length": {"field"}, "pluck": {"field"}, "limit": {"count"}, "python": {"function"}}
TESTS = {"eq", "ne", "contains", "gt", "lt", "gte", "lte"}


def validate(definition: dict, inputs: set[str]) -> list[dict]:
    """The steps, or an error that names the first thing wrong."""
    steps = definition.get("steps")
    if not isinstance(steps, list) or not steps:
        raise ValueError("a workflow needs steps")
    if len(steps) > MOST_STEPS:
        raise ValueError(f"at most {MOST_STEPS} steps")
    known = set(inputs)
    for s in steps:
        op, name = s.get("op"), s.get("id")
        if op not in OPS:
            raise ValueError(f"unknown operation {op!r}")
        if not name or name in known:
            raise ValueError(f"step id {name!r} is missing or taken")
        if missing := OPS[op] - set(s):
            raise ValueError(f"step {name}: missing {sorted(missing)}")
        for ref in [s.get("input"), *([s["with"]] if op == "join" else [])]:
            if ref not in known:
                raise ValueError(f"step {name}: {ref!r} is no input or earlier step")
        if op == "filter" and s["test"] not in TESTS:
            raise ValueError(f"step {name}: unknown test {s['test']!r}")
        known.add(name)
    if definition.get("output", steps[-1]["id"]) not in known:
        raise ValueError("output is no step")
    return steps


def _step(s: dict, df: DataFrame, tables: dict[str, DataFrame], ordinal: str, functions: dict) -> DataFrame:
    op = s["op"]
    if op == "python":  # S02: a function that the caller has registered, never source text
        out = functions[s["function"]](df)
        if ordinal not in out.columns:
            raise ValueError(f"step {s['id']}: {s['function']} lost the {ordinal} column")
        return out
    for name in [s.get("field"), *s.get("fields", []), *(s["on"] if op == "join" else [])]:
        if name is not None and name.split(".")[0] not in df.columns:
            raise ValueError(f"step {s['id']}: no field {name!r}")
    if op == "pick":
        return df.select(*[F.col(f).alias(f.split(".")[-1]) for f in s["fields"]], ordinal)
    if op == "filter":
        c, v = F.col(s["field"]), F.lit(s["value"])
        return df.filter({"eq": c == v, "ne": ~c.eqNullSafe(v), "contains": F.contains(c.cast("string"), v.cast("string")), "gt": c > v, "lt": c < v, "gte": c >= v, "lte": c <= v}[s["test"]])
    if op == "sort":  # ties keep their order, also when descending
        key = F.desc(s["field"]) if s.get("descending") else F.asc(s["field"])
        return df.withColumn(ordinal, F.row_number().over(Window.orderBy(key, ordinal)).cast("long"))
    if op == "unique":
        return df.withColumn("_n", F.row_number().over(Window.partitionBy(s["field"]).orderBy(ordinal))).filter("_n = 1").drop("_n")
    if op == "join":
        return df.join(tables[s["with"]].drop(ordinal), s["on"], s.get("how", "inner"))
    if op == "replace":
        c = F.col(s["field"])
        if s.get("first"):
            at = F.locate(s["find"], c)
            done = F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), F.lit(s["by"]), F.substring(c, at + len(s["find"]), F.char_length(c)))).otherwise(c)
        else:
            done = F.replace(c, F.lit(s["find"]), F.lit(s["by"]))
        return df.withColumn(s["field"], done)
    if op == "template":
        import re

        parts = [F.coalesce(F.col(p[1:-1]).cast("string"), F.lit("")) if p.startswith("{") else F.lit(p) for p in re.findall(r"\{\w+\}|[^{]+", s["text"])]
        return df.withColumn(s["name"], F.concat(*parts))
    if op == "split":
        return df.withColumn(s["field"], F.split(s["field"], "\\Q" + s["by"] + "\\E", -1))
    if op == "length":
        c = F.col(s["field"])
        return df.withColumn(s.get("name", "length"), F.size(c) if dict(df.dtypes)[s["field"]].startswith("array") else F.char_length(c))
    if op == "pluck":
        return df.select(F.col(s["field"]).alias("value"), ordinal)
    return df.orderBy(ordinal).limit(int(s["count"]))


def compile_workflow(definition: dict, inputs: dict[str, DataFrame], ordinal: str = "ordinal", functions: dict | None = None) -> DataFrame:
    """The output step's table; every input carries ``ordinal``, the order of its rows.

    ``functions``: name -> DataFrame function, for steps with ``op`` python.
    """
    steps = validate(definition, set(inputs))
    for s in steps:
        if s["op"] == "python" and s["function"] not in (functions or {}):
            raise ValueError(f"step {s['id']}: no function {s['function']!r} is registered")
    for name, df in inputs.items():
        if ordinal not in df.columns:
            raise ValueError(f"input {name} has no {ordinal} column")
    tables = dict(inputs)
    for s in steps:
        tables[s["id"]] = _step(s, tables[s["input"]], tables, ordinal, functions or {})
    return tables[definition.get("output", steps[-1]["id"])]
