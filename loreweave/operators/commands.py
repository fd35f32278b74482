"""Command pipelines: steps of named table commands that use the results of earlier steps.

``{"steps": [{"id", "command", "input", "forEach", "paginate"}]}``. Values of an
input are literals, ``{"$ref": "step#/field"}`` (a field of the step's only row),
``{"$ref": "step#", "$pluck": "/field"}`` (a field of all its rows, as an array)
or, in a forEach step, ``{"$item": "/field"}``. A command gets one table with a
row for each call and answers all calls in one plan: forEach is a join with it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_STEPS, MOST_CALLS, MOST_PAGE, MOST_PAGED_ROWS = 8, 64, 100, 500
FIELDS = {"id", "command", "input", "forEach", "paginate"}
STEP_ID = re.compile(r"[A-Za-z][A-Za-z0-9_-]{0,31}")
CALL = "call"


class PipelineError(ValueError):
    def __init__(self, code: str, text: str):
        super().__init__(f"{code}: {text}")
        self.code = code


@dataclass(frozen=True)
class Command:
    """``run(calls)`` answers with rows that carry ``call``; a paged one sorts by ``page_order`` and has unique ``id``."""

    run: Callable[[DataFrame], DataFrame]
    writes: bool = False
    page_size: int = 0
    page_order: str = "id"


def _need(ok: bool, text: str, code: str = "invalid_plan") -> None:
    if not ok:
        raise PipelineError(code, text)


def _pointer(raw: object) -> list[str]:
    _need(isinstance(raw, str) and (raw == "" or raw.startswith("/")) and len(raw) <= 512 and not re.search(r"~(?![01])", raw), f"no JSON pointer: {raw!r}")
    return [p.replace("~1", "/").replace("~0", "~") for p in raw.split("/")[1:]]


def _reference(value: dict) -> tuple[str, list[str], list[str] | None]:
    _need(set(value) <= {"$ref", "$pluck"} and isinstance(value.get("$ref"), str) and "#" in value["$ref"], f"no reference: {value}")
    step, _, path = value["$ref"].partition("#")
    return step, _pointer(path), _pointer(value["$pluck"]) if "$pluck" in value else None


def _is(value: object, *marks: str) -> bool:
    return isinstance(value, dict) and any(m in value for m in marks)


def _walk(value, earlier: set[str], looping: bool, depth: int = 0) -> None:
    _need(depth <= 32, "nested deeper than 32")
    if _is(value, "$item"):
        _need(looping and len(value) == 1, "$item stands alone, in a forEach step")
        _pointer(value["$item"])
    elif _is(value, "$ref", "$pluck"):
        _need(_reference(value)[0] in earlier, f"{value} refers to no earlier step")
    elif isinstance(value, dict | list):
        for child in value.values() if isinstance(value, dict) else value:
            _walk(child, earlier, looping, depth + 1)


def plan(definition: dict, commands: dict[str, Command]) -> list[dict]:
    """The checked steps; nothing runs if any of them is wrong."""
    _need(isinstance(definition, dict) and set(definition) == {"steps"}, "a pipeline has steps and nothing else")
    steps = definition["steps"]
    _need(isinstance(steps, list) and 1 <= len(steps) <= MOST_STEPS, f"1 to {MOST_STEPS} steps")
    earlier: set[str] = set()
    for i, s in enumerate(steps):
        _need(isinstance(s, dict) and set(s) <= FIELDS, f"step fields are {sorted(FIELDS)}")
        _need(bool(STEP_ID.fullmatch(str(s.get("id")))) and s["id"] not in earlier, f"step id {s.get('id')!r} is malformed or taken")
        _need(s.get("command") in commands, f"no command {s.get('command')!r}", "unknown_command")
        cmd, loop, paged = commands[s["command"]], s.get("forEach"), s.get("paginate", False)
        _need(isinstance(s.get("input", {}), dict) and isinstance(paged, bool), "input is an object, paginate true or false")
        _need(not (loop and paged), "a step either loops or pages")
        _need(not paged or cmd.page_size > 0, f"{s['command']} has no pages")
        _need(not cmd.writes or (i == len(steps) - 1 and not loop and not paged), "a writing command comes last and runs once")
        if loop:
            _need(_is(loop, "$ref"), "forEach is a reference")
            _walk(loop, earlier, False)
        _walk(s.get("input", {}), earlier, loop is not None)
        earlier.add(s["id"])
    return steps


def _field(df: DataFrame, path: list[str]) -> Column:
    """A column or a field of it; a missing one is an error, a null is a value."""
    _need(bool(path) and path[0] in df.columns, f"no field /{'/'.join(path)}", "missing_reference")
    found = F.col(f"`{path[0]}`")
    kind = df.schema[path[0]].dataType
    for p in path[1:]:
        if kind.typeName() == "array" and p.isdigit():
            found, kind = F.get(found, F.lit(int(p))), kind.elementType
        else:
            _need(kind.typeName() == "struct" and p in kind.names, f"no field /{'/'.join(path)}", "missing_reference")
            found, kind = found.getField(p), kind[p].dataType
    return found


def _column(value, item: DataFrame | None, attach: Callable) -> Column:
    if _is(value, "$item"):
        return _field(item, _pointer(value["$item"]))
    if _is(value, "$ref"):
        return attach(*_reference(value))
    if isinstance(value, dict):
        return F.struct(*[_column(v, item, attach).alias(k) for k, v in value.items()]) if value else F.lit(None)
    if isinstance(value, list):
        return F.array(*[_column(v, item, attach) for v in value])
    return F.lit(value)


def execute(spark: SparkSession, definition: dict, commands: dict[str, Command]) -> tuple[DataFrame, DataFrame]:
    """The last step's table and the trace (id, command, calls). At most 64 calls of reading commands run.

    A writing command is not run: its last step yields the table of its calls
    for approval. A page's rows are counted once before it is read.
    """
    results: dict[str, DataFrame] = {}
    left, trace, out = MOST_CALLS, [], None
    for s in plan(definition, commands):
        cmd, loop = commands[s["command"]], s.get("forEach")
        if loop:
            step, path, _ = _reference(loop)
            item = results[step].drop(CALL)
            if path:
                item = item.select(F.explode(_field(item, path)).alias("value")).select("value.*" if dict(item.select(F.explode(_field(item, path)).alias("v")).dtypes)["v"].startswith("struct") else "value")
            rows = item.limit(left + 1).collect()  # bounded by the calls that are left
            _need(len(rows) <= left, f"more than {MOST_CALLS} calls", "call_limit")
            item = spark.createDataFrame(rows, item.schema)
            base = item.withColumn(CALL, F.monotonically_increasing_id())
        else:
            rows, item, base = [()], None, spark.range(1).select(F.col("id").alias(CALL))
        joined: list[DataFrame] = []

        def attach(step, path, pluck, joined=joined):
            """The value as a column of a one-row table that is joined to the calls."""
            source, name = results[step].drop(CALL), f"_r{len(joined)}"
            if pluck is None:
                some = source.limit(2).select(_field(source, path).alias(name)).collect()
                _need(len(some) == 1, f"{step} has not exactly one row", "missing_reference")
                joined.append(source.select(_field(source, path).alias(name)))
            else:
                _need(not path, "$pluck takes the rows of a step")
                some = source.select(_field(source, pluck).alias(name)).limit(MOST_PAGED_ROWS + 1)
                _need(some.count() <= MOST_PAGED_ROWS, f"{step} has more than {MOST_PAGED_ROWS} rows", "pagination_limit")
                joined.append(some.agg(F.collect_list(name).alias(name)))
            return F.col(name)

        columns = {k: _column(v, item, attach) for k, v in s.get("input", {}).items()}
        calls = base
        for one in joined:
            calls = calls.crossJoin(one)  # one row each
        calls = calls.select(CALL, *[c.alias(k) for k, c in columns.items()])
        if cmd.writes:
            trace.append((s["id"], s["command"], 0))
            out = calls
            continue
        if s.get("paginate"):
            given = s.get("input", {})
            page, size = given.get("page", 1), given.get("size", cmd.page_size)
            _need(isinstance(page, int) and page > 0 and isinstance(size, int) and 0 < size <= MOST_PAGE, "page and size are positive integers")
            answer = cmd.run(calls)
            n, distinct = answer.agg(F.count("*"), F.count_distinct("id")).first()
            _need(n == distinct, "rows repeat over pages", "pagination_inconsistent")
            wanted = max(0, n - (page - 1) * size)
            _need(wanted <= MOST_PAGED_ROWS, f"more than {MOST_PAGED_ROWS} rows", "pagination_limit")
            used = max(1, -(-wanted // size))
            answer = answer.orderBy(cmd.page_order, "id").offset((page - 1) * size)
        else:
            answer, used = cmd.run(calls), len(rows)
        _need(used <= left, f"more than {MOST_CALLS} calls", "call_limit")
        left -= used
        results[s["id"]] = out = answer
        trace.append((s["id"], s["command"], used))
    return out, spark.createDataFrame(trace, "id string, command string, calls int")
