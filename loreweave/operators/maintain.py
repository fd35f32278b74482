"""Incremental maintenance: change detection, snapshot sinks, ordered steps with checkpoints."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def diff_sources(live: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """``key, state``: added, changed, removed or unchanged, by ``hash``."""
    joined = live.withColumnRenamed("hash", "_new").join(known.withColumnRenamed("hash", "_old"), key, "full")
    state = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("changed")
    return joined.select(*key, state.alias("state"))


def insert_ignore(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The target and those rows whose key it lacks (one for each key)."""
    return target.unionByName(rows.dropDuplicates(key).join(target.select(*key), key, "left_anti").select(target.columns))


def upsert(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows, and of the target what has no key of theirs."""
    return target.join(rows.select(*key).distinct(), key, "left_anti").select(target.columns).unionByName(rows.dropDuplicates(key).select(target.columns))


def backoff_seconds(failures: Column) -> Column:
    """min(600, 30 * 2^min(failures - 1, 5))."""
    return F.least(F.lit(600.0), 30 * F.pow(F.lit(2.0), F.least(failures - 1, F.lit(5)))).cast("long")


class Snapshots:
    """Tables as numbered snapshot folders with a pointer: prepare, then swap."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self, name: str) -> list[int]:
        base = self._path(f"{self.root}/{name}")
        if not self._fs.exists(base):
            return []
        return sorted(int(s.getPath().getName()[1:]) for s in self._fs.listStatus(base) if s.getPath().getName()[1:].isdigit() and self._fs.exists(self._path(f"{self.root}/{name}/{s.getPath().getName()}/_SUCCESS")))

    def write(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> int:
        """A new snapshot; readers see it only once it is complete."""
        version = (self._versions(name) or [0])[-1] + 1
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.root}/{name}/v{version}")
        return version

    def read(self, name: str) -> DataFrame | None:
        """The newest complete snapshot."""
        versions = self._versions(name)
        return self.spark.read.parquet(f"{self.root}/{name}/v{versions[-1]}") if versions else None

    def replace_sources(self, name: str, rows: DataFrame, key: list[str], changed: DataFrame) -> int:
        """A snapshot in which the rows of changed or removed sources are replaced by ``rows``."""
        old = self.read(name)
        kept = rows if old is None else old.join(changed.select(*key).distinct(), key, "left_anti").select(rows.columns).unionByName(rows)
        return self.write(name, kept)


@dataclass
class Step:
    """A maintenance step: ``run`` returns nothing; ``fingerprint`` says what it would work on."""

    name: str
    run: object
    fingerprint: object
    needs: list[str] = field(default_factory=list)


@dataclass
class Maintenance:
    """Runs steps in order of their needs; keeps what was done, failures and retry times as JSON state."""

    steps: list[Step]
    state: dict = field(default_factory=dict)
    clock: object = time.time

    def tick(self) -> list[tuple[str, str]]:
        """One pass: (step, outcome) of those tried. Steps whose needs are not done wait."""
        out, blocked = [], set()
        for step in self.steps:
            if blocked & set(step.needs):
                blocked.add(step.name)
                out.append((step.name, "blocked"))
                continue
            mark, s = step.fingerprint(), self.state.setdefault(step.name, {})
            if s.get("done") == mark:
                continue
            if s.get("tried") == mark and self.clock() < s.get("retry_at", 0):
                blocked.add(step.name)
                out.append((step.name, "waiting"))
                continue
            failures = s.get("failures", 0) if s.get("tried") == mark else 0
            s["tried"] = mark
            try:
                step.run()
            except Exception as e:
                failures += 1
                s |= {"failures": failures, "retry_at": self.clock() + min(600, 30 * 2 ** min(failures - 1, 5)), "error": str(e)[:500]}
                blocked.add(step.name)
                out.append((step.name, "failed"))
                continue
            if step.fingerprint() != mark:  # changed meanwhile: the result is stale
                blocked.add(step.name)
                out.append((step.name, "changed"))
                continue
            s |= {"done": mark, "failures": 0, "retry_at": 0, "error": ""}
            out.append((step.name, "done"))
        return out

    def dump(self) -> str:
        return json.dumps(self.state, sort_keys=True)

    def load(self, text: str) -> Maintenance:
        self.state = json.loads(text)
        return self


def maintain(spark: SparkSession, root: str, corpus: DataFrame, cfg=None) -> dict[str, int]:
    """Bring the chunk table up to date with the corpus: only changed sources are chunked again."""
    from loreweave.config import Config
    from loreweave.operators.chunk import chunk

    cfg = cfg or Config()
    store = Snapshots(spark, root)
    key = ["source_type", "source_id"]
    params = f"{cfg.chunk_target}:{cfg.chunk_overlap}:{cfg.chunk_max}:{cfg.chunk_strategy}"
    live = corpus.select(*key, F.sha2(F.concat(F.lit(params), F.lit("\0"), F.coalesce("content", F.lit(""))), 256).alias("hash"))
    known = store.read("state")
    diff = diff_sources(live, known if known is not None else live.limit(0), key).persist()
    counts = {r.state: r["count"] for r in diff.groupBy("state").count().collect()}
    if set(counts) - {"unchanged"}:
        changed = diff.filter("state <> 'unchanged'")
        fresh = chunk(corpus.join(diff.filter("state in ('added', 'changed')"), key, "left_semi"), cfg)
        store.replace_sources("chunks", fresh, key, changed)
        store.write("state", live)
    diff.unpersist()
    return counts


def rotated(sources: DataFrame, last: str | None, most: int, key: str = "source_key") -> DataFrame:
    """The next ``most`` sources behind the last one handled, then from the beginning, so that none starves."""
    behind = F.lit(True) if last is None else F.col(key) > last
    return sources.orderBy(~behind, key).limit(most)
