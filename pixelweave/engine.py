"""The engine's public face: register pipelines, submit images, run what was submitted, read the board.

A pipeline is a folder of any file system that Spark reaches: an append-only log of submissions with a running number each, and, per run, the board's rows and what the run left
over for the next. Nothing of it is in a session's memory alone, so a new session goes on where another ended.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.plans.plan import Plan, ScopeError, load
from pixelweave.session import ship
from pixelweave.streaming import scopes

LOG = f"{scopes.SUBMISSIONS}, priority int"
#: States of the board: submitted; in a run that hasn't ended; run; run without a result; taken off before it ran.
STATES = ("queued", "running", "done", "failed", "cancelled")


class Folder:
    """Small files in a folder of any file system, by way of Spark's own."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, str(path).rstrip("/")
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def write(self, name: str, text: str, replace: bool = False) -> bool:
        """Writes a file whole or not at all; False if there is one already and it isn't to be replaced."""
        if not replace:
            try:  # whoever creates this file first has the name
                self.fs.create(self._at(f"claims/{name}"), False).close()
            except Py4JJavaError as e:
                if "exist" in str(e.java_exception).lower():
                    return False
                raise
        aside = self._at(f"claims/{uuid.uuid4().hex}")
        out = self.fs.create(aside, True)
        out.write(bytearray(text.encode()))
        out.close()
        target = self._at(name)
        self.fs.mkdirs(target.getParent())
        if replace:
            self.fs.delete(target, False)
        return self.fs.rename(aside, target)

    def names(self, folder: str) -> list[str]:
        place = self._at(folder)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(place)) if self.fs.exists(place) else []

    def read(self, name: str) -> str | None:
        return self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()["value"] if self.fs.exists(self._at(name)) else None


class Pipeline:
    """One registered pipeline: its plan, its steps and its folder."""

    def __init__(self, spark: SparkSession, name: str, plan: Plan, path: str, steps: dict[str, scopes.Run]):
        self.spark, self.name, self.plan, self.steps, self.lock = spark, name, plan, steps, threading.Lock()
        self.folder = Folder(spark, path)
        scopes.Runner(plan, steps).check()
        numbers = [int(x.removesuffix(".json")) for x in self.folder.names("log")]
        self.jobs = max(numbers, default=0)
        seen = self.log().select(F.explode(F.map_keys("scope")).alias("k")).distinct().collect() if numbers else []
        self.seen = {r["k"] for r in seen}

    def log(self) -> DataFrame:
        if not self.folder.names("log"):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).json(f"{self.folder.path}/log")

    def runs(self) -> list[dict]:
        """Runs that ended, in order: number, first and last job."""
        return [json.loads(self.folder.read(f"runs/{x}")) for x in self.folder.names("runs") if x.endswith(".end.json")]

    def check(self, complete: list[str], scope: dict[str, str]) -> None:
        for level in complete:
            if level not in scope and level in self.seen and level in self.plan.scopes:
                raise ScopeError(f"closing {level} without naming it would close every {level} at once")

    def board(self) -> DataFrame:
        """Rows of all runs, and one for each image that no run has taken yet."""
        ended = self.runs()
        out = self.spark.createDataFrame([], scopes.BOARD)
        for run in ended:
            out = out.unionByName(self.spark.read.schema(scopes.BOARD).parquet(f"{self.folder.path}/board/{run['number']:06d}"))
        done = max((r["last"] for r in ended), default=0)
        begun = [json.loads(self.folder.read(f"runs/{x}")) for x in self.folder.names("runs") if x.endswith(".begin.json")]
        until = max((r["last"] for r in begun if r["alive"]), default=0)
        cancelled = json.loads(self.folder.read("cancelled.json") or '{"ranges": []}')["ranges"]
        state = F.when(F.col("job") <= until, F.lit("running")).otherwise(F.lit("queued"))
        for low, high in cancelled:
            state = F.when(F.col("job").between(low, high), F.lit("cancelled")).otherwise(state)
        rest = self.log().where(F.col("job") > done)
        for low, high in cancelled:  # a later run passes over them
            rest = rest.unionByName(self.log().where(F.col("job").between(low, high) & (F.col("job") <= done)))
        empty = self.spark.createDataFrame([], scopes.BOARD)
        return out.unionByName(rest.select("job", F.col("scope").alias("unit"), state.alias("state"), F.array("job").alias("jobs"), F.lit(1).alias("n_inputs")).unionByName(empty, allowMissingColumns=True), allowMissingColumns=True)


class Engine:
    """Registers pipelines on a session. Leaving its block shuts it down."""

    def __init__(self, spark: SparkSession, folder: str):
        ship(spark)
        self.spark, self.folder, self.pipelines, self.closed = spark, str(folder), {}, False
        self.lock = threading.Lock()

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, kind: type | None, *_: object) -> None:
        self.shutdown(wait=kind is None)

    def register(self, name: str, plan: Plan | str, steps: dict[str, scopes.Run] | None = None) -> Pipeline:
        """Adds a pipeline and keeps a copy of its plan; a name is taken once. ``steps``: run(data, state, **params) by name; without any, the examples'."""
        with self.lock:
            if self.closed:
                raise RuntimeError("the engine is shut down")
            if name in self.pipelines:
                raise ValueError(f"{name} is registered already")
            plan = plan if isinstance(plan, Plan) else load(plan, self.spark)
            p = Pipeline(self.spark, name, plan, f"{self.folder}/{name}", scopes.examples(plan) if steps is None else steps)
            copy = {"name": plan.name, "levels": plan.levels, "metadata": plan.metadata, "phases": [{"scope": x.scope, "steps": [[s.name, s.params, s.max_workers] for s in x.steps]} for x in plan.phases]}
            p.folder.write("plan.json", json.dumps(copy, default=str), replace=True)
            self.pipelines[name] = p
        self._record(p, "register", steps=[s.name for x in plan.phases for s in x.steps])
        return p

    def _of(self, name: str) -> Pipeline:
        if name not in self.pipelines:
            raise KeyError(name)
        return self.pipelines[name]

    def submit(self, name: str, data: Any, scope: dict[str, Any] | None = None, priority: int = 0, complete: str | list[str] | None = None) -> int:
        """Appends one image to the log, with what it completes; returns its number. A refused close submits nothing. Data is a JSON object; a number is its value."""
        p = self._of(name)
        scope = {k: str(v) for k, v in (scope or {}).items()}
        levels = [complete] if isinstance(complete, str) else list(complete or [])
        text = json.dumps(data if isinstance(data, dict) else {"value": float(data)})
        with p.lock:
            p.check(levels, scope)
            row = {"scope": scope, "data": text, "complete": levels, "priority": priority}
            while True:  # other sessions may have numbers of their own
                p.jobs += 1
                if p.folder.write(f"log/{p.jobs:012d}.json", json.dumps({"job": p.jobs} | row) + "\n"):
                    break
            p.seen |= scope.keys()
            job = p.jobs
        self._record(p, "submit", job=job, complete=levels)
        return job

    def log(self, name: str) -> DataFrame:
        return self._of(name).log()

    def run(self, name: str) -> int:
        """Runs what was submitted since the last run, and returns how many images that were. Rows and left-overs are written before the run counts as ended."""
        p = self._of(name)
        with p.lock:
            ended = p.runs()
            number, done = len(ended), max((r["last"] for r in ended), default=0)
            last = p.jobs
            if last <= done:
                return 0
            span = {"number": number, "first": done + 1, "last": last}
            p.folder.write(f"runs/{number:06d}.begin.json", json.dumps(span | {"alive": True}), replace=True)
            left = None
            if number:
                before = f"{p.folder.path}/left/{number - 1:06d}"
                left = scopes.Left(self.spark.read.schema(scopes.ITEMS).parquet(f"{before}/items"), self.spark.read.schema(scopes.OPEN).parquet(f"{before}/opened"))
            log = p.log().where(F.col("job").between(done + 1, last))
            for low, high in json.loads(p.folder.read("cancelled.json") or '{"ranges": []}')["ranges"]:
                log = log.where(~F.col("job").between(low, high))
            try:
                rows, left = scopes.advance(log.drop("priority"), p.plan, p.steps, left)
                rows.write.mode("overwrite").parquet(f"{p.folder.path}/board/{number:06d}")
                left.items.write.mode("overwrite").parquet(f"{p.folder.path}/left/{number:06d}/items")
                left.opened.write.mode("overwrite").parquet(f"{p.folder.path}/left/{number:06d}/opened")
                p.folder.write(f"runs/{number:06d}.end.json", json.dumps(span), replace=True)
            finally:
                p.folder.write(f"runs/{number:06d}.begin.json", json.dumps(span | {"alive": False}), replace=True)
        self._record(p, "end", first=done + 1, last=last)
        return last - done

    def board(self, name: str) -> DataFrame:
        """A row per image and per closed unit, with its state."""
        return self._of(name).board()

    def results(self, name: str, level: str | None = None) -> DataFrame:
        """Units and results of a level, or of the images; nothing is read before the frame is."""
        return self.board(name).where(F.col("level").eqNullSafe(F.lit(level)) & (F.col("state") == "done")).select("job", "unit", "result")

    def pending(self, name: str) -> DataFrame:
        """The log in the order in which images would run: highest priority first, then first come."""
        return self.log(name).orderBy(F.desc("priority"), "job")

    def tallies(self, name: str) -> DataFrame:
        return self.board(name).groupBy("state").agg(F.count(F.lit(1)).alias("n"))

    def status(self, name: str | None = None) -> dict[str, dict[str, int]]:
        """Numbers of rows by state, of one pipeline or of all."""
        names = [name] if name else list(self.pipelines)
        return {n: {s: 0 for s in STATES} | {r["state"]: r["n"] for r in self.tallies(n).collect()} for n in names}

    def deregister(self, name: str, wait: bool = True) -> DataFrame:
        """Takes a pipeline off and returns its final board: what is still queued is run first, or, without waiting, cancelled."""
        p = self._of(name)
        if wait:
            self.run(name)
        else:
            done = max((r["last"] for r in p.runs()), default=0)
            if p.jobs > done:
                ranges = json.loads(p.folder.read("cancelled.json") or '{"ranges": []}')["ranges"]
                p.folder.write("cancelled.json", json.dumps({"ranges": [*ranges, [done + 1, p.jobs]]}), replace=True)
        self._record(p, "deregister", wait=wait)
        with self.lock:
            del self.pipelines[name]
        return p.board()

    def shutdown(self, wait: bool = True) -> dict[str, DataFrame]:
        """Takes all pipelines off; their final boards. Nothing is registered afterwards."""
        with self.lock:
            self.closed = True
        return {name: self.deregister(name, wait) for name in list(self.pipelines)}

    def _record(self, p: Pipeline, event: str, **fields: Any) -> None:
        """One file of the run's record; a disk that fails doesn't stop the run."""
        try:
            row = {"time": time.strftime("%Y-%m-%dT%H:%M:%S"), "event": event, **fields}
            p.folder.write(f"record/{time.time_ns()}-{uuid.uuid4().hex[:8]}.json", json.dumps(row, default=str) + "\n", replace=True)
        except Py4JJavaError:
            pass

    def record(self, name: str) -> DataFrame:
        """The record of a pipeline's folder, oldest first."""
        return self.spark.read.json(f"{self.folder}/{name}/record").orderBy(F.input_file_name())
