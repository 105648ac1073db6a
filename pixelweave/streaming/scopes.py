"""Scoped pipelines as a relational plan over a log of submissions: over all of it, or batch by batch.

submissions(job long, scope map<string,string>, data string, complete array<string>). ``data`` and all results are JSON objects. Each submission is an image, and names the
levels that it completes. What a plan makes of a log follows from three rules, all of them joins and windows:

- an image's unit is open until the next close that names the unit itself or, at a level around it, a unit that it lies in; that close makes a row
  for it, as every close of a level with a phase does;
- a result or a failure goes to the next row of the phase above whose unit it lies in, and to that one only;
- a row also tells of what its unit holds from phases further down that no row has taken yet.

"Next" is by job, place among the levels completed, phase, and, among units that one close ends, the job that opened them. Log, waiting results and open units are tables, so that a log may be worked off in parts: each part starts with
what the part before left over, and gives the rows that the whole log would.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.plans.plan import Phase, Plan
from pixelweave.session import checkpointed, shared_folder

FAILURE = "struct<scope:map<string,string>,step:string,error:string,phase:int,job:bigint>"
SEQ = "struct<job:bigint,place:int,phase:int,opened:bigint>"
SUBMISSIONS = "job long, scope map<string,string>, data string, complete array<string>"
#: What waits for a row of the phase above: a result, or, with an error, a failure.
ITEMS = f"id string, phase int, seq {SEQ}, scope map<string,string>, step string, result string, error string, jobs array<bigint>, below array<{FAILURE}>"
#: Images whose unit at a level is open.
OPEN = f"level string, seq {SEQ}, scope map<string,string>"
BOARD = f"job long, level string, unit map<string,string>, state string, result string, error string, step string, jobs array<bigint>, failed array<{FAILURE}>, n_inputs int"
#: What a phase's steps come to.
RAN = "result string, step string, error string"
#: Jobs that are looked through together for the next close, so that a unit of any size is spread over tasks.
SPAN = 1 << 16

Run = Callable[..., dict]
_held: dict[str, dict] = {}


def pass_value(data: dict, state: dict, **params: Any) -> dict:
    """The image step of the examples: passes its value, fails where it is told to."""
    if data["input"].get("fail"):
        raise ValueError("image failed")
    return {"value": data["input"]["value"]}


def total(data: dict, state: dict, **params: Any) -> dict:
    """The unit step of the examples: the sum of its inputs."""
    return {"value": float(sum(r["value"] for r in data["results"]))}


@dataclass
class Left:
    """What a part of the log leaves over: waiting items and open units; nothing is worked out before it is written."""

    items: DataFrame
    opened: DataFrame


@dataclass
class Runner:
    """Runs a phase's steps in a chain, each on what the one before returned; a worker's state is one dict per step."""

    plan: Plan
    steps: dict[str, Run] = field(default_factory=dict)

    def check(self) -> None:
        missing = [s.name for p in self.plan.phases for s in p.steps if s.name not in self.steps]
        if missing:
            raise ValueError(f"no step is named {missing}; there are {sorted(self.steps)}")

    def chain(self, phase: Phase, data: dict) -> tuple[dict | None, str | None, str | None]:
        """(result, step, error): the last step's result, or the step that failed and why."""
        for step in phase.steps:
            try:
                out = self.steps[step.name](data, _held.setdefault(step.name, {}), **step.params)
                if not isinstance(out, dict):
                    raise TypeError(f"{step.name} returned {type(out).__name__}, expected dict")
                json.dumps(out)
            except Exception as e:  # noqa: BLE001  an image or a unit fails alone
                return None, step.name, str(e)
            data = out
        return data, None, None

    def spelled(self, phase: Phase, data: dict) -> tuple[str | None, str | None, str | None]:
        result, step, error = self.chain(phase, data)
        return json.dumps(result) if error is None else None, step, error


def examples(plan: Plan, on_image: Run = pass_value, on_unit: Run = total) -> dict[str, Run]:
    """The same step for every name of the first phase, and another for all others."""
    return {s.name: on_unit if p.scope else on_image for p in plan.phases for s in p.steps}


def following(items: DataFrame, events: DataFrame) -> DataFrame:
    """(id, event): for items(id, key, seq) the first of events(key, seq, ref) after it under its key; items without one are left out."""
    kind = f"struct<seq:{SEQ},ref:{dict(events.dtypes)['ref']}>"
    both = items.select("key", "seq", "id", F.lit(None).cast(kind).alias("event")).unionByName(
        events.select("key", "seq", F.lit(None).cast(dict(items.dtypes)["id"]).alias("id"), F.struct("seq", "ref").cast(kind).alias("event"))
    )
    span = F.floor(F.col("seq.job") / SPAN).alias("span")
    backwards = Window.partitionBy("key", "span").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    near = both.select("*", span).withColumn("next", F.last("event", ignorenulls=True).over(backwards)).where("id is not null")
    # where a span has no event any more, the first one of a later span
    firsts = events.select("key", span, F.struct("seq", "ref").cast(kind).alias("event")).groupBy("key", "span").agg(F.min("event").alias("event"))
    firsts = firsts.groupBy(F.col("key").alias("k")).agg(F.sort_array(F.collect_list(F.struct("span", "event"))).alias("firsts"))
    later = F.get(F.filter("firsts", lambda x: x["span"] > F.col("span")), F.lit(0))["event"]
    return near.join(firsts, F.col("key") == F.col("k")).select("id", F.coalesce("next", later).alias("event")).where("event is not null")


def _shapes(events: DataFrame) -> list[list[str]]:
    """The sets of levels that units name: as many as there are sets of levels at most."""
    return [sorted(r[0]) for r in events.select(F.array_sort(F.map_keys("unit")).alias("names")).distinct().collect()]


def _keys(source: str, shapes: list[list[str]]) -> Column:
    """One key per shape that a scope has all levels of: which those are, and its values."""
    value = lambda x: F.try_element_at(F.col(source), F.lit(x))
    every = [F.when(F.forall(F.array(*map(value, shape)), lambda x: x.isNotNull()) if shape else F.lit(True), F.array(F.lit(",".join(shape)), *map(value, shape))) for shape in shapes]
    return F.filter(F.array(*every).cast("array<array<string>>"), lambda x: x.isNotNull())


def _key(source: str) -> Column:
    """The key of a unit's own shape."""
    names = F.array_sort(F.map_keys(source))
    return F.concat(F.array(F.array_join(names, ",")), F.transform(names, lambda x: F.try_element_at(F.col(source), x)))


def next_of(items: DataFrame, events: DataFrame) -> DataFrame:
    """(id, event): the first event(unit, seq, ref) after each of items(id, seq, scope) whose unit the scope lies in."""
    keyed = items.select("id", "seq", F.explode(_keys("scope", _shapes(events))).alias("key"))
    return following(keyed, events.select(_key("unit").alias("key"), "seq", "ref")).groupBy("id").agg(F.min("event").alias("event"))


def seq(job: Column, place: Column, phase: int) -> Column:
    return F.struct(job.cast("long").alias("job"), place.cast("int").alias("place"), F.lit(phase).cast("int").alias("phase"), F.lit(0).cast("long").alias("opened"))


def unit_rows(log: DataFrame, opened: DataFrame, plan: Plan) -> tuple[DataFrame, DataFrame]:
    """Rows(level, ref, unit, seq, scope) of all levels with a phase, and what stays open."""
    closes = log.select("job", "scope", F.posexplode("complete").alias("place", "level")).where(F.col("level").isin(plan.known))
    unit_in = lambda names: F.coalesce(*[F.when(F.col("level") == x, plan.unit(x, F.col("scope"))) for x in names])
    phase = F.coalesce(*[F.when(F.col("level") == x, F.lit(i)) for i, x in enumerate(plan.scopes, 1)], F.lit(0)).cast("int")
    end = seq(F.col("job"), F.col("place"), 99).alias("seq")
    closes = checkpointed(closes.withColumn("unit", unit_in(plan.known)))
    mine = F.filter(F.array(*map(F.lit, plan.scopes)), lambda x: F.try_element_at("scope", x).isNotNull())
    images = opened.unionByName(log.select(F.explode(mine).alias("level"), seq(F.col("job"), F.lit(-1), 0).alias("seq"), "scope"))
    images = images.withColumn("own", unit_in(plan.scopes)).withColumn("id", F.concat_ws("@", "level", "seq.job"))
    # a unit ends with a close that names it, or one around it; keys begin with the level whose units they are of
    inner = F.coalesce(*[F.when(F.col("level") == x, F.array(*map(F.lit, plan.inside(x))).cast("array<string>")) for x in plan.known])
    outer = closes.select(F.explode(inner).alias("of"), _key("unit").alias("key"), end)
    outer = outer.select(F.concat(F.array(F.lit("in"), "of"), "key").alias("key"), "seq", F.lit(0).alias("ref"))
    exact = closes.where(F.col("level").isin(plan.scopes) & (F.size("unit") > 0)).select(F.concat(F.array(F.lit("is"), "level"), _key("unit")).alias("key"), end, F.lit(1).alias("ref"))
    around = F.transform(_keys("scope", _shapes(closes)), lambda x: F.concat(F.array(F.lit("in"), "level"), x))
    keyed = images.select("id", "seq", F.explode(F.concat(around, F.array(F.concat(F.array(F.lit("is"), "level"), _key("own"))))).alias("key"))
    ends = checkpointed(following(keyed, outer.unionByName(exact)).groupBy("id").agg(F.min("event").alias("event")))
    left = images.join(ends, "id", "left_anti").select("level", "seq", "scope")
    # a close makes its row, and one for each unit inside it that was open; a unit has one row in a job
    cascaded = images.join(ends, "id").where("event.ref = 0").select("level", "own", F.col("event.seq.job").alias("job"), F.col("event.seq.place").alias("place"), F.lit(1).alias("by"), F.col("own").alias("scope"), F.col("seq.job").alias("opened"))
    direct = closes.where(F.col("level").isin(plan.scopes)).select("level", F.col("unit").alias("own"), "job", "place", F.lit(0).alias("by"), "scope", F.lit(0).cast("long").alias("opened"))
    every = cascaded.unionByName(direct).groupBy("level", "job", F.to_json("own").alias("name"))
    first = every.agg(F.min("place").cast("int").alias("place"), F.min_by(F.struct("own", "scope"), F.struct("place", "by", "opened")).alias("x"), F.min(F.struct("place", "by", "opened"))["opened"].alias("opened"))
    at = F.struct("job", "place", phase.alias("phase"), "opened").cast(SEQ).alias("seq")
    rows = first.select("level", F.concat_ws("@", "level", "name", "job").alias("ref"), F.col("x.own").alias("unit"), at, F.col("x.scope").alias("scope"))
    return checkpointed(rows), left


def _images(log: DataFrame, runner: Runner) -> DataFrame:
    """Items of the first phase: every image through its steps."""

    def run(jobs: pd.Series, scopes_: pd.Series, datas: pd.Series) -> pd.DataFrame:
        out = []
        for job, scope, data in zip(jobs, scopes_, datas):
            meta = {"workflow_name": runner.plan.name, "scope": json.loads(scope), "submission_idx": int(job), "steps": [s.name for s in runner.plan.phases[0].steps]}
            out.append(runner.spelled(runner.plan.phases[0], {"metadata": meta, "input": json.loads(data) if data else {}}))
        return pd.DataFrame(out, columns=["result", "step", "error"], dtype=object)

    ran = F.pandas_udf(run, RAN).asNondeterministic()
    found = log.withColumn("ran", ran("job", F.to_json("scope"), "data")).select("*", "ran.*")
    return found.select(
        F.col("job").cast("string").alias("id"), F.lit(0).alias("phase"), seq(F.col("job"), F.lit(-1), 0).alias("seq"), "scope", "step", "result", "error",
        F.when(F.col("error").isNull(), F.array("job")).otherwise(F.array().cast("array<bigint>")).alias("jobs"), F.array().cast(f"array<{FAILURE}>").alias("below"),
    )


def _failure(step: Column, error: Column) -> Column:
    return F.struct(F.col("scope").alias("scope"), step.alias("step"), error.alias("error"), F.col("phase").cast("int").alias("phase"), F.col("seq.job").alias("job")).cast(FAILURE)


def _in_order(rows: Column, by: str) -> Column:
    """An array of structs in the order of one of their fields: the others, maps among them, have none."""
    return F.array_sort(rows, lambda a, b: F.when(a[by] < b[by], -1).when(a[by] > b[by], 1).otherwise(0))


def _units(rows: DataFrame, taken: DataFrame, notes: DataFrame, level: str, number: int, runner: Runner) -> DataFrame:
    """Board rows of a level with what their steps returned: taken(ref, items...), notes(ref, note)."""
    inputs = taken.where("error is null").groupBy("ref").agg(_in_order(F.collect_list(F.struct("seq", "result", "jobs", "below")), "seq").alias("inputs"))
    own = taken.where("error is not null").select("ref", "seq", _failure(F.col("step"), F.col("error")).alias("f"))
    own = own.groupBy("ref").agg(F.transform(_in_order(F.collect_list(F.struct("seq", "f")), "seq"), lambda x: x["f"]).alias("own"))
    told = notes.groupBy("ref").agg(F.transform(_in_order(F.collect_list("note"), "job"), lambda x: x["f"]).alias("told"))
    full = rows.join(inputs, "ref", "left").join(own, "ref", "left").join(told, "ref", "left")
    none = lambda kind: F.array().cast(kind)
    failures = F.concat(F.coalesce("own", none(f"array<{FAILURE}>")), F.coalesce("told", none(f"array<{FAILURE}>")))
    full = full.select(
        "ref", "unit", "seq", "scope", failures.alias("failures"),
        F.coalesce(F.transform("inputs", lambda x: x["result"]), none("array<string>")).alias("results"),
        F.coalesce(F.array_sort(F.flatten(F.transform("inputs", lambda x: x["jobs"]))), none("array<bigint>")).alias("jobs"),
        F.coalesce(F.flatten(F.transform("inputs", lambda x: x["below"])), none(f"array<{FAILURE}>")).alias("below"),
    )
    full = full.withColumn("n_inputs", F.size("results"))

    def run(units: pd.Series, results: pd.Series, failures: pd.Series) -> pd.DataFrame:
        out = []
        for unit, own, failed in zip(units, results, failures):
            data = {"results": [json.loads(x) for x in own], "failures": json.loads(failed)}
            data["metadata"] = {"workflow_name": runner.plan.name, "scope_level": level, "phase": number, "unit": json.loads(unit), "n_accumulated": len(own), "n_failures": len(data["failures"])}
            out.append(runner.spelled(runner.plan.phases[number], data) if data["results"] or data["failures"] else (None, None, f"no images in this {level}"))
        return pd.DataFrame(out, columns=["result", "step", "error"], dtype=object)

    ran = F.pandas_udf(run, RAN).asNondeterministic()
    full = full.withColumn("ran", ran(F.to_json("unit"), "results", F.to_json("failures"))).drop("results")
    return checkpointed(full.select("*", "ran.*", ((F.col("n_inputs") > 0) | (F.size("failures") > 0)).alias("did")).drop("ran"))


def advance(log: DataFrame, plan: Plan, steps: dict[str, Run] | None = None, left: Left | None = None) -> tuple[DataFrame, Left]:
    """The board's rows that a part of the log adds, and what it leaves over for the next part."""
    runner = Runner(plan, examples(plan) if steps is None else steps)
    runner.check()
    spark = log.sparkSession
    left = left or Left(spark.createDataFrame([], ITEMS), spark.createDataFrame([], OPEN))
    rows, opened = unit_rows(log, left.opened, plan)
    images = checkpointed(_images(log, runner))
    none = F.array().cast(f"array<{FAILURE}>")
    own_job = F.array(F.col("seq.job"))
    board = images.select(
        F.col("seq.job").alias("job"), F.lit(None).cast("string").alias("level"), F.col("scope").alias("unit"), F.when(F.col("error").isNull(), "done").otherwise("failed").alias("state"),
        "result", "error", "step", own_job.alias("jobs"), none.alias("failed"), F.lit(1).alias("n_inputs"),
    )
    waiting: list[tuple[DataFrame, DataFrame]] = []  # items of a phase, and when they were taken
    new = images
    for number, level in enumerate(plan.scopes, 1):
        items = left.items.where(F.col("phase") == number - 1).unionByName(new)
        own = rows.where(F.col("level") == level).drop("level")
        events = own.select("unit", "seq", "ref")
        ends = checkpointed(next_of(items.select("id", "seq", "scope"), events))
        taken = items.join(ends, "id").withColumn("ref", F.col("event.ref"))
        notes = _notes(waiting, events, plan)
        units = _units(own, taken, notes, level, number, runner)
        waiting.append((items, ends))
        state = F.when(F.col("error").isNull(), "done").otherwise("failed").alias("state")
        failed = F.concat("failures", "below")
        board = board.unionByName(units.select(F.col("seq.job").alias("job"), F.lit(level).alias("level"), "unit", state, "result", "error", "step", "jobs", failed.alias("failed"), "n_inputs"))
        new = units.where("did").select(
            F.concat(F.lit(f"{number}:"), "ref").alias("id"), F.lit(number).alias("phase"), "seq", "scope", "step", "result", "error",
            F.when(F.col("error").isNull(), F.col("jobs")).otherwise(F.array().cast("array<bigint>")).alias("jobs"), F.when(F.col("error").isNull(), failed).otherwise(none).alias("below"),
        )
    rest = left.items.where("false")  # of the last phase nothing waits
    for items, ends in waiting:
        rest = rest.unionByName(items.join(ends, "id", "left_anti"))
    return board, Left(rest, opened)


def _notes(waiting: list[tuple[DataFrame, DataFrame]], events: DataFrame, plan: Plan) -> DataFrame:
    """(ref, note): what the units of a level still hold from phases whose own level hasn't closed; each is kept for that."""
    spark = events.sparkSession
    out = spark.createDataFrame([], f"ref string, note struct<job:bigint,f:{FAILURE}>")
    for phase, (items, ends) in enumerate(waiting):
        ends = ends.select("id", F.col("event.seq").alias("until"))
        held = items.join(ends, "id", "left").withColumn("f", F.when(F.col("error").isNull(), _failure(F.lit("engine"), F.lit(f"{plan.scopes[phase]} not closed"))).otherwise(_failure(F.col("step"), F.col("error"))))
        mine = held.select(F.explode(_keys("scope", _shapes(events))).alias("key"), "seq", "until", "f")
        mine = mine.join(events.select(_key("unit").alias("k"), F.col("seq").alias("at"), "ref"), F.col("key") == F.col("k"))
        out = out.unionByName(mine.where("seq < at and (until is null or until > at)").select("ref", F.struct(F.col("seq.job").alias("job"), "f").alias("note")))
    return out


def board(submissions: DataFrame, plan: Plan, steps: dict[str, Run] | None = None) -> DataFrame:
    """The board of a whole log: a row per image and per closed unit."""
    return advance(submissions, plan, steps)[0]


def streamed(submissions: DataFrame, plan: Plan, sink: str, steps: dict[str, Run] | None = None, trigger: dict | None = None):
    """Starts a query that adds the board's rows of each micro-batch to ``sink``/board, one folder per batch.

    What a batch leaves over is written beside it and is where the next one starts, so a batch that is run again gives the same rows again. Jobs come in order
    from batch to batch, as in the log.
    """

    def one(log: DataFrame, number: int) -> None:
        spark = log.sparkSession
        left = None
        if number:
            before = f"{sink}/left/{number - 1}"
            left = Left(spark.read.schema(ITEMS).parquet(f"{before}/items"), spark.read.schema(OPEN).parquet(f"{before}/opened"))
        rows, left = advance(log, plan, steps, left)
        rows.write.mode("overwrite").parquet(f"{sink}/board/batch={number}")
        left.items.write.mode("overwrite").parquet(f"{sink}/left/{number}/items")
        left.opened.write.mode("overwrite").parquet(f"{sink}/left/{number}/opened")

    shared_folder(submissions.sparkSession)
    return submissions.writeStream.foreachBatch(one).option("checkpointLocation", f"{sink}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def unit_totals(submissions: DataFrame, levels: list[str]) -> DataFrame:
    """(unit columns, close_job, total, n_inputs) as windows alone, for a level whose units name every wider one.

    submissions(job, one column per level, value, fail, closes boolean). An image belongs to the first close of its unit at or after it.
    """
    taken = closed(submissions, levels).where("not fail and close_job is not null")
    return taken.groupBy(*levels, "close_job").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n_inputs"))


def closed(submissions: DataFrame, levels: list[str]) -> DataFrame:
    """Submissions with close_job, the first close of their unit at or after them; null while it is open."""
    backwards = Window.partitionBy(*levels).orderBy(F.desc("job")).rowsBetween(Window.unboundedPreceding, 0)
    return submissions.withColumn("close_job", F.last(F.when(F.col("closes"), F.col("job")), ignorenulls=True).over(backwards))
