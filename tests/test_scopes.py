"""Units of a hierarchy, as a batch, as a stream, and through the engine."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from pixelweave.engine import Engine
from pixelweave.plans.plan import Phase, Plan, ScopeError, Step, load, phases_of
from pixelweave.streaming import scopes

THREE = Plan("p", phases_of([{"image": None}, {"g": {"scope": "group"}}, {"c": {"scope": "compartment"}}, {"a": {"scope": "carrier"}}]))


def steps(plan):
    def total(data, state, **params):
        values = [r["value"] for r in data["results"]]
        if 666 in values:
            raise ValueError("666")
        return {"value": float(sum(values))}

    return scopes.examples(plan, on_unit=total)


def frame(spark, log):
    rows = [(job, scope, json.dumps({"value": value, "fail": any(fail)}), complete) for job, (scope, value, complete, *fail) in enumerate(log, 1)]
    return spark.createDataFrame(rows, scopes.SUBMISSIONS)


def plain(r):
    """A row of the board to compare by."""
    value = json.loads(r.result)["value"] if r.result else None
    failed = sorted((f.job, f.phase, f.step, f.error) for f in r.failed)
    return (r.job, r.level, tuple(sorted(r.unit.items())), r.state, value, r.error, tuple(r.jobs), tuple(failed), r.n_inputs)


def board(spark, plan, log):
    order = {None: 0} | {x: i for i, x in enumerate(plan.scopes, 1)}
    out = [plain(r) for r in scopes.board(frame(spark, log), plan, steps(plan)).collect()]
    return sorted((x for x in out if x[1]), key=lambda x: (x[0], order[x[1]], x[2]))


def tile(carrier, compartment=None, group=None):
    return {k: str(v) for k, v in (("carrier", carrier), ("compartment", compartment), ("group", group)) if v is not None}


def test_three_levels(spark):
    log = []
    for a in (1, 2):
        for c in (1, 2):
            for g in (1, 2):
                for d in (1, 2):
                    done = [] if d == 1 else ["group"] + (["compartment"] if g == 2 else []) + (["carrier"] if g == c == 2 else [])
                    log.append((tile(a, c, g), 1000 * a + 100 * c + 10 * g + d, done))
    out = board(spark, THREE, log)
    assert [sum(x[1] == n for x in out) for n in ("group", "compartment", "carrier")] == [8, 4, 2]
    assert [x[4] for x in out if x[1] == "carrier"] == [sum(v for s, v, _ in log if s["carrier"] == a) for a in "12"]
    assert out[-1][6] == tuple(range(9, 17))


def test_close_cascades(spark):
    log = [(tile(1, c, g), 1.0, ["carrier"] if (c, g) == (2, 2) else []) for c in (1, 2) for g in (1, 2)]
    out = board(spark, THREE, log)
    assert [x[1] for x in out] == ["group"] * 4 + ["compartment"] * 2 + ["carrier"] and out[-1][4] == 4


def test_late_image_reopens(spark):
    out = board(spark, THREE, [(tile(1, 1, 1), 3.0, ["group"]), (tile(1, 1, 1), 10.0, ["group"]), (tile(1, 1, 1), 0.0, ["carrier"])])
    assert [x[4] for x in out] == [3.0, 10.0, 0.0, 13.0, 13.0] and out[-2][8] == 3


def test_closed_out_of_order(spark):
    two = Plan("p", phases_of([{"i": None}, {"c": {"scope": "compartment"}}, {"a": {"scope": "carrier"}}]))
    out = board(spark, two, [(tile(1, 1), 1.0, ["compartment"]), (tile(1), 5.0, ["carrier"])])
    assert (out[-1][8], out[-1][4]) == (1, 1.0) and out[-1][7] == ((2, 0, "engine", "compartment not closed"),)


def test_failures_stay_in_their_unit(spark):
    log = [(tile(1, 1, 1), 1.0, [], True), (tile(1, 1, 1), 2.0, ["group"]), (tile(1, 1, 2), 666.0, ["group"]), (tile(1, 2, 1), 4.0, ["carrier"])]
    out = board(spark, THREE, log)
    assert [(x[1], x[3], len(x[7])) for x in out] == [
        ("group", "done", 1), ("group", "failed", 0), ("group", "done", 0), ("compartment", "done", 2), ("compartment", "done", 0), ("carrier", "done", 2),
    ]
    only = board(spark, THREE, [(tile(1, 1, 1), 1.0, ["group"], True)])
    assert only[0][3:5] == ("done", 0.0)
    none = board(spark, THREE, [(tile(1, 1, 1), 1.0, ["group"]), (tile(2, 1, 1), 1.0, []), (tile(1, 1, 1) | {"carrier": "3"}, 1.0, ["compartment"]), (tile(4, 1), 1.0, ["compartment"])])
    assert none[-1][3:6] == ("done", 0.0, None) and none[-1][7] == ((4, 0, "engine", "group not closed"),)


def test_skipped_level(spark):
    gap = [{"i": None}, {"g": {"scope": "group"}}, {"a": {"scope": "carrier"}}]
    log = [(tile(1, 1, 1), 2.0, []), (tile(1, 2, 1), 200.0, ["group"])]
    assert [x[4] for x in board(spark, Plan("p", phases_of(gap), ("carrier", "compartment", "group")), log)] == [200.0]
    assert [x[4] for x in board(spark, Plan("p", phases_of(gap)), log)] == [202.0]


def test_close_everything(spark):
    plan = Plan("p", phases_of([{"i": None}, {"a": {"scope": "carrier"}}, {"e": {"scope": "all"}}]))
    out = board(spark, plan, [(tile(1), 3.0, ["carrier"]), (tile(2), 30.0, []), (tile(3), 500.0, ["all"])])
    assert [x[4] for x in out] == [3.0, 30.0, 500.0, 533.0] and out[-1][2] == ()
    assert [x[3:6] for x in board(spark, plan, [({}, 1.0, ["carrier"])])] == [("done", 1.0, None)]


def replayed(plan, log):
    """The three rules, worked out by looking through the whole log for each item."""
    rank = {x: i for i, x in enumerate(plan.scopes, 1)}

    def unit(level, scope):
        return {k: scope[k] for k in (*plan.around(level), level) if k in scope} if level in scope else {}

    def lies(scope, where):
        return all(scope.get(k) == v for k, v in where.items())

    closes = [(job, place, level, scope) for job, (scope, _, complete, *_) in enumerate(log, 1) for place, level in enumerate(complete)]
    rows, opened = {}, {}
    for job, place, level, scope in closes:
        if level in rank:
            key = (level, job, tuple(sorted(unit(level, scope).items())))
            row = (place, 0, tuple(sorted(scope.items())))
            rows[key] = min(rows.get(key, row), row)
    for level in plan.scopes:
        for job, (scope, *_) in enumerate(log, 1):
            if level in scope:
                own = unit(level, scope)
                ends = [(j, p, x != level) for j, p, x, s in closes if j >= job and (x == level and unit(x, s) == own or level in plan.inside(x) and lies(scope, unit(x, s)))]
                if ends and min(ends)[2]:
                    key, row = (level, min(ends)[0], tuple(sorted(own.items()))), (min(ends)[1], 1, tuple(sorted(own.items())))
                    rows[key] = min(rows.get(key, row), row)
                    opened[key] = min(opened.get(key, job), job)
    items = {0: []}
    for job, (scope, value, _, *fail) in enumerate(log, 1):
        items[0].append({"at": (job, -1, 0, 0), "scope": scope, "value": value, "error": "image failed" if any(fail) else None, "step": plan.phases[0].steps[0].name, "jobs": [job], "below": []})
    out = []
    for level in plan.scopes:
        n = rank[level]
        items[n] = []
        own = [((job, place, n, opened[x, job, key] if by else 0), dict(key), dict(scope)) for (x, job, key), (place, by, scope) in sorted(rows.items()) if x == level]
        for item in items[n - 1]:
            item["taken"] = min((at for at, where, _ in own if at > item["at"] and lies(item["scope"], where)), default=None)
        for at, where, scope in own:
            got = [x for x in items[n - 1] if x["taken"] == at and lies(x["scope"], where)]
            good = [x for x in got if x["error"] is None]
            failed = [(x["at"][0], n - 1, x["step"], x["error"]) for x in got if x["error"]]
            for k in range(n - 1):
                for x in items[k]:
                    if x["at"] < at and lies(x["scope"], where) and (x["taken"] is None or x["taken"] > at):
                        failed.append((x["at"][0], k, x["step"], x["error"]) if x["error"] else (x["at"][0], k, "engine", f"{plan.scopes[k]} not closed"))
            jobs = tuple(sorted(j for x in good for j in x["jobs"]))
            unit_of = tuple(sorted(where.items()))
            if not good and not failed:
                out.append((at[0], level, unit_of, "failed", None, f"no images in this {level}", (), (), 0))
                continue
            below = failed + [f for x in good for f in x["below"]]
            bad = any(x["value"] == 666 for x in good)
            value = None if bad else float(sum(x["value"] for x in good))
            out.append((at[0], level, unit_of, "failed" if bad else "done", value, "666" if bad else None, jobs, tuple(sorted(below)), len(good)))
            items[n].append({"at": at, "scope": scope, "value": value, "error": "666" if bad else None, "step": plan.phases[n].steps[0].name, "jobs": [] if bad else jobs, "below": [] if bad else below})
    return sorted(out, key=lambda x: (x[0], rank[x[1]], x[2]))


@pytest.mark.parametrize("seed", range(3))
def test_made_logs(spark, seed):
    """Logs with missing levels, late images, closes out of order and failures, whole and in parts."""
    r = random.Random(seed)
    levels = ("carrier", "compartment", "group") if seed % 2 else None
    plan = Plan("p", phases_of([{"image": None}, {"g": {"scope": "group"}}, {"c": {"scope": "compartment"}}, {"a": {"scope": "carrier"}}]), levels)
    log = []
    for _ in range(60):
        scope = {k: str(r.randint(1, 2)) for k in ("carrier", "compartment", "group") if r.random() < 0.9}
        complete = [x for x in r.sample(("group", "compartment", "carrier"), 3) if r.random() < 0.12]
        log.append((scope, r.choice((1.0, 2.0, 666.0, 4.0, 5.0)), complete, r.random() < 0.1))
    expected = replayed(plan, log)
    assert len(expected) > 15 and board(spark, plan, log) == expected
    if seed == 1:
        whole, left, out = frame(spark, log), None, []
        for low, high in ((1, 20), (21, 45), (46, 60)):
            rows, left = scopes.advance(whole.where(F.col("job").between(low, high)), plan, steps(plan), left)
            out += [plain(x) for x in rows.where("level is not null").collect()]
        assert sorted(out, key=lambda x: (x[0], plan.scopes.index(x[1]), x[2])) == expected


def test_plans(tmp_path):
    path = tmp_path / "p.yaml"
    path.write_text("metadata: {levels: [carrier, group]}\nmine:\n- read: {max_workers: 2, x: 1}\n- sum: {scope: group}\n- more:\n")
    plan = load(path)
    assert plan.phases == (Phase((Step("read", {"x": 1}, 2),)), Phase((Step("sum"), Step("more")), "group")) and plan.levels == ("carrier", "group")
    for wrong in ([{"a": {"environment": "e"}}], [{"a": {"max_workers": 0}}], [{"a": {"scope": "x"}}], [{"a": None}, {"b": {"scope": "x"}}, {"c": {"scope": "x"}}], []):
        with pytest.raises(ValueError):
            Plan("p", phases_of(wrong))
    assert plan.around("group") == ["carrier"] and plan.inside("carrier") == ["group"] and plan.around("other") == []


def test_steps_hand_data_on(spark):
    """Two steps per phase, with their parameters; the second gets what the first returned. What isn't a dict fails the image."""

    def scale(data, state, by=1, **_):
        state["calls"] = state.get("calls", 0) + 1
        return {"value": data["input"]["value"] * by, "job": data["metadata"]["submission_idx"]}

    def odd(data, state, plus=0, **_):
        return {"value": data["value"] + plus, "job": data["job"]} if data["value"] < 100 else data["value"]

    def gather(data, state, **_):
        return {"values": [x["value"] for x in data["results"]], "unit": data["metadata"]["unit"], "failures": len(data["failures"])}

    def most(data, state, **_):
        return {"most": max(data["values"]), "unit": data["unit"], "failures": data["failures"]}

    plan = Plan("p", phases_of([{"scale": {"by": 10}}, {"odd": {"plus": 1}}, {"gather": {"scope": "carrier"}}, {"most": None}]))
    log = frame(spark, [(tile(1), 3.0, []), (tile(1), 20.0, []), (tile(1), 5.0, ["carrier"])])
    out = {(r.job, r.level): r for r in scopes.board(log, plan, {"scale": scale, "odd": odd, "gather": gather, "most": most}).collect()}
    assert json.loads(out[1, None].result) == {"value": 31.0, "job": 1} and out[2, None].step == "odd" and "expected dict" in out[2, None].error
    assert json.loads(out[3, "carrier"].result) == {"most": 51.0, "unit": {"carrier": "1"}, "failures": 1}
    with pytest.raises(ValueError):
        scopes.board(log, plan, {"scale": scale})


def test_stream_is_batch(spark, tmp_path):
    plan = Plan("p", phases_of([{"i": None}, {"c": {"scope": "compartment"}}, {"a": {"scope": "carrier"}}]))
    log = []
    for a in (1, 2):
        for c in (1, 2):
            log += [(tile(a, c), float(len(log) + d), ["compartment"] if d in (2, 5) else [], d == 4) for d in range(6)]
        log.append((tile(a, 2), 0.5, ["carrier"]))
    rows = [r.asDict() for r in frame(spark, log).collect()]
    (tmp_path / "log").mkdir()
    for i, part in enumerate((rows[:5], rows[5:14], rows[14:])):
        (tmp_path / "log" / f"{i}.json").write_text("".join(json.dumps(r) + "\n" for r in part))
        os.utime(tmp_path / "log" / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files are read in order of their times
    for _ in range(2):  # a query that is started again has nothing more to do
        stream = spark.readStream.schema(scopes.SUBMISSIONS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "log"))
        scopes.streamed(stream, plan, str(tmp_path / "out"), steps(plan)).awaitTermination()
    got = spark.read.schema(scopes.BOARD).parquet(str(tmp_path / "out" / "board"))
    batch = scopes.board(frame(spark, log), plan, steps(plan))
    key = lambda x: (x[0], x[1] or "", x[2])
    assert sorted(map(plain, got.collect()), key=key) == sorted(map(plain, batch.collect()), key=key) and got.count() == 26 + 8 + 2 + 2


def test_engine(spark, tmp_path):
    with Engine(spark, tmp_path) as e:
        e.register("p", THREE, steps(THREE))
        with pytest.raises(ValueError):
            e.register("p", THREE)
        for g in (1, 2):
            e.submit("p", g, tile(1, 1, g), priority=g, complete="group")
        assert e.status()["p"] == {"queued": 2, "running": 0, "done": 0, "failed": 0, "cancelled": 0}
        assert e.run("p") == 2 and e.run("p") == 0
        assert e.submit("p", 3, tile(1, 1, 3), complete=["carrier"]) == 3
        with pytest.raises(ScopeError):
            e.submit("p", 1, tile(1), complete="group")
        assert e.status("p")["p"] == {"queued": 1, "running": 0, "done": 4, "failed": 0, "cancelled": 0}
        assert [r.job for r in e.pending("p").collect()] == [2, 1, 3]
        e.run("p")
        assert [json.loads(r.result)["value"] for r in e.results("p", "carrier").collect()] == [6.0]
        assert {r.state: r.n for r in e.tallies("p").collect()} == {"done": 8}
        assert e.deregister("p").count() == 8
        with pytest.raises(KeyError):
            e.submit("p", 1)
    with pytest.raises(RuntimeError):
        e.register("q", THREE)
    assert [r.event for r in e.record("p").collect()][-1] == "deregister"


def test_engine_goes_on(spark, tmp_path):
    """A folder that is opened again keeps its jobs, its open units and its numbers; two sessions at once don't take each other's."""
    plan = Plan("p", phases_of([{"i": None}, {"a": {"scope": "carrier"}}]))
    with Engine(spark, tmp_path) as e:
        e.register("p", plan)
        assert e.submit("p", 1.0, tile(1)) == 1
    with Engine(spark, tmp_path) as first, Engine(spark, tmp_path) as second:
        first.register("p", plan)
        second.register("p", plan)
        assert first.submit("p", 2.0, tile(1)) == 2
        assert second.submit("p", 4.0, tile(1), complete="carrier") == 3
        with pytest.raises(ScopeError):
            first.submit("p", 4.0, {}, complete="carrier")
        second.run("p")
        out = {(r.job, r.level): r for r in second.board("p").collect()}
        assert len(out) == 4 and json.loads(out[3, "carrier"].result)["value"] == 7.0 and out[3, "carrier"].jobs == [1, 2, 3]
        first.pipelines.clear()
    with Engine(spark, tmp_path) as e:
        e.register("p", plan)
        assert e.submit("p", 1.0, tile(2)) == 4
        assert {r.job: r.state for r in e.deregister("p", wait=False).where(F.col("level").isNull()).collect()} == {1: "done", 2: "done", 3: "done", 4: "cancelled"}
    with Engine(spark, tmp_path) as e:
        e.register("p", plan)
        e.submit("p", 8.0, tile(2), complete="carrier")
        e.run("p")
        assert [json.loads(r.result)["value"] for r in e.results("p", "carrier").orderBy("job").collect()] == [7.0, 8.0]
        assert e.status("p")["p"]["cancelled"] == 1
