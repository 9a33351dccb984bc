"""Sync planning against the rules taken one name at a time."""

import hashlib
import random

import pytest

from trackplace.operators import manifest


def frames(spark, local, remote, index, deleted):
    make = spark.createDataFrame
    return (
        make([(0, n, d) for n, d in local.items()], "f long, name string, digest string"),
        make([(0, n, i, d, c) for c, (i, n, d) in enumerate(remote)], "f long, name string, remote_id long, digest string, created long"),
        make([(0, n, i, d) for n, (i, d) in index.items()], "f long, name string, remote_id long, digest string"),
        make([(0, n) for n in deleted], "f long, name string"),
    )


def planned(spark, local, remote, index, deleted, policy, limit=None):
    plan = manifest.sync_plan(*frames(spark, local, remote, index, deleted), ["f"], policy, limit=limit)
    return sorted((r.phase, r.name, r.action_no, r.action, r.target, r.remote_id, r.digest) for r in plan.collect()) \
        if plan else []


def one_by_one(local, remote, index, deleted, policy):
    here, synced = dict(local), dict(index)
    taken = set(here) | {n for _, n, _ in remote} | set(synced) | set(deleted)
    out, there = [], {}

    def free(name):
        dot = name.rfind(".")
        dot = dot if dot > 0 else len(name)
        n = 2
        while f"{name[:dot]} ({n}){name[dot:]}" in taken:
            n += 1
        taken.add(f"{name[:dot]} ({n}){name[dot:]}")
        return f"{name[:dot]} ({n}){name[dot:]}"

    for rid, name, digest in remote:
        if name not in there:
            there[name] = (rid, digest)
            continue
        to = free(name)
        there[to] = (rid, digest)
        out.append((0, name, 0, "rename_remote", to, rid, None))
        mine = next((n for n, (i, _) in synced.items() if i == rid), None)
        if mine and here.get(mine) == synced[mine][1]:
            out.append((0, mine, 1, "rename_local", to, None, None))
            here[to], synced[to] = here.pop(mine), synced.pop(mine)
    for name in sorted(set(here) | set(there) | set(synced) | set(deleted)):
        l, (rid, r) = here.get(name), there.get(name, (None, None))
        last = synced[name][1] if name in synced and (rid is None or synced[name][0] == rid) else None
        if l and r:
            if l == r:
                steps = [] if last == l and name not in deleted else [("record", None, rid, l)]
            elif name in deleted:
                to = free(name)
                steps = [("rename_local", to, None, None), ("upload", to, None, None)]
            elif l == last:
                steps = [("download", None, rid, None)]
            elif r == last:
                steps = [("update", None, rid, None)]
            elif policy == manifest.MERGE:
                steps = [("merge", None, rid, None)]
            else:
                to = free(name)
                steps = [("rename_local", to, None, None), ("upload", to, None, None), ("download", None, rid, None)]
        elif l:
            steps = [("upload", None, None, None)]
        elif r:
            if name in deleted:
                steps = []
            elif last and policy == manifest.KEEP_BOTH:
                steps = [("forget", None, None, None)]
            else:
                steps = [("download", None, rid, None)]
        else:
            steps = [("prune", None, None, None)]
        out += [(1, name, i, a, to, x, d) for i, (a, to, x, d) in enumerate(steps)]
    return sorted(out, key=str)


@pytest.mark.parametrize("policy,limit", [(manifest.KEEP_BOTH, None), (manifest.KEEP_BOTH, 8), (manifest.MERGE, None)])
def test_plan_agrees_with_names_taken_one_by_one(spark, policy, limit):
    rng = random.Random(7)
    pool = [f"{b}{x}" for b in ("a", "b", "c (2)", "c", ".d") for x in (".gpx", "", " (2).gpx", " (3).gpx")]
    local = {n: rng.choice("xyz") for n in pool if rng.random() < 0.6}
    remote = [(i, rng.choice(pool), rng.choice("xyz")) for i in range(30)]
    index = {n: (i, rng.choice("xyz")) for n, i in zip(rng.sample(pool, 12), rng.sample(range(34), 12))}
    deleted = rng.sample(pool, 3)
    plan = manifest.sync_plan(*frames(spark, local, remote, index, deleted), ["f"], policy, limit=limit)
    got = sorted(((r.phase, r.name, r.action_no, r.action, r.target, r.remote_id, r.digest) for r in plan.collect()), key=str)
    assert got == one_by_one(local, remote, index, deleted, policy)


def test_names_that_cannot_be_synced_take_no_part(spark):
    local, remote, index, deleted = frames(spark, {"a\tb": "x", "ok": "x"}, [(1, "c\nd", "y")], {}, [])
    plan = manifest.sync_plan(local, remote, index, deleted, ["f"])
    assert [(r.name, r.action) for r in plan.collect()] == [("ok", "upload")]
    report = manifest.sync_report(plan, ["f"]).first()
    assert (report.uploads, report.downloads, report.renames, report.changed_locally) == (1, 0, 0, False)


def test_free_names_for_one_hot_name(spark):
    taken = [(0, f"n ({i}).x") for i in (2, 3, 5, 9, 40)] + [(0, "n (07).x"), (0, "m (4).x")]
    asked = spark.createDataFrame([(0, "n.x", i) for i in range(60)], "f long, name string, o long")
    names = spark.createDataFrame(taken, "f long, name string")
    want = [i for i in range(2, 80) if i not in (2, 3, 5, 9, 40)][:60]
    for limit in (None, 10):
        got = manifest.free_names(asked, names, ["f"], ["o"], limit=limit).orderBy("o").collect()
        assert [r.free_name for r in got] == [f"n ({i}).x" for i in want]


def test_the_same_state_is_the_same_bytes(spark):
    from trackplace.sinks import states

    rows = [(1, None, "DSCF0001.RAF", 3, 1_500_000, "a\tb"), (1, "F_X", "x\\y.JPG", 12, 0, None), (1, "A_B", "n\n", 0, 7, ""), (2, None, "z", 1, 0, "d")]
    schema = "file long, camera_key string, last_file string, import_no int, at_us long, device string"
    want = {
        1: "\\N\tDSCF0001.RAF\t3\t1970-01-01T00:00:01.500Z\ta\\tb\nA_B\tn\\n\t0\t1970-01-01T00:00:00.000007Z\t\n"
           "F_X\tx\\\\y.JPG\t12\t1970-01-01T00:00:00Z\t\\N\n",
        2: "\\N\tz\t1\t1970-01-01T00:00:00Z\td\n"}
    for order in (rows, rows[::-1]):
        got = states.state_documents(spark.createDataFrame(order, schema).repartition(3), ["file"]).collect()
        assert {r.file: r.document for r in got} == want
        assert {r.digest for r in got} == {hashlib.md5(t.encode()).hexdigest() for t in want.values()}
    settings = spark.createDataFrame([("f", "b", 2, 0), ("f", "a", None, 1)], "file string, skey string, svalue long, changed_us long")
    assert states.setting_documents(settings, ["file"]).first().document == (
        "a\t\\N\t1970-01-01T00:00:00.000001Z\nb\t2\t1970-01-01T00:00:00Z\n")
