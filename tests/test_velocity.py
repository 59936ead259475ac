"""The stream of velocities against a fold in Python, with late events in a second micro-batch and a restart."""

import pytest

from rankloom.operators import behavior
from rankloom.streaming import velocity

SCHEMA = "product_id long, time_block int, query_id long, position int, event_seq long, clicked int"


def folded(events, keep=0.75):
    out, last = {}, {}
    for p, b, q, pos, seq, c in sorted(events, key=lambda e: (e[0], e[1], e[2], e[3], e[4])):
        v = last.get(p, 0.0)
        out.setdefault((p, b), [0, v, v])
        last[p] = out[p, b][2] = keep * v + c
        out[p, b][0] += 1
    return {k: tuple(x) for k, x in out.items()}


def test_blocks_close_late_rows_are_counted_and_restarts_repeat_nothing(spark, tmp_path):
    first = [(1, 0, 2, 1, 11, 1), (1, 0, 1, 1, 10, 0), (1, 1, 1, 1, 12, 1), (2, 0, 1, 1, 13, 1), (1, 2, 1, 2, 14, 1), (None, 0, 1, 1, 1, 1), (3, None, 1, 1, 1, 1)]
    second = [(1, 3, 1, 1, 20, 1), (1, 0, 1, 1, 21, 1), (1, 0, 1, 1, 22, 1), (2, 1, 1, 1, 23, 1), (9, 0, 1, 1, 24, 1), (2, 4, 1, 1, 25, 0)]
    third = [(1, 2, 1, 1, 30, 1), (1, 6, 1, 1, 31, 1), (2, 9, 1, 1, 32, 1)]
    files, folder = f"{tmp_path}/in", f"{tmp_path}/out"

    def add(rows, n):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{files}/{n}")

    def run():
        out = velocity.event_velocities(spark, f"{files}/*", spark.read.parquet(f"{files}/0").schema, folder)
        return {(r.product_id, r.time_block): (r.events, r.before, r.velocity, r.late) for r in out.collect()}

    add(first, 0)
    run()
    add(second, 1)
    run()
    add(third, 2)
    got = run()
    late = {k: x[3] for k, x in got.items() if x[3]}
    assert late == {(1, 0): 2, (2, 1): 1, (9, 0): 1, (1, 2): 1}
    kept = [e for e in (*first, *second, *third) if e[0] is not None and e[1] is not None and e[4] not in (21, 22, 23, 24, 30)]
    want = {k: x for k, x in folded(kept).items() if k[1] <= 8}
    assert {k: x[:3] for k, x in got.items() if x[0]} == {k: pytest.approx(x) for k, x in want.items()}
    assert run() == got


def test_equals_the_batch_feature(spark, tmp_path):
    import random

    rng = random.Random(3)
    rows = [(rng.randint(1, 5), rng.randint(0, 6), rng.randint(0, 9), rng.randint(1, 10), i, rng.randint(0, 1)) for i in range(200)] + [(77, 9, 0, 1, 999, 0)]
    log = spark.createDataFrame(rows, SCHEMA)
    log.coalesce(2).write.parquet(f"{tmp_path}/in")
    got = velocity.event_velocities(spark, f"{tmp_path}/in", log.schema, f"{tmp_path}/out")
    stream = {(r.product_id, r.time_block): r.before for r in got.where("events > 0").collect()}
    batch = {(r.product_id, r.time_block): r.velocity for r in behavior.event_velocity(log).collect() if r.product_id != 77}
    assert stream == {k: pytest.approx(v) for k, v in batch.items()}
