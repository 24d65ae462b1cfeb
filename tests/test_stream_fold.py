"""The stream of calls against the batch fold: several batches, a restart, calls that come late."""

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import environment as E
from palimpsest.plans import catalog_environment as C
from palimpsest.plans.projection import World
from palimpsest.streaming.calls import fold_stream

ORDER = ["step", "part", "supp", "amount"]


@pytest.fixture()
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def calls(spark, sf):
    rows = C.calls(World(spark, sf)).where("case_id < 150").select("case_id", *ORDER, "tool", *E.CALL)
    return rows.withColumn("at", F.expr("timestamp'2020-01-01 00:00:00' + make_dt_interval(0, step)"))


def run(spark, folder, schema, out, keep_ms=10**12, late="90 minutes"):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    q = fold_stream(stream, "case_id", "at", ORDER, late, keep_ms).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def test_batches_restart_and_late_calls(spark, sf, rocks, tmp_path):
    rows = calls(spark, sf).cache()
    want = E.fold(rows, "case_id", *ORDER)
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    # Calls of a step come in that step's batch, every fifth one in the next.
    batch = F.col("step") + F.when(F.col("part") % 5 == 0, 1).otherwise(0)
    last = rows.agg(F.max(batch)).first()[0]
    put = lambda df, n: df.coalesce(1).write.parquet(f"{folder}/{n:02d}")
    for n in range(1, 4):
        put(rows.where(batch == n), n)
    run(spark, folder, rows.schema, out)
    some = spark.read.parquet(f"{out}/rows").count()
    assert 0 < some < rows.count()
    # Started again from its checkpoint; calls of the first step are too late now; a call of another case days later moves the watermark on.
    late = rows.where("step = 1").limit(3).withColumn("tool", F.lit("too_late"))
    for n in range(4, last + 1):
        put(rows.where(batch == n), n)
    put(late, last + 1)
    put(rows.limit(1).withColumns({"case_id": F.lit(-1).cast("long"), "at": F.expr("timestamp'2021-01-01'")}), last + 2)
    run(spark, folder, rows.schema, out)
    got = spark.read.parquet(f"{out}/rows").where("case_id >= 0")
    cols = ["case_id", "n", "tool", "code", "status", "finalized"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    rows.unpersist()


def test_closed_cases_are_forgotten(spark, rocks, tmp_path):
    call = lambda case, hour, tool, **k: (case, 0, 0, 0, 0.0, tool, *[{"mutates": True, "rests": True, "finalizes": False, **k}.get(c) for c in E.CALL], hour)
    rows = [call(1, 0, "finalize_case", effect="finalized", finalizes=True), call(2, 0, "release_item", effect="released")]
    later = [call(9, 30, "x")], [call(9, 31, "x")], [call(9, 32, "x")], [call(1, 40, "release_item", effect="released"), call(2, 40, "finalize_case", effect="finalized", finalizes=True)], [call(9, 400, "x")]
    schema = "case_id long, step int, part long, supp long, amount double, tool string, gate string, domain_error string, late_error string, effect string, selects_stale boolean, mutates boolean, rests boolean, finalizes boolean, hour int"
    made = None
    for n, part in enumerate((rows, *later)):
        made = spark.createDataFrame(part, schema).withColumn("at", F.expr("timestamp'2020-01-01 00:00:00' + make_dt_interval(0, hour)"))
        made.coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    run(spark, f"{tmp_path}/in", made.schema, f"{tmp_path}/out", keep_ms=3_600_000, late="1 minute")
    got = {(r.case_id, r.n, r.code) for r in spark.read.parquet(f"{tmp_path}/out/rows").where("case_id < 9").collect()}
    assert got == {(1, 1, "ok"), (2, 1, "ok"), (1, 1, "ok"), (2, 2, "ok")}


def test_a_group_of_cases_is_one_state():
    """A hundred cases of one group: two reads and writes of the state and a timer, not some for each case."""
    import pandas as pd

    from palimpsest.streaming.calls import CaseFold

    class Handle:
        value, uses, timers = None, 0, []

        def getValueState(self, *_):  # noqa: N802
            return self

        def registerTimer(self, ms):  # noqa: N802
            self.timers.append(ms)

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value, self.uses = value, self.uses + 1

    class Time:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    rows = [(case, 1000 * at, "x", *[{"mutates": True, "rests": True, "finalizes": False}.get(c) for c in E.CALL]) for case in range(100) for at in (2, 1, 9)]
    fold, handle = CaseFold("case_id", [], 10**12), Handle()
    fold.init(handle)
    list(fold.handleInputRows(None, iter([pd.DataFrame(rows, columns=["case_id", "call_ms", "tool", *E.CALL])]), Time(0)))
    out = pd.concat(fold.handleExpiredTimer(None, Time(5000), Time(1000)))
    assert (len(out), sorted(set(out["n"])), handle.uses, handle.timers) == (200, [1, 2], 2, [1000, 9000])
