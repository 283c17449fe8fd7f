"""The log as keyed state: batches, restarts and replays against a loop over the whole log."""

import random
import tempfile

from pyspark.sql import functions as F

from spanloom.operators import results
from spanloom.streaming import machine

SCHEMA = "k string, seq long, ok boolean, who string"


def plain_events(rows):
    state, out = {}, []
    for k, seq, ok, who in rows:
        s = state.setdefault(k, {"who": who, "last": None, "n": 0, "done": False})
        if s["last"] is not None and who != s["who"]:
            event = "identity_changed"
        elif s["last"] is not None and seq <= s["last"]:
            event = "out_of_order"
        elif s["done"]:
            event = "after_complete"
        else:
            s.update(who=who, last=seq, n=s["n"] + 1, done=ok)
            event = "complete" if ok else "attempt"
        out.append((k, seq, event, s["n"]))
    return out


def follow(spark, base, out="out", files=1):
    return machine.follow(spark, f"{base}/in", SCHEMA, f"{base}/{out}", f"{base}/{out}-checkpoint", ["k"], "seq", F.col("ok"), F.col("who"), files=files)


def test_batches_and_restarts_give_the_same_rows(spark):
    rng, base = random.Random(3), "file://" + tempfile.mkdtemp(prefix="spanloom-log-")
    rows = [(rng.choice(["a", "b", "c", None, "e"]), seq, rng.random() < 0.15, rng.choice(["x"] * 9 + ["y", None])) for seq in range(60)]
    rows[30] = (rows[10][0], 10, False, rows[10][3])  # an older record comes again
    write = lambda part: spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
    order = lambda x: sorted(map(tuple, x), key=str)
    for k in range(3):
        write(rows[15 * k : 15 * k + 15])
    got = follow(spark, base)
    assert order(got.collect()) == order(plain_events(rows[:45]))
    # restarted from its checkpoint, with one more file: keys go on where they were
    write(rows[45:])
    got = follow(spark, base)
    assert order(got.collect()) == order(plain_events(rows))
    assert order(follow(spark, base).collect()) == order(plain_events(rows))
    # the whole log again as one batch, where in-order logs agree with the batch operator
    one = "file://" + tempfile.mkdtemp(prefix="spanloom-log-")
    plain = [(k, seq, ok, "x") for k, seq, ok, _ in rows if seq != 10]
    spark.createDataFrame(plain, SCHEMA).repartition(3).write.parquet(f"{one}/in")
    found = follow(spark, one, files=None).where("event = 'after_complete'").select("sequence")
    batch = results.retried_after_complete(spark.read.parquet(f"{one}/in").withColumn("k", F.coalesce("k", F.lit("-"))), ["k"], "seq", F.col("ok")).select("seq")
    assert sorted(r[0] for r in found.collect()) == sorted(r[0] for r in batch.collect())


def test_silent_keys_become_due(spark):
    base = "file://" + tempfile.mkdtemp(prefix="spanloom-log-")
    schema = "k string, seq long, ok boolean, at timestamp"
    day = lambda k, seq, ok, minute: (k, seq, ok, f"2024-01-01 00:{minute:02d}:00")
    for part in ([day("failed", 1, False, 0), day("done", 2, True, 0), day("again", 3, False, 0)], [day("again", 4, False, 20), day("late", 5, False, 21)], [day("end", 6, True, 40)]):
        spark.createDataFrame(part, "k string, seq long, ok boolean, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(f"{base}/in")
    got = machine.follow(spark, f"{base}/in", schema, f"{base}/out", f"{base}/c", ["k"], "seq", F.col("ok"), F.lit(None), files=1, time="at", patience=600)
    due = {(r["k"], r["sequence"]) for r in got.where("event = 'due'").collect()}
    assert ("failed", 1) in due and ("again", 4) in due and ("late", 5) in due and not {k for k, _ in due} & {"done", "end"}
