"""As-of joins, scheduled commands and timers against loops."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import sessions, voxel
from sparkloom.operators.commands import firings, parse_schedule
from sparkloom.plans.asof import last_before, next_after
from sparkloom.sources.scripts import parse_commands
from sparkloom.streaming import timers


def key(r):
    return tuple("-" if v is None else str(v) for v in r)


@pytest.mark.parametrize("parts", [1, 7])
def test_next_and_last(spark, parts):
    """Against a search in lists; one key has most rows, orders repeat, keys and orders may be null."""
    r = random.Random(parts)
    pick = lambda: (r.choice(["hot"] * 8 + ["a", "b", None]), r.choice([None] + list(range(12))), r.randrange(100))
    left, right = [pick() for _ in range(150)], [pick() for _ in range(40)]
    rank = lambda o: -1 if o is None else o
    want_next, want_last = Counter(), Counter()
    for k, o, v in left:
        after = sorted((rank(p), q, p) for kk, p, q in right if kk == k and rank(p) > rank(o))
        before = sorted((rank(p), q, p) for kk, p, q in right if kk == k and rank(p) < rank(o))
        want_next[key((k, o, v, *((after[0][2], after[0][1]) if after else (None, None))))] += 1
        want_last[key((k, o, v, *((before[-1][2], before[-1][1]) if before else (None, None))))] += 1
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    a, b = spark.createDataFrame(left, "k string, o int, v int"), spark.createDataFrame(right, "k string, o int, q int")
    got_next = Counter(key(x) for x in next_after(a, b, ["k"], ["o"], ["q"]).collect())
    got_last = Counter(key(x) for x in last_before(a, b, ["k"], ["o"], ["q"]).collect())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got_next == want_next and got_last == want_last


def test_asof_without_rows(spark):
    a = spark.createDataFrame([("x", 1)], "k string, o int")
    none = a.limit(0)
    assert [tuple(r) for r in next_after(a, none, ["k"], ["o"]).collect()] == [("x", 1, None)]
    assert next_after(none, a, ["k"], ["o"]).collect() == []


def world(entries, last):
    """A schedule run tick by tick: what is due is run and forgotten at the beginning of a tick, then that tick's commands are entered."""
    table, ran = {}, []
    for tick in range(last + 1):
        ran += [(tick, nth, at) for nth, at in table.pop(tick, [])]
        for at, nth, verb, due in sorted(e for e in entries if e[0] == tick):
            if verb == "clear":
                table.clear()
            else:
                table.setdefault(due, []).append((nth, at))
    return sorted(ran)


def test_commands_against_a_loop(spark):
    r = random.Random(5)
    entries, rows = {}, []
    for w in ("hot", "cold", "still"):
        at, entries[w] = 0, []
        for nth in range({"hot": 300, "cold": 25, "still": 3}[w]):
            at += r.choice([0, 0, 1, 3])
            verb = "clear" if r.random() < (0.08 if w != "still" else 0) else "sched"
            entries[w].append((at, nth, verb, at + r.randrange(-2, 30) if verb == "sched" else None))
        rows += [(w, *e) for e in entries[w]]
    frame = spark.createDataFrame(rows + [("hot", None, 999, "sched", 5), ("cold", 3, 1000, "sched", None)], "world string, tick long, nth long, verb string, due long")
    got = Counter((x.world, x.tick, x.nth, x.entered) for x in firings(frame, ["world"]).collect())
    assert got == Counter((w, *e) for w in entries for e in world(entries[w], 1000))


def test_schedule_of_a_script(spark):
    text = "sched 10 setblock 1 2 3 4\nsched x fill\nsched 5\nsched 7 nothing a\nclear_sched\nsched -1 fill\nsched 12 fill a b\nsay hi"
    rows = parse_schedule(parse_commands(spark.createDataFrame([("f", text)], "file string, text string")), ["setblock", "fill"]).orderBy("nth").collect()
    assert [(x.nth, x.verb, x.due, x.scheduled, x.scheduled_args) for x in rows] == [(0, "sched", 10, "setblock", ["1", "2", "3", "4"]), (4, "clear", None, None, None), (6, "sched", 12, "fill", ["a", "b"])]
    run = firings(parse_schedule(parse_commands(spark.createDataFrame([("f", text)], "file string, text string")), ["setblock", "fill"]).withColumn("tick", F.lit(0).cast("long")), ["file"]).collect()
    assert [(x.tick, x.scheduled) for x in run] == [(12, "fill")]


def in_batches(spark, frame, parts, tmp_path, make, last):
    """``make`` of a stream of files, one a micro-batch; between two of them the query ends and starts again from its checkpoint. ``last`` is a row that moves the clock on."""
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    rows = frame.collect()
    for i, chunk in enumerate([rows[k::parts] for k in range(parts)] + [[last]]):
        spark.createDataFrame(chunk, frame.schema).coalesce(1).write.mode("append").parquet(source)
        if i % 2 and i < parts:
            continue  # two files at once
        stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = make(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
        query.awaitTermination()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return spark.read.parquet(out)


def test_keep_alive_as_a_stream(spark, tmp_path):
    r = random.Random(9)
    rows = []
    for client in ("a", "b", "c", "d"):
        at = r.randrange(10_000)
        for _ in range(12):
            rows.append((client, at))
            at += r.choice([0, 500, 14_999, 15_000, 15_001, 29_000, 30_000, 30_001, 50_000])
    r.shuffle(rows)
    events = spark.createDataFrame([*rows, (None, 5), ("a", None)], "user_id string, ms long").select("user_id", F.timestamp_millis("ms").alias("ts"))
    end = 10_000_000
    clock = spark.createDataFrame([("clock", end + 86_400_000)], "user_id string, ms long").select("user_id", F.timestamp_millis("ms").alias("ts")).first()
    got = in_batches(spark, events, 3, tmp_path, lambda s: timers.keep_alive(s, late="1 day"), clock).where("client <> 'clock'")
    signs = Counter((x.client, x.us, x.gap, x.what) for x in got.where("what not like 'send%'").collect())
    want = Counter((x.user_id, x.us, x.gap, x.what) for x in sessions.gaps(events).select("user_id", F.unix_micros("ts").alias("us"), "gap", "what").collect())
    assert signs == want
    sent = Counter((x.client, x.us, x.what) for x in got.where("what like 'send%'").collect())
    assert sent == Counter((x.user_id, x.us, x.what) for x in sessions.deadlines(events, until=end * 1000).collect())


def test_due_work_as_a_stream(spark, tmp_path):
    r = random.Random(4)
    rows = [(r.randrange(3), 0, 0, r.randrange(4), r.choice([None, *range(30)]), r.randrange(100)) for _ in range(120)]
    work = spark.createDataFrame(rows, "x int, y int, z int, type int, trigger_tick long, ms long").withColumn("ts", F.timestamp_millis("ms")).drop("ms")
    clock = spark.createDataFrame([(9, 9, 9, 9, 1000, 10 * 50)], "x int, y int, z int, type int, trigger_tick long, ms long").withColumn("ts", F.timestamp_millis("ms")).drop("ms").first()
    got = in_batches(spark, work, 3, tmp_path, lambda s: timers.due_work(s, late="100 milliseconds"), clock).collect()
    due = voxel.due(work.drop("ts").distinct(), 8).collect()  # the clock stands at tick 10, less two ticks for late rows
    assert Counter(tuple(x) for x in got) == Counter((x.x, x.y, x.z, x.type, x.trigger_tick) for x in due)
