"""Streams give what the batch jobs give on the same rows."""

import datetime
import random

import pytest
from compare import DATA
from pyspark.sql import functions as F

from offerloom.operators import traffic
from offerloom.plans.views import Catalog
from offerloom.sources.snapshot import Snapshot
from offerloom.streaming import refresh
from offerloom.streaming import traffic as streams


def run(spark, stream, name, folder):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.table(name)


FAR = datetime.datetime(2100, 1, 1)


def shuffled_log(spark, folder, delay_minutes=40, files=6):
    """A log whose requests arrive up to half the delay late, in files of a micro-batch each, and a last request that moves the watermark past all."""
    log = Catalog(spark, f"{DATA}/sf0.001").request_log.withColumn("ts", F.col("ts").cast("timestamp"))
    # some thousands of seconds hold the log, so that clients are busy; every client is one of four
    first = log.agg(F.min("ts")).first()[0]
    squeezed = (F.unix_seconds("ts") - F.unix_seconds(F.lit(first))) % 20_000
    log = log.withColumn("ts", F.timestamp_seconds(F.lit(1_600_000_000) + squeezed)).withColumn("client_key", F.concat(F.lit("u"), (F.col("event_id") % 4).cast("string"))).cache()
    rng = random.Random(2)
    rows = sorted(log.collect(), key=lambda r: r["ts"].timestamp() + rng.random() * delay_minutes * 30)
    for i in range(files):
        part = rows[i * len(rows) // files : (i + 1) * len(rows) // files]
        spark.createDataFrame(part, log.schema).coalesce(1).write.parquet(f"{folder}/{i:02}")
    last = spark.createDataFrame([(10**9, FAR, "end", "", "x")], "event_id long, ts timestamp, client_key string, url string, user_agent string")
    last.select([F.col(c).cast(log.schema[c].dataType) for c in log.columns]).coalesce(1).write.parquet(f"{folder}/{files:02}")
    return log


@pytest.mark.parametrize("files_at_once", [1, 3])
def test_streams_equal_batches_on_shuffled_arrival(spark, tmp_path, files_at_once):
    log = shuffled_log(spark, tmp_path / "in")
    source = lambda: spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files_at_once).parquet(str(tmp_path / "in/*"))
    name = f"n{files_at_once}"
    got = run(spark, streams.return_visits(source(), minutes=1, delay="40 minutes"), f"visits_{name}", tmp_path / "c1")
    want = sorted(map(tuple, traffic.return_visits(log, 1).select("event_id", "is_return").collect()))
    assert sorted(map(tuple, got.where("client_key <> 'end'").select("event_id", "is_return").collect())) == want
    got = run(spark, streams.rate_limit(source(), 600, 3, delay="40 minutes"), f"limits_{name}", tmp_path / "c2")
    want = sorted(map(tuple, traffic.rate_limit(log, 600, 3).select("event_id", "blocked").collect()))
    assert sorted(map(tuple, got.where("client_key <> 'end'").select("event_id", "blocked").collect())) == want
    assert any(b for _, b in want) and not all(b for _, b in want)


def test_visits_are_forgotten_by_event_time(spark, tmp_path):
    day = lambda n: datetime.datetime(2026, 1, n)
    log = spark.createDataFrame([(1, day(1), "a"), (2, day(2), "a"), (3, day(9), "a"), (4, day(10), "b"), (5, day(20), "b")], "event_id long, ts timestamp, client_key string").withColumn("url", F.lit(""))
    for i in range(1, 6):
        log.where(f"event_id = {i}").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    log.limit(1).select(F.lit(9).cast("long").alias("event_id"), F.lit(FAR).alias("ts"), F.lit("end").alias("client_key"), "url").write.parquet(str(tmp_path / "in/9"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = run(spark, streams.return_visits(stream, keep_days=5, delay="1 hour"), "kept", tmp_path / "c")
    want = {(1, False), (2, True), (3, False), (4, False), (5, False)}
    assert {tuple(r) for r in traffic.return_visits(log, keep_days=5).select("event_id", "is_return").collect()} == want
    assert {tuple(r) for r in got.where("event_id < 9").select("event_id", "is_return").collect()} == want


BANKS = ("seylan", "dfcc")
NOW = "2026-06-01T00:00:00.000Z"


def scrapes(spark, most):
    return Catalog(spark, f"{DATA}/sf0.001").scrape_raw.where(f"seq < {most}").withColumn("bank_id", F.when(F.col("seq") % 2 == 0, BANKS[0]).otherwise(BANKS[1]))


def stored(spark, snap, *names):
    schema = refresh.stored_schema(refresh.scrape_offers(NOW)(scrapes(spark, 1)))
    return snap.read("offers", schema).select(*(names or schema.names))


def test_refresh_of_whole_batches_is_idempotent(spark, tmp_path):
    rows = scrapes(spark, 40).cache()
    snap = Snapshot(spark, str(tmp_path / "store"))
    refresh.refresh_batch(snap, rows, 0, NOW, NOW)
    first = stored(spark, snap).count()
    assert snap.version() == 0 and first > 0
    refresh.refresh_batch(snap, rows.where("seq < 5"), 0, NOW, NOW)  # an old batch id changes nothing
    assert snap.version() == 0 and stored(spark, snap).count() == first
    # the batch is the whole of dfcc: what it lacks goes inactive, other banks stay
    refresh.refresh_batch(snap, rows.where("bank_id = 'dfcc' and seq < 8"), 1, NOW, NOW)
    later = stored(spark, snap)
    assert snap.version() == 1 and later.count() == first
    assert {r[0] for r in later.where("status = 'inactive'").select("bank_id").distinct().collect()} == {"dfcc"}
    # rows of a batch that is older than what is stored change nothing
    before = sorted(map(tuple, later.collect()))
    refresh.refresh_batch(snap, rows.where("bank_id = 'seylan'"), 2, "2026-05-01T00:00:00.000Z", NOW)
    assert sorted(map(tuple, stored(spark, snap).collect())) == before


def test_refresh_runs_as_a_stream(spark, tmp_path):
    rows = scrapes(spark, 60)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    snap = Snapshot(spark, str(tmp_path / "store"))
    source = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    assert refresh.start(source(), snap, str(tmp_path / "c"), NOW, NOW).awaitTermination(120)
    once = Snapshot(spark, str(tmp_path / "once"))
    refresh.refresh_batch(once, rows, 0, NOW, NOW)
    same = lambda s: sorted(map(str, stored(spark, s, "id", "title", "status").collect()))
    assert same(snap) == same(once) and len(same(snap)) > 0
    assert refresh.start(source(), snap, str(tmp_path / "c"), NOW, NOW).awaitTermination(120)  # nothing new
    assert snap.version() == 0


# --- runs --------------------------------------------------------------------------------

RUN = "bank_id string, id string, title string, valid_until string, status string, seq long, run long, at timestamp, total long"


def run_rows(banks=("a", "b"), runs=3, seed=1):
    """Rows of runs in order of time, each run with its end; later runs lack some offers and bring others."""
    rng, out = random.Random(seed), []
    for run in range(1, runs + 1):
        for k, bank in enumerate(banks):
            chosen = [i for i in range(6) if rng.random() < 0.6] if (bank, run) != (banks[0], 2) else []
            at = lambda j: datetime.datetime(2026, 1, run, k, j)  # noqa: B023, E731
            out += [(bank, f"{bank}{i}", f"t{run}", "2026-01-02" if i == 0 else None, "active", i, run, at(i), None) for i in chosen]
            out.append((bank, None, None, None, None, None, run, at(59), len(chosen)))
    return out


def offers_of(t):
    return t.drop("run", "at", "total")


def fed(spark, folder, rows, cuts, **options):
    """The catalog after rows in micro-batches that end at cuts."""
    snap = Snapshot(spark, str(folder))
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        refresh.apply_runs(snap, spark.createDataFrame(rows[a:b], RUN), i, offers_of, **options)
    return snap


def catalog_of(spark, snap):
    return sorted(map(str, snap.read("offers", refresh.stored_schema(offers_of(spark.createDataFrame([], RUN)))).collect()))


def plain_catalog(rows):
    """{id: (title, status, first seen, last seen, last checked)} by one run after another."""
    told = {}
    for bank, run in sorted({(r[0], r[6]) for r in rows}, key=lambda x: x[::-1]):
        mine = [r for r in rows if (r[0], r[6]) == (bank, run)]
        now = max(r[7] for r in mine).strftime("%Y-%m-%dT%H:%M:%S.000Z")
        fresh = {r[1]: r for r in mine if r[8] is None}
        for key, old in list(told.items()):
            if old[5] == bank and key not in fresh:
                told[key] = (old[0], "expired" if old[1] == "expired" else "inactive", old[2], old[3], now, bank)
        for key, r in fresh.items():
            status = "expired" if r[3] and r[3] + "T23:59:59" < now else "active"
            told[key] = (r[2], status, told[key][2] if key in told else now, now, now, bank)
    return sorted((k, *v) for k, v in told.items())


def test_any_split_of_runs_gives_one_result(spark, tmp_path):
    rows = run_rows()
    want = catalog_of(spark, fed(spark, tmp_path / "one", rows, []))
    snap = Snapshot(spark, str(tmp_path / "one"))
    got = snap.read("offers", refresh.stored_schema(offers_of(spark.createDataFrame([], RUN)))).select("id", "title", "status", "first_seen_at", "last_seen_at", "last_checked_at", "bank_id")
    assert sorted(map(tuple, got.collect())) == plain_catalog(rows)
    rng = random.Random(5)
    for n in range(3):
        cuts = sorted(rng.sample(range(1, len(rows)), 2 + n))
        assert catalog_of(spark, fed(spark, tmp_path / f"split{n}", rows, cuts)) == want


def test_rows_in_any_order_within_runs(spark, tmp_path):
    """Ends before rows, and a bank's second run complete before its first."""
    rows = run_rows(banks=("a",), runs=2, seed=4)
    want = plain_catalog(rows)
    late_first = [r for r in rows if r[6] == 2] + [r for r in rows if r[6] == 1][::-1]
    first_known = rows[:1] + late_first[:-1] if late_first[-1] == rows[0] else late_first
    snap = fed(spark, tmp_path / "s", first_known, [1, 3])
    got = snap.read("offers", refresh.stored_schema(offers_of(spark.createDataFrame([], RUN)))).select("id", "title", "status", "first_seen_at", "last_seen_at", "last_checked_at", "bank_id")
    assert sorted(map(tuple, got.collect())) == want
    assert snap.read("open_runs", refresh.OPEN).count() == 0 and snap.state().rows("pending") == 0


def test_runs_without_an_end_and_late_rows(spark, tmp_path):
    rows = [r for r in run_rows(banks=("a",), runs=2) if r[8] is None or r[6] == 1]
    two = [r for r in rows if r[6] == 2] or [("a", "a5", "t2", None, "active", 5, 2, datetime.datetime(2026, 1, 2), None)]
    one = [r for r in rows if r[6] == 1]
    snap = fed(spark, tmp_path / "s", one + two, [len(one)], delay="1 hour")
    assert snap.read("open_runs", refresh.OPEN).count() == 1  # the second run waits
    later = ("b", "b1", "t", None, "active", 1, 1, datetime.datetime(2026, 1, 9), None)
    refresh.apply_runs(snap, spark.createDataFrame([later], RUN), 2, offers_of, delay="1 hour")
    assert [r["bank_id"] for r in snap.read("open_runs", refresh.OPEN).collect()] == ["b"]
    before = catalog_of(spark, snap)
    # a row of a merged run is late; so is a batch id that was stored before
    refresh.apply_runs(snap, spark.createDataFrame([one[0]], RUN), 3, offers_of)
    refresh.apply_runs(snap, spark.createDataFrame([later], RUN), 3, offers_of)
    assert catalog_of(spark, snap) == before
    assert {(r["bank_id"], r["run"], r["late"]) for r in snap.read("applied", refresh.APPLIED).collect()} == {("a", 2, 1)}
    refresh.apply_runs(snap, spark.createDataFrame([], RUN), 4, offers_of, finish=True)
    assert snap.read("open_runs", refresh.OPEN).count() == 0 and any("b1" in x for x in catalog_of(spark, snap))


def test_runs_as_a_stream(spark, tmp_path):
    rows = run_rows()
    for i in range(0, len(rows), 7):
        spark.createDataFrame(rows[i : i + 7], RUN).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    snap = Snapshot(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema(spark.createDataFrame([], RUN).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert refresh.start_runs(stream, snap, str(tmp_path / "c"), offers_of).awaitTermination(240)
    assert catalog_of(spark, snap) == catalog_of(spark, fed(spark, tmp_path / "one", rows, []))
