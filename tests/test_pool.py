import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from newsflow import catalog
from newsflow.operators import pool as p

COLS = ("id string, source_id string, origin string, published_at timestamp, fetched_at timestamp, "
        "suggestion_last_checked_at timestamp, ingestion_run_id string, ingestion_source string, suggestion_state string")


def ts(minutes):
    import datetime

    return datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=minutes)


def run_id(n):
    return f"00000000-0000-4000-8000-{n:012d}"


def row(i, source, origin="rss", published=True, checked=False, run=None, state=None):
    return (f"{i:05d}", source if origin == "rss" else None, origin, ts(i) if published else None, ts(i),
            ts(i) if checked else None, run, f"{origin}:{source}" if origin else None, state)


def fixture_rows():
    """123 rows of one run, a feed backlog, correspondent rows, direct and unknown ones."""
    rows, i = [], 0
    for n in range(123):
        rows.append(row(i := i + 1, f"s{n % 12}", published=n % 10 != 0, run=run_id(1)))
    for n in range(180):
        rows.append(row(i := i - 1000 if n == 0 else i + 1, f"b{n % 18}", published=n % 3 != 0))
    i = 5000
    for n in range(80):
        rows.append(row(i := i - 1, f"c{n % 8}", "correspondent", published=n % 2 == 0))
    for n in range(30):
        rows.append(row(i := i - 1, "d", "url"))
        rows.append(row(i := i - 1, "n", None))
    return [(f"{k:05d}", *r[1:]) for k, r in enumerate(rows)]


def loop_round_robin(rows):
    """The plain loop: unchecked sources take turns, then checked ones."""
    out = []
    for checked in (False, True):
        queues = {}
        for r in rows:
            if (r["suggestion_last_checked_at"] is not None) == checked:
                queues.setdefault(r["key"], []).append(r["id"])
        while any(queues.values()):
            for q in queues.values():
                if q:
                    out.append(q.pop(0))
    return out


@settings(max_examples=3, deadline=None)
@given(hs.integers(0, 10**6))
def test_round_robin_equals_the_loop(spark, seed):
    rnd = random.Random(seed)
    rows = [row(i, f"s{rnd.randint(0, 4)}", rnd.choice(["rss", "correspondent", None]), rnd.random() < 0.7, rnd.random() < 0.3) for i in range(60)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, COLS).repartition(5)
    got = [r.id for r in p.source_round_robin(df).orderBy("rr").collect()]
    ordered = df.withColumn("key", p.source_key()).orderBy(*p.pool_order()).collect()
    assert got == loop_round_robin([r.asDict() for r in ordered])
    assert [r.id for r in p.source_round_robin(df, keep=17).orderBy("rr").collect()] == got[:17]


def test_weighted_round_robin_equals_the_loop(spark):
    rnd = random.Random(3)
    for _ in range(2):
        queues = [(w, [f"q{k}-{i}" for i in range(rnd.randint(0, 9))]) for k, w in enumerate([4, 3, 1, 2])]
        rows = [(name, k, i + 1, w) for k, (w, names) in enumerate(queues) for i, name in enumerate(names)]
        df = spark.createDataFrame(rows, "id string, queue int, rn int, weight int")
        left, want = [list(n) for _, n in queues], []
        while any(left):
            for q, (w, _) in zip(left, queues):
                want += q[:w]
                del q[:w]
        assert [r.id for r in p.weighted_round_robin(df, 20).orderBy("wrr").collect()] == want[:20]


def test_pool_shares_and_partition_independence(spark):
    rows = fixture_rows()
    df = spark.createDataFrame(rows, COLS)
    pools = []
    for n, seed in ((1, 0), (7, 5)):
        random.Random(seed).shuffle(rows)
        got = p.select_pool(spark.createDataFrame(rows, COLS).repartition(n), 100)
        pools.append([tuple(r) for r in got.orderBy("pool_pos").collect()])
    assert pools[0] == pools[1]
    assert sum(r[-2] == "cohort" for r in pools[0]) == 70 and len(pools[0]) == 100
    counts = {(r.dimension, r.key): r.n for r in p.pool_diagnostics(p.select_pool(df, 100)).collect()}
    assert counts[("part", "remainder")] == 30 and counts[("origin", "rss")] >= 70


def test_a_large_cohort_does_not_hide_the_backlog(spark):
    rows = [row(i, "big", run=run_id(1)) for i in range(400)] + [row(1000 - i, "old") for i in range(700, 720)]
    rows = [(f"{k:05d}", *r[1:]) for k, r in enumerate(rows)]
    got = p.select_pool(spark.createDataFrame(rows, COLS), 100, run_id(1)).collect()
    assert sum(r.source_id == "old" for r in got) == 20


def test_resolve_run_falls_back_from_an_unusable_preference(spark):
    df = spark.createDataFrame([row(1, "a", run=run_id(1)), row(2, "a", run=run_id(2)), row(3, "a", run=run_id(3), state="used")], COLS)
    assert tuple(p.resolve_run(df, run_id(1)).first()) == (run_id(1), False)
    assert tuple(p.resolve_run(df, run_id(3)).first()) == (run_id(2), True)
    assert tuple(p.resolve_run(df, "x").first()) == (run_id(2), True)
    assert tuple(p.resolve_run(df).first()) == (run_id(2), False)
    assert tuple(p.resolve_run(df.limit(0)).first()) == (None, False)


def test_completion(spark):
    pool = spark.createDataFrame([(str(i),) for i in itertools.chain(range(62), range(3))], "id string")
    failed = spark.createDataFrame([(str(i),) for i in range(50, 80)], "id string")
    done = {r.id: r.outcome for r in p.completion(pool, failed, False).collect()}
    assert len(done) == 62 and sum(o == "retryable" for o in done.values()) == 12
    assert set(r.outcome for r in p.completion(pool, failed, True).collect()) == {"retryable"}


def test_limit_is_clamped():
    assert [p.clamp_limit(n) for n in (1, 61, 100, 120, 999)] == [60, 80, 100, 120, 200]


def test_legacy_pool_puts_undated_rows_first(spark):
    df = spark.createDataFrame([row(1, "a"), row(2, "a", published=False), row(3, "a", state="used")], COLS)
    assert [r.id for r in p.pool_legacy(df, 5).orderBy("pool_pos").collect()] == ["00002", "00001"]
    assert p.pool_legacy(df, 5).where(F.col("pool_pos") == 1).first().published_at is None


def scans(df):
    """How often the plan reads the articles."""
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_the_pool_reads_the_articles_twice(spark):
    sf_dir = "/root/testdata/sf0.001"
    queries = catalog.all_queries()
    assert scans(queries["pool_select"](spark, sf_dir)) <= 3
    assert scans(queries["pool_fair_queues"](spark, sf_dir)) <= 3
    assert scans(queries["run_suggest_input"](spark, sf_dir)) <= 6
