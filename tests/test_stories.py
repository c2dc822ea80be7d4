import random
import time

import plain_merge
import pytest
from pyspark.sql import functions as F

from newsflow.functions.lineage import store
from newsflow.operators import stories as st
from newsflow.operators.components import components


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    rnd = random.Random(seed)
    edges = [(f"n{rnd.randint(0, 60):02d}", f"n{rnd.randint(0, 60):02d}") for _ in range(45)] + [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(30)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = sorted((find(a), find(b)))
            parent[rb] = ra
    want = {n: find(n) for n in parent}
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == want


MEMBER = ("array<struct<id:string,text:string,story:string,source:string,source_id:string,published_at:timestamp,"
          "event_date:date,ents:array<string>,evidence:boolean>>")


def group(run, gid, pos, topic, keywords, ents, text, date=None, hour=0):
    import datetime

    member = (f"a{gid}", text, text, "", "s", datetime.datetime(2026, 1, 1, hour), date, ents, True)
    return (run, gid, pos, topic, keywords, [f"a{gid}"], "r", ents, 0, [member])


GROUP = f"run_id string, group_id string, pos long, topic string, keywords array<string>, article_ids array<string>, reason string, common_entities array<string>, cohesion_score int, members {MEMBER}"


def random_groups(seed):
    rnd = random.Random(seed)
    words = ["berlin fire", "berlin", "closing night", "warehouse", "closure", "tokyo"]
    rows = []
    for i in range(6):
        ks = rnd.sample(words, rnd.randint(1, 3))
        ents = rnd.sample(["Alpha One", "Beta Two", "Gamma"], rnd.randint(0, 2))
        text = " ".join([*words, *(e.lower() for e in ents)]) if rnd.random() < 0.8 else " ".join(ks)
        rows.append(group("r1" if i < 4 else "r2", f"g{i:02d}", i, f"Topic {i}", ks, ents, text))
    return rows


def keys(df):
    return sorted(("+".join(r.merged_from), r.topic, tuple(r.keywords), tuple(r.article_ids), tuple(r.common_entities), r.cohesion_score) for r in df.collect())


def test_merging_equals_the_plain_merge(spark):
    rows = []
    for seed in range(12):
        rows += [(f"{r[0]}-{seed}", f"{r[1]}-{seed}", *r[2:]) for r in random_groups(seed)]
    df = spark.createDataFrame(rows, GROUP)
    runs = plain_merge.prepared(df).values()
    want = sorted(k for run in runs for k in plain_merge.keys(plain_merge.merge_in_rounds(run)))
    assert keys(st.merge_groups(df)) == want and sum(len(k[0].split("+")) for k in want) == len(rows) > len(want)
    assert keys(st.merge_groups(df.repartition(7))) == want


def test_merging_at_once_equals_merging_one_by_one(spark):
    """The same parts meet, where the order of merges decides nothing."""
    rows = []
    for seed in range(12):
        rows += [(f"{r[0]}-{seed}", f"{r[1]}-{seed}", *r[2:]) for r in random_groups(seed)]
    runs = plain_merge.prepared(spark.createDataFrame(rows, GROUP)).values()
    parts = lambda merge: [sorted("+".join(sorted(g["parts"])) for g in merge([dict(g) for g in run])) for run in runs]
    same = [a == b for a, b in zip(parts(plain_merge.merge_in_rounds), parts(plain_merge.merge_one_by_one), strict=True)]
    assert sum(same) >= 0.9 * len(same)


def test_a_run_of_many_rounds_is_planned_in_time(spark):
    """Ten alike groups merge one pair a round; with checkpoints the plan of the sixth round took over half a minute."""
    rows = [group("r", f"g{i}", i, f"Topic {i}", ["berlin fire"], ["Alpha One"], "alpha one berlin fire") for i in range(10)]
    df = spark.createDataFrame(rows, GROUP)
    want = sorted(k for run in plain_merge.prepared(df).values() for k in plain_merge.keys(plain_merge.merge_in_rounds(run)))
    start = time.monotonic()
    assert keys(st.merge_groups(df)) == want and len(want) == 1
    assert time.monotonic() - start < 300


def test_a_stored_table_hands_on_no_constraints(spark):
    df = spark.range(3).where("id > 0").selectExpr("id", "id AS b")
    stored = store(df)
    assert df._jdf.queryExecution().analyzed().constraints().size() > 0
    assert stored._jdf.queryExecution().analyzed().constraints().size() == 0
    assert sorted(stored.collect()) == sorted(df.collect())


def test_pairs_meet_by_key_without_a_broadcast(spark):
    """How many keys a group has is unknown to the planner, so a small file could fill the driver."""
    b = st._blocked(spark.createDataFrame(random_groups(1), GROUP))
    plan = st._meet(b, b)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_no_groups(spark):
    assert st.merge_groups(spark.createDataFrame([], GROUP)).count() == 0


def test_merge_needs_a_common_story(spark):
    same = [group("r", "g1", 1, "A", ["venue closure"], ["Alpha One"], "alpha one venue closure"), group("r", "g2", 2, "B", ["closure"], ["Alpha One"], "alpha one closure of the venue")]
    other = [group("r", "g3", 3, "C", ["album"], ["Alpha One"], "alpha one album"), group("r", "g4", 4, "D", ["venue closure"], ["Alpha One"], "alpha one venue closure", hour=3)]
    import datetime

    dated = [group("q", "g5", 1, "A", ["venue closure"], ["X Y"], "x y venue closure", datetime.date(2026, 1, 1)), group("q", "g6", 2, "B", ["venue closure"], ["X Y"], "x y venue closure", datetime.date(2026, 1, 2))]
    got = {"+".join(r.merged_from) for r in st.merge_groups(spark.createDataFrame(same + other + dated, GROUP)).collect()}
    assert "g5" in got and "g6" in got and "g3" in got
    assert any(set(k.split("+")) == {"g1", "g2", "g4"} for k in got)


def test_proposals_are_parsed(spark):
    rows = [("1", '{"suggestions":[{"topic":"T","articleIds":["a"],"keywords":["k"]}]}'), ("2", 'x {"suggestions":[{"topic":"U","articleIds":["a","b"]}]} y'), ("3", '{"sugg')]
    got = {r.output_id: (r.parse, r.topic, r.is_singleton) for r in st.parse_proposals(spark.createDataFrame(rows, "output_id string, response string")).collect()}
    assert got == {"1": ("whole", "T", True), "2": ("braces", "U", False), "3": ("failed", None, False)}


def test_clean_terms(spark):
    ks = ["Techno", "https://x.com", "mixmag", "2024 news", " Berghain ", "Berghain", "a1", "b2", "c3", "d4", "e5"]
    es = ["at Boiler Room", "festival", "beatportal", "Nina Kraviz - Mixmag", "edm", "best of the year", "Ab"]
    df = spark.createDataFrame([(ks, es)], "keywords array<string>, common_entities array<string>")
    r = st.clean_terms(df).first()
    assert r.keywords == ["Berghain", "a1", "b2", "c3", "d4"]
    assert r.common_entities == ["Boiler Room", "Nina Kraviz"]


def test_cohesion(spark):
    df = spark.createDataFrame([(2, ["Alpha"], ["alpha x", "beta"]), (2, ["techno"], ["techno", "techno"]), (1, ["Alpha"], ["alpha"])], "n int, e array<string>, t array<string>")
    assert [r[0] for r in df.select(st.cohesion_of(F.col("n"), F.col("e"), F.col("t"))).collect()] == [48, 43, 0]


def test_normalize_drops_and_keeps(spark):
    ra = spark.createDataFrame(
        [("1", "Alpha One closes venue", "techno text", "s", None, "2026-01-01", "n"), ("2", "Other", "body", "s", None, "2026-01-02", "n")],
        "id string, title string, content string, source_id string, published_at timestamp, event_date string, source_name string",
    ).withColumn("event_date", F.col("event_date").cast("date"))
    idx = spark.createDataFrame([("1", "Alpha One", "qualifying"), ("2", "Alpha One", "qualifying")], "id string, canonical string, role string")
    props = spark.createDataFrame(
        [("g1", "A topic", ["venue"], ["1"]), ("g2", "A topic", ["venue"], ["1", "9"]), ("g3", "A topic", ["venue"], ["1", "2"]), ("g4", "www.x.com", ["venue"], ["1"]), ("g5", "A topic", ["zebra"], ["1"])],
        "group_id string, topic string, keywords array<string>, article_ids array<string>",
    ).withColumns({"reason": F.lit(""), "common_entities": F.array().cast("array<string>"), "cohesion_score": F.lit(None).cast("double")})
    got = {r.group_id: r.drop_reason for r in st.normalize_proposals(props, st.article_features(ra, idx)).collect()}
    assert got == {"g1": None, "g2": "article_not_edm_eligible", "g3": "event_date_conflict", "g4": "normalization_failed", "g5": "normalization_failed"}


HOT = 31  # articles of one entity, more than twice the newest fifteen


def hot_entity(spark):
    """One entity in all articles, a second one in every fifth; the lowest ids are the oldest."""
    import datetime

    t0 = datetime.datetime(2026, 1, 1)
    ra = spark.createDataFrame(
        [(f"a{i:02d}", f"The Prodigy {'Nova One ' if i % 5 == 0 else ''}w{i % 3}x", "", t0 + datetime.timedelta(days=i / 2),
          datetime.date(2026, 1, i % 8 + 1) if i % 4 == 0 else None, None) for i in range(HOT)],
        "id string, title string, content string, published_at timestamp, event_date date, suggestion_state string")
    rows = [(f"a{i:02d}", c, "qualifying") for i in range(HOT) for c in ("The Prodigy", "Nova One")[: 1 + (i % 5 == 0)]]
    return ra, spark.createDataFrame(rows, "id string, canonical string, role string")


@pytest.mark.parametrize("block", [4, 500])
def test_every_pair_of_an_entity_is_an_edge_whatever_its_size(spark, block):
    ra, index = hot_entity(spark)
    got = sorted(tuple(r) for r in st.pair_edges(st.entity_members(index), index, ra, block).collect())
    want = []
    for i in range(HOT):
        for j in range(i + 1, HOT):
            if i % 4 == 0 and j % 4 == 0 and i % 8 != j % 8:
                continue
            gap = (j - i) / 2
            # every title has the entity's words
            score = (3 if i % 5 == 0 and j % 5 == 0 else 1) + (3 if gap <= 3 else 1 if gap <= 7 else 0) + 2
            want.append((f"a{i:02d}", f"a{j:02d}", score))
    assert got == want


def test_extended_groups_see_articles_beyond_the_newest_fifteen_of_an_entity(spark):
    from newsflow.plans.grouping import extended_groups
    from test_entities import surfaces

    ra, _ = hot_entity(spark)
    out = extended_groups(ra, surfaces(spark, [("The Prodigy", [], 1.0)])).collect()
    assert len(out) == 1 and out[0].entity == "The Prodigy"
    gap = lambda i, j: 3 if abs(i - j) <= 6 else 1 if abs(i - j) <= 14 else 0
    apart = lambda i, j: i % 4 == 0 and j % 4 == 0 and i % 8 != j % 8
    degree = {i: sum(3 + gap(i, j) for j in range(HOT) if j != i and not apart(i, j)) for i in range(HOT)}
    assert list(out[0].article_ids) == sorted(f"a{i:02d}" for i in sorted(degree, key=lambda i: (-degree[i], i))[:5])
    assert min(out[0].article_ids) < f"a{HOT - 15:02d}"


def test_the_sql_of_pair_edges_has_no_cap():
    from newsflow.catalog import all_oracles

    assert "entity_rank <=" not in all_oracles()["story_pair_edges"]
