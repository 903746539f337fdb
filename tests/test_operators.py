import itertools
import math
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from concordia.operators import anchors, confidence, drift, evidence, history, inference, matching, patterns, registry, relational, temporal, units, vectors
from concordia.operators.semantic_join import META, Keys, fuzzy_pairs, match_statistics, semantic_join
from concordia.plans import join_planner as planner


def frame(spark, name, values, kind="double"):
    cast = float if kind == "double" else (lambda v: v)
    return spark.createDataFrame([(cast(v),) for v in values], f"{name} {kind}")


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


# --- joins ------------------------------------------------------------------


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abc ", max_size=9), max_size=25), st.lists(st.text("abc ", max_size=9), max_size=25), st.sampled_from([0.5, 0.7, 0.8, 0.95]))
def test_fuzzy_pairs_are_those_of_brute_force(spark, left, right, t):
    left, right = set(left), set(right)
    got = {(r.lk, r.rk) for r in fuzzy_pairs(frame(spark, "lk", left, "string"), frame(spark, "rk", right, "string"), t).collect()}
    want = {(a, b) for a, b in itertools.product(left, right) if (a or b) and 1 - lev(a, b) / max(len(a), len(b)) >= t - 1e-12}
    assert got - {("", "")} == want


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 1200), min_size=5, max_size=40), st.lists(st.integers(0, 1200), max_size=40), st.sampled_from([0.75, 0.84, 0.9, 0.95]), st.integers(0, 9))
def test_fuzzy_pairs_of_keys_with_a_common_start(spark, a, b, t, cut):
    left, right = {f"customer#{i:06d}" for i in a}, {f"customer#{i:06d}"[: 15 - i % 3].replace("o", "" if i % 2 else "o")[cut % 2 :] for i in b}
    got = {(r.lk, r.rk) for r in fuzzy_pairs(frame(spark, "lk", left, "string"), frame(spark, "rk", right, "string"), t).collect()}
    assert got == {(x, y) for x, y in itertools.product(left, right) if 1 - lev(x, y) / max(len(x), len(y)) >= t - 1e-12}


def test_matches(spark):
    a, b = frame(spark, "a", ["kitten", "sitting", "flaw", None, ""], "string"), frame(spark, "b", ["mitten", "kitten", "lawn", "sittin", None], "string")
    found = [tuple(r) for r in matching.top_matches(a, b, "a", "b", 2, 0.5).orderBy("query", "rank").collect()]
    assert [(q, c, k) for q, c, _, k in found] == [("flaw", "lawn", 1), ("kitten", "kitten", 1), ("kitten", "mitten", 2), ("sitting", "sittin", 1), ("sitting", "kitten", 2)]
    assert {r.query: r.candidate for r in matching.best_match(a, b, "a", "b", 0.5).collect()} == {"flaw": "lawn", "kitten": "kitten", "sitting": "sittin"}
    pairs = spark.createDataFrame([("kitten", "sitting"), ("flaw", "lawn"), (None, "x")], "a string, b string")
    assert [r.d for r in pairs.select(matching.banded_distance(F.col("a"), F.col("b"), 2).alias("d")).collect()] == [None, 2, None]
    assert {r.a: (r.distance, r.mixed.is_match) for r in matching.compare(pairs, "a", "b").collect() if r.a} == {"kitten": (3, False), "flaw": (2, False)}


def test_all_detectors_at_once(spark):
    old = spark.range(400).selectExpr("id", "id % 7 * 1.0 as weight", "concat('ab-', id % 10) as code", "id % 5 as same")
    new = spark.range(400).selectExpr("id", "id % 7 * 60.0 as weight", "concat('AB', id % 10, 'x') as code", "id % 5 as same")
    anchors_ = spark.createDataFrame([("weight", 0.9), ("same", 0.9)], "column string, confidence double")
    found = {(r["column"], r.kind) for r in drift.column_drift(old, new, anchors=anchors_).collect()}
    assert {("weight", "unit"), ("weight", "distribution"), ("code", "format"), ("weight", "confidence")} <= found
    assert not any(c in ("same", "id") for c, _ in found)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 12), min_size=1, max_size=60), st.lists(st.integers(-2, 15), min_size=1, max_size=60))
def test_psi_is_that_of_plain_bins(spark, a, b):
    s = sorted(a)
    edges = sorted({s[math.floor(i * (len(s) - 1) / 10)] for i in range(11)})
    place = lambda v: min(max(sum(e < v for e in edges) - 1, 0), max(len(edges) - 2, 0))
    share = lambda x, k: max(sum(place(v) == k for v in x) / len(x), 1e-4)
    want = sum((share(b, k) - share(a, k)) * math.log(share(b, k) / share(a, k)) for k in {place(v) for v in a + b})
    assert drift.psi(frame(spark, "v", a), frame(spark, "v", b), "v").first().psi == pytest.approx(want)


def test_join_kinds_and_nulls(spark):
    a = spark.createDataFrame([(1, "John@X.com "), (2, None), (3, "nobody@x.com")], "id int, email string")
    b = spark.createDataFrame([(10, "john@x.com"), (20, None), (30, "far@away.org")], "uid int, mail string")
    ready = Keys(("email",), confidence.model(confidence.Context(unique_count=3, rows=3), confidence.Context(unique_count=3, rows=3)))
    counts = {how: semantic_join(a, b, "email", "mail", how=how, fuzzy=False, confidence_threshold=0.1, prepared=ready).count() for how in ("inner", "left", "right", "outer")}
    assert counts == {"inner": 1, "left": 3, "right": 3, "outer": 5}
    assert semantic_join(a, b, "email", "mail", fuzzy=False, null_equal=True, confidence_threshold=0.1, prepared=ready).count() == 2
    row = semantic_join(a, b, "email", "mail", fuzzy=False, confidence_threshold=0.1, prepared=ready).first()
    assert row[META].match_type == "normalized"
    assert match_statistics(semantic_join(a, b, "email", "mail", how="left", fuzzy=False, confidence_threshold=0.1, prepared=ready)).first().matched == 1


def test_join_prepares_itself(spark):
    a = spark.createDataFrame([(1, "Jonathan Smith"), (2, "Mary Jones")], "id int, name string")
    b = spark.createDataFrame([(7, "jonathan smyth"), (8, "MARY JONES")], "uid int, title string")
    got = {(r.left_id, r.right_uid): r[META].match_type for r in semantic_join(a, b, "name", "title", confidence_threshold=0.3).collect()}
    assert got == {(1, 7): "fuzzy", (2, 8): "normalized"}
    with pytest.raises(ValueError, match="key columns"):
        semantic_join(a, b, ["name"], ["title", "uid"])


def test_confidence_vectors(spark):
    c = confidence.Context("identifier", 0.6, kind="string", unique_count=100, unique_percent=90.0, avg_length=8.0, rows=100)
    m = confidence.model(c, c)
    assert confidence.exact_confidence(m) == 1.0
    assert m.base + 0.15 + 0.08 - 0.162 == pytest.approx(0.82)
    fuzzy = spark.range(1).select(confidence.fuzzy_confidence(m, F.lit(0.85), F.lit(0.85)).alias("c")).first().c
    assert fuzzy == pytest.approx(0.78925)


def test_planner():
    def c(n, u):
        return confidence.Context("identifier", unique_count=u, rows=n)

    assert planner.plan([(c(10, 10), c(20, 10))], ["default"]).strategy == "nested_loop"
    assert planner.plan([(c(5000, 10), c(200_000, 10))], ["default"]).strategy == "broadcast_join"
    assert planner.plan([(c(50_000, 10), c(50_000, 10))], ["default"], fuzzy=True).selectivity == 0.001
    assert planner.plan([(c(50_000, 10), c(50_000, 10))], ["default"]).strategy == "hash_join"
    assert planner.plan([(c(50_000, 50_000), c(50_000, 50_000))], ["default"]).strategy == "sort_merge"


def test_as_of_join_carries_over_buckets(spark):
    t = lambda d, h: datetime(2024, 1, d, h)
    left = spark.createDataFrame([("a", t(5, 3), 1), ("a", t(1, 0), 2), ("b", t(2, 0), 3)], "k string, ts timestamp, id int")
    right = spark.createDataFrame([("a", t(2, 1), 10), ("a", t(3, 1), 11), ("a", t(5, 4), 12)], "k string, ts timestamp, v int")
    got = {r.id: r.v for r in relational.as_of_join(left, right, "ts", "ts", ["k"], ["v"]).collect()}
    assert got == {1: 11, 2: None, 3: None}


# --- drift ------------------------------------------------------------------


def test_ks(spark):
    r = drift.ks_test(frame(spark, "v", [1.0, 2, 3, 4]), frame(spark, "v", [10.0, 11, 12, 13]), "v").first()
    assert (r.statistic, round(r.critical_value, 6), round(r.p_value, 6)) == (1.0, 0.961665, 0.036631)
    r = drift.ks_test(frame(spark, "v", [1.0, 2, 3, 4, 5]), frame(spark, "v", [3.0, 4, 5, 6, 7]), "v").first()
    assert (round(r.statistic, 6), round(r.critical_value, 6), round(r.p_value, 6)) == (0.4, 0.860140, 0.818621)
    r = drift.ks_test(frame(spark, "v", [1.0, 2]), frame(spark, "v", [1.0, 2]), "v").first()
    assert (r.statistic, r.p_value) == (0.0, 1.0)


def test_psi_and_wasserstein(spark):
    a, b = frame(spark, "v", map(float, range(100))), frame(spark, "v", map(float, range(10, 110)))
    r = drift.psi(a, b, "v").first()
    assert round(r.psi, 6) == 0.759399
    assert r.level == "severe"
    assert drift.psi(a, a, "v").first().psi == 0
    assert drift.wasserstein(frame(spark, "v", map(float, range(50))), frame(spark, "v", map(float, range(5, 55))), "v").first().distance == pytest.approx(5.0)


def test_chi_square(spark):
    o = spark.createDataFrame([("a", 22), ("b", 30), ("c", 48)], "k string, n int")
    e = spark.createDataFrame([("a", 25), ("b", 25), ("c", 50)], "k string, n int")
    r = drift.chi_square(o, e, "k", "n").first()
    assert r.df == 2
    assert r.statistic == pytest.approx(9 / 25 + 1 + 4 / 50)
    assert drift.chi_square_p(r.statistic, 2) == pytest.approx(math.exp(-r.statistic / 2))
    assert drift.chi_square_p(3.841459, 1) == pytest.approx(0.05, abs=1e-6)


def test_findings_and_alerts(spark):
    p = spark.createDataFrame([("x", 0.0, 10.0, 0.0, 1200.0, 0.9, 0.2), ("y", 0.0, 1.0, 0.0, 1.0, 0.5, 0.5)], "column string, old_min_num double, old_max_num double, new_min_num double, new_max_num double, old_unique_ratio double, new_unique_ratio double")
    found = drift.scale_drift(p).unionByName(drift.joinability_drift(p))
    assert {(r.column, r.kind, r.severity) for r in found.collect()} == {("x", "unit", "critical"), ("x", "joinability", "critical")}
    assert drift.drift_report(found).first().severity == "critical"
    made = drift.alerts(found)
    assert made.count() == 2
    assert drift.health(made).first().health == 0
    store = spark.createDataFrame([("x", 0.9)], "column string, confidence double")
    assert drift.confidence_drift(found, store).first().kind == "confidence"


def test_distribution_drift(spark):
    a = spark.createDataFrame([("c", float(i)) for i in range(100)], "column string, v double")
    b = spark.createDataFrame([("c", float(i)) for i in range(500, 700)], "column string, v double")
    assert drift.distribution_drift(a, b, "v", ["column"]).first().severity == "critical"
    assert drift.distribution_drift(a, a, "v", ["column"]).count() == 0


def test_pattern_drift(spark):
    old = frame(spark, "v", [f"user{i}@example.com" for i in range(5)], "string")
    new = frame(spark, "v", [f"2024-01-0{i}" for i in range(1, 6)], "string")
    changes = patterns.pattern_changes(patterns.pattern_frequencies(old, "v"), patterns.pattern_frequencies(new, "v"))
    assert {r.pattern: r.change for r in changes.collect() if r.pattern in ("email", "date_iso")} == {"email": "lost", "date_iso": "new"}
    finding = patterns.format_findings("v", patterns.similarity(changes)).first()
    assert finding.kind == "format"


# --- anchors ----------------------------------------------------------------


def base(spark, n=500):
    rows = [(1000 + i, f"user{i % 400}@example.com", 10.5 * (i % 450), f"2023-01-{i % 28 + 1:02d}", f"+1555000{i % 380:04d}", f"Name_{i % 300}") for i in range(n)]
    return spark.createDataFrame(rows, "customer_id bigint, email string, amount double, order_date string, phone string, name string")


def test_anchors_survive_renames(spark):
    old = base(spark)
    new = old.toDF("cust_pk", "mail", "price", "timestamp", "tel", "title").withColumn("product_code", F.concat(F.lit("P"), F.col("cust_pk"))).withColumn("misc_field", F.when(F.col("cust_pk") % 3 > 0, "x"))
    store = anchors.create(anchors.fingerprints(old), "customers", "2024-01-01")
    r = anchors.reconcile(anchors.fingerprints(new), store, threshold=0.7, tolerance=0.2)
    names = {a.anchor_id: a.column_name for a in store.collect()}
    got = {c: names[a] for c, a, _, _ in r.matched}
    want = {"mail": "email", "price": "amount", "tel": "phone", "title": "name", "timestamp": "order_date", "cust_pk": "customer_id"}
    assert {k: v for k, v in got.items() if want.get(k) != v} == {}
    assert len(got) >= 5
    assert "product_code" in r.new
    assert "misc_field" in r.new
    assert not r.unmatched


def test_fingerprint_nulls_and_codec(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), ("c",), ("",)], "v string")
    fp = anchors.fingerprints(df)
    r = fp.first()
    assert (r.cardinality, r.null_ratio, r.unique_ratio, r.sample_values) == (3, 0.4, 0.6, ["a", "b", "c"])
    back = fp.select(anchors.decode(anchors.encode(F.struct(*fp.columns))).alias("d")).first().d
    assert (back.min, back.max, back.cardinality, back.null_ratio) == ("a", "c", 3, 0.4)


def test_anchor_store(spark):
    a = anchors.create(anchors.fingerprints(spark.createDataFrame([(1, "x")], "id int, name string")), "d", "2024-01-01")
    b = anchors.create(anchors.fingerprints(spark.createDataFrame([(1, "x")], "id int, name string")), "d", "2024-02-01")
    merged = anchors.upsert(a, b)
    assert merged.count() == 2
    assert {str(r.last_seen) for r in merged.collect()} == {"2024-02-01"}
    assert anchors.delete(merged, merged.where("column_name = 'id'")).count() == 1
    assert anchors.search(merged, pattern="na").count() == 1


def test_side_metadata(spark):
    df = spark.createDataFrame([(1,)], "id int")
    marked = anchors.attach(df, {"id": {"semantic_type": "identifier"}})
    assert anchors.attached(marked) == {"id": {"semantic_type": "identifier"}}
    assert anchors.attached(anchors.detach(marked)) == {}
    assert marked.collect() == df.collect()


# --- inference and concepts -------------------------------------------------


def test_infer_types(spark):
    rows = [(i, f"user{i}@example.com", f"${i}.50", f"2024-01-{i % 28 + 1:02d}", ["a", "b"][i % 2]) for i in range(200)]
    got = {i.column: i.semantic_type for i in inference.infer_types(spark.createDataFrame(rows, "user_id int, email string, price string, day string, kind string"))}
    assert got["email"] == "email"
    assert got["price"] == "currency"
    assert got["day"] in ("date", "timestamp")
    assert got["user_id"] == "identifier"


def test_detectors(spark):
    ok = {"ipv4": "10.0.0.1", "uuid": "550e8400-e29b-41d4-a716-446655440000", "credit_card": "4539 1488 0343 6467", "url": "https://a.b/c?d=1", "ssn": "123-45-6789", "percentage": "12.5%"}
    for name, value in ok.items():
        assert spark.range(1).select(inference.detects(name, F.lit(value)).alias("r")).first().r, name
    assert not spark.range(1).select(inference.detects("credit_card", F.lit("4539148803436468")).alias("r")).first().r


def test_packs(spark):
    packs = {p.name: p for p in (registry.IDENTITY, registry.TIME, registry.UNITS)}
    order = registry.load_order(packs)
    assert order.index("common.units") < order.index("common.identity")
    assert all(not registry.validate(p) for p in packs.values())
    with pytest.raises(ValueError, match="needed by"):
        registry.unload(packs, "common.units")
    with pytest.raises(ValueError, match="missing"):
        registry.load_order({"common.identity": registry.IDENTITY})
    a, b = registry.Pack("a", "1.0.0", (), ("b",)), registry.Pack("b", "1.0.0", (), ("a",))
    with pytest.raises(ValueError, match="each other"):
        registry.load_order({"a": a, "b": b})
    assert registry.satisfies("1.2.0", "^1.0.0")
    assert not registry.satisfies("2.0.0", "^1.0.0")


def test_lookup(spark):
    table = registry.concepts(spark, registry.IDENTITY, registry.UNITS)
    names = frame(spark, "name", ["customer_id", "custmer_id", "zzz"], "string")
    got = {(r.name, r.cid): r.match_type for r in registry.lookup(names, table).collect()}
    assert got["customer_id", "identity.person"] == "exact"
    assert got["custmer_id", "identity.person"] == "fuzzy"
    assert not any(n == "zzz" for n, _ in got)
    found = {r.cid: r.match_type for r in registry.by_criteria(table, {"identifier": True}, "company").collect()}
    assert found["identity.organization"] == "inference"


# --- time, units, evidence --------------------------------------------------


def test_grains(spark):
    t = F.lit(datetime(2023, 1, 5, 10, 31)).cast("timestamp")
    r = spark.range(1).select(*(temporal.adjust(t, g).alias(g) for g in ("week", "month", "quarter", "year"))).first()
    assert [str(r[g].date()) for g in ("week", "month", "quarter", "year")] == ["2023-01-05", "2022-12-24", "2022-12-24", "2022-12-19"]


def test_midpoint_fill(spark):
    t = lambda h: datetime(2024, 1, 1, h)
    df = spark.createDataFrame([(t(0), 10.0), (t(3), 18.0)], "ts timestamp, v double")
    assert [r.value for r in temporal.align(df, "ts", "v", "hour", "interpolate").orderBy("timestamp").collect()] == [10, 14, 16, 18]
    assert [r.value for r in temporal.align(df, "ts", "v", "hour", "forward").orderBy("timestamp").collect()] == [10, 10, 10, 18]
    assert [r.value for r in temporal.align(df, "ts", "v", "hour", "drop").orderBy("timestamp").collect()] == [10, 18]
    assert temporal.gap_count(df, "ts", "hour").first().gaps == 2
    bounds = spark.createDataFrame([(t(0), t(3))], "a timestamp, b timestamp")
    assert temporal.grid(bounds, "a", "b", "hour").count() == 4


def test_grain_statistics(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1) + timedelta(hours=i),) for i in range(48)], "ts timestamp")
    r = temporal.grain_statistics(df, "ts").first()
    assert (r.grain, r.mode_ms, r.intervals, r.confidence, r.regularity) == ("hour", 3_600_000, 47, 1.0, 1.0)
    assert temporal.advise_grain(r.asDict(), 47 * 3_600_000)[0] == "hour"
    assert temporal.advise_grain(r.asDict(), 47 * 3_600_000, 2)[0] == "day"
    assert temporal.keeps_order(df.withColumn("x", F.col("ts") + F.expr("interval 1 hour")), "ts", "x").first().ordered


def test_zones(spark):
    t = F.lit(datetime(2024, 7, 1, 12)).cast("timestamp")
    r = spark.range(1).select(temporal.convert_zone(t, "UTC", "America/New_York").alias("a"), temporal.is_dst(t, "America/New_York").alias("d"), temporal.is_dst(t, "Asia/Tokyo").alias("e")).first()
    assert (r.a.hour, r.d, r.e) == (8, True, False)
    assert temporal.closest_zone(545) == "Asia/Tokyo"
    assert temporal.valid_zone("UTC")
    assert not temporal.valid_zone("Mars/Base")


def test_units(spark):
    rows = [(100.0, "cm", "m"), (1.0, "kg", "g"), (32.0, "F", "C"), (0.0, "C", "F"), (1.0, "kg", "m"), (1.0, "huh", "m")]
    df = spark.createDataFrame(rows, "v double, a string, b string")
    got = [(r.converted, r.error) for r in units.convert_rows(df.coalesce(1), "v", "a", "b").collect()]
    assert got == [(1.0, None), (1000.0, None), (0.0, None), (32.0, None), (None, "different categories"), (None, "unknown unit")]
    with pytest.raises(ValueError, match="distance"):
        units.convert(F.lit(1.0), "m", "kg")
    assert units.fallback_rate("EUR", "USD") == pytest.approx(1 / 0.85)


def events(spark, kinds, when=None):
    when = when or datetime(2024, 1, 1)
    rows = [(str(i), when, t, s, "a") for i, (t, s) in enumerate(kinds)]
    return spark.createDataFrame(rows, "id string, timestamp timestamp, type string, source string, anchor_id string")


def test_evidence_confidence(spark):
    e = events(spark, [("human_approval", "human_feedback"), ("statistical_match", "automated_analysis")])
    assert evidence.confidence(e, datetime(2024, 1, 1)).first().confidence == pytest.approx(0.779956, abs=1e-6)


@pytest.mark.parametrize(("good", "bad", "want"), [(3, 1, 0.8), (1, 2, 0.2), (1, 1, 0.5)])
def test_consistency(spark, good, bad, want):
    e = events(spark, [("statistical_match", "automated_analysis")] * good + [("human_rejection", "human_feedback")] * bad)
    assert evidence.confidence(e, datetime(2024, 1, 1)).first().consistency == want


def test_states(spark):
    e = events(spark, [("human_approval", "human_feedback"), ("human_rejection", "human_feedback"), ("human_approval", "human_feedback")])
    moves = evidence.transitions(evidence.scored_steps(e, datetime(2024, 1, 1)))
    got = [(r.from_state, r.to_state) for r in moves.orderBy("id").collect()]
    assert got[:2] == [("proposed", "accepted"), ("accepted", "deprecated")]
    created = spark.createDataFrame([("a", datetime(2024, 1, 1)), ("b", datetime(2024, 1, 1))], "anchor_id string, created timestamp")
    states = {r.anchor_id: r.state for r in evidence.current_states(moves, created).collect()}
    assert states["b"] == "proposed"
    assert evidence.due_for_review(evidence.current_states(moves, created), datetime(2025, 1, 1)).count() >= 1


def test_history(spark):
    rows = [("c", datetime(2024, 1, d), 100 * (5 if d == 20 else 1), 0.0, 0.5) for d in range(1, 31)]
    h = spark.createDataFrame(rows, "column string, ts timestamp, cardinality bigint, null_ratio double, unique_ratio double")
    path = history.trajectory(h)
    assert {r.ts.day: r.moved for r in path.where("moved is not null").collect()} == {20: "spike"}
    assert [r.ts.day for r in history.anomalies(h).collect()] == [20]
    assert history.trend(h).first().trend in ("stable", "increasing")
    assert history.index_percentile(frame(spark, "v", map(float, range(10))), "v", [50, 99]).first().asDict() == {"p50": 5.0, "p99": 9.0}
    assert history.volatility(path).first().level in ("low", "medium", "high")


def test_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8)).astype("float32")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = {(r.query_id, r["rank"]): r.neighbour_id for r in vectors.knn(df.where("vec_id < 3"), df, 4).collect()}
    for q in range(3):
        d = np.sqrt(((x.astype("float64") - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        assert [got[q, k] for k in (1, 2, 3, 4)] == np.argsort(d)[:4].tolist()
    books = vectors.pq_train(df, subspaces=4, centroids=16)
    codes = vectors.pq_encode(df, books)
    assert codes.count() == 60
    near = [r.vec_id for r in vectors.pq_search(codes, books, x[5].tolist(), 10).collect()]
    assert 5 in near
    assert vectors.pq_ratio(128, 8) == 64
    hits = sum(got[r.query_id, 1] == r.neighbour_id for r in vectors.lsh_knn(df.where("vec_id < 3"), df, 4, tables=24, bits=4).where("rank = 1").collect())
    assert hits >= 2


def test_quick_findings_and_rates(spark):
    p = spark.createDataFrame([("a", "int64", "string", 5, 5, 0.0, 0.0), ("b", "int64", "int64", 5, 500, 0.0, 0.0), ("c", "x", "x", 5, 5, 0.0, 0.9), ("d", "x", "x", 5, 6, 0.0, 0.1)], "column string, old_dtype string, new_dtype string, old_cardinality bigint, new_cardinality bigint, old_null_ratio double, new_null_ratio double")
    assert {r.column: r.reason for r in drift.quick_findings(p).collect()} == {"a": "dtype", "b": "cardinality", "c": "nulls"}
    rates = drift.detection_rates(spark.createDataFrame([(True, True), (True, False), (False, False)], "drifted boolean, found boolean")).first()
    assert (rates.true_positive_rate, rates.false_positive_rate) == (0.5, 0.0)


def test_scores_and_coverage(spark):
    from concordia.operators import profile

    issues = spark.createDataFrame([("a", "error"), ("a", "warning"), ("b", "warning")], "file string, level string")
    assert {r.file: r.score for r in profile.validation_scores(issues).collect()} == {"a": 75, "b": 95}
    files = spark.createDataFrame([("x",), ("y",)], "path string")
    assert profile.coverage(files, files.limit(1)).first().status == "warn"
    quality = profile.frame_quality(spark.createDataFrame([("a@b.c", None), ("bad", None), ("bad", None)], "email string, gap string")).first()
    assert quality.score == pytest.approx(1 - 0.3 - 0.1 - 0.2)
    assert profile.schema_overlap(files, issues)["score"] == 0


def test_fx_modes(spark):
    rates = spark.createDataFrame([("USD", "EUR", 0.9, datetime(2024, 1, 1))], "from_ccy string, to_ccy string, rate double, ts timestamp")
    df = spark.createDataFrame([(1, datetime(2024, 1, 1, 6), 10.0, "EUR", "USD"), (2, datetime(2024, 3, 1), 10.0, "USD", "EUR"), (3, datetime(2024, 1, 2), 10.0, "USD", "GBP"), (4, datetime(2024, 1, 2), 10.0, "USD", "USD")], "id int, ts timestamp, x double, a string, b string")
    got = {r.id: (r.rate_source, round(r.converted, 4)) for r in units.fx_convert(df, "ts", "x", "a", "b", rates, "fresh").collect()}
    assert got == {1: ("table", 11.1111), 2: ("fallback", 8.5), 3: ("fallback", 7.5), 4: ("table", 10.0)}
    strict = {r.id: r.rate_source for r in units.fx_convert(df, "ts", "x", "a", "b", rates, "strict").collect()}
    assert strict[3] is None
    with pytest.raises(ValueError, match="mode"):
        units.fx_convert(df, "ts", "x", "a", "b", rates, "no")
