from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.text import key_json
from corpusloom.operators import dialogue as D
from corpusloom.operators import duplicates as U
from corpusloom.operators import governance as G
from corpusloom.operators import relational as J
from corpusloom.operators import rules as R
from corpusloom.operators import sampling as A
from corpusloom.operators import stats as S
from corpusloom.operators import textstats as T


@pytest.fixture(scope="module")
def frame(spark):
    product, issue = "A A A A A A B B B A|B".split(), "x x x x x x y y y x".split()
    rows = [(str(k + 1), product[k], issue[k], "2026-02" if k == 9 else "2026-01") for k in range(10)]
    return spark.createDataFrame(rows, "id string, product string, issue string, month string")


def ids(df, c="id"):
    return sorted(r[0] for r in df.select(c).collect())


def test_allocation_and_draw_repeat(frame):
    shares = A.allocate(frame, 5, ["product", "issue"])
    assert shares.agg(F.sum("allocated")).first()[0] == 5 and shares.count() == 3
    draws = [ids(A.stratified_sample(frame, 5, ["product", "issue"], "id", 7, "core")) for _ in range(2)]
    assert draws[0] == draws[1] and len(draws[0]) == 5


def test_allocation_edges(spark, frame):
    assert A.allocate(frame, 99, ["product"]).agg(F.sum("allocated")).first()[0] == 10
    assert A.allocate(frame.limit(0), 5, ["product"]).count() == 0
    with pytest.raises(ValueError):
        A.allocate(frame, -1, ["product"])
    null = spark.createDataFrame([(1, None), (2, "a")], "id int, s string")
    assert {r.s for r in A.allocate(null, 2, ["s"]).collect()} == {"<NA>", "a"}
    assert A.stratified_sample(null, 2, ["s"], "id", 1, "n").count() == 2


def test_strata_with_bars_do_not_merge(spark):
    rows = spark.createDataFrame([("1", "x|y", "z"), ("2", "x", "y|z")], "id string, a string, b string")
    assert A.allocate(rows, 2, ["a", "b"]).count() == 2


def test_coverage(frame):
    core = frame.filter("id in ('1', '7')")
    got = A.coverage_supplement(frame, core, ["product", "issue"], "id", 7, "coverage").collect()
    assert [(r.id, r.prevalence_eligible) for r in got] == [("10", False)]
    with pytest.raises(ValueError):
        A.coverage_supplement(frame, core.limit(0), ["product"], "id", 7, "c", most=1).count()


def test_group_cap(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b")], "id int, hash string")
    draws = [ids(A.cap_groups(rows, "hash", 1, [key_json(7, "cap", F.col("id")), "id"])) for _ in range(2)]
    assert draws[0] == draws[1] and len(draws[0]) == 2 and A.cap_accounting(rows, "hash", 1).first().removed == 2


def test_quota_sets_do_not_reuse(frame):
    quotas = [A.Quota("x", F.col("issue") == "x", 3), A.Quota("all", F.lit(True), 20)]
    rows, accounts = A.quota_sets(frame, quotas, ["product"], "id", ["id"], 7, "s")
    got = rows.collect()
    assert len({r.id for r in got}) == len(got) == 10
    assert {(r.reason, r.available, r.selected) for r in accounts.collect()} == {("x", 7, 3), ("all", 7, 7)}


def test_share_allocation():
    got = A.share_allocation({"a": 0.9, "b": 0.09, "c": 0.001}, 10)
    assert sum(got.values()) == 10 and min(got.values()) >= 1


def test_double_annotation(frame):
    got = A.double_annotation(frame, 4, ["product"], "id", 7).collect()
    assert len(got) == 8 and {r.annotator for r in got} == {"A", "B"} and len({r.id for r in got}) == 4


@pytest.mark.parametrize("links", [[(k, k + 1) for k in range(25)], [(0, k) for k in range(1, 30)], [(1, 2), (2, 3), (3, 1), (7, 9), (9, 7), (5, 5)], []])
def test_components(spark, links):
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = {r.node: r.component for r in U.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in linked}


def test_shingle_pairs_are_exact(spark):
    import random

    random.seed(3)
    base = [[random.choice("abcdefgh") + str(random.randint(0, 9)) for _ in range(60)] for _ in range(12)]
    texts = []
    for k, w in enumerate(base):
        texts.append((3 * k, w))
        texts.append((3 * k + 1, [*w[:30], "zz", *w[31:]]))
        texts.append((3 * k + 2, w if k % 2 else w[:50]))
    df = spark.createDataFrame(texts, "id bigint, w array<string>")
    sets = {}
    for i, w in texts:
        s = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        sets.setdefault(s, i)
    want = {}
    for s, i in sets.items():
        for t, j in sets.items():
            if i < j and len(s & t) / len(s | t) >= 0.8:
                want[i, j] = len(s & t) / len(s | t)
    got = {(r.a, r.b): r.jaccard for r in U.shingle_pairs(df, "id", F.col("w"), threshold=0.8).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got) and want


def test_reviewed_bridge_splits(spark):
    pairs = spark.createDataFrame([("1", "2", "yes"), ("2", "3", "yes")], "a string, b string, same string")
    clusters = spark.createDataFrame([], "component string, valid string")
    edges = U.reviewed_edges(pairs, clusters, spark.createDataFrame([("2", "3", "no")], "a string, b string, same string"))
    rows = spark.createDataFrame([("1",), ("2",), ("3",)], "id string")
    assert edges.count() == 1 and U.fuzzy_cap(rows, "id", edges, 1, ["id"]).count() == 2
    refused = U.reviewed_edges(pairs, spark.createDataFrame([("1", "no")], "component string, valid string"), pairs.limit(0))
    assert refused.count() == 0
    with pytest.raises(ValueError):
        U.fuzzy_cap(rows, "id", pairs, 1, ["id"], largest=2).count()


def test_rules_stay_open_after_retain(spark):
    rows = spark.createDataFrame([(1, True, True), (2, False, True), (3, True, False), (4, None, None)], "id int, a boolean, b boolean")
    got = R.apply_rules(rows, [R.Rule("a", F.col("a"), "retain"), R.Rule("b", F.col("b"), "exclude")])
    assert {r.id: (r.seed_action, r.seed_action_reason) for r in got.collect()} == {1: ("exclude", "b"), 2: ("exclude", "b"), 3: ("retain", "a"), 4: ("retain", "")}
    with pytest.raises(ValueError):
        R.apply_rules(rows, [R.Rule("a", F.col("a"), "drop")])


def test_overrides_fail_closed(spark):
    rows = spark.createDataFrame([(1, "h", "retain", ""), (2, "g", "retain", "")], "id int, h string, seed_action string, seed_action_reason string")
    make = lambda *x: spark.createDataFrame(list(x), "id int, h string, action string, reason_code string")
    good = R.override_rows(rows, make((1, "h", "exclude", "z"), (1, "h", "exclude", "a")), "id", "h")
    assert {(r.id, r.seed_action, r.seed_action_reason) for r in good.collect()} == {(1, "exclude", "a|z"), (2, "retain", "")}
    with pytest.raises(ValueError):
        R.override_rows(rows, make((1, "h", "exclude", "a"), (1, "h", "retain", "a")), "id", "h")
    with pytest.raises(ValueError):
        R.override_rows(rows, make((1, "other", "exclude", "a")), "id", "h")
    marked = R.mark_override(rows, {"seed_action": F.lit("x")})
    with pytest.raises(ValueError):
        R.mark_override(marked, {"seed_action": F.lit("y")})
    with pytest.raises(ValueError):
        R.require_columns(rows, ["missing"])


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, a string")
    b = spark.createDataFrame([(1, "p"), (1, "q")], "id int, b string")
    with pytest.raises(ValueError):
        J.join_one_to_one(a, b, ["id"])
    null = spark.createDataFrame([(1, None), (2, "s")], "id int, k string")
    assert ids(J.anti_null_safe(null, spark.createDataFrame([(None,)], "k string"), ["k"])) == [2]
    assert J.same_rows(a, a.orderBy(F.desc("id"))) and not J.same_rows(a, a.union(a))
    assert {tuple(r) for r in J.key_differences(a, b, ["id"]).collect()} == {(2, "left_only")}


def test_row_numbers(spark):
    rows = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("v"))
    got = J.number_rows(rows.repartition(7), ["v"]).collect()
    assert all(r.row_number == r.v + 1 for r in got) and len(got) == 1000


@pytest.mark.parametrize("parts", [8, 64])
def test_row_numbers_and_sums_with_further_columns(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        orders = spark.read.parquet("/root/testdata/sf0.1/orders.parquet")
        order = ["o_totalprice", "o_orderkey"]
        got = J.running_sum(J.number_rows(orders, order).withColumn("one", F.lit(1)), order, "one")
        assert set(got.columns) == {*orders.columns, "row_number", "one", "running"}
        total = orders.count()
        row = got.agg(F.count("*"), F.countDistinct("row_number"), F.min("row_number"), F.max("row_number"), F.max(F.abs(F.col("running") - F.col("row_number")))).first()
        assert tuple(row) == (total, total, 1, total, 0)
        dates = J.sequential_ids(orders, "X", [F.desc("o_orderdate"), "o_orderkey"], 9).agg(F.countDistinct("record_id"), F.max("record_id")).first()
        assert tuple(dates) == (total, f"X-{total:09d}")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_round_robin_of_all_rows(spark):
    rows = spark.range(200).select("id", (F.col("id") % 7).alias("s"))
    whole = {r.id: r.position for r in J.round_robin(rows, ["s"], F.col("id")).collect()}
    part = {r.id: r.position for r in J.round_robin(rows, ["s"], F.col("id"), 50).collect()}
    assert sorted(whole.values()) == list(range(1, 201)) and part == {k: p for k, p in whole.items() if p <= 50}


def test_decision_metrics(spark):
    rows = spark.createDataFrame([("rejected", "rejected"), ("kept", "kept")], "g string, f string")
    row = S.decision_metrics(rows, F.col("g"), F.col("f")).first()
    assert (row.n, row.accuracy, row.reject_precision, row.reject_recall, row.reject_f1) == (2, 1.0, 1.0, 1.0, 1.0)
    none = S.decision_metrics(rows.filter("g = 'kept'"), F.col("g"), F.col("f")).first()
    assert (none.accuracy, none.reject_f1) == (1.0, None) and S.decision_metrics(rows.limit(0), F.col("g"), F.col("f")).first().accuracy is None


def test_tables_in_a_folder_that_is_shared(spark):
    from corpusloom.operators import storage

    first = storage.saved_so_far()
    assert storage.saved(spark.range(5)).count() == 5 and storage.saved_so_far() == first + 1
    path = storage._WRITTEN[first].removeprefix("file:")
    assert Path(path).exists()
    storage.drop_saved(spark, first)
    assert not Path(path).exists()


def test_components_name_the_smallest(spark):
    links = [(5, 3), (3, 9), (2, 7), (8, 8)]
    found = U.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {(r.node, r.component) for r in found} == {(3, 3), (5, 3), (9, 3), (2, 2), (7, 2)}


def test_copies_are_linked_to_their_representative(spark):
    base = [f"w{k}" for k in range(40)]
    rows = [(1, base), (2, base), (3, base), (4, [*base[:-1], "x"]), (5, [f"v{k}" for k in range(40)])]
    docs = spark.createDataFrame(rows, "id bigint, w array<string>")
    links = U.similar_links(docs, "id", F.col("w"))
    assert {(r.node, r.component) for r in U.components(links).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1)}
    assert {r.id for r in U.fuzzy_cap(docs.select("id"), "id", links, 1, ["id"]).collect()} == {1, 5}


def test_wilson_and_kappa(spark):
    row = spark.range(1).select(*[c.alias(n) for n, c in zip("ab", S.wilson(F.lit(5), F.lit(10)), strict=True)], S.wilson(F.lit(0), F.lit(0))[0].alias("z")).first()
    assert row.a == pytest.approx(0.23659, abs=1e-4) and row.b == pytest.approx(0.76341, abs=1e-4) and row.z is None
    same = spark.createDataFrame([("yes", "yes")] * 3, "a string, b string")
    assert S.kappa(same, "a", "b", ["yes", "no"]).first().kappa is None
    mixed = spark.createDataFrame([("yes", "yes"), ("no", "no"), ("yes", "no"), ("no", "yes"), ("other", "yes")], "a string, b string")
    assert S.kappa(mixed, "a", "b", ["yes", "no"]).first().kappa == pytest.approx(0) and S.kappa(mixed.limit(0), "a", "b", ["yes"]).first().n == 0


def test_weighted_quantiles(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 2.0), (None, 1.0)], "x double, w double")
    got = {r.q: r.value for r in S.weighted_quantiles(rows, "x", "w", [0.0, 0.5, 1.0]).collect()}
    assert got[0.0] == 1.0 and got[1.0] == 3.0 and got[0.5] == pytest.approx(2 + (0.5 - 0.375) / 0.375)


def test_conflicts_and_sets(spark):
    rows = spark.createDataFrame([(1, "a", None), (1, "a", "x"), (2, "b", "y"), (2, "b", "y")], "k int, p string, q string")
    assert [tuple(r) for r in S.conflicts(rows, "k", ["p", "q"]).collect()] == [(1, 2, "q")]
    metrics = S.label_set_metrics(spark.createDataFrame([(["a"], ["a"]), ([], []), (["b"], ["b"])], "g array<string>, f array<string>"), "g", "f").first()
    assert metrics.f1 == metrics.exact_set_accuracy == 1.0


def test_phrases_stay_in_sentences(spark):
    rows = spark.createDataFrame([("c1", ["we were charged twice", "today again"]), ("c2", ["we were charged"]), ("c3", ["twice today again"])], "case string, s array<string>")
    got = {r.phrase: r.cases for r in T.repeated_phrases(rows, "case", F.col("s"), (3,)).collect()}
    assert got == {"we were charged": 2}


def test_question_pairs(spark):
    rows = spark.createDataFrame([("s", 0, "user", "Hi"), ("s", 1, "assistant", "When?"), ("s", 2, "user", "Today"), ("s", 3, "assistant", "Why?")], "c string, t int, role string, text string")
    assert [(r.t, r.user_follows) for r in D.question_pairs(rows, "c", "t", "role", "text").orderBy("t").collect()] == [(1, True), (3, False)]


def test_evidence(spark):
    rows = spark.createDataFrame([(1, "One. Two!")], "id int, t string")
    assert [tuple(r)[1:] for r in D.evidence_units(rows, "id", "t").collect()] == [("G001", "One."), ("G002", "Two!")]


@pytest.mark.parametrize(("text", "said"), [("We will refund you", True), ("I'll resolve this today", True), ("They asked for a refund", False), ("I promise", True)])
def test_promises(spark, text, said):
    assert spark.range(1).select(F.lit(text).rlike(D.PROMISE)).first()[0] is said


def test_privacy_finalisation(spark):
    make = lambda *x: spark.createDataFrame(list(x), "manual_pii_present string, release_action string, reviewer string, selection_stratum string")
    assert not G.finalize_privacy(make(("pending", "pending", "", "x")), 0).first().cleared
    assert G.finalize_privacy(make(("no", "allow", "r", "x")), 0).first().cleared
    assert not G.finalize_privacy(make(("no", "allow", "r", "x")), 200).first().cleared
    assert not G.finalize_privacy(make(("yes", "allow", "r", "x")), 0).first().cleared


def test_gates(spark):
    rows = spark.createDataFrame([(1, "h")], "id int, h string")
    make = lambda *x: spark.createDataFrame(list(x), "id int, h string, clearance_status string, release_action string")
    assert G.clear_rows(rows, make(), "id", "h").first().release_action == "allow"
    for wrong in ((9, "h", "cleared", "allow"), (1, "g", "cleared", "allow")):
        with pytest.raises(G.GateError):
            G.clear_rows(rows, make(wrong), "id", "h")
    with pytest.raises(G.GateError):
        G.validate_rules({"a": {"x": 1}}, {"a": ["x", "y"], "b": []})
    with pytest.raises(G.GateError):
        G.validate_rules({"a": {"x": 1}}, {"a": ["x"]}, {"a.x": [2]})
    G.validate_rules({"a": {"x": 2}}, {"a": ["x"]}, {"a.x": [2]})
    cover = G.coverage(spark.range(3).withColumnRenamed("id", "k"), spark.createDataFrame([(0,), (0,), (7,)], "k bigint"), "k").first()
    assert (cover.missing, cover.unknown, cover.duplicated) == (2, 1, 1)
    relabels = spark.createDataFrame([(1, "good", "x"), (1, "good", "y")], "id int, verdict string, new_label string")
    with pytest.raises(G.GateError):
        G.overlay_reviews(rows.withColumn("label", F.lit("z")), relabels, "id")


def test_sources_and_sinks(spark, tmp_path):
    from corpusloom.sources import readers as I
    from corpusloom.sources import writers as O

    (tmp_path / "in.csv").write_text('﻿id,text\n1,"two\nlines, ""quoted"""\n2,\n', encoding="utf-8")
    rows = I.text_csv(spark, str(tmp_path / "in.csv"), ["id", "text"])
    assert [tuple(r) for r in rows.orderBy("id").collect()] == [("1", 'two\nlines, "quoted"'), ("2", "")]
    out = str(tmp_path / "once")
    assert O.write_once(rows, out) and not O.write_once(rows, out)
    with pytest.raises(FileExistsError):
        O.write_once(rows.limit(1), out)
    told = O.manifest(rows, out)
    assert told["rows"] == 2 and all(len(f["sha256"]) == 64 for f in told["files"]) and "rows" in O.manifest_json({"a": told})
    assert O.redelimit(rows, str(tmp_path / "again")).count() == 2
    O.write_json_lines(rows, str(tmp_path / "j"), sort_keys=True)
    assert I.json_lines(spark, str(tmp_path / "j"), "id string, text string").count() == 2
    O.write_routed(rows.withColumn("route", F.when(F.col("id") == "1", "review").otherwise("validated")), "route", str(tmp_path / "r"))
    assert {p.name for p in (tmp_path / "r").iterdir() if p.is_dir()} == {"route=review", "route=validated"}
    (tmp_path / "reg.json").write_text('{"entries": [{"name": "a",\n "status": "ok", "roles": ["x", "y"]}]}')
    assert I.registry(spark, str(tmp_path / "reg.json")).count() == 2
    assert I.file_table(spark, str(tmp_path / "reg.json")).first()["size"] == (tmp_path / "reg.json").stat().st_size
    parts = O.reading_copy(spark.createDataFrame([(1, "x" * 50_000)], "id int, text string"), "id", "text").collect()
    assert [len(p.text) for p in sorted(parts, key=lambda p: p.part)] == [30_000, 20_000]


def test_streams(spark, tmp_path):
    from corpusloom.streaming import events as E

    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(200)
    rows.write.parquet(str(tmp_path / "in"))
    stream = E.windowed_counts(E.read_events(spark, str(tmp_path / "in"), rows.schema))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.sql("select window_start, event_type, n from windows").collect()}
    assert got == {tuple(r) for r in E.windowed_counts(rows).select("window_start", "event_type", "n").collect()}
    first = E.first_of_each(E.read_events(spark, str(tmp_path / "in"), rows.schema)).writeStream.outputMode("append").format("memory").queryName("firsts").start()
    first.processAllAvailable()
    first.stop()
    assert spark.sql("select count(*) from firsts").first()[0] == rows.select("event_id").distinct().count()


def test_bound_inputs_and_decisions(spark, tmp_path):
    import hashlib

    from corpusloom.sources.readers import file_table

    (tmp_path / "a.txt").write_bytes(b"x")
    files = file_table(spark, str(tmp_path / "a.txt"))
    G.bound_inputs(files, {"a.txt": hashlib.sha256(b"x").hexdigest()})
    for wrong in ({"a.txt": "0"}, {"b.txt": "0"}):
        with pytest.raises(G.GateError):
            G.bound_inputs(files, wrong)
    signed = {"privacy": {"decision": "approve", "reviewer": "r", "reviewed_utc": "2026-01-01T00:00:00Z"}}
    G.decision_gate(signed, ["privacy"], (20, 20))
    for record, approvals, cover in ((signed, ["privacy", "register"], None), (signed, ["privacy"], (19, 20)), ({"privacy": {"decision": "approve"}}, ["privacy"], None)):
        with pytest.raises(G.GateError):
            G.decision_gate(record, approvals, cover)


def test_mismatches(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", "z")], "id int, p string, q string")
    b = spark.createDataFrame([(1, "x", "w"), (2, "y", "z")], "id int, p string, q string")
    assert [tuple(r) for r in J.mismatches(a, b, ["id"], ["p", "q"]).collect()] == [(1, "q")]
