"""Views, backfills, schema tools, seeding, the harness, file tables and the driver contract."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from larkspur import harness, schema, seed
from larkspur import types as t
from larkspur.errors import ConflictError, QueryBuilderDefect
from larkspur.functions import olap, pg
from larkspur.operators.store import Store
from larkspur.plans.lower import compile_query
from larkspur.plans.query import from_, union_all
from larkspur.streaming.views import backfill, compact, materialized_view, merged
from larkspur.table import file_table, frame_table, table


def hits(spark):
    rows = [(k, dt.datetime(2024, 1, 1 + k // 10, k % 24), k % 3) for k in range(40)]
    return frame_table("hits", spark.createDataFrame(rows, "id long, at timestamp_ntz, kind int"), {"id": t.int64, "at": t.date_time64, "kind": t.int32})


def view_of(h, engine="summing"):
    to = table("by_kind", {"kind": t.int32, "n": t.int64, "last": t.simple_aggregate("max", t.int64)}, engine=engine, order_by=("kind",))
    return materialized_view("by_kind_view", to, from_(h).select(lambda x: {"kind": x.kind, "n": olap.count(), "last": olap.max_(x.id)}).group_by("kind"))


def test_view_follows_inserts_and_merges(spark, tmp_path):
    h = hits(spark)
    store, view = Store(spark, str(tmp_path)), view_of(h)
    rows = h.source(spark)
    for k in range(2):
        store.append(view.to, view.over(rows.where(F.col("id") % 2 == k)))
    want = [(k, sum(i % 3 == k for i in range(40)), max(i for i in range(40) if i % 3 == k)) for k in range(3)]
    assert store.frame(view.to).count() == 6
    assert sorted(map(tuple, merged(store.frame(view.to), view.to).collect())) == want
    compact(store, view.to)
    assert store.frame(view.to).count() == 3


def test_backfill_runs_each_window_once(spark, tmp_path):
    h = hits(spark)
    store, view = Store(spark, str(tmp_path)), view_of(h)
    span = (dt.datetime(2024, 1, 1, 5), dt.datetime(2024, 1, 4))
    assert backfill(view, store, h.source(spark), "at", *span) == 3 and backfill(view, store, h.source(spark), "at", *span) == 0
    want = h.source(spark).where((F.col("at") >= F.lit(span[0])) & (F.col("at") < F.lit(span[1]))).count()
    assert store.frame(view.to).agg(F.sum("n")).first()[0] == want


def test_view_streams(spark, tmp_path):
    h = hits(spark)
    store, view = Store(spark, str(tmp_path / "t")), view_of(h)
    for part in range(2):
        h.source(spark).where(F.col("id") % 2 == part).write.mode("append").parquet(str(tmp_path / "in"))
        view.start(store, str(tmp_path / "in"), str(tmp_path / "state"), once=True).awaitTermination()
    assert merged(store.frame(view.to), view.to).agg(F.sum("n")).first()[0] == 40


def test_view_refusals(spark):
    h = hits(spark)
    with pytest.raises(QueryBuilderDefect):
        materialized_view("v", table("x", {"a": t.int32}), from_(h).select("kind"))
    with pytest.raises(QueryBuilderDefect):
        materialized_view("v", table("x", {"kind": t.string}), from_(h).select("kind"))
    with pytest.raises(QueryBuilderDefect):
        materialized_view("v", table("x", {"kind": t.int32}), union_all(from_(h).select("kind")))


def test_replacing_engine(spark):
    to = table("r", {"k": t.int32, "v": t.string, "version": t.int64}, engine="replacing", order_by=("k",))
    df = spark.createDataFrame([(1, "z", 1), (1, "a", 2), (2, "b", 1)], "k int, v string, version long")
    assert sorted(map(tuple, merged(df, to, "version").collect())) == [(1, "a", 2), (2, "b", 1)]


A = table("a", {"id": t.int64, "name": t.string}, primary_key=("id",))
B = table("a", {"id": t.int64, "label": t.nullable(t.string), "n": t.nullable(t.int32)}, primary_key=("id",))


def test_schema_diff_and_digest():
    one, two = schema.snapshot([A]), schema.snapshot([B])
    assert schema.digest(one) == schema.digest(schema.snapshot([A])) != schema.digest(two)
    assert [o.kind for o in schema.diff({}, one)] == ["create_table"] and [o.kind for o in schema.diff(one, {})] == ["drop_table"] and schema.diff(one, one) == []
    assert {o.kind for o in schema.diff(one, two)} == {"drop_column", "add_column"}
    renamed = schema.diff(one, two, {"a.name": "label"})
    assert [o.kind for o in renamed] == ["rename_column", "modify_column", "add_column"]
    assert "RENAME COLUMN `name` TO `label`" in schema.render(renamed[0]) and schema.render(schema.diff({}, one)[0]).startswith("CREATE TABLE `a` (`id` bigint NOT NULL")
    with pytest.raises(QueryBuilderDefect):
        schema.diff(one, schema.snapshot([table("a", {"id": t.int64, "name": t.string}, primary_key=("id",), order_by=("id",))]))
    assert schema.snapshot([table("e", {"a": t.int32}, external=True)]) == {}


def test_migrations_run_once(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.append(A, spark.createDataFrame([(1, "x")], "id long, name string"))
    ran = []

    def widen(s):
        df = s.frame(A)
        for op in schema.diff(schema.snapshot([A]), schema.snapshot([B]), {"a.name": "label"}):
            df = schema.rewrite(df, op)
        s.overwrite(B, df)
        ran.append(1)

    def fails(s):
        raise RuntimeError("power cut")

    runner = schema.Runner(store)
    first, second = schema.Migration("1", (widen,)), schema.Migration("2", ("SELECT 1", fails))
    assert runner.run([first]) == ["1"] and runner.run([first]) == [] and len(ran) == 1
    assert [tuple(r) for r in store.frame(B).collect()] == [(1, "x", None)] and schema.verify(store, [B]) == [] and schema.verify(store, [A]) != []
    with pytest.raises(RuntimeError):
        runner.run([first, second])
    assert runner.status([first, second]) == {"1": "done", "2": "uncertain"}
    with pytest.raises(ConflictError):
        runner.run([second])
    runner.resolve("2", applied=True)
    assert runner.run([second]) == ["2"]
    assert runner.status([schema.Migration("1", ("other",))]) == {"1": "changed"}
    runner.baseline([schema.Migration("3", ())])
    assert runner.status([schema.Migration("3", ())]) == {"3": "done"}
    store._write(runner.path, json.dumps(runner.ledger() | {"lease": {"owner": "other", "until": 9e12}}))
    with pytest.raises(ConflictError):
        runner.run([first])
    assert '"id": t.nullable(t.int64)' in schema.introspect(store.frame(A), "a")


def test_seed_is_deterministic(spark):
    kinds = table("k", {"id": t.int64, "org": t.string, "name": t.nullable(t.string), "price": t.float64, "ok": t.boolean, "at": t.date_time64, "twice": t.float64, "tags": t.array(t.string)}, tenant="org", primary_key=("id",), computed={"twice": "price * 2"})
    made = lambda n, parts: sorted(map(str, seed.seed(spark, kinds, n, {"name": seed.pick("a", "b")}, 3, "org_1").repartition(parts).collect()))
    assert made(50, 1) == made(50, 4)
    df = seed.seed(spark, kinds, 50, {"name": seed.pick("a", "b")}, 3, "org_1")
    assert df.select("id").distinct().count() == 50 and {r["name"] for r in df.collect()} == {"a", "b"} and df.where("twice <> price * 2 OR org <> 'org_1'").count() == 0
    with pytest.raises(QueryBuilderDefect):
        seed.seed(spark, kinds, 1, {"none": 1})


def test_harness(spark):
    cases = [harness.Case("a", lambda s: s.range(5)), harness.Case("b", lambda s: s.range(3)), harness.Case("bad", lambda s: s.sql("SELECT nothing"))]
    got = harness.run_suite(spark, cases, runs=3, warmup=1)
    by = {r.id: r for r in got}
    assert len(by["a"].wall_ms) == 3 and by["a"].rows == 5 and by["bad"].error and by["a"].result_hash != by["b"].result_hash
    assert harness.compare_runs(got[:2], got[:2])["exit_code"] == harness.PASS and harness.compare_runs(got, got)["exit_code"] == harness.INCONCLUSIVE
    slow = harness.Result("a", [x * 10 for x in by["a"].wall_ms], 5, by["a"].result_hash)
    assert harness.compare_runs([by["a"]], [slow])["exit_code"] == harness.REGRESSION
    assert harness.compare_runs([by["a"]], [harness.Result("a", [1.0], 5, "other")])["exit_code"] == harness.INVALID
    assert harness.compare_budgets(got[:2], {"a": {"p95_wall_ms": 0}})["over"][0]["id"] == "a"
    assert harness.fingerprint("SELECT 1  FROM a") == harness.fingerprint("select 22 from a") != harness.fingerprint("select 1 from b")
    r = harness.Result("x", [float(k) for k in range(1, 101)])
    assert r.stats()["p50_wall_ms"] == 50 and r.stats()["p95_wall_ms"] == 95


def test_file_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    for kind, options in (("csv", {"header": "true"}), ("json", {}), ("orc", {})):
        df.write.format(kind).options(**options).save(str(tmp_path / kind))
        found = file_table("f", str(tmp_path / kind), {"id": t.int64, "name": t.string}, kind, **options)
        assert compile_query(from_(found).select(lambda f: {"s": pg.sum(f.id), "n": olap.count()}), spark).df.collect()[0]["s"] == 3


def test_entry_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 70
    assert entry.entry(spark).count() > 0


def test_plans_push_down(spark):
    plan = harness.explain(entry.queries()["q_bucket_events"](spark, "/root/testdata/sf0.001"))
    assert "In(event_type, [click,purchase,view])" in plan and "event_id" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_command_line(tmp_path, monkeypatch, capsys):
    from larkspur import kit

    (tmp_path / "models_for_kit.py").write_text("from larkspur import types as t\nfrom larkspur.table import table\nTABLES = [table('a', {'id': t.int64})]\nMIGRATIONS = []\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    assert kit.main(["generate", "models_for_kit"]) == 0 and "CREATE TABLE `a`" in capsys.readouterr().out
    assert kit.main(["check", "models_for_kit"]) == 1
    import models_for_kit

    (tmp_path / "snapshot.json").write_text(schema.canonical(schema.snapshot(models_for_kit.TABLES)))
    assert kit.main(["check", "models_for_kit", "--snapshot", str(tmp_path / "snapshot.json")]) == 0
