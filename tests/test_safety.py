"""Tenant guards on every way of reading, order after joins, whole pointers, batches that come twice."""

import pytest

from larkspur import types as t
from larkspur.errors import ConflictError, TenantScopeError
from larkspur.functions import olap
from larkspur.operators.relations import Read, Relations, many
from larkspur.operators.store import Store
from larkspur.plans.lower import compile_query
from larkspur.plans.query import from_, union_all
from larkspur.session import Session
from larkspur.streaming.views import materialized_view
from larkspur.table import frame_table, table


@pytest.fixture(scope="module")
def library(spark):
    shelves = frame_table("shelves", spark.createDataFrame([("north", k, k % 4) for k in range(8)] + [("south", 90, 1)], "branch string, shelf int, floor int"), {"branch": t.string, "shelf": t.int32, "floor": t.int32}, tenant="branch")
    books = frame_table("books", spark.createDataFrame([("north", 100 + k, k % 8, k * 7 % 50) for k in range(40)] + [("south", 999, 90, 1)], "branch string, book int, shelf int, pages int"), {"branch": t.string, "book": t.int32, "shelf": t.int32, "pages": t.int32}, tenant="branch")
    return shelves, books, Relations({"shelves": {"books": many(books, "shelf", "shelf")}})


def north(r):
    return r.branch.eq("north")


def test_find_many_keeps_its_order_after_joins(spark, library):
    shelves, books, graph = library
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = Session(spark, relations=graph).find_many(shelves, Read(where=north, order_by=(("floor", "desc"), ("shelf", "asc")), columns=("shelf",), with_={"books": Read(where=north, order_by=(("pages", "desc"), ("book", "asc")), columns=("book", "pages"))}, counts=("books",)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [r["shelf"] for r in got] == [3, 7, 2, 6, 1, 5, 0, 4]
    for r in got:
        pages = [(-b["pages"], b["book"]) for b in r["books"]]
        assert pages == sorted(pages) and len(pages) == 5 == r["books_count"]


def test_every_read_is_guarded(spark, library):
    shelves, books, graph = library
    seen = []
    s = Session(spark, relations=graph, require_tenant_scope=True, observers=[seen.append])
    order = [("shelf", "asc")]
    for read in (
        lambda: s.run(from_(shelves).select("shelf")),
        lambda: s.paginate(from_(shelves).select("shelf"), order, 2),
        lambda: s.find_many(shelves),
        lambda: s.find_many(shelves, Read(where=north, with_={"books": Read()})),
        lambda: s.find_many(shelves, Read(where=north, counts=("books",))),
        lambda: s.find_by_ids(shelves, "shelf", [90]),
    ):
        with pytest.raises(TenantScopeError):
            read()
    assert seen == []
    assert len(s.paginate(from_(shelves).select("shelf").where(north), order, 2).rows) == 2
    assert len(s.paginate(from_(shelves).select("shelf").cross_tenant(), order, 20).rows) == 9
    assert len(s.find_many(shelves, Read(where=north, with_={"books": Read(where=north)}))) == 8
    assert len(s.find_many(shelves, Read(cross_tenant=True, counts=("books",), with_={"books": True}))) == 9
    assert s.find_by_ids(shelves, "shelf", [90], where=north) == [[]] and len(s.find_by_ids(shelves, "shelf", [90], cross_tenant=True)[0]) == 1
    assert [o.operation for o in seen] == ["page", "page", "find many", "find many", "find by ids", "find by ids"]


def test_pointers_are_whole_and_never_overwritten(spark, tmp_path):
    notes = table("notes", {"k": t.int32})
    one, two = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    rows = spark.createDataFrame([(1,)], "k int")
    one.append(notes, rows)
    with pytest.raises(ConflictError):  # both begin with the same version

        def work():
            one.append(notes, rows)
            two.append(notes, rows)

        one.transaction(work)
    assert one.frame(notes).count() == 2
    number = one._committed("notes")[0]
    assert not one._write(f"{tmp_path}/notes/_current.{number:012d}", "lost", replace=False) and one.frame(notes).count() == 2
    one.overwrite(notes, rows)
    one.vacuum(notes)
    assert two.frame(notes).count() == 1 and len(list((tmp_path / "notes").glob("_current.*"))) == 1 and not list((tmp_path / "notes").glob("*.tmp"))


def test_a_batch_that_comes_twice_is_written_once(spark, tmp_path):
    source = frame_table("visits", spark.createDataFrame([(k, k % 3) for k in range(12)], "id int, kind int"), {"id": t.int32, "kind": t.int32})
    to = table("per_kind", {"kind": t.int32, "n": t.int64})
    view, store, caught = materialized_view("v", to, from_(source).select(lambda x: {"kind": x.kind, "n": olap.count()}).group_by("kind")), Store(spark, str(tmp_path / "t")), {}
    rows = source.source(spark)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    real = store.append

    def append(table_, df, marks=None):
        caught.update(df=df, marks=marks)
        real(table_, df, marks)
        if not caught.get("failed"):
            caught["failed"] = True
            raise RuntimeError("lost after the write")

    store.append = append
    for _ in range(2):
        try:
            view.start(store, str(tmp_path / "in"), str(tmp_path / "state"), once=True).awaitTermination()
        except Exception:  # noqa: BLE001
            pass
    assert caught["failed"] and store.frame(to).count() == 3


def test_unions_take_the_widest_number(spark):
    small = frame_table("small", spark.createDataFrame([(1,)], "n int"), {"n": t.int32})
    large = frame_table("large", spark.createDataFrame([(1 << 40,)], "n long"), {"n": t.int64})
    made = compile_query(union_all(from_(small).select("n"), from_(large).select("n")).order_by("n"), spark)
    assert [r["n"] for r in made.decode_rows(made.df.collect())] == [1, 1 << 40]
