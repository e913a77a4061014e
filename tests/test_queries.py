"""The builder: plans, refusals, nulls, tenants, subqueries, pages, relations and writes, on a fixed pair of tables."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from larkspur import types as t
from larkspur.errors import CardinalityError, ConflictError, ConstraintError, InvalidArguments, InvalidLiteral, QueryBuilderDefect, RowDecodeError, TenantScopeError, UnresolvedParam
from larkspur.expr import and_, lit, not_, or_, outer, outer_ref, param, raw_cond, raw_expr, sql, when
from larkspur.functions import olap, pg, sqlite
from larkspur.operators.relations import Read, Relations, many, one
from larkspur.operators.write import delete_from, excluded, excluded_all, insert_into, update
from larkspur.plans.lower import Semantics, compile_query
from larkspur.plans.query import from_, from_query, from_union, group_by, limit, order_by, select, select_no_from, union_all, where
from larkspur.plans.subquery import exists, in_subquery, not_in_subquery, scalar
from larkspur.plans.tenant import scope_of
from larkspur.session import Recorder, Session
from larkspur.sources import full_text, json_tables
from larkspur.table import frame_table, table

ORDERS = [
    ("org_1", 1, "acme", 10, "paid", "rush", 0), ("org_1", 2, "acme", 20, "paid", None, 10), ("org_1", 3, "globex", 5, "open", None, 20), ("org_1", 4, "initech", 7, "void", "it's", 30), ("org_2", 5, "acme", 99, "paid", None, 40),
]
CUSTOMERS = [("org_1", "acme", "gold"), ("org_1", "globex", "silver"), ("org_1", "umbrella", "bronze"), ("org_2", "acme", "platinum")]


@pytest.fixture(scope="module")
def db(spark):
    class Tables:
        orders = frame_table(
            "orders", spark.createDataFrame([(*r[:6], dt.datetime(2026, 1, 1) + dt.timedelta(minutes=r[6])) for r in ORDERS], "OrgId string, Id int, Customer string, Amount long, Status string, Note string, Created timestamp_ntz"),
            {"OrgId": t.string, "Id": t.int32, "Customer": t.string, "Amount": t.int64, "Status": t.string, "Note": t.nullable(t.string), "Created": t.date_time64}, tenant="OrgId",
        )
        customers = frame_table("customers", spark.createDataFrame(CUSTOMERS, "OrgId string, Name string, Tier string"), {"OrgId": t.string, "Name": t.string, "Tier": t.string}, tenant="OrgId")

    return Tables


def run(spark, q, params=None, semantics=None):
    made = compile_query(q, spark, params, semantics)
    return made.decode_rows(made.df.collect())


def of_1(o):
    return o.OrgId.eq("org_1")


def test_group_having(spark, db):
    q = from_(db.orders, "o").select(lambda o: {"c": o.Customer, "n": olap.count(), "paid": olap.count_if(o.Status.eq("paid")), "s": olap.sum(o.Amount), "lo": olap.min_(o.Amount), "hi": olap.max_(o.Amount)}).where(of_1).group_by("c").having(lambda o: olap.count().gt(1))
    assert run(spark, q) == [{"c": "acme", "n": 2, "paid": 2, "s": 30, "lo": 10, "hi": 20}]


def joined(db):
    return from_(db.orders, "o").left_join(db.customers, "c", lambda o, c: [o.OrgId.eq(c.OrgId), o.Customer.eq(c.Name)])


def test_left_join_and_narrowing(spark, db):
    q = joined(db).select(lambda o: {"Id": o.Id, "Tier": o.c.Tier}).where(lambda o: [of_1(o), o.Id.gt(2)]).order_by("Id")
    assert run(spark, q) == [{"Id": 3, "Tier": "silver"}, {"Id": 4, "Tier": None}]
    assert run(spark, q, semantics=Semantics(missing_join="default"))[1]["Tier"] == ""
    assert compile_query(q, spark).columns["Tier"].is_nullable
    narrowed = joined(db).where(lambda o: o.c.Tier.is_not_null()).select(lambda o: {"Tier": o.c.Tier})
    assert not compile_query(narrowed, spark).columns["Tier"].is_nullable
    late = joined(db).select(lambda o: {"Tier": o.c.Tier}).where(lambda o: o.c.Tier.is_not_null())
    assert compile_query(late, spark).columns["Tier"].is_nullable


def test_union(spark, db):
    part = lambda s: from_(db.orders, "o").select(lambda o: {"status": o.Status, "total": o.Amount}).where(lambda o: [of_1(o), o.Status.eq(s)])
    u = union_all(part("paid"), part("void"), part("open")).order_by(("total", "desc")).limit(2).offset(2)
    assert run(spark, u) == [{"status": "void", "total": 7}, {"status": "open", "total": 5}]
    counted = from_union(union_all(part("paid"), part("void")), "u").select(lambda x: {"n": olap.count()})
    assert run(spark, counted) == [{"n": 3}]


def test_distinct_on_and_order(spark, db):
    q = from_(db.orders, "o").select(lambda o: {"Customer": o.Customer, "Id": o.Id}).order_by(("Customer", "asc"), ("Id", "desc")).distinct_on("Customer")
    assert [(r["Customer"], r["Id"]) for r in run(spark, q)] == [("acme", 5), ("globex", 3), ("initech", 4)]
    nulls = lambda order, d: [r["Note"] for r in run(spark, from_(db.orders, "o").select("Note").distinct().order_by(("Note", d)), semantics=Semantics(null_order=order))]
    assert nulls("first", "asc") == [None, "it's", "rush"] and nulls("last", "asc") == ["it's", "rush", None] and nulls("greatest", "desc") == [None, "rush", "it's"] and nulls("last", "desc") == ["rush", "it's", None]


def test_predicates(spark, db):
    ids = lambda make: sorted(r["Id"] for r in run(spark, from_(db.orders, "o").select("Id").where(make)))
    assert ids(lambda o: o.Note.is_null()) == [2, 3, 5] and ids(lambda o: o.Note.neq("rush")) == [4] and ids(lambda o: not_(o.Note.eq("rush"))) == [4]
    assert ids(lambda o: o.Note.in_([])) == [] and ids(lambda o: o.Note.not_in([])) == [1, 2, 3, 4, 5] and ids(lambda o: o.Amount.gt(6.5)) == [1, 2, 4, 5]
    assert ids(lambda o: or_(o.Id.eq(1), None, o.Id.eq(5))) == [1, 5] and ids(lambda o: [when(None, o.Id.eq), o.Id.between(2, 3)]) == [2, 3] and ids(lambda o: o.Note.eq("it's")) == [4]
    assert ids(lambda o: o.Created.gte("2026-01-01 00:20:00")) == [3, 4, 5] and ids(lambda o: o.Created.eq(dt.datetime(2026, 1, 1, 0, 10))) == [2] and ids(lambda o: raw_cond("Amount > 50")) == [5]
    assert ids(lambda o: sql.cond("{a} + {b} = 21", a=o.Amount, b=o.Id)) == [] and ids(lambda o: sql.cond("{a} > {b}", a=o.Amount, b=19)) == [2, 5]


def test_text_match(spark):
    bodies = ["50% off", "500 off", "a_b", "aXb", "C:\\dir", "C:dir", "A_B", "[x]", "x", "who?", "whom"]
    texts = frame_table("texts", spark.createDataFrame(list(enumerate(bodies, 1)), "Id int, Body string"), {"Id": t.int32, "Body": t.string})
    ids = lambda make: sorted(r["Id"] for r in run(spark, from_(texts).select("Id").where(make)))
    assert ids(lambda x: x.Body.contains("50%")) == [1] and ids(lambda x: x.Body.like("50\\%%")) == [1] and ids(lambda x: x.Body.contains("_")) == [3, 7] and ids(lambda x: x.Body.contains("a_b", insensitive=True)) == [3, 7]
    assert ids(lambda x: x.Body.contains("\\")) == [5] and ids(lambda x: x.Body.starts_with("[")) == [8] and ids(lambda x: x.Body.ends_with("?")) == [10] and ids(lambda x: x.Body.like("who_")) == [10, 11] and ids(lambda x: x.Body.ilike("A\\_b")) == [3, 7]


def test_subqueries(spark, db):
    gold = from_(db.customers, "c").select("Name").where(lambda c: c.Tier.eq("gold"))
    ids = lambda make: sorted(r["Id"] for r in run(spark, from_(db.orders, "o").select("Id").where(make)))
    assert ids(lambda o: in_subquery(o.Customer, gold)) == [1, 2, 5] and ids(lambda o: not_in_subquery(o.Customer, gold)) == [3, 4]
    notes = from_(db.orders, "p").select("Note")
    assert ids(lambda o: not_in_subquery(o.Customer, notes)) == []  # a null among them
    same = from_(db.customers, "c").select("Name").where(lambda c: [c.Name.eq(outer_ref("o.Customer", t.string)), c.OrgId.eq(outer_ref("o.OrgId", t.string))])
    assert ids(lambda o: exists(same)) == [1, 2, 3, 5] and ids(lambda o: not_(exists(same))) == [4]
    q = from_(db.customers, "c").select(lambda c: {"Name": c.Name, "n": scalar(from_(db.orders, "o").select(lambda o: {"n": olap.count()}).where(lambda o: [o.Customer.eq(outer(c.Name)), o.OrgId.eq(outer(c.OrgId))]))}).where(lambda c: c.OrgId.eq("org_1")).order_by("Name")
    assert [r["n"] for r in run(spark, q)] == [2, 1, 0]
    with pytest.raises(QueryBuilderDefect):
        in_subquery(lit(1), from_(db.customers, "c").select("Name", "Tier"))


def test_cross_cte_and_pipes(spark, db):
    big = table("big", {"Id": t.int32}, external=True)
    q = from_(big).with_cte("big", from_(db.orders, "o").select("Id").where(lambda o: o.Amount.gt(9))).cross_join(db.customers, "c").select(lambda b: {"n": olap.count()}).where(lambda b: b.c.OrgId.eq("org_1"))
    assert run(spark, q) == [{"n": 9}]
    piped = from_(db.orders, "o").pipe(select(lambda o: {"c": o.Customer, "n": olap.count()}), where(of_1), group_by("c"), order_by(("n", "desc"), ("c", "asc")), limit(1))
    assert run(spark, piped) == [{"c": "acme", "n": 2}]
    text = from_(table("two", {"a": t.int32}, external=True)).with_cte("two", "SELECT 1 AS a UNION ALL SELECT 2", tenant_scope="untenanted").select(lambda x: {"s": olap.sum(x.a)})
    assert run(spark, text) == [{"s": 3}] and scope_of(text) == "untenanted"
    odd = from_(db.orders, "o").select(lambda o: {"order by": o.Id, "a`b": o.Amount}).where(lambda o: o.Id.eq(1))
    assert compile_query(odd.order_by("order by"), spark).df.collect()[0]["order by"] == 1


REFUSED = [
    lambda d: from_(d.orders, "o").select(lambda o: {"Id": o.Id, "n": olap.count()}), lambda d: from_(d.orders, "o").select("Id").where(lambda o: olap.count().gt(1)), lambda d: from_(d.orders, "o").select(lambda o: {"n": olap.count()}).group_by("n"),
    lambda d: from_(d.orders, "o").select("Id").group_by("none"), lambda d: from_(d.orders, "o").select("Id").order_by("none"), lambda d: from_(d.orders, "o").select("Id").for_update(), lambda d: from_(d.orders, "o").select("Id").distinct_on("none"),
    lambda d: from_(d.orders, "o").inner_join(d.customers, "o", lambda a, b: None).select("Id"), lambda d: from_(d.orders, "o").inner_join(d.customers, "Id", lambda a, b: a.OrgId.eq(b.OrgId)).select("Amount"), lambda d: from_(d.orders, "o").select("none"),
    lambda d: from_(d.orders, "o").select("Id").having(lambda o: o.Id.gt(1)), lambda d: union_all(from_(d.orders, "o").select("Id"), from_(d.orders, "o").select("Amount")), lambda d: from_(d.orders, "o").select("Id").where(lambda o: o.Note.eq(None)),
    lambda d: from_(d.orders, "o").select("Id").with_cte("a", "SELECT 1").with_cte("a", "SELECT 2"), lambda d: from_(d.orders, "o").inner_join(d.customers, "c", lambda o, c: olap.count().gt(1)).select("Id"), lambda d: from_(d.orders, "o").select("Id").distinct().order_by(lambda o: [(o.Amount, "asc")]),
]


@pytest.mark.parametrize("k", range(len(REFUSED)))
def test_refusals(spark, db, k):
    with pytest.raises(QueryBuilderDefect):
        compile_query(REFUSED[k](db), spark)


def test_value_refusals(spark, db):
    with pytest.raises(UnresolvedParam):
        compile_query(from_(db.orders, "o").select("Id").where(lambda o: o.Id.eq(param.int("a"))), spark)
    with pytest.raises(InvalidLiteral):
        compile_query(from_(db.orders, "o").select("Id").where(lambda o: o.Id.eq(param.int("a"))), spark, {"a": 1.5})
    for make in (lambda o: o.Status.eq(5), lambda o: o.Id.eq("x"), lambda o: o.Created.eq("never"), lambda o: o.Id.eq([1])):
        with pytest.raises(InvalidLiteral):
            compile_query(from_(db.orders, "o").select("Id").where(make), spark)
    for n in (-1, 1.5, True, 2**60):
        with pytest.raises(InvalidArguments):
            from_(db.orders, "o").limit(n)
    with pytest.raises(InvalidArguments):
        from_(db.orders, "o").format("CSV")
    with pytest.raises(InvalidLiteral):
        lit([1])


def test_types():
    assert t.uint8.literal(255) == 255 and t.array(t.int64).literal([1, 2]) == [1, 2] and t.nullable(t.string).literal(None) is None and t.uint64_wide.literal("18446744073709551615") == 2**64 - 1
    for kind, bad in ((t.uint8, 256), (t.uint16, -1), (t.int32, 2**31), (t.integer, 2**53), (t.date_time, "2026-01-01 00:00:00.5"), (t.varchar(2), "abc"), (t.decimal(4, 2), 123), (t.enum("e", ("a",)), "b"), (t.string, None), (t.uuid, "x"), (t.boolean, 2), (t.varbinary(1), b"ab"), (t.date, "x"), (t.brand(t.int32, lambda v: v > 0, "positive"), 0)):
        with pytest.raises(InvalidLiteral):
            kind.literal(bad)
    assert t.precision(t.date_time64, 9).spark.typeName() == "long" and t.low_cardinality(t.string).literal("a") == "a" and t.simple_aggregate("sum", t.int64).merge == "sum"


def test_decoding(spark, db):
    positive = t.brand(t.int64, lambda v: v > 6, "large")
    made = compile_query(from_(db.orders, "o").select(lambda o: {"v": raw_expr("Amount", positive)}).order_by("v"), spark)
    with pytest.raises(RowDecodeError) as failure:
        made.decode_rows(made.df.collect())
    assert failure.value.row_index == 0 and failure.value.column == "v"
    assert compile_query(from_(db.orders, "o").select(lambda o: {"v": o.Id, "u": olap.count().add(1)}).group_by("v"), spark).row_schema_source == "derived"


def test_tenant_scopes(db):
    base = from_(db.orders, "o").select("Id")
    assert scope_of(base) == "cross-tenant" and scope_of(base.where(of_1)) == "single-tenant" and scope_of(base.where(lambda o: o.OrgId.in_(["org_1"]))) == "single-tenant"
    assert scope_of(base.where(lambda o: o.OrgId.in_(["org_1", "org_2"]))) == "cross-tenant" and scope_of(base.where(lambda o: or_(of_1(o), o.Id.eq(1)))) == "cross-tenant" and scope_of(base.where(lambda o: not_(of_1(o)))) == "cross-tenant"
    assert scope_of(base.where(of_1).cross_tenant()) == "cross-tenant" and scope_of(base.where(lambda o: o.OrgId.eq(param.string("org")))) == "single-tenant" and scope_of(base.where(lambda o: [of_1(o), o.OrgId.eq("org_2")])) == "cross-tenant"
    assert scope_of(joined(db).select(lambda o: {"Id": o.Id}).where(of_1)) == "single-tenant" and scope_of(joined(db).select(lambda o: {"Id": o.Id}).where(lambda o: o.c.OrgId.eq("org_1"))) == "cross-tenant"
    inner = from_(db.orders, "o").inner_join(db.customers, "c", lambda o, c: o.OrgId.eq(c.OrgId)).select("Id")
    assert scope_of(inner.where(lambda o: o.c.OrgId.eq("org_1"))) == "single-tenant"
    two = lambda a, b: union_all(base.where(lambda o: o.OrgId.eq(a)), base.where(lambda o: o.OrgId.eq(b)))
    assert scope_of(two("org_1", "org_1")) == "single-tenant" and scope_of(two("org_1", "org_2")) == "cross-tenant"
    assert scope_of(from_query(base.where(of_1), "q").select("Id")) == "single-tenant" and scope_of(select_no_from(lambda: {"a": lit(1)})) == "untenanted"


def test_session_reads(spark, db):
    seen = []
    s = Session(spark, observers=[seen.append], require_tenant_scope=True)
    q = from_(db.orders, "o").select("Id").where(of_1).order_by("Id")
    assert [r["Id"] for r in s.run(q)] == [1, 2, 3, 4] and seen[0].rows == 4 and seen[0].scope == "single-tenant"
    assert s.run_one(q.where(lambda o: o.Id.eq(1))) == {"Id": 1} and s.run_option(q.where(lambda o: o.Id.eq(9))) is None and [r["Id"] for r in s.stream(q)] == [1, 2, 3, 4]
    for call, make in ((s.run_one, q), (s.run_option, q), (s.run_non_empty, q.where(lambda o: o.Id.eq(9)))):
        with pytest.raises(CardinalityError):
            call(make)
    with pytest.raises(TenantScopeError):
        s.run(from_(db.orders, "o").select("Id"))
    assert len(s.run(from_(db.orders, "o").select("Id").cross_tenant())) == 5
    assert s.query("SELECT :a AS v, count(*) AS n FROM {o}", {"a": "x' --"}, o=db.orders.source(spark)) == [{"v": "x' --", "n": 5}]
    double = Recorder([[{"a": 1}]])
    assert double.run(q) == [{"a": 1}] and double.run(q) == [] and len(double.seen) == 2


def test_pages(spark, db):
    s = Session(spark)
    q = from_(db.orders, "o").select("Customer", "Id")
    order, seen, cursor = [("Customer", "desc"), ("Id", "asc")], [], None
    while True:
        page = s.paginate(q, order, 2, cursor)
        seen += [r["Id"] for r in page.rows]
        cursor = page.next_cursor
        if cursor is None:
            break
    assert seen == [4, 3, 1, 2, 5]
    first = s.paginate(q, order, 2).next_cursor
    with pytest.raises(InvalidArguments):
        s.paginate(q, [("Id", "asc")], 2, first)
    with pytest.raises(InvalidArguments):
        s.paginate(q, order, 2, "zzz")
    for bad in (q.offset(1), q.order_by("Id"), q.limit(3)):
        with pytest.raises(QueryBuilderDefect):
            s.paginate(bad, order, 2)
    with pytest.raises(QueryBuilderDefect):
        s.paginate(from_(db.orders, "o").select("Note"), [("Note", "asc")], 2)
    with pytest.raises(QueryBuilderDefect):
        s.paginate(q, [("Id", "asc"), ("Id", "desc")], 2)


def test_relations(spark, db):
    g = Relations({"customers": {"orders": many(db.orders, "Name", "Customer")}, "orders": {"customer": one(db.customers, "Customer", "Name")}})
    s = Session(spark, relations=g)
    got = s.find_many(db.customers, Read(where=lambda c: c.OrgId.eq("org_1"), order_by=(("Name", "asc"),), columns=("Name",), with_={"orders": Read(where=lambda o: o.OrgId.eq("org_1"), order_by=(("Amount", "desc"),), columns=("Id",))}, counts=("orders",)))
    by = {r["Name"]: r for r in got}
    assert [o["Id"] for o in by["acme"]["orders"]] == [2, 1] and by["umbrella"]["orders"] == [] and by["acme"]["orders_count"] == 3 and by["umbrella"]["orders_count"] == 0
    with pytest.raises(QueryBuilderDefect):
        s.find_many(db.customers, Read(with_={"orders": Read(limit=3)}))
    one_each = {r["Id"]: r["customer"] for r in s.find_many(db.orders, Read(where=of_1, columns=("Id",), with_={"customer": Read(where=lambda c: c.OrgId.eq("org_1"), columns=("Tier",))}))}
    assert one_each[3] == {"Tier": "silver"} and one_each[4] is None
    names = lambda make: sorted(r["Name"] for r in s.run(from_(db.customers).select("Name").where(lambda c: [c.OrgId.eq("org_1"), make(g.of(db.customers, "orders"))])))
    assert names(lambda r: r.some(lambda o: o.Amount.gt(50))) == ["acme"] and names(lambda r: r.none()) == ["umbrella"] and names(lambda r: r.every(lambda o: o.Note.eq("rush"))) == ["acme", "globex", "umbrella"]  # a null does not fail
    assert names(lambda r: r.every(lambda o: o.Status.eq("paid"))) == ["acme", "umbrella"] and names(lambda r: r.count().gt(1)) == ["acme"]
    assert [[r["Id"] for r in rows] for rows in s.find_by_ids(db.orders, "Customer", ["globex", "none", "globex"])] == [[3], [], [3]]
    with pytest.raises(QueryBuilderDefect):
        g.of(db.orders, "none")


@pytest.fixture
def writable(spark, tmp_path):
    scratch = table(
        "scratch", {"Id": t.int32, "OrgId": t.string, "Name": t.string, "Note": t.nullable(t.string), "Qty": t.int32, "Twice": t.nullable(t.int64)}, tenant="OrgId", primary_key=("Id",), defaults={"Qty": 5, "Name": lambda: "made"},
        computed={"Twice": "Qty * 2"}, checks={"qty": "Qty >= 0"}, on_update={"Note": lambda: "touched"},
    )
    return Session(spark, str(tmp_path / "tables")), scratch


def all_rows(s, scratch):
    return {r["Id"]: r for r in s.run(from_(scratch).select())}


def test_writes(writable):
    s, scratch = writable
    back = s.execute(insert_into(scratch).values({"Id": 1, "OrgId": "a", "Name": "x"}, {"Id": 2, "OrgId": "a", "Note": "n", "Qty": 7}).returning("Id", "Qty", "Twice"))
    assert sorted((r["Id"], r["Qty"], r["Twice"]) for r in back) == [(1, 5, 10), (2, 7, 14)] and all_rows(s, scratch)[2]["Name"] == "made"
    s.execute(insert_into(scratch).values({"Id": 2, "OrgId": "a", "Qty": 1}, {"Id": 3, "OrgId": "b", "Qty": 1}).on_conflict_do_nothing(["Id"]))
    assert {k: r["Qty"] for k, r in all_rows(s, scratch).items()} == {1: 5, 2: 7, 3: 1}
    up = insert_into(scratch).values({"Id": 3, "OrgId": "b", "Name": "new", "Qty": 9}, {"Id": 4, "OrgId": "b", "Qty": 2})
    back = s.execute(up.on_conflict_do_update(["Id"], set=lambda old, new: {"Qty": old.Qty.add(new.Qty)} | excluded("Name")).returning("Id"))
    assert sorted(r["Id"] for r in back) == [3, 4] and (all_rows(s, scratch)[3]["Qty"], all_rows(s, scratch)[3]["Name"], all_rows(s, scratch)[3]["Twice"]) == (10, "new", 20)
    assert set(excluded_all(scratch, "Id")) == {"OrgId", "Name", "Note", "Qty"}
    back = s.execute(update(scratch).set(lambda r: {"Qty": r.Qty.mul(3)}).where(lambda r: [r.OrgId.eq("b"), r.Id.eq(4)]).returning("Id", "Qty", "Note"))
    assert [tuple(r.values()) for r in back] == [(4, 6, "touched")]
    assert [r["Id"] for r in s.execute(delete_from(scratch).where(lambda r: r.Note.eq("n")).returning("Id"))] == [2] and sorted(all_rows(s, scratch)) == [1, 3, 4]
    s.execute(delete_from(scratch).all_rows())
    assert all_rows(s, scratch) == {} and s.store.vacuum(scratch) > 0


def test_write_refusals(writable):
    s, scratch = writable
    s.execute(insert_into(scratch).values({"Id": 1, "OrgId": "a"}))
    for make in (lambda: update(scratch).set({"Qty": 1}).conditions(), lambda: delete_from(scratch).where(lambda r: None).conditions(), lambda: insert_into(scratch).values({"Twice": 1}), lambda: insert_into(scratch).values({"none": 1}), lambda: s.execute(update(scratch).set({}).all_rows())):
        with pytest.raises(QueryBuilderDefect):
            make()
    for row, kind in (({"Id": 1, "OrgId": "a"}, "unique"), ({"Id": 2, "OrgId": "a", "Qty": -1}, "check"), ({"Id": 2}, "not null")):
        with pytest.raises(ConstraintError) as failure:
            s.execute(insert_into(scratch).values(row))
        assert failure.value.kind == kind
    with pytest.raises(InvalidLiteral):
        s.execute(insert_into(scratch).values({"Id": "x", "OrgId": "a"}))
    assert sorted(all_rows(s, scratch)) == [1]
    assert insert_into(scratch).values({"Id": 1, "OrgId": "a"}).tenant_scope() == "single-tenant" and update(scratch).set({"Qty": 1}).where(lambda r: r.Id.eq(1)).tenant_scope() == "cross-tenant"


def test_transactions(writable):
    s, scratch = writable
    done = []

    def work():
        s.execute(insert_into(scratch).values({"Id": 1, "OrgId": "a"}))
        s.after_commit(lambda: done.append(sorted(all_rows(s, scratch))))
        try:
            s.transaction(lambda: (s.execute(insert_into(scratch).values({"Id": 2, "OrgId": "a"})), 1 / 0))
        except ZeroDivisionError:
            pass
        s.require_transaction()
        return sorted(all_rows(s, scratch))

    assert s.transaction(work) == [1] and done == [[1]]
    with pytest.raises(ZeroDivisionError):
        s.transaction(lambda: (s.execute(insert_into(scratch).values({"Id": 3, "OrgId": "a"})), 1 / 0))
    assert sorted(all_rows(s, scratch)) == [1]
    with pytest.raises(ConstraintError):
        s.batch(insert_into(scratch).values({"Id": 4, "OrgId": "a"}), insert_into(scratch).values({"Id": 4, "OrgId": "a"}))
    assert sorted(all_rows(s, scratch)) == [1]
    other = Session(s.spark, s.root)

    def clash():
        s.execute(insert_into(scratch).values({"Id": 5, "OrgId": "a"}))
        other.execute(insert_into(scratch).values({"Id": 6 + len(all_rows(other, scratch)), "OrgId": "a"}))

    with pytest.raises(ConflictError):
        s.transaction(clash, retries=0)
    with pytest.raises(ValueError):
        s.require_transaction()
    mine = s.repository(scratch, "a")
    assert mine.find_by_id(1)["Id"] == 1 and s.repository(scratch, "b").find_by_id(1) is None
    assert mine.update(1, {"Qty": 8})[0]["Qty"] == 8 and mine.delete(1) == 1 and mine.insert({"Id": 9})[0]["OrgId"] == "a"


def test_json_tables(spark):
    each = from_(json_tables.json_each('{"a": 1, "b": [2, null], "c d": "x"}'), "j").select("key", "value", "type", "fullkey")
    assert [(r["key"], r["value"], r["type"], r["fullkey"]) for r in run(spark, each)] == [("a", "1", "integer", "$.a"), ("b", "[2,null]", "array", "$.b"), ("c d", "x", "text", '$."c d"')]
    tree = [(r["fullkey"], r["atom"], r["parent"]) for r in run(spark, from_(json_tables.json_tree('{"a": [true, {"b": 1.5}]}'), "j").select())]
    assert tree == [("$", None, None), ("$.a", None, 0), ("$.a[0]", "true", 1), ("$.a[1]", None, 1), ("$.a[1].b", "1.5", 3)]
    assert run(spark, from_(json_tables.json_each("5"), "j").select("value", "fullkey")) == [{"value": "5", "fullkey": "$"}]
    assert run(spark, from_(json_tables.json_rows([{"a": 1}, {"a": 2, "b": "x"}], {"a": t.int64, "b": t.nullable(t.string)}), "r").select()) == [{"a": 1, "b": None}, {"a": 2, "b": "x"}]


def test_full_text(spark):
    docs = spark.createDataFrame([(1, "The quick brown fox"), (2, "quick foxes and a brown dog"), (3, "nothing here"), (4, None)], "id int, body string")
    table_ = frame_table("docs", docs, {"id": t.int32, "body": t.nullable(t.string)})
    ids = lambda query: sorted(r["id"] for r in run(spark, from_(table_).select("id").where(lambda d: full_text.fts_match(d.body, query))))
    assert ids("quick brown") == [1, 2] and ids('"quick brown"') == [1] and ids("fox*") == [1, 2] and ids("quick NOT dog") == [1] and ids("fox OR dog") == [1, 2] and ids("(fox OR nothing) NOT brown") == [3]
    marked = {r["id"]: r["m"] for r in run(spark, from_(table_).select(lambda d: {"id": d.id, "m": full_text.highlight(d.body, "quick OR fox*", "[", "]")}))}
    assert marked == {1: "The [quick] brown [fox]", 2: "[quick] [foxes] and a brown dog", 3: "nothing here", 4: None}
    part = {r["id"]: r["m"] for r in run(spark, from_(table_).select(lambda d: {"id": d.id, "m": full_text.snippet(d.body, "brown", "[", "]", n=2)}))}
    assert part[1] == "...quick [brown]..." and part[3] == "nothing here"
    ranked = {r["id"]: r["rank"] for r in full_text.bm25(docs, "fox", ["body"]).collect()}
    assert list(ranked) == [1] and ranked[1] < 0
    for bad in ("(", "AND", "a NOT"):
        with pytest.raises(InvalidArguments):
            full_text.parse(bad)


# Random filters against a three-valued model in Python.
ROW = st.fixed_dictionaries({"a": st.one_of(st.none(), st.integers(-3, 3)), "b": st.one_of(st.none(), st.integers(-3, 3)), "s": st.one_of(st.none(), st.sampled_from(["", "acme", "it's", "a_b"]))})
LEAF = st.one_of(
    st.tuples(st.sampled_from(["eq", "neq", "gt", "gte", "lt", "lte"]), st.sampled_from(["a", "b"]), st.one_of(st.integers(-3, 3), st.sampled_from(["a", "b"]))), st.tuples(st.just("null"), st.sampled_from(["a", "b", "s"])), st.tuples(st.just("in"), st.just("a"), st.lists(st.integers(-3, 3), max_size=3)), st.tuples(st.just("has"), st.just("s"), st.sampled_from(["", "_", "'", "ac"]))
)
TREE = st.recursive(LEAF, lambda c: st.one_of(st.tuples(st.just("and"), c, c), st.tuples(st.just("or"), c, c), st.tuples(st.just("not"), c)), max_leaves=6)
OPS = {"eq": lambda x, y: x == y, "neq": lambda x, y: x != y, "gt": lambda x, y: x > y, "gte": lambda x, y: x >= y, "lt": lambda x, y: x < y, "lte": lambda x, y: x <= y}


def model(tree, row):
    kind = tree[0]
    if kind in OPS:
        x, y = row[tree[1]], row[tree[2]] if isinstance(tree[2], str) else tree[2]
        return None if x is None or y is None else OPS[kind](x, y)
    if kind == "null":
        return row[tree[1]] is None
    if kind == "in":
        return False if not tree[2] else None if row["a"] is None else row["a"] in tree[2]
    if kind == "has":
        return None if row["s"] is None else tree[2] in row["s"]
    if kind == "not":
        x = model(tree[1], row)
        return None if x is None else not x
    x, y = model(tree[1], row), model(tree[2], row)
    if kind == "and":
        return False if x is False or y is False else None if x is None or y is None else True
    return True if x is True or y is True else None if x is None or y is None else False


def built(tree, r):
    kind = tree[0]
    if kind in OPS:
        return getattr(r[tree[1]], kind)(r[tree[2]] if isinstance(tree[2], str) else tree[2])
    if kind == "null":
        return r[tree[1]].is_null()
    if kind == "in":
        return r.a.in_(tree[2])
    if kind == "has":
        return r.s.contains(tree[2])
    if kind == "not":
        return not_(built(tree[1], r))
    return (and_ if kind == "and" else or_)(built(tree[1], r), built(tree[2], r))


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(ROW, min_size=1, max_size=8), st.lists(TREE, min_size=1, max_size=4))
def test_random_filters(spark, rows, trees):
    df = spark.createDataFrame([(k, r["a"], r["b"], r["s"]) for k, r in enumerate(rows)], "k int, a int, b int, s string")
    table_ = frame_table("r", df, {"k": t.int32, "a": t.nullable(t.int32), "b": t.nullable(t.int32), "s": t.nullable(t.string)})
    q = from_(table_).select(lambda r: {"k": r.k} | {f"t{i}": pg.as_boolean(built(tree, r)) for i, tree in enumerate(trees)})
    for got in compile_query(q, spark).df.collect():
        for i, tree in enumerate(trees):
            assert got[f"t{i}"] == model(tree, rows[got["k"]]), tree


def test_grouped_values_follow_a_model(spark, db):
    q = from_(db.orders, "o").select(lambda o: {"org": o.OrgId, "n": olap.count(), "s": olap.sum(o.Amount), "a": sqlite.round_(olap.avg(o.Amount), 4)}).group_by("org").order_by("org").cross_tenant()
    assert [tuple(r.values()) for r in run(spark, q)] == [("org_1", 4, 42, 10.5), ("org_2", 1, 99, 99.0)]


def test_full_text_table_and_raw_queries(spark, db):
    docs = frame_table("d", spark.createDataFrame([(1, "red fox", "a dog"), (2, "blue", None)], "id int, head string, body string"), {"id": t.int32, "head": t.string, "body": t.nullable(t.string)})
    fts = full_text.full_text_table(docs, "head", "body")
    assert run(spark, from_(docs).select(lambda d: {"id": d.id, "h": fts.highlight(d, "body", "dog", "[", "]")}).where(lambda d: fts.match(d, "fox dog"))) == [{"id": 1, "h": "a [dog]"}]
    assert [r["id"] for r in fts.ranked(docs.source(spark), "blue", [2.0, 1.0]).collect()] == [2]
    with pytest.raises(QueryBuilderDefect):
        full_text.full_text_table(docs, "none")
    lines = compile_query(from_(db.orders, "o").select("Id", "Note").where(lambda o: o.Id.lt(3)).order_by("Id").format("JSONEachRow"), spark)
    assert lines.format == "JSONEachRow" and [r["value"] for r in lines.json_lines().collect()] == ['{"Id":1,"Note":"rush"}', '{"Id":2,"Note":null}']
    from larkspur.plans.lower import raw_compiled_query

    raw = raw_compiled_query(spark, "SELECT :a AS a", {"a": t.int32}, "a test", params={"a": 1})
    assert raw.decode_rows(raw.df.collect()) == [{"a": 1}]
    with pytest.raises(QueryBuilderDefect):
        raw_compiled_query(spark, "SELECT 1", {}, " ")


def test_upserts_prove_their_tenant():
    own = table("own", {"Id": t.int32, "Org": t.string}, tenant="Org")
    row = insert_into(own).values({"Id": 1, "Org": "a"})
    assert row.on_conflict_do_update(["Id"], set={"Id": 1}).tenant_scope() == "cross-tenant" and row.on_conflict_do_update(["Id", "Org"], set={"Id": 1}).tenant_scope() == "single-tenant"
    with pytest.raises(QueryBuilderDefect):
        Session(None).transaction(lambda: None, isolation="serializable")
