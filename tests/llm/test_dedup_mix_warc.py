import collections
import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from larkspur.llm import exact_dedup, mixing, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept int"


def frame(spark, rows):
    return spark.createDataFrame([(a, b, "en", "s", 1, 0) for a, b in rows], DOCS).repartition(3)


LONG = "Some words here and there. " * 3000
ROWS = [(1, "Hello"), (5, "hELLO"), (2, "hello "), (3, None), (4, ""), (7, "É"), (8, "é"), (9, LONG), (10, LONG.upper()), (11, LONG + "x"), (None, "Hello"), (1, "Hello"), (12, "a" * 20000), (13, "A" * 20000), (14, "a" * 20001)]


def test_exact_dedup_equals_brute_force(spark):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    groups = collections.defaultdict(list)
    for key, text in ROWS:
        groups[(text or "").translate(lower)].append(key)
    want = []
    for key, text in ROWS:
        norm = (text or "").translate(lower)
        best = max((k for k in groups[norm] if k is not None), default=None)
        want.append((key, best, len(groups[norm]), key == best, hashlib.sha256(norm.encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup.exact_dedup(frame(spark, ROWS)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_chunks_join_to_the_text_and_meet_again(spark):
    df = frame(spark, [(1, LONG), (2, "Inserted at the front! " + LONG)])
    cut = [r["c"] for r in df.select(exact_dedup.chunks(exact_dedup.normalised(F.col("text"))).alias("c")).collect()]
    assert sorted("".join(c) for c in cut) == sorted([LONG.lower(), "inserted at the front! " + LONG.lower()])
    assert all(len(x) <= exact_dedup.MAX_CHUNK + 1 for c in cut for x in c)
    store = exact_dedup.chunk_store(exact_dedup.recipes(df)).collect()
    assert all(r["verified"] for r in store)


def test_drop_exact_keeps_columns_and_one_of_each(spark):
    df = frame(spark, [r for r in ROWS if r[0] is not None])
    out = exact_dedup.drop_exact(df)
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == [2, 4, 5, 7, 8, 10, 11, 13, 14]
    assert exact_dedup.drop_exact(df.limit(0)).collect() == []


def test_raking_meets_the_marginals(spark):
    cells = spark.createDataFrame([("a", "x", "t", 100.0), ("a", "y", "t", 300.0), ("b", "x", "u", 500.0), ("b", "y", "t", 50.0), ("c", "x", "u", 0.0)], "source string, lang string, topic string, tokens double")
    targets = {"source": {"a": 3.0, "b": 1.0, "none": 9.0, "c": 0.0}, "lang": {"x": 0.5, "y": 0.5}}
    # A small budget: there is enough of every cell.
    got = mixing.rake(cells, ("source", "lang"), targets, sweeps=60, budget=0.05).collect()
    sums = lambda d: {k: sum(r["raked"] for r in got if r[d] == k) for k in {r[d] for r in got}}
    assert abs(sum(r["raked"] for r in got) - 1) < 1e-9
    assert abs(sums("source")["a"] - 0.75) < 0.02 and abs(sums("lang")["x"] - 0.5) < 0.02


def test_cells_that_give_all_they_have_leave_the_marginals_to_the_others(spark):
    cells = spark.createDataFrame([("a", "x", "", 5.0), ("a", "y", "", 495.0), ("b", "x", "", 300.0), ("b", "y", "", 200.0)], "source string, lang string, topic string, tokens double")
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.4, "y": 0.6}}
    raked = mixing.rake(cells, ("source", "lang"), targets, sweeps=60, budget=0.7)
    got = {(r["source"], r["lang"]): r["raked"] for r in raked.collect()}
    assert abs(got[("a", "x")] - 0.005 / 0.7) < 1e-9  # all of it
    assert all(abs(r["target"] - r["reached"]) < 1e-6 for r in mixing.reached(raked, ("source", "lang")).collect())


def test_many_cells_are_raked_alike_by_joins(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    few = {r["doc_id"]: r["probability"] for r in mixing.mix(df, sweeps=2).collect()}
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", 1)
    many = {r["doc_id"]: r["probability"] for r in mixing.mix(df, sweeps=2).collect()}
    assert few.keys() == many.keys() and all(abs(few[k] - many[k]) < 1e-8 for k in few)


def test_the_shipped_marginals_are_met(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    seen = mixing.mix(df).groupBy(*mixing.DIMS).agg(F.sum("n_tokens").alias("tokens"))
    gaps = [abs(r["target"] - r["reached"]) for r in mixing.reached(mixing.rake(seen)).collect()]
    assert max(gaps) < 0.002


def test_raking_equals_a_plain_loop(spark):
    rows = [(s, lang, p, float((3 * i + 7 * j + 5 * k) % 11 + 1)) for i, s in enumerate("abc") for j, lang in enumerate("xy") for k, p in enumerate("tu")]
    w = {r[:3]: r[3] for r in rows}
    total = sum(w.values())
    w = {k: v / total for k, v in w.items()}
    most, want = {k: v / mixing.BUDGET for k, v in w.items()}, []
    for axis, d in enumerate(mixing.DIMS):
        share = collections.Counter()
        for k, v in w.items():
            share[k[axis]] += v
        t = {k: v ** mixing.TEMPER[d] for k, v in share.items()}
        want.append({k: v / sum(t.values()) for k, v in t.items()})
    for _ in range(mixing.SWEEPS):
        for axis in range(3):
            share = collections.Counter()
            for k, v in w.items():
                share[k[axis]] += v
            w = {k: min(most[k], v * want[axis][k[axis]] / share[k[axis]]) for k, v in w.items()}
    got = mixing.rake(spark.createDataFrame(rows, "source string, lang string, topic string, tokens double")).collect()
    assert all(abs(r["raked"] - w[(r["source"], r["lang"], r["topic"])]) < 1e-12 for r in got)


def test_mix_handles_nulls_and_is_stable(spark):
    rows = [(k, "word " * (k % 7), "en" if k % 3 else None, f"s{k % 4}" if k % 5 else None, 1, 0) for k in range(400)] + [(None, None, None, None, None, 0), (3, "x @ y", "en", "s1", 1, 0)]
    df = spark.createDataFrame(rows, DOCS)
    one = sorted(map(str, mixing.mix(df).collect()))
    assert one == sorted(map(str, mixing.mix(df.repartition(5)).collect())) and len(one) == len(rows)
    kept = mixing.sample_mix(df)
    assert kept.columns == df.columns and 0 < kept.count() < len(rows)
    assert mixing.mix(df.limit(0)).collect() == []


def test_sampled_share_follows_the_budget(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") % 4 == 0, "small").otherwise("big").alias("source"), F.lit("en").alias("lang"))
    got = mixing.mix(df, targets={"source": {"small": 0.5, "big": 0.5}}, budget=0.4).groupBy("source").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    by = {r["source"]: r["kept"] for r in got}
    assert abs(by["small"] - 0.8) < 0.06 and abs(by["big"] - 0.8 / 3) < 0.04


RECORDS = "record_id long, url string, date timestamp_ntz, kind string, headers map<string,string>, html string"


def records(spark, rows):
    import datetime as dt

    return spark.createDataFrame([(a, u, None if s is None else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), k, h, "x") for a, u, s, k, h in rows], RECORDS)


@pytest.mark.parametrize("spans", [1, 3, 64])
def test_revisits(spark, spans):
    rows = [
        (1, "http://WWW.Example.com:80/a/?utm_source=x#top", 0, "response", {"etag": '"1"', "content-type": "text/html", "date": "d0"}), (2, "https://example.com/a", 10, "response", {"etag": '"2"', "content-type": "text/html"}),
        (3, "http://example.com/a/", 5, "revisit", {"etag": 'W/"1"', "date": "d5", "content-type": "bad"}), (4, "http://example.com/a", 10, "revisit", {"etag": '"2"'}), (5, "http://example.com/a", 10, "revisit", {"etag": '"9"'}),
        (6, "http://example.com/a", 100, "revisit", None), (7, "http://example.com/b", 100, "revisit", {"etag": '"1"'}), (8, None, 100, "revisit", {}), (9, "http://example.com/a", None, "revisit", {}), (0, "http://example.com/a", 0, "revisit", {"etag": '"1"'}), (10, "http://example.com/a", 3, "request", {}),
    ]
    got = {r["record_id"]: r for r in warc.resolve(records(spark, rows), spans).collect()}
    assert {k: (r["response_id"], r["status"]) for k, r in got.items()} == {3: (1, "resolved"), 4: (2, "resolved"), 5: (2, "mismatch"), 6: (2, "unvalidated"), 7: (None, "unresolved"), 8: (None, "unresolved"), 9: (None, "unresolved"), 0: (None, "unresolved")}
    assert got[3]["headers"] == {"etag": 'W/"1"', "date": "d5", "content-type": "text/html"} and got[3]["age_s"] == 5 and got[5]["headers"] == {"etag": '"9"'}
    assert warc.resolve(records(spark, []), spans).collect() == []


def test_many_revisits_equal_brute_force(spark):
    import random

    rng = random.Random(1)
    rows = [(k, f"http://h/{rng.choice('aaab')}", rng.randint(0, 500), rng.choice(["response", "revisit"]), {"etag": "1"}) for k in range(400)]
    want = {}
    for key, url, at, kind, _ in rows:
        if kind == "revisit":
            before = [(a, k) for k, u, a, kk, _ in rows if kk == "response" and u == url and (a, k) < (at, key)]
            want[key] = max(before)[1] if before else None
    got = {r["record_id"]: r["response_id"] for r in warc.resolve(records(spark, rows), 7).collect()}
    assert got == want


def test_warc_files_round_trip():
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX-Long: a\r\n b\r\n\r\n<p>body</p>"
    data = warc.write_record("response", {"WARC-Target-URI": "http://a/", "Content-Type": "application/http;msgtype=response"}, http) + warc.write_record("warcinfo", {}, b"hello")
    found = warc.read_warc(data)
    assert [r["kind"] for r in found] == ["response", "warcinfo"] and found[0]["body"] == b"<p>body</p>" and found[0]["headers"] == {":status": "HTTP/1.1 200 OK", "content-type": "text/html", "x-long": "a b"} and found[1]["body"] == b"hello"
    assert warc.read_warc(b"") == [] and warc.read_warc(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc") == []


def test_files_resolve(spark):
    http = lambda status, tag: f"HTTP/1.1 {status}\r\nETag: {tag}\r\n\r\n".encode()
    fields = lambda k, s: {"WARC-Record-ID": f"<urn:{k}>", "WARC-Target-URI": "http://a/x", "WARC-Date": f"2024-01-01T00:00:0{s}Z", "Content-Type": "application/http"}
    data = warc.write_record("response", fields(1, 1), http(200, '"1"') + b"body") + warc.write_record("revisit", fields(2, 5), http(304, '"1"'))
    made = warc.records_of_files(spark.createDataFrame([(data,), (None,), (b"junk",)], "content binary"))
    assert sorted((r["kind"], bytes(r["body"])) for r in made.collect()) == [("response", b"body"), ("revisit", b"")]
    got = warc.resolve(made).collect()
    assert [(r["status"], r["age_s"]) for r in got] == [("resolved", 4)]


@pytest.mark.parametrize("op", [exact_dedup, mixing, warc])
def test_sql_gives_the_same_rows(spark, op):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    df = {exact_dedup: exact_dedup.op8_exact_dedup, mixing: mixing.op4_mix_sources, warc: warc.op6_warc_revisits}[op](spark, sf)
    got = df.select(*sorted(df.columns)).collect()
    sql = con.execute(f"SELECT {', '.join(sorted(df.columns))} FROM ({op.ORACLE})").fetchall()
    plain = lambda rows: sorted(str(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)
    assert plain(got) == plain(sql)
