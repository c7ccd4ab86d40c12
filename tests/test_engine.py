import json

import pytest
from pyspark.sql import functions as F

from fathomline import output
from fathomline.api import Events, field
from fathomline.errors import CommandError
from fathomline.operators.materialize import Retention
from fathomline.session import Engine
from fathomline.streaming.ingest import ingest


@pytest.fixture()
def engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/log")
    e.execute('DEFINE visit FIELDS {user: "int", page: "string", made: "datetime", score: "float | null"}')
    e.execute('DEFINE buy FIELDS {user: "int", status: ["open", "done"], amount: "int", made: "datetime"}')
    rows = [(1, "a", "2024-01-01", 1.5), (1, "b", "2024-01-02", None), (2, "a", "2024-01-02", 2.0), (3, "a", "2024-02-01", -1.0), (1, "a", "2024-01-03", 4.0)]
    for n, (u, p, d, s) in enumerate(rows):
        e.log.append("visit", f"c{u}", {"user": u, "page": p, "made": d, "score": s}, now=100 + n)
    for n, (u, s, a, d) in enumerate([(1, "open", 10, "2024-01-02"), (2, "done", 5, "2024-01-01"), (3, "done", 7, "2024-02-01"), (1, "done", 2, "2024-01-05")]):
        e.log.append("buy", f"c{u}", {"user": u, "status": s, "amount": a, "made": d}, now=200 + n)
    return e


def rows(frame, *columns):
    return [tuple(r[c] for c in columns) for r in frame.collect()]


def test_store_is_seen_before_and_after_flush(engine):
    assert engine.execute("QUERY visit COUNT").first()["count"] == 5
    assert engine.execute("FLUSH") == "9 events written"
    engine.execute('STORE visit FOR c9 PAYLOAD {"user": 9, "page": "z", "made": 1704067200000}')
    assert engine.execute("QUERY visit COUNT").first()["count"] == 6
    assert rows(engine.execute("QUERY visit WHERE user = 9"), "context_id", "made", "score") == [("c9", 1704067200, None)]
    engine.execute("FLUSH")
    again = Engine(engine.log.spark, engine.log.store_files.root)
    assert again.execute("QUERY visit COUNT").first()["count"] == 6
    again.log.compact("visit", 1)
    assert again.execute("QUERY visit COUNT").first()["count"] == 6


@pytest.mark.parametrize(
    "payload",
    ['{"user": 1, "page": "x"}', '{"user": 1, "page": "x", "made": 1, "extra": 1}', '{"user": "1", "page": "x", "made": 1}', '{"user": 1, "page": null, "made": 1}', '{"user": 1, "page": "x", "made": "soon"}', '{"user": true, "page": "x", "made": 1}'],
)
def test_store_checks(engine, payload):
    with pytest.raises(CommandError):
        engine.execute(f"STORE visit FOR c PAYLOAD {payload}")


def test_definitions(engine):
    for bad in ('DEFINE visit FIELDS {a: "int"}', 'DEFINE 1x FIELDS {a: "int"}', "DEFINE fresh FIELDS {}", 'DEFINE fresh FIELDS {a: ["x", "x"]}'):
        with pytest.raises(CommandError):
            engine.execute(bad)
    with pytest.raises(CommandError):
        engine.execute('STORE buy FOR c PAYLOAD {"user": 1, "status": "gone", "amount": 1, "made": 1}')
    with pytest.raises(CommandError) as e:
        engine.execute("QUERY nothing")
    assert e.value.status == 404


def test_predicates(engine):
    ask = lambda where: {r["event_id"] for r in engine.execute(f"QUERY visit WHERE {where}").collect()}
    every = ask("user > 0")
    assert len(ask("score > 1")) == 3 and len(ask("NOT score > 1")) == 2  # a null is not above 1
    assert len(ask("score != 2")) == 3  # and not unlike 2
    assert len(ask("score >= -1.0")) == 4 and ask("user > -1") == every
    assert len(ask('made >= "2024-01-02" AND made < "2024-02-01"')) == 3
    assert ask('page > "a"') == set() and ask("nothing = 1") == set() and ask("NOT nothing = 1") == every
    assert ask("user IN ()") == set() and len(ask('page IN ("b", "q") OR user IN (3, "2")')) == 3


def test_order_offset_limit(engine):
    assert rows(engine.execute("QUERY visit ORDER BY timestamp DESC LIMIT 2 OFFSET 1"), "timestamp") == [(103,), (102,)]
    assert engine.execute("QUERY visit ORDER BY made LIMIT 3 OFFSET 9").count() == 0
    for bad in ("QUERY visit OFFSET 1", "QUERY visit ORDER BY nothing", "QUERY visit COUNT BY nothing", "QUERY visit COUNT BY user ORDER BY nothing"):
        with pytest.raises(CommandError):
            engine.execute(bad)
    assert engine.execute("QUERY visit RETURN [page, nothing]").columns == ["context_id", "event_type", "timestamp", "event_id", "page"]


def test_aggregates(engine):
    got = engine.execute("QUERY visit COUNT, COUNT score, COUNT UNIQUE score, TOTAL score, AVG score, MIN score, MAX page BY page ORDER BY count DESC").collect()
    assert [tuple(r) for r in got] == [("a", 4, 4, 4, 6.5, 1.625, -1.0, "a"), ("b", 1, 0, 1, 0.0, 0.0, None, "b")]
    assert rows(engine.execute("QUERY buy TOTAL amount, AVG amount"), "total_amount", "avg_amount") == [(24, 6.0)]
    assert engine.execute("QUERY buy WHERE amount > 99 COUNT, TOTAL amount").count() == 0
    assert engine.execute("QUERY visit COUNT UNIQUE nothing").first()[0] == 1
    assert rows(engine.execute("QUERY visit COUNT PER MONTH USING made BY page"), "bucket", "page", "count") == [(1704067200, "a", 3), (1704067200, "b", 1), (1706745600, "a", 1)]
    assert rows(engine.execute("QUERY visit COUNT BY user LIMIT 1 OFFSET 1"), "user", "count") == [("2", 1)]


def brute(a, b, followed):
    out = []
    for x in a:
        near = [y for y in b if y[0] == x[0] and (y[1] >= x[1] if followed else y[1] < x[1])]
        if near:
            out.append((x, min(near, key=lambda y: (y[1], y[2])) if followed else max(near, key=lambda y: (y[1], y[2]))))
    return sorted(out)


@pytest.mark.parametrize("slice_seconds", [None, 86_400, 10**7])
@pytest.mark.parametrize("followed", [True, False])
def test_sequences(engine, followed, slice_seconds):
    engine.slice_seconds = slice_seconds
    word = "FOLLOWED" if followed else "PRECEDED"
    frame = engine.execute(f"QUERY visit {word} BY buy LINKED BY user USING TIME made")
    key = lambda frame: [(r["user"], r["made"], r["event_id"]) for r in frame.collect()]
    want = brute(key(engine.execute("QUERY visit")), key(engine.execute("QUERY buy")), followed)
    got = {}
    for r in frame.collect():
        got.setdefault(r["match"], {})[r["event_type"]] = (r["user"], r["made"], r["event_id"])
        assert r["place"] == (r["event_type"] == "buy") * followed + (r["event_type"] == "visit") * (not followed)
    assert sorted((m["visit"], m["buy"]) for m in got.values()) == want and want


def test_sequence_conditions(engine):
    n = lambda text: engine.execute(text).count()
    base = "QUERY visit FOLLOWED BY buy LINKED BY user USING TIME made"
    assert n(f'{base} WHERE visit.page = "b"') == 2 and n(f'{base} WHERE buy.status = "done"') == 2 * 4 and n(f"{base} LIMIT 2") == 4
    assert n(f'{base} WHERE status = "done"') == 0  # asked of both types, and visits have no status
    for bad in (f"{base} WHERE user = 1", "QUERY visit FOLLOWED BY buy", "QUERY visit FOLLOWED BY buy FOLLOWED BY visit LINKED BY user", f"{base} COUNT"):
        with pytest.raises(CommandError):
            engine.execute(bad)
    assert n("QUERY visit FOLLOWED BY visit LINKED BY user USING TIME made") == 10  # at equal times a row meets itself


def test_compare(engine):
    got = engine.execute("PLOT count OF visit VS count OF buy BREAKDOWN BY user OVER month(made)")
    assert got.columns == ["bucket", "user", "visit.count", "buy.count"]
    assert [tuple(r) for r in got.collect()] == [(1704067200, "1", 3, 2), (1704067200, "2", 1, 1), (1706745600, "3", 1, 1)]
    got = engine.execute('PLOT avg(amount) OF buy FILTER status = "done" VS avg(amount) OF buy FILTER status = "open" BREAKDOWN BY user')
    assert got.columns == ["user", "buy.avg_amount", "right.avg_amount"] and tuple(got.first()) == ("1", 2.0, 10.0)
    assert got.where("`right.avg_amount` is null").count() == 2
    assert [tuple(r) for r in engine.execute("PLOT total(amount) OF buy BREAKDOWN BY user TOP 2").collect()] == [("1", 12), ("3", 7)]


def test_replay(engine):
    got = engine.execute("REPLAY FOR c1").collect()
    assert [r["timestamp"] for r in got] == [100, 101, 104, 200, 203] and got[0]["amount"] is None and got[-1]["amount"] == 2
    assert engine.execute('REPLAY buy FOR c1 SINCE "201"').count() == 1


def test_remember_and_show(engine):
    engine.execute("REMEMBER QUERY visit WHERE page = a AS pages")
    engine.execute("REMEMBER QUERY visit COUNT BY page AS counts")
    with pytest.raises(CommandError):
        engine.execute("REMEMBER QUERY visit AS pages")
    with pytest.raises(CommandError):
        engine.execute("SHOW nothing")
    assert engine.execute("SHOW pages").count() == 4
    engine.log.append("visit", "c4", {"user": 4, "page": "a", "made": 1}, now=104)  # the mark's own second, a later id
    engine.log.append("visit", "c4", {"user": 4, "page": "a", "made": 1}, now=150)
    engine.log.append("visit", "c4", {"user": 4, "page": "a", "made": 1}, now=50)  # too late for the mark
    assert engine.execute("SHOW pages").count() == 6 and engine.execute("SHOW pages").count() == 6
    assert rows(engine.execute("SHOW counts"), "page", "count") == [("a", 7), ("b", 1)]
    again = Engine(engine.log.spark, engine.log.store_files.root)
    assert again.execute("SHOW pages").count() == 6
    assert again.materialized.retain("pages", Retention(max_rows=3)) == 1 and again.materialized.stored("pages").count() == 2
    assert again.materialized.retain("pages", Retention(max_age_s=10), now=1000) == 1 and again.materialized.stored("pages").count() == 0


def test_access(engine):
    engine.execute('CREATE USER boss WITH KEY k WITH ROLES ["admin"]')
    engine.execute('CREATE USER ed WITH ROLES ["viewer"]')
    engine.execute("CREATE USER plain")
    engine.execute("GRANT WRITE ON buy TO ed")
    engine.execute("GRANT READ ON visit TO plain")
    put = 'STORE buy FOR c PAYLOAD {"user": 1, "status": "open", "amount": 1, "made": 1}'
    assert engine.execute("QUERY buy", "ed").count() == 4  # reads by its role
    engine.execute(put, "ed")
    for bad, who in ((put, "plain"), ("QUERY buy", "plain"), ("PLOT count OF visit VS count OF buy", "plain"), ('DEFINE x FIELDS {a: "int"}', "ed"), ("LIST USERS", "ed"), ("REPLAY FOR c1", "plain")):
        with pytest.raises(CommandError) as e:
            engine.execute(bad, who)
        assert e.value.status == 403
    engine.execute("REVOKE READ, WRITE ON buy FROM ed")
    with pytest.raises(CommandError):
        engine.execute("QUERY buy", "ed")  # an entry without either denies
    assert engine.execute("SHOW PERMISSIONS FOR plain") == ["visit: read"] and engine.execute("LIST USERS", "boss") == ["boss: active", "ed: active", "plain: active"]
    engine.execute("REVOKE KEY boss")
    with pytest.raises(CommandError):
        engine.execute("QUERY buy", "boss")


def test_batch_json_and_fluent(engine):
    got = engine.execute("BATCH [PING; QUERY visit COUNT]")
    assert got[0] == "PONG" and got[1].first()["count"] == 5
    assert engine.execute({"type": "Query", "event_type": "buy", "where": {"field": "amount", "op": "gt", "value": 5}}).count() == 2
    api = Events(engine)
    assert api.query("visit").where((field("page") == "a") & ~(field("user") > 1)).count().frame().first()["count"] == 2
    assert api.query("visit").followed_by("buy", "user", "made").limit(1).frame().count() == 2
    assert api.query("buy").count().by("user").versus(api.query("visit").count().by("user")).columns == ["user", "buy.count", "visit.count"]
    assert api.replay("c2").count() == 2


def test_outputs(engine):
    frame = engine.execute("QUERY buy ORDER BY amount RETURN [amount]")
    got = [json.loads(x) for x in output.json_frames(frame, batch=3)]
    assert [g["type"] for g in got] == ["schema", "batch", "batch", "end"] and got[-1]["row_count"] == 4
    import pyarrow as pa

    assert pa.ipc.open_stream(output.arrow_stream(frame)).read_all().column("amount").to_pylist() == [2, 5, 7, 10]
    assert len(list(output.lines(frame))) == 5


def test_snapshot(engine, tmp_path):
    engine.log.flush()
    engine.log.snapshot(["visit", "buy"], f"file://{tmp_path}/snap")
    other = Engine(engine.log.spark, f"file://{tmp_path}/other")
    other.execute('DEFINE buy FIELDS {user: "int", status: ["open", "done"], amount: "int", made: "datetime"}')
    assert other.log.restore(f"file://{tmp_path}/snap") == 4
    assert {tuple(r) for r in other.execute("QUERY buy").collect()} == {tuple(r) for r in engine.execute("QUERY buy").collect()}


def test_ids_ascend(engine):
    ids = [engine.log.next_id(1_700_000_000_000) for _ in range(5000)]
    assert ids == sorted(set(ids)) and (ids[0] >> 22) + 1_609_459_200_000 >= 1_700_000_000_000


def test_streaming_ingest(engine, spark, tmp_path):
    lines = [
        {"context_id": "s1", "payload": {"user": 7, "status": "open", "amount": 3, "made": "2024-03-01"}}, {"context_id": "s1", "payload": {"user": 7, "status": "lost", "amount": 3, "made": 1}},
        {"context_id": "s2", "payload": {"user": 8, "status": "done", "amount": 4, "made": 1704067200000}}, {"context_id": "s2", "payload": {"user": 8, "status": "done", "amount": 4, "made": 1, "more": 1}}, {"payload": {}},
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    ask = lambda: spark.readStream.text(f"file://{tmp_path}/in")
    for _ in range(2):  # the second start finds nothing new
        ingest(ask(), engine.log, "buy", f"file://{tmp_path}/check", rejected=f"file://{tmp_path}/bad").awaitTermination()
    engine.log.flush()
    got = engine.execute("QUERY buy WHERE user > 6").orderBy("user")
    assert rows(got, "context_id", "amount", "made") == [("s1", 3, 1709251200), ("s2", 4, 1704067200)]
    assert spark.read.json(f"file://{tmp_path}/bad").count() == 4


def test_plans_push_down(engine):
    engine.log.flush()
    frame = engine.execute('QUERY buy FOR c1 WHERE amount > 3 RETURN [amount]')
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThan(amount,3)" in plan and "EqualTo(context_id,c1)" in plan and "status" not in plan.split("ReadSchema")[1]
    seq = engine.execute("QUERY visit FOLLOWED BY buy LINKED BY user")._jdf.queryExecution().executedPlan().toString()
    assert seq.count("Exchange hashpartitioning(link") <= 2 and "Join" not in seq
    assert engine.log.wildcard().groupBy("event_type").agg(F.count("*")).count() == 2
