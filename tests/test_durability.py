"""What outlives a restart or a crash, and who may do what afterwards."""

import pytest

from fathomline import ast
from fathomline.errors import CommandError
from fathomline.session import Engine

BUY = 'DEFINE buy FIELDS {user: "int", made: "datetime", note: "string | null"}'


@pytest.fixture
def engine(spark, tmp_path):
    out = Engine(spark, f"file://{tmp_path}/log")
    out.execute(BUY)
    return out


def put(engine, user, made=None, now=100):
    return engine.log.append("buy", f"c{user}", {"user": user, "made": 1 if made is None else made}, now=now)


def users(frame):
    return sorted(r["user"] for r in frame.collect())


def test_stored_events_outlive_a_restart(engine, spark):
    put(engine, 1)
    engine.execute("FLUSH")
    ids = [put(engine, 2), put(engine, 3)]
    again = Engine(spark, engine.log.store_files.root)
    assert users(again.execute("QUERY buy")) == [1, 2, 3]
    assert put(again, 4) > max(ids)
    again.execute("FLUSH")
    assert users(Engine(spark, engine.log.store_files.root).execute("QUERY buy")) == [1, 2, 3, 4]


def test_a_flush_that_is_repeated_writes_once(engine, spark):
    put(engine, 1)
    held = Engine(spark, engine.log.store_files.root)  # holds the event too, as if the first had died
    engine.execute("FLUSH")
    held.execute("FLUSH")
    assert users(held.execute("QUERY buy")) == [1]


def test_a_compaction_that_lost_its_last_step(engine):
    for u in (1, 2):
        put(engine, u)
        engine.execute("FLUSH")
    engine.log.compact("buy", 2)
    engine.log.store_files.rename("events/buy", "events/buy.new")
    assert users(engine.execute("QUERY buy")) == [1, 2]


def test_a_small_file_that_lost_its_last_step(engine):
    files = engine.log.store_files
    files.write("x.json", "1")
    files.rename("x.json", "x.json.new")
    assert files.read("x.json") == "1"


def test_show_takes_each_row_once_whatever_it_returns(engine):
    for u in (1, 2):
        put(engine, u, made=10 * u)
    engine.execute("REMEMBER QUERY buy USING made RETURN [user] AS held")
    put(engine, 3, made=30)
    for _ in range(3):
        got = engine.execute("SHOW held")
        assert users(got) == [1, 2, 3] and "made" not in got.columns


def test_a_query_remembered_by_its_ast(engine, spark):
    put(engine, 1)
    engine.execute(ast.Remember(ast.Query("buy", where=ast.Or(ast.In("user", (1, 2)), ast.Compare("user", "=", 5))), "held"))
    put(engine, 2)
    put(engine, 3)
    engine.execute("FLUSH")
    assert users(Engine(spark, engine.log.store_files.root).execute("SHOW held")) == [1, 2]


def test_many_parts_become_one(engine, monkeypatch):
    from fathomline.operators import materialize

    monkeypatch.setattr(materialize, "MOST_PARTS", 2)
    put(engine, 0)
    engine.execute("REMEMBER QUERY buy AS held")
    for u in range(1, 5):
        put(engine, u, now=100 + u)
        assert users(engine.execute("SHOW held")) == list(range(u + 1))
    assert len(engine.materialized.entries["held"]["parts"]) <= 2


def test_a_revoked_admin_is_none(engine):
    engine.execute('CREATE USER boss WITH ROLES ["admin"]')
    engine.execute("LIST USERS", "boss")
    engine.execute("REVOKE KEY boss")
    with pytest.raises(CommandError):
        engine.execute("LIST USERS", "boss")


def test_groups_before_vs_hold(engine):
    put(engine, 1)
    got = engine.execute("PLOT count OF buy BREAKDOWN BY user VS count OF buy")
    assert got.columns == ["user", "buy.count", "right.count"]
