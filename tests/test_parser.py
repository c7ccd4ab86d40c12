import pytest

from fathomline import ast
from fathomline.errors import CommandError, ParseError
from fathomline.json_commands import command_of
from fathomline.parser import parse


def test_query_clauses_in_any_order_and_last_one_counts():
    a = parse('QUERY orders LIMIT 9 WHERE a = 1 FOR "c 1" LIMIT 5 OFFSET 2 SINCE "2024-01-01" USING made RETURN [x, "y"] ORDER BY x DESC')
    assert a == ast.Query("orders", "c 1", "2024-01-01", "made", returns=("x", "y"), where=ast.Compare("a", "=", 1), limit=5, offset=2, order=ast.Order("x", True))
    assert parse("find orders since 12").since == 12


def test_precedence():
    got = parse("QUERY t WHERE a=1 OR b=2 AND NOT (c=3 OR d)").where
    assert got == ast.Or(ast.Compare("a", "=", 1), ast.And(ast.Compare("b", "=", 2), ast.Not(ast.Or(ast.Compare("c", "=", 3), ast.Compare("d", "=", True)))))


@pytest.mark.parametrize("text,value", [("x = -2", -2), ("x = 2.5", 2.5), ('x = "a b"', "a b"), ("x = word", "word")])
def test_values(text, value):
    assert parse(f"QUERY t WHERE {text}").where.value == value


def test_metrics_and_groups():
    q = parse("QUERY t COUNT, COUNT UNIQUE u, COUNT f, TOTAL x, AVG x, MIN x, MAX x PER week USING made BY a, b")
    assert [m.name for m in q.aggs] == ["count", "count_unique_u", "count_f", "total_x", "avg_x", "min_x", "max_x"]
    assert q.bucket == ast.Bucket("week", "made") and q.by == ("a", "b")
    assert parse("QUERY t COUNT BY a").aggs == (ast.Agg("count"),)


def test_sequences():
    q = parse("QUERY a FOLLOWED BY b LINKED BY user USING TIME made WHERE a.x = 1")
    assert q.links == (ast.Link(True, "b"),) and q.linked_by == "user" and q.using_time == "made"
    assert not parse("QUERY a PRECEDED BY b LINKED BY user").links[0].followed


def test_plot():
    q = parse('PLOT sum(x) OF t FILTER a = 1 FILTER b = 2 BREAKDOWN BY r OVER month(made) TOP 3 BY avg(y)')
    assert q.aggs == (ast.Agg("total", "x"), ast.Agg("avg", "y")) and q.order == ast.Order("avg_y", True) and q.limit == 3
    assert isinstance(q.where, ast.And) and q.bucket == ast.Bucket("month", "made")
    c = parse("PLOT count OF a FILTER x = 1 VS count OF b VS count OF a BREAKDOWN BY r")
    assert [s.event_type for s in c.sides] == ["a", "b", "a"] and all(s.by == ("r",) for s in c.sides) and c.sides[0].where and not c.sides[1].where
    with pytest.raises(ParseError):
        parse("PLOT count OF a VS total(x) OF b")
    with pytest.raises(ParseError):
        parse("PLOT count OF a -> b")


def test_other_commands():
    assert parse('DEFINE t AS 2 FIELDS {a: "int", "e": ["x", "y"]}').fields == {"a": "int", "e": ["x", "y"]}
    s = parse('STORE t FOR c PAYLOAD {a: 1, "b": "x: {y}", "l": [1, 2]}')
    assert s.payload == {"a": 1, "b": "x: {y}", "l": "[1, 2]"}
    assert parse("REPLAY FOR c") == ast.Replay("c") and parse("REPLAY t FOR c SINCE \"5\" RETURN [a]").event_type == "t"
    assert parse("REMEMBER QUERY t WHERE a = 1 AS my-view").name == "my-view"
    assert [type(c) for c in parse('BATCH [PING; STORE t FOR c PAYLOAD {"a": ";"}; FLUSH]').commands] == [ast.Ping, ast.Store, ast.Flush]
    assert parse('CREATE USER "a-b" WITH ROLES ["admin"] WITH KEY k') == ast.CreateUser("a-b", "k", ("admin",))
    assert parse("GRANT READ, WRITE ON a, b TO u") == ast.Grant("u", ("a", "b"), ("read", "write"))
    assert parse("REVOKE ON a FROM u") == ast.Revoke("u", ("a",)) and parse("REVOKE KEY u") == ast.RevokeKey("u")
    assert parse("SHOW PERMISSIONS FOR u") == ast.ShowPermissions("u") and parse("SHOW v") == ast.Show("v") and parse("LIST USERS") == ast.ListUsers()


@pytest.mark.parametrize("text", ["", "NOPE x", "QUERY", "QUERY t WHERE", "QUERY t LIMIT x", "QUERY t LIMIT 1 nonsense", "QUERY t PER fortnight", "PLOT median(x) OF t", "QUERY t WHERE EXISTS(x)", "DEFINE t", "STORE t FOR c PAYLOAD [1]", "BATCH PING", "GRANT FLY ON a TO u", 'DEFINE t FIELDS {"a": {"b": "int"}}'])
def test_errors(text):
    with pytest.raises(ParseError):
        parse(text)


def test_json_commands():
    q = command_of({"type": "Query", "event_type": "t", "where": {"or": [{"field": "a", "op": "gt", "value": 1}, {"not": {"field": "b", "in": [1, 2]}}]}, "limit": 3, "order_by": {"field": "a", "desc": True}})
    assert q.where == ast.Or(ast.Compare("a", ">", 1), ast.Not(ast.In("b", (1, 2)))) and q.order == ast.Order("a", True)
    assert command_of({"type": "Batch", "commands": [{"type": "Ping"}]}) == ast.Batch((ast.Ping(),))
    with pytest.raises(CommandError):
        command_of({"type": "Fly"})
