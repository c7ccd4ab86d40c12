"""QUERY and FIND, REPLAY, and PLOT. Clauses come in any order; of a repeated clause the last one counts."""

from __future__ import annotations

from dataclasses import replace

from ..ast import GRANULARITIES, Agg, And, Bucket, CompareQueries, Link, Order, Query, Replay
from ..errors import ParseError
from .expressions import expression
from .lexer import Reader

CLAUSES = ("FOR", "SINCE", "RETURN", "LINKED", "WHERE", "USING", "COUNT", "TOTAL", "AVG", "MIN", "MAX", "PER", "BY", "LIMIT", "OFFSET", "ORDER")


def returned(r: Reader) -> tuple[str, ...]:
    r.need("[")
    return r.listed(lambda: r.one("string") if r.next and r.next.kind == "string" else r.field(), "]")


def granularity(r: Reader) -> str:
    got = r.name().lower()
    if got not in GRANULARITIES:
        raise ParseError(f"not a time bucket: {got}")
    return got


def at_clause(r: Reader) -> bool:
    return any(r.is_word(c) for c in CLAUSES)


def aggregate(r: Reader) -> Agg:
    if r.take_words("COUNT"):
        if r.take_words("UNIQUE"):
            return Agg("count_unique", r.field())
        if r.next and r.next.kind == "word" and not at_clause(r):
            return Agg("count", r.field())
        return Agg("count")
    for kind in ("total", "avg", "min", "max"):
        if r.take_words(kind.upper()):
            if at_clause(r):
                r.fail("a field")
            return Agg(kind, r.field())
    r.fail("a metric")


def query(r: Reader) -> Query:
    q, links = Query(r.name()), []
    while r.is_word("FOLLOWED", "BY") or r.is_word("PRECEDED", "BY"):
        followed = r.take_words("FOLLOWED", "BY") or not r.take_words("PRECEDED", "BY")
        links.append(Link(followed, r.name()))
    q = replace(q, links=tuple(links))
    while r.next and not r.is_word("AS") and r.next.text != ";" and r.next.text != "]":
        if r.take_words("FOR"):
            q = replace(q, context_id=str(r.one("string", "word", "number")))
        elif r.take_words("SINCE"):
            q = replace(q, since=r.one("string", "number"))
        elif r.take_words("RETURN"):
            q = replace(q, returns=returned(r))
        elif r.take_words("LINKED", "BY"):
            q = replace(q, linked_by=r.field())
        elif r.take_words("WHERE"):
            q = replace(q, where=expression(r))
        elif r.is_word("USING", "TIME") and r.at + 2 < len(r.tokens) and r.tokens[r.at + 2].kind == "word" and r.tokens[r.at + 2].text.upper() not in CLAUSES:
            r.at += 2
            q = replace(q, using_time=r.field())
        elif r.take_words("USING"):
            q = replace(q, using=r.field())
        elif any(r.is_word(w) for w in ("COUNT", "TOTAL", "AVG", "MIN", "MAX")):
            q = replace(q, aggs=r.listed(lambda: aggregate(r)))
        elif r.take_words("PER"):
            kind = granularity(r)
            q = replace(q, bucket=Bucket(kind, r.field() if r.take_words("USING") else None))
        elif r.take_words("BY"):
            q = replace(q, by=r.listed(r.field))
            if r.take_words("USING"):
                q = replace(q, using=r.field())
        elif r.take_words("LIMIT"):
            q = replace(q, limit=r.count())
        elif r.take_words("OFFSET"):
            q = replace(q, offset=r.count())
        elif r.take_words("ORDER", "BY"):
            field = r.field()
            q = replace(q, order=Order(field, r.take_words("DESC") or (r.take_words("ASC") and False)))
        else:
            r.fail("a clause")
    return q


def replay(r: Reader) -> Replay:
    event_type = None if r.is_word("FOR") else r.name()
    r.need_words("FOR")
    out = Replay(str(r.one("string", "word", "number")), event_type)
    while r.next and r.next.text not in (";", "]"):
        if r.take_words("SINCE"):
            out = replace(out, since=r.one("string", "number"))
        elif r.take_words("RETURN"):
            out = replace(out, returns=returned(r))
        elif r.take_words("USING"):
            out = replace(out, using=r.field())
        else:
            r.fail("a clause")
    return out


#: PlotQL's metrics.
METRICS = {"TOTAL": "total", "SUM": "total", "AVG": "avg", "MIN": "min", "MAX": "max", "COUNT": "count", "UNIQUE": "count_unique"}


def metric(r: Reader) -> Agg:
    word = r.name().upper()
    if word not in METRICS:
        raise ParseError(f"not a metric: {word.lower()}")
    if r.take("("):
        out = Agg(METRICS[word], r.field())
        r.need(")")
        return out
    if word != "COUNT":
        r.fail("'('")
    return Agg("count")


def side(r: Reader) -> Query:
    m = metric(r)
    r.need_words("OF")
    q = Query(r.name(), aggs=(m,))
    if r.take("->") or r.take_words("THEN"):
        raise ParseError("PLOT over a sequence has no link field; use QUERY ... FOLLOWED BY ... LINKED BY")
    return clauses(r, q, shared=False)


def clauses(r: Reader, q: Query, shared: bool) -> Query:
    while r.next and r.next.text not in (";", "]") and not r.is_word("VS"):
        if r.take_words("FILTER"):
            where = expression(r)
            q = replace(q, where=And(q.where, where) if q.where else where)
        elif r.take_words("BREAKDOWN", "BY"):
            q = replace(q, by=r.listed(r.field))
        elif r.take_words("OVER"):
            kind = granularity(r)
            r.need("(")
            q = replace(q, bucket=Bucket(kind, r.field()))
            r.need(")")
        elif r.take_words("TOP"):
            q = top(r, q)
        else:
            r.fail("a clause")
    return q


def top(r: Reader, q: Query) -> Query:
    n = r.count()
    by = q.aggs[0]
    name = by.name
    if r.take_words("BY"):
        word = r.next.text.upper() if r.next else ""
        ahead = r.tokens[r.at + 1].text if r.at + 1 < len(r.tokens) else ""
        if word in METRICS and (ahead == "(" or word == "COUNT"):
            by = metric(r)
            name = by.name
            if by not in q.aggs:
                q = replace(q, aggs=(*q.aggs, by))
        else:
            name = r.field()
    return replace(q, limit=n, order=Order(name, True))


def plot(r: Reader) -> Query | CompareQueries:
    sides = [side(r)]
    while r.take_words("VS"):
        sides.append(side(r))
    if len(sides) == 1:
        return sides[0]
    if any(s.aggs[0] != sides[0].aggs[0] for s in sides):
        raise ParseError("all sides of a comparison take the same metric")
    last = sides[-1]
    groups = {s.by for s in ([last] if last.by else sides) if s.by}  # one before VS holds for all where the last side has none
    if len(groups) > 1:
        raise ParseError("all sides of a comparison have the same groups")
    by = next(iter(groups), ())
    ends = [(s.limit, s.order) for s in sides[:-1]] + [(None, None)]  # a TOP before VS is its side's own
    sides = [replace(s, by=by, bucket=last.bucket, limit=n, order=o) for s, (n, o) in zip(sides, ends, strict=True)]
    return CompareQueries(tuple(sides), last.limit, last.order)
