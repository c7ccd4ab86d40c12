"""Conditions: OR binds looser than AND, then NOT and parentheses; a bare field means that it is true."""

from __future__ import annotations

from typing import Any

from ..ast import And, Compare, Expr, In, Not, Or
from ..errors import ParseError
from .lexer import Reader

OPS = ("=", "!=", ">", ">=", "<", "<=")


def expression(r: Reader) -> Expr:
    left = conjunction(r)
    return Or(left, expression(r)) if r.take_words("OR") else left


def conjunction(r: Reader) -> Expr:
    left = factor(r)
    return And(left, conjunction(r)) if r.take_words("AND") else left


def factor(r: Reader) -> Expr:
    if r.take_words("NOT"):
        if r.is_word("EXISTS"):
            raise ParseError("EXISTS is not supported")
        return Not(factor(r))
    if r.take("("):
        inner = expression(r)
        r.need(")")
        return inner
    if r.is_word("EXISTS"):
        raise ParseError("EXISTS is not supported")
    field = r.field()
    if r.take_words("IN"):
        r.need("(")
        return In(field, r.listed(lambda: value(r), ")"))
    if r.next and r.next.kind == "op" and r.next.text in OPS:
        return Compare(field, r.one("op"), value(r))
    return Compare(field, "=", True)


def value(r: Reader) -> Any:
    return r.one("string", "number", "word")
