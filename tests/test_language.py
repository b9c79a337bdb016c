"""The query language: tokens, clauses, quirks."""

import pytest

from factloom.errors import QueryError
from factloom.functions.temporal import AsOf
from factloom.plans.compile import logical_plan
from factloom.plans.lexer import Token, lex
from factloom.plans.parser import parse
from factloom.schema import MAX_TIME

FULL = 'MATCH (n) WHERE SIMILAR(n, "Alice Shanghai") AS OF VALID TIME 1500 TRAVERSE SEMANTIC(depth <= 3, budget = 4000 tokens) RETURN CONTEXT(cite = true)'


def test_tokens():
    assert lex("a_1 -5 'x y' <= ;") == [Token("word", "a_1"), Token("int", -5), Token("string", "x y"), Token("<="), Token(";")]


@pytest.mark.parametrize("source", ["<", "a:b", "[", '"open', "99999999999999999999", "$q", "{"])
def test_bad_tokens(source):
    with pytest.raises(QueryError):
        lex(source)


def test_all_clauses():
    q = parse(FULL)
    assert (q.match_var, q.similar_to, q.as_of, q.max_depth, q.budget, q.return_context, q.cite) == ("n", "Alice Shanghai", AsOf(1500, MAX_TIME), 3, 4000, True, True)
    assert [name for name, _ in logical_plan(q).steps] == ["seed", "as_of", "expand", "budget", "context"]


def test_empty_and_trailing():
    assert parse("").similar_to is None
    q = parse('AS OF VALID TIME 5 WHERE SIMILAR(n,"x") RETURN CONTEXT(cite=true)')
    assert q.as_of == AsOf.valid(5) and q.similar_to is None and not q.return_context


def test_clauses():
    assert parse("MATCH (n) RETURN n, m").return_names == ("n", "m")
    assert parse("as of transaction time 42 return context()").as_of == AsOf.transaction(42)
    assert parse('WHERE foo = 3 AND SIMILAR(n,"x") RETURN n').similar_to == "x"
    assert parse('WHERE SIMILAR("a") AND SIMILAR("b")').similar_to == "b"
    assert parse('WHERE SIMILAR("a") foo RETURN n').return_names == ()
    q = parse("TRAVERSE SEMANTIC(depth <= -1, budget = -3)")
    assert (q.max_depth, q.budget) == ((1 << 32) - 1, 0)


@pytest.mark.parametrize("source", ["MATCH (a", "MATCH a", "AS VALID", "AS OF TIME 3", "AS OF VALID TIME x", "TRAVERSE SEMANTIC(depth = 3)", "RETURN CONTEXT", "RETURN CONTEXT(cite = 1)", "RETURN 3", "WHERE SIMILAR(n)", "MATCH ( <bad"])
def test_bad_clauses(source):
    with pytest.raises(QueryError):
        parse(source)
