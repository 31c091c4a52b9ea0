"""Query strings: a recursive-descent parser into operators.

AND, OR, NOT, +, -, &&, ||, !, groups, field:..., "phrases"~slop, wild*cards, fuzzy~1, /regex/, ranges [a TO b] {a TO b}
and *:*, boosts ^2.
"""

from __future__ import annotations

import re

from fathom.operators.scoring import apply_score
from fathom.plans.compiler import Compiler, Row, Scope
from fathom.plans.errors import QueryError, need, only

LEX = re.compile(
    r"""\s*(?:(?P<op>&&|\|\||AND\b|OR\b|NOT\b|TO\b|[()+!^~:\[\]{}]|-)|"(?P<quoted>(?:[^"\\]|\\.)*)"|/(?P<regex>(?:[^/\\]|\\.)*)/|(?P<word>(?:[^\s()+\-!^~:\[\]{}"/\\&|]|\\.|(?<=\S)[-+!/&|])+))"""
)


def lex(text: str) -> list[tuple[str, str, bool]]:
    """(kind, value, whether white space stands before it)."""
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = LEX.match(text, at)
        if m is None or m.end() == at:
            raise QueryError(f"can't parse the query string at {text[at:]!r}")
        kind = m.lastgroup or "op"
        out.append((kind, m[kind], text[at].isspace()))
        at = m.end()
    return out


def plain(word: str) -> str:
    return re.sub(r"\\(.)", r"\1", word)


class Parser:
    def __init__(self, text: str, default: str) -> None:
        self.tokens, self.at, self.field = lex(text), 0, default

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] == "op" and self.tokens[self.at][1] in values

    def take(self, *values: str) -> bool:
        if self.peek(*values):
            self.at += 1
            return True
        return False

    def parse(self) -> dict:
        need(self.tokens, "query string is empty")
        found = self.disjunction()
        need(self.at == len(self.tokens), "query string has an unexpected end")
        return found

    def disjunction(self) -> dict:
        """Clauses in the classic manner: AND makes both neighbours required, NOT and - prohibit, + requires, the rest is optional."""
        clauses: list[list] = []
        while self.at < len(self.tokens) and not self.peek(")"):
            joined = "and" if self.take("AND", "&&") else "or" if self.take("OR", "||") else ""
            need(not joined or clauses, "query string begins with an operator")
            mark = "not" if self.take("NOT", "!", "-") else "must" if self.take("+") else ""
            need(self.at < len(self.tokens) and not self.peek(")"), "query string ends with an operator")
            op = self.clause()
            if joined == "and":
                if clauses[-1][0] == "should":
                    clauses[-1][0] = "must"
                mark = mark or "must"
            clauses.append([{"not": "mustNot", "must": "must", "": "should"}[mark], op])
        need(clauses, "empty group")
        if len(clauses) == 1 and clauses[0][0] != "mustNot":
            return clauses[0][1]
        body: dict[str, list] = {}
        for kind, op in clauses:
            body.setdefault(kind, []).append(op)
        return {"compound": body}

    def clause(self) -> dict:
        kind, value, _ = self.tokens[self.at]
        if kind == "word" and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][:2] == ("op", ":"):
            self.at += 2
            name = plain(value)
            need(not name.startswith("$"), "fields must not begin with $")
            need(self.at < len(self.tokens), "a field without a value")
            if name == "*" and self.tokens[self.at][1] == "*":
                self.at += 1
                return {"allDocuments": {}}
            before, self.field = self.field, name
            found = self.clause()
            self.field = before
            return found
        if self.take("("):
            found = self.disjunction()
            need(self.take(")"), "a group isn't closed")
        elif self.peek("[", "{"):
            found = self.range()
        else:
            self.at += 1
            found = self.term(kind, value)
        if self.take("^"):
            boost = float(self.word())
            return {"compound": {"must": [found], "score": {"boost": {"value": boost}}}}
        return found

    def word(self) -> str:
        need(self.at < len(self.tokens) and self.tokens[self.at][0] in ("word", "quoted"), "a word is missing")
        self.at += 1
        return plain(self.tokens[self.at - 1][1])

    def number(self, default: int) -> int:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "word" and not self.tokens[self.at][2] and re.fullmatch(r"\d+(\.\d+)?", self.tokens[self.at][1]):
            self.at += 1
            return int(float(self.tokens[self.at - 1][1]))
        return default

    def range(self) -> dict:
        closed = self.take("[")
        self.at += not closed
        low = self.word()
        need(self.take("TO"), "a range needs TO")
        high = self.word()
        need(self.peek("]", "}"), "a range isn't closed")
        upper = self.take("]")
        self.at += not upper
        return {"__range": {"path": self.field, "low": None if low == "*" else low, "high": None if high == "*" else high, "gte": closed, "lte": upper}}

    def term(self, kind: str, value: str) -> dict:
        if kind == "quoted":
            slop = self.number(0) if self.take("~") else 0
            return {"phrase": {"path": self.field, "query": plain(value), "slop": slop}}
        if kind == "regex":
            return {"regex": {"path": self.field, "query": value.replace("\\/", "/"), "allowAnalyzedField": True}}
        need(kind == "word", f"unexpected {value}")
        if value == "*" :
            return {"exists": {"path": self.field}}
        if re.search(r"(?<!\\)[*?]", value):
            return {"wildcard": {"path": self.field, "query": value.lower(), "allowAnalyzedField": True}}
        if self.take("~"):
            edits = min(2, self.number(2))
            return {"text": {"path": self.field, "query": plain(value)} | ({"fuzzy": {"maxEdits": edits}} if edits else {})}
        return {"text": {"path": self.field, "query": plain(value), "matchCriteria": "any"}}


def number_or_text(x: str | None):
    if x is None:
        return None
    try:
        return float(x) if "." in x or "e" in x.lower() else int(x)
    except ValueError:
        return x


def text_range(c: Compiler, scope: Scope, body: dict) -> Row:
    """A range of a query string: of numbers, of tokens, or of an analysed field's terms."""
    from pyspark.sql import functions as F

    from fathom.operators.predicates import range_
    from fathom.operators.text import fields

    path = body["path"]
    if c.index.kind(path, "number"):
        low, high = number_or_text(body["low"]), number_or_text(body["high"])
    else:
        low, high = body["low"], body["high"]
    limits = ({"gte" if body["gte"] else "gt": low} if low is not None else {}) | ({"lte" if body["lte"] else "lt": high} if high is not None else {})
    if not limits:
        from fathom.operators.predicates import exists

        return exists(c, scope, {"path": path})
    if c.index.kind(path, "number", "token", "date"):
        return range_(c, scope, {"path": path} | limits)
    tests = {"gt": lambda x, v: x > v, "gte": lambda x, v: x >= v, "lt": lambda x, v: x < v, "lte": lambda x, v: x <= v}

    def holds(term):
        out = F.lit(True)
        for k, v in limits.items():
            out = out & tests[k](term, v.lower())
        return out

    return c.either([Row(F.exists(f.tokens, lambda t: holds(t["term"])), F.lit(1.0)) for f, _ in fields(c, scope, path)])


def query_string(c: Compiler, scope: Scope, body: dict) -> Row:
    only(body, "defaultPath! query! score", "queryString")
    need(isinstance(body["query"], str), "query must be a string")
    row = c.operator(Parser(body["query"], body["defaultPath"]).parse(), scope)
    return apply_score(c, scope, row, body.get("score"))
