"""Boolean composition."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import functions as F

from fathom.operators.scoring import apply_score
from fathom.plans.compiler import Compiler, Row, Scope, sum_of
from fathom.plans.errors import need, only


def compound(c: Compiler, scope: Scope, body: dict) -> Row:
    """must and filter all hold, mustNot none, of should at least minimumShouldMatch (one, if there is no must or filter).

    Scores of must and of the should clauses that match are summed. With dismax the should clauses are one clause:
    the best score and a part of the others; a minimum of two or more then can't be met if they are several.
    """
    only(body, "must mustNot should filter minimumShouldMatch doesNotAffect score", "compound")
    clauses = {k: body[k] if isinstance(body[k], list) else [body[k]] for k in ("must", "mustNot", "should", "filter") if k in body}
    need(any(clauses.values()), "compound needs a clause")
    rows = {k: [c.operator(op, scope) for op in ops] for k, ops in clauses.items()}
    least = body.get("minimumShouldMatch", 0)
    need(isinstance(least, int) and least >= 0, "minimumShouldMatch must not be negative")
    score = body.get("score")
    must, should = rows.get("must", []), rows.get("should", [])
    conditions = [r.match for r in [*must, *rows.get("filter", [])]] + [~r.match for r in rows.get("mustNot", [])]
    parts = [r.score for r in must]
    if should:
        scored = [r.scored() for r in should]
        if score and "dismax" in score:
            tie = only(score["dismax"], "tieBreakerScore", "dismax").get("tieBreakerScore", 1)
            need(0 <= tie <= 1, "tieBreakerScore is from 0 to 1")
            best = F.greatest(*scored) if len(scored) > 1 else scored[0]
            parts.append(best + F.lit(float(tie)) * (sum_of(scored) - best))
            if len(should) > 1 and least > 1:
                conditions.append(F.lit(False))
        else:
            parts += scored
        if least > 1:
            conditions.append(sum_of([r.match.cast("int") for r in should]) >= least)
        elif least == 1 or not must and not rows.get("filter"):
            conditions.append(reduce(or_, [r.match for r in should]))
    elif least > 0:
        conditions.append(F.lit(False))
    details = [x for r in [*must, *should] for x in r.details]
    row = Row(reduce(and_, conditions), sum_of(parts), details)
    return apply_score(c, scope, row, score, ("boost", "constant", "function", "dismax"))
