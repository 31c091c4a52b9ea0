"""Edit distance with transpositions, globs, regular expressions."""

from __future__ import annotations

import re


def osa(a: str, b: str, most: int) -> int:
    """Optimal string alignment: insertions, deletions, substitutions and swaps of neighbours; most + 1 if it is more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


def glob(pattern: str) -> str:
    """A wildcard pattern as an anchored Java regular expression: * any run, ? one character, \\ escapes."""
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            at += 1
            out.append(re.escape(pattern[at]))
        else:
            out.append({"*": "(?s:.*)", "?": "(?s:.)"}.get(c) or re.escape(c))
        at += 1
    return "^" + "".join(out) + "$"


def whole_regex(pattern: str) -> str:
    """A term pattern as an anchored Java regular expression. Of the automaton syntax, @ (anything), # (nothing) and "literal" are translated; ~, & and <n-m> are refused."""
    out, at, in_class = [], 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            out.append(pattern[at : at + 2] if pattern[at + 1].isascii() and not pattern[at + 1].isalnum() else re.escape(pattern[at + 1]))
            at += 1
        elif in_class:
            in_class = c != "]"
            out.append(c if c != "[" else "\\[")
        elif c == "[":
            in_class = True
            out.append(c)
        elif c == "@":
            out.append("(?s:.*)")
        elif c == "#":
            out.append("(?!)")
        elif c == '"' and (end := pattern.find('"', at + 1)) > 0:
            out.append(re.escape(pattern[at + 1 : end]))
            at = end
        elif c in "~&<":
            raise ValueError(f"{c} isn't supported in regular expressions")
        elif c in "^$":
            out.append("\\" + c)  # literals in automaton syntax
        else:
            out.append(c)
        at += 1
    return "^(?:" + "".join(out) + ")$"
