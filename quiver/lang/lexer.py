"""Query text to tokens."""

from __future__ import annotations

import re
from typing import NamedTuple

from quiver.errors import QuerySyntaxError

#: Reserved words of the language (fixed values).
KEYWORDS = frozenset(
    """
    MATCH WHERE RETURN CREATE INSERT DELETE SET REMOVE DROP GRAPH TYPE NODE EDGE TRUE FALSE NULL NOT AND OR XOR IS IN
    LIKE AS BY ORDER ASC DESC LIMIT OFFSET GROUP HAVING WITH LET FOR FILTER CALL YIELD OPTIONAL MANDATORY EXISTS CASE
    WHEN THEN ELSE END UNION INTERSECT EXCEPT ALL DISTINCT COUNT SUM AVG MIN MAX COLLECT WALK TRAIL SIMPLE ACYCLIC
    SHORTEST PATH ANY COMMIT ROLLBACK BEGIN IF DETACH NODETACH COST OF TO FROM INDEX UNIQUE ON LIST
    """.split()
)


class Token(NamedTuple):
    kind: str  # word, name (quoted), string, integer, float, parameter, symbol, end
    text: str
    line: int
    column: int

    @property
    def keyword(self) -> str | None:
        upper = self.text.upper()
        return upper if self.kind == "word" and upper in KEYWORDS else None


_TOKEN = re.compile(
    r"""
      (?P<skip>\s+|--[^\n]*|/\*.*?\*/)
    | (?P<float>\d+\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)
    | (?P<integer>\d+)
    | (?P<string>'(?:[^']|'')*')
    | (?P<name>`[^`]+`|"[^"]+")
    | (?P<parameter>\$\w+)
    | (?P<word>[^\W\d]\w*)
    | (?P<symbol><-\[|\]->|<>|!=|<=|>=|<-|->|\|\||\.\.|[-+*/%=<>(){}\[\],.;:|&~?])
    """,
    re.VERBOSE | re.DOTALL,
)


def tokenize(text: str) -> list[Token]:
    tokens, at, line, start = [], 0, 1, 0
    while at < len(text):
        found = _TOKEN.match(text, at)
        if not found:
            what = "unterminated string" if text[at] == "'" else f"unexpected character {text[at]!r}"
            raise QuerySyntaxError(what, line, at - start + 1)
        kind, value = found.lastgroup, found.group()
        if kind != "skip":
            if kind == "string":
                value = value[1:-1].replace("''", "'")
            elif kind in ("name", "parameter"):
                value = value[1:-1] if kind == "name" else value[1:]
            tokens.append(Token(kind, value, line, at - start + 1))
        lines = found.group().count("\n")
        if lines:
            line += lines
            start = at + found.group().rindex("\n") + 1
        at = found.end()
    tokens.append(Token("end", "", line, at - start + 1))
    return tokens
