"""Tokens to syntax trees: recursive descent for clauses, precedence climbing for expressions."""

from __future__ import annotations

from quiver.errors import QuerySyntaxError
from quiver.lang import ast as A
from quiver.lang.lexer import Token, tokenize

#: Nesting beyond this is refused.
MOST_NESTED = 256
#: Binary operators by strength; comparisons do not chain.
_LEVELS = {"OR": 1, "XOR": 2, "AND": 3, "=": 5, "<>": 5, "!=": 5, "<": 5, ">": 5, "<=": 5, ">=": 5, "IS": 5, "IN": 5, "LIKE": 5, "||": 6, "+": 7, "-": 7, "*": 8, "/": 8, "%": 8}
_NOT, _COMPARE = 4, 5
_AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "COLLECT"}
#: Aggregates whose names are not reserved.
_MORE_AGGREGATES = {"STDDEV", "PERCENTILE"}
_WRITES = (A.Insert, A.Update, A.Delete)


class Parser:
    def __init__(self, text: str):
        self.tokens, self.at, self.depth = tokenize(text), 0, 0

    # -- tokens

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def ahead(self, n: int = 1) -> Token:
        return self.tokens[min(self.at + n, len(self.tokens) - 1)]

    def fail(self, message: str) -> QuerySyntaxError:
        return QuerySyntaxError(message, self.now.line, self.now.column)

    def next(self) -> Token:
        token = self.now
        self.at += 1
        return token

    def at_word(self, *words: str) -> bool:
        return self.now.kind == "word" and self.now.text.upper() in words

    def at_symbol(self, *symbols: str) -> bool:
        return self.now.kind == "symbol" and self.now.text in symbols

    def word(self, *words: str) -> bool:
        if self.at_word(*words):
            self.at += 1
            return True
        return False

    def symbol(self, symbol: str) -> bool:
        if self.at_symbol(symbol):
            self.at += 1
            return True
        return False

    def need_word(self, *words: str) -> str:
        if not self.at_word(*words):
            raise self.fail(f"expected {' or '.join(words)}, found {self.now.text or 'the end'!r}")
        return self.next().text.upper()

    def need(self, symbol: str) -> None:
        if not self.symbol(symbol):
            raise self.fail(f"expected {symbol!r}, found {self.now.text or 'the end'!r}")

    def name(self, any_word: bool = False) -> str:
        token = self.now
        if token.kind == "name" or token.kind == "word" and (any_word or not token.keyword):
            self.at += 1
            return token.text
        raise self.fail(f"expected a name, found {token.text or 'the end'!r}")

    def property_name(self) -> str:
        token = self.now
        name = self.name(any_word=True)
        return name.lower() if token.keyword and token.text == token.text.upper() else name

    def number(self) -> int:
        if self.now.kind != "integer":
            raise self.fail("expected a whole number")
        return int(self.next().text)

    # -- statements

    def program(self) -> A.Program:
        out = []
        while self.now.kind != "end":
            if not self.symbol(";"):
                out.append(self.statement())
                if self.now.kind != "end" and not self.at_symbol(";"):
                    raise self.fail(f"unexpected {self.now.text!r}")
        return A.Program(tuple(out))

    def statement(self) -> A.Node:
        if self.at_word("CREATE"):
            return self.create()
        if self.word("DROP"):
            kind = self.need_word("GRAPH", "INDEX")
            there = self.if_exists()
            return A.DropGraph(self.name(), there) if kind == "GRAPH" else A.DropIndex(self.name(any_word=True), there)
        if self.at_word("LIST"):
            self.next()
            self.need_word("GRAPHS", "GRAPH")
            self.word("S", "GRAPHS")
            return A.ListGraphs()
        if self.at_word("BEGIN", "COMMIT", "ROLLBACK"):
            action = self.next().text.upper()
            self.word("TRANSACTION")
            return A.Transaction(action)
        return self.composite()

    def if_exists(self) -> bool:
        if not self.word("IF"):
            return False
        self.need_word("EXISTS")
        return True

    def if_not_exists(self) -> bool:
        if not self.word("IF"):
            return False
        self.need_word("NOT"), self.need_word("EXISTS")
        return True

    def create(self) -> A.Node:
        self.need_word("CREATE")
        unique = self.word("UNIQUE")
        kind = self.need_word("INDEX") if unique else self.need_word("INDEX", "GRAPH")
        if kind == "INDEX":
            absent = self.if_not_exists()
            index = self.name(any_word=True)
            self.need_word("FOR"), self.need("(")
            variable = self.name()
            self.need(":")
            label = self.name()
            self.need(")"), self.need_word("ON"), self.need("(")
            columns = []
            while True:
                if self.name() != variable:
                    raise self.fail(f"properties of an index must be those of {variable}")
                self.need(".")
                columns.append(self.property_name())
                if not self.symbol(","):
                    break
            self.need(")")
            return A.CreateIndex(index, label, tuple(columns), unique, absent)
        type_only = self.word("TYPE")
        absent = self.if_not_exists()
        return A.CreateGraph(self.name(), absent, self.type_declarations() if type_only or self.at_symbol("{") else (), type_only)

    def type_declarations(self) -> tuple[A.TypeDeclaration, ...]:
        self.need("{")
        out = []
        while not self.symbol("}"):
            kind = self.need_word("NODE", "EDGE")
            labels = []
            while self.symbol(":"):
                labels.append(self.name())
            source = self.name() if kind == "EDGE" and self.word("FROM") else None
            target = self.name() if kind == "EDGE" and self.word("TO") else None
            properties = []
            if self.symbol("{"):
                while not self.symbol("}"):
                    name = self.property_name()
                    self.need(":")
                    of = self.name(any_word=True).upper()
                    required = self.word("NOT") and bool(self.need_word("NULL"))
                    properties.append((name, of, required))
                    self.symbol(",")
            out.append(A.TypeDeclaration(kind, tuple(labels), tuple(properties), source, target))
            self.symbol(",")
        return tuple(out)

    def composite(self) -> A.Node:
        """UNION and EXCEPT from left to right, INTERSECT binds tighter; operands are whole linear queries."""
        left = self.intersection()
        while self.at_word("UNION", "EXCEPT"):
            op = self.next().text.upper()
            every = self.word("ALL")
            self.word("DISTINCT")
            left = A.SetOperation(op, every, left, self.intersection())
        return left

    def intersection(self) -> A.Node:
        left = self.linear()
        while self.word("INTERSECT"):
            every = self.word("ALL")
            self.word("DISTINCT")
            left = A.SetOperation("INTERSECT", every, left, self.linear())
        return left

    def linear(self) -> A.Query:
        clauses = []
        while (clause := self.clause()) is not None:
            clauses.append(clause)
            if isinstance(clause, A.Projection) and clause.final:
                break
        if not clauses:
            raise self.fail(f"expected a statement, found {self.now.text or 'the end'!r}")
        return A.Query(tuple(clauses))

    def clause(self) -> A.Node | None:
        if self.at_word("OPTIONAL", "MANDATORY", "MATCH"):
            optional, mandatory = self.word("OPTIONAL"), self.word("MANDATORY")
            self.need_word("MATCH")
            paths = self.paths()
            graph = self.name() if self.word("ON") else None
            where = self.expression() if self.word("WHERE") else None
            return A.Match(paths, where, optional, mandatory, graph, self.page())
        if self.word("RETURN"):
            distinct, items = self.items()
            group = ()
            if self.word("GROUP"):
                self.need_word("BY")
                group = self.list_of(self.expression)
            having = self.expression() if self.word("HAVING") else None
            return A.Projection(items, distinct, True, group, having, None, self.page())
        if self.word("WITH"):
            distinct, items = self.items()
            where = self.expression() if self.word("WHERE") else None
            page = self.page()
            if where is None and self.word("WHERE"):
                where = self.expression()
            return A.Projection(items, distinct, False, (), None, where, page)
        if self.word("CALL"):
            parts = [self.name(any_word=True)]
            while self.symbol("."):
                parts.append(self.name(any_word=True))
            self.need("(")
            args = () if self.at_symbol(")") else self.list_of(self.expression)
            self.need(")")
            return A.Procedure(".".join(parts), args, self.list_of(self.yielded) if self.word("YIELD") else None)
        if self.word("LET"):
            return A.Let(self.list_of(self.assignment))
        if self.word("FOR"):
            variable = self.name()
            self.need_word("IN")
            return A.For(variable, self.expression())
        if self.word("FILTER"):
            self.word("WHERE")
            return A.Filter(self.expression())
        if self.word("INSERT"):
            return A.Insert(self.paths())
        if self.word("SET"):
            return A.Update(self.list_of(self.set_item))
        if self.word("REMOVE"):
            return A.Update(self.list_of(self.remove_item), remove=True)
        if self.at_word("DETACH", "NODETACH", "DELETE"):
            detach = self.word("DETACH")
            self.word("NODETACH")
            self.need_word("DELETE")
            targets = self.list_of(self.expression)
            if not all(isinstance(x, A.Variable) for x in targets):
                raise self.fail("DELETE takes variables")
            return A.Delete(tuple(x.name for x in targets), detach)
        return None

    def list_of(self, one) -> tuple:
        out = [one()]
        while self.symbol(","):
            out.append(one())
        return tuple(out)

    def assignment(self) -> tuple[str, A.Node]:
        name = self.name()
        self.need("=")
        return name, self.expression()

    def yielded(self) -> A.Item:
        name = self.name(any_word=True)
        return A.Item(A.Variable(name), self.name() if self.word("AS") else None)

    def items(self) -> tuple[bool, tuple[A.Item, ...]]:
        distinct = self.word("DISTINCT")
        self.word("ALL")
        return distinct, (() if self.symbol("*") else self.list_of(self.item))

    def item(self) -> A.Item:
        expression = self.expression()
        return A.Item(expression, self.name(any_word=True) if self.word("AS") else None)

    def page(self) -> A.Page:
        order, limit, offset = (), None, None
        if self.word("ORDER"):
            self.need_word("BY")
            order = self.list_of(self.sort)
        if self.word("LIMIT"):
            limit = self.expression()
        if self.word("OFFSET"):
            offset = self.expression()
        if limit is None and self.word("LIMIT"):
            limit = self.expression()
        return A.Page(order, limit, offset)

    def sort(self) -> A.Sort:
        expression = self.expression()
        descending = self.word("DESC", "DESCENDING")
        if not descending:
            self.word("ASC", "ASCENDING")
        return A.Sort(expression, descending)

    def set_item(self) -> A.Node:
        variable = self.name()
        if self.symbol(":"):
            return A.SetLabel(variable, self.name())
        if self.symbol("="):
            return A.SetAll(variable, self.expression())
        self.need(".")
        name = self.property_name()
        self.need("=")
        return A.SetProperty(variable, name, self.expression())

    def remove_item(self) -> A.Node:
        variable = self.name()
        if self.symbol(":"):
            return A.SetLabel(variable, self.name())
        self.need(".")
        return A.SetProperty(variable, self.property_name(), A.Literal(None))

    # -- patterns

    def paths(self) -> tuple[A.Path, ...]:
        return self.list_of(self.path)

    def path(self) -> A.Path:
        variable = None
        if self.now.kind in ("word", "name") and self.ahead().text == "=" and self.ahead().kind == "symbol":
            variable = self.name(any_word=True)
            self.need("=")
        shortest = None
        if self.at_word("ANY", "ALL", "SHORTEST"):
            first = self.next().text.upper()
            shortest = "all" if first == "ALL" else "any"
            if first != "SHORTEST":
                self.need_word("SHORTEST")
        mode = self.next().text.upper() if self.at_word("WALK", "TRAIL", "SIMPLE", "ACYCLIC") else None
        self.word("PATH", "PATHS")
        elements: list[A.Node] = [self.node_pattern()]
        while self.at_symbol("-", "<-", "->", "<-[", "~"):
            elements.append(self.edge_pattern())
            elements.append(self.node_pattern())
        if (quantifier := self.quantifier()) is not None:
            if len(elements) != 3:
                raise self.fail("a quantifier behind a path needs a path of one edge")
            edge = elements[1]
            elements[1] = A.EdgePattern(edge.variable, edge.labels, edge.properties, edge.where, edge.direction, quantifier)
        return A.Path(tuple(elements), variable, mode, shortest)

    def element(self, close: str) -> tuple:
        """variable, labels, properties, condition of a node or edge."""
        variable = self.name() if self.now.kind in ("word", "name") and not self.at_word("WHERE", "IS") else None
        labels: list[tuple[str, ...]] = []
        if self.word("IS"):
            labels.append(self.alternatives())
        while self.symbol(":") or self.symbol("&"):
            labels.append(self.alternatives())
        quantifier = None
        if close == "]" and self.symbol("*"):
            low = self.number() if self.now.kind == "integer" else 1
            high = (self.number() if self.now.kind == "integer" else None) if self.symbol("..") else (low if self.tokens[self.at - 1].kind == "integer" else None)
            quantifier = (low, high)
        properties = self.map_items() if self.at_symbol("{") else ()
        where = self.expression() if self.word("WHERE") else None
        return variable, tuple(labels), properties, where, quantifier

    def alternatives(self) -> tuple[str, ...]:
        out = [self.name()]
        while self.symbol("|"):
            self.symbol(":")
            out.append(self.name())
        return tuple(out)

    def node_pattern(self) -> A.NodePattern:
        self.need("(")
        variable, labels, properties, where, _ = self.element(")")
        self.need(")")
        return A.NodePattern(variable, labels, properties, where)

    def edge_pattern(self) -> A.EdgePattern:
        opening = self.next().text
        if opening in ("->", "<-") and not self.at_symbol("["):
            return A.EdgePattern(None, direction="out" if opening == "->" else "in", quantifier=self.quantifier())
        if opening in ("-", "~") and not self.at_symbol("["):
            return A.EdgePattern(None, direction="both", quantifier=self.quantifier())
        if opening != "<-[":
            self.need("[")
        variable, labels, properties, where, stars = self.element("]")
        leftward = opening in ("<-[", "<-")
        if self.symbol("]->"):
            rightward = True
        else:
            self.need("]")
            rightward = self.symbol("->")
            if not rightward and not self.symbol("-") and not self.symbol("~"):
                raise self.fail("expected '-' or '->' behind an edge")
        direction = "both" if leftward == rightward else "in" if leftward else "out"
        return A.EdgePattern(variable, tuple(x for group in labels for x in group), properties, where, direction, stars or self.quantifier())

    def quantifier(self) -> tuple[int, int | None] | None:
        if not (self.at_symbol("{") and (self.ahead().kind == "integer" or self.ahead().text == ",")):
            return None
        self.need("{")
        low = self.number() if self.now.kind == "integer" else 0
        high = (self.number() if self.now.kind == "integer" else None) if self.symbol(",") else low
        self.need("}")
        if high is not None and high < low:
            raise self.fail("the quantifier's upper bound is below its lower bound")
        return low, high

    def map_items(self) -> tuple[tuple[str, A.Node], ...]:
        self.need("{")
        out = []
        while not self.symbol("}"):
            name = self.next().text if self.now.kind == "string" else self.property_name()
            self.need(":")
            out.append((name, self.expression()))
            if not self.symbol(","):
                self.need("}")
                break
        return tuple(out)

    # -- expressions

    def expression(self, least: int = 1) -> A.Node:
        self.depth += 1
        if self.depth > MOST_NESTED:
            raise self.fail("the expression is nested too deeply")
        if least <= _NOT and self.word("NOT"):
            left: A.Node = A.Unary("NOT", self.expression(_NOT))
        else:
            left = self.prefix()
        compared = False
        while (op := self.operator()) is not None and _LEVELS[op] >= least:
            level = _LEVELS[op]
            if level == _COMPARE:
                if compared:
                    raise self.fail("comparisons don't chain")
                compared = True
            self.next()
            if op == "IS":
                negated = self.word("NOT")
                self.need_word("NULL")
                left = A.IsNull(left, negated)
            else:
                left = A.Binary("<>" if op == "!=" else op, left, self.expression(level + 1))
        self.depth -= 1
        return left

    def operator(self) -> str | None:
        token = self.now
        if token.kind == "word":
            text = token.text.upper()
            return text if text in ("OR", "XOR", "AND", "IS", "IN", "LIKE") else None
        if token.kind == "symbol" and token.text in _LEVELS:
            return token.text
        return None

    def prefix(self) -> A.Node:
        if self.at_symbol("-", "+"):
            op = self.next().text
            self.depth += 1
            if self.depth > MOST_NESTED:
                raise self.fail("the expression is nested too deeply")
            operand = self.prefix()
            self.depth -= 1
            if op == "-" and isinstance(operand, A.Literal) and isinstance(operand.value, int | float) and not isinstance(operand.value, bool):
                return A.Literal(-operand.value)
            return A.Unary(op, operand)
        return self.postfix(self.primary())

    def postfix(self, value: A.Node) -> A.Node:
        while self.symbol("."):
            value = A.Property(value, self.property_name())
        return value

    def primary(self) -> A.Node:
        token = self.now
        if token.kind in ("integer", "float", "string", "parameter", "name"):
            self.next()
            return {"integer": lambda: A.Literal(int(token.text)), "float": lambda: A.Literal(float(token.text)), "string": lambda: A.Literal(token.text), "parameter": lambda: A.Parameter(token.text), "name": lambda: A.Variable(token.text)}[token.kind]()
        if self.symbol("("):
            inside = self.expression()
            self.need(")")
            return inside
        if self.symbol("["):
            items = () if self.at_symbol("]") else self.list_of(self.expression)
            self.need("]")
            return A.ListOf(items)
        if self.at_symbol("{"):
            return A.MapOf(self.map_items())
        if token.kind != "word":
            raise self.fail(f"expected an expression, found {token.text or 'the end'!r}")
        upper = token.text.upper()
        if upper in ("TRUE", "FALSE", "NULL"):
            self.next()
            return A.Literal({"TRUE": True, "FALSE": False, "NULL": None}[upper])
        if upper == "CASE":
            return self.case()
        if upper in ("EXISTS", "VALUE") and self.ahead().text == "{":
            self.next()
            self.need("{")
            query = self.braced()
            self.need("}")
            return A.Exists(query) if upper == "EXISTS" else A.ValueOf(query)
        if upper == "CAST" and self.ahead().text == "(":
            self.next(), self.need("(")
            operand = self.expression()
            self.need_word("AS")
            of = self.name(any_word=True).upper()
            self.need(")")
            return A.Cast(operand, of)
        if self.ahead().text == "(" and self.ahead().kind == "symbol":
            if upper in _AGGREGATES | _MORE_AGGREGATES:
                return self.aggregate()
            if token.keyword is None or upper in ("TYPE", "EXISTS", "LIST"):
                self.next(), self.need("(")
                args = () if self.at_symbol(")") else self.list_of(self.expression)
                self.need(")")
                return A.Call(token.text.lower(), args)
        return A.Variable(self.name())

    def braced(self) -> A.Node:
        """A query in braces; a bare pattern counts as MATCH."""
        if self.at_symbol("("):
            paths = self.paths()
            return A.Query((A.Match(paths, self.expression() if self.word("WHERE") else None),))
        return self.composite()

    def aggregate(self) -> A.Node:
        name = self.next().text.upper()
        self.need("(")
        distinct = self.word("DISTINCT")
        arg = None if self.symbol("*") or self.at_symbol(")") else self.expression()
        extra = self.expression() if self.symbol(",") else None
        self.need(")")
        if arg is None and name != "COUNT":
            raise self.fail(f"{name} needs an argument")
        return A.Aggregate(name, arg, distinct, extra)

    def case(self) -> A.Node:
        self.need_word("CASE")
        subject = None if self.at_word("WHEN") else self.expression()
        branches = []
        while self.word("WHEN"):
            condition = self.expression()
            self.need_word("THEN")
            branches.append((condition, self.expression()))
        if not branches:
            raise self.fail("CASE needs WHEN")
        default = self.expression() if self.word("ELSE") else None
        self.need_word("END")
        return A.Case(subject, tuple(branches), default)


def parse(text: str) -> A.Program:
    return Parser(text).program()


def is_write(statement: A.Node) -> bool:
    return any(isinstance(x, _WRITES) for x in A.walk(statement))
