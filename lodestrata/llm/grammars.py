"""Parsers that accept or refuse a text of a language (problem 5).

They follow the published grammars of the languages closely enough to refuse
truncated, merged, foreign and mistyped text, and leave aside what compilers
decide by names and types. No tree is built.
"""

from __future__ import annotations

import ast
import sys
import warnings

from lodestrata.llm.lexers import ENDS, Fail, Tokens


class Watched(list):
    """Token types that remember how far they were read."""

    most = 0

    def __getitem__(self, i):
        if i.__class__ is int and i > self.most:
            self.most = i
        return list.__getitem__(self, i)


class Parser:
    language = ""

    def __init__(self, text: str, limit: int | None = None):
        self.k = Tokens(self.language, text, limit=limit)
        self.t = self.k.type if limit is None else Watched(self.k.type)
        self.fresh = self.k.fresh
        self.close = self.k.matched(limit is None)
        self.i = 0

    # helpers -----------------------------------------------------------------
    def word(self, i: int | None = None) -> str:
        i = self.i if i is None else i
        return self.k.text[self.k.start[i] : self.k.end[i]]

    def fail(self, why: str = "unexpected") -> Fail:
        return Fail(f"{why} {self.t[self.i]} at {self.k.start[self.i]}")

    def want(self, kind: str) -> None:
        if self.t[self.i] != kind:
            raise self.fail(f"{kind} wanted, not")
        self.i += 1

    def take(self, kind: str) -> bool:
        if self.t[self.i] == kind:
            self.i += 1
            return True
        return False

    def tried(self, what, *args) -> bool:
        """Parse if possible; otherwise stay. An index beyond the tokens means that the text ended too early."""
        at, marks = self.i, self.t
        saved = None
        try:
            if ">>" in marks:
                saved = marks[:]
            what(*args)
            return True
        except (Fail, IndexError):
            self.i = at
            if saved is not None:
                marks[:] = saved
            return False

    def angle(self) -> None:
        """One closing angle bracket, also out of a longer sign."""
        t = self.t[self.i]
        if t == ">":
            self.i += 1
        elif t in (">>", ">>>", ">=", ">>=", ">>>="):
            self.t[self.i] = t[1:]
        else:
            raise self.fail("> wanted, not")

    def skip(self) -> None:
        """Over a bracketed group."""
        if self.t[self.i] not in ("(", "[", "{"):
            raise self.fail()
        self.i = self.close[self.i] + 1

    def listed(self, end: str, item) -> None:
        """Items between commas up to the closing sign; a last comma is allowed."""
        while self.t[self.i] != end:
            item()
            if not self.take(","):
                break
        self.want(end)


# --- Go ----------------------------------------------------------------------
class Go(Parser):
    language = "go"
    BINARY = frozenset("|| && == != < <= > >= + - | ^ * / % << >> & &^".split())
    ASSIGN = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())

    def end(self) -> None:
        if self.t[self.i] in (")", "}"):
            return
        self.want(";")

    def file(self) -> None:
        self.want("package")
        self.want("ID")
        self.want(";")
        while self.take("import"):
            self.group(self.imported)
            self.end()
        while self.t[self.i] != "END":
            t = self.t[self.i]
            if t == "func":
                self.function()
            elif t in ("var", "const", "type"):
                self.declared()
            else:
                raise self.fail()
            self.want(";")

    def imported(self) -> None:
        if self.t[self.i] in ("ID", "."):
            self.i += 1
        self.want("STR")

    def group(self, spec) -> None:
        if self.take("("):
            while self.t[self.i] != ")":
                spec()
                self.end()
            self.want(")")
        else:
            spec()

    def declared(self) -> None:
        t = self.t[self.i]
        self.i += 1
        self.group({"var": self.variable, "const": self.constant, "type": self.typed}[t])

    def names(self) -> None:
        self.want("ID")
        while self.take(","):
            self.want("ID")

    def variable(self) -> None:
        self.names()
        if self.take("="):
            self.expressions()
            return
        self.type()
        if self.take("="):
            self.expressions()

    def constant(self) -> None:
        self.names()
        if self.t[self.i] not in ("=", ";", ")"):
            self.type()
        if self.take("="):
            self.expressions()

    def typed(self) -> None:
        self.want("ID")
        if self.t[self.i] == "[" and self.t[self.i + 1] == "ID" and self.t[self.i + 2] != "]":
            self.tried(self.type_parameters)
        self.take("=")
        self.type()

    def type_parameters(self) -> None:
        self.want("[")
        while self.t[self.i] != "]":
            self.names()
            self.constraint()
            if not self.take(","):
                break
        self.want("]")

    def constraint(self) -> None:
        self.take("~")
        self.type()
        while self.take("|"):
            self.take("~")
            self.type()

    def function(self) -> None:
        self.want("func")
        if self.t[self.i] == "(":
            self.parameters()
        self.want("ID")
        if self.t[self.i] == "[":
            self.type_parameters()
        self.signature()
        if self.t[self.i] == "{":
            self.block()

    def signature(self) -> None:
        self.parameters()
        if self.t[self.i] == "(":
            self.parameters()
        elif self.t[self.i] in ("ID", "*", "[", "map", "chan", "func", "struct", "interface", "<-"):
            self.type()

    def parameters(self) -> None:
        self.want("(")
        self.listed(")", self.parameter)

    def parameter(self) -> None:
        if self.t[self.i] == "ID" and self.t[self.i + 1] not in (",", ")", ".", "["):
            self.i += 1
            self.take("...")
            self.type()
            return
        if self.t[self.i] == "ID" and self.t[self.i + 1] == "[":
            at = self.i
            self.i += 1
            if self.tried(self.type) and self.t[self.i] in (",", ")"):
                return
            self.i = at
        self.take("...")
        self.type()

    def type(self) -> None:
        t = self.t[self.i]
        if t == "ID":
            self.i += 1
            if self.t[self.i] == ".":
                self.i += 1
                self.want("ID")
            if self.t[self.i] == "[" and self.t[self.i + 1] not in ("]", "...", "NUM"):
                self.tried(self.type_arguments)
        elif t == "*":
            self.i += 1
            self.type()
        elif t == "(":
            self.i += 1
            self.type()
            self.want(")")
        elif t == "[":
            self.i += 1
            if self.t[self.i] != "]" and not self.take("..."):
                self.expression()
            self.want("]")
            self.type()
        elif t == "map":
            self.i += 1
            self.want("[")
            self.type()
            self.want("]")
            self.type()
        elif t == "chan":
            self.i += 1
            self.take("<-")
            self.type()
        elif t == "<-":
            self.i += 1
            self.want("chan")
            self.type()
        elif t == "func":
            self.i += 1
            self.signature()
        elif t == "struct":
            self.i += 1
            self.want("{")
            while self.t[self.i] != "}":
                self.field()
                self.end()
            self.want("}")
        elif t == "interface":
            self.i += 1
            self.want("{")
            while self.t[self.i] != "}":
                if self.t[self.i] == "ID" and self.t[self.i + 1] == "(":
                    self.i += 1
                    self.signature()
                else:
                    self.constraint()
                self.end()
            self.want("}")
        else:
            raise self.fail("type wanted, not")

    def type_arguments(self) -> None:
        self.want("[")
        self.listed("]", self.type)

    def field(self) -> None:
        if self.t[self.i] == "*" or (self.t[self.i] == "ID" and self.t[self.i + 1] in (";", ".", "STR", "}")):
            self.type()
        else:
            self.names()
            self.type()
        self.take("STR")

    def block(self) -> None:
        self.want("{")
        self.statements()
        self.want("}")

    def statements(self) -> None:
        while self.t[self.i] not in ("}", "case", "default", "END"):
            self.statement()
            self.end()

    def statement(self) -> None:
        t = self.t[self.i]
        if t == ";":
            return
        if t in ("var", "const", "type"):
            self.declared()
        elif t == "{":
            self.block()
        elif t in ("go", "defer"):
            self.i += 1
            if self.expression() != "call":
                raise self.fail("call wanted before")
        elif t == "return":
            self.i += 1
            if self.t[self.i] not in (";", "}"):
                self.expressions()
        elif t in ("break", "continue"):
            self.i += 1
            self.take("ID")
        elif t == "goto":
            self.i += 1
            self.want("ID")
        elif t == "fallthrough":
            self.i += 1
        elif t == "if":
            self.conditional()
        elif t == "for":
            self.loop()
        elif t == "switch":
            self.switch()
        elif t == "select":
            self.i += 1
            self.cases(self.simple)
        elif t == "ID" and self.t[self.i + 1] == ":":
            self.i += 2
            if self.t[self.i] != "}":
                self.statement()
        else:
            self.simple()

    def simple(self, head: bool = False) -> str:
        if head and self.take("range"):
            self.expression(head)
            return "range"
        at = self.i
        kind = self.expressions(head)
        t = self.t[self.i]
        if t in self.ASSIGN:
            if t == ":=" and not all(self.t[k] in ("ID", ",") for k in range(at, self.i)):
                raise self.fail("names wanted before")
            self.i += 1
            if head and self.take("range"):
                self.expression(head)
                return "range"
            self.expressions(head)
            return "assign"
        if t in ("++", "--"):
            self.i += 1
            return "step"
        if t == "<-":
            self.i += 1
            self.expression(head)
            return "send"
        return kind

    def conditional(self) -> None:
        self.want("if")
        if self.t[self.i] == "{":
            raise self.fail("condition wanted, not")
        if self.t[self.i] != ";":
            kind = self.simple(True)
        else:
            kind = "none"
        if self.take(";"):
            kind = self.simple(True)
        if kind in ("assign", "step", "send", "none"):
            raise self.fail("condition wanted before")
        self.block()
        if self.take("else"):
            if self.t[self.i] == "if":
                self.conditional()
            else:
                self.block()

    def loop(self) -> None:
        self.want("for")
        if self.t[self.i] == "{":
            self.block()
            return
        kind = "none"
        if self.t[self.i] != ";":
            kind = self.simple(True)
        if kind != "range" and self.take(";"):
            if self.t[self.i] != ";":
                self.expression(True)
            self.want(";")
            if self.t[self.i] != "{":
                self.simple(True)
        elif kind in ("assign", "step", "send"):
            raise self.fail("condition wanted before")
        self.block()

    def switch(self) -> None:
        self.want("switch")
        if self.t[self.i] != "{":
            if self.t[self.i] != ";":
                self.simple(True)
            if self.take(";") and self.t[self.i] != "{":
                self.simple(True)
        self.cases(self.alternatives)

    def alternatives(self) -> None:
        def one() -> None:
            at = self.i
            if not (self.tried(self.expression) and self.t[self.i] in (",", ":")):
                self.i = at
                self.type()

        one()
        while self.take(","):
            one()

    def cases(self, head) -> None:
        self.want("{")
        while self.t[self.i] != "}":
            if self.take("default"):
                self.want(":")
            else:
                self.want("case")
                head()
                self.want(":")
            self.statements()
        self.want("}")

    def expressions(self, head: bool = False) -> str:
        kind = self.expression(head)
        while self.take(","):
            self.expression(head)
            kind = "list"
        return kind

    def expression(self, head: bool = False) -> str:
        kind = self.unary(head)
        while self.t[self.i] in self.BINARY:
            self.i += 1
            self.unary(head)
            kind = "value"
        return kind

    def unary(self, head: bool) -> str:
        plain = True
        while self.t[self.i] in ("+", "-", "!", "^", "*", "&", "<-"):
            if self.t[self.i] == "<-" and self.t[self.i + 1] == "chan":
                break
            self.i += 1
            plain = False
        kind = self.primary(head)
        return kind if plain else "value"

    def primary(self, head: bool) -> str:
        t, literal = self.t[self.i], False
        if t == "ID":
            self.i += 1
            literal = not head
        elif t in ("NUM", "STR", "CHR"):
            self.i += 1
        elif t == "(":
            self.i += 1
            at = self.i
            if not (self.tried(self.expression) and self.t[self.i] == ")"):
                self.i = at
                self.type()
            self.want(")")
        elif t == "func":
            self.i += 1
            self.signature()
            if self.t[self.i] == "{":
                self.block()
        elif t in ("[", "map", "chan", "struct", "interface", "<-"):
            self.type()
            literal = t in ("[", "map", "struct")
        else:
            raise self.fail("expression wanted, not")
        kind = "value"
        while True:
            t = self.t[self.i]
            if t == ".":
                self.i += 1
                if self.take("("):
                    if not self.take("type"):
                        self.type()
                    self.want(")")
                    literal = False
                else:
                    self.want("ID")
                kind = "value"
            elif t == "[":
                end = self.close[self.i]
                self.i += 1
                if self.t[self.i] == "]":
                    raise self.fail("index wanted, not")
                if self.t[self.i] != ":":
                    if not self.tried(self.expression):
                        self.type()
                while self.t[self.i] in (":", ","):
                    self.i += 1
                    if self.i < end and self.t[self.i] != ":":
                        if not self.tried(self.expression):
                            self.type()
                self.want("]")
                kind = "value"
            elif t == "(":
                self.i += 1

                def argument() -> None:
                    at = self.i
                    if not (self.tried(self.expression) and self.t[self.i] in (",", ")", "...")):
                        self.i = at
                        self.type()
                    self.take("...")

                self.listed(")", argument)
                kind, literal = "call", False
            elif t == "{" and literal:
                self.composite()
                kind, literal = "value", False
            else:
                return kind

    def composite(self) -> None:
        self.want("{")

        def element() -> None:
            for _ in range(2):
                if self.t[self.i] == "{":
                    self.composite()
                else:
                    self.expression()
                if not self.take(":"):
                    return

        self.listed("}", element)


# --- Java --------------------------------------------------------------------
class Java(Parser):
    language = "java"
    PRIMITIVE = frozenset("boolean byte char double float int long short void".split())
    MODIFIERS = frozenset("public protected private static abstract final native synchronized transient volatile strictfp default".split())
    BINARY = frozenset("|| && | ^ & == != < > <= >= << + - * / %".split())
    ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>=".split())
    CONTEXT = frozenset("record sealed non permits yield var".split())

    def file(self) -> None:
        while self.t[self.i] != "END":
            t = self.t[self.i]
            if t == ";":
                self.i += 1
                continue
            if t == "import":
                self.i += 1
                self.take("static")
                self.dotted(True)
                self.want(";")
                continue
            self.modifiers()
            if self.take("package"):
                self.dotted()
                self.want(";")
            elif not self.type_declaration():
                raise self.fail()

    def dotted(self, star: bool = False) -> None:
        self.want("ID")
        while self.take("."):
            if star and self.take("*"):
                return
            self.want("ID")

    def modifiers(self) -> None:
        while True:
            t = self.t[self.i]
            if t == "@" and self.t[self.i + 1] != "interface":
                self.i += 1
                self.dotted()
                if self.t[self.i] == "(":
                    self.annotation()
            elif t in self.MODIFIERS and not (t == "default" and self.t[self.i + 1] in (":", "->")) and not (t == "synchronized" and self.t[self.i + 1] == "("):
                self.i += 1
            elif t == "ID" and self.word() == "sealed" and self.t[self.i + 1] in ("class", "interface", "abstract", "public"):
                self.i += 1
            elif t == "ID" and self.word() == "non" and self.t[self.i + 1] == "-":
                self.i += 3
            else:
                return

    def annotation(self) -> None:
        self.want("(")

        def value() -> None:
            if self.t[self.i] == "ID" and self.t[self.i + 1] == "=":
                self.i += 2
            self.annotation_value()

        self.listed(")", value)

    def annotation_value(self) -> None:
        if self.take("{"):
            self.listed("}", self.annotation_value)
        elif self.t[self.i] == "@":
            self.modifiers()
        else:
            self.expression()

    def type_declaration(self) -> bool:
        t = self.t[self.i]
        if t == "class":
            self.i += 1
            self.want("ID")
            self.generics()
            if self.take("extends"):
                self.type()
            self.heritage()
            self.members(False)
        elif t == "interface" or t == "@":
            self.i += 1 + (t == "@")
            self.want("ID")
            self.generics()
            if self.take("extends"):
                self.types()
            self.heritage()
            self.members(False)
        elif t == "enum":
            self.i += 1
            self.want("ID")
            self.heritage()
            self.want("{")
            while self.t[self.i] in ("ID", "@"):
                self.modifiers()
                self.want("ID")
                if self.t[self.i] == "(":
                    self.arguments()
                if self.t[self.i] == "{":
                    self.members(False)
                if not self.take(","):
                    break
            if self.take(";"):
                while self.t[self.i] != "}":
                    self.member()
            self.want("}")
        elif t == "ID" and self.word() == "record" and self.t[self.i + 1] == "ID" and self.t[self.i + 2] in ("(", "<"):
            self.i += 2
            self.generics()
            self.parameters()
            self.heritage()
            self.members(True)
        else:
            return False
        return True

    def heritage(self) -> None:
        if self.take("implements"):
            self.types()
        if self.t[self.i] == "ID" and self.word() == "permits":
            self.i += 1
            self.types()

    def types(self) -> None:
        self.type()
        while self.take(","):
            self.type()

    def generics(self) -> None:
        if self.take("<"):
            while True:
                self.modifiers()
                self.want("ID")
                if self.take("extends"):
                    self.type()
                    while self.take("&"):
                        self.type()
                if not self.take(","):
                    break
            self.angle()

    def type(self, dims: bool = True) -> None:
        self.modifiers()
        if self.t[self.i] in self.PRIMITIVE:
            self.i += 1
        elif self.take("?"):
            if self.t[self.i] in ("extends", "super"):
                self.i += 1
                self.type()
            return
        else:
            self.want("ID")
            self.type_arguments()
            while self.t[self.i] == "." and self.t[self.i + 1] == "ID":
                self.i += 2
                self.type_arguments()
        while dims and self.t[self.i] == "[" and self.t[self.i + 1] == "]":
            self.i += 2

    def type_arguments(self) -> None:
        if self.t[self.i] == "<":
            self.i += 1
            if self.take(">"):
                return
            self.types()
            self.angle()

    def members(self, record: bool) -> None:
        self.want("{")
        while self.t[self.i] != "}":
            self.member(record)
        self.want("}")

    def member(self, record: bool = False) -> None:
        if self.take(";"):
            return
        if self.t[self.i] == "{":
            self.block()
            return
        if self.t[self.i] == "static" and self.t[self.i + 1] == "{":
            self.i += 1
            self.block()
            return
        self.modifiers()
        if self.type_declaration():
            return
        self.generics()
        if self.t[self.i] == "ID" and self.t[self.i + 1] == "(":
            self.i += 1
            self.method()
            return
        if record and self.t[self.i] == "ID" and self.t[self.i + 1] == "{":
            self.i += 1
            self.block()
            return
        self.type()
        self.want("ID")
        if self.t[self.i] == "(":
            self.method()
            return
        self.declarators()
        self.want(";")

    def method(self) -> None:
        self.parameters()
        while self.take("["):
            self.want("]")
        if self.take("throws"):
            self.types()
        if self.take("default"):
            self.annotation_value()
        if self.t[self.i] == "{":
            self.block()
        else:
            self.want(";")

    def parameters(self) -> None:
        self.want("(")

        def one() -> None:
            self.modifiers()
            self.type()
            self.take("...")
            if not self.take("this"):
                self.want("ID")
            while self.take("["):
                self.want("]")

        if self.take(")"):
            return
        one()
        while self.take(","):
            one()
        self.want(")")

    def declarators(self) -> None:
        """After the first name."""
        while True:
            while self.take("["):
                self.want("]")
            if self.take("="):
                self.initializer()
            if not self.take(","):
                return
            self.want("ID")

    def initializer(self) -> None:
        if self.take("{"):
            self.listed("}", self.initializer)
        else:
            self.expression()

    def block(self) -> None:
        self.want("{")
        while self.t[self.i] != "}":
            self.statement(True)
        self.want("}")

    def local(self) -> bool:
        """A local variable declaration without its end."""
        at = self.i

        def head() -> None:
            self.modifiers()
            self.type()
            self.want("ID")
            if self.t[self.i] not in ("=", ";", ",", "[", ":"):
                raise self.fail()

        if not (self.t[at] in ("ID", "@", "final") or self.t[at] in self.PRIMITIVE):
            return False
        if not self.tried(head):
            return False
        self.declarators()
        return True

    def statement(self, inside: bool = False) -> None:
        t = self.t[self.i]
        if t == "{":
            self.block()
        elif t == ";":
            self.i += 1
        elif t == "if":
            self.i += 1
            self.grouped()
            self.statement()
            if self.take("else"):
                self.statement()
        elif t == "while":
            self.i += 1
            self.grouped()
            self.statement()
        elif t == "do":
            self.i += 1
            self.statement()
            self.want("while")
            self.grouped()
            self.want(";")
        elif t == "for":
            self.i += 1
            self.want("(")
            if self.t[self.i] != ";" and not self.local():
                self.several()
            if self.take(":"):
                self.expression()
            else:
                self.want(";")
                if self.t[self.i] != ";":
                    self.expression()
                self.want(";")
                if self.t[self.i] != ")":
                    self.several()
            self.want(")")
            self.statement()
        elif t == "try":
            self.i += 1
            resources = self.t[self.i] == "("
            if resources:
                self.i += 1
                while self.t[self.i] != ")":
                    if not self.local():
                        self.expression()
                    if not self.take(";"):
                        break
                self.want(")")
            self.block()
            handled = False
            while self.take("catch"):
                handled = True
                self.want("(")
                self.modifiers()
                self.type()
                while self.take("|"):
                    self.type()
                self.want("ID")
                self.want(")")
                self.block()
            if self.take("finally"):
                handled = True
                self.block()
            if not (handled or resources):
                raise self.fail("catch wanted, not")
        elif t == "switch":
            self.switch()
            if self.t[self.i] == ".":
                raise self.fail()
        elif t in ("return", "throw"):
            self.i += 1
            if t == "throw" or self.t[self.i] != ";":
                self.expression()
            self.want(";")
        elif t in ("break", "continue"):
            self.i += 1
            self.take("ID")
            self.want(";")
        elif t == "synchronized":
            self.i += 1
            self.grouped()
            self.block()
        elif t == "assert":
            self.i += 1
            self.expression()
            if self.take(":"):
                self.expression()
            self.want(";")
        elif t == "ID" and self.t[self.i + 1] == ":":
            self.i += 2
            self.statement()
        elif t == "ID" and self.word() == "yield" and self.t[self.i + 1] not in ("=", ".", "(", "++", "--", "["):
            self.i += 1
            self.expression()
            self.want(";")
        else:
            if inside:
                at = self.i
                self.modifiers()
                if self.type_declaration():
                    return
                self.i = at
            if inside and self.local():
                self.want(";")
                return
            if self.expression() not in ("call", "assign", "step", "new"):
                raise self.fail("statement wanted before")
            self.want(";")

    def several(self) -> None:
        self.expression()
        while self.take(","):
            self.expression()

    def grouped(self) -> None:
        self.want("(")
        self.expression()
        self.want(")")

    def switch(self) -> None:
        self.want("switch")
        self.grouped()
        self.want("{")
        while self.t[self.i] != "}":
            if self.take("default"):
                pass
            else:
                self.want("case")
                self.pattern()
                while self.take(","):
                    if not self.take("default"):
                        self.pattern()
                if self.t[self.i] == "ID" and self.word() == "when":
                    self.i += 1
                    self.expression()
            if self.take("->"):
                if self.t[self.i] == "{":
                    self.block()
                elif self.t[self.i] == "throw":
                    self.statement()
                else:
                    self.expression()
                    self.want(";")
            else:
                self.want(":")
                while self.t[self.i] not in ("case", "default", "}"):
                    self.statement(True)
        self.want("}")

    def pattern(self) -> None:
        def typed() -> None:
            self.modifiers()
            self.type()
            if self.take("("):
                self.listed(")", self.pattern)
                self.take("ID")
            else:
                self.want("ID")

        at = self.i
        if self.tried(typed) and self.t[self.i] in (",", ")", "->", ":", "ID", "&&", "||", ";"):
            return
        self.i = at
        self.ternary()

    def expression(self) -> str:
        t = self.t[self.i]
        if (t == "ID" and self.t[self.i + 1] == "->") or (t == "(" and self.t[self.close[self.i] + 1] == "->"):
            if t == "ID":
                self.i += 1
            else:
                at = self.i

                def names() -> None:
                    self.want("(")
                    while self.t[self.i] != ")":
                        self.want("ID")
                        if not self.take(","):
                            break
                    self.want(")")

                if not self.tried(names):
                    self.i = at
                    self.parameters()
            self.want("->")
            if self.t[self.i] == "{":
                self.block()
            else:
                self.expression()
            return "lambda"
        kind = self.ternary()
        if self.t[self.i] in self.ASSIGN or (self.t[self.i] == ">" and self.t[self.i + 1] in (">=", ">")):
            if kind not in ("name", "index"):
                raise self.fail("variable wanted before")
            self.i += 1
            self.expression()
            return "assign"
        return kind

    def ternary(self) -> str:
        kind = self.binary()
        if self.take("?"):
            self.expression()
            self.want(":")
            self.expression()
            return "value"
        return kind

    def binary(self) -> str:
        kind = self.unary()
        while True:
            t = self.t[self.i]
            if t == "instanceof":
                self.i += 1
                self.take("final")
                self.type()
                if self.take("("):
                    self.listed(")", self.pattern)
                self.take("ID")
                kind = "value"
            elif t in self.BINARY:
                self.i += 1
                while t == ">" and self.t[self.i] == ">":
                    self.i += 1
                self.unary()
                kind = "value"
            else:
                return kind

    def unary(self) -> str:
        t = self.t[self.i]
        if t in ("+", "-", "!", "~"):
            self.i += 1
            self.unary()
            return "value"
        if t in ("++", "--"):
            self.i += 1
            self.unary()
            return "step"
        if t == "(":
            end = self.close[self.i]
            nxt = self.t[end + 1]

            def cast() -> None:
                self.want("(")
                self.type()
                while self.take("&"):
                    self.type()
                if self.i != end:
                    raise self.fail()
                self.want(")")

            simple = self.t[self.i + 1] in self.PRIMITIVE
            if simple or nxt in ("ID", "NUM", "STR", "CHR", "(", "!", "~", "this", "super", "new", "true", "false", "null", "switch"):
                if self.tried(cast):
                    if self.t[self.i] == "(" and self.t[self.close[self.i] + 1] == "->" or self.t[self.i] == "ID" and self.t[self.i + 1] == "->":
                        self.expression()
                    else:
                        self.unary()
                    return "value"
        return self.postfix()

    def arguments(self) -> None:
        self.want("(")
        if self.take(")"):
            return
        self.several()
        self.want(")")

    def postfix(self) -> str:
        t = self.t[self.i]
        if t in ("NUM", "STR", "CHR", "true", "false", "null"):
            self.i += 1
            kind = "value"
        elif t == "(":
            self.grouped()
            kind = "value"
        elif t in ("this", "super"):
            self.i += 1
            kind = "value"
            if self.t[self.i] == "(":
                self.arguments()
                kind = "call"
        elif t == "ID":
            kind = "name"

            def reference() -> None:
                self.type()
                if self.t[self.i] != "::" and not (self.t[self.i] == "." and self.t[self.i + 1] == "class"):
                    raise self.fail()

            if self.t[self.i + 1] in ("<", "[") and self.tried(reference):
                pass
            else:
                self.i += 1
                if self.t[self.i] == "(":
                    self.arguments()
                    kind = "call"
        elif t in self.PRIMITIVE:
            self.type()
            if self.t[self.i] not in ("::", "."):
                raise self.fail()
            kind = "value"
        elif t == "new":
            kind = self.created()
        elif t == "switch":
            self.switch()
            kind = "value"
        else:
            raise self.fail("expression wanted, not")
        while True:
            t = self.t[self.i]
            if t == ".":
                self.i += 1
                if self.take("new"):
                    self.i -= 1
                    kind = self.created()
                    continue
                self.type_arguments()
                if self.t[self.i] in ("class", "this", "super"):
                    self.i += 1
                    kind = "value"
                else:
                    self.want("ID")
                    kind = "name"
                if self.t[self.i] == "(":
                    self.arguments()
                    kind = "call"
            elif t == "[":
                self.i += 1
                self.expression()
                self.want("]")
                kind = "index"
            elif t in ("++", "--"):
                self.i += 1
                kind = "step"
            elif t == "::":
                self.i += 1
                self.type_arguments()
                if not self.take("new"):
                    self.want("ID")
                kind = "value"
            else:
                return kind

    def created(self) -> str:
        self.want("new")
        self.type_arguments()
        self.type(False)
        if self.t[self.i] == "(":
            self.arguments()
            if self.t[self.i] == "{":
                self.members(False)
            return "new"
        sized = False
        while self.take("["):
            if self.t[self.i] != "]":
                self.expression()
                sized = True
            self.want("]")
        if self.t[self.i] == "{":
            self.initializer()
        elif not sized:
            raise self.fail("size wanted, not")
        return "value"


# --- TypeScript and JavaScript -----------------------------------------------
class Ts(Parser):
    language = "ts"
    BINARY = frozenset("|| && ?? | ^ & == != === !== < > <= >= << + - * / % ** in instanceof".split())
    ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
    UNARY = frozenset("+ - ! ~ typeof void delete".split())

    def said(self, w: str) -> bool:
        return self.t[self.i] == "ID" and self.word() == w

    def name(self) -> None:
        """An identifier or a reserved word used as one."""
        if self.t[self.i] == "ID" or self.t[self.i].isalpha() and self.t[self.i] not in ("NUM", "STR", "END", "BAD"):
            self.i += 1
        else:
            raise self.fail("name wanted, not")

    def end(self) -> None:
        if self.take(";") or self.t[self.i] in ("}", "END") or self.fresh[self.i]:
            return
        raise self.fail("; wanted, not")

    def file(self) -> None:
        while self.t[self.i] != "END":
            self.statement()

    def block(self) -> None:
        self.want("{")
        while self.t[self.i] != "}":
            if self.t[self.i] == "END":
                raise self.fail()
            self.statement()
        self.want("}")

    def decorators(self) -> None:
        while self.take("@"):
            if self.t[self.i] == "(":
                self.grouped()
            else:
                self.name()
                while self.take("."):
                    self.name()
                if self.t[self.i] == "(":
                    self.arguments()

    def statement(self) -> None:
        t = self.t[self.i]
        if t == "{":
            self.block()
        elif t == ";":
            self.i += 1
        elif t == "@":
            self.decorators()
            self.statement()
        elif t in ("var", "const") or self.said("let") and self.t[self.i + 1] in ("ID", "[", "{"):
            if t == "const" and self.t[self.i + 1] == "enum":
                self.i += 1
                self.statement()
                return
            self.variables()
            self.end()
        elif t == "function":
            self.function(True)
        elif t == "class":
            self.klass()
        elif t == "if":
            self.i += 1
            self.grouped()
            self.statement()
            if self.take("else"):
                self.statement()
        elif t == "for":
            self.loop()
        elif t == "while":
            self.i += 1
            self.grouped()
            self.statement()
        elif t == "with":
            self.i += 1
            self.grouped()
            self.statement()
        elif t == "do":
            self.i += 1
            self.statement()
            self.want("while")
            self.grouped()
            self.take(";")
        elif t == "switch":
            self.i += 1
            self.grouped()
            self.want("{")
            while self.t[self.i] != "}":
                if not self.take("default"):
                    self.want("case")
                    self.sequence()
                self.want(":")
                while self.t[self.i] not in ("case", "default", "}"):
                    self.statement()
            self.want("}")
        elif t == "try":
            self.i += 1
            self.block()
            handled = False
            if self.take("catch"):
                handled = True
                if self.take("("):
                    self.binding()
                    if self.take(":"):
                        self.type()
                    self.want(")")
                self.block()
            if self.take("finally"):
                handled = True
                self.block()
            if not handled:
                raise self.fail("catch wanted, not")
        elif t in ("return", "throw"):
            self.i += 1
            if t == "throw" and self.fresh[self.i]:
                raise self.fail()
            if self.t[self.i] not in (";", "}", "END") and not self.fresh[self.i]:
                self.sequence()
            elif t == "throw":
                raise self.fail()
            self.end()
        elif t in ("break", "continue"):
            self.i += 1
            if self.t[self.i] == "ID" and not self.fresh[self.i]:
                self.i += 1
            self.end()
        elif t == "debugger":
            self.i += 1
            self.end()
        elif t == "import" and self.t[self.i + 1] not in ("(", "."):
            self.imports()
        elif t == "export":
            self.exports()
        elif t == "enum":
            self.i += 1
            self.want("ID")
            self.want("{")

            def member() -> None:
                if not self.take("STR"):
                    self.name()
                if self.take("="):
                    self.assignment()

            self.listed("}", member)
        elif t == "ID" and self.t[self.i + 1] == ":":
            self.i += 2
            self.statement()
        elif t == "ID" and self.contextual():
            return
        else:
            self.sequence()
            self.end()

    def contextual(self) -> bool:
        """Statements that begin with a word that is not reserved."""
        w, nxt, near = self.word(), self.t[self.i + 1], not self.fresh[self.i + 1]
        if w == "type" and nxt == "ID" and near:
            self.i += 2
            self.generics()
            self.want("=")
            self.type()
            self.end()
        elif w == "interface" and nxt == "ID" and near:
            self.i += 2
            self.generics()
            if self.take("extends"):
                self.types()
            self.object_type()
        elif w in ("declare", "abstract") and nxt in ("class", "function", "const", "var", "enum", "ID") and near:
            self.i += 1
            self.statement()
        elif w in ("namespace", "module", "global") and (nxt in ("ID", "STR") and near or nxt == "{"):
            self.i += 1
            while self.t[self.i] in ("ID", "STR", "."):
                self.i += 1
            self.block()
        elif w == "async" and nxt == "function" and near:
            self.i += 1
            self.function(True)
        else:
            return False
        return True

    def variables(self, head: bool = False) -> None:
        self.i += 1
        while True:
            self.binding()
            self.take("!")
            if self.take(":"):
                self.type()
            if self.take("="):
                self.assignment(not head)
            if not self.take(","):
                return

    def binding(self) -> None:
        if self.take("{"):

            def one() -> None:
                if self.take("..."):
                    self.binding()
                    return
                if self.take("["):
                    self.assignment()
                    self.want("]")
                elif self.t[self.i] in ("STR", "NUM"):
                    self.i += 1
                else:
                    self.name()
                if self.take(":"):
                    self.binding()
                if self.take("="):
                    self.assignment()

            self.listed("}", one)
        elif self.take("["):
            while self.t[self.i] != "]":
                if self.take(","):
                    continue
                self.take("...")
                self.binding()
                if self.take("="):
                    self.assignment()
                if not self.take(","):
                    break
            self.want("]")
        elif not self.take("this"):
            self.want("ID")

    def loop(self) -> None:
        self.want("for")
        if self.said("await"):
            self.i += 1
        self.want("(")
        if self.t[self.i] != ";":
            if self.t[self.i] in ("var", "const") or self.said("let"):
                self.i += 1
                self.binding()
                if self.take(":"):
                    self.type()
                if self.said("of") or self.t[self.i] == "in":
                    self.i += 1
                    self.sequence()
                    self.want(")")
                    self.statement()
                    return
                if self.take("="):
                    self.assignment()
                while self.take(","):
                    self.binding()
                    if self.take(":"):
                        self.type()
                    if self.take("="):
                        self.assignment()
            else:
                self.sequence()
                if self.said("of"):
                    self.i += 1
                    self.sequence()
                    self.want(")")
                    self.statement()
                    return
                if self.t[self.i] == ")":
                    self.want(")")
                    self.statement()
                    return
        self.want(";")
        if self.t[self.i] != ";":
            self.sequence()
        self.want(";")
        if self.t[self.i] != ")":
            self.sequence()
        self.want(")")
        self.statement()

    def imports(self) -> None:
        self.want("import")
        if self.take("STR"):
            self.attributes()
            self.end()
            return
        if self.said("type") and self.t[self.i + 1] in ("{", "*", "ID") and self.word(self.i + 1) != "from":
            self.i += 1
        if self.take("ID"):
            if self.take("="):
                self.sequence()
                self.end()
                return
            if not self.take(","):
                self.source()
                return
        if self.take("*"):
            if not self.said("as"):
                raise self.fail()
            self.i += 1
            self.want("ID")
        else:
            self.specifiers()
        self.source()

    def specifiers(self) -> None:
        self.want("{")

        def one() -> None:
            while self.t[self.i] not in (",", "}"):
                if not self.take("STR"):
                    self.name()

        self.listed("}", one)

    def source(self) -> None:
        if not self.said("from"):
            raise self.fail("from wanted, not")
        self.i += 1
        self.want("STR")
        self.attributes()
        self.end()

    def attributes(self) -> None:
        if self.t[self.i] == "with" or self.said("assert") and self.t[self.i + 1] == "{":
            self.i += 1
            self.skip()

    def exports(self) -> None:
        self.want("export")
        if self.take("default"):
            if self.t[self.i] == "function" or self.said("async") and self.t[self.i + 1] == "function":
                self.take("ID")
                self.function(False)
            elif self.t[self.i] in ("class", "@") or self.said("abstract"):
                self.decorators()
                if self.said("abstract"):
                    self.i += 1
                self.klass()
            elif self.said("interface"):
                self.statement()
            else:
                self.assignment()
                self.end()
        elif self.take("*"):
            if self.said("as"):
                self.i += 1
                self.name()
            self.source()
        elif self.t[self.i] == "{" or self.said("type") and self.t[self.i + 1] == "{":
            self.take("ID")
            self.specifiers()
            if self.said("from"):
                self.source()
            else:
                self.end()
        elif self.take("="):
            self.sequence()
            self.end()
        elif self.t[self.i] in ("var", "const", "function", "class", "enum", "@", "import") or self.t[self.i] == "ID" and self.word() in ("let", "type", "interface", "abstract", "declare", "namespace", "module", "async"):
            self.statement()
        else:
            raise self.fail()

    def function(self, named: bool) -> None:
        self.want("function")
        self.take("*")
        if named:
            self.want("ID")
        else:
            self.take("ID")
        self.signature()
        if self.t[self.i] == "{":
            self.block()
        else:
            self.end()

    def signature(self) -> None:
        self.generics()
        self.parameters()
        if self.take(":"):
            self.type()

    def parameters(self) -> None:
        self.want("(")

        def one() -> None:
            self.decorators()
            while self.t[self.i] == "ID" and self.word() in ("public", "private", "protected", "readonly", "override") and self.t[self.i + 1] in ("ID", "{", "["):
                self.i += 1
            self.take("...")
            self.binding()
            self.take("?")
            if self.take(":"):
                self.type()
            if self.take("="):
                self.assignment()

        self.listed(")", one)

    def generics(self) -> None:
        if self.take("<"):
            while True:
                while self.t[self.i] in ("const", "in") or self.said("out") and self.t[self.i + 1] == "ID":
                    self.i += 1
                self.want("ID")
                if self.take("extends"):
                    self.type()
                if self.take("="):
                    self.type()
                if not self.take(",") or self.t[self.i] == ">":
                    break
            self.angle()

    def klass(self) -> None:
        self.want("class")
        if self.t[self.i] == "ID" and self.word() != "implements":
            self.i += 1
        self.generics()
        if self.take("extends"):
            self.postfix()
            if self.t[self.i] == "<":
                self.type_arguments()
        if self.said("implements"):
            self.i += 1
            self.types()
        self.want("{")
        while self.t[self.i] != "}":
            self.member()
        self.want("}")

    def member(self) -> None:
        if self.take(";"):
            return
        self.decorators()
        if self.said("static") and self.t[self.i + 1] == "{":
            self.i += 1
            self.block()
            return
        while self.t[self.i] == "ID" and self.word() in ("public", "private", "protected", "static", "readonly", "abstract", "override", "async", "declare", "get", "set", "accessor") and (self.t[self.i + 1] in ("ID", "STR", "NUM", "[", "*", "{") or self.t[self.i + 1].isalpha() and self.t[self.i + 1] != "END"):
            self.i += 1
        self.take("*")
        self.key()
        if self.t[self.i] in ("?", "!"):
            self.i += 1
        if self.t[self.i] in ("(", "<"):
            self.signature()
            if self.t[self.i] == "{":
                self.block()
            else:
                self.end()
            return
        if self.take(":"):
            self.type()
        if self.take("="):
            self.assignment()
        self.end()

    def key(self) -> None:
        if self.t[self.i] in ("STR", "NUM"):
            self.i += 1
        elif self.take("["):
            self.assignment()
            if self.take(":"):
                self.type()
            self.want("]")
        else:
            self.name()

    # types
    def types(self) -> None:
        self.type()
        while self.take(","):
            self.type()

    def type_arguments(self) -> None:
        self.want("<")
        self.types()
        self.angle()

    def type(self) -> None:
        if self.said("asserts") and self.t[self.i + 1] in ("ID", "this") and not self.fresh[self.i + 1]:
            self.i += 2
            if self.said("is"):
                self.i += 1
                self.type()
            return
        if self.t[self.i] in ("ID", "this") and self.t[self.i + 1] == "ID" and self.word(self.i + 1) == "is" and not self.fresh[self.i + 1]:
            self.i += 2
            self.type()
            return
        self.union()
        if self.t[self.i] == "extends" and not self.fresh[self.i]:
            self.i += 1
            self.union()
            self.want("?")
            self.type()
            self.want(":")
            self.type()

    def union(self) -> None:
        self.take("|") or self.take("&")
        self.operator_type()
        while self.t[self.i] in ("|", "&"):
            self.i += 1
            self.operator_type()

    def operator_type(self) -> None:
        if self.t[self.i] == "ID" and self.word() in ("keyof", "unique", "readonly", "infer") and self.t[self.i + 1] not in (",", ")", ">", ";", "=", "|", "&", "]", "}"):
            self.i += 1
            self.operator_type()
            return
        self.primary_type()
        while self.t[self.i] == "[" and not self.fresh[self.i]:
            self.i += 1
            if self.t[self.i] != "]":
                self.type()
            self.want("]")

    def function_type(self) -> None:
        self.generics()
        self.parameters()
        self.want("=>")
        self.type()

    def primary_type(self) -> None:
        t = self.t[self.i]
        if t == "new" or self.said("abstract") and self.t[self.i + 1] == "new":
            self.i += 1 if t == "new" else 2
            self.function_type()
        elif t == "(" and self.t[self.close[self.i] + 1] == "=>" or t == "<":
            self.function_type()
        elif t == "(":
            self.i += 1
            self.type()
            self.want(")")
        elif t == "{":
            self.object_type()
        elif t == "[":
            self.i += 1

            def element() -> None:
                self.take("...")
                if self.t[self.i] == "ID" and self.t[self.i + 1] in (":", "?") and self.t[self.i + 2] not in (",", "]"):
                    self.i += 1
                    self.take("?")
                    self.want(":")
                self.type()
                self.take("?")

            self.listed("]", element)
        elif t in ("STR", "NUM", "true", "false", "null", "void", "this"):
            self.i += 1
        elif t == "-":
            self.i += 1
            self.want("NUM")
        elif t == "typeof" or t == "import":
            self.i += 1
            if t == "import" or self.take("import"):
                self.skip()
            else:
                self.name()
            while self.take("."):
                self.name()
            if self.t[self.i] == "<":
                self.type_arguments()
        elif t == "ID":
            self.i += 1
            while self.take("."):
                self.name()
            if self.t[self.i] == "<" and not self.fresh[self.i]:
                self.type_arguments()
        else:
            raise self.fail("type wanted, not")

    def object_type(self) -> None:
        self.want("{")
        while self.t[self.i] != "}":
            if self.t[self.i] in ("+", "-"):
                self.i += 1
            while self.t[self.i] == "ID" and self.word() in ("readonly", "get", "set") and self.t[self.i + 1] in ("ID", "[", "STR"):
                self.i += 1
            if self.t[self.i] == "new":
                self.i += 1
            if self.t[self.i] in ("(", "<"):
                self.signature()
            else:
                if self.take("["):
                    self.want("ID")
                    if self.take(":"):
                        self.type()
                    elif self.take("in"):
                        self.type()
                        if self.said("as"):
                            self.i += 1
                            self.type()
                    self.want("]")
                elif self.t[self.i] in ("STR", "NUM"):
                    self.i += 1
                else:
                    self.name()
                if self.t[self.i] in ("+", "-"):
                    self.i += 1
                self.take("?")
                if self.t[self.i] in ("(", "<"):
                    self.signature()
                elif self.take(":"):
                    self.type()
            if not (self.take(";") or self.take(",")) and self.t[self.i] != "}" and not self.fresh[self.i]:
                raise self.fail()
        self.want("}")

    # expressions
    def grouped(self) -> None:
        self.want("(")
        self.sequence()
        self.want(")")

    def sequence(self) -> None:
        self.assignment()
        while self.take(","):
            self.assignment()

    def arrow(self) -> None:
        self.generics()
        if self.t[self.i] == "(":
            self.parameters()
            if self.take(":"):
                self.type()
        else:
            self.want("ID")
        if self.fresh[self.i]:
            raise self.fail()
        self.want("=>")
        if self.t[self.i] == "{":
            self.block()
        else:
            self.assignment()

    def assignment(self, _in: bool = True) -> str:
        t = self.t[self.i]
        at = self.i
        if self.said("async") and not self.fresh[self.i + 1] and self.t[self.i + 1] in ("ID", "(", "<"):
            self.i += 1
            if self.t[self.i] == "ID" and self.t[self.i + 1] == "=>" or self.t[self.i] == "(" and self.t[self.close[self.i] + 1] in ("=>", ":") or self.t[self.i] == "<":
                if self.tried(self.arrow):
                    return "value"
            self.i = at
        if t == "ID" and self.t[self.i + 1] == "=>" or t == "(" and self.t[self.close[self.i] + 1] == "=>":
            self.arrow()
            return "value"
        if (t == "(" and self.t[self.close[self.i] + 1] == ":" or t == "<") and self.tried(self.arrow):
            return "value"
        if self.said("yield") and self.t[self.i + 1] not in ("=", ".", "(", ")", ",", ";"):
            self.i += 1
            self.take("*")
            if self.t[self.i] not in (")", "]", "}", ",", ";", "END") and not self.fresh[self.i]:
                self.assignment()
            return "value"
        kind = self.ternary()
        if self.t[self.i] in self.ASSIGN or self.t[self.i] == ">" and self.t[self.i + 1] == ">=":
            if kind not in ("name", "pattern"):
                raise self.fail("variable wanted before")
            self.i += 1
            self.assignment()
            return "assign"
        return kind

    def ternary(self) -> str:
        kind = self.binary()
        if self.t[self.i] == "?":
            self.i += 1
            self.assignment()
            self.want(":")
            self.assignment()
            return "value"
        return kind

    def binary(self) -> str:
        kind = self.unary()
        while True:
            t = self.t[self.i]
            if t == "ID" and not self.fresh[self.i] and self.word() in ("as", "satisfies"):
                self.i += 1
                if not self.take("const"):
                    self.type()
                kind = "name"
            elif t in self.BINARY:
                self.i += 1
                while t == ">" and self.t[self.i] == ">":
                    self.i += 1
                self.unary()
                kind = "value"
            else:
                return kind

    def unary(self) -> str:
        t = self.t[self.i]
        if t in self.UNARY or t == "ID" and self.word() == "await" and (self.t[self.i + 1] in ("ID", "(", "[", "{", "new", "this", "STR", "import", "function", "super") and not self.fresh[self.i + 1]):
            self.i += 1
            self.unary()
            return "value"
        if t in ("++", "--"):
            self.i += 1
            self.unary()
            return "value"
        if t == "<":

            def cast() -> None:
                self.want("<")
                if not self.take("const"):
                    self.type()
                self.angle()
                self.unary()

            if self.tried(cast):
                return "value"
        kind = self.postfix()
        if self.t[self.i] in ("++", "--") and not self.fresh[self.i]:
            self.i += 1
            return "value"
        return kind

    def arguments(self) -> None:
        self.want("(")

        def one() -> None:
            self.take("...")
            self.assignment()

        self.listed(")", one)

    def postfix(self) -> str:
        kind = self.primary()
        while True:
            t = self.t[self.i]
            if t == ".":
                self.i += 1
                self.name()
                kind = "name"
            elif t == "?.":
                self.i += 1
                if self.t[self.i] == "(":
                    self.arguments()
                elif self.take("["):
                    self.sequence()
                    self.want("]")
                else:
                    self.name()
                kind = "value"
            elif t == "[":
                self.i += 1
                self.sequence()
                self.want("]")
                kind = "name"
            elif t == "(":
                self.arguments()
                kind = "value"
            elif t == "!" and not self.fresh[self.i]:
                self.i += 1
            elif t == "STR" and self.k.text[self.k.start[self.i]] == "`":
                self.i += 1
                kind = "value"
            elif t == "<":

                def generic() -> None:
                    self.type_arguments()
                    if self.t[self.i] not in ("(", "STR", ")", "]", ";", ",", ".", "?."):
                        raise self.fail()

                if not self.tried(generic):
                    return kind
                kind = "value"
            else:
                return kind

    def primary(self) -> str:
        t = self.t[self.i]
        if t == "ID":
            if self.word() == "async" and self.t[self.i + 1] == "function" and not self.fresh[self.i + 1]:
                self.i += 1
                self.function(False)
                return "value"
            self.i += 1
            return "name"
        if t in ("NUM", "STR", "true", "false", "null", "this", "super"):
            self.i += 1
            return "value"
        if t == "(":
            self.grouped()
            return "name"
        if t == "[":
            self.i += 1
            while self.t[self.i] != "]":
                if self.take(","):
                    continue
                self.take("...")
                self.assignment()
                if not self.take(","):
                    break
            self.want("]")
            return "pattern"
        if t == "{":
            self.i += 1
            self.listed("}", self.property)
            return "pattern"
        if t == "function":
            self.i += 1
            self.take("*")
            self.take("ID")
            self.signature()
            self.block()
            return "value"
        if t == "class":
            self.klass()
            return "value"
        if t == "new":
            self.i += 1
            if self.take("."):
                self.name()
                return "value"
            if self.t[self.i] == "new":
                self.primary()
            else:
                self.primary()
                while self.t[self.i] in (".", "["):
                    if self.take("."):
                        self.name()
                    else:
                        self.i += 1
                        self.sequence()
                        self.want("]")
                if self.t[self.i] == "<":
                    self.tried(self.type_arguments)
            if self.t[self.i] == "(":
                self.arguments()
            return "value"
        if t == "import":
            self.i += 1
            if self.take("."):
                self.name()
            elif self.t[self.i] != "(":
                raise self.fail()
            return "value"
        raise self.fail("expression wanted, not")

    def property(self) -> None:
        if self.take("..."):
            self.assignment()
            return
        while self.t[self.i] == "ID" and self.word() in ("async", "get", "set") and (self.t[self.i + 1] in ("ID", "STR", "NUM", "[", "*") or self.t[self.i + 1].isalpha() and self.t[self.i + 1] != "END"):
            self.i += 1
        self.take("*")
        short = self.t[self.i] == "ID"
        self.key()
        if self.take(":"):
            self.assignment()
        elif self.t[self.i] in ("(", "<"):
            self.signature()
            self.block()
        elif short:
            if self.take("="):
                self.assignment()
        else:
            raise self.fail()


# --- Rust --------------------------------------------------------------------
class Rust(Parser):
    language = "rust"
    BINARY = frozenset("|| && == != < > <= >= | ^ & << + - * / %".split())
    ASSIGN = frozenset("= += -= *= /= %= ^= &= |= <<= >>=".split())
    BLOCKS = frozenset("if match loop while for unsafe {".split())
    STARTS = frozenset("ID NUM STR CHR LIFE ( [ { - ! * & && | || move if match loop while for unsafe return break continue true false self Self super crate < .. ..= :: async const static yield".split())

    def file(self) -> None:
        self.inner()
        while self.t[self.i] != "END":
            self.item()

    def inner(self) -> None:
        while self.t[self.i] == "#" and self.t[self.i + 1] == "!":
            self.i += 2
            if self.t[self.i] != "[":
                raise self.fail()
            self.skip()

    def attributes(self) -> None:
        while self.t[self.i] == "#":
            self.i += 1
            if self.t[self.i] != "[":
                raise self.fail("[ wanted, not")
            self.skip()

    def visibility(self) -> None:
        if self.take("pub") and self.t[self.i] == "(" and self.t[self.i + 1] in ("crate", "self", "super", "in"):
            self.skip()

    def is_item(self) -> bool:
        t, u = self.t[self.i], self.t[self.i + 1]
        if t in ("fn", "struct", "enum", "impl", "trait", "mod", "use", "type", "static", "pub", "extern"):
            return True
        if t == "const":
            return u in ("ID", "fn", "unsafe", "mut") or u == "async"
        if t == "unsafe":
            return u in ("fn", "impl", "trait", "extern", "mod")
        if t == "async":
            return u in ("fn", "unsafe")
        if t == "ID":
            w = self.word()
            return w == "macro_rules" and u == "!" or w == "union" and u == "ID"
        return False

    def item(self) -> None:
        self.attributes()
        if self.t[self.i] == "ID" and self.t[self.i + 1] in ("!", "::") and not self.is_item():
            self.path()
            self.want("!")
            self.take("ID")
            brace = self.t[self.i] == "{"
            self.skip()
            if not brace:
                self.want(";")
            return
        if not self.is_item():
            raise self.fail()
        self.visibility()
        t = self.t[self.i]
        if t == "ID" and self.word() == "macro_rules":
            self.i += 2
            self.want("ID")
            brace = self.t[self.i] == "{"
            self.skip()
            if not brace:
                self.want(";")
            return
        while t in ("const", "async", "unsafe", "extern") and self.t[self.i + 1] in ("fn", "async", "unsafe", "extern", "impl", "trait", "STR", "mod"):
            self.i += 1
            if t == "extern":
                self.take("STR")
            t = self.t[self.i]
        if t == "fn":
            self.function()
        elif t == "struct" or t == "ID" and self.word() == "union":
            self.i += 1
            self.want("ID")
            self.generics()
            if self.t[self.i] == "(":
                self.tuple_fields()
                self.where()
                self.want(";")
            else:
                self.where()
                if not self.take(";"):
                    self.fields()
        elif t == "enum":
            self.i += 1
            self.want("ID")
            self.generics()
            self.where()
            self.want("{")

            def variant() -> None:
                self.attributes()
                self.want("ID")
                if self.t[self.i] == "(":
                    self.tuple_fields()
                elif self.t[self.i] == "{":
                    self.fields()
                if self.take("="):
                    self.expression()

            self.listed("}", variant)
        elif t == "impl":
            self.i += 1
            if self.t[self.i] == "<":
                self.generics()
            self.take("!")
            self.type()
            if self.take("for"):
                self.type()
            self.where()
            self.members()
        elif t == "trait":
            self.i += 1
            self.want("ID")
            self.generics()
            if self.take(":"):
                self.bounds()
            self.where()
            if self.take("="):
                self.bounds()
                self.want(";")
            else:
                self.members()
        elif t == "mod":
            self.i += 1
            self.want("ID")
            if not self.take(";"):
                self.want("{")
                self.inner()
                while self.t[self.i] != "}":
                    self.item()
                self.want("}")
        elif t == "use":
            self.i += 1
            self.use_tree()
            self.want(";")
        elif t == "type":
            self.i += 1
            self.want("ID")
            self.generics()
            if self.take(":"):
                self.bounds()
            self.where()
            if self.take("="):
                self.type()
            self.where()
            self.want(";")
        elif t in ("static", "const"):
            self.i += 1
            self.take("mut")
            self.want("ID")
            self.want(":")
            self.type()
            if self.take("="):
                self.expression()
            self.want(";")
        elif t == "extern":
            self.i += 1
            if self.take("crate"):
                if not self.take("self"):
                    self.want("ID")
                if self.take("as"):
                    self.want("ID")
                self.want(";")
            else:
                self.take("STR")
                self.members()
        elif t == "{" and self.t[self.i - 1] in ("STR", "extern"):
            self.members()
        else:
            raise self.fail()

    def members(self) -> None:
        self.want("{")
        self.inner()
        while self.t[self.i] != "}":
            self.item()
        self.want("}")

    def use_tree(self) -> None:
        self.take("::")
        while True:
            if self.take("{"):
                self.listed("}", self.use_tree)
                return
            if self.take("*"):
                return
            if self.t[self.i] in ("ID", "self", "super", "crate", "Self"):
                self.i += 1
            else:
                raise self.fail()
            if not self.take("::"):
                break
        if self.take("as"):
            self.want("ID")

    def tuple_fields(self) -> None:
        self.want("(")

        def one() -> None:
            self.attributes()
            self.visibility()
            self.type()

        self.listed(")", one)

    def fields(self) -> None:
        self.want("{")

        def one() -> None:
            self.attributes()
            self.visibility()
            self.want("ID")
            self.want(":")
            self.type()

        self.listed("}", one)

    def generics(self) -> None:
        if not self.take("<"):
            return
        while self.t[self.i] not in (">",):
            self.attributes()
            if self.take("LIFE"):
                if self.take(":"):
                    while self.take("LIFE"):
                        self.take("+")
            elif self.take("const"):
                self.want("ID")
                self.want(":")
                self.type()
                if self.take("="):
                    self.postfix(False)
            else:
                self.want("ID")
                if self.take(":"):
                    self.bounds()
                if self.take("="):
                    self.type()
            if not self.take(","):
                break
        self.angle()

    def where(self) -> None:
        if self.take("where"):
            while self.t[self.i] not in ("{", ";", "="):
                if self.take("LIFE"):
                    self.want(":")
                    while self.take("LIFE"):
                        self.take("+")
                else:
                    self.for_lifetimes()
                    self.type()
                    self.want(":")
                    self.bounds()
                if not self.take(","):
                    break

    def for_lifetimes(self) -> None:
        if self.t[self.i] == "for" and self.t[self.i + 1] == "<":
            self.i += 1
            self.generics()

    def bounds(self) -> None:
        while self.t[self.i] not in ("{", ",", "=", ">", ";", ")", "where", ">>", ">=", "]", "|"):
            if self.take("LIFE"):
                pass
            elif self.take("("):
                self.bounds()
                self.want(")")
            else:
                self.take("?")
                self.for_lifetimes()
                self.path(True)
            if not self.take("+"):
                break

    def function(self) -> None:
        self.want("fn")
        self.want("ID")
        self.generics()
        self.want("(")

        def one() -> None:
            self.attributes()
            if self.take("..."):
                return
            at = self.i
            if self.take("&"):
                self.take("LIFE")
            self.take("mut")
            if self.take("self"):
                if self.take(":"):
                    self.type()
                return
            self.i = at
            self.pattern(False)
            self.want(":")
            if not self.take("..."):
                self.type()

        self.listed(")", one)
        if self.take("->"):
            self.type()
        self.where()
        if not self.take(";"):
            self.block()

    def type(self) -> None:
        t = self.t[self.i]
        if t in ("&", "&&"):
            self.i += 1
            self.take("LIFE")
            self.take("mut")
            self.type_no_bounds()
        else:
            self.type_no_bounds()
            while self.take("+"):
                if not self.take("LIFE"):
                    self.take("?")
                    self.path(True)

    def type_no_bounds(self) -> None:
        t = self.t[self.i]
        if t in ("&", "&&"):
            self.type()
        elif t == "*":
            self.i += 1
            if self.t[self.i] not in ("const", "mut"):
                raise self.fail()
            self.i += 1
            self.type_no_bounds()
        elif t == "(":
            self.i += 1
            self.listed(")", self.type)
        elif t == "[":
            self.i += 1
            self.type()
            if self.take(";"):
                self.expression()
            self.want("]")
        elif t == "!":
            self.i += 1
        elif t in ("impl", "dyn"):
            self.i += 1
            self.bounds()
        elif t in ("fn", "unsafe", "extern", "for"):
            self.for_lifetimes()
            self.take("unsafe")
            if self.take("extern"):
                self.take("STR")
            self.want("fn")
            self.want("(")

            def one() -> None:
                if self.t[self.i] == "ID" and self.t[self.i + 1] == ":":
                    self.i += 2
                self.type()

            self.listed(")", one)
            if self.take("->"):
                self.type_no_bounds()
        elif t == "<":
            self.qualified()
        else:
            self.path(True)
            if self.t[self.i] == "!":
                self.i += 1
                self.skip()

    def qualified(self) -> None:
        self.want("<")
        self.type()
        if self.take("as"):
            self.path(True)
        self.angle()
        while self.take("::"):
            self.segment(True)

    def segment(self, types: bool) -> None:
        if self.t[self.i] not in ("ID", "self", "Self", "super", "crate"):
            raise self.fail("name wanted, not")
        self.i += 1
        if types:
            if self.t[self.i] == "::" and self.t[self.i + 1] == "<":
                self.i += 1
            if self.t[self.i] == "<":
                self.type_arguments()
            elif self.t[self.i] == "(" and self.word(self.i - 1) in ("Fn", "FnMut", "FnOnce"):
                self.i += 1
                self.listed(")", self.type)
                if self.take("->"):
                    self.type_no_bounds()

    def type_arguments(self) -> None:
        self.want("<")
        while self.t[self.i] not in (">", ">>", ">=", ">>="):
            if self.take("LIFE"):
                pass
            elif self.t[self.i] in ("NUM", "STR", "CHR", "true", "false", "-"):
                self.take("-")
                self.i += 1
            elif self.t[self.i] == "{":
                self.block()
            elif self.t[self.i] == "ID" and self.t[self.i + 1] in ("=", ":"):
                self.i += 1
                if self.take("="):
                    self.type()
                else:
                    self.i += 1
                    self.bounds()
            else:
                self.type()
            if not self.take(","):
                break
        self.angle()

    def path(self, types: bool = False) -> None:
        self.take("::")
        if self.t[self.i] == "<":
            self.qualified()
            return
        while True:
            self.segment(types)
            if self.t[self.i] == "::" and self.t[self.i + 1] == "<":
                self.i += 1
                self.type_arguments()
            if self.t[self.i] == "::" and self.t[self.i + 1] in ("ID", "self", "Self", "super", "crate"):
                self.i += 1
            else:
                return

    def pattern(self, alternatives: bool = True) -> None:
        if alternatives:
            self.take("|")
        self.one_pattern()
        while alternatives and self.take("|"):
            self.one_pattern()

    def one_pattern(self) -> None:
        t = self.t[self.i]
        if t in ("&", "&&"):
            self.i += 1
            self.take("mut")
            self.one_pattern()
        elif t in ("ref", "mut"):
            self.i += 1
            self.take("mut")
            self.want("ID")
            if self.take("@"):
                self.one_pattern()
        elif t in ("(", "["):
            self.i += 1
            self.listed(")" if t == "(" else "]", self.pattern)
        elif t in ("..", "..=", "..."):
            self.i += 1
            if self.t[self.i] in ("NUM", "CHR", "STR", "-", "ID"):
                self.literal()
        elif t in ("NUM", "CHR", "STR", "true", "false", "-"):
            self.literal()
            self.range_end()
        elif t == "ID" and self.t[self.i + 1] == "@":
            self.i += 2
            self.one_pattern()
        elif t in ("ID", "self", "Self", "super", "crate", "::", "<"):
            self.path()
            t = self.t[self.i]
            if t == "!":
                self.i += 1
                self.skip()
            elif t == "(":
                self.i += 1
                self.listed(")", self.pattern)
            elif t == "{":
                self.i += 1

                def field() -> None:
                    self.attributes()
                    if self.take(".."):
                        return
                    self.take("ref")
                    self.take("mut")
                    if not self.take("NUM"):
                        self.want("ID")
                    if self.take(":"):
                        self.pattern()

                self.listed("}", field)
            else:
                self.range_end()
        else:
            raise self.fail("pattern wanted, not")

    def literal(self) -> None:
        self.take("-")
        if self.t[self.i] in ("NUM", "CHR", "STR", "true", "false"):
            self.i += 1
        else:
            self.path()

    def range_end(self) -> None:
        if self.t[self.i] in ("..=", "..", "..."):
            self.i += 1
            if self.t[self.i] in ("NUM", "CHR", "STR", "-", "ID", "crate", "self", "Self"):
                self.literal()

    def block(self) -> None:
        self.want("{")
        self.inner()
        while self.t[self.i] != "}":
            self.statement()
        self.want("}")

    def statement(self) -> None:
        if self.take(";"):
            return
        self.attributes()
        t = self.t[self.i]
        if t == "let":
            self.i += 1
            self.pattern()
            if self.take(":"):
                self.type()
            if self.take("="):
                self.expression()
                if self.take("else"):
                    self.block()
            self.want(";")
            return
        if self.is_item():
            self.item()
            return
        if t in self.BLOCKS or t == "LIFE" or t == "async" and self.t[self.i + 1] in ("{", "move"):
            at = self.i
            self.blocklike()
            if self.t[self.i] not in (".", "?"):
                self.take(";")
                return
            self.i = at
        if t == "ID" and self.t[self.i + 1] == "!" and self.t[self.i + 2] == "{":
            self.i += 2
            self.skip()
            if self.t[self.i] not in (".", "?"):
                self.take(";")
                return
            self.i -= 0
            while self.t[self.i] in (".", "?"):
                self.suffix()
        else:
            self.expression()
        if self.t[self.i] != "}":
            self.want(";")

    def blocklike(self) -> None:
        if self.take("LIFE"):
            self.want(":")
        t = self.t[self.i]
        if t == "if":
            self.i += 1
            self.condition()
            self.block()
            if self.take("else"):
                if self.t[self.i] == "if":
                    self.blocklike()
                else:
                    self.block()
        elif t == "match":
            self.i += 1
            self.expression(False)
            self.want("{")
            self.inner()
            while self.t[self.i] != "}":
                self.attributes()
                self.pattern()
                if self.take("if"):
                    self.condition(True)
                self.want("=>")
                block = self.t[self.i] in self.BLOCKS
                self.expression()
                if not self.take(",") and self.t[self.i] != "}" and not (block and self.t[self.i - 1] == "}"):
                    raise self.fail()
            self.want("}")
        elif t == "loop":
            self.i += 1
            self.block()
        elif t == "while":
            self.i += 1
            self.condition()
            self.block()
        elif t == "for":
            self.i += 1
            self.pattern()
            self.want("in")
            self.expression(False)
            self.block()
        elif t in ("unsafe", "async", "const"):
            self.i += 1
            self.take("move")
            self.block()
        else:
            self.block()

    def condition(self, structs: bool = False) -> None:
        while True:
            if self.take("let"):
                self.pattern()
                self.want("=")
                self.binary(structs, chain=False)
            else:
                self.expression(structs, chain=False)
            if not self.take("&&"):
                return

    def expression(self, structs: bool = True, chain: bool = True) -> None:
        t = self.t[self.i]
        if t in ("return", "break", "continue") or t == "ID" and self.word() == "yield" and self.t[self.i + 1] in self.STARTS:
            self.i += 1
            if t in ("break", "continue"):
                self.take("LIFE")
            if t != "continue" and self.t[self.i] in self.STARTS and not (self.t[self.i] == "{" and not structs):
                self.expression(structs)
            return
        if t in ("..", "..="):
            self.i += 1
            if self.t[self.i] in self.STARTS and not (self.t[self.i] == "{" and not structs):
                self.binary(structs)
            return
        self.binary(structs, chain)
        t = self.t[self.i]
        if t in ("..", "..="):
            self.i += 1
            if self.t[self.i] in self.STARTS and not (self.t[self.i] == "{" and not structs):
                self.binary(structs)
        elif t in self.ASSIGN or t == ">" and self.t[self.i + 1] == ">=":
            if t == ">":
                self.i += 1
            self.i += 1
            self.expression(structs)

    def binary(self, structs: bool, chain: bool = True) -> None:
        self.unary(structs)
        while True:
            t = self.t[self.i]
            if t == "as":
                self.i += 1
                self.type_no_bounds()
            elif t in self.BINARY and not (t == "&&" and not chain and self.t[self.i + 1] == "let"):
                if t == ">" and self.t[self.i + 1] == ">=":
                    return
                self.i += 1
                if t == ">" and self.t[self.i] == ">":
                    self.i += 1
                if self.t[self.i] in ("return", "break", "continue"):
                    self.expression(structs)
                    return
                self.unary(structs)
            else:
                return

    def unary(self, structs: bool) -> None:
        while True:
            t = self.t[self.i]
            if t in ("-", "!", "*"):
                self.i += 1
            elif t in ("&", "&&"):
                self.i += 1
                if self.t[self.i] == "ID" and self.word() == "raw" and self.t[self.i + 1] in ("const", "mut"):
                    self.i += 2
                self.take("mut")
            else:
                break
        self.postfix(structs)

    def suffix(self) -> None:
        if self.take("?"):
            return
        self.want(".")
        if self.take("await") or self.take("NUM"):
            return
        self.want("ID")
        if self.t[self.i] == "::":
            self.i += 1
            self.type_arguments()
        if self.t[self.i] == "(":
            self.i += 1
            self.listed(")", self.expression)

    def postfix(self, structs: bool) -> None:
        self.primary(structs)
        while True:
            t = self.t[self.i]
            if t in ("?", "."):
                self.suffix()
            elif t == "(":
                self.i += 1
                self.listed(")", self.expression)
            elif t == "[":
                self.i += 1
                self.expression()
                self.want("]")
            else:
                return

    def primary(self, structs: bool) -> None:
        t = self.t[self.i]
        if t in ("NUM", "STR", "CHR", "true", "false"):
            self.i += 1
        elif t in self.BLOCKS or t == "LIFE":
            self.blocklike()
        elif t == "(":
            self.i += 1
            self.listed(")", self.expression)
        elif t == "[":
            self.i += 1
            if not self.take("]"):
                self.expression()
                if self.take(";"):
                    self.expression()
                else:
                    while self.take(",") and self.t[self.i] != "]":
                        self.expression()
                self.want("]")
        elif t in ("|", "||", "move", "static") or t == "async" and self.t[self.i + 1] in ("|", "||", "move") and self.t[self.i + 2] != "{":
            while self.t[self.i] in ("move", "async", "static"):
                self.i += 1
            if not self.take("||"):
                self.want("|")

                def one() -> None:
                    self.attributes()
                    self.pattern(False)
                    if self.take(":"):
                        self.type()

                self.listed("|", one)
            if self.take("->"):
                self.type_no_bounds()
                self.block()
            else:
                self.expression(structs)
        elif t in ("async", "const"):
            self.blocklike()
        elif t in ("ID", "self", "Self", "super", "crate", "::", "<"):
            self.path()
            if self.t[self.i] == "!" and self.t[self.i + 1] in ("(", "[", "{"):
                self.i += 1
                self.skip()
            elif self.t[self.i] == "{" and structs and self.is_struct():
                self.want("{")

                def field() -> None:
                    self.attributes()
                    if self.take(".."):
                        if self.t[self.i] != "}":
                            self.expression()
                        return
                    if not self.take("NUM"):
                        self.want("ID")
                    if self.take(":"):
                        self.expression()

                self.listed("}", field)
        elif t in ("return", "break", "continue"):
            self.expression(structs)
        else:
            raise self.fail("expression wanted, not")

    def is_struct(self) -> bool:
        a, b = self.t[self.i + 1], self.t[self.i + 2]
        return a == "}" or a == ".." or a == "#" or a in ("ID", "NUM") and b in (":", ",", "}")


PARSERS = {"go": Go, "java": Java, "ts": Ts, "rust": Rust}
LANGUAGES = ("python", *PARSERS)
#: Calls of the parsers one within another, tens of thousands of nested brackets; they take no stack of the machine. Compilers refuse less.
MAX_FRAMES = 1_000_000


def python_fails(text: str) -> str | None:
    """Why a text is not Python 3; None if it is."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text.removeprefix("﻿"))
    except SyntaxError as e:
        return str(e.msg)
    except ValueError as e:
        return str(e)
    except RecursionError:
        return None  # parsed; only its tree is too deep to be built
    except MemoryError:
        return "nested deeper than the interpreter takes"
    return None


#: Tokens of a text's beginning by which most foreign grammars are ruled out.
BEGINNING = 40


def begins_wrong(language: str, text: str) -> str | None:
    """Why a text's first tokens alone, whatever follows, are not of a brace language; None if that can't be told.

    The parser reads from left to right, so where it fails without having read
    up to the end of the beginning, it fails alike on the whole text.
    """
    parser = None
    try:
        parser = PARSERS[language](text, BEGINNING)
        parser.file()
    except Fail as e:
        return str(e) if parser is None or parser.t.most < BEGINNING - 8 else None
    except (RecursionError, IndexError):
        return None
    return None


def parses(text: str, language: str) -> bool:
    """Whether a text is of a language, asked of texts that mostly aren't."""
    return (language == "python" or begins_wrong(language, text) is None) and fails(language, text) is None


def fails(language: str, text: str) -> str | None:
    """Why a text is not of the language; None if it is."""
    if language == "python":
        return python_fails(text)
    limit = sys.getrecursionlimit()
    try:
        sys.setrecursionlimit(max(limit, MAX_FRAMES))
        parser = PARSERS[language](text)
        parser.file()
        if parser.i != len(parser.t) - ENDS:
            raise parser.fail()
    except Fail as e:
        return str(e)
    except IndexError:
        return "unexpected END"
    except RecursionError:
        return "nested deeper than compilers take"
    finally:
        sys.setrecursionlimit(limit)
    return None
