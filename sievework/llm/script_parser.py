"""A recognising parser for the script languages: recursive descent for statements and types, precedence climbing for
binary expressions, and panic-mode recovery, so that one pass reports every error of a file.

It builds no tree. The dialect says what the extension allows: ``typed`` (annotations), ``markup`` (elements in
expressions), and ``goal`` ("module", "script" for CommonJS, "either").
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass

EOF, NAME, NUM, STR, PUNCT, PRIVATE, BAD = 0, 2, 3, 4, 5, 6, 7

_IDENT = r"(?:[A-Za-z_$ª-\U0010ffff]|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]+\})(?:[\w$‌‍]|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]+\})*"
_TOKEN = re.compile(
    r"((?:[^\S\n]+|\n|﻿|//[^\n]*|/\*[\s\S]*?\*/)*)"
    rf"(?:({_IDENT})"
    r"|((?:0[xX][0-9A-Fa-f](?:_?[0-9A-Fa-f])*|0[bB][01](?:_?[01])*|0[oO][0-7](?:_?[0-7])*)n?|\d(?:_?\d)*n|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?)"
    r"|(\"(?:[^\"\\\n\r]|\\\r\n|\\[\s\S])*\"|'(?:[^'\\\n\r]|\\\r\n|\\[\s\S])*')"
    r"|(>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@`])"
    rf"|(#{_IDENT})"
    r"|([\s\S]))?"
)
_REGEX = re.compile(r"/(?![*/])((?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\\\]\n\r]|\\[^\n\r])*\])+)/([A-Za-z]*)")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_ELEMENT_TEXT = re.compile(r"[^<{}>]*")
_ELEMENT_STRING = re.compile(r"\s*(?:\"[^\"]*\"|'[^']*')")
_ELEMENT_NAME = re.compile(r"[\w$.\-:]*")
_DASHED = re.compile(r"[\w$\-]*")
_AFTER_NUMBER = re.compile(r"[\w$]")

RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
)
_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
_PREFIX = frozenset(["!", "~", "+", "-", "++", "--", "typeof", "void", "delete"])
_MODIFIERS = frozenset("public private protected readonly static abstract override declare async accessor".split())
_SYNC = frozenset("const let var function class if for while switch try return import export interface type enum".split())
_AFTER_TYPE_ARGS = frozenset("( ` ) ] : ; , . ?. == === != !== && || ?? ^ & | } >".split())


class ParseError(Exception):
    def __init__(self, at: int, message: str):
        super().__init__(message)
        self.at, self.message = at, message


@dataclass(frozen=True)
class Dialect:
    typed: bool = False
    markup: bool = False
    goal: str = "either"
    ambient: bool = False


DIALECTS = {
    "ts": Dialect(typed=True, goal="module"),
    "tsx": Dialect(typed=True, markup=True, goal="module"),
    "js": Dialect(),
    "jsx": Dialect(markup=True),
    "mjs": Dialect(goal="module"),
    "cjs": Dialect(goal="script"),
}


class Parser:
    """One file. ``errors`` holds (offset, message) in order of discovery."""

    def __init__(self, text: str, dialect: Dialect, most_errors: int = 1_000_000):
        self.text, self.d = text, dialect
        self.typed, self.markup = dialect.typed, dialect.markup
        self.errors: list[tuple[int, str]] = []
        self.most = most_errors
        self.match = _TOKEN.match
        # context flags: function kind and what encloses the position
        self.is_async = self.is_gen = False
        self.in_fn = 0
        self.loops = self.switches = 0
        self.labels: list[str] = []
        self.no_in = False
        self.in_class_field = False
        self.ambient = dialect.ambient
        self.no_arrow_type = False
        self.logical = 0
        pos = 0
        if text.startswith("﻿"):
            pos = 1
        if text.startswith("#!", pos):
            end = text.find("\n", pos)
            pos = len(text) if end < 0 else end
        self.e = pos
        self.t = PUNCT
        self.v = ""
        self.s = pos
        self.nl = True
        self.last = pos
        try:
            self.next()
        except ParseError as x:
            self.note(x)
            self.v = ""
            if not self.recover():
                self.t = EOF

    # ---- tokens

    def next(self) -> None:
        self.last = self.e
        m = self.match(self.text, self.e)
        k = m.lastindex
        gap = m.group(1)
        self.nl = bool(gap) and "\n" in gap
        if k == 1 or k is None:
            self.t, self.v, self.s, self.e = EOF, "", m.end(1), m.end(1)
            return
        self.t, self.v = k, m.group(k)
        self.s, self.e = m.start(k), m.end(k)
        if k == PUNCT:
            if self.v == "/" and self.text.startswith("*", self.e):
                raise ParseError(self.s, "unterminated comment")
        elif k == NUM:
            if _AFTER_NUMBER.match(self.text, self.e) or (self.v[0] == "0" and len(self.v) > 1 and self.v[1].isdigit() and self.d.goal == "module"):
                raise ParseError(self.s, "malformed number")
        elif k == BAD:
            raise ParseError(self.s, "unterminated string" if self.v in "\"'" else f"unexpected character {self.v!r}")

    def save(self):
        return (self.t, self.v, self.s, self.e, self.nl, self.last)

    def restore(self, state) -> None:
        self.t, self.v, self.s, self.e, self.nl, self.last = state

    def fail(self, message: str = ""):
        raise ParseError(self.s, message or (f"unexpected {self.v!r}" if self.t != EOF else "unexpected end of file"))

    def at(self, v: str) -> bool:
        return self.v == v and (self.t == PUNCT or self.t == NAME)

    def eat(self, v: str) -> bool:
        if self.v == v and (self.t == PUNCT or self.t == NAME):
            self.next()
            return True
        return False

    def want(self, v: str) -> None:
        if self.v == v and (self.t == PUNCT or self.t == NAME):
            self.next()
        else:
            self.fail(f"expected {v!r} before {self.v!r}" if self.t != EOF else f"expected {v!r} before end of file")

    def peek(self) -> tuple[int, str, bool]:
        m = self.match(self.text, self.e)
        k = m.lastindex
        return (EOF, "", "\n" in m.group(1)) if k == 1 or k is None else (k, m.group(k), "\n" in m.group(1))

    def semicolon(self) -> None:
        if self.t == PUNCT and self.v == ";":
            self.next()
        elif not (self.nl or self.t == EOF or (self.t == PUNCT and self.v == "}")):
            self.fail(f"expected ';' before {self.v!r}")

    def identifier(self) -> None:
        if self.t != NAME or self.v in RESERVED:
            self.fail()
        if self.v == "await" and (self.is_async or (self.d.goal == "module" and not self.ambient)) or self.v == "yield" and self.is_gen:
            self.fail()
        self.next()

    def close_angle(self) -> None:
        if self.t == PUNCT and self.v[0] == ">":
            self.e = self.s + 1
            self.next()
        else:
            self.fail("expected '>'")

    # ---- program and recovery

    def parse(self) -> list[tuple[int, str]]:
        while True:
            try:
                while self.t != EOF:
                    self.statement(top=True)
                break
            except ParseError as x:
                self.note(x)
            if len(self.errors) >= self.most or not self.recover():
                break
        return self.errors

    def note(self, x: ParseError) -> None:
        self.errors.append((x.at, x.message))

    def recover(self) -> bool:
        """Panic mode: skips to the next line that begins a statement, or past a semicolon or brace."""
        self.is_async = self.is_gen = self.no_in = self.in_class_field = False
        self.in_fn = self.loops = self.switches = 0
        self.labels = []
        while True:
            try:
                before = self.e
                if self.t == EOF:
                    return False
                self.next()
                if self.t == EOF:
                    return False
                if self.nl and self.t == NAME and self.v in _SYNC:
                    return True
                if self.t == PUNCT and self.v in (";", "}"):
                    self.next()
                    return True
            except ParseError:
                self.e = max(before + 1, self.e)
                self.t = PUNCT
                if self.e >= len(self.text):
                    return False

    # ---- statements

    def statement(self, top: bool = False, single: bool = False) -> None:
        t, v = self.t, self.v
        if t == PUNCT:
            if v == "{":
                self.block()
                return
            if v == ";":
                self.next()
                return
            if v == "@":
                self.decorators()
                if self.at("export"):
                    self.export()
                else:
                    self.eat("abstract") if self.typed else None
                    self.klass(True)
                return
        elif t == NAME:
            rule = _STATEMENTS.get(v)
            if rule is not None:
                if rule(self, top, single):
                    return
            elif self.typed and v in _TYPED_STATEMENTS and not single and self.typed_statement():
                return
            if v not in RESERVED and v not in ("await", "yield"):
                k, w, _ = self.peek()
                if k == PUNCT and w == ":":
                    self.next()
                    self.next()
                    self.labels.append(v)
                    self.statement(single=single)
                    self.labels.pop()
                    return
        self.expression()
        self.semicolon()

    def block(self) -> None:
        self.want("{")
        while not (self.t == PUNCT and self.v == "}"):
            if self.t == EOF:
                self.fail("expected '}' before end of file")
            self.statement()
        self.next()

    def s_var(self, top: bool, single: bool) -> bool:
        if self.v == "let":
            k, w, nl = self.peek()
            if not (k == NAME and w not in ("in", "instanceof", "of") or k == PUNCT and w in ("[", "{")):
                return False
        if self.v != "var" and single:
            self.fail("declaration needs a block")
        const = self.v == "const"
        self.next()
        if const and self.at("enum") and self.typed:
            self.enum()
            return True
        self.declarators(const)
        self.semicolon()
        return True

    def declarators(self, const: bool, in_for: bool = False) -> None:
        while True:
            pattern = self.t == PUNCT
            self.binding()
            if self.typed:
                if self.t == PUNCT and self.v == "!":
                    self.next()
                if self.t == PUNCT and self.v == ":":
                    self.next()
                    self.type()
            if self.t == PUNCT and self.v == "=":
                self.next()
                self.assignment()
            elif (const or pattern) and not self.ambient and not (in_for and (self.at("of") or self.at("in"))):
                self.fail("declaration needs a value")
            if not (self.t == PUNCT and self.v == ","):
                return
            self.next()

    def binding(self) -> None:
        if self.t == PUNCT and self.v == "{":
            self.next()
            while not self.at("}"):
                if self.eat("..."):
                    self.identifier()
                else:
                    plain = self.t == NAME
                    name = self.v
                    self.property_name()
                    if self.eat(":"):
                        self.binding()
                    elif not plain or name in RESERVED:
                        self.fail()
                    if self.eat("="):
                        self.with_in(self.assignment)
                if not self.at("}"):
                    self.want(",")
            self.next()
        elif self.t == PUNCT and self.v == "[":
            self.next()
            while not self.at("]"):
                if self.at(","):
                    self.next()
                    continue
                rest = self.eat("...")
                self.binding()
                if not rest and self.eat("="):
                    self.with_in(self.assignment)
                if not self.at("]"):
                    self.want(",")
            self.next()
        else:
            self.identifier()

    def with_in(self, rule):
        kept, self.no_in = self.no_in, False
        try:
            return rule()
        finally:
            self.no_in = kept

    def s_if(self, top: bool, single: bool) -> bool:
        self.next()
        self.want("(")
        self.expression()
        self.want(")")
        self.statement(single=True)
        if self.eat("else"):
            self.statement(single=True)
        return True

    def s_for(self, top: bool, single: bool) -> bool:
        self.next()
        if self.at("await"):
            if not (self.is_async or not self.in_fn and self.d.goal != "script"):
                self.fail()
            self.next()
        self.want("(")
        kept, self.no_in = self.no_in, True
        iterates = False
        if self.at(";"):
            pass
        elif self.t == NAME and (self.v in ("var", "const") or self.v == "let" and self.peek()[0] in (NAME, PUNCT) and self.peek()[1] not in ("=", ";", ".", "(", "in", "of")):
            const = self.v == "const"
            self.next()
            self.declarators(const, True)
            iterates = True
        else:
            iterates = True
            self.expression()
        self.no_in = kept
        if iterates and self.at("of"):
            self.next()
            self.assignment()
        elif iterates and self.at("in"):
            self.next()
            self.expression()
        else:
            self.want(";")
            if not self.at(";"):
                self.expression()
            self.want(";")
            if not self.at(")"):
                self.expression()
        self.want(")")
        self.loop_body()
        return True

    def loop_body(self) -> None:
        self.loops += 1
        self.statement(single=True)
        self.loops -= 1

    def s_while(self, top: bool, single: bool) -> bool:
        self.next()
        self.want("(")
        self.expression()
        self.want(")")
        self.loop_body()
        return True

    def s_do(self, top: bool, single: bool) -> bool:
        self.next()
        self.loop_body()
        self.want("while")
        self.want("(")
        self.expression()
        self.want(")")
        self.eat(";")
        return True

    def s_jump(self, top: bool, single: bool) -> bool:
        is_break = self.v == "break"
        self.next()
        if self.t == NAME and not self.nl and self.v not in RESERVED:
            if self.v not in self.labels:
                self.fail(f"unknown label {self.v!r}")
            self.next()
        elif not (self.loops or is_break and self.switches):
            raise ParseError(self.last, "jump outside of a loop")
        self.semicolon()
        return True

    def s_return(self, top: bool, single: bool) -> bool:
        if not self.in_fn and self.d.goal == "module":
            self.fail("return outside of a function")
        self.next()
        if not (self.nl or self.t == EOF or self.at(";") or self.at("}")):
            self.expression()
        self.semicolon()
        return True

    def s_throw(self, top: bool, single: bool) -> bool:
        self.next()
        if self.nl:
            self.fail("line break after throw")
        self.expression()
        self.semicolon()
        return True

    def s_try(self, top: bool, single: bool) -> bool:
        self.next()
        self.block()
        if self.eat("catch"):
            if self.eat("("):
                self.binding()
                if self.typed and self.eat(":"):
                    self.type()
                self.want(")")
            self.block()
            if self.eat("finally"):
                self.block()
        else:
            self.want("finally")
            self.block()
        return True

    def s_switch(self, top: bool, single: bool) -> bool:
        self.next()
        self.want("(")
        self.expression()
        self.want(")")
        self.want("{")
        self.switches += 1
        seen_default = False
        while not self.at("}"):
            if self.eat("case"):
                self.expression()
            elif self.at("default") and not seen_default:
                seen_default = True
                self.next()
            else:
                self.fail()
            self.want(":")
            while not (self.at("case") or self.at("default") or self.at("}")):
                if self.t == EOF:
                    self.fail("expected '}' before end of file")
                self.statement()
        self.next()
        self.switches -= 1
        return True

    def s_function(self, top: bool, single: bool) -> bool:
        self.function(declared=True)
        return True

    def s_async(self, top: bool, single: bool) -> bool:
        k, w, nl = self.peek()
        if k == NAME and w == "function" and not nl:
            self.next()
            self.function(declared=True, is_async=True)
            return True
        return False

    def s_class(self, top: bool, single: bool) -> bool:
        self.klass(True)
        return True

    def s_debugger(self, top: bool, single: bool) -> bool:
        self.next()
        self.semicolon()
        return True

    def s_with(self, top: bool, single: bool) -> bool:
        if self.d.goal == "module":
            self.fail("with in a module")
        self.next()
        self.want("(")
        self.expression()
        self.want(")")
        self.statement(single=True)
        return True

    def s_import(self, top: bool, single: bool) -> bool:
        k, w, _ = self.peek()
        if k == PUNCT and w in ("(", "."):
            return False
        if not top and not self.ambient or self.d.goal == "script":
            self.fail("import declaration outside of a module's top level")
        self.next()
        if self.t == STR:
            self.next()
            self.attributes()
            self.semicolon()
            return True
        if self.typed and self.at("type"):
            k, w, _ = self.peek()
            if k == PUNCT and w in ("{", "*") or k == NAME and w != "from":
                self.next()
        named = False
        if self.t == NAME:
            self.identifier()
            named = True
            if self.typed and self.eat("="):
                self.expression()
                self.semicolon()
                return True
            if not self.eat(","):
                self.from_clause(True)
                return True
        if self.eat("*"):
            self.want("as")
            self.identifier()
        elif self.at("{"):
            self.specifiers(True)
        else:
            self.fail()
        self.from_clause(True)
        return True

    def from_clause(self, needed: bool) -> None:
        if not needed and not self.at("from"):
            self.semicolon()
            return
        self.want("from")
        if self.t != STR:
            self.fail()
        self.next()
        self.attributes()
        self.semicolon()

    def attributes(self) -> None:
        if (self.at("with") or self.at("assert")) and not self.nl:
            self.next()
            self.object_literal()

    def specifiers(self, is_import: bool) -> None:
        self.want("{")
        while not self.at("}"):
            if self.typed and self.at("type"):
                k, w, _ = self.peek()
                if k in (NAME, STR) and w != "as":
                    self.next()
            if self.t not in (NAME, STR):
                self.fail()
            reserved = self.t == STR or self.v in RESERVED and self.v != "default"
            first = self.v
            self.next()
            if self.eat("as"):
                if is_import:
                    self.identifier()
                elif self.t in (NAME, STR):
                    self.next()
                else:
                    self.fail()
            elif is_import and (reserved or first == "default"):
                self.fail()
            if not self.at("}"):
                self.want(",")
        self.next()

    def s_export(self, top: bool, single: bool) -> bool:
        if not top and not self.ambient or self.d.goal == "script":
            self.fail("export outside of a module's top level")
        self.export()
        return True

    def export(self) -> None:
        self.want("export")
        if self.eat("default"):
            if self.at("@"):
                self.decorators()
            if self.at("function"):
                self.function(declared=True, anonymous=True)
            elif self.at("async") and self.peek()[1] == "function" and not self.peek()[2]:
                self.next()
                self.function(declared=True, is_async=True, anonymous=True)
            elif self.at("class") or self.typed and self.at("abstract") and self.peek()[1] == "class":
                self.eat("abstract")
                self.klass(False)
            elif self.typed and self.at("interface") and self.peek()[0] == NAME:
                self.typed_statement()
            else:
                self.assignment()
                self.semicolon()
            return
        if self.typed and self.at("type") and self.peek()[1] in ("{", "*"):
            self.next()
        if self.eat("*"):
            if self.eat("as"):
                if self.t not in (NAME, STR):
                    self.fail()
                self.next()
            self.from_clause(True)
            return
        if self.at("{"):
            self.specifiers(False)
            self.from_clause(False)
            return
        if self.typed and self.eat("="):
            self.expression()
            self.semicolon()
            return
        if self.typed and self.at("as"):
            self.next()
            self.want("namespace")
            self.identifier()
            self.semicolon()
            return
        if self.at("@"):
            self.decorators()
        if self.t == NAME and self.v in ("const", "let", "var", "function", "class"):
            self.statement(top=True)
        elif self.at("async") and self.peek()[1] == "function":
            self.statement(top=True)
        elif self.typed and self.t == NAME and self.v == "import":
            self.s_import(True, False)
        elif self.typed and self.t == NAME and self.v in _TYPED_STATEMENTS and self.typed_statement():
            pass
        else:
            self.fail()

    def decorators(self) -> None:
        while self.eat("@"):
            if self.eat("("):
                self.expression()
                self.want(")")
            else:
                self.identifier()
                while self.eat("."):
                    self.next() if self.t in (NAME, PRIVATE) else self.fail()
                if self.at("("):
                    self.arguments()

    # ---- functions and classes

    def function(self, declared: bool, is_async: bool = False, anonymous: bool = False) -> None:
        self.want("function")
        is_gen = self.eat("*")
        if self.t == NAME and self.v not in RESERVED:
            self.next()
        elif declared and not anonymous:
            self.fail()
        self.signature_and_body(is_async, is_gen, bodiless=declared)

    def signature_and_body(self, is_async: bool, is_gen: bool, bodiless: bool = False) -> None:
        kept = (self.is_async, self.is_gen, self.in_fn, self.loops, self.switches, self.labels, self.no_in, self.in_class_field)
        self.is_async, self.is_gen, self.loops, self.switches, self.labels, self.no_in, self.in_class_field = is_async, is_gen, 0, 0, [], False, False
        self.in_fn += 1
        if self.typed and self.at("<"):
            self.type_parameters()
        self.parameters()
        if self.typed and self.eat(":"):
            self.type(returns=True)
        if self.at("{"):
            self.block()
        elif bodiless and self.typed:
            self.semicolon()
        else:
            self.want("{")
        self.is_async, self.is_gen, self.in_fn, self.loops, self.switches, self.labels, self.no_in, self.in_class_field = kept

    def parameters(self) -> None:
        self.want("(")
        while not (self.t == PUNCT and self.v == ")"):
            self.parameter()
            if not (self.t == PUNCT and self.v == ")"):
                self.want(",")
        self.next()

    def parameter(self) -> None:
        if self.at("@"):
            self.decorators()
        if self.typed:
            while self.t == NAME and self.v in ("public", "private", "protected", "readonly", "override") and self.peek()[1] not in (",", ")", ":", "=", "?"):
                self.next()
            if self.at("this"):
                self.next()
                self.want(":")
                self.type()
                return
        rest = self.eat("...")
        self.binding()
        if self.typed:
            self.eat("?")
            if self.eat(":"):
                self.type()
        if not rest and self.eat("="):
            self.with_in(self.assignment)
        if rest and not self.at(")"):
            self.fail("rest parameter must be last")

    def klass(self, named: bool) -> None:
        self.want("class")
        if self.t == NAME and self.v not in ("extends", "implements"):
            self.identifier()
        elif named:
            self.fail()
        if self.typed and self.at("<"):
            self.type_parameters()
        if self.eat("extends"):
            self.unary_postfix()
            if self.typed and self.at("<"):
                self.type_arguments()
        if self.typed and self.eat("implements"):
            self.type()
            while self.eat(","):
                self.type()
        self.want("{")
        while not (self.t == PUNCT and self.v == "}"):
            if self.t == EOF:
                self.fail("expected '}' before end of file")
            if not self.eat(";"):
                self.member()
        self.next()

    def member(self) -> None:
        if self.at("@"):
            self.decorators()
        is_async = is_gen = False
        accessor = False
        ends = ("(", "=", ";", "}", ":", "?", "!", "<", ",")
        allowed = _MODIFIERS if self.typed else ("static", "async", "accessor")
        while self.t == NAME:
            k, w, nl = self.peek()
            if k == PUNCT and w in ends or k == EOF:
                break
            if self.v in ("get", "set") and not nl and (k in (NAME, STR, NUM, PRIVATE) or w == "["):
                accessor = True
                self.next()
                break
            if self.v in allowed:
                if self.v == "static" and w == "{":
                    self.next()
                    kept = (self.is_async, self.in_fn)
                    self.is_async, self.in_fn = False, self.in_fn
                    self.block()
                    self.is_async, self.in_fn = kept
                    return
                if nl and self.v in ("async",):
                    break
                is_async = is_async or self.v == "async"
                self.next()
                continue
            break
        if self.eat("*"):
            is_gen = True
        if self.typed and self.at("[") and self.index_signature():
            self.member_end()
            return
        name = self.v
        self.property_name(private=True)
        if self.typed:
            if not self.eat("?"):
                self.eat("!")
        if self.at("(") or self.typed and self.at("<"):
            self.signature_and_body(is_async, is_gen, bodiless=True)
            return
        if is_gen or accessor or is_async:
            self.fail()
        del name
        if self.typed and self.eat(":"):
            self.type()
        if self.eat("="):
            kept = (self.is_async, self.is_gen, self.in_class_field)
            self.is_async, self.is_gen, self.in_class_field = False, False, True
            self.assignment()
            self.is_async, self.is_gen, self.in_class_field = kept
        self.member_end()

    def member_end(self) -> None:
        if not self.eat(";") and not (self.nl or self.at("}")):
            self.fail()

    def index_signature(self) -> bool:
        state = self.save()
        try:
            self.next()
            self.identifier()
            if not self.eat(":"):
                raise ParseError(self.s, "")
        except ParseError:
            self.restore(state)
            return False
        self.type()
        self.want("]")
        if self.eat(":"):
            self.type()
        return True

    def property_name(self, private: bool = False) -> None:
        if self.t in (NAME, STR, NUM) or private and self.t == PRIVATE:
            self.next()
        elif self.t == PUNCT and self.v == "[":
            self.next()
            self.with_in(self.assignment)
            self.want("]")
        else:
            self.fail()

    # ---- expressions

    def expression(self) -> None:
        self.assignment()
        while self.t == PUNCT and self.v == ",":
            self.next()
            self.assignment()

    def assignment(self) -> None:
        t, v = self.t, self.v
        if t == NAME:
            if v == "yield" and self.is_gen:
                self.next()
                if not self.nl and not (self.t == PUNCT and self.v in (")", "]", "}", ",", ";", ":") or self.t == EOF):
                    self.eat("*")
                    self.assignment()
                return
            k, w, nl = self.peek()
            if k == PUNCT and w == "=>" and v not in RESERVED and not nl:
                self.next()
                self.arrow_body(False)
                return
            if v == "async" and not nl:
                if k == NAME and w not in RESERVED and w not in ("of", "as", "satisfies"):
                    self.next()
                    self.next()
                    if not self.at("=>"):
                        self.fail()
                    self.arrow_body(True)
                    return
                if k == PUNCT and (w == "(" or w == "<" and self.typed) and self.try_arrow(True):
                    return
        elif t == PUNCT:
            if v == "(":
                if self.try_arrow(False):
                    return
            elif v == "<" and self.typed and not (self.markup and not self.generic_arrow_ahead()):
                if self.try_arrow(False):
                    return
        target = self.conditional()
        if self.t == PUNCT and self.v in _ASSIGN:
            if not target:
                self.fail("invalid assignment target")
            self.next()
            self.assignment()

    def generic_arrow_ahead(self) -> bool:
        """In a file with markup, a type parameter list is told by a comma or a bound."""
        return bool(re.compile(r"<\s*(?:const\s+)?[\w$]+\s*(?:,|extends\b)").match(self.text, self.s))

    def try_arrow(self, is_async: bool) -> bool:
        """Reads an arrow function if there is one here; else the position stays."""
        if not self.arrow_ahead(is_async):
            return False
        state = self.save()
        kept = (self.is_async, self.is_gen)
        try:
            if is_async:
                self.next()
                self.is_async = True
            if self.typed and self.at("<"):
                self.type_parameters()
            self.parameters()
            if self.typed and not self.no_arrow_type and self.eat(":"):
                self.type(returns=True)
            if not self.at("=>") or self.nl:
                raise ParseError(self.s, "")
        except ParseError as x:
            self.is_async, self.is_gen = kept
            self.restore(state)
            if not x.message or self.typed or self.t == PUNCT:
                return False
            raise
        self.is_async, self.is_gen = kept
        self.arrow_body(is_async)
        return True

    def arrow_ahead(self, is_async: bool) -> bool:
        """A cheap look for what can follow the opening parenthesis of an arrow function's parameters."""
        if self.typed and (self.v == "<" or is_async):
            return True
        at = self.e
        if is_async:
            at = self.text.find("(", at) + 1
        m = self.match(self.text, at)
        k, w = m.lastindex, m.group(m.lastindex) if m.lastindex else ""
        if k == PUNCT:
            return w in (")", "{", "[", "...", "@")
        if k != NAME or w in RESERVED and w != "this":
            return False
        m = self.match(self.text, m.end())
        k, w = m.lastindex, m.group(m.lastindex) if m.lastindex else ""
        return k == PUNCT and w in (",", ")", ":", "?", "=")  or k == NAME

    def arrow_body(self, is_async: bool) -> None:
        self.want("=>")
        if self.at("{"):
            kept = (self.is_async, self.is_gen, self.in_fn, self.loops, self.switches, self.labels, self.no_in)
            self.is_async, self.is_gen, self.loops, self.switches, self.labels, self.no_in = is_async, False, 0, 0, [], False
            self.in_fn += 1
            self.block()
            self.is_async, self.is_gen, self.in_fn, self.loops, self.switches, self.labels, self.no_in = kept
        else:
            kept = (self.is_async, self.is_gen, self.in_fn)
            self.is_async, self.is_gen = is_async, False
            self.in_fn += 1
            self.assignment()
            self.is_async, self.is_gen, self.in_fn = kept

    def conditional(self) -> bool:
        target = self.binary(0)
        if self.t == PUNCT and self.v == "?":
            self.next()
            state = self.save() if self.typed else None
            try:
                self.with_in(self.assignment)
                self.want(":")
            except ParseError:
                if state is None or self.no_arrow_type:
                    raise
                # what seemed the return type of an arrow function may be the other branch
                self.restore(state)
                self.no_arrow_type = True
                try:
                    self.with_in(self.assignment)
                    self.want(":")
                finally:
                    self.no_arrow_type = False
            self.assignment()
            return False
        return target

    def binary(self, least: int) -> bool:
        """Precedence climbing; tells whether what was read can be assigned to."""
        if self.t == PRIVATE:
            self.next()
            if not self.at("in"):
                self.fail()
            target = False
        else:
            target = self.unary()
        mixed = 0
        while True:
            v = self.v
            if self.t == PUNCT:
                level = _BINARY.get(v)
                if level is None or level <= least:
                    self.logical = mixed
                    return target
            elif self.t == NAME:
                if v == "instanceof" or v == "in" and not self.no_in:
                    level = 8
                    if level <= least:
                        self.logical = mixed
                        return target
                elif self.typed and v in ("as", "satisfies") and not self.nl:
                    if least >= 8:
                        self.logical = mixed
                        return target
                    self.next()
                    if not self.eat("const"):
                        self.type()
                    continue
                else:
                    self.logical = mixed
                    return target
            else:
                self.logical = mixed
                return target
            if level <= 3:
                kind = 1 if level == 1 else 2
                if mixed and mixed != kind:
                    self.fail("?? mixed with || or &&")
                mixed = kind
            self.next()
            self.binary(level - 1 if v == "**" else level)
            if level == 1 and self.logical == 2:
                self.fail("?? mixed with || or &&")
            target = False

    def unary(self) -> bool:
        t, v = self.t, self.v
        if (t == PUNCT or t == NAME) and v in _PREFIX:
            self.next()
            target = self.unary()
            if v in ("++", "--") and not target:
                self.fail("invalid update target")
            if self.at("**") and v not in ("++", "--"):
                self.fail("unary operator before **")
            return False
        if t == NAME and v == "await":
            if self.is_async or not self.in_fn and self.d.goal != "script" and not self.in_class_field:
                self.next()
                self.unary()
                return False
            if self.d.goal == "module":
                self.fail("await outside of an async function")
        elif t == PUNCT and v == "<":
            if self.markup:
                self.element()
                return False
            if self.typed:
                self.next()
                if not self.eat("const"):
                    self.type()
                self.close_angle()
                self.unary()
                return False
        return self.unary_postfix(update=True)

    def unary_postfix(self, update: bool = False) -> bool:
        target = self.primary()
        optional = False
        while True:
            v = self.v
            if self.t == PUNCT:
                if v == ".":
                    self.next()
                    if self.t != NAME and self.t != PRIVATE:
                        self.fail()
                    self.next()
                    target = not optional
                    continue
                if v == "(":
                    self.arguments()
                    target = False
                    continue
                if v == "[":
                    self.next()
                    self.with_in(self.expression)
                    self.want("]")
                    target = not optional
                    continue
                if v == "?.":
                    optional, target = True, False
                    self.next()
                    if self.at("("):
                        self.arguments()
                    elif self.at("["):
                        self.next()
                        self.with_in(self.expression)
                        self.want("]")
                    elif self.t == NAME or self.t == PRIVATE:
                        self.next()
                    elif self.t == PUNCT and self.v == "<" and self.typed:
                        self.type_arguments()
                    else:
                        self.fail()
                    continue
                if v == "`":
                    self.template()
                    target = False
                    continue
                if v == "!" and self.typed and not self.nl:
                    self.next()
                    continue
                if v in ("<", "<<") and self.typed:
                    state = self.save()
                    try:
                        if v == "<<":
                            raise ParseError(self.s, "")
                        self.type_arguments()
                        if not (self.t == EOF or self.t == PUNCT and self.v in _AFTER_TYPE_ARGS or self.nl):
                            raise ParseError(self.s, "")
                        target = False
                        continue
                    except ParseError:
                        self.restore(state)
                        return target
                if v in ("++", "--") and update and not self.nl:
                    if not target:
                        self.fail("invalid update target")
                    self.next()
                    return False
            return target

    def arguments(self) -> None:
        self.want("(")
        kept, self.no_in = self.no_in, False
        while not (self.t == PUNCT and self.v == ")"):
            if self.t == PUNCT and self.v == "...":
                self.next()
            self.assignment()
            if not (self.t == PUNCT and self.v == ")"):
                self.want(",")
        self.next()
        self.no_in = kept

    def primary(self) -> bool:
        t, v = self.t, self.v
        if t == NAME:
            if v == "function":
                self.function(declared=False)
                return False
            if v == "async":
                k, w, nl = self.peek()
                if k == NAME and w == "function" and not nl:
                    self.next()
                    self.function(declared=False, is_async=True)
                    return False
            elif v == "class":
                self.klass(False)
                return False
            elif v == "new":
                self.new()
                return False
            elif v == "this" or v == "null" or v == "true" or v == "false":
                self.next()
                return False
            elif v == "super":
                self.next()
                if not (self.at("(") or self.at(".") or self.at("[")):
                    self.fail()
                return False
            elif v == "import":
                self.next()
                if self.eat("."):
                    if not self.at("meta") or self.d.goal == "script":
                        self.fail()
                    self.next()
                elif not self.at("("):
                    self.fail()
                return False
            elif v in RESERVED:
                self.fail()
            self.identifier()
            return True
        if t == NUM or t == STR:
            self.next()
            return False
        if t == PUNCT:
            if v == "(":
                self.next()
                kept, self.no_in = self.no_in, False
                target = self.assignment_target_list()
                self.no_in = kept
                self.want(")")
                return target
            if v == "[":
                self.next()
                kept, self.no_in = self.no_in, False
                while not (self.t == PUNCT and self.v == "]"):
                    if self.t == PUNCT and self.v == ",":
                        self.next()
                        continue
                    if self.t == PUNCT and self.v == "...":
                        self.next()
                    self.assignment()
                    if not (self.t == PUNCT and self.v == "]"):
                        self.want(",")
                self.next()
                self.no_in = kept
                return True
            if v == "{":
                self.object_literal()
                return True
            if v == "`":
                self.template()
                return False
            if v == "/" or v == "/=":
                m = _REGEX.match(self.text, self.s)
                if not m:
                    self.fail("unterminated regular expression")
                flags = m.group(2)
                if len(set(flags)) != len(flags) or set(flags) - set("dgimsuvy"):
                    self.fail("invalid regular expression flags")
                self.e = m.end()
                self.next()
                return False
            if v == "@":
                self.decorators()
                self.klass(False)
                return False
        self.fail()
        return False

    def assignment_target_list(self) -> bool:
        start = self.t
        single = self.t == NAME
        self.assignment()
        while self.eat(","):
            single = False
            self.assignment()
        return single and start == NAME

    def new(self) -> None:
        self.next()
        if self.eat("."):
            if not self.at("target") or not self.in_fn and not self.in_class_field:
                self.fail()
            self.next()
            return
        if self.at("new"):
            self.new()
        elif self.at("import"):
            self.fail()
        else:
            self.primary()
        while True:
            if self.at("."):
                self.next()
                if self.t not in (NAME, PRIVATE):
                    self.fail()
                self.next()
            elif self.at("["):
                self.next()
                self.expression()
                self.want("]")
            elif self.at("`"):
                self.template()
            else:
                break
        if self.typed and self.at("<"):
            state = self.save()
            try:
                self.type_arguments()
            except ParseError:
                self.restore(state)
        if self.at("("):
            self.arguments()

    def object_literal(self) -> None:
        self.want("{")
        kept, self.no_in = self.no_in, False
        while not (self.t == PUNCT and self.v == "}"):
            if self.t == PUNCT and self.v == "...":
                self.next()
                self.assignment()
            else:
                self.property()
            if not (self.t == PUNCT and self.v == "}"):
                self.want(",")
        self.next()
        self.no_in = kept

    def property(self) -> None:
        is_async = is_gen = accessor = False
        if self.t == NAME and self.v in ("get", "set", "async"):
            k, w, nl = self.peek()
            if k in (NAME, STR, NUM) or k == PUNCT and w in ("[", "*"):
                is_async = self.v == "async"
                accessor = not is_async
                self.next()
        if self.t == PUNCT and self.v == "*":
            is_gen = True
            self.next()
        plain, name = self.t == NAME, self.v
        self.property_name()
        if self.t == PUNCT and self.v == "(" or self.typed and self.at("<"):
            self.signature_and_body(is_async, is_gen)
            return
        if is_async or is_gen or accessor:
            self.fail()
        if self.t == PUNCT and self.v == ":":
            self.next()
            self.assignment()
        elif plain and name not in RESERVED:
            if self.t == PUNCT and self.v == "=":
                self.next()
                self.assignment()
        else:
            self.fail()

    def template(self) -> None:
        text = self.text
        at = self.e
        opened = self.s
        while True:
            at = _TEMPLATE.match(text, at).end()
            if at >= len(text):
                raise ParseError(opened, "unterminated template")
            if text[at] == "`":
                self.e = at + 1
                self.next()
                return
            if text[at] != "$":
                raise ParseError(opened, "unterminated template")
            self.e = at + 2
            self.next()
            self.with_in(self.expression)
            if not (self.t == PUNCT and self.v == "}"):
                self.fail("expected '}' in template")
            at = self.e

    # ---- elements

    def element(self) -> None:
        """An element from its '<' on; afterwards the token behind it is current."""
        self.e = self.element_at(self.s)
        self.next()

    def _space(self, at: int) -> int:
        m = re.compile(r"(?:\s+|//[^\n]*|/\*[\s\S]*?\*/)*").match(self.text, at)
        return m.end()

    def _need(self, at: int, what: str) -> int:
        if not self.text.startswith(what, at):
            raise ParseError(at, f"expected {what!r} in element")
        return at + len(what)

    def _braced(self, at: int, empty: bool) -> int:
        """An expression in braces that begins at ``at``; returns the offset behind the closing brace."""
        self.e = at + 1
        self.next()
        if self.at("}") and empty:
            return self.e
        if self.at("..."):
            self.next()
        self.with_in(self.expression)
        if not self.at("}"):
            self.fail("expected '}' in element")
        return self.e

    def element_at(self, at: int) -> int:
        text = self.text
        start = at
        at = self._space(at + 1)
        name_end = _ELEMENT_NAME.match(text, at).end()
        name = text[at:name_end]
        at = name_end
        if name and not (name[0].isalpha() or name[0] in "_$"):
            raise ParseError(start, "malformed element name")
        if self.typed and text.startswith("<", at):
            self.e = at
            self.next()
            self.type_arguments()
            at = self.s
        if not name:
            at = self._need(self._space(at), ">")
        else:
            while True:
                at = self._space(at)
                if at >= len(text):
                    raise ParseError(start, "unterminated element")
                c = text[at]
                if c == "/":
                    return self._need(self._space(at + 1), ">")
                if c == ">":
                    at += 1
                    break
                if c == "{":
                    at = self._braced(at, False)
                    continue
                end = _ELEMENT_NAME.match(text, at).end()
                if end == at or not (c.isalpha() or c in "_$"):
                    raise ParseError(at, f"unexpected {c!r} in element")
                at = self._space(end)
                if text.startswith("=", at):
                    at = self._space(at + 1)
                    m = _ELEMENT_STRING.match(text, at)
                    if m:
                        at = m.end()
                    elif text.startswith("{", at):
                        at = self._braced(at, False)
                    elif text.startswith("<", at):
                        at = self.element_at(at)
                    else:
                        raise ParseError(at, "malformed attribute")
        while True:
            at = _ELEMENT_TEXT.match(text, at).end()
            if at >= len(text):
                raise ParseError(start, f"element {name!r} is not closed")
            c = text[at]
            if c == "{":
                at = self._braced(at, True)
            elif c == "<":
                inside = self._space(at + 1)
                if text.startswith("/", inside):
                    inside = self._space(inside + 1)
                    end = _ELEMENT_NAME.match(text, inside).end()
                    if text[inside:end] != name:
                        raise ParseError(at, f"element {name!r} is closed by {text[inside:end]!r}")
                    return self._need(self._space(end), ">")
                at = self.element_at(at)
            else:
                raise ParseError(at, f"unexpected {c!r} in element text")

    # ---- types

    def type_parameters(self) -> None:
        self.want("<")
        while True:
            while self.t == NAME and self.v in ("const", "in", "out") and self.peek()[0] == NAME:
                self.next()
            self.identifier()
            if self.eat("extends"):
                self.type()
            if self.eat("="):
                self.type()
            if not self.eat(",") or self.t == PUNCT and self.v[0] == ">":
                break
        self.close_angle()

    def type_arguments(self) -> None:
        self.want("<")
        while True:
            self.type()
            if not self.eat(","):
                break
        self.close_angle()

    def type(self, returns: bool = False) -> None:
        if returns and self.t == NAME:
            k, w, nl = self.peek()
            if self.v == "asserts" and k == NAME and not nl and w != "is":
                self.next()
                self.next()
                if self.eat("is"):
                    self.type()
                return
            if k == NAME and w == "is" and not nl:
                self.next()
                self.next()
                self.type()
                return
        kept, self.no_in = self.no_in, False
        self.union()
        if self.at("extends") and not self.nl:
            self.next()
            self.union()
            self.want("?")
            self.type()
            self.want(":")
            self.type()
        self.no_in = kept

    def union(self) -> None:
        if self.t == PUNCT and self.v in ("|", "&"):
            self.next()
        self.type_operand()
        while self.t == PUNCT and self.v in ("|", "&"):
            self.next()
            self.type_operand()

    def type_operand(self) -> None:
        while self.t == NAME and self.v in ("keyof", "unique", "readonly", "infer"):
            k, w, _ = self.peek()
            if not (k in (NAME, STR, NUM) or k == PUNCT and w in ("{", "[", "(", "`")):
                break
            infer = self.v == "infer"
            self.next()
            if infer:
                self.identifier()
                state = self.save()
                if self.eat("extends"):
                    self.union()
                    if self.at("?"):
                        self.restore(state)
                return
        self.type_primary()
        while True:
            if self.t == PUNCT and self.v == "[" and not self.nl:
                self.next()
                if not self.eat("]"):
                    self.type()
                    self.want("]")
            else:
                return

    def type_primary(self) -> None:
        t, v = self.t, self.v
        if t == NAME:
            if v == "typeof":
                self.next()
                if self.at("import"):
                    self.import_type()
                    return
                self.next() if self.t == NAME else self.fail()
                while self.eat("."):
                    self.next() if self.t in (NAME, PRIVATE) else self.fail()
                if self.at("<") and not self.nl:
                    self.type_arguments()
                return
            if v == "import":
                self.import_type()
                return
            if v == "new" or v == "abstract" and self.peek()[1] == "new":
                self.eat("abstract")
                self.next()
                self.function_type()
                return
            if v in ("void", "null", "this", "true", "false", "undefined"):
                self.next()
                return
            if v in RESERVED:
                self.fail()
            self.next()
            while self.t == PUNCT and self.v == ".":
                self.next()
                self.next() if self.t == NAME else self.fail()
            if self.t == PUNCT and self.v == "<" and not self.nl:
                self.type_arguments()
            return
        if t == STR or t == NUM:
            self.next()
            return
        if t == PUNCT:
            if v == "-":
                self.next()
                self.next() if self.t == NUM else self.fail()
                return
            if v == "{":
                self.object_type()
                return
            if v == "[":
                self.next()
                while not self.at("]"):
                    self.eat("...")
                    if self.t == NAME and self.peek()[1] in (":", "?"):
                        state = self.save()
                        self.next()
                        self.eat("?")
                        if not self.eat(":"):
                            self.restore(state)
                    self.type()
                    self.eat("?")
                    if not self.at("]"):
                        self.want(",")
                self.next()
                return
            if v == "`":
                self.template_type()
                return
            if v == "<":
                self.function_type()
                return
            if v == "(":
                state = self.save()
                try:
                    self.function_type()
                    return
                except ParseError as x:
                    deepest = x
                self.restore(state)
                self.next()
                self.type()
                if not self.at(")"):
                    raise deepest
                self.next()
                return
        self.fail()

    def template_type(self) -> None:
        kept = self.expression
        self.expression = self.type  # holes of a template in type position hold types
        try:
            self.template()
        finally:
            self.expression = kept

    def import_type(self) -> None:
        self.want("import")
        self.want("(")
        if self.t != STR:
            self.fail()
        self.next()
        self.want(")")
        while self.eat("."):
            self.next() if self.t == NAME else self.fail()
        if self.at("<"):
            self.type_arguments()

    def function_type(self) -> None:
        if self.at("<"):
            self.type_parameters()
        self.parameters()
        self.want("=>")
        self.type(returns=True)

    def object_type(self) -> None:
        self.want("{")
        while not (self.t == PUNCT and self.v == "}"):
            self.type_member()
            if not (self.t == PUNCT and self.v == "}"):
                if not self.eat(";") and not self.eat(",") and not self.nl:
                    self.fail()
        self.next()

    def type_member(self) -> None:
        if self.t == PUNCT and self.v in ("+", "-"):
            self.next()
            self.want("readonly")
        elif self.at("readonly") and self.peek()[1] not in (":", "?", "(", ";", ",", "}"):
            self.next()
        if self.at("(") or self.at("<"):
            self.call_signature()
            return
        if self.at("new") and self.peek()[1] in ("(", "<"):
            self.next()
            self.call_signature()
            return
        if self.t == NAME and self.v in ("get", "set"):
            k, w, _ = self.peek()
            if k in (NAME, STR, NUM) or w == "[":
                self.next()
        if self.at("["):
            state = self.save()
            self.next()
            if self.t == NAME:
                k, w, _ = self.peek()
                if k == PUNCT and w == ":" or k == NAME and w == "in":
                    self.next()
                    self.next()
                    self.type()
                    if self.eat("as"):
                        self.type()
                    self.want("]")
                    if self.t == PUNCT and self.v in ("+", "-"):
                        self.next()
                    self.eat("?")
                    if self.eat(":"):
                        self.type()
                    return
            self.restore(state)
        self.property_name(private=False)
        self.eat("?")
        if self.at("(") or self.at("<"):
            self.call_signature()
        elif self.eat(":"):
            self.type()

    def call_signature(self) -> None:
        if self.at("<"):
            self.type_parameters()
        self.parameters()
        if self.eat(":"):
            self.type(returns=True)

    def typed_statement(self) -> bool:
        """Statements that only the typed dialects have; false if the word is an ordinary name here."""
        v = self.v
        k, w, nl = self.peek()
        if v == "interface":
            if k != NAME or nl:
                return False
            self.next()
            self.identifier()
            if self.at("<"):
                self.type_parameters()
            if self.eat("extends"):
                self.type()
                while self.eat(","):
                    self.type()
            self.object_type()
            return True
        if v == "type":
            if k != NAME or nl or w in RESERVED:
                return False
            self.next()
            self.identifier()
            if self.at("<"):
                self.type_parameters()
            self.want("=")
            self.type()
            self.semicolon()
            return True
        if v == "enum":
            self.enum()
            return True
        if v in ("namespace", "module"):
            if nl or not (k == NAME or k == STR and v == "module"):
                return False
            self.next()
            if self.t == STR:
                self.next()
            else:
                self.identifier()
                while self.eat("."):
                    self.identifier()
            self.module_body()
            return True
        if v == "abstract":
            if k != NAME or w != "class" or nl:
                return False
            self.next()
            self.klass(True)
            return True
        if v == "declare":
            if k != NAME or nl or w not in ("const", "let", "var", "function", "class", "interface", "type", "enum", "namespace", "module", "abstract", "global", "async"):
                return False
            self.next()
            kept, self.ambient = self.ambient, True
            if self.at("global"):
                self.next()
                self.module_body()
            else:
                self.statement(top=True)
            self.ambient = kept
            return True
        return False

    def module_body(self) -> None:
        if not self.at("{"):
            self.semicolon()
            return
        self.next()
        while not self.at("}"):
            if self.t == EOF:
                self.fail("expected '}' before end of file")
            self.statement(top=True)
        self.next()

    def enum(self) -> None:
        self.want("enum")
        self.identifier()
        self.want("{")
        while not self.at("}"):
            self.property_name()
            if self.eat("="):
                self.assignment()
            if not self.at("}"):
                self.want(",")
        self.next()


_TYPED_STATEMENTS = frozenset("interface type enum namespace module abstract declare".split())
_STATEMENTS = {
    "const": Parser.s_var, "let": Parser.s_var, "var": Parser.s_var, "if": Parser.s_if, "for": Parser.s_for, "while": Parser.s_while, "do": Parser.s_do,
    "break": Parser.s_jump, "continue": Parser.s_jump, "return": Parser.s_return, "throw": Parser.s_throw, "try": Parser.s_try, "switch": Parser.s_switch,
    "function": Parser.s_function, "async": Parser.s_async, "class": Parser.s_class, "debugger": Parser.s_debugger, "with": Parser.s_with, "import": Parser.s_import, "export": Parser.s_export,
}

def deep_enough(text: str) -> None:
    """Lets calls nest as deeply as a text can, so that no depth is an error. What nests takes a letter, and no letter more
    calls than this; frames of Python functions live on the heap."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000 + 40 * len(text)))


def script_errors(text: str, extension: str, path: str = "", most_errors: int = 1_000_000) -> list[tuple[int, str]]:
    """Errors of a script as (offset, message), in order; an empty list means that the file is valid."""
    dialect = DIALECTS[extension]
    if path.endswith(".d.ts"):
        dialect = Dialect(typed=True, goal="module", ambient=True)
    deep_enough(text)
    return Parser(text, dialect, most_errors).parse()
