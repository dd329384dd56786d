"""A tolerant recursive-descent parser for Solidity sources, in plain Python so that it runs anywhere an executor does.

Syntax is kept as nested dictionaries: ``k`` is the form, ``s`` and ``e`` are character offsets (half open). What can't be
read becomes a diagnostic and the parser goes on at the next plausible place.
"""

from __future__ import annotations

import re

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/|/\*.*\Z)
|(?P<str>(?:hex|unicode)?(?:"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'))
|(?P<num>0[xX][0-9a-fA-F_]+|(?:\d[\d_]*)?\.?\d[\d_]*(?:[eE]-?\d+)?)
|(?P<id>[A-Za-z_$][\w$]*)
|(?P<op>>>>=|>>>|<<=|>>=|\*\*|=>|->|:=|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|\|=|&=|\^=|<<|>>|[-+*/%=<>!~&|^?:;,.(){}\[\]])
|(?P<bad>.)""",
    re.S | re.X,
)
_ELEMENTARY = re.compile(r"^(?:address|bool|string|bytes\d*|byte|u?int\d*|u?fixed(?:\d+x\d+)?|var)$")
_UNITS = {"wei", "gwei", "szabo", "finney", "ether", "seconds", "minutes", "hours", "days", "weeks", "years"}
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "|=", "&=", "^=", "<<=", ">>=", ">>>="}
_BINARY = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 4, ">": 4, "<=": 4, ">=": 4, "|": 5, "^": 6, "&": 7, "<<": 8, ">>": 8, ">>>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10, "**": 11}
_LOCATIONS = {"memory", "storage", "calldata"}


class Trouble(Exception):
    def __init__(self, message: str, at: int):
        super().__init__(message)
        self.message, self.at = message, at


class Parser:
    def __init__(self, text: str):
        self.text = text
        self.toks: list[tuple[str, str, int, int]] = []
        for m in _TOKEN.finditer(text):
            if m.lastgroup != "skip":
                self.toks.append((m.lastgroup, m.group(), m.start(), m.end()))
        n = len(text)
        self.toks.append(("end", "", n, n))
        self.i = 0
        self.troubles: list[dict] = []

    # tokens
    @property
    def v(self) -> str:
        return self.toks[self.i][1]

    @property
    def kind(self) -> str:
        return self.toks[self.i][0]

    @property
    def at(self) -> int:
        return self.toks[self.i][2]

    @property
    def last(self) -> int:
        return self.toks[self.i - 1][3] if self.i else 0

    def ahead(self, n: int = 1) -> str:
        return self.toks[min(self.i + n, len(self.toks) - 1)][1]

    def take(self, *want: str) -> str | None:
        if self.kind not in ("str", "end") and self.v in want:
            self.i += 1
            return self.toks[self.i - 1][1]
        return None

    def need(self, want: str) -> str:
        if self.take(want) is None:
            raise Trouble(f"expected {want!r}, found {self.v!r}", self.at)
        return want

    def name(self) -> str:
        if self.kind != "id":
            raise Trouble(f"expected a name, found {self.v!r}", self.at)
        self.i += 1
        return self.toks[self.i - 1][1]

    def path(self) -> str:
        out = self.name()
        while self.v == "." and self.toks[self.i + 1][0] == "id":
            self.i += 1
            out += "." + self.name()
        return out

    def skip_balanced(self) -> None:
        """Past one bracketed group."""
        depth = 0
        while self.kind != "end":
            if self.kind == "op" and self.v in "([{":
                depth += 1
            elif self.kind == "op" and self.v in ")]}":
                depth -= 1
            self.i += 1
            if depth <= 0:
                return

    def recover(self) -> None:
        """To the end of the statement or group at hand."""
        while self.kind != "end" and self.v != "}":
            if self.v == "{":
                self.skip_balanced()
                return
            if self.v == ";":
                self.i += 1
                return
            self.i += 1

    def tell(self, t: Trouble) -> None:
        self.troubles.append({"message": t.message, "at": t.at})

    # files
    def unit(self) -> dict:
        out = {"pragmas": [], "imports": [], "contracts": [], "structs": [], "enums": [], "functions": []}
        while self.kind != "end":
            start = self.i
            try:
                self.top(out)
            except Trouble as t:
                self.tell(t)
                self.recover()
            if self.i == start:
                self.i += 1
        out["troubles"] = self.troubles
        return out

    def top(self, out: dict) -> None:
        s, v = self.at, self.v
        if v == "pragma":
            self.i += 1
            a = self.at
            while self.kind != "end" and self.v != ";":
                self.i += 1
            out["pragmas"].append(self.text[a : self.at].strip())
            self.take(";")
        elif v == "import":
            out["imports"].append(self.imported())
        elif v in ("contract", "interface", "library") or v == "abstract" and self.ahead() == "contract":
            out["contracts"].append(self.contract())
        elif v == "struct":
            out["structs"].append(self.struct())
        elif v == "enum":
            out["enums"].append(self.enum())
        elif v == "function":
            out["functions"].append(self.function())
        elif v in ("using", "error", "event", "type"):
            self.recover()
        else:
            self.i += 1
            self.recover()
        if self.at == s:
            raise Trouble("unexpected input", s)

    def imported(self) -> dict:
        self.need("import")
        d = {"path": "", "alias": None, "symbols": []}
        if self.kind == "str":
            d["path"] = self.string()
            if self.take("as"):
                d["alias"] = self.name()
        elif self.take("*"):
            self.need("as")
            d["alias"] = self.name()
            self.need("from")
            d["path"] = self.string()
        else:
            self.need("{")
            while not self.take("}"):
                symbol = self.name()
                d["symbols"].append([symbol, self.name() if self.take("as") else symbol])
                self.take(",")
            self.need("from")
            d["path"] = self.string()
        self.take(";")
        return d

    def string(self) -> str:
        if self.kind != "str":
            raise Trouble("expected a string", self.at)
        self.i += 1
        raw = self.toks[self.i - 1][1]
        body = raw[raw.index(raw[-1]) + 1 : -1]
        return re.sub(r"\\(u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|\n|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "ux" and len(m[1]) > 1 else {"n": "\n", "t": "\t", "r": "\r", "\n": ""}.get(m[1], m[1]), body, flags=re.S)

    # declarations
    def contract(self) -> dict:
        s = self.at
        abstract = bool(self.take("abstract"))
        kind = self.name()
        c = {"name": self.name(), "kind": "abstract" if abstract else kind, "bases": [], "vars": [], "functions": [], "modifiers": [], "structs": [], "enums": [], "events": [], "using": []}
        if self.take("is"):
            while True:
                base = {"name": self.path(), "args": None}
                if self.v == "(":
                    base["args"] = self.arguments()[0]
                c["bases"].append(base)
                if not self.take(","):
                    break
        while self.v not in ("{", "") and self.v != ";":
            self.i += 1
        self.need("{")
        while self.v != "}" and self.kind != "end":
            start = self.i
            try:
                self.member(c)
            except Trouble as t:
                self.tell(t)
                self.recover()
            if self.i == start:
                self.i += 1
        self.take("}")
        return c | {"s": s, "e": self.last}

    def member(self, c: dict) -> None:
        v, n = self.v, self.ahead()
        if v == "function" and n != "(" or v in ("constructor", "receive", "fallback") and n == "(" or v == "function" and n == "(" and self.unnamed_fallback():
            c["functions"].append(self.function())
        elif v == "modifier":
            c["modifiers"].append(self.modifier())
        elif v == "struct":
            c["structs"].append(self.struct())
        elif v == "enum":
            c["enums"].append(self.enum())
        elif v == "event":
            s = self.at
            self.i += 1
            name = self.name()
            params = self.parameters()
            self.take("anonymous")
            self.take(";")
            c["events"].append({"name": name, "params": params, "s": s, "e": self.last})
        elif v == "using":
            self.i += 1
            library = None
            if self.v == "{":
                self.skip_balanced()
            else:
                library = self.path()
            self.need("for")
            target = "*" if self.take("*") else self.type_name()
            self.take("global")
            self.take(";")
            c["using"].append({"library": library, "type": target})
        elif v == "error" and self.toks[self.i + 1][0] == "id" or v == "type" and self.toks[self.i + 1][0] == "id" and self.ahead(2) == "is":
            self.recover()
        else:
            c["vars"].append(self.state_variable())

    def unnamed_fallback(self) -> bool:
        """``function () ... {`` of old sources, against a variable of function type."""
        i = self.i
        self.i += 1
        self.skip_balanced()
        while self.kind == "id":
            self.i += 1
        body = self.v == "{"
        self.i = i
        return body

    def state_variable(self) -> dict:
        s = self.at
        d = {"type": self.type_name(), "visibility": "internal", "constant": False, "immutable": False, "value": None}
        while self.kind == "id" and self.v in ("public", "private", "internal", "constant", "immutable", "override", "transient"):
            v = self.name()
            if v in ("public", "private", "internal"):
                d["visibility"] = v
            elif v == "override" and self.v == "(":
                self.skip_balanced()
            elif v in ("constant", "immutable"):
                d[v] = True
        d["name"] = self.name()
        if self.take("="):
            d["value"] = self.expression()
        self.need(";")
        return d | {"s": s, "e": self.last}

    def struct(self) -> dict:
        s = self.at
        self.need("struct")
        d = {"name": self.name(), "fields": []}
        self.need("{")
        while not self.take("}"):
            t = self.type_name()
            d["fields"].append([t, self.name()])
            self.need(";")
        return d | {"s": s, "e": self.last}

    def enum(self) -> dict:
        s = self.at
        self.need("enum")
        d = {"name": self.name(), "values": []}
        self.need("{")
        while not self.take("}"):
            d["values"].append(self.name())
            self.take(",")
        return d | {"s": s, "e": self.last}

    def parameters(self) -> list[dict]:
        self.need("(")
        out = []
        while not self.take(")"):
            s = self.at
            p = {"type": self.type_name(), "location": None, "indexed": False, "name": ""}
            while self.kind == "id":
                v = self.name()
                if v in _LOCATIONS:
                    p["location"] = v
                elif v == "indexed":
                    p["indexed"] = True
                elif v != "payable":
                    p["name"] = v
                else:
                    p["type"] += " payable"
            out.append(p | {"s": s, "e": self.last})
            if not self.take(",") and self.v != ")":
                raise Trouble(f"expected ',' or ')', found {self.v!r}", self.at)
        return out

    def function(self) -> dict:
        s = self.at
        word = self.name()
        kind = word if word in ("constructor", "receive", "fallback") else "function"
        if kind == "function" and self.v == "(":
            kind = "fallback"
        d = {"name": self.name() if kind == "function" else kind, "kind": kind, "visibility": "", "mutability": "", "modifiers": [], "virtual": False, "override": False, "returns": []}
        d["params"] = self.parameters()
        while self.v not in ("{", ";") and self.kind != "end":
            at, v = self.at, self.v
            if v in ("public", "private", "internal", "external"):
                d["visibility"] = self.name()
            elif v in ("pure", "view", "payable", "constant"):
                d["mutability"] = {"constant": "view"}.get(self.name(), v)
            elif v == "virtual":
                self.i += 1
                d["virtual"] = True
            elif v == "override":
                self.i += 1
                d["override"] = True
                if self.v == "(":
                    self.skip_balanced()
            elif v == "returns":
                self.i += 1
                d["returns"] = self.parameters()
            elif self.kind == "id":
                m = {"name": self.path(), "args": [], "s": at}
                if self.v == "(":
                    m["args"] = self.arguments()[0]
                d["modifiers"].append(m | {"e": self.last})
            else:
                raise Trouble(f"unexpected {v!r} in a function head", self.at)
        d["body"] = None if self.take(";") else self.block()["body"]
        return d | {"s": s, "e": self.last}

    def modifier(self) -> dict:
        s = self.at
        self.need("modifier")
        d = {"name": self.name(), "params": self.parameters() if self.v == "(" else []}
        while self.v not in ("{", ";") and self.kind != "end":
            self.i += 1
        d["body"] = None if self.take(";") else self.block()["body"]
        return d | {"s": s, "e": self.last}

    def type_name(self) -> str:
        if self.take("mapping"):
            self.need("(")
            key = self.type_name()
            if self.kind == "id":
                self.name()
            self.need("=>")
            value = self.type_name()
            if self.kind == "id":
                self.name()
            self.need(")")
            out = f"mapping({key} => {value})"
        elif self.v == "function":
            self.i += 1
            self.skip_balanced()
            while self.kind == "id" and self.v in ("internal", "external", "pure", "view", "payable", "returns"):
                if self.name() == "returns":
                    self.skip_balanced()
            out = "function"
        else:
            out = self.path()
            if out == "address" and self.v == "payable":
                self.i += 1
                out = "address payable"
        while self.v == "[":
            self.i += 1
            a = self.at
            if self.v != "]":
                self.expression()
            out += "[" + self.text[a : self.last if self.v == "]" and self.last > a else a].strip() + "]"
            self.need("]")
        return out

    # statements
    def block(self) -> dict:
        s = self.at
        self.need("{")
        body = []
        while self.v != "}" and self.kind != "end":
            start = self.i
            try:
                body.append(self.statement())
            except Trouble as t:
                self.tell(t)
                self.i = max(self.i, start)
                self.recover()
            if self.i == start:
                self.i += 1
        self.take("}")
        return {"k": "block", "body": body, "s": s, "e": self.last}

    def statement(self) -> dict:
        s, v = self.at, self.v
        if v == "{":
            return self.block()
        if self.kind == "id":
            f = {"if": self.if_, "for": self.for_, "while": self.while_, "do": self.do_, "try": self.try_, "assembly": self.assembly}.get(v)
            if f:
                return f()
            if v == "unchecked" and self.ahead() == "{":
                self.i += 1
                return self.block() | {"k": "unchecked", "s": s}
            if v == "return":
                self.i += 1
                value = None if self.v == ";" else self.expression()
                self.need(";")
                return {"k": "return", "value": value, "s": s, "e": self.last}
            if v == "emit":
                self.i += 1
                value = self.expression()
                self.need(";")
                return {"k": "emit", "value": value, "s": s, "e": self.last}
            if v == "revert" and self.toks[self.i + 1][0] == "id":
                self.i += 1
                call = self.expression()
                self.need(";")
                return {"k": "revert", "value": call, "s": s, "e": self.last}
            if v in ("break", "continue", "_") and self.ahead() == ";":
                self.i += 2
                return {"k": v if v != "_" else "placeholder", "s": s, "e": self.last}
        d = self.declaration()
        if d is None:
            value = self.expression()
            d = {"k": "expr", "value": value, "s": value["s"], "e": value["e"]}
            self.need(";")
        return d

    def declaration(self) -> dict | None:
        """A variable declaration with its semicolon, or None with nothing consumed."""
        i, s, n = self.i, self.at, len(self.troubles)
        try:
            targets = []
            if self.v == "(" or self.v == "var" and self.ahead() == "(":
                self.take("var")
                self.need("(")
                while True:
                    if self.v in (",", ")"):
                        targets.append(None)
                    else:
                        targets.append(self.target())
                    if self.take(")"):
                        break
                    self.need(",")
                if self.v != "=" or not any(targets):
                    raise Trouble("no declaration", s)
            else:
                if self.kind != "id":
                    raise Trouble("no declaration", s)
                targets.append(self.target())
            if self.v not in ("=", ";"):
                raise Trouble("no declaration", s)
        except Trouble:
            self.i = i
            del self.troubles[n:]
            return None
        value = self.expression() if self.take("=") else None
        self.need(";")
        return {"k": "declare", "targets": targets, "value": value, "s": s, "e": self.last}

    def target(self) -> dict:
        s = self.at
        t, location = self.type_name(), None
        if self.v in _LOCATIONS:
            location = self.name()
        at = self.at
        return {"type": t, "location": location, "name": self.name(), "s": s, "e": self.last, "at": at}

    def if_(self) -> dict:
        s = self.at
        self.need("if")
        self.need("(")
        test = self.expression()
        self.need(")")
        then = self.statement()
        other = self.statement() if self.take("else") else None
        return {"k": "if", "test": test, "then": then, "else": other, "s": s, "e": self.last}

    def while_(self) -> dict:
        s = self.at
        self.need("while")
        self.need("(")
        test = self.expression()
        self.need(")")
        return {"k": "while", "test": test, "body": self.statement(), "s": s, "e": self.last}

    def do_(self) -> dict:
        s = self.at
        self.need("do")
        body = self.statement()
        self.need("while")
        self.need("(")
        test = self.expression()
        self.need(")")
        self.take(";")
        return {"k": "do", "test": test, "body": body, "s": s, "e": self.last}

    def for_(self) -> dict:
        s = self.at
        self.need("for")
        self.need("(")
        init = None if self.take(";") else self.statement()
        test = None if self.v == ";" else self.expression()
        self.need(";")
        post = None if self.v == ")" else self.expression()
        self.need(")")
        return {"k": "for", "init": init, "test": test, "post": post, "body": self.statement(), "s": s, "e": self.last}

    def try_(self) -> dict:
        s = self.at
        self.need("try")
        value = self.expression()
        if self.take("returns"):
            self.parameters()
        d = {"k": "try", "value": value, "body": self.block(), "catches": [], "s": s}
        while self.take("catch"):
            if self.kind == "id":
                self.name()
            if self.v == "(":
                self.parameters()
            d["catches"].append(self.block())
        return d | {"e": self.last}

    # inline assembly
    def assembly(self) -> dict:
        s = self.at
        self.need("assembly")
        if self.kind == "str":
            self.i += 1
        if self.v == "(":
            self.skip_balanced()
        return {"k": "assembly", "body": self.yul_block(), "s": s, "e": self.last}

    def yul_block(self) -> list[dict]:
        self.need("{")
        out = []
        while self.v != "}" and self.kind != "end":
            start = self.i
            try:
                out.append(self.yul_statement())
            except Trouble as t:
                self.tell(t)
                self.i += self.i == start
        self.take("}")
        return out

    def yul_statement(self) -> dict:
        s, v = self.at, self.v
        if v == "{":
            return {"k": "yblock", "body": self.yul_block(), "s": s, "e": self.last}
        if v == "if":
            self.i += 1
            return {"k": "yif", "test": self.yul_expression(), "body": self.yul_block(), "s": s, "e": self.last}
        if v == "for":
            self.i += 1
            init, test, post = self.yul_block(), self.yul_expression(), self.yul_block()
            return {"k": "yfor", "init": init, "test": test, "post": post, "body": self.yul_block(), "s": s, "e": self.last}
        if v == "switch":
            self.i += 1
            d = {"k": "yswitch", "test": self.yul_expression(), "cases": [], "s": s}
            while self.v in ("case", "default"):
                if self.name() == "case":
                    self.yul_expression()
                d["cases"].append(self.yul_block())
            return d | {"e": self.last}
        if v == "function":
            self.i += 1
            self.name()
            self.skip_balanced()
            while self.v != "{" and self.kind != "end":
                self.i += 1
            return {"k": "yblock", "body": self.yul_block(), "s": s, "e": self.last}
        if v in ("break", "continue", "leave"):
            self.i += 1
            return {"k": "yblock", "body": [], "s": s, "e": self.last}
        if v == "let":
            self.i += 1
        names = [self.yul_path()] if self.kind == "id" and (v == "let" or self.ahead() in (":=", ",", ".")) else None
        if names:
            while self.take(","):
                names.append(self.yul_path())
            value = self.yul_expression() if self.take(":=") else None
            return {"k": "yassign", "names": names, "value": value, "s": s, "e": self.last}
        return self.yul_expression()

    def yul_path(self) -> str:
        out = self.name()
        while self.take("."):
            out += "." + self.name()
        return out

    def yul_expression(self) -> dict:
        s = self.at
        if self.kind in ("str", "num"):
            self.i += 1
            return {"k": "lit", "sub": "number" if self.toks[self.i - 1][0] == "num" else "string", "value": self.toks[self.i - 1][1], "s": s, "e": self.last}
        name = self.yul_path()
        if self.v != "(":
            if name in ("true", "false"):
                return {"k": "lit", "sub": "bool", "value": name, "s": s, "e": self.last}
            return {"k": "id", "name": name, "s": s, "e": self.last}
        self.need("(")
        args = []
        while not self.take(")"):
            args.append(self.yul_expression())
            if not self.take(",") and self.v != ")":
                raise Trouble(f"expected ',' or ')', found {self.v!r}", self.at)
        return {"k": "ycall", "name": name, "args": args, "s": s, "e": self.last}

    # expressions
    def expression(self) -> dict:
        left = self.ternary()
        if self.kind == "op" and self.v in _ASSIGN:
            op = self.v
            self.i += 1
            right = self.expression()
            return {"k": "assign", "op": op, "a": left, "b": right, "s": left["s"], "e": right["e"]}
        return left

    def ternary(self) -> dict:
        test = self.binary(1)
        if self.take("?"):
            a = self.expression()
            self.need(":")
            b = self.expression()
            return {"k": "ternary", "test": test, "a": a, "b": b, "s": test["s"], "e": b["e"]}
        return test

    def binary(self, least: int) -> dict:
        left = self.unary()
        while self.kind == "op" and (p := _BINARY.get(self.v, 0)) >= least:
            op = self.v
            self.i += 1
            right = self.binary(p if op == "**" else p + 1)
            left = {"k": "binary", "op": op, "a": left, "b": right, "s": left["s"], "e": right["e"]}
        return left

    def unary(self) -> dict:
        s, v = self.at, self.v
        if self.kind == "op" and v in ("!", "~", "-", "+", "++", "--") or v == "delete" and self.kind == "id":
            self.i += 1
            a = self.unary()
            return {"k": "unary", "op": v, "prefix": True, "a": a, "s": s, "e": a["e"]}
        return self.postfix(self.primary())

    def arguments(self) -> tuple[list[dict], list[str] | None]:
        self.need("(")
        args, names = [], None
        if self.v == "{":
            self.i += 1
            names = []
            while not self.take("}"):
                names.append(self.name())
                self.need(":")
                args.append(self.expression())
                self.take(",")
            self.need(")")
            return args, names
        while not self.take(")"):
            args.append(self.expression())
            if not self.take(",") and self.v != ")":
                raise Trouble(f"expected ',' or ')', found {self.v!r}", self.at)
        return args, names

    def postfix(self, left: dict) -> dict:
        while self.kind == "op":
            v = self.v
            if v == ".":
                self.i += 1
                name = self.name()
                left = {"k": "member", "name": name, "a": left, "s": left["s"], "e": self.last}
            elif v == "[":
                self.i += 1
                index = None
                if self.v not in ("]", ":"):
                    index = self.expression()
                if self.take(":") and self.v != "]":
                    self.expression()
                self.need("]")
                left = {"k": "index", "a": left, "b": index, "s": left["s"], "e": self.last}
            elif v == "{" and self.toks[self.i + 1][0] == "id" and self.ahead(2) == ":" and left["k"] in ("member", "new", "id"):
                self.i += 1
                options = []
                while not self.take("}"):
                    n = self.name()
                    self.need(":")
                    options.append([n, self.expression()])
                    self.take(",")
                left = {"k": "options", "a": left, "options": options, "s": left["s"], "e": self.last}
            elif v == "(":
                args, _ = self.arguments()
                left = {"k": "call", "f": left, "args": args, "s": left["s"], "e": self.last}
            elif v in ("++", "--"):
                self.i += 1
                left = {"k": "unary", "op": v, "prefix": False, "a": left, "s": left["s"], "e": self.last}
            else:
                break
        return left

    def primary(self) -> dict:
        s, kind, v = self.at, self.kind, self.v
        if kind == "num":
            self.i += 1
            unit = self.name() if self.kind == "id" and self.v in _UNITS else None
            return {"k": "lit", "sub": "number", "value": v, "unit": unit, "s": s, "e": self.last}
        if kind == "str":
            if v.startswith("hex"):
                self.i += 1
                return {"k": "lit", "sub": "hex", "value": v[4:-1], "s": s, "e": self.last}
            value = self.string()
            while self.kind == "str":
                value += self.string()
            return {"k": "lit", "sub": "string", "value": value, "s": s, "e": self.last}
        if v == "(":
            self.i += 1
            items, commas = [], 0
            while self.v != ")":
                if self.v == ",":
                    self.i += 1
                    commas += 1
                    if len(items) < commas:
                        items.append(None)
                    continue
                if len(items) < commas:
                    items.append(None)
                items.append(self.expression())
            self.need(")")
            items += [None] * (commas + 1 - len(items))
            if len(items) == 1 and items[0]:
                return items[0]  # plain parentheses
            return {"k": "tuple", "items": items, "s": s, "e": self.last}
        if v == "[":
            self.i += 1
            items = []
            while not self.take("]"):
                items.append(self.expression())
                self.take(",")
            return {"k": "tuple", "items": items, "s": s, "e": self.last}
        if kind == "id":
            if v == "new":
                self.i += 1
                return {"k": "new", "type": self.type_name(), "s": s, "e": self.last}
            if v in ("true", "false"):
                self.i += 1
                return {"k": "lit", "sub": "bool", "value": v, "s": s, "e": self.last}
            if v == "payable" and self.ahead() == "(":
                self.i += 1
                return {"k": "type", "name": "address payable", "s": s, "e": self.last}
            if v == "type" and self.ahead() == "(":
                self.i += 1
                return {"k": "id", "name": "type", "s": s, "e": self.last}
            if _ELEMENTARY.match(v):
                self.i += 1
                if v == "address" and self.v == "payable":
                    self.i += 1
                return {"k": "type", "name": v, "s": s, "e": self.last}
            self.i += 1
            return {"k": "id", "name": v, "s": s, "e": self.last}
        raise Trouble(f"unexpected {v!r}", s)


def parse(text: str) -> dict:
    return Parser(text).unit()
