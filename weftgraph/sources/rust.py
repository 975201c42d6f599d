"""Source text to syntax trees, control-flow graphs and symbol tables.

A lexer and recursive-descent parser for the Rust constructs that the graph is made of: items, functions,
blocks, statements, branches, loops, matches and nested blocks. Offsets are bytes. What stands inside
simple expressions is kept as text. A file is one task's unit; ``analyze`` is the only place of the library
where Python sees data, and files of any number are spread by Spark.

Defined results: null content is an empty file; a file that cannot be read to its end (an open brace, an
open string) raises ``ParseError`` rather than give half a tree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.durable import durable
from weftgraph.model import SCHEMAS

TOKEN = re.compile(
    rb"""(?P<space>\s+)
    |(?P<line_comment>//[^\n]*)
    |(?P<block_comment>/\*)
    |(?P<raw>(?:b|c|br|cr)?r(?P<hash>\#*)")
    |(?P<string>(?:b|c)?"(?:[^"\\]|\\.)*")
    |(?P<char>b?'(?:[^'\\\n]|\\(?:u\{[^}]*\}|x..|.))[\x80-\xbf]*')
    |(?P<life>'[A-Za-z_]\w*)
    |(?P<number>\d(?:[\w]|\.(?=\d))*)
    |(?P<ident>(?:r\#)?[A-Za-z_\x80-\xff][\w\x80-\xff]*)
    |(?P<op>::|->|=>|\.\.=|\.\.\.|\.\.|==|!=|<=|>=|&&|\|\||[-+*/%^&|]=|<<=|>>=)
    |(?P<punct>.)""",
    re.VERBOSE | re.DOTALL,
)
OPEN, CLOSE = {b"(": b")", b"[": b"]", b"{": b"}"}, {b")", b"]", b"}"}
# Words that begin an item, and the kind of the items that are kept as text.
ITEMS = {b"struct": "struct_item", b"enum": "enum_item", b"union": "union_item", b"type": "type_item", b"use": "use_declaration", b"const": "const_item", b"static": "static_item", b"extern": "extern_crate_declaration"}
QUALIFIERS = (b"pub", b"async", b"const", b"unsafe", b"extern", b"default")
LOOPS = {b"while": "while_expression", b"loop": "loop_expression", b"for": "for_expression"}
JUMPS = {b"return": "return_expression", b"break": "break_expression", b"continue": "continue_expression"}


class ParseError(ValueError):
    pass


@dataclass
class Tok:
    kind: str
    text: bytes
    start: int
    end: int


@dataclass
class Node:
    kind: str
    start: int
    end: int
    children: list[Node] = field(default_factory=list)
    field: str | None = None
    label: bytes | None = None

    def named(self, name: str) -> Node | None:
        return next((c for c in self.children if c.field == name), None)

    def as_field(self, name: str) -> Node:
        self.field = name
        return self

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += reversed(n.children)


def tokenize(src: bytes) -> list[Tok]:
    """Tokens without white space; comments stay."""
    out, at = [], 0
    while at < len(src):
        m = TOKEN.match(src, at)
        kind, end = m.lastgroup if m.lastgroup != "hash" else "raw", m.end()
        if kind == "block_comment":
            depth, end = 1, at + 2
            while depth:
                n = re.compile(rb"/\*|\*/").search(src, end)
                if not n:
                    raise ParseError(f"comment at byte {at} is open")
                depth, end = depth + (1 if n.group() == b"/*" else -1), n.end()
        elif m.group("raw"):
            kind, stop = "string", src.find(b'"' + m.group("hash"), end)
            if stop < 0:
                raise ParseError(f"string at byte {at} is open")
            end = stop + 1 + len(m.group("hash"))
        elif kind == "punct" and m.group() == b'"':
            raise ParseError(f"string at byte {at} is open")
        if kind != "space":
            out.append(Tok(kind, src[at:end], at, end))
        at = end
    return out


class Parser:
    def __init__(self, src: bytes):
        self.src, self.toks, self.at = src, tokenize(src), 0

    # tokens
    def peek(self, ahead: int = 0) -> bytes:
        """Text of a coming token that is no comment; empty at the end."""
        k = self.at
        while k < len(self.toks):
            if not self.toks[k].kind.endswith("comment"):
                if not ahead:
                    return self.toks[k].text
                ahead -= 1
            k += 1
        return b""

    def comment(self) -> bool:
        return self.at < len(self.toks) and self.toks[self.at].kind.endswith("comment")

    def take(self, want: bytes | None = None) -> Tok:
        while self.comment():
            self.at += 1
        if self.at == len(self.toks):
            raise ParseError("the file ends within a construct")
        t = self.toks[self.at]
        if want is not None and t.text != want:
            raise ParseError(f"{want.decode()} expected at byte {t.start}")
        self.at += 1
        return t

    def leaf(self, want: bytes | None = None, kind: str | None = None) -> Node:
        t = self.take(want)
        return Node(kind or ("identifier" if t.kind == "ident" else t.text.decode("utf-8", "replace") if t.kind in ("punct", "op") else t.kind), t.start, t.end)

    def skip_group(self) -> None:
        """One balanced group, its brackets included."""
        want = [OPEN[self.take().text]]
        while want:
            t = self.take().text
            if t in OPEN:
                want.append(OPEN[t])
            elif t in CLOSE and t != want.pop():
                raise ParseError(f"unbalanced bracket before byte {self.toks[self.at - 1].end}")

    def skip_to(self, *stops: bytes, angles: bool = False) -> None:
        """Up to a stop at the outer level. With ``angles``, < and > count as brackets."""
        depth = 0
        while (t := self.peek()) and not (depth == 0 and t in stops):
            if t in CLOSE:
                return
            if t in OPEN:
                self.skip_group()
                continue
            depth += angles and (t == b"<") - (t == b">" and depth > 0)
            self.take()

    def end(self) -> int:
        return self.toks[self.at - 1].end

    # items
    def file(self) -> Node:
        root = Node("source_file", 0, len(self.src))
        self.items(root, None)
        return root

    def items(self, into: Node, closer: bytes | None) -> None:
        while self.at < len(self.toks):
            if self.comment():
                into.children.append(self.extra())
            elif closer and self.peek() == closer:
                return
            else:
                into.children.append(self.item())
        if closer:
            raise ParseError("the file ends within a block")

    def extra(self) -> Node:
        t = self.toks[self.at]
        self.at += 1
        return Node(t.kind, t.start, t.end)

    def starts_item(self) -> bool:
        t, nxt = self.peek(), self.peek(1)
        if t in (b"fn", b"mod", b"impl", b"trait", b"pub", b"struct", b"enum", b"use", b"type", b"static") or (t == b"union" and re.match(rb"[A-Za-z_]", nxt)):
            return True
        if t == b"macro_rules":
            return nxt == b"!"
        if t in (b"const", b"async", b"unsafe", b"extern"):
            return nxt not in (b"{", b"move", b"|", b"||")
        return False

    def attribute(self) -> Node:
        start = self.take(b"#").start
        kind = "attribute_item"
        if self.peek() == b"!":
            self.take()
            kind = "inner_attribute_item"
        self.skip_group()
        return Node(kind, start, self.end())

    def item(self) -> Node:
        if self.peek() == b"#":
            return self.attribute()
        while self.comment():
            self.at += 1
        start, k = self.toks[self.at].start, 0
        save = self.at
        while self.peek() in QUALIFIERS and (self.peek() == b"pub" or self.peek(1) in (b"fn", b"trait", b"impl", b"unsafe", b"async", b"extern") or self.toks[self.at].text == b"extern"):
            if self.peek() == b"extern" and self.peek(1) in (b"crate", b"{"):
                break
            word = self.take().text
            if word == b"pub" and self.peek() == b"(":
                self.skip_group()
            if word == b"extern" and self.peek()[:1] == b'"':
                self.take()
                if self.peek() == b"{":
                    node = self.body_of("foreign_mod_item", start)
                    return node
        t = self.peek()
        if t == b"fn":
            return self.function(start)
        if t in (b"mod", b"impl", b"trait"):
            return self.container({b"mod": "mod_item", b"impl": "impl_item", b"trait": "trait_item"}[t], start)
        if t == b"macro_rules" and self.peek(1) == b"!":
            self.take(), self.take(), self.take()
            self.skip_group()
            if self.peek() == b";":
                self.take()
            return Node("macro_definition", start, self.end())
        if t in ITEMS:
            return self.plain_item(ITEMS[t], start)
        k = self.at
        if re.match(rb"[A-Za-z_]", t) and (b"!" in (self.peek(1), self.peek(3)) or self.peek(1) == b"::"):
            self.skip_to(b"!", b";")
            if self.peek() == b"!":
                self.take()
                if self.peek() in OPEN:
                    self.skip_group()
                if self.peek() == b";":
                    self.take()
                return Node("macro_invocation", start, self.end())
        self.at = max(save, k)
        t = self.take()
        if t.text in CLOSE:
            raise ParseError(f"unbalanced {t.text.decode()} at byte {t.start}")
        return Node("ERROR", t.start, t.end)

    def plain_item(self, kind: str, start: int) -> Node:
        word = self.take().text
        if word in (b"struct", b"enum", b"union"):
            self.skip_to(b"{", b";", b"(", angles=True)
            if self.peek() == b"(":
                self.skip_group()
                self.skip_to(b";")
            if self.peek() == b"{":
                self.skip_group()
            elif self.peek() == b";":
                self.take()
        else:
            self.skip_to(b";")
            self.take(b";")
        return Node(kind, start, self.end())

    def body_of(self, kind: str, start: int) -> Node:
        body = Node("declaration_list", self.toks[self.at].start, 0, field="body")
        body.children.append(self.leaf(b"{"))
        self.items(body, b"}")
        body.children.append(self.leaf(b"}"))
        body.end = self.end()
        return Node(kind, start, self.end(), [body])

    def container(self, kind: str, start: int) -> Node:
        self.skip_to(b"{", b";", angles=True)
        if self.peek() == b";":
            self.take()
            return Node(kind, start, self.end())
        while self.comment():
            self.at += 1
        return self.body_of(kind, start)

    def function(self, start: int) -> Node:
        node = Node("function_item", start, 0)
        node.children.append(self.leaf(b"fn"))
        node.children.append(self.leaf().as_field("name"))
        if self.peek() == b"<":
            self.skip_to(b"(", angles=True)
        node.children.append(self.parameters().as_field("parameters"))
        self.skip_to(b"{", b";")
        if self.peek() == b";":
            self.take()
            node.kind = "function_signature_item"
        else:
            node.children.append(self.block().as_field("body"))
        node.end = self.end()
        return node

    def parameters(self) -> Node:
        out = Node("parameters", 0, 0)
        out.children.append(self.leaf(b"("))
        out.start = out.children[0].start
        while self.peek() != b")":
            while self.peek() == b"#":
                out.children.append(self.attribute())
            first = self.at
            pattern = self.pattern(b":", b",")
            words = [t.text for t in self.toks[first : self.at]]
            if words and words[-1] == b"self" and set(words[:-1]) <= {b"&", b"mut"} | {w for w in words if w[:1] == b"'"}:
                self.skip_to(b",", angles=True)
                out.children.append(Node("self_parameter", pattern.start, self.end()))
            elif words:
                param = Node("parameter", self.toks[first].start, 0, [pattern.as_field("pattern")])
                self.skip_to(b",", angles=True)
                param.end = self.end()
                out.children.append(param)
            if self.peek() == b",":
                out.children.append(self.leaf(b","))
        out.children.append(self.leaf(b")"))
        out.end = self.end()
        return out

    def pattern(self, *stops: bytes) -> Node:
        """A pattern up to a stop. ``mut x`` is the identifier ``x``: the specifier is no part of it."""
        while self.comment():
            self.at += 1
        if self.peek() == b"mut" and self.peek(2) in (*stops, b")"):
            self.take()
        first = self.at
        self.skip_to(*stops, angles=True)
        if first == self.at:
            return Node("missing", self.end(), self.end())
        one = self.at - first == 1 and self.toks[first].kind == "ident" and self.toks[first].text != b"_"
        return Node("identifier" if one else "pattern", self.toks[first].start, self.end())

    # statements and expressions
    def block(self) -> Node:
        out = Node("block", 0, 0)
        out.children.append(self.leaf(b"{"))
        out.start = out.children[0].start
        while True:
            if self.comment():
                out.children.append(self.extra())
            elif not self.peek():
                raise ParseError(f"block at byte {out.start} is open")
            elif self.peek() == b"}":
                break
            else:
                out.children.append(self.statement())
        out.children.append(self.leaf(b"}"))
        out.end = self.end()
        return out

    def statement(self) -> Node:
        t = self.peek()
        if t == b"#":
            return self.attribute()
        if t == b";":
            return self.leaf(b";", "empty_statement")
        if t == b"let":
            return self.let()
        if self.starts_item():
            return self.item()
        start = self.toks[self.at].start
        blocky = self.block_like()
        if blocky is not None and self.peek() not in (b".", b"?"):
            return Node("expression_statement", start, self.end(), [blocky])
        expr = self.expression(start, [blocky] if blocky else [])
        if self.peek() == b";":
            semi = self.leaf(b";")
            return Node("expression_statement", start, semi.end, [expr, semi])
        braces = expr.kind == "macro_invocation" and self.src[expr.end - 1 : expr.end] == b"}"
        return Node("expression_statement", start, expr.end, [expr]) if braces and self.peek() != b"}" else expr

    def let(self) -> Node:
        out = Node("let_declaration", 0, 0)
        out.children.append(self.leaf(b"let"))
        out.start = out.children[0].start
        out.children.append(self.pattern(b":", b"=", b";").as_field("pattern"))
        if self.peek() == b":":
            self.take()
            self.skip_to(b"=", b";", angles=True)
        if self.peek() == b"=":
            self.take()
            out.children.append(self.expression(stops=(b";", b"else")).as_field("value"))
            if self.peek() == b"else":
                self.take()
                out.children.append(self.block().as_field("alternative"))
        out.children.append(self.leaf(b";"))
        out.end = self.end()
        return out

    def block_like(self) -> Node | None:
        """An expression that ends with a block, if one begins here."""
        t, nxt = self.peek(), self.peek(1)
        if self.toks[self.at].kind == "life" and nxt == b":" and self.peek(2) in (*LOOPS, b"{"):
            label, _ = self.take().text, self.take()
            inner = self.block_like()
            inner.label = label
            return inner
        if t == b"if":
            return self.if_()
        if t in LOOPS and not (t == b"for" and nxt == b"<"):
            return self.loop(LOOPS[t])
        if t == b"match":
            return self.match()
        if t == b"{":
            return self.block()
        if t in (b"unsafe", b"async", b"const") and (nxt == b"{" or (nxt == b"move" and self.peek(2) == b"{")):
            word = self.leaf(kind=t.decode())
            if self.peek() == b"move":
                self.take()
            body = self.block()
            return Node(f"{t.decode()}_block", word.start, self.end(), [word, body])
        return None

    def if_(self) -> Node:
        out = Node("if_expression", 0, 0)
        out.children.append(self.leaf(b"if"))
        out.start = out.children[0].start
        out.children.append(self.expression(stops=(b"{",)).as_field("condition"))
        out.children.append(self.block().as_field("consequence"))
        if self.peek() == b"else":
            word = self.leaf(b"else")
            body = self.if_() if self.peek() == b"if" else self.block()
            out.children.append(Node("else_clause", word.start, self.end(), [word, body], "alternative"))
        out.end = self.end()
        return out

    def loop(self, kind: str) -> Node:
        out = Node(kind, 0, 0)
        out.children.append(self.leaf())
        out.start = out.children[0].start
        if kind == "for_expression":
            out.children.append(self.pattern(b"in").as_field("pattern"))
            self.take(b"in")
            out.children.append(self.expression(stops=(b"{",)).as_field("value"))
        elif kind == "while_expression":
            out.children.append(self.expression(stops=(b"{",)).as_field("condition"))
        out.children.append(self.block().as_field("body"))
        out.end = self.end()
        return out

    def match(self) -> Node:
        out = Node("match_expression", 0, 0)
        out.children.append(self.leaf(b"match"))
        out.start = out.children[0].start
        out.children.append(self.expression(stops=(b"{",)).as_field("value"))
        body = Node("match_block", 0, 0, field="body")
        body.children.append(self.leaf(b"{"))
        body.start = body.children[0].start
        while self.peek() != b"}":
            while self.peek() == b"#":
                self.attribute()
            first = self.pattern(b"=>")
            arm = Node("match_arm", first.start, 0, [Node("match_pattern", first.start, first.end, field="pattern")])
            self.take(b"=>")
            start = self.toks[self.at].start
            value = self.block_like()
            if value is None or self.peek() not in (b",", b"}") and value.kind != "block":
                value = value if value and self.peek() not in (b".", b"?") else self.expression(start, [value] if value else [], (b",",))
            arm.children.append(value.as_field("value"))
            if self.peek() == b",":
                self.take()
            arm.end = self.end()
            body.children.append(arm)
        body.children.append(self.leaf(b"}"))
        body.end = self.end()
        out.children.append(body)
        out.end = self.end()
        return out

    def expression(self, start: int | None = None, children: list[Node] | None = None, stops: tuple[bytes, ...] = (b";",)) -> Node:
        """Up to a stop or a closing bracket; its children are the groups and blocks within."""
        while self.comment():
            self.at += 1
        first = self.at
        out = Node("expression", self.toks[self.at].start if start is None and self.at < len(self.toks) else start or 0, 0, children or [])
        word = self.peek()
        before: Tok | None = None
        while (t := self.peek()) and t not in stops and t not in CLOSE and not (t == b";" and b";" not in stops):
            if self.comment():
                self.at += 1
                continue
            if t == b"!" and before is not None and before.kind == "ident" and self.peek(1) in OPEN:
                self.take()
                self.skip_group()
                if first + 2 <= self.at and out.kind == "expression" and not out.children:
                    out.kind = "macro_invocation"
            elif t in (b"(", b"["):
                out.children.append(self.group())
                out.kind = "call_expression" if t == b"(" and out.kind == "expression" and before is not None and before.kind == "ident" else out.kind
            elif t == b"{":
                literal = before is not None and (before.kind == "ident" or before.text == b">") and b"{" not in stops
                out.children.append(self.group() if literal else self.block())
            elif before is None or before.kind != "ident" or before.text in (*JUMPS, b"move", b"in"):
                nested = self.block_like() if t in (b"if", b"match", b"unsafe", b"async", *LOOPS) or self.toks[self.at].kind == "life" else None
                if nested is not None:
                    out.children.append(nested)
                else:
                    self.take()
            else:
                self.take()
            before = self.toks[self.at - 1]
        if self.at == first and not out.children:
            raise ParseError(f"expression expected at byte {self.toks[self.at].start if self.at < len(self.toks) else len(self.src)}")
        if word in JUMPS and not children:
            out.kind = JUMPS[word]
        elif self.at - first == 1 and not children:
            out.kind = "identifier" if self.toks[first].kind == "ident" else f"{self.toks[first].kind}_literal"
        out.end = self.end()
        return out

    def group(self) -> Node:
        opener = self.leaf()
        closer = OPEN[self.src[opener.start : opener.end]]
        out = Node("arguments" if closer == b")" else "array" if closer == b"]" else "field_initializer_list", opener.start, 0, [opener])
        while self.peek() != closer:
            if self.peek() in (b",", b";"):
                out.children.append(self.leaf())
                continue
            if not self.peek():
                raise ParseError(f"bracket at byte {opener.start} is open")
            while self.peek() == b"#":
                self.attribute()
            if self.peek() != closer:
                out.children.append(self.expression(stops=(b",", b";")))
        out.children.append(self.leaf(closer))
        out.end = self.end()
        return out


def parse(src: bytes) -> Node:
    return Parser(src).file()


def shown(src: bytes, node: Node, limit: int = 100) -> str:
    """The node's text: white space other than blanks goes, at most ``limit`` characters."""
    text = src[node.start : node.end].decode("utf-8", "replace")
    return "".join(c for c in text if c == " " or not c.isspace())[:limit]


def _functions(node: Node) -> Iterator[Node]:
    """Functions in text order; those within a function are part of it."""
    for c in node.children:
        if c.kind == "function_item":
            yield c
        else:
            yield from _functions(c)


@dataclass
class CfgBuilder:
    """CFGs of a file; node ids go on from function to function.

    ``opaque_else``: an else branch is one statement. ``precise``: ``for`` is a loop, ``return``, ``break`` and
    ``continue`` (with labels) redirect the flow, edges into the branches of an ``if`` are True and False, and
    what cannot be reached has no incoming edge.
    """

    src: bytes
    opaque_else: bool = False
    precise: bool = False
    nodes: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)
    count: int = 0
    function: int = 0
    seq: int = 0
    leave: int = 0
    loops: list[tuple[bytes | None, int, int]] = field(default_factory=list)
    into: tuple[int, str] | None = None  # the next edge from this node is of this kind

    def new(self, kind: str, at: Node, text: str) -> int:
        self.nodes.append({"function_id": self.function, "node_id": self.count, "kind": kind, "range_start": at.start, "range_end": at.end, "statement": text})
        self.count += 1
        return self.count - 1

    def link(self, src: int | None, dst: int, kind: str = "Normal") -> None:
        if src is None:
            return
        if self.into and self.into[0] == src:
            kind, self.into = self.into[1], None
        self.edges.append({"function_id": self.function, "seq": self.seq, "src": src, "dst": dst, "kind": kind})
        self.seq += 1

    def build(self, root: Node) -> CfgBuilder:
        for k, f in enumerate(_functions(root)):
            self.function, self.seq, self.loops = k, 0, []
            entry, self.leave = self.new("Entry", f, "<entry>"), self.new("Exit", f, "<exit>")
            self.link(self.walk(f.named("body"), entry), self.leave)
        return self

    def walk(self, node: Node, before: int | None, kind: str | None = None) -> int | None:
        """The last node of a block, null if the flow does not come out of it."""
        self.into = (before, kind) if kind and self.precise and before is not None else None
        if node.kind == "else_clause" and not self.opaque_else:
            node = node.children[1]
        for stmt in node.children if node.kind == "block" else [node]:
            if stmt.kind not in ("{", "}", "(", ")", ",", ";"):
                before = self.step(stmt, before)
        return before

    def step(self, stmt: Node, before: int | None) -> int | None:
        real = stmt.children[0] if stmt.kind == "expression_statement" else stmt
        if real.kind == "if_expression":
            branch, merge = self.fork("Branch", real, before, shown(self.src, real, 50))
            self.link(self.walk(real.named("consequence"), branch, "True"), merge)
            other = real.named("alternative")
            if other is None:
                self.into = None
                self.link(branch, merge, "False")
            else:
                self.link(self.walk(other, branch, "False"), merge)
            self.into = None
            return merge
        if real.kind in ("while_expression", "loop_expression") or (self.precise and real.kind == "for_expression"):
            head, merge = self.fork("LoopHeader", real, before, shown(self.src, real, 50))
            self.loops.append((real.label, head, merge))
            self.link(self.walk(real.named("body"), head), head, "Continue")
            self.loops.pop()
            if real.kind != "loop_expression":
                self.link(head, merge, "Break")
            return merge
        if real.kind == "match_expression":
            branch, merge = self.fork("Branch", real, before, "match")
            for arm in real.named("body").children:
                if arm.kind == "match_arm":
                    self.link(self.walk(arm.named("value"), branch), merge)
            return merge
        here = self.new("Statement", stmt, shown(self.src, stmt))
        self.link(before, here)
        if self.precise and real.kind in JUMPS.values():
            return self.jump(real, here)
        return here

    def jump(self, node: Node, here: int) -> None:
        label = re.match(rb"\w+\s+('\w+)", self.src[node.start : node.end])
        around = [x for x in reversed(self.loops) if not label or x[0] == label.group(1)]
        if node.kind == "return_expression" or not around:
            self.link(here, self.leave)
        elif node.kind == "break_expression":
            self.link(here, around[0][2], "Break")
        else:
            self.link(here, around[0][1], "Continue")

    def fork(self, kind: str, at: Node, before: int | None, text: str) -> tuple[int, int]:
        head = self.new(kind, at, text)
        self.link(before, head)
        return head, self.new("Merge", at, "<merge>")


@dataclass
class SymbolBuilder:
    """Scopes and symbols of a file; scope 0 is the file."""

    src: bytes
    scopes: list[dict] = field(default_factory=list)
    symbols: list[dict] = field(default_factory=list)

    def scope(self, kind: str, parent: int | None) -> int:
        self.scopes.append({"scope_id": len(self.scopes), "parent_id": parent, "kind": kind})
        return len(self.scopes) - 1

    def bind(self, name: Node, at: Node, scope: int, kind: str) -> None:
        text = self.src[name.start : name.end].decode("utf-8", "replace")
        self.symbols.append({"symbol_id": len(self.symbols), "name": text, "range_start": at.start, "range_end": at.end, "scope_id": scope, "kind": kind})

    def build(self, root: Node) -> SymbolBuilder:
        self.visit(root, self.scope("File", None))
        return self

    def visit(self, node: Node, scope: int) -> None:
        if node.kind == "function_item":
            self.bind(node.named("name"), node, scope, "Function")
            inner = self.scope("Function", scope)
            for p in node.named("parameters").children:
                if p.kind == "parameter":
                    self.bind(p.named("pattern"), p.named("pattern"), inner, "Parameter")
            self.visit(node.named("body"), inner)
        elif node.kind == "let_declaration":
            if (p := node.named("pattern")).kind == "identifier":
                self.bind(p, node, scope, "Variable")
        else:
            inner = self.scope("Block", scope) if node.kind == "block" else scope
            for c in node.children:
                self.visit(c, inner)


def tree_rows(root: Node) -> list[dict]:
    """The tree in pre-order, as rows of the ``ast`` table."""
    out, stack = [], [(root, None, 0, 0)]
    while stack:
        n, parent, index, depth = stack.pop()
        me = len(out)
        out.append({"node_id": me, "parent_id": parent, "child_index": index, "kind": n.kind, "field": n.field, "start": n.start, "end": n.end, "depth": depth})
        stack += [(c, me, i, depth + 1) for i, c in reversed(list(enumerate(n.children)))]
    return out


TABLES = ("ast", "cfg_nodes", "cfg_edges", "scopes", "symbols")


def facts_of(src: bytes, opaque_else: bool = False, precise: bool = False) -> dict[str, list[dict]]:
    root = parse(src)
    cfg, sym = CfgBuilder(src, opaque_else, precise).build(root), SymbolBuilder(src).build(root)
    return {"ast": tree_rows(root), "cfg_nodes": cfg.nodes, "cfg_edges": cfg.edges, "scopes": sym.scopes, "symbols": sym.symbols}


@dataclass(frozen=True)
class Facts:
    """Tables of all parsed files, keyed by ``file_id``."""

    files: DataFrame
    ast: DataFrame
    cfg_nodes: DataFrame
    cfg_edges: DataFrame
    scopes: DataFrame
    symbols: DataFrame


def analyze(files: DataFrame, opaque_else: bool = False, precise: bool = False) -> Facts:
    """Facts of ``files(file_id, content BINARY)``. Files are parsed once; tables are views of the result."""
    inner = {t: ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in SCHEMAS[t].fields if f.name != "file_id") for t in TABLES}
    schema = "file_id string, " + ", ".join(f"{t} array<struct<{inner[t]}>>" for t in TABLES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for fid, content in zip(b["file_id"], b["content"]):
                yield pd.DataFrame([{"file_id": fid, **facts_of(bytes(content) if content is not None else b"", opaque_else, precise)}])

    parsed = durable(files.select("file_id", "content").mapInPandas(run, schema))
    view = lambda t: parsed.select("file_id", F.explode(t).alias("_x")).select("file_id", "_x.*").select(*SCHEMAS[t].names)
    return Facts(parsed.select("file_id"), *(view(t) for t in TABLES))
