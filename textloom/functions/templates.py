"""Chat templates written by users, as column expressions.

The usual small part of the template language is taken: text, ``{{ }}`` output, loops
over ``messages``, conditions, ``set``, trim markers, comments; in expressions, texts,
whole numbers, names, ``message['role']`` or ``message.role``, ``loop.first``, ``loop.last``,
``loop.index``, ``loop.index0``, ``+``, ``%``, comparisons, ``and``, ``or``, ``not``, ``in`` a text,
the filter ``trim`` and ``raise_exception``.  A newline behind a block and the blanks before
one on its line are dropped.  Anything else is an error that names its place.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import null_to_empty, strip

_TAG = re.compile(r"\{\{-?|\{%-?|\{#-?")
_CLOSING = {"{{": "}}", "{%": "%}", "{#": "#}"}
_TOKEN = re.compile(r"""\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<mark>==|!=|<=|>=|[<>()\[\].|+%,=]))""", re.S)


class TemplateError(ValueError):
    """What a template holds that is not taken, and where."""


@dataclass(frozen=True)
class Value:
    """A column with its kind: ``text``, ``number``, ``truth``, or ``message``/``messages``/``loop``."""

    kind: str
    column: Column | None = None
    also: Column | None = None

    def truth(self) -> Column:
        return {"text": lambda: self.column != "", "number": lambda: self.column != 0, "truth": lambda: self.column}[self.kind]()


Scope = dict[str, Value]


class _Expression:
    """Recursive descent over one expression; ``at`` is its place in the template."""

    def __init__(self, source: str, fail: Callable[[int, str], TemplateError], at: int):
        self.fail, self.tokens = fail, []
        place = 0
        while source[place:].strip():
            match = _TOKEN.match(source, place)
            if match is None:
                gap = len(source[place:]) - len(source[place:].lstrip())
                raise fail(at + place + gap, f"{source[place + gap]!r}")
            self.tokens.append((match.lastgroup, match.group(match.lastgroup), at + match.start(match.lastgroup)))
            place = match.end()
        self.end, self.i = at + len(source), 0

    def peek(self, *values: str) -> bool:
        return self.i < len(self.tokens) and self.tokens[self.i][0] != "text" and self.tokens[self.i][1] in values

    def take(self, *values: str) -> tuple[str, str, int]:
        if self.i >= len(self.tokens):
            raise self.fail(self.end, "the end of an expression")
        token = self.tokens[self.i]
        if values and not self.peek(*values):
            raise self.fail(token[2], f"{token[1]!r}")
        self.i += 1
        return token

    def whole(self, scope: Scope) -> Value:
        value = self.either(scope)
        if self.i < len(self.tokens):
            raise self.fail(self.tokens[self.i][2], f"{self.tokens[self.i][1]!r}")
        return value

    def either(self, scope: Scope) -> Value:
        value = self.both(scope)
        while self.peek("or"):
            at = self.take()[2]
            value = Value("truth", self.truth(value, at) | self.truth(self.both(scope), at))
        return value

    def both(self, scope: Scope) -> Value:
        value = self.negated(scope)
        while self.peek("and"):
            at = self.take()[2]
            value = Value("truth", self.truth(value, at) & self.truth(self.negated(scope), at))
        return value

    def negated(self, scope: Scope) -> Value:
        if self.peek("not"):
            at = self.take()[2]
            return Value("truth", ~self.truth(self.negated(scope), at))
        return self.compared(scope)

    def truth(self, value: Value, at: int) -> Column:
        if value.kind not in ("text", "number", "truth"):
            raise self.fail(at, f"a condition on {value.kind}")
        return value.truth()

    def compared(self, scope: Scope) -> Value:
        left = self.summed(scope)
        if not self.peek("==", "!=", "<", ">", "<=", ">=", "in"):
            return left
        _, mark, at = self.take()
        right = self.summed(scope)
        if left.kind != right.kind or left.kind not in ("text", "number", "truth") or mark == "in" and left.kind != "text":
            raise self.fail(at, f"{mark!r} between {left.kind} and {right.kind}")
        a, b = left.column, right.column
        return Value("truth", {"==": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[mark] if mark != "in" else F.contains(b, a))

    def summed(self, scope: Scope) -> Value:
        value = self.filtered(scope)
        while self.peek("+", "%"):
            _, mark, at = self.take()
            other = self.filtered(scope)
            if value.kind != other.kind or value.kind not in ("text", "number") or mark == "%" and value.kind == "text":
                raise self.fail(at, f"{mark!r} between {value.kind} and {other.kind}")
            if value.kind == "text":
                value = Value("text", F.concat(value.column, other.column))
            else:
                value = Value("number", value.column + other.column if mark == "+" else value.column % other.column)
        return value

    def filtered(self, scope: Scope) -> Value:
        value = self.atom(scope)
        while self.peek("|"):
            self.take()
            _, name, at = self.take()
            if name != "trim" or value.kind != "text":
                raise self.fail(at, f"the filter {name!r} on {value.kind}")
            value = Value("text", strip(value.column))
        return value

    def atom(self, scope: Scope) -> Value:
        kind, text, at = self.take()
        if kind == "text":
            return Value("text", F.lit(ast.literal_eval(text.replace("\n", "\\n"))))
        if kind == "number":
            return Value("number", F.lit(int(text)))
        if text == "(":
            value = self.either(scope)
            self.take(")")
            return value
        if kind != "name":
            raise self.fail(at, f"{text!r}")
        if text in ("true", "True", "false", "False"):
            return Value("truth", F.lit(text.lower() == "true"))
        if text == "raise_exception":
            self.take("(")
            message = self.either(scope)
            self.take(")")
            return Value("text", F.raise_error(message.column).cast("string"))
        if text not in scope:
            raise self.fail(at, f"the name {text!r}")
        return self.parts(scope[text], text)

    def parts(self, value: Value, name: str) -> Value:
        while self.peek("[", "."):
            mark = self.take()[1]
            kind, part, at = self.take()
            if mark == "[":
                self.take("]")
                part = ast.literal_eval(part) if kind == "text" else part
            if value.kind == "messages" and kind == "number" and mark == "[":
                value = Value("message", F.get(value.column, F.lit(int(part))))
            elif value.kind == "message" and part in ("role", "content"):
                value = Value("text", null_to_empty(value.column[part]))
            elif value.kind == "loop" and part in ("first", "last", "index", "index0"):
                i, n = value.column, value.also
                value = {"first": Value("truth", i == 0), "last": Value("truth", i == n - 1),
                         "index": Value("number", i + 1), "index0": Value("number", i)}[part]
            else:
                raise self.fail(at, f"{part!r} of {name!r}")
        return value


class UserTemplate:
    """A template's text, read once; ``names`` are further names it may use, such as ``bos_token``."""

    def __init__(self, source: str, names: dict[str, str] | None = None):
        self.source, self.names = source, dict(names or {})
        self.tree, rest = self._block(self._pieces(), 0, ())
        if rest is not None:
            raise self.fail(rest[2], f"{rest[1]!r} without a beginning")

    def fail(self, at: int, what: str) -> TemplateError:
        line = self.source.count("\n", 0, at) + 1
        column = at - (self.source.rfind("\n", 0, at) + 1) + 1
        return TemplateError(f"{what} is not taken at line {line}, column {column} of the template")

    def _pieces(self) -> list[tuple[str, str, int]]:
        """(kind, content, place): ``text``, ``{{`` or ``{%``."""
        out: list[tuple[str, str, int]] = []
        at, source, strip_next, drop_newline = 0, self.source, False, False
        while True:
            tag = _TAG.search(source, at)
            text = source[at:tag.start() if tag else len(source)]
            if strip_next:
                text = text.lstrip()
            elif drop_newline and text.startswith("\n"):
                text = text[1:]
            if tag and tag.group().endswith("-"):
                text = text.rstrip()
            elif tag and tag.group()[:2] != "{{":
                line = text.rpartition("\n")[2]
                before = source[:tag.start()].rpartition("\n")[2]
                if not before.strip(" \t"):
                    text = text[:len(text) - len(line)] + line.rstrip(" \t") if line else text
            if text:
                out.append(("text", text, at))
            if not tag:
                return out
            opening = tag.group()[:2]
            stop = source.find(_CLOSING[opening], tag.end())
            if stop < 0:
                raise self.fail(tag.start(), f"{opening!r} without an end")
            content = source[tag.end():stop]
            strip_next = content.endswith("-")
            drop_newline = opening != "{{"
            if opening != "{#":
                out.append((opening, content[:-1] if strip_next else content, tag.end()))
            at = stop + 2

    def _block(self, pieces: list, i: int, ends: tuple[str, ...]):
        """Nodes up to one of the tags in ``ends``; (nodes, (index, tag, place)) or (nodes, None) at the end."""
        nodes = []
        while i < len(pieces):
            kind, content, at = pieces[i]
            i += 1
            if kind == "text":
                nodes.append(("text", content))
                continue
            if kind == "{{":
                nodes.append(("out", content, at))
                continue
            head = re.match(r"\s*(\w*)", content)
            word, rest, place = head.group(1), content[head.end():], at + head.end()
            if word in ends or word in ("endfor", "endif", "else", "elif"):
                return nodes, (i, word, at, rest, place)
            if word == "set":
                match = re.match(r"\s*([A-Za-z_]\w*)\s*=(?!=)", rest)
                if not match:
                    raise self.fail(place, f"'set{rest}'")
                nodes.append(("set", match.group(1), rest[match.end():], place + match.end()))
            elif word == "for":
                match = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+([A-Za-z_]\w*)\s*", rest)
                if not match:
                    raise self.fail(place, f"'for{rest}'")
                body, end = self._block(pieces, i, ("endfor",))
                if end is None or end[1] != "endfor":
                    raise self.fail(at, "a loop without its end")
                nodes.append(("for", match.group(1), match.group(2), body, at))
                i = end[0]
            elif word == "if":
                branches, condition = [], (rest, place)
                while True:
                    body, end = self._block(pieces, i, ("elif", "else", "endif"))
                    if end is None or end[1] == "endfor":
                        raise self.fail(at, "a condition without its end")
                    branches.append((condition, body))
                    i = end[0]
                    if end[1] == "endif":
                        break
                    if condition is None:
                        raise self.fail(end[2], f"{end[1]!r} behind 'else'")
                    condition = (end[3], end[4]) if end[1] == "elif" else None
                nodes.append(("if", branches))
            else:
                raise self.fail(at, f"{word!r}")
        return nodes, None

    def _text(self, nodes: list, scope: Scope) -> Column:
        """The text that nodes make; ``set`` changes ``scope``."""
        parts = [F.lit("")]
        for node in nodes:
            if node[0] == "text":
                parts.append(F.lit(node[1]))
            elif node[0] == "out":
                value = _Expression(node[1], self.fail, node[2]).whole(scope)
                if value.kind not in ("text", "number"):
                    raise self.fail(node[2], f"{value.kind} as text")
                parts.append(value.column.cast("string"))
            elif node[0] == "set":
                scope[node[1]] = _Expression(node[2], self.fail, node[3]).whole(scope)
            elif node[0] == "for":
                parts.append(self._loop(node, scope))
            else:
                parts.append(self._choice(node[1], scope))
        return F.concat(*parts)

    def _loop(self, node: tuple, scope: Scope) -> Column:
        _, name, over, body, at = node
        if over not in scope or scope[over].kind != "messages":
            raise self.fail(at, f"a loop over {over!r}")
        messages = scope[over].column

        def one(message: Column, i: Column) -> Column:
            inner = scope | {name: Value("message", message), "loop": Value("loop", i, F.size(messages))}
            return self._text(body, inner)

        return F.array_join(F.transform(messages, one), "")

    def _choice(self, branches: list, scope: Scope) -> Column:
        if not branches:
            return F.lit("")
        (condition, body), rest = branches[0], branches[1:]
        if condition is None:
            return self._text(body, scope)
        expression = _Expression(condition[0], self.fail, condition[1])
        holds = expression.truth(expression.whole(scope), condition[1])
        yes, no = dict(scope), dict(scope)
        text = F.when(holds, self._text(body, yes)).otherwise(self._choice(rest, no))
        for name in yes.keys() & no.keys():
            a, b = yes[name], no[name]
            if a is not b and a.kind == b.kind and a.kind in ("text", "number", "truth"):
                scope[name] = Value(a.kind, F.when(holds, a.column).otherwise(b.column))
        return text

    def render(self, messages: Column, add_generation: bool = False) -> Column:
        """Text of a conversation: an array of (role, content)."""
        scope: Scope = {name: Value("text", F.lit(text)) for name, text in self.names.items()}
        scope |= {"messages": Value("messages", messages), "add_generation_prompt": Value("truth", F.lit(add_generation))}
        return self._text(self.tree, scope)
