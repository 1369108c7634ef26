"""Chat formatting by a template compiler (operator 8).

The template language has text, ``{{ expression }}``, ``{% for x in messages %}``,
``{% if %} / {% elif %} / {% else %}`` and ``{% generation %}``, whose body is under
the loss mask.  Expressions know strings, integers, booleans, the loop variable's
``role`` and ``text``, ``loop.first / last / index``, ``== != + and or not`` and the
filters ``escape`` and ``trim``; there are no calls, subscripts or other attributes, so
a template can reach nothing else.  A template is parsed into a tree, constants are
folded (joined literals, decided branches), and the tree becomes Python closures.

Rendering is lazy: messages come from an iterator and pieces leave one by one, so a
conversation of any length needs the memory of one turn.

Defined results: null role or text is empty; turns with an equal number are ordered by
role, then text; a conversation without rows does not occur; a null conversation id is
one conversation; ids may be of any type; equal rows are turns each; an empty table gives no
rows; a text of any length is one turn in memory; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame


TEMPLATE = (
    "{% for m in messages %}"
    "{{ '<|turn|>' + m.role + '<|text|>' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}"
    "{{ '<|end|>' }}"
    "{% endfor %}"
)
#: Strings that mark turns here or in other common formats; inside texts they are escaped.
CONTROL = ("<|turn|>", "<|text|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>")

Piece = tuple[str, bool]


class TemplateError(ValueError):
    """The template is not in the language."""


class Escaper:
    """Puts one more backslash after the first character of every control string, and takes one away."""

    def __init__(self, control: Iterable[str] = CONTROL):
        tails: dict[str, list[str]] = {}
        for c in control:
            if len(c) < 2 or "\\" in c:
                raise ValueError(f"not usable as a control string: {c!r}")
            tails.setdefault(c[0], []).append(re.escape(c[1:]))
        heads = "|".join(f"(?<={re.escape(h)})(?=\\\\*(?:{'|'.join(t)}))" for h, t in tails.items())
        marked = "|".join(f"(?<={re.escape(h)})\\\\(?=\\\\*(?:{'|'.join(t)}))" for h, t in tails.items())
        self._add, self._drop = re.compile(heads), re.compile(marked)

    def escape(self, text: str) -> str:
        return self._add.sub(r"\\", text)

    def unescape(self, text: str) -> str:
        return self._drop.sub("", text)


# Syntax tree.


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Field:
    of: str
    name: str


@dataclass(frozen=True)
class Op:
    name: str
    args: tuple


@dataclass(frozen=True)
class Emit:
    value: object


@dataclass(frozen=True)
class Loop:
    name: str
    body: tuple


@dataclass(frozen=True)
class Branch:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


_TAG = re.compile(r"\{\{(.*?)\}\}|\{%-?\s*(.*?)\s*-?%\}", re.S)
_TOKEN = re.compile(r"\s*(?:'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\"|(\d+)|([A-Za-z_]\w*)|(==|!=|[+|().]))")
_ESCAPES = {"n": "\n", "t": "\t"}
_FIELDS = {"role", "text"}
_LOOP = {"first", "last", "index"}


class _Expression:
    def __init__(self, source: str, names: set[str]):
        self.tokens: list[tuple[str, object]] = []
        self.names, self.at = names, 0
        pos, source = 0, source.rstrip()
        while pos < len(source):
            m = _TOKEN.match(source, pos)
            if not m:
                raise TemplateError(f"unexpected text in an expression: {source[pos:]!r}")
            pos = m.end()
            one, two, number, name, sign = m.groups()
            if one is not None or two is not None:
                self.tokens.append(("const", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), one if one is not None else two, flags=re.S)))
            elif number is not None:
                self.tokens.append(("const", int(number)))
            else:
                self.tokens.append(("name", name) if name else ("sign", sign))

    def peek(self, *values: object) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "const" and self.tokens[self.at][1] in values

    def take(self) -> tuple[str, object]:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def parse(self):
        tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"not expected here: {self.tokens[self.at][1]!r}")
        return tree

    def either(self):
        left = self.both()
        while self.peek("or"):
            self.take()
            left = Op("or", (left, self.both()))
        return left

    def both(self):
        left = self.negated()
        while self.peek("and"):
            self.take()
            left = Op("and", (left, self.negated()))
        return left

    def negated(self):
        if self.peek("not"):
            self.take()
            return Op("not", (self.negated(),))
        left = self.joined()
        if self.peek("==", "!="):
            return Op(str(self.take()[1]), (left, self.joined()))
        return left

    def joined(self):
        left = self.filtered()
        while self.peek("+"):
            self.take()
            left = Op("+", (left, self.filtered()))
        return left

    def filtered(self):
        left = self.atom()
        while self.peek("|"):
            self.take()
            kind, name = self.take()
            if kind != "name" or name not in ("escape", "trim"):
                raise TemplateError(f"no such filter: {name!r}")
            left = Op(str(name), (left,))
        return left

    def atom(self):
        kind, value = self.take()
        if kind == "const":
            return Const(value)
        if kind == "sign" and value == "(":
            tree = self.either()
            if self.take() != ("sign", ")"):
                raise TemplateError("a bracket is not closed")
            return tree
        if kind == "name" and value in ("true", "false"):
            return Const(value == "true")
        if kind == "name" and value in self.names and self.peek("."):
            self.take()
            part, field = self.take()
            if part == "name" and field in (_LOOP if value == "loop" else _FIELDS):
                return Field(str(value), str(field))
            raise TemplateError(f"{value} has no {field!r}")
        raise TemplateError(f"no such name: {value!r}")


def parse(template: str) -> tuple:
    """The syntax tree of a template."""
    stack: list[tuple[str, list, dict]] = [("root", [], {})]
    names: list[str] = []

    def expression(source: str):
        return _Expression(source, {*names, *(["loop"] if names else [])}).parse()

    def close(kind: str) -> tuple[list, dict]:
        if stack[-1][0] != kind or len(stack) == 1:
            raise TemplateError(f"nothing to close with end{kind}")
        _, body, more = stack.pop()
        return body, more

    pos = 0
    for m in _TAG.finditer(template):
        if m.start() > pos:
            stack[-1][1].append(Emit(Const(template[pos : m.start()])))
        pos = m.end()
        if m[1] is not None:
            stack[-1][1].append(Emit(expression(m[1])))
            continue
        word, _, rest = m[2].partition(" ")
        if word == "for":
            got = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+messages", rest.strip())
            if not got or got[1] in ("loop", "messages"):
                raise TemplateError(f"not a loop over messages: {rest!r}")
            if names:
                raise TemplateError("loops can't be nested: messages are read once")
            stack.append(("for", [], {"name": got[1]}))
            names.append(got[1])
        elif word == "endfor":
            body, more = close("for")
            names.pop()
            stack[-1][1].append(Loop(more["name"], tuple(body)))
        elif word == "if":
            stack.append(("if", [], {"cases": [], "test": expression(rest)}))
        elif word in ("elif", "else"):
            if stack[-1][0] != "if" or stack[-1][2]["test"] is None:
                raise TemplateError(f"{word} without if")
            kind, body, more = stack.pop()
            cases = [*more["cases"], (more["test"], tuple(body))]
            stack.append(("if", [], {"cases": cases, "test": expression(rest) if word == "elif" else None}))
        elif word == "endif":
            body, more = close("if")
            other = tuple(body)
            if more["test"] is not None:
                other = (Branch(more["test"], tuple(body), ()),)
            for test, then in reversed(more["cases"]):
                other = (Branch(test, then, other),)
            stack[-1][1].extend(other)
        elif word == "generation":
            stack.append(("generation", [], {}))
        elif word == "endgeneration":
            body, _ = close("generation")
            stack[-1][1].append(Generation(tuple(body)))
        else:
            raise TemplateError(f"no such tag: {word!r}")
    if pos < len(template):
        stack[-1][1].append(Emit(Const(template[pos:])))
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    return tuple(stack[0][1])


def text_of(value: object) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def _apply(name: str, args: list, escaper: Escaper) -> object:
    if name == "not":
        return not args[0]
    if name == "trim":
        return text_of(args[0]).strip()
    if name == "escape":
        return escaper.escape(text_of(args[0]))
    left, right = args
    if name == "+":
        return left + right if isinstance(left, int) and isinstance(right, int) else text_of(left) + text_of(right)
    return {"==": left == right, "!=": left != right, "and": left and right, "or": left or right}[name]


def fold(tree, escaper: Escaper):
    """The tree with constant expressions evaluated, dead branches gone and literals joined."""
    if isinstance(tree, tuple):
        out: list = []
        for node in tree:
            done = fold(node, escaper)
            for x in done if isinstance(done, tuple) else (done,):
                if isinstance(x, Emit) and isinstance(x.value, Const):
                    if text_of(x.value.value) == "":
                        continue
                    if out and isinstance(out[-1], Emit) and isinstance(out[-1].value, Const):
                        out[-1] = Emit(Const(text_of(out[-1].value.value) + text_of(x.value.value)))
                        continue
                out.append(x)
        return tuple(out)
    if isinstance(tree, Op):
        args = tuple(fold(a, escaper) for a in tree.args)
        if all(isinstance(a, Const) for a in args):
            return Const(_apply(tree.name, [a.value for a in args], escaper))
        return Op(tree.name, args)
    if isinstance(tree, Emit):
        return Emit(fold(tree.value, escaper))
    if isinstance(tree, Loop):
        return Loop(tree.name, fold(tree.body, escaper))
    if isinstance(tree, Generation):
        return Generation(fold(tree.body, escaper))
    if isinstance(tree, Branch):
        test = fold(tree.test, escaper)
        if isinstance(test, Const):
            return fold(tree.then if test.value else tree.other, escaper)
        return Branch(test, fold(tree.then, escaper), fold(tree.other, escaper))
    return tree


def _value(node, escaper: Escaper) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Field):
        return lambda env, of=node.of, name=node.name: env[of][name]
    args = [_value(a, escaper) for a in node.args]
    if node.name in ("and", "or"):
        a, b = args
        return (lambda env: a(env) and b(env)) if node.name == "and" else (lambda env: a(env) or b(env))
    return lambda env, name=node.name: _apply(name, [a(env) for a in args], escaper)


def _block(nodes: tuple, escaper: Escaper) -> Callable[[dict, bool], Iterator[Piece]]:
    made = [_node(n, escaper) for n in nodes]

    def run(env: dict, masked: bool) -> Iterator[Piece]:
        for f in made:
            yield from f(env, masked)

    return run


def _node(node, escaper: Escaper) -> Callable[[dict, bool], Iterator[Piece]]:
    if isinstance(node, Emit):
        value = _value(node.value, escaper)
        return lambda env, masked: iter(((text_of(value(env)), masked),))
    if isinstance(node, Generation):
        body = _block(node.body, escaper)
        return lambda env, masked: body(env, True)
    if isinstance(node, Branch):
        test, then, other = _value(node.test, escaper), _block(node.then, escaper), _block(node.other, escaper)
        return lambda env, masked: (then if test(env) else other)(env, masked)
    body = _block(node.body, escaper)

    def loop(env: dict, masked: bool) -> Iterator[Piece]:
        messages = iter(env["messages"])
        here = next(messages, None)
        index = 0
        while here is not None:
            after = next(messages, None)
            index += 1
            yield from body(env | {node.name: here, "loop": {"first": index == 1, "last": after is None, "index": index}}, masked)
            here = after

    return loop


class Template:
    """A compiled template: ``render(messages)`` yields ``(text, under the loss mask)``."""

    def __init__(self, source: str = TEMPLATE, control: Iterable[str] = CONTROL):
        self.escaper = Escaper(control)
        self.tree = fold(parse(source), self.escaper)
        self._run = _block(self.tree, self.escaper)

    def render(self, messages: Iterable[dict[str, str]]) -> Iterator[Piece]:
        return self._run({"messages": messages}, False)


_ROLE_OUT = {"\\": "\\\\", "<": "\\l"}
_ROLE_IN = re.compile(r"\\([\\l])")


def role_out(role: str) -> str:
    """A role that holds no ``<``, so that no control string starts in it."""
    return "".join(_ROLE_OUT.get(c, c) for c in role) if "<" in role or "\\" in role else role


def role_in(role: str) -> str:
    return _ROLE_IN.sub(lambda m: "<" if m[1] == "l" else "\\", role)


class Reader:
    """Reads turns and masked text back from formatted pieces, one turn in memory at a time."""

    def __init__(self, escaper: Escaper):
        self.escaper, self.buffer, self.masked = escaper, [], []
        self.turns = self.chars = self.loss = 0
        self.all, self.under = hashlib.sha256(), hashlib.sha256()

    def feed(self, text: str, masked: bool) -> None:
        self.chars += len(text)
        self.buffer.append(text)
        if masked:
            self.masked.append(text)
        if not masked and "<|end|>" in text:
            self._turns()

    def _turns(self) -> None:
        held = "".join(self.buffer)
        *done, rest = held.split("<|end|>")
        for turn in done:
            head, _, body = turn.partition("<|text|>")
            if not head.startswith("<|turn|>"):
                raise ValueError("a turn without its mark")
            self.turns += 1
            self.all.update(f"{role_in(head[len('<|turn|>'):])}\n{self.escaper.unescape(body)}\n".encode())
        self.buffer = [rest] if rest else []
        if self.masked:
            loss = self.escaper.unescape("".join(self.masked))
            self.loss += len(loss)
            self.under.update(loss.encode())
            self.masked = []


SCHEMA = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Scalar, Iterator[dict[str, str]]]]:
    """Conversations of sorted rows; each is read to its end before the next.  Ids stay Arrow scalars of any type."""
    flat = ((c, r or "", t or "") for b in batches for c, r, t in zip(b.column(0), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))
    held = next(flat, None)
    while held is not None:
        key = held[0]

        def messages(key=key) -> Iterator[dict[str, str]]:
            nonlocal held
            while held is not None and held[0] == key:
                here, held = held, None
                held = next(flat, None)
                yield {"role": role_out(here[1]), "text": here[2]}

        turns = messages()
        yield key, turns
        for _ in turns:
            pass


def formatted(rows: DataFrame, source: str = TEMPLATE, control: tuple[str, ...] = CONTROL) -> DataFrame:
    """conv_id, text, mask (start, end, ... code points under the loss) of each conversation."""
    Template(source, control)
    key = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(source, control)
        for conv, messages in _conversations(batches):
            out, mask, at = [], [], 0
            for text, masked in template.render(messages):
                if masked and text:
                    mask += [at, at + len(text)]
                out.append(text)
                at += len(text)
            yield pa.RecordBatch.from_arrays([pa.array([conv.as_py()], conv.type), pa.array(["".join(out)], pa.string()), pa.array([mask], pa.list_(pa.int64()))], ["conv_id", "text", "mask"])

    return _sorted(rows).mapInArrow(run, f"conv_id {key}, text string, mask array<long>")


def digests(rows: DataFrame, control: tuple[str, ...] = CONTROL) -> DataFrame:
    """Each conversation formatted and read back, piece by piece."""
    key = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id"] + [x.split(" ")[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(TEMPLATE, control)
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            ids, *cols = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array([c.as_py() for c in ids], ids[0].type)] + [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        for conv, messages in _conversations(batches):
            r = Reader(template.escaper)
            for text, masked in template.render(messages):
                r.feed(text, masked)
            out.append((conv, r.turns, r.all.hexdigest(), r.loss, r.under.hexdigest(), r.chars))
            if len(out) >= 5000:
                yield flush()
        if out:
            yield flush()

    return _sorted(rows).mapInArrow(run, f"conv_id {key}, {SCHEMA}")
