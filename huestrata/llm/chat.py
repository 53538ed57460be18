"""Chat formatting with a template compiler.

A small template language is parsed into a syntax tree, constants are folded, and the tree
is turned into Python closures. Templates see only the values they are given: there is no
attribute access on Python objects, no call but the named filters, and no import.

  {{ expr }}                         output
  {% for m in expr %}..{% endfor %}  loop; inside, loop.index, loop.first, loop.last
  {% if e %}..{% elif e %}..{% else %}..{% endif %}
  {% set name = expr %}
  {% generation %}..{% endgeneration %}   output under the loss mask
  {# comment #}; a minus inside a tag trims white space on that side
  expr: strings, integers, true/false/none, names, a.b, a['b'], + - * ~, comparisons, in,
        and/or/not, filters |escape |trim |upper |lower |length |default(x), parentheses

`messages` may be a lazy stream: a loop looks one message ahead, never further, so that a
conversation of any length is rendered in bounded memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huestrata.llm.common import slices

#: The control strings of the default template, and the letter that escapes them.
TURN_START, TURN_END, ESCAPE = "<|im_start|>", "<|im_end|>", "\\"

DEFAULT_TEMPLATE = (
    "{%- for m in messages -%}"
    "{{ '<|' ~ 'im_start|>' }}{{ m.role | escape_role }}{{ '\n' }}"
    "{%- if m.role == 'assistant' -%}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{%- else -%}{{ m.text | escape }}{%- endif -%}"
    "{{ '<|' ~ 'im_end|>' }}{{ '\n' }}"
    "{%- endfor -%}"
)


def escape(text: str) -> str:
    """Text in which no control string, and in a role no line break, is left; unescape() gives it back."""
    return text.replace(ESCAPE, ESCAPE + ESCAPE).replace("<|", "<" + ESCAPE + "|")


def escape_role(text: str) -> str:
    return escape(text).replace("\n", ESCAPE + "n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.DOTALL) if ESCAPE in text else text


class TemplateError(ValueError):
    pass


# --- parsing ------------------------------------------------------------------------------

_TAG = re.compile(r"\{\{-?|\{%-?|\{#")
_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+*~|.,()\[\]<>=]))""", re.DOTALL)
_WORDS = {"and", "or", "not", "in", "is", "if", "else", "true", "false", "none", "True", "False", "None"}

Node = tuple  # (kind, ...); constants are ("const", value)


def _lex(source: str) -> list[tuple[str, str, list]]:
    """(kind, text, tokens) items: kind is text, out or tag."""
    items, at, trim = [], 0, False
    while at < len(source):
        m = _TAG.search(source, at)
        text = source[at : m.start()] if m else source[at:]
        text = text.lstrip() if trim else text
        trim = False
        if m and m[0].endswith("-"):
            text = text.rstrip()
        if text:
            items.append(("text", text, []))
        if not m:
            break
        close = {"{{": "}}", "{%": "%}", "{#": "#}"}[m[0][:2]]
        if close == "#}":
            end = source.find(close, m.end())
            if end < 0:
                raise TemplateError("a comment is not closed")
            at = end + 2
            continue
        tokens, at = _tokens(source, m.end(), close)
        trim = source[at] == "-"
        at += 2 + trim
        items.append(("out" if close == "}}" else "tag", "", tokens))
    return items


def _tokens(source: str, at: int, close: str) -> tuple[list[tuple[str, Any]], int]:
    out = []
    while True:
        while at < len(source) and source[at].isspace():
            at += 1
        if source.startswith(close, at) or source.startswith("-" + close, at):
            return out, at
        m = _TOKEN.match(source, at)
        if not m or m.end() == at:
            raise TemplateError(f"unreadable at {source[at:at + 20]!r}")
        if m["num"]:
            out.append(("const", int(m["num"])))
        elif m["str"]:
            body = re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1]), m["str"][1:-1], flags=re.DOTALL)
            out.append(("const", body))
        elif m["name"]:
            out.append(("word" if m["name"] in _WORDS else "name", m["name"]))
        else:
            out.append(("op", m["op"]))
        at = m.end()


class _Expression:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, tokens: list):
        self.tokens, self.at = tokens, 0

    def peek(self) -> tuple:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", None)

    def take(self, *values) -> Any:
        kind, value = self.peek()
        if kind in ("op", "word", "name") and value in values:
            self.at += 1
            return value
        return None

    def need(self, value) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing")

    def name(self) -> str:
        kind, value = self.peek()
        if kind != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return value

    def whole(self) -> Node:
        node = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"left over: {self.peek()[1]!r}")
        return node

    def either(self) -> Node:
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> Node:
        node = self.negation()
        while self.take("and"):
            node = ("and", node, self.negation())
        return node

    def negation(self) -> Node:
        return ("not", self.negation()) if self.take("not") else self.comparison()

    def comparison(self) -> Node:
        node = self.sum()
        while True:
            if op := self.take("==", "!=", "<", ">", "<=", ">=", "in"):
                node = ("binary", op, node, self.sum())
            elif self.peek() == ("word", "not") and self.tokens[self.at + 1 : self.at + 2] == [("word", "in")]:
                self.at += 2
                node = ("not", ("binary", "in", node, self.sum()))
            else:
                return node

    def sum(self) -> Node:
        node = self.product()
        while op := self.take("+", "-", "~"):
            node = ("binary", op, node, self.product())
        return node

    def product(self) -> Node:
        node = self.filtered()
        while self.take("*"):
            node = ("binary", "*", node, self.filtered())
        return node

    def filtered(self) -> Node:
        node = self.member()
        while self.take("|"):
            name, extra = self.name(), []
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            if self.take("("):
                while not self.take(")"):
                    extra.append(self.either())
                    self.take(",")
            node = ("filter", name, node, *extra)
        return node

    def member(self) -> Node:
        node = self.atom()
        while True:
            if self.take("."):
                node = ("item", node, ("const", self.name()))
            elif self.take("["):
                node = ("item", node, self.either())
                self.need("]")
            else:
                return node

    def atom(self) -> Node:
        kind, value = self.peek()
        self.at += 1
        if kind == "const":
            return ("const", value)
        if kind == "name":
            return ("name", value)
        if kind == "word" and value.lower() in ("true", "false", "none"):
            return ("const", {"true": True, "false": False, "none": None}[value.lower()])
        if (kind, value) == ("op", "("):
            node = self.either()
            self.need(")")
            return node
        if (kind, value) == ("op", "-"):
            return ("binary", "-", ("const", 0), self.member())
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> Node:
    """The syntax tree of a template."""
    items, at = _lex(source), 0

    def block(*ends: str) -> tuple[list[Node], _Expression | None]:
        nonlocal at
        body: list[Node] = []
        while at < len(items):
            kind, text, tokens = items[at]
            at += 1
            if kind == "text":
                body.append(("text", text))
            elif kind == "out":
                body.append(("out", _Expression(tokens).whole()))
            else:
                e = _Expression(tokens)
                if e.peek()[1] in ends:
                    return body, e
                word = e.peek()[1]
                e.at += 1
                if word == "for":
                    name = e.name()
                    e.need("in")
                    over = e.whole()
                    inner, _ = block("endfor")
                    body.append(("for", name, over, ("block", inner)))
                elif word == "if":
                    body.append(branch(e.whole()))
                elif word == "set":
                    name = e.name()
                    e.need("=")
                    body.append(("set", name, e.whole()))
                elif word == "generation":
                    inner, _ = block("endgeneration")
                    body.append(("generation", ("block", inner)))
                else:
                    raise TemplateError(f"unknown tag {word!r}")
        if ends:
            raise TemplateError(f"{ends[0]!r} is missing")
        return body, None

    def branch(test: Node) -> Node:
        then, e = block("elif", "else", "endif")
        word = e.take("elif", "else", "endif")
        if word == "elif":
            return ("if", test, ("block", then), branch(e.whole()))
        other = block("endif")[0] if word == "else" else []
        return ("if", test, ("block", then), ("block", other))

    return ("block", block()[0])


# --- folding ------------------------------------------------------------------------------


def _show(x: Any) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


FILTERS: dict[str, Callable] = {
    "escape": lambda x: escape(_show(x)),
    "escape_role": lambda x: escape_role(_show(x)),
    "trim": lambda x: _show(x).strip(),
    "upper": lambda x: _show(x).upper(),
    "lower": lambda x: _show(x).lower(),
    "length": len,
    "default": lambda x, other="": other if x is None else x,
}

BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "~": lambda a, b: _show(a) + _show(b),
}


def fold(node: Node) -> Node:
    """The same tree with constant expressions evaluated, dead branches dropped and neighbouring texts joined."""
    kind = node[0]
    if kind == "block":
        out: list[Node] = []
        for child in map(fold, node[1]):
            for x in child[1] if child[0] == "block" else [child]:
                if x[0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + x[1])
                elif x != ("text", ""):
                    out.append(x)
        return ("block", out)
    node = tuple(fold(x) if isinstance(x, tuple) else x for x in node)
    if kind == "out" and node[1][0] == "const":
        return ("text", _show(node[1][1]))
    if kind == "binary" and node[2][0] == node[3][0] == "const":
        return ("const", BINARY[node[1]](node[2][1], node[3][1]))
    if kind == "filter" and all(x[0] == "const" for x in node[2:]):
        return ("const", FILTERS[node[1]](*(x[1] for x in node[2:])))
    if kind == "not" and node[1][0] == "const":
        return ("const", not node[1][1])
    if kind in ("and", "or") and node[1][0] == "const":
        return node[2] if bool(node[1][1]) == (kind == "and") else node[1]
    if kind == "if" and node[1][0] == "const":
        return node[2] if node[1][1] else node[3]
    return node


# --- closures -----------------------------------------------------------------------------

Piece = tuple[str, bool]  # text, and whether it is under the loss mask


def _value(node: Node) -> Callable[[dict], Any]:
    kind = node[0]
    if kind == "const":
        value = node[1]
        return lambda env: value
    if kind == "name":
        name = node[1]
        return lambda env: env.get(name)
    if kind == "item":
        of, key = _value(node[1]), _value(node[2])

        def item(env):
            where, what = of(env), key(env)
            if isinstance(where, dict):
                return where.get(what)
            return where[what] if isinstance(where, (list, str)) and isinstance(what, int) and -len(where) <= what < len(where) else None

        return item
    if kind == "binary":
        f, a, b = BINARY[node[1]], _value(node[2]), _value(node[3])
        return lambda env: f(a(env), b(env))
    if kind == "filter":
        f, parts = FILTERS[node[1]], [_value(x) for x in node[2:]]
        if len(parts) == 1:
            only = parts[0]
            return lambda env: f(only(env))
        return lambda env: f(*(p(env) for p in parts))
    if kind == "not":
        a = _value(node[1])
        return lambda env: not a(env)
    a, b = _value(node[1]), _value(node[2])
    return (lambda env: a(env) and b(env)) if kind == "and" else (lambda env: a(env) or b(env))


def _render(node: Node, masked: bool = False) -> Callable[[dict], Iterator[Piece]]:
    kind = node[0]
    if kind == "block":
        parts = [_render(x, masked) for x in node[1]]
        if len(parts) == 1:
            return parts[0]

        def block(env):
            for p in parts:
                yield from p(env)

        return block
    if kind == "text":
        piece = (node[1], masked)
        return lambda env: iter((piece,))
    if kind == "out":
        value = _value(node[1])
        return lambda env: iter(((_show(value(env)), masked),))
    if kind == "generation":
        return _render(node[1], True)
    if kind == "set":
        name, value = node[1], _value(node[2])

        def put(env):
            env[name] = value(env)
            return iter(())

        return put
    if kind == "if":
        test, then, other = _value(node[1]), _render(node[2], masked), _render(node[3], masked)
        return lambda env: then(env) if test(env) else other(env)
    name, over, body = node[1], _value(node[2]), _render(node[3], masked)

    def loop(env):
        stream = iter(over(env) or ())
        ahead, index = next(stream, None), 0
        while ahead is not None:
            now, ahead = ahead, next(stream, None)
            index += 1
            yield from body(env | {name: now, "loop": {"index": index, "first": index == 1, "last": ahead is None}})

    return loop


def compile_template(source: str) -> Callable[[dict], Iterator[Piece]]:
    """A template as a function from named values to (text, masked) pieces."""
    return _render(fold(parse(source)))


# --- DataFrames ---------------------------------------------------------------------------

_PIECE = "piece_no long, formatted string, mask_start array<long>, mask_end array<long>"
#: Characters of formatted text after which a piece may end, and of rows handed over at once.
_PIECE_CHARS, _BATCH_CHARS = 4096, 4 << 20


def format_conversations(turns: DataFrame, template: str = DEFAULT_TEMPLATE) -> DataFrame:
    """Formatted conversations as rows conv_id, piece_no, formatted, mask_start, mask_end.

    The pieces of a conversation, joined in order, are its formatted text; masks are
    code-point offsets within a piece. Turns go by turn, then role and text; null texts and
    roles count as empty, a null turn comes first, null conv_ids make one conversation, and
    repeated rows are repeated turns. conv_id may be of any type with an order, turn must be
    a number. A conversation lies in one partition, but is sorted on disk and streamed:
    nobody ever holds the whole of it. Extra columns are ignored.
    """
    rows = turns.select(
        F.col("conv_id").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"),
    )
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "_t")
    names = ["conv_id", "piece_no", "formatted", "mask_start", "mask_end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        kind: list[pa.DataType] = []

        def rows_of() -> Iterator[tuple]:
            for b in slices(batches):
                kind[:] = [b.schema.field("conv_id").type]
                yield from zip(b.column("conv_id").to_pylist(), ({"role": r, "text": t} for r, t in zip(b.column("role").to_pylist(), b.column("_t").to_pylist(), strict=True)), strict=True)

        stream = rows_of()
        ahead = next(stream, None)
        out: list[tuple] = []
        chars = 0

        def flush() -> pa.RecordBatch:
            nonlocal chars
            kinds = [kind[0], pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            batch = pa.RecordBatch.from_arrays([pa.array([row[i] for row in out], k) for i, k in enumerate(kinds)], names=names)
            out.clear()
            chars = 0
            return batch

        while ahead is not None:
            conv = ahead[0]

            def messages():
                nonlocal ahead
                while ahead is not None and ahead[0] == conv:
                    now, ahead = ahead[1], next(stream, None)
                    yield now

            held: list[str] = []
            starts: list[int] = []
            ends: list[int] = []
            size = no = 0
            for text, masked in render({"messages": messages()}):
                if masked and text:
                    if ends and ends[-1] == size:
                        ends[-1] = size + len(text)
                    else:
                        starts.append(size)
                        ends.append(size + len(text))
                held.append(text)
                size += len(text)
                if not masked and size >= _PIECE_CHARS:
                    out.append((conv, no, "".join(held), starts, ends))
                    chars += size
                    no, size, held, starts, ends = no + 1, 0, [], [], []
                    if chars >= _BATCH_CHARS:
                        yield flush()
            if held or no == 0:
                out.append((conv, no, "".join(held), starts, ends))
                chars += size + 64
                if chars >= _BATCH_CHARS:
                    yield flush()
            while ahead is not None and ahead[0] == conv:  # turns that the template left unread
                ahead = next(stream, None)
        if out:
            yield flush()

    return rows.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {_PIECE}")


_TURN = re.compile(r"<\|im_start\|>((?:[^\\\n]|\\.)*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


class _Reader:
    """Reads one formatted conversation back, piece by piece."""

    def __init__(self):
        self.turns, self.loss, self.rest = hashlib.sha256(), hashlib.sha256(), ""
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def add(self, formatted: str, starts, ends) -> None:
        self.formatted_chars += len(formatted)
        for a, b in zip(starts, ends, strict=True):
            said = unescape(formatted[a:b])
            self.loss_chars += len(said)
            self.loss.update(said.encode("utf-8", "surrogatepass"))
        text, at = self.rest + formatted, 0
        for m in _TURN.finditer(text):
            if m.start() != at:
                raise ValueError("the formatted text is not a row of turns")
            self.n_turns += 1
            self.turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
            at = m.end()
        self.rest = text[at:]

    def row(self, conv) -> tuple:
        if self.rest:
            raise ValueError("the formatted text ends inside a turn")
        return (conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars)


def read_back(pieces: DataFrame) -> DataFrame:
    """Per conversation, parsed from its formatted pieces: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    pieces must come straight from format_conversations with the default template: the
    pieces of a conversation are next to each other and in order within a partition.
    """

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, conv, out = None, None, []
        id_kind = pa.null()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([row[i] for row in out], k) for i, k in enumerate([id_kind, *kinds])], names=names)
            out.clear()
            return batch

        for batch in slices(batches, "formatted"):
            id_kind = batch.schema.field("conv_id").type
            for c, text, starts, ends in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "formatted", "mask_start", "mask_end")), strict=True):
                if reader is None or c != conv:
                    if reader is not None:
                        out.append(reader.row(conv))
                    reader, conv = _Reader(), c
                reader.add(text, starts, ends)
            if out:
                yield flush()
        if reader is not None:
            out.append(reader.row(conv))
            yield flush()

    kind = pieces.schema["conv_id"].dataType.simpleString()
    return pieces.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
