"""Source texts to flattened syntax trees. A parser is any picklable callable, text -> rows; two small ones come along.

The Python one reads the standard library's trees; the scanner finds declarations, imports and calls of brace
languages by pattern, with strings and comments masked, which is an approximation.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..schemas import SYNTAX
from .files import language_of


@dataclass
class Node:
    """A node of a tree in the making: a span of the source, a kind, and the role in its parent."""

    kind: str
    start: int
    end: int
    role: str | None = None
    children: list[Node] = field(default_factory=list)


Parser = Callable[[str], Node | None]


def flatten(root: Node, source: str) -> Iterator[tuple]:
    """Rows of a tree in pre-order, numbered so that a subtree is an interval."""
    starts = [0]
    for m in re.finditer("\n", source):
        starts.append(m.end())

    def place(offset: int) -> tuple[int, int]:
        line = bisect_right(starts, offset) - 1
        return line, offset - starts[line]

    order: list[tuple[Node, int | None, int]] = []
    todo: list[tuple[Node, int | None, int]] = [(root, None, 0)]
    while todo:
        entry = todo.pop()
        k, children = len(order), entry[0].children
        order.append(entry)
        for i in range(len(children) - 1, -1, -1):
            todo.append((children[i], k, i))
    sizes = [1] * len(order)
    for k in range(len(order) - 1, 0, -1):
        sizes[order[k][1]] += sizes[k]
    for k, (n, parent, at) in enumerate(order):
        yield (k, parent, at, n.kind, n.role, *place(n.start), *place(n.end), k + sizes[k] - 1, source[n.start : n.end])


def parse_python(source: str) -> Node | None:
    """Functions, classes, imports, calls and docstrings of Python; null if it isn't Python."""
    marked = source.startswith("\ufeff")
    try:
        tree = ast.parse(source[1:] if marked else source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    starts = [int(marked), *(m.end() for m in re.finditer("\r\n|\r|\n", source))]
    ends = [*starts[1:], len(source)]

    def offset(line: int, column: int) -> int:
        return starts[line - 1] + len(source[starts[line - 1] : ends[line - 1]].encode("utf-8", "replace")[:column].decode(errors="ignore"))

    def span(n: ast.AST) -> tuple[int, int]:
        return offset(n.lineno, n.col_offset), offset(n.end_lineno, n.end_col_offset)

    root = Node("module", 0, len(source))
    todo: list[tuple[ast.AST, Node]] = [(tree, root)]  # in page order, without recursion: trees can be deep
    while todo:
        n, into = todo.pop()
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            node = Node("class_definition" if isinstance(n, ast.ClassDef) else "function_definition", *span(n))
            named = DEFINED.match(source, node.start)
            if named:
                node.children.append(Node("identifier", *named.span(1), "name"))
            body = Node("block", span(n.body[0])[0], node.end, "body")
            first = n.body[0]
            if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
                body.children.append(Node("expression_statement", *span(first), None, [Node("string", *span(first.value))]))
            node.children.append(body)
            into.children.append(node)
            into = body
        elif isinstance(n, (ast.Import, ast.ImportFrom)):
            into.children.append(Node("import_statement", *span(n)))
            continue
        elif isinstance(n, ast.Call):
            called = Node("attribute" if isinstance(n.func, ast.Attribute) else "identifier", *span(n.func), "function")
            node = Node("call", *span(n), None, [called])
            into.children.append(node)
            into = node
        todo += [(c, into) for c in reversed([*ast.iter_child_nodes(n)])]
    return root


#: What stands between a definition's start and its name, as it is written: the tree's own name may be normalised.
DEFINED = re.compile(r"(?:async[\s\\]+)?(?:def|class)[\s\\]+(\w+)")
MASKED = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.DOTALL)
DECLARED = re.compile(
    r"\b(?P<class>class|interface|trait|enum|struct|impl)\s+(?P<class_name>\w+)[^;{}()]*\{|\b(?:function|func|fn|def)\s+(?P<function>\w+)\s*[^;{}]*\{|(?P<method>\b\w++)\s*+\([^;{}()]*\)\s*(?:const|throws [\w, .]+|:\s*[\w<>\[\], |]+|->\s*[^;{}]+)?\s*\{"
)
IMPORTED = re.compile(r"^[ \t]*(?:import|use|#include|using)\b[^\n;]*;?", re.MULTILINE)
CALLED = re.compile(r"(?<![\w.])((?:[\w$]++\s*+\.\s*+)*+)([\w$]++)\s*+\(")
MADE = re.compile(r"\bnew\s+$")
WORDS = frozenset("if for while switch catch return function func fn def new sizeof typeof await else do".split())
KIND_OF = {"class": "class_declaration", "interface": "interface_declaration", "trait": "trait_item", "enum": "enum_declaration", "struct": "struct_item", "impl": "impl_item"}


def blocks(plain: str) -> dict[int, int]:
    """Where each brace's block ends."""
    ends: dict[int, int] = {}
    stack: list[int] = []
    for m in re.finditer(r"[{}]", plain):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            ends[stack.pop()] = m.end()
    return ends


def declarations(source: str, plain: str, ends: dict[int, int]) -> tuple[list[Node], set[int]]:
    """Imports and declarations of a brace language, and where declared names stand. ``plain``: the source with strings and comments masked."""
    found = [Node("import_statement", m.start() + len(m[0]) - len(m[0].lstrip()), m.end()) for m in IMPORTED.finditer(source) if plain[m.start() : m.end()].strip()]
    heads: set[int] = set()
    for m in DECLARED.finditer(plain):
        group = "class_name" if m["class"] else "function" if m["function"] else "method"
        if m[group] in WORDS:
            continue
        kind = KIND_OF[m["class"]] if m["class"] else "function_declaration" if m["function"] else "method_definition"
        node = Node(kind, m.start(), ends.get(m.end() - 1, len(plain)))
        node.children.append(Node("identifier", m.start(group), m.end(group), "name"))
        heads.add(m.start(group))
        found.append(node)
    return found, heads


def nested(source: str, found: list[Node]) -> Node:
    """A tree of nodes by their spans; children that nodes have already stay theirs, and what lies within such a child goes into it."""
    root = Node("program", 0, len(source))
    open_ = [root]
    todo: list[tuple[Node, Node | None]] = [(n, None) for n in found]
    placed: list[tuple[Node, Node | None]] = []
    while todo:  # children that can hold others take their part in the nesting
        node, parent = todo.pop()
        placed.append((node, parent))
        for c in node.children:
            if c.children or c.kind in HOLDERS:
                todo.append((c, node))
    for node, parent in sorted(placed, key=lambda x: (x[0].start, -x[0].end, x[1] is not None)):
        while len(open_) > 1 and (open_[-1].end <= node.start or parent is not None and open_[-1] is not parent and open_[-1].start == node.start and not within(node, open_[-1])):
            open_.pop()
        if parent is None:
            open_[-1].children.append(node)
        open_.append(node)
    return root


#: Children of found nodes that hold further ones.
HOLDERS = frozenset(["arrow_function", "lexical_declaration", "variable_declarator"])


def within(node: Node, other: Node) -> bool:
    return other.start <= node.start and node.end <= other.end


def scan_braces(source: str) -> Node:
    """Declarations, imports and calls of a brace language, nested by their braces."""
    plain = MASKED.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)
    found, heads = declarations(source, plain, blocks(plain))
    stack: list[int] = []
    closed: dict[int, int] = {}  # where each parenthesis ends
    for m in re.finditer(r"[()]", plain):
        if m[0] == "(":
            stack.append(m.start())
        elif stack:
            closed[stack.pop()] = m.end()
    for m in CALLED.finditer(plain):
        if m[2] in WORDS or m.start(2) in heads:
            continue
        before = plain[max(0, m.start() - 8) : m.start()]
        made = "new" in before and MADE.search(before)
        callee = Node("member_expression" if m[1] else "identifier", m.start(), m.end(2), None if made else "function")
        if m[1]:
            callee.children.append(Node("property_identifier", m.start(2), m.end(2), "property"))
        at = closed.get(m.end() - 1, len(plain))
        found.append(Node("new_expression" if made else "call_expression", m.start(), at, None, [callee]))
    return nested(source, found)


BRACES = ["java", "csharp", "go", "rust", "c", "cpp", "php"]
SCRIPTS = ["typescript", "tsx", "javascript"]


def default_parsers() -> dict[str, Parser]:
    from .scripts import parse_ruby, scan_script

    return {"python": parse_python, "ruby": parse_ruby} | dict.fromkeys(BRACES, scan_braces) | dict.fromkeys(SCRIPTS, scan_script)


#: The kind of the only row of a file on which its parser failed; the row's text is the error.
ERROR = "ERROR"
#: Rows of a batch, about.
BATCH = 20_000


def parse_sources(source_files: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """``source_files`` (repo, file_path, source) to ``schemas.SYNTAX``.

    Files of other languages, and ones a parser refuses (returns None for), have no rows. A file on which a parser fails has
    one, of kind ERROR; the others go on.
    """
    parsers = default_parsers() if parsers is None else parsers
    own = source_files.select("repo", "file_path", "source", language_of(F.col("file_path")).alias("language")).filter(F.col("language").isin([*parsers]) & F.col("source").isNotNull())

    def tree(source: str, parser: Parser) -> list[tuple]:
        try:
            root = parser(source)
            return [] if root is None else [*flatten(root, source)]
        except Exception as e:
            return [(0, None, 0, ERROR, None, 0, 0, 0, 0, 0, f"{type(e).__name__}: {e}")]

    schema = to_arrow_schema(SYNTAX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        table = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        for x in batches:
            for repo, path, source, language in zip(*(c.to_pylist() for c in x.columns), strict=True):
                rows += [(repo, path, language, *r) for r in tree(source, parsers[language])]
                if len(rows) >= BATCH:
                    yield table()
                    rows.clear()
        if rows:
            yield table()

    return own.mapInArrow(run, SYNTAX)
