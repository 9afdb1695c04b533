"""Parsers of Ruby and of the script languages, on what people write."""

import pytest

from treeweave.sources.parse import default_parsers, flatten
from treeweave.sources.scripts import masked_ruby, masked_script, parse_ruby, scan_script

SCRIPT = r'''import x from './y'
export const a = () => { b(`t ${c(1)} { ${`in ${d(2)}`} } no(1)`); }
export default function f(x) { return /[{}"'`]/.test(x) ? g() : 1 / h() / 2 }
export class K { run = async (q) => this.go(q)
  m(a): void { i(() => k()) } }
export { a, b }
const p = (x: number): string => x
  .map(y => z(y)), r = 3
let w = function (a) { v() } // export function no() {
export async function e() { await l("export const no = () => {") }
export default () => 1
'''
RUBY = r'''require 'set'
=begin
def no; end
=end
module M
  class A < B
    attr_reader :x, :end
    def self.go(a) = helper(a)
    def run(x)
      s = <<~ONE + <<-'TWO'
        def no
      ONE
        end
      TWO
      return 1 if x
      y = if x then foo(1) else 2 end
      while x do
        puts "a #{bar(x) { |q| "#{q}" }} end"
      end
      x.each do |i| i.baz unless i.end? end
      @w ||= %w[if def] + %q(do (class) x)
    end
    def ok?; zap(/end/); end
    def ==(other) other.same? self end
  end
end
class << self
end
'''


def callees(root):
    """(enclosing function's or class's name, callee's text) of all calls."""
    out = []

    def walk(node, inside, source):
        for c in node.children:
            name = next((source[x.start : x.end] for x in c.children if x.role == "name"), None)
            if c.kind in ("call_expression", "new_expression"):
                out.append((inside, source[c.children[0].start : c.children[0].end].replace("\n", "").replace(" ", "")))
            walk(c, name or inside, source)

    return out, walk


def calls_of(parser, source):
    root = parser(source)
    out, walk = callees(root)
    walk(root, None, source)
    return {*out}


def kinds(parser, source):
    found = []

    def walk(node):
        for c in node.children:
            name = next((source[x.start : x.end] for x in c.children if x.role == "name"), None)
            if c.kind not in ("identifier", "property_identifier", "member_expression", "string") and not c.kind.endswith("call_expression") and c.kind != "call_expression":
                found.append((c.kind, c.role, name))
            walk(c)

    walk(parser(source))
    return found


def test_scripts():
    assert calls_of(scan_script, SCRIPT) == {
        ("a", "b"), ("a", "c"), ("a", "d"), ("f", "test"), ("f", "g"), ("f", "h"), ("run", "this.go"), ("m", "i"), ("m", "k"), ("p", "x.map"), ("p", "z"), (None, "v"), ("e", "l"),
    }
    found = kinds(scan_script, SCRIPT)
    assert [k for k in found if k[0] == "export_statement"] == [("export_statement", None, None)] * 6
    declared = [(k, n) for k, r, n in found if r == "declaration"]
    assert declared == [("lexical_declaration", None), ("function_declaration", "f"), ("class_declaration", "K"), ("function_declaration", "e")]
    assert [n for k, _, n in found if k == "variable_declarator"] == ["a", "run", "p"]
    assert sum(k == "arrow_function" for k, _, _ in found) == 6 and sum(k == "function_expression" for k, _, _ in found) == 1


def test_ruby():
    assert calls_of(parse_ruby, RUBY) == {
        ("A", "attr_reader"), ("go", "helper"), ("run", "foo"), ("run", "puts"), ("run", "bar"), ("run", "x.each"), ("run", "i.baz"), ("run", "i.end?"), ("ok?", "zap"), ("==", "other.same?"),
    }
    found = [k for k in kinds(parse_ruby, RUBY) if k[2]]
    assert found == [("class_definition", None, "M"), ("class_definition", None, "A"), *[("function_definition", None, n) for n in ("go", "run", "ok?", "==")]]
    rows = [*flatten(parse_ruby(RUBY), RUBY)]
    texts = {r[10]: (r[5], r[7]) for r in rows if r[3] in ("class_definition", "function_definition")}
    assert texts[next(t for t in texts if t.startswith("module M"))] == (4, 25)
    assert [r[10] for r in rows if r[4] == "source"] == ["'set'"]


@pytest.mark.parametrize("mask", [masked_script, masked_ruby])
def test_masks_keep_places(mask):
    for text in (SCRIPT, RUBY, "", "`", "`${", "'", '"#{', "<<~A", "%w[", "/", "=begin", "a /b", "`${`${`", '"#{"#{"'):
        assert len(mask(text)) == len(text) and [i for i, c in enumerate(mask(text)) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]


def test_trees_are_trees():
    """Whatever the text: children lie within their parents, and nothing fails or takes long."""
    texts = [SCRIPT, RUBY, SCRIPT[::-1], RUBY[::-1], "end\n" * 5000, "def a\n" * 5000, "(" * 20000, "=> " * 5000, "export " * 5000, "{`${" * 3000, "a.b(" * 5000, "x = " * 5000 + "y => 1", "if a\n" * 3000 + "end\n" * 3000]
    for parser in {p for n, p in default_parsers().items() if n != "python"}:
        for text in texts:
            last = {}
            for number, parent, *_, end, whole in flatten(parser(text), text):
                last[number] = (end, whole)
                assert parent is None or end <= last[parent][0]
