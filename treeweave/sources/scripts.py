"""Small parsers for languages that end blocks by keywords, or whose functions are expressions: Ruby, JavaScript and TypeScript.

Both first mask what isn't code, by reading the text once with a stack of what is open: strings that hold code, templates, regular
expressions, heredocs. Then declarations, functions and calls are found by pattern and nested by where they end. They read what people write; they are
not grammars.
"""

from __future__ import annotations

import re
from bisect import bisect_left

from .parse import CALLED, MADE, WORDS, Node, blocks, declarations, nested

#: After these a slash begins a regular expression; elsewhere it divides.
BEFORE_REGEX = frozenset("(,=:[!&|?{};+-*%<>~^\n") | {""}
REGEX_WORDS = frozenset("return typeof case in of delete void throw new else do and or not if unless while until when then puts".split())
SCRIPT_TOKEN = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|[`{}/]", re.DOTALL)
LAST_WORD = re.compile(r"[\w$]+\Z")
TEMPLATE = re.compile(r"(?:\\.|(?!\$\{)[^`\\])*", re.DOTALL)
SLASHED = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")


class Mask:
    """A text whose spans are blanked one by one; line ends stay."""

    def __init__(self, source: str):
        self.source, self.parts, self.at = source, [], 0

    def blank(self, start: int, end: int) -> None:
        self.parts += [self.source[self.at : start], re.sub(r"[^\n]", " ", self.source[start:end])]
        self.at = end

    def text(self) -> str:
        return "".join(self.parts) + self.source[self.at :]


def masked_script(source: str) -> str:
    """Comments, strings, template text and regular expressions as blanks; code inside templates stays."""
    out, at, last, open_ = Mask(source), 0, "", []  # open_: for each brace, whether a template goes on after it

    def template(start: int) -> int:
        end = TEMPLATE.match(source, start).end()
        if source.startswith("${", end):
            open_.append(True)
            out.blank(start, end)
            out.blank(end, end + 2)
            return end + 2
        out.blank(start, min(end + 1, len(source)))
        return end + 1

    while m := SCRIPT_TOKEN.search(source, at):
        plain = source[at : m.start()].rstrip()
        if plain:  # a slash, also one after a comment, asks what stands before it
            last = plain[-1]
            if m[0].startswith("/") and (word := LAST_WORD.search(plain, max(0, len(plain) - 20))):
                last = word[0]
        token, at = m[0], m.end()
        if token == "`":
            out.blank(m.start(), at)
            at, last = template(at), "`"
        elif token[0] in "\"'" or token.startswith(("//", "/*")):
            out.blank(m.start(), at)
            last = last if token[0] == "/" else token[0]
        elif token == "/" and (last in BEFORE_REGEX or last in REGEX_WORDS) and (r := SLASHED.match(source, m.start())):
            out.blank(m.start(), r.end())
            at, last = r.end(), "/"
        elif token == "{":
            open_.append(False)
            last = token
        elif token == "}":
            if open_ and open_.pop():
                out.blank(m.start(), at)
                at, last = template(at), "`"
            else:
                last = token
        else:
            last = token
    return out.text()


ARROW = re.compile(r"(?:\basync\s*)?(?:(?P<open>\()|(?P<one>[\w$]+)\s*=>)")
ARROW_TAIL = re.compile(r"\s*(?::[^=;{}()]*(?:\([^()]*\)[^=;{}()]*)?)?=>")
BOUND = re.compile(r"(?P<name>[\w$]+)\s*(?::[^=;]*?)?=\s*$")
LINE_ON = re.compile(r"\s*(?:[.?:+\-*/%&|^<>=,)\]}]|\b(?:in|of|instanceof|as)\b)")
ANONYMOUS = re.compile(r"\bfunction\s*\*?\s*\(")
EXPORTED = re.compile(r"(?:^|(?<=[;}\n]))[ \t]*(?P<export>export)\b(?P<default>\s+default\b)?\s*", re.MULTILINE)
STORED = re.compile(r"(?:const|let|var)\s+")


def expression_end(plain: str, start: int, pairs: dict[int, int]) -> int:
    """Where an expression ends: at a comma, semicolon or closing bracket of what surrounds it, or at the end of a line after which it doesn't go on."""
    at, last = start, ""
    while at < len(plain):
        c = plain[at]
        if c in "([{":
            at = pairs.get(at, len(plain))
            last = c
            continue
        if c in ",;)]}":
            return at
        if c == "\n" and last and last not in "=+-*/%&|^<>?:.!~" and not LINE_ON.match(plain, at):
            return at
        if not c.isspace():
            last = c
        at += 1
    return at


def brackets(plain: str) -> dict[int, int]:
    """Where each bracket's partner ends; unpaired ones are passed over."""
    pairs, open_ = {}, []
    closes = {")": "(", "]": "[", "}": "{"}
    for m in re.finditer(r"[()\[\]{}]", plain):
        if m[0] in "([{":
            open_.append(m)
        else:
            while open_:
                o = open_.pop()
                if o[0] == closes[m[0]]:
                    pairs[o.start()] = m.end()
                    break
    return pairs


def scan_script(source: str) -> Node:
    """JavaScript and TypeScript: declarations, imports and calls as ``scan_braces`` finds them, and arrow functions, function expressions and exports."""
    plain = masked_script(source)
    pairs = brackets(plain)
    found, heads = declarations(source, plain, blocks(plain))
    taken = {n.start for n in found}
    for m in ARROW.finditer(plain):
        if m["open"]:
            close = pairs.get(m.start("open"))
            tail = close and ARROW_TAIL.match(plain, close)
            if not tail:
                continue
            body = tail.end()
        else:
            if re.search(r"\)\s*:\s*$", plain[max(0, m.start() - 20) : m.start()]):
                continue  # the type that a parenthesised list returns
            body = m.end()
        while body < len(plain) and plain[body].isspace():
            body += 1
        end = pairs.get(body, len(plain)) if plain[body : body + 1] == "{" else expression_end(plain, body, pairs)
        arrow = Node("arrow_function", m.start(), end)
        bound = BOUND.search(plain, max(0, m.start() - 400), m.start())
        if bound:
            found.append(Node("variable_declarator", bound.start(), end, None, [Node("identifier", *bound.span("name"), "name"), arrow]))
            arrow.role = "value"
        else:
            found.append(arrow)
    for m in ANONYMOUS.finditer(plain):
        body = plain.find("{", pairs.get(m.end() - 1, len(plain)))
        if m.start() not in taken and body >= 0:
            found.append(Node("function_expression", m.start(), pairs.get(body, len(plain))))
    starts = {n.start: n for n in found if n.kind.endswith(("_declaration", "declarator"))}
    ordered = sorted(starts)
    for m in EXPORTED.finditer(plain):
        node = Node("export_statement", m.start("export"), expression_end(plain, m.end(), pairs))
        stored = STORED.match(plain, m.end())
        k = bisect_left(ordered, stored.end() if stored else m.end())
        # a declaration may have words before it: async, abstract, declare
        declared = starts[ordered[k]] if k < len(ordered) and re.fullmatch(r"(?:async|abstract|declare|\s)*", plain[stored.end() if stored else m.end() : ordered[k]]) else None
        if declared is not None:
            node.end = max(node.end if stored else declared.end, declared.end)
        if stored:
            node.children.append(Node("lexical_declaration", m.end(), node.end, "declaration"))
            if declared is not None:
                node.children[0].children.append(declared)
                found.remove(declared)
        elif declared is not None:
            declared.role = "declaration"
            node.children.append(declared)
            found.remove(declared)
        found.append(node)
    return nested(source, [*found, *calls(plain, pairs, heads, WORDS | {"default"})])


def calls(plain: str, pairs: dict[int, int], heads: set[int], words: frozenset[str]) -> list[Node]:
    out = []
    for m in CALLED.finditer(plain):
        if m[2] in words or m.start(2) in heads or m[2] == "async" and ARROW_TAIL.match(plain, pairs.get(m.end() - 1, len(plain))):
            continue
        before = plain[max(0, m.start() - 8) : m.start()]
        made = "new" in before and MADE.search(before)
        # what is called on may have been masked: then a keyword before it isn't the receiver
        start = m.start(2) if m[1] and ((first := m[1].split(".")[0].strip()) in words or first in REGEX_WORDS) else m.start()
        callee = Node("member_expression" if m[1] else "identifier", start, m.end(2), None if made else "function")
        if m[1]:
            callee.children.append(Node("property_identifier", m.start(2), m.end(2), "property"))
        out.append(Node("new_expression" if made else "call_expression", start, pairs.get(m.end() - 1, len(plain)), None, [callee]))
    return out


# --- Ruby ---

RUBY_TOKEN = re.compile(
    r"^=begin\b.*?(?:^=end\b[^\n]*|\Z)|^__END__\b.*\Z|#[^\n]*|<<[~-]?(?P<mark>[\"'`]?)(?P<here>[A-Z_]\w*)(?P=mark)|%[qQwWiIrx]?(?P<pc>[\[({<|!/])|:?\"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`|[/{}\n]|\?[^\s\w](?!\w)|::|:?[A-Za-z_]\w*[?!]?:?(?!:)|[^\s\w]",
    re.DOTALL | re.MULTILINE,
)
RUBY_TEXT = re.compile(r"(?:\\.|(?!#\{)[^\"\\])*", re.DOTALL)
CLOSERS = {"[": "]", "(": ")", "{": "}", "<": ">"}


def masked_ruby(source: str) -> str:
    """Comments, strings, heredocs, symbols' quotes and regular expressions as blanks; code inside strings stays."""
    out, at, last, open_, waiting = Mask(source), 0, "", [], []

    def quoted(start: int) -> int:
        end = RUBY_TEXT.match(source, start).end()
        if source.startswith("#{", end):
            open_.append(True)
            out.blank(start, end + 2)
            return end + 2
        out.blank(start, min(end + 1, len(source)))
        return end + 1

    while m := RUBY_TOKEN.search(source, at):
        token, at = m[0], m.end()
        if token == "\n":
            for word in waiting:  # bodies of heredocs begin on the next line, in turn
                body = re.compile(rf"^[ \t]*{word}[ \t]*$", re.MULTILINE).search(source, at)
                end = body.end() if body else len(source)
                out.blank(at, end)
                at = end
            waiting.clear()
            last = "\n" if last in BEFORE_REGEX else last
        elif token[0] in "#=_" and (token[0] == "#" or token.startswith(("=begin", "__END__"))):
            out.blank(m.start(), at)
        elif m["here"] and (last in BEFORE_REGEX or m["mark"] or token[2] in "~-"):
            waiting.append(m["here"])
            out.blank(m.start(), at)
            last = "'"
        elif m["pc"] and (last in BEFORE_REGEX or last in REGEX_WORDS or len(token) > 2):
            close, depth = CLOSERS.get(m["pc"], m["pc"]), 1
            while at < len(source) and depth:
                c = source[at]
                depth += (c == m["pc"] and close != m["pc"]) - (c == close)
                at += 2 if c == "\\" else 1
            out.blank(m.start(), min(at, len(source)))
            last = "'"
        elif token in ('"', ':"'):
            out.blank(m.start(), at)
            at, last = quoted(at), "'"
        elif token[0] in "'`" or token[0] == "?" and len(token) > 1 or token[0] == ":" and len(token) > 1 and token != "::":
            out.blank(m.start(), at)
            last = "'"
        elif token == "/" and (last in BEFORE_REGEX or last in REGEX_WORDS or re.match(r"\w ", source[max(0, m.start() - 2) : m.start()]) and not source[at : at + 1].isspace()) and (r := SLASHED.match(source, m.start())):
            out.blank(m.start(), r.end())
            at, last = r.end(), "'"
        elif token == "{":
            open_.append(False)
            last = token
        elif token == "}":
            if open_ and open_.pop():
                out.blank(m.start(), at)
                at, last = quoted(at), "'"
            else:
                last = token
        else:
            last = token
    return out.text()


RUBY_WORD = re.compile(r"(?<![\w.@$:])(?:class|module|def|begin|do|case|if|unless|while|until|for|end)\b(?![?!:])(?!\s*=[^=~>])")
RUBY_NAME = re.compile(r"\s+(?:<<\s*self|(?:[\w]+\s*\.\s*)?(?P<name>[A-Za-z_][\w:]*[?!=]?|[-+*/%<>=!~^&|\[\]]+))")
ENDLESS = re.compile(r"\s*(?:\([^()]*\))?\s*=(?![=~>])")
RUBY_KEYWORDS = frozenset("if unless while until for case when then else elsif end def class module begin rescue ensure do return yield super self nil true false and or not in alias undef defined? raise loop".split()) - {"raise", "loop"}
REQUIRED = re.compile(r"^[ \t]*(?P<call>require(?:_relative)?|load)\b[ \t]*\(?[ \t]*(?P<what>\"[^\"\n]*\"|'[^'\n]*')\)?", re.MULTILINE)
RUBY_CALL = re.compile(r"(?P<on>(?:@{0,2}[\w:]+[?!]?(?:\([^()\n]*\))?\s*&?\.\s*)*)(?<![\w@$:])(?P<name>[A-Za-z_]\w*[?!]?)(?P<open>\()?")
COMMAND = re.compile(r"[ \t]+(?=[\w\"'@\[:])(?!(?:if|unless|while|until|and|or|do|in|then|rescue|end)\b)")


def parse_ruby(source: str) -> Node:
    """Methods, classes, modules, requires and calls of Ruby, nested by their ``end``.

    An ``end`` that begins a line closes what was opened on a line of the same indentation, if there is such, so one misread word doesn't
    shift all that follows.
    """
    plain = masked_ruby(source)
    found: list[Node] = []
    heads: set[int] = set()
    open_: list[tuple[int, str, Node | None]] = []  # indentation of the line, word, node
    loop_lines: set[int] = set()
    for m in RUBY_WORD.finditer(plain):
        word, start = m[0], plain.rfind("\n", 0, m.start()) + 1
        before = plain[start : m.start()]
        indent = len(before) - len(before.lstrip()) if before.strip() else len(before)
        first = not before.strip()
        if word == "end":
            if first and any(i == indent for i, _, _ in open_):
                while open_[-1][0] != indent:
                    node = open_.pop()[2]
                    if node is not None:
                        node.end = m.end()
            if open_:
                node = open_.pop()[2]
                if node is not None:
                    node.end = m.end()
            continue
        if word in ("if", "unless", "while", "until") and not first and not re.search(r"(?:[=(\[{,;|&!?:+*<>-]|\b(?:return|then|else|do|and|or|not))\s*$", before):
            continue  # stands after what it governs
        if word == "do" and start in loop_lines:
            loop_lines.discard(start)
            continue
        if word in ("while", "until", "for"):
            loop_lines.add(start)
        node = None
        if word in ("class", "module", "def"):
            name = RUBY_NAME.match(plain, m.end())
            if name and name["name"]:
                if word == "class" and before.rstrip().endswith("."):
                    continue
                node = Node("function_definition" if word == "def" else "class_definition", m.start(), len(plain), None, [Node("identifier", *name.span("name"), "name")])
                heads.add(name.start("name"))
                found.append(node)
                if word == "def" and ENDLESS.match(plain, name.end()):
                    line = plain.find("\n", name.end())
                    node.end = line if line >= 0 else len(plain)
                    continue
        open_.append((indent, word, node))
    required = set()
    for m in REQUIRED.finditer(source):
        if plain[m.start("call") : m.end("call")] == m["call"]:
            found.append(Node("import_statement", m.start("call"), m.end(), None, [Node("string", *m.span("what"), "source")]))
            required.add(m.start("call"))
    pairs = brackets(plain)
    for m in RUBY_CALL.finditer(plain):
        start, name = m.start("on") if m["on"] else m.start("name"), m["name"]
        if m.start("name") in heads or start in required or name in RUBY_KEYWORDS or m["on"].rstrip().endswith("::"):
            continue
        line = plain.rfind("\n", 0, start) + 1
        command = not m["on"] and not m["open"] and not plain[line:start].strip() and name[0].islower() and COMMAND.match(source, m.end("name"))
        if re.search(r"\bdef\s+[\w.]*$", plain[line:start]) or not (m["on"] or m["open"] or command):
            continue
        callee = Node("member_expression" if m["on"] else "identifier", start, m.end("name"), "function")
        if m["on"]:
            callee.children.append(Node("property_identifier", *m.span("name"), "property"))
        end = pairs.get(m.start("open"), len(plain)) if m["open"] else m.end("name")
        found.append(Node("call_expression", start, end, None, [callee]))
    return nested(source, found)
