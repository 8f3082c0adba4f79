"""String literals and template parts of JavaScript and TypeScript."""

from __future__ import annotations

import regex

Span = tuple[int, int]


class JsxError(ValueError):
    """The file may hold JSX, and it isn't to be read."""

    def __init__(self, file: str):
        super().__init__(f"{file} may hold JSX, which is not read")


_SKIP = regex.compile(r"(?:[\s\ufeff]|//[^\n\r\u2028\u2029]*|/\*.*?(?:\*/|\Z))+", regex.S)
_SHEBANG = regex.compile(r"#![^\n\r]*")
_NAME = regex.compile(r"(?:[\p{ID_Start}$_#@]|\\u(?:\{[0-9a-fA-F]+\}|[0-9a-fA-F]{4}))(?:[\p{ID_Continue}$\u200c\u200d]|\\u(?:\{[0-9a-fA-F]+\}|[0-9a-fA-F]{4}))*")
_NUMBER = regex.compile(r"(?:0[xXoObB][0-9a-fA-F_]+|(?:[0-9][0-9_]*(?:\.[0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?)n?")
_STRING = {q: regex.compile(rf"{q}(?:[^{q}\\\n\r]|\\(?:\r\n|[\s\S]))*{q}?") for q in "'\""}
_REGEX = regex.compile(r"/(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/?[\p{ID_Continue}$]*")
_TEMPLATE = regex.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{|\Z)")

#: What begins an element where a value may stand; a generic arrow function doesn't.
_ELEMENT = regex.compile(r"<(?=>|(?!const\s+[\p{ID_Start}$_])[\p{ID_Start}$_][\p{ID_Continue}$.:-]*(?:[/>{]|\s+(?!extends(?!\s*[=/>]))))")
_ATTRIBUTE = regex.compile(r"[^\s'\"{}<>/=]+|=")
_END = regex.compile(r"/\s*>")
_CHILD = regex.compile(r"[<{]")

#: A slash after one of these words divides; after any other word that is a keyword it begins an expression.
_VALUES = frozenset(["this", "super", "true", "false", "null"])
_KEYWORDS = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends finally for function if import in instanceof new return switch throw try typeof var void while with "
    "implements interface let package private protected public static yield".split()
)
_CONTEXTUAL = frozenset(["namespace", "module", "type"])
_CLAUSES = frozenset(["if", "while", "for", "with"])
_DECLARES = frozenset(["class", "interface", "enum", *_CONTEXTUAL])
_BEFORE_BLOCK = frozenset([";", "{", ")", "=>", "else", "do", "try", "finally"])


def literals(code: str, jsx: bool = False) -> list[Span]:
    """Spans of strings (with quotes) and of the fixed parts of templates (with their signs).

    With ``jsx`` elements are read where a value may stand: the strings of their attributes, and those in braces; their
    text is no string."""
    found: list[Span] = []
    clauses: list[bool] = []  # of each open parenthesis: whether it belongs to if, while, for or with
    blocks: list[bool] = []  # of each open brace: whether it opens a block
    holes: list[tuple[int, bool]] = []  # how many braces were open when a hole began, and whether it is a template's or an element's
    elements: list[list[bool]] = []  # of each outermost element: for those open in it whether their tag is over
    last = ""  # the token before; "v" for a value
    divides = False  # whether a slash is a division here
    header = False  # whether a declaration's brace is awaited
    i = m.end() if (m := _SHEBANG.match(code)) else 0
    n = len(code)

    def template(start: int, body: int) -> int:
        m = _TEMPLATE.match(code, body)
        found.append((start, m.end()))
        if m[1] == "${":
            holes.append((len(blocks), False))
        return m.end()

    def element(i: int) -> tuple[int, bool]:
        """Reads on in the innermost element, to a brace or to its end: (place, whether it is over)."""
        open_ = elements[-1]
        equals = False
        while i < n:
            if open_[-1]:
                if not (m := _CHILD.search(code, i)):
                    break
                i = m.start()
                if code[i] == "{":
                    holes.append((len(blocks), True))
                    return i + 1, False
                if code.startswith("</", i):
                    i = code.find(">", i) + 1 or n
                    open_.pop()
                    if not open_:
                        return i, True
                else:
                    open_.append(False)
                    i += 1
                continue
            if m := _SKIP.match(code, i):
                i = m.end()
                continue
            c = code[i]
            if c in "'\"":
                end = code.find(c, i + 1) + 1 or n
                found.append((i, end))
                i = end
            elif c == "{":
                holes.append((len(blocks), True))
                return i + 1, False
            elif c == ">":
                open_[-1] = True
                i += 1
            elif m := _END.match(code, i):
                i = m.end()
                open_.pop()
                if not open_:
                    return i, True
            elif c == "<" and equals:
                open_.append(False)
                i += 1
            elif c == "<":  # type arguments
                depth = 0
                while i < n:
                    depth += (code[i] == "<") - (code[i] == ">" and code[i - 1] != "=")
                    i += 1
                    if not depth:
                        break
            else:
                m = _ATTRIBUTE.match(code, i)
                equals = bool(m) and m[0] == "="
                i = m.end() if m else i + 1
                continue
            equals = False
        return n, True

    while True:
        if m := _SKIP.match(code, i):
            i = m.end()
        if i >= n:
            return found
        c = code[i]
        if c in "'\"":
            m = _STRING[c].match(code, i)
            found.append((i, m.end()))
            i, last, divides = m.end(), "v", True
        elif c == "`":
            i = template(i, i + 1)
            closed = code[i - 1] == "`"
            last, divides = ("v", True) if closed else ("${", False)
        elif m := _NAME.match(code, i):
            word = m[0]
            i = m.end()
            after_dot = last in (".", "?.")
            keyword = word in _KEYWORDS and not after_dot
            divides = not keyword and not (word in _CONTEXTUAL and not after_dot)
            last = word if keyword or word in _VALUES or (word in _CONTEXTUAL and not after_dot) else "v"
            if word in _DECLARES and not after_dot:
                header = True
        elif c.isdigit() or (c == "." and code[i + 1 : i + 2].isdigit()):
            i, last, divides = _NUMBER.match(code, i).end(), "v", True
        elif c == "/" and not divides and (m := _REGEX.match(code, i)):
            i, last, divides = m.end(), "v", True
        elif jsx and c == "<" and not divides and _ELEMENT.match(code, i):
            elements.append([False])
            i, over = element(i + 1)
            last, divides = ("v", True) if over else ("(", False)
            if over:
                elements.pop()
        elif c == "!" and code[i + 1 : i + 2] != "=":
            i, last = i + 1, "!"  # before a value or after one: what a slash means stays
        elif c == "(":
            clauses.append(last in _CLAUSES)
            i, last, divides = i + 1, "(", False
        elif c == ")":
            divides = not (clauses.pop() if clauses else False)
            i, last = i + 1, ")"
        elif c == "{":
            blocks.append(header or last == "" or last in _BEFORE_BLOCK)
            header = False
            i, last, divides = i + 1, "{", False
        elif c == "}" and holes and holes[-1] == (len(blocks), True):
            holes.pop()
            i, over = element(i + 1)
            last, divides = ("v", True) if over else ("(", False)
            if over:
                elements.pop()
        elif c == "}" and holes and holes[-1] == (len(blocks), False):
            holes.pop()
            i = template(i, i + 1)
            closed = code[i - 1] == "`"
            last, divides = ("v", True) if closed else ("${", False)
        elif c == "}":
            divides = not (blocks.pop() if blocks else True)
            i, last = i + 1, "}"
        else:
            token = next((t for t in ("=>", "++", "--", "?.") if code.startswith(t, i)), c)
            if token in (";", ":", ","):
                header = False
            divides = token in ("]", "++", "--")
            i, last = i + len(token), token


def strings_of(text: str, file: str, jsx: bool = True) -> list[Span]:
    holds = file.lower().endswith((".tsx", ".jsx"))
    if holds and not jsx:
        raise JsxError(file)
    return literals(text, holds)
