"""Functions, imports and variables of code blocks, read from a token stream of each language."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import language
from loomgraph.storage import ship

#: Names that make a function an entry point, by language.
ENTRY_NAMES = {
    "python": ["main", "run", "execute", "handle", "process"],
    "bash": ["main", "run", "execute"],
    "javascript": ["main", "run", "execute", "handler"],
    "typescript": ["main", "run", "execute", "handler"],
    "go": ["main", "Run", "Execute"],
    "rust": ["main", "run", "execute"],
    "java": ["main", "run", "execute"],
}
FACTS = (
    "struct<functions:array<struct<name:string,params:array<string>,returns:string,line_start:int,line_end:int,docstring:boolean,is_async:boolean,is_entry:boolean>>,"
    "imports:array<struct<module:string,line:int>>,variables:array<struct<name:string,line:int>>>"
)
CLOSING = {"(": ")", "[": "]", "{": "}"}


@dataclass
class Token:
    """A piece of code: its kind (name, text, sign, end), text, line from 0, place, and whether it begins its line."""

    kind: str
    text: str
    line: int
    at: int
    first: bool


def lexer(comment: str, quotes: list[str], signs: list[str]) -> re.Pattern:
    """Comments go to the line's end (and between /* */); quoted text may hold escapes."""
    parts = [("skip", rf"{comment}[^\n]*" + (r"|/\*[\s\S]*?(?:\*/|\Z)" if comment == "//" else "") + r"|\\\n|[^\S\n]+")]
    parts += [("text", "|".join(quotes)), ("end", r"\n"), ("name", r"[^\W\d]\w*"), ("sign", "|".join([*map(re.escape, signs), r"[\d.]+\w*", r"\S"]))]
    return re.compile("|".join(f"(?P<{k}>{p})" for k, p in parts))


LONG = [r'"""[\s\S]*?(?:"""|\Z)', r"'''[\s\S]*?(?:'''|\Z)"]
SHORT = [r'"(?:\\.|[^"\\\n])*"?', r"'(?:\\.|[^'\\\n])*'?"]
TICKED = r"`(?:\\[\s\S]|[^`\\])*`?"
LEXERS = {
    "python": lexer("#", [*LONG, *SHORT], ["->", "==", ":=", "<=", ">=", "!=", "//"]),
    "bash": lexer(r"(?<![^\s;])\#", [r'"(?:\\[\s\S]|[^"\\])*"?', r"'[^']*'?"], ["==", "+=", "$"]),
    "javascript": lexer("//", [*SHORT, TICKED], ["=>", "===", "==", "!==", "!=", "<=", ">="]),
    "go": lexer("//", [*SHORT, TICKED], [":=", "==", "!=", "<=", ">=", "<-"]),
    # A quote in Rust may open a lifetime, so only whole character literals are texts.
    "rust": lexer("//", [SHORT[0], r"'(?:\\.[^']*|[^'\\\n])'"], ["->", "=>", "::", "==", "!=", "<=", ">="]),
    "java": lexer("//", [LONG[0], *SHORT], ["->", "==", "!=", "<=", ">=", "::"]),
}
LEXERS["typescript"] = LEXERS["javascript"]


@dataclass
class Code:
    """A block's tokens, with the partner of every bracket; ``end`` tokens part statements."""

    text: str
    language: str
    tokens: list[Token] = field(default_factory=list)
    partner: dict[int, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        line, first, opened = 0, True, []
        for m in LEXERS[self.language].finditer(self.text):
            kind = m.lastgroup
            if kind != "skip":
                k = len(self.tokens)
                self.tokens.append(Token(kind, m[0], line, m.start(), first))
                if m[0] in CLOSING:
                    opened.append(k)
                elif m[0] in (")", "]", "}") and opened and CLOSING[self.tokens[opened[-1]].text] == m[0]:
                    self.partner[opened.pop()] = k
                first = False
            line += m[0].count("\n")
            first = first or kind == "end"

    def is_(self, k: int, *texts: str) -> bool:
        return 0 <= k < len(self.tokens) and self.tokens[k].kind != "text" and self.tokens[k].text in texts

    def name(self, k: int) -> bool:
        return 0 <= k < len(self.tokens) and self.tokens[k].kind == "name"

    def between(self, a: int, b: int) -> str:
        """The source from token a up to token b, white space collapsed."""
        stop = self.tokens[b].at if b < len(self.tokens) else len(self.text)
        return " ".join(self.text[self.tokens[a].at : stop].split()) if a < b else ""

    def params(self, k: int) -> list[str]:
        """The parts between commas inside the bracket at k, nested ones whole."""
        out, start, j, close = [], k + 1, k + 1, self.partner.get(k, len(self.tokens))
        depth = 0
        while j < close:
            if self.is_(j, "<"):
                depth += 1
            elif self.is_(j, ">"):
                depth -= 1
            elif depth <= 0 and self.is_(j, ","):
                out.append(self.between(start, j))
                start = j + 1
            j = self.partner.get(j, j) + 1
        return [p for p in [*out, self.between(start, close)] if p]

    def until(self, k: int, *texts: str) -> int:
        """The next place from k with one of the texts, over whole brackets."""
        while k < len(self.tokens) and not self.is_(k, *texts):
            k = self.partner.get(k, k) + 1
        return k

    def closes(self, k: int) -> int:
        """The line on which the next block from k ends (that of k, where none opens before its statement ends)."""
        while k < len(self.tokens) and not self.is_(k, "{", ";"):
            k = self.partner.get(k, k) + 1
        if not self.is_(k, "{"):
            return self.tokens[min(k, len(self.tokens) - 1)].line
        return self.tokens[self.partner.get(k, len(self.tokens) - 1)].line


@dataclass
class Found:
    functions: list = field(default_factory=list)
    imports: list = field(default_factory=list)
    variables: list = field(default_factory=list)

    def function(self, c: Code, k: int, brackets: int | None, last: int, returns: str | None = None, is_async: bool = False, docstring: bool = False, start: int | None = None) -> None:
        name = c.tokens[k].text
        line = c.tokens[k if start is None else start].line
        self.functions.append((name, c.params(brackets) if brackets is not None else [], returns or None, line, last, docstring, is_async, name in ENTRY_NAMES[c.language]))


def unquoted(text: str) -> str:
    return text.strip("'\"`")


def python(c: Code, k: int, found: Found) -> None:
    """``[async] def name(...) [-> type]:``, ``import a``, ``from a import b`` and ``name [: type] =`` at a line's start."""
    t = c.tokens
    start = k
    is_async = c.is_(k, "async")
    k += is_async
    if c.is_(k, "def") and c.name(k + 1):
        b = k + 2 if c.is_(k + 2, "(") else c.until(k + 2, "(", "end")
        colon = c.until(c.partner.get(b, b) + 1, ":")
        arrow = c.partner.get(b, b) + 1
        body = colon + 1
        while body < len(t) and t[body].kind == "end":
            body += 1
        indent = lambda j: t[j].at - (c.text.rfind("\n", 0, t[j].at) + 1)
        last, own, j = t[min(colon, len(t) - 1)].line, indent(start), colon + 1
        while j < len(t):
            if t[j].kind != "end":
                if t[j].first and indent(j) <= own:
                    break
                last = max(last, t[j].line + t[j].text.count("\n"))
                j = c.partner.get(j, j)
                last = max(last, t[j].line)
            j += 1
        doc = body < len(t) and t[body].kind == "text" and t[body].text.startswith(('"""', "'''"))
        found.function(c, k + 1, b if c.is_(b, "(") else None, last, c.between(arrow + 1, colon) if c.is_(arrow, "->") else None, is_async, doc, start)
    elif c.is_(k, "import"):
        stop = k + 1
        while stop < len(t) and t[stop].kind != "end":
            stop += 1
        for part in c.between(k + 1, stop).split(","):
            found.imports.append((part.split()[0] if part.split() else "", t[k].line))
    elif c.is_(k, "from"):
        stop = c.until(k + 1, "import")
        found.imports.append((c.between(k + 1, stop).replace(" ", ""), t[k].line))
    elif c.name(k):
        j = k + 1
        if c.is_(j, ":"):
            while j < len(t) and t[j].kind != "end" and not c.is_(j, "="):
                j = c.partner.get(j, j) + 1
        if c.is_(j, "="):
            found.variables.append((t[k].text, t[k].line))


def bash(c: Code, k: int, found: Found) -> None:
    """``function name [()] {``, ``name() {``, ``source file`` or ``. file``, and ``name=value``."""
    t = c.tokens
    n = k + c.is_(k, "function")
    if c.name(n):
        after = n + 3 if c.is_(n + 1, "(") and c.is_(n + 2, ")") else n + 1
        body = after
        while body < len(t) and t[body].kind == "end":
            body += 1
        if (n > k or after > n + 1) and c.is_(body, "{"):
            found.function(c, n, None, c.closes(body), start=k)
            return
    if c.is_(k, "source", "."):
        stop = k + 1
        while stop < len(t) and t[stop].kind != "end" and not c.is_(stop, ";", "&", "|"):
            stop += 1
        found.imports.append((unquoted(c.between(k + 1, stop)), t[k].line))
    elif c.name(k):
        n = k + 1 if c.is_(k, "export", "local", "readonly", "declare") and c.name(k + 1) else k
        if c.is_(n + 1, "=") and t[n + 1].at == t[n].at + len(t[n].text):
            found.variables.append((t[n].text, t[n].line))


def javascript(c: Code, k: int, found: Found) -> None:
    """Function declarations, functions and arrows given to a name, ``import`` and ``require``, other declared names."""
    t = c.tokens
    if c.is_(k, "function") and c.name(k + 1) and c.is_(k + 2, "("):
        if not c.is_(k - 1, "=") and not (c.is_(k - 1, "async") and c.is_(k - 2, "=")):
            is_async = c.is_(k - 1, "async")
            found.function(c, k + 1, k + 2, c.closes(c.partner.get(k + 2, k + 2) + 1), _type_after(c, k + 2), is_async, start=k - is_async)
    elif c.is_(k, "import") and not c.is_(k - 1, ".") and not c.is_(k + 1, "(", "."):
        at = k + 1
        while at < len(t) and t[at].kind != "text" and not c.is_(at, ";"):
            at = c.partner.get(at, at) + 1
        if at < len(t) and t[at].kind == "text":
            found.imports.append((unquoted(t[at].text), t[k].line))
    elif c.is_(k, "const", "let", "var"):
        if not c.name(k + 1):
            at = c.partner.get(k + 1, k + 1) + 1  # a pattern of names
            if c.is_(at, "=") and c.is_(at + 1, "require") and c.is_(at + 2, "("):
                found.imports.append((unquoted(t[at + 3].text), t[k].line))
            return
        eq = k + 2
        if c.is_(eq, ":"):
            while eq < len(t) and not c.is_(eq, "=", ";") and t[eq].kind != "end":
                eq = c.partner.get(eq, eq) + 1
        v = eq + 1 + c.is_(eq + 1, "async")
        is_async = v > eq + 1
        if not c.is_(eq, "="):
            found.variables.append((t[k + 1].text, t[k].line))
        elif c.is_(v, "require") and c.is_(v + 1, "("):
            found.imports.append((unquoted(t[v + 2].text), t[k].line))
        elif c.is_(v, "function"):
            b = c.until(v + 1, "(")
            found.function(c, k + 1, b, c.closes(c.partner.get(b, b) + 1), _type_after(c, b), is_async, start=k)
        elif c.is_(v, "(") and c.is_(_arrow(c, v), "=>"):
            found.function(c, k + 1, v, _arrow_end(c, _arrow(c, v)), _type_after(c, v), is_async, start=k)
        elif c.name(v) and c.is_(v + 1, "=>"):
            found.function(c, k + 1, None, _arrow_end(c, v + 1), None, is_async, start=k)
            found.functions[-1] = (*found.functions[-1][:1], [t[v].text], *found.functions[-1][2:])
        else:
            found.variables.append((t[k + 1].text, t[k].line))


def _arrow(c: Code, brackets: int) -> int:
    after = c.partner.get(brackets, brackets) + 1
    return c.until(after, "=>", "{", ";") if c.is_(after, ":") else after


def _arrow_end(c: Code, arrow: int) -> int:
    if c.is_(arrow + 1, "{"):
        return c.tokens[c.partner.get(arrow + 1, len(c.tokens) - 1)].line
    k = arrow + 1
    while k < len(c.tokens) - 1 and c.tokens[k].kind != "end" and not c.is_(k, ";"):
        k = c.partner.get(k, k) + 1
    return c.tokens[min(k, len(c.tokens) - 1)].line


def _type_after(c: Code, brackets: int) -> str | None:
    after = c.partner.get(brackets, brackets) + 1
    return c.between(after + 1, c.until(after + 1, "{", "=>", ";")) if c.is_(after, ":") else None


def go(c: Code, k: int, found: Found) -> None:
    """``func [(receiver)] name(...) [result] {``, single and grouped imports, ``name :=`` and ``var name``."""
    t = c.tokens
    if c.is_(k, "func"):
        n = c.partner.get(k + 1, k) + 1 if c.is_(k + 1, "(") else k + 1
        if c.name(n) and c.is_(n + 1, "("):
            after = c.partner.get(n + 1, n + 1) + 1
            body = after
            while body < len(t) and not c.is_(body, "{") and t[body].kind != "end":
                body = c.partner.get(body, body) + 1
            found.function(c, n, n + 1, c.closes(body), c.between(after, body).strip("()"), start=k)
    elif c.is_(k, "import"):
        stop = c.partner.get(k + 1, k + 1) if c.is_(k + 1, "(") else k + 2
        for j in range(k + 1, min(stop + 1, len(t))):
            if t[j].kind == "text":
                found.imports.append((unquoted(t[j].text), t[j].line))
    elif c.is_(k, ":="):
        j = k - 1
        names = []
        while c.name(j):
            names.append((t[j].text, t[j].line))
            j -= 2 if c.is_(j - 1, ",") else len(t)
        found.variables += reversed(names)
    elif c.is_(k, "var") and c.name(k + 1):
        found.variables.append((t[k + 1].text, t[k].line))


def rust(c: Code, k: int, found: Found) -> None:
    """``[async] fn name[<...>](...) [-> type] {``, ``use path;`` and ``let [mut] name``."""
    t = c.tokens
    if c.is_(k, "fn") and c.name(k + 1):
        b = c.until(k + 2, "(")
        after = c.partner.get(b, b) + 1
        returns = c.between(after + 1, c.until(after + 1, "{", ";", "where")) if c.is_(after, "->") else None
        found.function(c, k + 1, b, c.closes(after), returns, c.is_(k - 1, "async"), start=k)
    elif c.is_(k, "use"):
        found.imports.append((c.between(k + 1, c.until(k + 1, ";")), t[k].line))
    elif c.is_(k, "let"):
        n = k + 1 + c.is_(k + 1, "mut")
        if c.name(n):
            found.variables.append((t[n].text, t[k].line))


#: Words of Java that stand before a name without being its type, and those that may come before a member.
JAVA_WORDS = {"new", "return", "else", "throw", "case", "package", "import", "assert", "instanceof", "yield"}
JAVA_CONTROL = {"if", "for", "while", "switch", "catch", "synchronized", "try", "super", "this", "return", "new"}
JAVA_MODIFIERS = {"public", "private", "protected", "static", "final", "abstract", "native", "synchronized", "default", "strictfp"}


def java(c: Code, k: int, found: Found) -> None:
    """Methods and constructors with their types, ``import path;`` and ``type name =`` or ``type name;``."""
    t = c.tokens
    if c.is_(k, "import"):
        found.imports.append((c.between(k + 1 + c.is_(k + 1, "static"), c.until(k + 1, ";")).replace(" ", ""), t[k].line))
        return
    if not c.name(k) or t[k].text in JAVA_WORDS | JAVA_CONTROL | JAVA_MODIFIERS:
        return
    j = k - 1
    while j >= 0 and t[j].kind == "end":
        j -= 1
    typed = c.is_(j, ">", "]") or (c.name(j) and t[j].text not in JAVA_WORDS | JAVA_MODIFIERS | JAVA_CONTROL)
    if c.is_(k + 1, "("):
        after = c.partner.get(k + 1, k + 1) + 1
        while after < len(t) and t[after].kind == "end":
            after += 1
        constructor = not typed and (j < 0 or c.is_(j, "{", "}", ";") or (c.name(j) and t[j].text in JAVA_MODIFIERS)) and t[k].text[:1].isupper()
        if (typed or constructor) and c.is_(after, "{", "throws"):
            start = j
            while start >= 0 and (t[start].kind == "name" and t[start].text not in JAVA_MODIFIERS or c.is_(start, "<", ">", "[", "]", ",", ".", "?")):
                start -= 1
            found.function(c, k, k + 1, c.closes(after), c.between(start + 1, k).strip() if typed else None, start=k)
    elif typed and c.is_(k + 1, "=", ";"):
        found.variables.append((t[k].text, t[k].line))


READERS = {"python": python, "bash": bash, "javascript": javascript, "typescript": javascript, "go": go, "rust": rust, "java": java}
#: Languages whose declarations begin a statement; the others are tried at every token.
LINEWISE = {"python", "bash"}


def extract(code: str | None, language: str | None, offset: int = 0) -> tuple:
    """(functions, imports, variables) of a block; lines count on from ``offset``."""
    if language not in READERS or not code:
        return [], [], []
    c, found, read = Code(code, language), Found(), READERS[language]
    for k, token in enumerate(c.tokens):
        if token.kind != "end" and (language not in LINEWISE or token.first or c.is_(k - 1, ";", "&", "|") or (language == "bash" and c.is_(k - 1, "then", "do", "else", "{"))):
            read(c, k, found)
    functions = [(*f[:3], offset + f[3] + 1, offset + f[4] + 1, *f[5:]) for f in found.functions]
    return functions, [(m, offset + n + 1) for m, n in found.imports], [(v, offset + n + 1) for v, n in found.variables]


FACTS_ARROW = pa.struct([
    ("functions", pa.list_(pa.struct([("name", pa.string()), ("params", pa.list_(pa.string())), ("returns", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32()), ("docstring", pa.bool_()), ("is_async", pa.bool_()), ("is_entry", pa.bool_())]))),
    ("imports", pa.list_(pa.struct([("module", pa.string()), ("line", pa.int32())]))),
    ("variables", pa.list_(pa.struct([("name", pa.string()), ("line", pa.int32())]))),
])


def _facts(code: pa.Array, language: pa.Array, offset: pa.Array) -> pa.Array:
    names = ("functions", "imports", "variables")
    keys = (("name", "params", "returns", "line_start", "line_end", "docstring", "is_async", "is_entry"), ("module", "line"), ("name", "line"))
    rows = []
    for c, lang, o in zip(code.to_pylist(), language.to_pylist(), offset.to_pylist(), strict=True):
        rows.append({n: [dict(zip(k, x, strict=True)) for x in part] for n, k, part in zip(names, keys, extract(c, lang, o), strict=True)})
    return pa.array(rows, FACTS_ARROW)


def code_facts(blocks: DataFrame) -> DataFrame:
    """Add ``facts`` to blocks (language, code, line_start)."""
    ship(blocks.sparkSession)
    facts = F.arrow_udf(_facts, FACTS)
    return blocks.withColumn("facts", facts("code", "language", F.coalesce("line_start", F.lit(0)).cast("int")))


#: The supported languages.
SUPPORTED = ["python", "bash", "javascript", "typescript", "go", "rust", "java", "c", "cpp", "sql"]


def supported(name: str | Column) -> Column:
    """Whether a language is supported, by any of its names."""
    return F.coalesce(language(name).isin(SUPPORTED), F.lit(False))
