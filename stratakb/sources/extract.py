"""Symbols, imports, calls and inheritance of source files, and hashes of bodies.

Python is read with its own parser. The other grammars share one scanner:
comments and strings are blanked out, declarations are found by a pattern for
each grammar, and their bodies by balanced braces (or ``end``). Hashes ignore
comments, white space and a symbol's own name, so they survive cosmetic edits
and renames and change with any other edit. Files that do not parse keep no
symbols; nothing raises.
"""

from __future__ import annotations

import ast
import hashlib
import io
import re
import tokenize
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize

MAX_PARSE = 512 * 1024
TOP = "<file>"


@dataclass
class Symbol:
    name: str
    kind: str
    start: int
    end: int
    parents: list[str]
    body: str = ""


@dataclass
class Facts:
    symbols: list[Symbol] = field(default_factory=list)
    imports: list[str] = field(default_factory=list)
    calls: list[tuple[str, str]] = field(default_factory=list)
    inherits: list[tuple[str, list[str], str, str]] = field(default_factory=list)  # child, its parents, base, relation
    ok: bool = True


def _dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return node.attr
    if isinstance(node, ast.Subscript):
        return _dotted(node.value)
    return _dotted(node.func) if isinstance(node, ast.Call) else None


def _python(src: str) -> Facts:
    out = Facts()
    try:
        tree = ast.parse(src)
    except (SyntaxError, ValueError, RecursionError):
        return Facts(ok=False)
    lines = src.splitlines()

    def visit(node: ast.AST, scope: list[tuple[str, str]]) -> None:
        for child in ast.iter_child_nodes(node):
            here = scope
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if scope else "function"
                parents = [n for n, _ in scope]
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                out.symbols.append(Symbol(child.name, kind, first, child.end_lineno or child.lineno, parents, "\n".join(lines[first - 1 : child.end_lineno])))
                if kind == "class":
                    out.inherits += [(child.name, parents, b, "extends") for x in child.bases if (b := _dotted(x))]
                here = [*scope, (child.name, kind)]
            elif isinstance(child, ast.Import):
                out.imports += [a.name for a in child.names]
            elif isinstance(child, ast.ImportFrom):
                out.imports += ["." * child.level + (child.module or "")] + [a.name for a in child.names]
            elif isinstance(child, ast.Call) and (name := _dotted(child.func)):
                out.calls.append((scope[-1][0] if scope else TOP, name))
            visit(child, here)

    visit(tree, [])
    return out


_C = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_Q = r'"(?:\\.|[^"\\\n])*"?|' + r"'(?:\\.|[^'\\\n])*'?"
MASKS = {
    "php": rf"{_C}|#(?!\[)[^\n]*|{_Q}", "javascript": rf"{_C}|`(?:\\.|[^`\\])*`?|{_Q}", "typescript": rf"{_C}|`(?:\\.|[^`\\])*`?|{_Q}", "cpp": rf"{_C}|{_Q}", "rust": rf'{_C}|"(?:\\.|[^"\\])*"?|' + r"'(?:\\.|[^'\\\n])'",
    "go": rf"{_C}|`[^`]*`?|{_Q}", "java": rf"{_C}|{_Q}", "c_sharp": rf"{_C}|{_Q}", "ruby": rf"#[^\n]*|{_Q}", "bash": rf"(?:(?<=\s)|(?<![^\n]))#[^\n]*|{_Q}",
}
_N = r"([A-Za-z_$][\w$]*)"
DECLS = {
    "php": [(rf"\b(?:class|interface|trait)\s+{_N}", "class"), (rf"\bfunction\s+&?\s*{_N}\s*\(", "function")],
    "javascript": [(rf"\bclass\s+{_N}", "class"), (rf"\bfunction\s*\*?\s*{_N}\s*\(", "function"), (rf"(?:(?<=[;{{}}\n])|^)[ \t]*(?:(?:static|async|get|set)\s+)*\*?{_N}\s*\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?=\{{)", "method")],
    "cpp": [(rf"\b(?:class|struct|enum(?:\s+class)?)\s+{_N}(?=[^;(){{}}]*\{{)", "class"), (rf"\bnamespace\s+{_N}\s*(?=\{{)", "scope"), (rf"[\w>&*\]]\s+[*&]*(?:[\w]+::)*~?{_N}\s*\([^;{{}}]*\)\s*(?:const|noexcept|override|final|\s)*(?:->[^{{;]*|:[^{{;]*)?(?=\{{)", "function")],
    "rust": [(rf"\b(?:struct|enum|trait)\s+{_N}", "class"), (rf"\bfn\s+{_N}", "function"), (rf"\b(?:const|static)\s+(?:mut\s+)?{_N}\s*:", "const"), (r"\bimpl\b(?:\s*<[^{;]*?>)?\s+(?:[^{;]*?\bfor\s+)?(?:\w+::)*(\w+)[^{;]*(?=\{)", "scope")],
    "go": [(rf"\bfunc\s+\([^)]*\)\s*{_N}", "method"), (rf"\bfunc\s+{_N}", "function"), (rf"\btype\s+{_N}\s+(?=\w|\[|\*|\{{)", "class")],
    "java": [(rf"\b(?:class|interface)\s+{_N}", "class"), (rf"[\w>\]]\s+{_N}\s*\([^;{{}}()]*\)\s*(?:throws[^{{;]*)?(?=\{{)", "method")],
    "c_sharp": [(rf"\b(?:class|interface|struct)\s+{_N}", "class"), (rf"\bnamespace\s+([\w.]+)\s*(?=\{{)", "scope"), (rf"[\w>\]?]\s+{_N}\s*(?:<[^>]*>)?\([^;{{}}()]*\)\s*(?:where[^{{;]*)?(?=\{{|=>)", "method")],
    "ruby": [(r"^[ \t]*(?:class|module)\s+(?:\w+::)*(\w+)", "class"), (r"^[ \t]*def\s+(?:self\.)?(\w+[?!=]?)", "function")],
    "bash": [(r"^[ \t]*(?:function\s+)?([A-Za-z_][\w-]*)\s*\(\)\s*(?=\{)", "function"), (r"^[ \t]*function\s+([A-Za-z_][\w-]*)\s*(?=\{)", "function")],
}
DECLS["typescript"] = [*DECLS["javascript"][:1], (rf"\babstract\s+class\s+{_N}", "class"), *DECLS["javascript"][1:2], (DECLS["javascript"][2][0].replace("static|async", "public|private|protected|readonly|static|async").replace(r"\s*(?=\{)", r"\s*(?::[^{;=]*)?(?=\{)"), "method")]
IMPORTS = {
    "php": r"^\s*use\s+([^;(]+);", "javascript": r"\bimport\b[^;'\"]*['\"]([^'\"]+)['\"]|\brequire\(\s*['\"]([^'\"]+)['\"]", "typescript": r"\bimport\b[^;'\"]*['\"]([^'\"]+)['\"]", "cpp": r"^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]", "rust": r"\buse\s+([^;]+);",
    "go": r"^\s*(?:import\s+)?(?:[\w.]+\s+)?\"([^\"\n]+)\"\s*$", "java": r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", "c_sharp": r"^\s*using\s+([\w.=\s]+);", "ruby": r"^\s*require(?:_relative)?\s*\(?\s*['\"]([^'\"]+)['\"]", "bash": r"^\s*(?:source|\.)\s+[\"']?([^\s\"';]+)",
}
_CALLED = re.compile(r"([A-Za-z_$][\w$]*[?!]?)\s*(?:::<[^>(]*>)?\(")
_WORDS = frozenset("if for while switch catch return function fn func sizeof match elif else new typeof super array list print echo foreach using lock fixed when with and or not in do await yield assert defined unless until case".split())


#: Calls without parentheses: shell commands, and in Ruby methods of a receiver and commands with an argument.
COMMANDS = {
    "bash": [r"(?:^|[;&|(){}])[ \t]*(?:(?:then|do|else|elif|if|while|until|time|!)[ \t]+)*([A-Za-z_./][\w./:+-]*)(?![\w./:+-]|=|\[|\+=|[ \t]*\(\))"],
    "ruby": [r"\.([a-z_]\w*[?!]?)(?![\w?!]|[ \t]*(?:\(|=(?!=)))", r"(?:^|;|\b(?:then|do|else|return|and|or|not)\b)[ \t]*([a-z_]\w*[?!]?)[ \t]+"],
}
KEYWORDS = {
    "bash": frozenset("if then else elif fi for while until do done case esac in function select time source . local export readonly declare typeset".split()),
    "ruby": frozenset("if unless while until for case when then else elsif end def class module begin rescue ensure do return yield and or not in super self nil true false require require_relative include prepend extend".split()),
}


def _argument(src: str, at: int) -> bool:
    """Does what follows a word in Ruby source start an argument, not an operator or a modifier?"""
    rest = src[at : at + 80].lstrip(" \t")
    if re.match(r"(?:if|unless|while|until|and|or|do|then|rescue|in)\b", rest):
        return False
    return bool(re.match(r"""[\w"':@$\[{~!]|[-*&][^\s=&*]|->""", rest)) and not rest.startswith("!=")


def _mask(lang: str, src: str) -> str:
    return re.sub(MASKS[lang], lambda m: re.sub(r"[^\n]", " ", m[0]), src, flags=re.S)


def _brace_end(code: str, at: int) -> int:
    """The end of the block that opens after at, or of the statement if none does."""
    depth = 0
    for m in re.compile(r"[{};]").finditer(code, at):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if depth <= 0:
                return m.end()
        elif not depth:
            return m.end()
    return len(code)


def _ruby_end(code: str, at: int) -> int:
    depth = 1
    for m in re.compile(r"^[ \t]*(?:class|module|def|if|unless|case|while|until|for|begin)\b|\bdo\b(?:\s*\|[^|]*\|)?[ \t]*$|^[ \t]*end\b", re.M).finditer(code, at):
        depth += -1 if m[0].strip() == "end" else 1
        if not depth:
            return m.end()
    return len(code)


def _bases(lang: str, head: str) -> list[tuple[str, str]]:
    """(base, relation) in the head of a type declaration."""
    last = lambda s: re.split(r"::|\\|\.", re.sub(r"<.*", "", s.strip(), flags=re.S).strip())[-1]
    split = lambda s: [last(x) for x in re.split(r",(?![^<]*>)", s) if last(x)]
    out: list[tuple[str, str]] = []
    if lang in ("php", "java", "javascript", "typescript"):
        for word, rel in (("extends", "extends"), ("implements", "implements")):
            m = re.search(rf"\b{word}\s+(.*?)(?=\bextends\b|\bimplements\b|\{{|$)", head, re.S)
            out += [(b, rel) for b in split(m[1])] if m else []
    elif lang in ("cpp", "c_sharp", "rust") and (m := re.search(r"(?<!:):(?!:)(.*)", head, re.S)):
        plain = re.sub(r"\b(?:public|private|protected|virtual)\b", "", m[1].split("where")[0])
        out += [(b, "extends") for b in (split(plain.replace("+", ",")) if lang == "rust" else split(plain)) if re.fullmatch(r"\w+", b)]
    elif lang == "ruby" and (m := re.search(r"<\s*([\w:]+)", head)):
        out.append((last(m[1]), "extends"))
    return out


def _scanned(lang: str, src: str) -> Facts:
    out, code = Facts(), _mask(lang, src)
    found: dict[int, tuple[int, str, str]] = {}
    for pattern, kind in DECLS[lang]:
        for m in re.finditer(pattern, code, re.M):
            if m[1] in _WORDS or any(m.start(1) == k for k in found):
                continue
            end = _ruby_end(code, m.end()) if lang == "ruby" else m.end() if kind == "const" else _brace_end(code, m.end())
            found[m.start(1)] = (end, m[1], kind)
    open_: list[tuple[int, str, str]] = []
    spans: list[tuple[int, int, str]] = []
    line = lambda at: code.count("\n", 0, at) + 1
    for start, (end, name, kind) in sorted(found.items()):
        open_ = [x for x in open_ if x[0] > start]
        parents = [n for _, n, _ in open_]
        if kind == "function" and lang in ("php", "cpp", "rust", "ruby") and open_ and (lang != "php" or open_[-1][2] == "class") and (lang != "cpp" or any(k == "class" for _, _, k in open_)):
            kind = "method"
        if kind != "scope":
            out.symbols.append(Symbol(name, kind, line(start), line(max(start, end - 1)), parents, src[code.rfind("\n", 0, start) + 1 : end]))
        if kind == "class":
            head = code[start + len(name) : end].split("{")[0] if lang != "ruby" else code[start : code.find("\n", start) if "\n" in code[start:] else len(code)]
            out.inherits += [(name, parents, b, rel) for b, rel in _bases(lang, head)]
            if lang == "go":
                inner = code[start:end].partition("{")[2].rpartition("}")[0]
                out.inherits += [(name, parents, m[1], "embeds") for m in re.finditer(r"^[ \t]*\*?(?:\w+\.)?([A-Z]\w*)[ \t]*$", inner, re.M)]
            if lang == "ruby":
                out.inherits += [(name, parents, m[1].split("::")[-1], "mixin") for m in re.finditer(r"^[ \t]*(?:include|prepend|extend)\s+([\w:]+)", code[start:end], re.M)]
        if kind == "scope" and lang == "rust" and (m := re.search(r"\bimpl\b[^{;]*?(?:\w+::)*(\w+)\s+for\s+$", code[max(0, start - 200) : start])):
            out.inherits.append((name, parents, m[1], "impl_trait"))
        open_.append((end, name, kind))
        spans.append((start, end, name))
    heads = set(found)
    for m in _CALLED.finditer(code):
        if m[1] not in _WORDS and m.start(1) not in heads:
            around = [x for x in spans if x[0] < m.start() < x[1]]
            out.calls.append((around[-1][2] if around else TOP, m[1]))
    for pattern in COMMANDS.get(lang, ()):
        for m in re.finditer(pattern, code, re.M):
            if m[1] in KEYWORDS[lang] or m.start(1) in heads or lang == "ruby" and not m[0].startswith(".") and not _argument(src, m.end(1)):
                continue
            around = [x for x in spans if x[0] < m.start(1) < x[1]]
            out.calls.append((around[-1][2] if around else TOP, m[1]))
    out.imports = [next(g for g in m.groups() if g).strip() for m in re.finditer(IMPORTS[lang], src, re.M)]
    return out


def extract(lang: str, src: str) -> Facts:
    if lang == "php" and "<?php" not in src:
        src = "<?php " + src.lstrip("\ufeff")
    return _python(src) if lang == "python" else _scanned(lang, src)


def body_form(lang: str, name: str, body: str) -> str:
    """A body's tokens without comments, white space and its own name."""
    if lang == "python":
        drop = {tokenize.COMMENT, tokenize.NL, tokenize.ENCODING, tokenize.ENDMARKER}
        try:
            import textwrap

            out = []
            for t in tokenize.generate_tokens(io.StringIO(textwrap.dedent(body) + "\n").readline):
                if t.type in drop or t.type == tokenize.NAME and t.string == name:
                    continue
                out.append({tokenize.NEWLINE: "\n", tokenize.INDENT: "{", tokenize.DEDENT: "}"}.get(t.type, t.string))
            return " ".join(out)
        except (tokenize.TokenError, IndentationError, SyntaxError):
            pass
    comment = re.compile({"ruby": r"#[^\n]*", "bash": r"(?<=\s)#[^\n]*", "php": rf"{_C}|#(?!\[)[^\n]*"}.get(lang, _C), re.S)
    parts = re.split(rf"({_Q})", body)
    code = "".join(p if i % 2 else comment.sub(" ", p) for i, p in enumerate(parts))
    return " ".join(t for t in re.findall(r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'|\w+|[^\w\s]', code) if t != name)


def digest(text: str | bytes) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()[:32]


def stem(path: str) -> str:
    folder, _, name = path.rpartition("/")
    base = name[: name.rfind(".")] if name.rfind(".") > 0 else name
    return (f"{folder}/{base}" if folder else base).replace("/", ".")


def index_one(path: str, content: bytes, lang: str | None) -> dict[str, list[tuple]]:
    """The rows of one file: files, symbols, imports, calls, inherits. Without grammar, too large or not UTF-8: the file alone."""
    out: dict[str, list[tuple]] = {"symbols": [], "imports": [], "calls": [], "inherits": []}
    try:
        text = content.decode() if lang and len(content) <= MAX_PARSE else None
    except UnicodeDecodeError:
        text = None
    if text is None:
        return out | {"files": [(path, None, len(content), digest(content), True)]}
    facts, root = extract(lang, text), stem(path)
    out["files"] = [(path, lang, len(content), digest(text), facts.ok)]
    for i, s in enumerate(facts.symbols):
        form = body_form(lang, s.name, s.body)
        parent = ".".join([root, *s.parents]) if s.parents else None
        out["symbols"].append((".".join([root, *s.parents, s.name]), s.name, s.kind, path, s.start, s.end, digest(form), len(form.encode()), parent, i))
    out["imports"] = [(path, t) for t in facts.imports]
    out["calls"] = [(f"{root}.{c}" if c != TOP else root, n, path) for c, n in facts.calls]
    out["inherits"] = [(".".join([root, *p, c]), b, rel, path) for c, p, b, rel in facts.inherits]
    return out


INDEXED = (
    "files array<struct<path:string,lang:string,size:long,hash:string,parse_ok:boolean>>, "
    "symbols array<struct<fqn:string,name:string,kind:string,file:string,start_line:long,end_line:long,body_hash:string,body_len:long,parent_fqn:string,ordinal:long>>, "
    "imports array<struct<file:string,target:string>>, calls array<struct<caller_fqn:string,callee_name:string,file:string>>, inherits array<struct<child_fqn:string,parent_name:string,rel:string,file:string>>"
)


def index(tree: DataFrame) -> dict[str, DataFrame]:
    """tree (path, content binary, lang, mtime_ns) -> the five derived tables. Each file is read and parsed once, for all of them."""

    def over(paths: pd.Series, contents: pd.Series, langs: pd.Series) -> pd.DataFrame:
        rows = [index_one(p, bytes(c) if c is not None else b"", g if isinstance(g, str) else None) for p, c, g in zip(paths, contents, langs, strict=True)]
        return pd.DataFrame({k: [r[k] for r in rows] for k in ("files", "symbols", "imports", "calls", "inherits")})

    got = materialize(tree.select("mtime_ns", F.pandas_udf(over, INDEXED)("path", "content", "lang").alias("x")), "parsed")
    out = {k: got.select(F.explode(f"x.{k}").alias("r")).select("r.*") for k in ("symbols", "imports", "calls", "inherits")}
    out["files"] = got.select("mtime_ns", F.explode("x.files").alias("r")).select("r.path", "r.lang", "mtime_ns", "r.size", "r.hash", "r.parse_ok")
    out["symbols"] = out["symbols"].withColumn("id", F.xxhash64("file", "ordinal"))
    return out
