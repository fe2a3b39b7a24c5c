"""A lexical reader of brace and ``end`` languages: definitions with their extents, calls, imports and inheritance.

Comments and strings are blanked first, in place, so that offsets hold; then definitions are found by pattern, and each one's
extent by matching its brace (or ``end``).  A definition without a body ends with its line.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Definition:
    name: str
    type: str  # of the chunk
    kind: str | None  # of the symbol; None: a chunk only
    start: int
    end: int


@dataclass
class Language:
    """``defs``: (pattern with group ``n``, chunk type, symbol kind).  A kind of ``member`` is a function outside classes and a method inside."""

    name: str
    defs: list[tuple[str, str, str | None]]
    line_comments: tuple[str, ...] = ("//",)
    block_comment: bool = True
    ends: bool = False  # bodies end with ``end``
    imports: list[str] = field(default_factory=list)  # patterns with group ``m``
    bases: list[tuple[str, str]] = field(default_factory=list)


_ID = r"[A-Za-z_$][\w$]*"
_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|open|override|async|virtual|partial|readonly|extern|unsafe|new|suspend|inline|operator|data|export|default|declare|mutating|fileprivate|implicit|lazy|case|synchronized|native|constexpr|explicit|enum|inner|annotation)\s+)*"
_CALL_BODY = r"\s*(?:<[^<>{}()]*>)?\s*\([^{};]*\)"
_JS_DEFS = [
    (rf"(?m)^[ \t]*{_MODS}function\s*\*?\s*(?P<n>{_ID})\s*[(<]", "function_declaration", "function"),
    (rf"(?m)^[ \t]*{_MODS}class\s+(?P<n>{_ID})", "class_declaration", "class"),
    (rf"(?m)\b(?:const|let|var)\s+(?P<n>{_ID})\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^()]*\)|{_ID})\s*(?::[^=\n]+)?=>", "arrow_function", "function"),
    (rf"(?m)^[ \t]+{_MODS}(?:get\s+|set\s+)?(?!(?:if|for|while|switch|catch|function|return)\b)(?P<n>[#A-Za-z_$][\w$]*){_CALL_BODY}\s*(?::[^{{;=\n]+)?\{{", "method_definition", "method"),
]
_TS_DEFS = [*_JS_DEFS, (rf"(?m)^[ \t]*{_MODS}interface\s+(?P<n>{_ID})", "interface_declaration", "class"), (rf"(?m)^[ \t]*{_MODS}type\s+(?P<n>{_ID})[^=;\n]*=", "type_alias_declaration", None)]
_JS_BASES = [(rf"\b(?:class|interface)\s+({_ID})[^{{]*?\bextends\s+([^{{]+?)(?=\bimplements\b|\{{)", "extends"), (rf"\bclass\s+({_ID})[^{{]*?\bimplements\s+([^{{]+)\{{", "implements")]
_JS_IMPORTS = [r"""import\s+(?P<names>[^'";]+?)\s+from\s+['"](?P<m>[^'"]+)['"]""", r"""import\s+['"](?P<m>[^'"]+)['"]""", r"""require\(\s*['"](?P<m>[^'"]+)['"]\s*\)"""]
_C_FUNCTION = rf"(?m)^(?!\s*(?:else|return|typedef|if|for|while|switch)\b)[A-Za-z_][\w\s*&:<>,~]*?[\s*&](?P<n>(?:{_ID}::)*~?{_ID})\s*\([^;{{}}]*\)\s*(?:const\s*|noexcept\s*|override\s*)*\{{"
_C_IMPORTS = [r"""(?m)^[ \t]*#\s*include\s*[<"](?P<m>[^>"]+)[>"]"""]
_COLON_BASES = [(rf"\b(?:class|struct|interface|protocol|object|enum)\s+({_ID})(?:<[^<>{{]*>)?(?:\s*\([^{{}}]*?\))?\s*:\s*([^{{\n]+)", "colon")]

# The chunk types and symbol kinds of each language; the patterns are this module's.
LANGUAGES: dict[str, Language] = {
    "javascript": Language("javascript", _JS_DEFS, imports=_JS_IMPORTS, bases=_JS_BASES),
    "typescript": Language("typescript", _TS_DEFS, imports=_JS_IMPORTS, bases=_JS_BASES),
    "tsx": Language("tsx", _TS_DEFS, imports=_JS_IMPORTS, bases=_JS_BASES),
    "c_sharp": Language(
        "c_sharp",
        [
            (rf"(?m)^[ \t]*{_MODS}class\s+(?P<n>{_ID})", "class_declaration", "class"),
            (rf"(?m)^[ \t]*{_MODS}interface\s+(?P<n>{_ID})", "interface_declaration", "class"),
            (rf"(?m)^[ \t]*{_MODS}struct\s+(?P<n>{_ID})", "struct_declaration", "class"),
            (rf"(?m)^[ \t]*{_MODS}enum\s+(?P<n>{_ID})", "enum_declaration", None),
            (rf"(?m)^[ \t]*{_MODS}record\s+(?P<n>{_ID})", "record_declaration", None),
            (rf"(?m)^[ \t]+{_MODS}(?!(?:return|new|else|await|throw|using|class|struct|interface|record)\b)[A-Za-z_][\w<>\[\],.? ]*?\s(?P<n>{_ID})\s*(?:<[^<>(){{}}]*>)?\([^;{{}}]*\)\s*(?:where[^{{]*)?(?:\{{|=>)", "method_declaration", "method"),
        ],
        imports=[r"(?m)^[ \t]*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?(?P<m>[\w.]+)\s*;"],
        bases=_COLON_BASES,
    ),
    "go": Language(
        "go",
        [
            (rf"(?m)^func\s+(?P<n>{_ID})\s*[\(\[]", "function_declaration", "function"),
            (rf"(?m)^func\s*\([^)]*\)\s*(?P<n>{_ID})\s*\(", "method_declaration", "method"),
            (rf"(?m)^type\s+(?P<n>{_ID})\b", "type_declaration", None),
        ],
        imports=[r"""(?m)^[ \t]*import\s+(?:[\w.]+\s+)?"(?P<m>[^"]+)\"""", r"""(?m)^[ \t]*import\s*\((?P<many>[^)]*)\)"""],
    ),
    "rust": Language(
        "rust",
        [
            (rf"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:(?:async|const|unsafe|extern)\s+)*fn\s+(?P<n>{_ID})", "function_item", "function"),
            (rf"(?m)^[ \t]*(?:unsafe\s+)?impl\b(?:\s*<[^{{]*?>)?\s+(?:[^{{]*?\bfor\s+)?(?P<n>{_ID})", "impl_item", "class"),
            (rf"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<n>{_ID})", "struct_item", "class"),
            (rf"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<n>{_ID})", "enum_item", None),
            (rf"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?trait\s+(?P<n>{_ID})", "trait_item", "class"),
        ],
        imports=[r"(?m)^[ \t]*(?:pub\s+)?use\s+(?P<m>[^;]+);"],
        bases=[(rf"\bimpl\b(?:\s*<[^{{]*?>)?\s+((?:{_ID}::)*{_ID})(?:<[^{{]*?>)?\s+for\s+({_ID})", "impl")],
    ),
    "java": Language(
        "java",
        [
            (rf"(?m)^[ \t]*{_MODS}class\s+(?P<n>{_ID})", "class_declaration", "class"),
            (rf"(?m)^[ \t]*{_MODS}interface\s+(?P<n>{_ID})", "interface_declaration", "class"),
            (rf"(?m)^[ \t]*{_MODS}enum\s+(?P<n>{_ID})\s*(?:implements[^{{]*)?\{{", "enum_declaration", None),
            (rf"(?m)^[ \t]+{_MODS}(?!(?:return|new|else|throw|class|interface)\b)(?:<[^<>]*>\s*)?[A-Za-z_][\w<>\[\],.? ]*?\s(?P<n>{_ID})\s*\([^;{{}}]*\)\s*(?:throws[^{{;]*)?\{{", "method_declaration", "method"),
        ],
        imports=[r"(?m)^[ \t]*import\s+(?:static\s+)?(?P<m>[\w.]+(?:\.\*)?)\s*;"],
        bases=_JS_BASES,
    ),
    "kotlin": Language(
        "kotlin",
        [
            (rf"(?m)^[ \t]*{_MODS}fun\s+(?:<[^<>]*>\s*)?(?:[\w.<>?]+\.)?(?P<n>{_ID})\s*\(", "function_declaration", "function"),
            (rf"(?m)^[ \t]*{_MODS}class\s+(?P<n>{_ID})", "class_declaration", "class"),
            (rf"(?m)^[ \t]*{_MODS}object\s+(?P<n>{_ID})", "object_declaration", "class"),
            (rf"(?m)^[ \t]*{_MODS}interface\s+(?P<n>{_ID})", "interface_declaration", "class"),
        ],
        imports=[r"(?m)^[ \t]*import\s+(?P<m>[\w.]+(?:\.\*)?)"],
        bases=_COLON_BASES,
    ),
    "swift": Language(
        "swift",
        [
            (rf"(?m)^[ \t]*{_MODS}func\s+(?P<n>{_ID})\s*[(<]", "function_declaration", "function"),
            (rf"(?m)^[ \t]*{_MODS}class\s+(?!func\b)(?P<n>{_ID})", "class_declaration", "class"),
            (rf"(?m)^[ \t]*{_MODS}protocol\s+(?P<n>{_ID})", "protocol_declaration", "class"),
            (rf"(?m)^[ \t]*{_MODS}struct\s+(?P<n>{_ID})", "struct_declaration", "class"),
            (rf"(?m)^[ \t]*(?:public|private|indirect|\s)*enum\s+(?P<n>{_ID})", "enum_declaration", "class"),
        ],
        imports=[r"(?m)^[ \t]*import\s+(?:class\s+|struct\s+|func\s+)?(?P<m>[\w.]+)"],
        bases=_COLON_BASES,
    ),
    "php": Language(
        "php",
        [
            (rf"(?m)^{_MODS}function\s+&?(?P<n>{_ID})\s*\(", "function_definition", "function"),
            (rf"(?m)^[ \t]+{_MODS}function\s+&?(?P<n>{_ID})\s*\(", "method_declaration", "method"),
            (rf"(?m)^[ \t]*{_MODS}class\s+(?P<n>{_ID})", "class_declaration", "class"),
            (rf"(?m)^[ \t]*interface\s+(?P<n>{_ID})", "interface_declaration", "class"),
            (rf"(?m)^[ \t]*trait\s+(?P<n>{_ID})", "trait_declaration", "class"),
        ],
        line_comments=("//", "#"),
        imports=[r"(?m)^use\s+(?:function\s+|const\s+)?(?P<m>[\w\\]+)[^;]*;"],
        bases=_JS_BASES,
    ),
    "ruby": Language(
        "ruby",
        [
            (r"(?m)^[ \t]*def\s+(?P<n>[A-Za-z_]\w*[?!=]?)", "method", "function"),
            (r"(?m)^[ \t]*def\s+self\.(?P<n>[A-Za-z_]\w*[?!=]?)", "singleton_method", "function"),
            (r"(?m)^[ \t]*class\s+(?P<n>[A-Z][\w:]*)", "class", "class"),
            (r"(?m)^[ \t]*module\s+(?P<n>[A-Z][\w:]*)", "module", "class"),
        ],
        line_comments=("#",),
        block_comment=False,
        ends=True,
        imports=[r"""(?m)^[ \t]*require(?:_relative)?\s*\(?\s*['"](?P<m>[^'"]+)['"]"""],
        bases=[(r"(?m)^[ \t]*class\s+([A-Z][\w:]*)\s*<\s*([A-Z][\w:]*)", "extends")],
    ),
    "c": Language("c", [(_C_FUNCTION, "function_definition", "function"), (rf"(?m)^[ \t]*(?:typedef\s+)?struct\s+(?P<n>{_ID})\s*\{{", "struct_specifier", None), (rf"(?m)^[ \t]*(?:typedef\s+)?enum\s+(?P<n>{_ID})\s*\{{", "enum_specifier", None)], imports=_C_IMPORTS),
    "cpp": Language(
        "cpp",
        [
            (rf"(?m)^[ \t]*(?:template\s*<[^<>]*>\s*)?class\s+(?P<n>{_ID})[^;{{]*\{{", "class_specifier", "class"),
            (rf"(?m)^[ \t]*(?:template\s*<[^<>]*>\s*)?struct\s+(?P<n>{_ID})[^;{{]*\{{", "struct_specifier", "class"),
            (rf"(?m)^[ \t]*enum\s+(?:class\s+)?(?P<n>{_ID})[^;{{]*\{{", "enum_specifier", None),
            (rf"(?m)^[ \t]*namespace\s+(?P<n>{_ID})\s*\{{", "namespace_definition", None),
            (_C_FUNCTION.replace("(?m)^(?!", "(?m)^[ \\t]*(?!"), "function_definition", "function"),
        ],
        imports=_C_IMPORTS,
        bases=[(rf"\b(?:class|struct)\s+({_ID})[^:;{{]*:\s*([^{{;]+)\{{", "extends")],
    ),
    "scala": Language(
        "scala",
        [
            (rf"(?m)^[ \t]*{_MODS}def\s+(?P<n>{_ID})", "function_definition", "function"),
            (rf"(?m)^[ \t]*{_MODS}class\s+(?P<n>{_ID})", "class_definition", "class"),
            (rf"(?m)^[ \t]*{_MODS}object\s+(?P<n>{_ID})", "object_definition", "class"),
            (rf"(?m)^[ \t]*{_MODS}trait\s+(?P<n>{_ID})", "trait_definition", "class"),
        ],
        imports=[r"(?m)^[ \t]*import\s+(?P<m>[\w.]+(?:\.\{[^}]*\}|\._|\.\*)?)"],
        bases=[(rf"\b(?:class|object|trait)\s+({_ID})[^{{\n]*?\bextends\s+([^{{\n]+)", "scala")],
    ),
}
# Extensions of parsed files.
BY_EXTENSION = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "tsx", ".cs": "c_sharp", ".go": "go", ".rs": "rust", ".java": "java",
    ".kt": "kotlin", ".kts": "kotlin", ".swift": "swift", ".php": "php", ".rb": "ruby", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".cc": "cpp", ".scala": "scala",
}
NO_CALL = frozenset("if for while switch catch return sizeof function when match foreach unless elsif until with typeof lock using fun func def fn class struct interface new throw await yield super this self constructor init guard else do try defined".split())


def blanked(text: str, lang: Language, strings: bool = True) -> str:
    """The text with comments (and strings) overwritten by blanks; line breaks stay."""
    parts = [re.escape(c) + r"[^\n]*" for c in lang.line_comments]
    if lang.name in ("c", "cpp", "c_sharp"):
        parts.append(r"(?m:^[ \t]*#(?!\s*include)[^\n]*)")
    if lang.block_comment:
        parts.append(r"/\*.*?\*/")
    quotes = [r'"""(?:\\.|[^\\])*?"""'] if lang.name in ("kotlin", "scala", "swift", "java") else []
    quotes += [r'"(?:\\.|[^"\\\n])*"', r"`(?:\\.|[^`\\])*`"] + ([r"'(?:\\.|[^'\\\n])*'"] if lang.name != "rust" else [r"'(?:\\.|[^'\\\n])'"])
    pattern = re.compile("|".join(f"(?P<c{k}>{p})" for k, p in enumerate(parts)) + "|" + "|".join(quotes), re.S)

    def blank(m: re.Match) -> str:
        comment = m.lastgroup is not None
        if not comment and not strings:
            return m.group()
        return re.sub(r"[^\n]", " ", m.group())

    return pattern.sub(blank, text)


def _brace_end(code: str, at: int) -> int:
    """The end of a definition that begins at ``at``: past its closing brace, or of its line if it has no body."""
    depth, parens, i, n = 0, 0, at, len(code)
    while i < n:
        c = code[i]
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0 and not re.match(r"[ \t]*\{", code[i + 1 : i + 80]):  # else it closed a type
                return i + 1
            if depth < 0:
                return i
        elif depth == 0:
            if c in "([":
                parens += 1
            elif c in ")]":
                parens -= 1
            elif c == ";" and parens <= 0:
                return i + 1
            elif c == "\n" and parens <= 0 and not re.match(r"\s*(?:\{|where\b|throws\b|:|extends\b|implements\b|with\b|=>|->)", code[i + 1 : i + 200]) and not code[at:i].rstrip().endswith(("=", "=>", ",", "->", ":")):
                return i
        i += 1
    return n


_OPEN = re.compile(r"(?m)(?:^|(?<=[;\n]))[ \t]*(?:class|module|def|if|unless|while|until|case|for|begin)\b|\bdo\b(?=\s*(?:\||$))|(?<==)\s*(?:if|unless|case|begin)\b|\bend\b", re.M)


def _end_keyword(code: str, at: int) -> int:
    depth = 0
    for m in _OPEN.finditer(code, at):
        if m.group().strip().startswith("end"):
            depth -= 1
            if depth <= 0:
                return m.end()
        else:
            depth += 1
    return len(code)


def definitions(code: str, lang: Language) -> list[Definition]:
    """All definitions of blanked code, in order of their start."""
    found: dict[int, Definition] = {}
    for pattern, kind, symbol in lang.defs:
        for m in re.finditer(pattern, code):
            name = m.group("n")
            if name in NO_CALL and name not in ("constructor", "init"):
                continue
            start = m.start() + len(m.group()) - len(m.group().lstrip())
            end = _end_keyword(code, start) if lang.ends else _brace_end(code, start)
            old = found.get(m.start("n"))
            if old is None:
                found[m.start("n")] = Definition(name.split("::")[-1], kind, symbol, start, end)
    return sorted(found.values(), key=lambda d: (d.start, -d.end))


def _names(text: str) -> list[str]:
    """The base names of a comma list, without type arguments, modifiers and calls."""
    depth, out, now = 0, [], ""
    for c in text + ",":
        depth += (c in "<([") - (c in ">)]")
        if c == "," and depth == 0:
            now = re.sub(r"\b(?:public|private|protected|virtual|by)\b.*?(?=\w|$)", "", re.sub(r"[<({\[].*", "", now, flags=re.S)).strip()
            if m := re.match(r"[\w.:\\$]+", now):
                out.append(re.split(r"[.:\\]", m.group().rstrip(":"))[-1])
            now = ""
        else:
            now += c
    return [x for x in out if x]


def read(text: str, language: str) -> tuple[list[Definition], list[tuple], list[tuple], list[tuple]]:
    """(definitions, calls (caller, callee, offset), imports (name, module), inheritance (child, parent, relation, offset))."""
    lang = LANGUAGES[language]
    code = blanked(text, lang)
    defs = definitions(code, lang)
    named = [d for d in defs if d.kind]
    headers = {}
    for d in defs:
        headers[code.find(d.name, d.start)] = d

    def enclosing(at: int) -> str | None:
        best = None
        for d in named:
            if d.start > at:
                break
            if d.end > at and code.find(d.name, d.start) != at and (best is None or d.end - d.start <= best.end - best.start):
                best = d
        return best.name if best else None

    calls = []
    pattern = r"([A-Za-z_$][\w$]*[?!]?)\s*(?:<[\w\s,.<>?]*>)?\(" if not lang.ends else r"([A-Za-z_]\w*[?!]?)\(|\.([A-Za-z_]\w*[?!]?)(?!\w|\()"
    for m in re.finditer(pattern, code):
        name = m.group(1) or m.group(2)
        at = m.start(1) if m.group(1) else m.start(2)
        before = code[max(0, at - 12) : at].rstrip()
        if name in NO_CALL or name.startswith("__") or at in headers or re.search(r"\b(?:function|def|fun|func|fn|class|struct|new)$", before):
            continue
        calls.append((enclosing(at), name, at))

    source = blanked(text, lang, strings=False)
    imports = []
    for pattern in lang.imports:
        for m in re.finditer(pattern, source):
            groups = m.groupdict()
            if groups.get("many") is not None:
                imports += [(x.split("/")[-1], x) for x in re.findall(r'"([^"]+)"', groups["many"])]
                continue
            module = re.sub(r"\s+", " ", groups["m"].strip())
            if groups.get("names"):
                names = [re.sub(r"\s+as\s+\w+", "", x).strip().removeprefix("type ").strip() for x in re.sub(r"[{}]", ",", groups["names"]).split(",")]
                names = [x.replace("*", "").strip() or module.split("/")[-1] for x in names if x]
                imports += [(x, module) for x in names]
            elif language in ("c", "cpp"):
                imports.append((module.split("/")[-1].split(".")[0], module))
            elif language == "ruby":
                imports.append((module.split("/")[-1], module))
            else:
                last = re.split(r"[.:\\/]+", re.sub(r"\{.*", "", re.sub(r"\s+as\s+\w+$", "", module)).rstrip(".*:_\\"))[-1]
                imports.append((last or module, module))

    bases = []
    for pattern, relation in lang.bases:
        for m in re.finditer(pattern, code):
            if relation == "impl":
                bases.append((m.group(2), m.group(1).split("::")[-1], "implements", m.start()))
                continue
            text_of = re.sub(r"\bwith\b", ",", m.group(2)) if relation == "scala" else m.group(2)
            for name in _names(text_of):
                kind = relation
                if relation == "colon":
                    kind = "implements" if language == "c_sharp" and re.match(r"I[A-Z]", name) else "extends"
                elif relation == "scala":
                    kind = "extends"
                bases.append((m.group(1), name, kind, m.start()))
    return defs, calls, list(dict.fromkeys(imports)), list(dict.fromkeys(bases))


class Lines:
    """Line numbers of offsets."""

    def __init__(self, text: str):
        self.breaks = [m.start() for m in re.finditer("\n", text)]

    def at(self, offset: int) -> int:
        return bisect_right(self.breaks, offset - 1) + 1
