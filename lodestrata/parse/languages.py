"""Language parsers over :class:`Source`: Dart, Kotlin and Java, JavaScript and TypeScript, markup, Gradle and outlines.

Each yields plain dicts: kind, name, line and what else is known; ``records`` fills in the rest.
"""

from __future__ import annotations

import hashlib
import re

from lodestrata.parse.source import Source, blanked

# ---- fixed values -------------------------------------------------------------------------------------------
WIDGET_BASES = (
    "StatelessWidget StatefulWidget ConsumerWidget ConsumerStatefulWidget HookWidget HookConsumerWidget InheritedWidget InheritedNotifier "
    "InheritedModel RenderObjectWidget SingleChildRenderObjectWidget MultiChildRenderObjectWidget State"
).split()
NOT_CALLS = (
    "if for while switch catch return await async throw assert super this print setState Scaffold Container Text Column Row Stack Padding "
    "SizedBox Expanded Flexible Center Align Icon"
).split()
NOT_WIDGETS = (
    "Navigator AppTheme Theme DurationFormatter Localizations Clipboard HapticFeedback Uuid DateFormat HiveService BadgeHelper _DS "
    "ReportPdfGenerator ShareParams XFile AsyncValue AsyncData AsyncLoading AsyncError TextStyle Border BorderRadius Radius BoxDecoration "
    "EdgeInsets File Uint8List ByteData Platform TargetPlatform WidgetsBinding SystemChrome MediaQuery ScaffoldMessenger FocusScope "
    "FocusManager String int double bool num List Map Set Future Stream Duration DateTime TextEditingController GlobalKey "
    "AnimationController ScrollController TabController PageController FocusNode Color Colors Paint Canvas Path Offset Size Rect Key "
    "ValueKey ObjectKey UniqueKey"
).split()
NOT_WIDGET_SUFFIXES = "Entity Model Exception Error State Result Params Provider Repository Source Service Helper Util Utils Data".split()
NOT_WIDGET_METHODS = (
    "of lerp copyWith maybeOf sizeOf paddingOf values parse tryParse fromJson toJson push pop format formatDecimalDays formatDuration "
    "successColor lightImpact setData getData get set watch read select show showDialog showSnackBar"
).split()
COMPONENT_SUFFIXES = "Activity Fragment Service ViewModel Adapter Receiver Provider Application View".split()
# -----------------------------------------------------------------------------------------------------------

_NAME = r"[A-Za-z_$][\w$]*"
_CALL = re.compile(rf"(?:({_NAME})\s*[?!]?\.\s*)?({_NAME})\s*\(")
_GENERIC = re.compile(r"<[^<>]*>")
_PARAMS = re.compile(r"\s*(?:<[^()]*>)?\s*\(")
_SPACES = re.compile(r"\s+")
_NOT_CALLS = frozenset(NOT_CALLS)


def bare(t: str) -> str:
    """A type without its generics and nullability."""
    while (s := _GENERIC.sub("", t)) != t:
        t = s
    return t.strip().rstrip("?").strip()


def listed(text: str | None) -> list[str]:
    """Comma-separated types, with commas inside <> and () left alone."""
    out, depth, word = [], 0, ""
    for c in text or "":
        depth += (c in "<([{") - (c in ">)]}")
        if c == "," and depth == 0:
            out.append(word.strip())
            word = ""
        else:
            word += c
    return [w for w in [*out, word.strip()] if w]


def private(name: str) -> bool:
    return name.startswith(("_", "#"))


def fingerprint(body: str, name: str) -> tuple[str, int]:
    b = "".join((body.replace(name, "") if name else body).split())
    return hashlib.md5(b.encode()).hexdigest(), len(b)


def params_of(header: str, name: str) -> str:
    """Text of the parameter list after a name."""
    at = header.find(name)
    while at >= 0 and not (m := _PARAMS.match(header, at + len(name))):
        at = header.find(name, at + 1)
    if at < 0:
        return ""
    depth, k = 1, m.end()
    while k < len(header) and depth:
        depth += (header[k] == "(") - (header[k] == ")")
        k += 1
    return " ".join(header[m.end() : k - 1].split())


class Parser:
    by_line = False

    def __init__(self, path: str, text: str):
        self.path, self.text = path, text
        self.src = Source(text, self.by_line)
        self.rows: list[dict] = []

    def add(self, kind: str, name: str, at: int, end: int | None = None, **more) -> None:
        self.rows.append({"kind": kind, "name": name, "line": self.src.line(at), "line_end": self.src.line(end) if end is not None else None, "is_private": private(name), **more})

    def body(self, seg) -> dict:
        if seg.open is None:
            return {}
        digest, size = fingerprint(self.text[seg.open : seg.close + 1], "")
        return {"body_hash": digest, "body_length": size}

    def calls(self, a: int, b: int, parent: str | None, function: str | None) -> None:
        masked = self.src.masked
        for m in _CALL.finditer(masked, a, b):
            receiver, name = m[1], m[2]
            if name in _NOT_CALLS or name == function or masked[max(0, m.start(2) - 4) : m.start(2)].strip() in ("new", "fun"):
                continue
            line = self.src.line(m.start(2))
            lo = self.src.breaks[line - 2] + 1 if line > 1 else 0
            hi = self.src.breaks[line - 1] if line - 1 < len(self.src.breaks) else len(self.text)
            self.add("call", name, m.start(2), parent=parent, receiver=receiver, caller_function=function, is_static=receiver is None or receiver[0].isupper(), context=self.text[lo:hi].strip()[:160])

    def docs(self, at: int) -> str | None:
        """The /// or /** */ text right above a place."""
        above = self.text[:at].rstrip().rsplit("\n", 40)
        run = []
        for line in reversed(above):
            t = line.strip()
            if t.startswith(("///", "*", "/**")):
                run.append(t.strip("/* ").strip())
            elif not t.startswith("@"):
                break
        return "\n".join(x for x in reversed(run) if x) or None


class Dart(Parser):
    _CLASS = re.compile(rf"^(?P<mods>(?:(?:abstract|base|final|interface|sealed|mixin)\s+)*)class\s+(?P<name>{_NAME})")
    _CLAUSES = {word: re.compile(rf"\b{word}\s+(.+?)(?=\s+(?:extends|with|implements|on)\b|\Z)") for word in ("extends", "with", "implements", "on")}
    _ANNOTATION = re.compile(rf"@({_NAME})(?:\.{_NAME})?(?:\((?:[^()]|\([^()]*\))*\))?\s*")
    _ANNOTATED = re.compile(rf"(?:class|enum|mixin|extension)\s+({_NAME})|({_NAME})\s*[(;=]")
    _DIRECTIVE = re.compile(r"(import|export|part)\b(?!\s*of\b)")
    _QUOTED = re.compile(r"['\"]([^'\"]*)['\"]")
    _LISTS = {word: re.compile(rf"\b{word}\s+([\w\s,$]+?)(?=\bshow\b|\bhide\b|\Z)") for word in ("show", "hide")}
    _ALIAS = re.compile(rf"\bas\s+({_NAME})")
    _TYPEDEF = re.compile(rf"typedef\s+(?:.*?\b)?({_NAME})\s*(?:<[^=]*>)?\s*(=|\()")
    _MIXIN = re.compile(rf"(?:base\s+)?mixin\s+({_NAME})")
    _EXTENSION_TYPE = re.compile(rf"extension\s+type\s+(?:const\s+)?({_NAME})")
    _EXTENSION = re.compile(rf"extension\s*(?:({_NAME})\s*(?:<.*?>)?\s*)?\bon\s+(.+)\Z")
    _ENUM = re.compile(rf"enum\s+({_NAME})")
    _VALUE, _EARLY_VALUE, _BRACKETED = re.compile(r"(?<![=!<>])=(?!=|>)"), re.compile(r"[^=(]*="), re.compile(r"[(<\[{].*")
    _NOT_TYPE = re.compile(r"\b(static|external|late|covariant|override)\b")
    _ASYNC = re.compile(r"\)\s*(async|sync)\b")
    _FIELD = re.compile(rf"(?P<mods>(?:(?:static|late|final|const|var|covariant|external)\s+)*)(?P<type>.*?)\b(?P<name>{_NAME})\s*(?:=(?P<value>.*))?\Z", re.S)
    _MARKED_END, _INITIALISERS = re.compile(r"\)\s*(async\*?|sync\*)?\s*\Z"), re.compile(r"\)\s*:.*\Z", re.S)
    _NAMED = re.compile(rf"(.*?)({_NAME}|operator\s*\S+)\s*(?:<[^<>]*(?:<[^<>]*>)*[^<>]*>)?\s*\Z", re.S)
    _METHOD = re.compile(rf"^(?P<ret>.*?)\b(?P<name>{_NAME}|operator\s*[^\s\w(]+)\s*(?:<[^()]*>)?\s*\((?P<rest>.*)\Z", re.S)
    _ACCESSOR = re.compile(rf"^(?P<ret>.*?)\b(?P<how>get|set)\s+(?P<name>{_NAME})", re.S)
    _STATEMENT = re.compile(r"^(?:return|await|throw|if|for|while|switch|do|try|else|case|assert|yield|new)\b")

    def parse(self) -> list[dict]:
        for seg in self.src.segments(0, len(self.text)):
            self.top(seg)
        return self.rows

    def annotations(self, header: str, at: int) -> str:
        while header.startswith("@") and (m := self._ANNOTATION.match(header)):
            target = self._ANNOTATED.search(header[m.end() :] + ";")
            self.add("annotation", m[1], at, target=(target[1] or target[2]) if target else None)
            at, header = at + m.end(), header[m.end() :]
        return header

    def top(self, seg) -> None:
        h = self.annotations(seg.header, seg.start)
        at = seg.start + (len(seg.header) - len(h))
        flat = " ".join(h.split())
        if m := self._DIRECTIVE.match(flat):
            quoted = self._QUOTED.search(self.text, seg.start, seg.end)
            more = lambda word: listed(x[1]) if (x := self._LISTS[word].search(flat)) else []
            alias = self._ALIAS.search(flat)
            self.add("import", quoted[1] if quoted else "", at, type=m[1], alias=alias and alias[1], show=more("show"), hide=more("hide"))
        elif m := self._TYPEDEF.match(flat):
            self.add("typedef", m[1], at, value=flat[m.end() - 1 :].lstrip("= ").strip())
        elif m := self._CLASS.match(flat):
            self.class_(seg, flat, at, m["name"], m["mods"].split())
        elif m := self._MIXIN.match(flat):
            on = self._CLAUSES["on"].search(flat)
            self.add("mixin", m[1], at, seg.close, on=on and on[1].strip())
            self.class_(seg, flat, at, m[1], ["mixin"])
        elif m := self._EXTENSION_TYPE.match(flat):
            self.add("extension_type", m[1], at, seg.close, on=params_of(flat, m[1]))
            self.members(seg, m[1])
        elif m := self._EXTENSION.match(flat):
            name = m[1] if m[1] and m[1] != "on" else ""
            self.add("extension", name, at, seg.close, on=m[2].strip())
            self.members(seg, name or m[2].strip())
        elif (m := self._ENUM.match(flat)) and seg.open is not None:
            self.add("enum", m[1], at, seg.close, values=enum_values(self.src.masked[seg.open + 1 : seg.close]))
        else:
            self.member(seg, h, at, None)

    def class_(self, seg, flat: str, at: int, name: str, mods: list[str]) -> None:
        clause = lambda word: m[1].strip() if (m := self._CLAUSES[word].search(flat)) else None
        base = clause("extends")
        kind = "mixin" if "mixin" in mods and not base else "widget" if base and (bare(base) in WIDGET_BASES or bare(base).endswith(("Widget", "State"))) else "class"
        self.add("class", name, at, seg.close, type=kind, extends_class=base, mixins=listed(clause("with")), implements=listed(clause("implements")), is_abstract="abstract" in mods, comment=self.docs(seg.start), **self.body(seg))
        self.members(seg, name)

    def members(self, seg, parent: str) -> None:
        if seg.open is not None:
            for s in self.src.segments(seg.open + 1, seg.close):
                h = self.annotations(s.header, s.start)
                self.member(s, h, s.start + len(s.header) - len(h), parent)

    def member(self, seg, h: str, at: int, parent: str | None) -> None:
        flat = " ".join(h.split())
        if not flat or self._STATEMENT.match(flat):
            return
        static, end = "static " in f" {flat}", seg.close if seg.open is not None else seg.end
        inner = (seg.open + 1 if seg.open is not None else at + (h.find("=>") + 2 if "=>" in h else len(h)), end)
        if m := self._ACCESSOR.match(flat.split("=>")[0].split("(")[0]):
            self.add("function", m["name"], at, end, parent=parent, type=m["ret"].replace("static", "").strip() or "dynamic", is_static=static)
            self.add("property", m["name"], at, parent=parent, type=m["ret"].replace("static", "").strip() or "dynamic", accessor=m["how"], is_static=static)
            return self.calls(*inner, parent, m["name"])
        head = flat.partition("=>")[0]
        value = "=" in head and self._VALUE.search(head if self._EARLY_VALUE.match(head) else self._BRACKETED.sub(lambda x: "\0" * len(x[0]), head))
        # a pattern of its own for each class: only where the header has the name at all
        if parent and parent in flat and (m := re.match(rf"(?:(?:const|external|factory)\s+)*({re.escape(parent)}(?:\.{_NAME})?)\s*\(", flat)):
            self.add("constructor", m[1], at, end, parent=parent, value=params_of(flat, m[1]), is_factory="factory " in flat[: m.start(1)], is_const=flat.startswith("const "))
            return self.calls(*inner, parent, m[1])
        m = None if value else self._function(head)
        if m and m[1] not in ("if", "for", "while", "switch", "catch", "return", "assert"):
            ret = self._NOT_TYPE.sub("", m[0]).strip()
            self.add("function", m[1], at, end, parent=parent, type=ret or "dynamic", value=params_of(flat, m[1]), is_async=bool(self._ASYNC.search(flat)), is_static=static, comment=self.docs(seg.start), **self.body(seg))
            self.calls(*inner, parent, m[1])
            if m[1] == "build":
                self.widgets(at, end)
            return
        m = self._FIELD.match(flat)
        if m and (m["mods"] or m["type"].strip()):
            mods = m["mods"].split()
            self.add("property" if parent else "variable", m["name"], at, parent=parent, type=m["type"].strip() or None, value=(m["value"] or "").strip() or None, is_final="final" in mods, is_const="const" in mods, is_static=static, is_top_level=parent is None)
            if m["value"]:
                self.calls(at + h.find("="), end, parent, None)

    @classmethod
    def _function(cls, head: str):
        """(return type, name) of a function header: the last name before the parameter list that ends it."""
        if ")" not in head:
            return None
        body = cls._INITIALISERS.sub(")", cls._MARKED_END.sub(")", head.strip()))
        if not body.endswith(")"):
            return None
        depth = 0
        for k in range(len(body) - 1, -1, -1):
            depth += (body[k] == ")") - (body[k] == "(")
            if depth == 0:
                m = cls._NAMED.match(body[:k])
                return (m[1].strip(), m[2]) if m else None
        return None

    _WIDGET = re.compile(r"(?:\breturn\s+|=>\s*)?(?<![\w.])(_?[A-Z]\w*)(?:<[^<>]*>)?(?:\.(\w+))?\s*\(")

    def widgets(self, a: int, b: int) -> None:
        """UI nodes of a build method; the parent is the last node before with a smaller column."""
        stack: list[tuple[int, int]] = []  # (column, node)
        count = len([r for r in self.rows if r["kind"] == "widget"])
        root = None
        first = True
        lo = self.text.rfind("\n", 0, a) + 1
        for line in self.src.masked[lo:b].split("\n"):
            start = lo
            lo += len(line) + 1
            signature, first = first, False
            if signature and "=>" not in line:
                continue
            for m in self._WIDGET.finditer(line):
                name, method = m[1], m[2]
                if name in NOT_WIDGETS or name.endswith(tuple(NOT_WIDGET_SUFFIXES)) or method in NOT_WIDGET_METHODS:
                    continue
                rest = self.text[start + m.end() : self.text.find("\n", start + m.end())].strip()
                if re.match(r"\)\s*=>", rest):
                    continue
                detail = re.match(r"'([^']*)'|\"([^\"]*)\"|(Icons\.[\w.]+)", rest)
                while stack and stack[-1][0] >= m.start():
                    stack.pop()
                parent = stack[-1][1] if stack else None
                root = count if parent is None else root
                self.add("widget", name, start + m.start(1), node_id=count, parent_id=parent, root_id=root, depth=len(stack), ord=count, value=next((x for x in detail.groups() if x), None) if detail else None)
                stack.append((m.start(), count))
                count += 1


def enum_values(body: str) -> list[str]:
    """Names of enum values: what stands before the first ; at the top of the body."""
    flat = re.sub(r"\((?:[^()]|\([^()]*\))*\)|\{[^{}]*\}", "", body.split(";")[0])
    return [m[1] for part in flat.split(",") if (m := re.match(rf"\s*(?:@\w+\s+)*({_NAME})", part))]


class KotlinJava(Parser):
    by_line = True
    _MODS = r"(?:(?:@[\w.]+(?:\([^()]*\))?|public|private|protected|internal|open|abstract|sealed|data|inner|final|static|override|suspend|inline|operator|companion|const|lateinit|enum|annotation|value|synchronized|default|native|tailrec|infix|external)\s+)*"

    def parse(self) -> list[dict]:
        self.walk(0, len(self.text), None)
        return self.rows

    def walk(self, a: int, b: int, parent: str | None) -> None:
        for s in self.src.segments(a, b):
            self.segment(s, parent)

    def segment(self, s, parent: str | None) -> None:
        flat = _SPACES.sub(" ", s.header)
        mods = m[0] if (m := re.match(self._MODS, flat + " ")) else ""
        for x in re.finditer(r"@([\w.]+)", mods):
            self.add("annotation", x[1], s.start)
        rest = flat[len(mods) :].strip()
        hidden = bool(re.search(r"\bprivate\b", mods))
        if m := re.match(r"import\s+(?:static\s+)?([\w.*]+)(?:\s+as\s+(\w+))?", rest):
            self.add("import", m[1], s.start, alias=m[2])
        elif re.match(r"package\b", rest):
            return
        elif (m := re.match(rf"(fun\s+)?interface\s+({_NAME})", rest)) and not rest.startswith("fun interface fun"):
            self.add("mixin", m[2], s.start, s.close, hidden=hidden)
            self.inside(s, m[2])
        elif m := re.match(rf"(?:class\s+)?(?:enum\s+)?class\s+({_NAME})|enum\s+({_NAME})", rest):
            name = m[1] or m[2]
            if "enum" in mods or rest.startswith("enum"):
                self.add("enum", name, s.start, s.close, values=enum_values(self.src.masked[s.open + 1 : s.close]) if s.open is not None else [])
            else:
                self.class_(s, rest, name, mods)
            self.inside(s, name)
        elif m := re.match(rf"object\b\s*({_NAME})?", rest):
            name = m[1] or "Companion"
            self.class_(s, rest, name, mods)
            self.inside(s, name)
        elif m := re.match(rf"fun\s+(?:<[^>]*>\s*)?(?:(?P<on>[\w<>?.]+)\.)?(?P<name>{_NAME}|`[^`]+`)\s*\(", rest):
            ret = re.search(r"\)\s*:\s*([^={]+)", rest)
            if m["on"]:
                self.add("extension", f"{m['on']}.{m['name']}", s.start, s.close, on=m["on"])
            self.function(s, m["name"], (ret[1].strip() if ret else "Unit"), rest, parent, mods, hidden)
        elif m := re.match(rf"(?:val|var)\s+(?:<[^>]*>\s*)?(?:[\w<>?.]+\.)?({_NAME})\s*(?::\s*([^=]+?))?\s*(?:=\s*(.*))?\Z", rest):
            self.add("property" if parent else "variable", m[1], s.start, parent=parent, type=(m[2] or "").strip() or None, value=m[3], is_final=rest.startswith("val"), is_top_level=parent is None)
            self.calls(s.start, s.end, parent, None)
        elif (m := re.match(rf"(?P<ret>[\w<>\[\], ?.]+?)\s+(?P<name>{_NAME})\s*\(", rest)) and m["ret"] not in ("return", "new", "throw", "else") and (s.open is not None or "abstract" in mods):
            self.function(s, m["name"], m["ret"].strip(), rest, parent, mods, hidden)
        elif (m := re.match(rf"(?P<type>[\w<>\[\], ?.]+?)\s+(?P<name>{_NAME})\s*(?:=\s*(?P<value>.*))?\Z", rest)) and s.open is None and m["type"] not in ("return", "throw", "package"):
            self.add("property" if parent else "variable", m["name"], s.start, parent=parent, type=m["type"].strip(), value=m["value"], is_final="final" in mods, is_top_level=parent is None)

    def inside(self, s, name: str) -> None:
        if s.open is not None:
            self.walk(s.open + 1, s.close, name)

    def class_(self, s, rest: str, name: str, mods: str) -> None:
        supers = re.search(r"\)\s*:\s*(.+)\Z|^[^(:]*:\s*(.+)\Z", re.sub(r"<[^<>]*>", "", rest))
        base, others = None, []
        for t in listed((supers[1] or supers[2]) if supers else None):
            if base is None and ("(" in t or bare(t.split("(")[0]).endswith(tuple(COMPONENT_SUFFIXES))):
                base = t.split("(")[0].strip()
            else:
                others.append(t.split(" by ")[0].strip())
        if m := re.search(r"\bextends\s+([\w.<>, ]+?)(?=\s+implements\b|\Z)", rest):
            base = m[1].strip()
        if m := re.search(r"\bimplements\s+(.+)\Z", rest):
            others = listed(m[1])
        self.add("class", name, s.start, s.close, type="class", extends_class=base, implements=others, mixins=[], is_abstract="abstract" in mods, comment=self.docs(s.start), **self.body(s))

    def function(self, s, name: str, ret: str, rest: str, parent, mods: str, hidden: bool) -> None:
        composable = "@Composable" in mods
        self.add("function", name, s.start, s.close if s.open is not None else s.end, parent=parent, type=ret, value=params_of(rest, name), is_async="suspend" in mods, is_static="static" in mods, hidden=hidden, comment=self.docs(s.start), **self.body(s))
        if composable and parent is None:
            self.add("class", name, s.start, s.close, type="widget", extends_class="Composable", mixins=[], implements=[], is_abstract=False)
        self.calls(s.open + 1 if s.open is not None else s.start + len(rest), s.close, parent, name)


class Script(Parser):
    by_line = True
    _MODS = r"(?:(?:export|default|declare|abstract|async|public|private|protected|readonly|static|override|get|set|@[\w.]+(?:\([^()]*\))?)\s+)*"

    def parse(self) -> list[dict]:
        for m in re.finditer(r"""(?:^|[;\n])\s*import\s+(?:type\s+)?(?:[^'"();]*?\bfrom\s*)?(['"])|\b(?:require|import)\s*\(\s*(['"])|(?:^|[;\n])\s*export\s+[^'"();=]*?\bfrom\s*(['"])""", self.src.masked):
            q = next(k for k in (1, 2, 3) if m[k])
            end = self.text.find(m[q], m.end())
            self.add("import", self.text[m.end() : end], m.end())
        self.walk(0, len(self.text), None)
        if self.path.lower().endswith((".tsx", ".jsx")):
            self.tags()
        return self.rows

    def walk(self, a: int, b: int, parent: str | None) -> None:
        for s in self.src.segments(a, b):
            self.segment(s, parent)

    def segment(self, s, parent: str | None) -> None:
        flat = _SPACES.sub(" ", s.header)
        mods = m[0] if (m := re.match(self._MODS, flat + " ")) else ""
        rest = flat[len(mods) :].strip()
        for x in re.finditer(r"@([\w.]+)", mods):
            self.add("annotation", x[1], s.start)
        # top-level names count as private unless exported, members by mark or keyword
        hidden = "export" not in mods if parent is None else None
        if re.match(r"(import|export)\b", flat) and not re.match(r"(class|function|const|let|var|interface|type|enum|async)\b", rest):
            return
        if m := re.match(rf"class\s+({_NAME})", rest):
            base, impl = re.search(r"\bextends\s+([\w.$<>, ]+?)(?=\s+implements\b|\Z)", rest), re.search(r"\bimplements\s+(.+)\Z", rest)
            kind = "widget" if base and bare(base[1]).endswith("Component") else "class"
            self.add("class", m[1], s.start, s.close, type=kind, extends_class=base and base[1].strip(), implements=listed(impl and impl[1]), mixins=[], is_abstract="abstract" in mods, hidden=hidden, comment=self.docs(s.start), **self.body(s))
            if s.open is not None:
                self.walk(s.open + 1, s.close, m[1])
        elif m := re.match(rf"interface\s+({_NAME})", rest):
            self.add("mixin", m[1], s.start, s.close, hidden=hidden)
        elif m := re.match(rf"type\s+({_NAME})[^=]*=\s*(.*)", rest):
            self.add("typedef", m[1], s.start, value=m[2], hidden=hidden)
        elif m := re.match(rf"(?:const\s+)?enum\s+({_NAME})", rest):
            self.add("enum", m[1], s.start, s.close, values=enum_values(self.src.masked[s.open + 1 : s.close]) if s.open is not None else [], hidden=hidden)
        elif m := re.match(rf"function\s*\*?\s*({_NAME})", rest):
            self.function(s, m[1], rest, parent, mods, hidden)
        elif m := re.match(rf"(?:const|let|var)\s+({_NAME})\s*(?::\s*(?P<type>[^=]+?))?\s*=\s*(?P<value>.*)\Z", rest):
            if re.match(r"(async\s*)?(\([^()]*\)|[\w$]+)\s*(:\s*[^=]+)?=>|(async\s+)?function\b", m["value"]):
                self.function(s, m[1], rest, parent, mods + ("async " if m["value"].startswith("async") else ""), hidden)
            else:
                self.add("variable", m[1], s.start, parent=parent, type=m["type"], value=m["value"], is_const=rest.startswith("const"), is_top_level=parent is None, hidden=hidden)
                self.calls(s.start, s.end, parent, None)
        elif parent and (m := re.match(rf"\*?\s*(#?{_NAME})\s*(?:<[^()]*>)?\s*\(", rest)) and s.open is not None and m[1] not in ("if", "for", "while", "switch", "catch"):
            if m[1] == "constructor":
                self.add("constructor", parent, s.start, s.close, parent=parent, value=params_of(rest, m[1]))
            self.function(s, m[1], rest, parent, mods, "private" in mods or None)
        elif parent and (m := re.match(rf"(#?{_NAME})\s*[?!]?\s*(?::\s*(?P<type>[^=]+?))?\s*(?:=\s*(?P<value>.*))?\Z", rest)):
            value = m["value"] or ""
            if re.match(r"(async\s*)?\([^()]*\)\s*(:\s*[^=]+)?=>", value):
                self.function(s, m[1], rest, parent, mods, "private" in mods or None)
            else:
                self.add("property", m[1], s.start, parent=parent, type=m["type"], value=value or None, hidden="private" in mods or None)
        elif s.open is None or not parent:
            self.calls(s.start, s.close, parent, None)

    def function(self, s, name: str, rest: str, parent, mods: str, hidden) -> None:
        ret = re.search(r"\)\s*:\s*([^={]+?)\s*(?:=>|\Z)", rest)
        self.add("function", name, s.start, s.close if s.open is not None else s.end, parent=parent, type=ret[1] if ret else "any", value=params_of(rest, name), is_async="async" in mods, is_static="static" in mods, hidden=hidden, comment=self.docs(s.start), **self.body(s))
        if parent is None and name[:1].isupper() and self.path.lower().endswith((".tsx", ".jsx")):
            self.add("class", name, s.start, s.close, type="widget", extends_class="React.FC", mixins=[], implements=[], is_abstract=False, hidden=hidden)
        self.calls(s.open + 1 if s.open is not None else s.start + len(name), s.close if s.open is not None else s.end, parent, name)

    _GENERIC_NAMES = ("string", "number", "boolean", "any", "unknown", "void", "never", "object", "T", "K", "V", "Promise", "Array", "Record", "Partial", "Map", "Set")

    def tags(self) -> None:
        """JSX elements as a tree; type arguments are not elements."""
        tags(self, re.compile(rf"<(/?)({_NAME}(?:\.{_NAME})*)((?:[^<>{{}}=]|=>|=\s*(?:\"[^\"]*\"|'[^']*'|\{{[^{{}}]*(?:\{{[^{{}}]*\}}[^{{}}]*)*\}}))*?)(/?)>"), skip=self._GENERIC_NAMES, not_after=re.compile(r"[\w$)\]]$"))


def tags(parser: Parser, pattern: re.Pattern, skip=(), not_after: re.Pattern | None = None) -> None:
    """Nested elements as widget rows: node, parent, root and depth by a stack of open elements."""
    stack: list[tuple[str, int]] = []
    count, root = 0, None
    for m in pattern.finditer(parser.src.masked):
        closing, name, alone = m[1], m[2], m[4]
        if name in skip or not_after is not None and not_after.search(parser.src.masked[max(0, m.start() - 1) : m.start()]):
            continue
        if closing:
            if any(n == name for n, _ in stack):
                while stack.pop()[0] != name:
                    pass
            continue
        parent = stack[-1][1] if stack else None
        root = count if parent is None else root
        attributes = dict(re.findall(r"([\w:.-]+)\s*=\s*[\"']([^\"']*)[\"']", parser.text[m.start(3) : m.end(3)]))
        parser.add("widget", name, m.start(), node_id=count, parent_id=parent, root_id=root, depth=len(stack), ord=count, value=attributes.get("android:text") or attributes.get("android:id") or attributes.get("id"))
        if not alone and name.lower() not in ("br", "hr", "img", "input", "link", "meta"):
            stack.append((name, count))
        count += 1


class Markup(Parser):
    """Manifests, resource files, layouts and HTML."""

    def __init__(self, path: str, text: str):
        super().__init__(path, text)
        self.src.masked = blanked(text, markup=True)

    def parse(self) -> list[dict]:
        t = self.src.masked
        if self.path.lower().endswith("androidmanifest.xml"):
            for m in re.finditer(r"<(activity|service|receiver|provider|application)\b[^>]*?android:name\s*=\s*\"([^\"]+)\"", t):
                self.add("class", m[2].rsplit(".", 1)[-1], m.start(), type=m[1], extends_class=m[1].capitalize(), mixins=[], implements=[], is_abstract=False)
            for m in re.finditer(r"<uses-permission[^>]*?android:name\s*=\s*\"([^\"]+)\"", t):
                self.add("import", m[1], m.start())
        elif "<resources" in t:
            for m in re.finditer(r"<(string|color|dimen|bool|integer|style|item)\b[^>]*?\bname\s*=\s*\"([^\"]+)\"[^>]*>([^<]*)", t):
                self.add("variable", m[2], m.start(), type=m[1], value=m[3].strip(), is_const=True, is_final=True, is_top_level=True)
        else:
            tags(self, re.compile(r"<(/?)([A-Za-z][\w.:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>"))
        return self.rows


class Gradle(Parser):
    def parse(self) -> list[dict]:
        for m in re.finditer(r"""^\s*(?:implementation|api|compileOnly|runtimeOnly|kapt|ksp|\w*[Tt]estImplementation|debugImplementation)\b[\s(]*(?:platform\()?(?:["']([^"']+)["']|(libs\.[\w.]+))""", self.text, re.M):
            self.add("import", m[1] or m[2], m.start(1) if m[1] else m.start(2))
        for m in re.finditer(r"""\b(compileSdk|minSdk|targetSdk|versionCode|versionName|applicationId|namespace)(?:Version)?\s*=?\s*["']?([\w.]+)["']?""", self.text):
            self.add("variable", m[1], m.start(), value=m[2], is_const=True, is_final=True, is_top_level=True)
        return self.rows


class Outline(Parser):
    """Headings, selectors, custom properties and keys of files that are not code."""

    def parse(self) -> list[dict]:
        at, fence, low = 0, False, self.path.lower()
        for line in self.text.split("\n"):
            t = line.strip()
            if low.endswith(".md"):
                if t.startswith(("```", "~~~")):
                    fence = not fence
                elif not fence and (m := re.match(r"(#{1,6})\s+(.+)", t)):
                    self.add("class", m[2].strip(), at, at, type=f"H{len(m[1])}")
            elif low.endswith((".css", ".scss")):
                if m := re.match(r"(--[\w-]+)\s*:\s*([^;]+);", t):
                    self.add("variable", m[1], at, type="css-var", value=m[2].strip(), is_const=True, is_final=True, is_top_level=True)
                elif m := re.match(r"([.#A-Za-z][^{]*)\{", t):
                    self.add("class", m[1].strip(), at, at, type="selector")
            elif low.endswith(".json") and (m := re.match(r"\s{1,4}\"([^\"]+)\"\s*:", line)):
                self.add("class", m[1], at, at, type="property")
            at += len(line) + 1
        return self.rows


BY_EXTENSION = {
    ".dart": Dart, ".kt": KotlinJava, ".java": KotlinJava, ".ts": Script, ".tsx": Script, ".js": Script, ".jsx": Script, ".mjs": Script, ".cjs": Script,
    ".xml": Markup, ".html": Markup, ".gradle": Gradle, ".kts": Gradle, ".md": Outline, ".css": Outline, ".scss": Outline, ".json": Outline,
}


def parse(path: str, text: str) -> list[dict]:
    """Rows of a file by its extension; none for unknown ones."""
    low = path.lower()
    for ext, parser in BY_EXTENSION.items():
        if low.endswith(ext):
            return parser(path, text or "").parse()
    return []
