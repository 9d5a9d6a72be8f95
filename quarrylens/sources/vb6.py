"""VB6 source text as tables.

``extract`` turns files into entity rows in one pass of Python, the only one: a
scanner, a splitter into statements, and readers of single statements. Errors of
a file become its diagnostics and never fail the job. ``entity`` gives the typed
table of one kind.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = (".bas", ".cls", ".frm", ".ctl", ".vbp")

# The language's words and the shapes that readers know.
KEYWORDS = frozenset(
    "alias and any as base binary boolean byref byte byval call case cbyte ccur cdbl cdate cdec cint clng cobj csng cstr cvar currency date decimal declare defbool defbyte defcur defdate defdec defdbl defint deflng defobj defsng defstr defvar dim do double each else elseif empty end enum eqv erase error event exit explicit false for friend function get global goto if imp implements in input integer is let like long loop me mid mod module new next not nothing null object on open option optional or output paramarray preserve print private property public put raiseevent random read redim resume return rset seek select set single static step stop string sub then to true type typeof unload until variant wend while with write xor attribute".split()
)
BUILTINS = frozenset(
    "abs asc atn cbool cbyte ccur cdate cdbl chr cint clng csng cstr cvar cvdate cverr cvlng date dateadd datediff datepart dateserial datevalue day ddb dir doevents environ error exp filelen fix format freecounter fv hex hour iif inputbox instr int irr isarray isdate isempty iserror ismissing isnull isnumeric isobject join lbound lcase left len log ltrim mid minute mirr month msgbox monthname now nper npv oct partition pmt pv qbcolor qcet qqcolor rate replace rgb right rnd round rtrim second sgn shell sin sln space spc split sqr str strcomp strconv string strreverse switch syd tab tan time timer timeserial timevalue trim typename ubound ucase val vartype weekday year".split()
)
NOT_CALLED = frozenset("if elseif else for each next while wend do loop select case set let const dim redim erase print debug end exit on goto resume error declare implements type enum with open close call option attribute".split())
MODIFIERS = frozenset("public private friend static global".split())
HEADS = MODIFIERS | {"sub", "function", "property", "declare"}
STATE_HINTS = ("estado", "state", "rastro", "situacao", "status", "resultado", "fase")
SQL_HEAD = re.compile(r"(?i)^\s*(select|insert\s+into|update|delete\s+from|merge|create\s+(table|view|or\s+replace)|alter\s+table|drop\s+table|truncate|execute|exec|call|\{call)\b")
SQL_CALL = re.compile(r"(?i)^\s*\{?\s*call\b")
SQL_TAIL = re.compile(r"(?i)\b(from|into|set|values|where|join|group\s+by|order\s+by)\b")
OUT_NAME = re.compile(r"^P_[A-Z0-9_]+$")
#: Changes when the reader gives other entities of the same text.
PARSER_VERSION = "own-3"
SET = re.compile(r"(?i)\s*set\s+(?:me\s*\.\s*)?(\w+)\s*=\s*(new\s+)?(?:me\s*\.\s*)?([\w.]+)\s*\Z")
STATE_ASSIGN = re.compile(r'^\s*([A-Za-z_][\w.$]*)\s*=\s*"([A-Z][A-Z0-9_]*)"\s*$')
STATE_SETTER = re.compile(r'^\s*(?:call\s+)?([A-Za-z_][\w.$]*)\s+([A-Za-z_][\w.$]*)\s*,\s*"([A-Z][A-Z0-9_]*)"\s*$')
STATE_CALL = re.compile(r'^\s*(?:call\s+)?[A-Za-z_][\w.$]*\s*\(\s*([A-Za-z_][\w.$]*)?\s*,\s*(?:(?:adVar|Types\.)?\w+\s*,\s*)?"([A-Z][A-Z0-9_]*)"')
STATE_VALUE = re.compile(r"[A-Z][A-Z0-9_]{2,}")
STATE_COLUMN = re.compile(r"(?i)\b(ESTADO|STATE|SITUACAO|SITUAÇÃO|STATUS|ESTADO_RASTRO)\b")
NO_STATE = frozenset(
    "SELECT INSERT UPDATE DELETE FROM WHERE VALUES CREATE ALTER DROP TABLE ORDER GROUP JOIN INNER OUTER LEFT RIGHT FULL CROSS RETURNING CURRENT_TIMESTAMP CURRENT_DATE AND OR NOT NULL TRUE FALSE REJECTED APPROVED UNKNOWN".split()
)

SCAN = re.compile(
    r"""(?P<CONTINUATION>[ \t]+_[ \t]*\r?\n)|(?P<NEWLINE>\r?\n)|(?P<SPACE>[ \t\f\v]+)|(?P<COMMENT>'[^\r\n]*)|(?P<STRING>"(?:[^"\r\n]|"")*")|(?P<OPEN>"[^\r\n]*)"""
    r"""|(?P<DATE>\#[^#\r\n]+\#)|(?P<NUMBER>&[HhOo][0-9A-Fa-f]+&?|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?[%&!\#@]?)|(?P<WORD>[^\W\d]\w*[$%!\#@]?)|(?P<OPERATOR><=|>=|<>|<<|>>|:=|[+\-*/\\^=<>&])|(?P<PUNCTUATION>.)"""
)


class Token(NamedTuple):
    kind: str
    value: str
    line: int
    col: int
    offset: int


class LexError(ValueError):
    """Text that is no VB6."""


def tokenize(source: str) -> list[Token]:
    """Tokens with line and column from 1; continued lines run on, whole Rem and Attribute lines are one token."""
    out: list[Token] = []
    line, begin, n = 1, 0, len(source)
    fresh, keywords, make = True, KEYWORDS, Token._make  # fresh: at the start of a statement
    found = SCAN.finditer(source)
    while m := next(found, None):
        kind = m.lastgroup
        if kind == "SPACE":
            continue
        value, at = m[0], m.start()
        col = at - begin + 1
        if kind == "WORD":
            low = value.lower()
            if fresh and low in ("rem", "attribute"):
                stop = source.find("\n", at)
                stop = n if stop < 0 else stop
                value = source[at:stop].rstrip("\r")
                kind = "COMMENT" if low == "rem" else "ATTRIBUTE"
                found = SCAN.finditer(source, at + len(value))
            else:
                kind = "KEYWORD" if low in keywords else "IDENTIFIER"
        elif kind == "NEWLINE" or kind == "CONTINUATION":
            if kind == "NEWLINE":
                out.append(make((kind, value, line, col, at)))
                fresh = True
            line, begin = line + 1, at + len(value)
            continue
        elif kind == "OPEN":
            raise LexError(f"string without end in line {line}")
        out.append(make((kind, value, line, col, at)))
        fresh = fresh and kind == "NUMBER"
    return out


class Statement(NamedTuple):
    line: int
    end_line: int
    text: str
    tokens: list[Token]


def split_statements(source: str, tokens: list[Token]) -> list[Statement]:
    """Tokens between line ends, comments left out, with their exact text."""
    out, held = [], []
    for t in [*tokens, Token("NEWLINE", "", 0, 0, len(source))]:
        if t.kind == "NEWLINE":
            if held:
                last = held[-1]
                out.append(Statement(held[0].line, last.line, source[held[0].offset : last.offset + len(last.value)], held))
            held = []
        elif t.kind != "COMMENT":
            held.append(t)
    return out


def _unquote(s: str) -> str:
    return s[1:-1].replace('""', '"')


def _low(t: Token | None) -> str:
    return t.value.lower() if t else ""


def _split_args(tokens: list[Token]) -> list[str]:
    """Argument texts, split at commas outside of parentheses."""
    out, depth, held = [], 0, []
    for t in tokens:
        depth += (t.value == "(") - (t.value == ")")
        if t.value == "," and depth == 0:
            out.append("".join(held))
            held = []
        else:
            held.append((" " if held and t.kind in ("IDENTIFIER", "KEYWORD", "OPERATOR", "STRING", "NUMBER") and held[-1] not in ("(", ".") else "") + t.value)
    if held or out:
        out.append("".join(held))
    return [x.strip() for x in out]


def _closing(tokens: list[Token], at: int) -> int:
    depth = 0
    for i in range(at, len(tokens)):
        depth += (tokens[i].value == "(") - (tokens[i].value == ")")
        if depth == 0:
            return i
    return len(tokens)


def parameters(tokens: list[Token]) -> list[dict]:
    out, groups, depth = [], [[]], 0
    for t in tokens:
        depth += (t.value == "(") - (t.value == ")")
        if t.value == "," and depth == 0:
            groups.append([])
        else:
            groups[-1].append(t)
    for g in groups:
        low = [_low(t) for t in g]
        names = [t for t in g if t.kind == "IDENTIFIER"]
        if not names:
            continue
        kind = g[low.index("as") + 1].value if "as" in low[:-1] else None
        name = names[0].value
        direction = "OUT" if kind and OUT_NAME.match(name) else "IN"
        out.append({"name": name, "type_name": kind, "direction": direction, "by_ref": "byval" not in low, "optional": "optional" in low, "type_confidence": "OK" if kind else "UNKNOWN"})
    return out


def header(tokens: list[Token]) -> dict | None:
    """Name, kind, visibility, parameters and return type, if the statement begins a procedure."""
    at, visible = 0, "public"
    if _low(tokens[0]) not in HEADS:
        return None
    while at < len(tokens) and _low(tokens[at]) in MODIFIERS:
        visible = "private" if _low(tokens[at]) == "private" else visible
        at += 1
    if at >= len(tokens) or _low(tokens[at]) not in ("sub", "function", "property", "declare"):
        return None
    kind, declared = _low(tokens[at]), False
    at += 1
    if kind == "declare":
        declared = True
        kind = _low(tokens[at]) if at < len(tokens) else "sub"
        at += 1
    accessor = ""
    if kind == "property" and at < len(tokens):
        accessor = _low(tokens[at])
        at += 1
    if at >= len(tokens):
        return None
    name = tokens[at].value
    at = next((i for i in range(at + 1, len(tokens)) if tokens[i].value == "("), len(tokens))
    stop = _closing(tokens, at)
    tail = [_low(t) for t in tokens[stop + 1 :]]
    returns = tokens[stop + 1 + tail.index("as") + 1].value if "as" in tail[:-1] else None
    handler = kind == "sub" and "_" in name and not declared
    return {"name": name, "kind": f"property_{accessor}" if accessor else kind, "visibility": visible, "parameters": parameters(tokens[at + 1 : stop]), "return_type": returns, "declared": declared, "is_event_handler": handler, "event_name": name.rsplit("_", 1)[1] if handler else None}


def calls(s: Statement) -> list[dict]:
    """Calls in a statement: with a receiver DYNAMIC, else STATIC; of the language or created by New EXTERNAL."""
    ts, out, seen = s.tokens, [], set()
    for i, t in enumerate(ts):
        if t.kind not in ("IDENTIFIER", "KEYWORD") or t.value.lower() in NOT_CALLED:
            continue
        nxt, prev = ts[i + 1] if i + 1 < len(ts) else None, ts[i - 1] if i else None
        member = prev is not None and prev.value == "."
        if t.kind == "KEYWORD" and not (nxt and nxt.value == "(" and t.value.lower() in BUILTINS):
            continue
        receiver, head = None, i
        if member and i >= 2:
            head = i - 2
            while head >= 2 and ts[head - 1].value == "." and ts[head].kind in ("IDENTIFIER", "KEYWORD"):
                head -= 2
            receiver = "".join(x.value for x in ts[head : i - 1])
        first = head == 0 or head == 1 and _low(ts[0]) == "call" or _low(ts[head - 1]) in ("then", "else")
        made = prev is not None and _low(prev) == "new"
        if nxt is not None and nxt.value == "(" and nxt.offset == t.offset + len(t.value) or made or _low(ts[0]) == "call" and first and nxt is not None and nxt.value == "(":
            stop = _closing(ts, i + 1) if nxt is not None and nxt.value == "(" else i + 1
            args = _split_args(ts[i + 2 : stop]) if nxt is not None and nxt.value == "(" else []
        elif first and (nxt is None or nxt.kind in ("IDENTIFIER", "STRING", "NUMBER", "KEYWORD") or nxt.value in ("(", "-")):
            if any(x.value == "=" for x in ts[i + 1 : i + 2]) or nxt is not None and _low(nxt) in ("as", "then", "to"):
                continue
            args = _split_args(ts[i + 1 :])
        else:
            continue
        if (t.value.lower(), (receiver or "").lower()) in seen or _low(ts[0]) in ("dim", "private", "public", "const", "redim", "global", "static") and not made:
            continue
        seen.add((t.value.lower(), (receiver or "").lower()))
        kind = "EXTERNAL" if made or receiver is None and t.value.lower() in BUILTINS else "DYNAMIC" if receiver else "STATIC"
        out.append({"callee": t.value, "receiver": receiver, "kind": kind, "line": t.line, "arguments": args, "expression": s.text.strip()})
    return out


def sql_string(s: Statement) -> dict | None:
    """The statement's string literals as one SQL text; what stands between them becomes a ?."""
    lits = [t for t in s.tokens if t.kind == "STRING"]
    if not lits:
        return None
    values = [_unquote(t.value) for t in lits]
    joined = "".join(values)
    if not (SQL_HEAD.match(joined) or len(joined) > 12 and SQL_TAIL.search(joined)):
        return None
    first, last = s.tokens.index(lits[0]), len(s.tokens) - 1 - s.tokens[::-1].index(lits[-1])
    parts, gap, depth = [], False, 0
    for t in s.tokens[first:]:
        depth += (t.value == "(") - (t.value == ")")
        if depth < 0:
            break
        if t.kind == "STRING" and depth == 0:
            parts += ["?"] * gap + [_unquote(t.value)]
            gap = False
        elif t.value not in ("&", "+") and depth >= 0:
            if s.tokens.index(t) > last and t.value == ",":
                break
            gap = True
    text = "".join(parts) + "?" * gap
    text = re.sub(r"'\?'", "?", text)
    if SQL_CALL.match(joined):
        text = joined
    states = [v.strip().upper() for v in values if _is_state(v.strip().upper())]
    return {"text": text, "raw": s.text.strip(), "is_dynamic": len(lits) > 1 or any(t.value == "&" for t in s.tokens), "line": s.line, "state_tokens": states, "mentions_state_column": bool(STATE_COLUMN.search(s.text))}


def _is_state(value: str) -> bool:
    return STATE_VALUE.fullmatch(value) is not None and value not in NO_STATE


def state_domain(name: str) -> str:
    low = name.lower()
    return "GRUPO" if "grupo" in low else "CONSISTENCIA" if "consistencia" in low else "UNKNOWN"


def _names_state(name: str | None) -> bool:
    return any(h in (name or "").lower() for h in STATE_HINTS)


def state_write(s: Statement) -> dict | None:
    """A literal in capitals that is assigned to a state, or passed to a setter or with an argument that names one."""
    if '"' not in s.text:
        return None
    leaf = lambda x: (x or "").rsplit(".", 1)[-1]
    found = []
    if m := STATE_ASSIGN.match(s.text):
        found.append(("assignment", m[1], m[2], _names_state(leaf(m[1]))))
    if m := STATE_SETTER.match(s.text):
        found.append(("setter", leaf(m[1]), m[3], _names_state(leaf(m[1])) or _names_state(m[2])))
    if m := STATE_CALL.match(s.text):
        found.append(("inline_call", leaf(m[1]), m[2], _names_state(leaf(m[1]))))
    for shape, target, value, named in found:
        if named and _is_state(value):
            return {"target": target, "value": value, "line": s.line, "shape": shape}
    return None


def assignment(s: Statement) -> dict | None:
    """Set x = New T, or Set x = y: the target, and the type or variable that it is given."""
    m = SET.match(s.text)
    return m and {"target": m[1], "type_name": m[3] if m[2] else None, "source": None if m[2] else m[3], "line": s.line}


def attention(s: Statement) -> list[str]:
    low = " ".join(s.text.lower().split())
    found = {"on error resume next": "resume-next", "on error goto": "error-goto", "err.": "err-object", "doevents": "do-events", "createobject(": "late-binding"}
    out = [name for shape, name in found.items() if shape in low]
    return out + ["goto"] * (low.startswith("goto ") or " then goto " in low)


def read_file(file: str, source: str, tokens: list[Token] | None = None, only: frozenset[str] | None = None) -> Iterator[tuple[str, dict]]:
    """(entity, fields) of one source file; ``tokens`` are the scanner's, if they are known.

    With ``only`` the entities of these kinds; what they do not need is not looked for.
    """
    if only is not None:
        yield from ((entity, row) for entity, row in _read(file, source, tokens, only) if entity in only)
    else:
        yield from _read(file, source, tokens, frozenset(SCHEMAS))


def _read(file: str, source: str, tokens: list[Token] | None, wanted: frozenset[str]) -> Iterator[tuple[str, dict]]:
    # a component lists what its variables and notes name
    noted, declared = not wanted.isdisjoint(("attention", "component")), not wanted.isdisjoint(("variable", "component"))
    called, given_, written, told = ("call" in wanted, "assignment" in wanted, "state_write" in wanted, "sql" in wanted)
    stem = re.split(r"[\\/]", file)[-1]
    base, _, ext = stem.rpartition(".")
    if ext.lower() == "vbp":
        yield from read_project(file, base, source)
        return
    statements = split_statements(source, tokenize(source) if tokens is None else tokens)
    name, attributes, current, body = base, {}, None, []
    handlers, variables, notes, refs, option = [], 0, set(), set(), None
    rows: list[tuple[str, dict]] = []
    for s in statements:
        first = _low(s.tokens[0])
        if s.tokens[0].kind == "ATTRIBUTE":
            m = re.match(r'(?i)attribute\s+([\w.]+)\s*=\s*"?([^"]*)"?', s.text)
            if m:
                attributes[m[1]] = m[2]
                name = m[2] if m[1].lower() == "vb_name" else name
            continue
        if first == "begin" and len(s.tokens) >= 4:
            kind = "".join(t.value for t in s.tokens[1:-1])
            rows.append(("control", {"kind": kind, "name": s.tokens[-1].value, "line": s.line}))
            continue
        if s.text.lower().startswith("option explicit"):
            option = True
        h = header(s.tokens)
        if h and current is None:
            current, body = h | {"line": s.line, "end_line": None}, [s.text]
            if h["declared"]:
                current["end_line"] = s.line
                rows.append(("procedure", current | {"body": s.text}))
                current = None
            continue
        where = current["name"] if current else None
        if first == "end" and len(s.tokens) > 1 and _low(s.tokens[1]) in ("sub", "function", "property") and current:
            current["end_line"] = s.line
            rows.append(("procedure", current | {"body": "\n".join([*body, s.text])}))
            current = None
            continue
        if current:
            body.append(s.text)
        for a in attention(s) if noted else ():
            notes.add(a)
            rows.append(("attention", {"procedure": where, "note": a, "line": s.line}))
        if declared and first in ("dim", "private", "public", "const", "global", "static") and not h:
            for p in parameters([t for t in s.tokens[1:] if _low(t) not in ("const", "withevents", "new")]):
                variables += 1
                scope = "local" if current else "global" if first in ("public", "global") else "module"
                rows.append(("variable", {"procedure": where, "name": p["name"], "type_name": p["type_name"], "scope": scope, "line": s.line}))
                if p["type_name"] and p["type_name"].lower() not in KEYWORDS:
                    refs.add(p["type_name"])
        if first == "load" and len(s.tokens) > 1:
            refs.add(s.tokens[1].value)
        if current:
            for c in calls(s) if called else ():
                rows.append(("call", c | {"procedure": where}))
            if given_ and first == "set" and (given := assignment(s)):
                rows.append(("assignment", given | {"procedure": where}))
            w = state_write(s) if written else None
            if w:
                rows.append(("state_write", w | {"procedure": where, "domain": state_domain(f"{w['target']} {where}")}))
            q = sql_string(s) if told else None
            if q:
                rows.append(("sql", q | {"procedure": where, "domain": state_domain(f"{q['raw']} {where}")}))
    status = "OK"
    if current:
        status = "PARTIAL"
        rows.append(("procedure", current | {"body": "\n".join(body), "end_line": None}))
    kind = {"bas": "MODULE", "cls": "CLASS", "frm": "FORM", "ctl": "CONTROL"}.get(ext.lower(), "UNKNOWN")
    yield "component", {"name": name, "kind": kind, "status": status, "option_explicit": option, "depends_on": sorted(refs), "attention_points": sorted(notes), "attributes": attributes}
    for entity, row in rows:
        yield entity, row | {"component": name}
    if kind == "FORM":
        yield "entry_point", {"name": name, "kind": "FORM", "component": name, "procedure": None, "line": 1}
    for entity, p in rows:
        if entity == "procedure" and not p["declared"]:
            if p["is_event_handler"]:
                yield "entry_point", {"name": f"{name}.{p['name']}", "kind": "EVENT_HANDLER", "component": name, "procedure": p["name"], "line": p["line"]}
            elif p["visibility"] == "public":
                yield "entry_point", {"name": f"{name}.{p['name']}", "kind": "COMMAND", "component": name, "procedure": p["name"], "line": p["line"]}


def read_project(file: str, base: str, source: str) -> Iterator[tuple[str, dict]]:
    """Declared components of a project file: Form=file, Module=name; file and so on."""
    kinds = {"form": "FORM", "module": "MODULE", "class": "CLASS", "usercontrol": "CONTROL"}
    for i, line in enumerate(source.splitlines(), 1):
        key, eq, value = line.partition("=")
        kind = kinds.get(key.strip().lower())
        if not eq or not kind:
            continue
        name, _, path = value.strip().strip('"').partition(";")
        path = (path or name).strip()
        stem = re.split(r"[\\/]", path)[-1]
        yield "declaration", {"component": name.strip() if ";" in value else stem, "kind": kind, "stem": stem.rsplit(".", 1)[0], "line": i}
        if kind == "FORM":
            yield "entry_point", {"name": stem.rsplit(".", 1)[0], "kind": "FORM", "component": stem.rsplit(".", 1)[0], "procedure": None, "line": i}


#: Rows of entities that a task holds before it passes them on, about.
BLOCK = 20_000
SCHEMAS = {
    "file": "sha256 string, line_count int, status string, diagnostics array<string>",
    "component": "name string, kind string, status string, option_explicit boolean, depends_on array<string>, attention_points array<string>, attributes map<string,string>",
    "procedure": "component string, name string, kind string, visibility string, parameters array<struct<name:string,type_name:string,direction:string,by_ref:boolean,optional:boolean,type_confidence:string>>, return_type string, declared boolean, is_event_handler boolean, event_name string, line int, end_line int, body string",
    "variable": "component string, procedure string, name string, type_name string, scope string, line int",
    "call": "component string, procedure string, callee string, receiver string, kind string, line int, arguments array<string>, expression string",
    "sql": "component string, procedure string, text string, raw string, is_dynamic boolean, line int, state_tokens array<string>, mentions_state_column boolean, domain string",
    "state_write": "component string, procedure string, target string, value string, line int, shape string, domain string",
    "assignment": "component string, procedure string, target string, type_name string, source string, line int",
    "control": "component string, name string, kind string, line int",
    "attention": "component string, procedure string, note string, line int",
    "entry_point": "name string, kind string, component string, procedure string, line int",
    "declaration": "component string, kind string, stem string, line int",
    "token": "kind string, value string, line int, col int, offset int",
    "statement": "line int, end_line int, text string",
}


def decode(raw: bytes) -> str:
    """UTF-8, else Windows-1252, else Latin-1."""
    for name in ("utf-8", "cp1252"):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1")


def read_sources(spark: SparkSession, root: str) -> DataFrame:
    """(file, content) of all source files below a folder, by suffix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    suffix = F.lower(F.regexp_extract("path", r"([.][^./\\]+)$", 1))
    return files.where(suffix.isin(*EXTENSIONS)).select(F.col("path").alias("file"), "content")


def extract(sources: DataFrame, tokens: bool = False, only: tuple[str, ...] | None = None) -> DataFrame:
    """(file, entity, seq, payload) of (file, content: binary or text), payload as JSON; with ``tokens`` the scanner's rows too.

    With ``only`` the entities of these kinds, in the same order, and "file" if it is among them; the readers of others do not run.
    """
    kinds = None if only is None else frozenset(only)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, dumps = ["file", "entity", "seq", "payload"], json.dumps
        for pdf in batches:
            out = []
            for file, content in zip(pdf["file"], pdf["content"]):
                raw, text = _texts(content)
                rows, status, notes = [], "OK", []
                try:
                    ts = None if file.lower().endswith(".vbp") else tokenize(text)
                    rows = list(read_file(file, text, ts, kinds))
                    if tokens and ts is not None:
                        rows += [("token", t._asdict()) for t in ts]
                        rows += [("statement", {"line": s.line, "end_line": s.end_line, "text": s.text}) for s in split_statements(text, ts)]
                except Exception as e:  # noqa: BLE001 - a broken file is a finding
                    rows, status, notes = [], "FAILED", [f"{type(e).__name__}: {e}"]
                if kinds is None or "file" in kinds:
                    rows.insert(0, ("file", {"sha256": hashlib.sha256(raw).hexdigest(), "line_count": text.count("\n") + bool(text and not text.endswith("\n")), "status": status, "diagnostics": notes}))
                out += [(file, entity, i, dumps(x)) for i, (entity, x) in enumerate(rows)]
                if len(out) >= BLOCK:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            yield pd.DataFrame(out, columns=columns)

    return sources.select("file", "content").mapInPandas(run, "file string, entity string, seq int, payload string")


def _texts(content: bytes | str) -> tuple[bytes, str]:
    raw = bytes(content) if not isinstance(content, str) else content.encode()
    return raw, decode(raw)


def scanned(sources: DataFrame, kind: str) -> DataFrame:
    """The typed table of the scanner's tokens or statements ("token", "statement") of (file, content), with file.

    The rows of entity(extract(sources, True), kind), without JSON, and without the
    readers: what these refuse has tokens here all the same.
    """
    names = [x.split()[0] for x in SCHEMAS[kind].split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            files, out = [], []
            for file, content in zip(pdf["file"], pdf["content"]):
                if file.lower().endswith(".vbp"):
                    continue
                text = _texts(content)[1]
                try:
                    ts = tokenize(text)
                    rows = ts if kind == "token" else [s[:3] for s in split_statements(text, ts)]
                except Exception:  # noqa: BLE001 - extract() tells of it
                    continue
                out += rows
                files += [file] * len(rows)
                if len(out) >= BLOCK:
                    yield _columns(files, out, names)
                    files, out = [], []
            if out:
                yield _columns(files, out, names)

    return sources.select("file", "content").mapInPandas(run, f"file string, {SCHEMAS[kind]}")


def _columns(files: list[str], rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({"file": files} | dict(zip(names, zip(*rows))))


def entity(extracted: DataFrame, kind: str) -> DataFrame:
    """The typed table of one kind of entity, with file and seq."""
    rows = extracted.where(F.col("entity") == kind).select("file", "seq", F.from_json("payload", SCHEMAS[kind]).alias("x"))
    return rows.select("file", "seq", "x.*")
