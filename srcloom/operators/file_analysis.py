"""One file at a time in plain Python: the scored symbols and the segments that ``symbols`` and ``segments`` describe.

An expression over arrays is interpreted for every line, brace and match of a file; here a file costs a few passes of
compiled patterns over its text. The patterns are those of ``symbols``: ``\\w`` and ``\\s`` of Python are the classes that
they spell out. Files come in Arrow batches, and nested rows are put together from flat lists.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import cloudpickle

from srcloom.functions.text import BRANCHES, MAX_COMPLEXITY, ML, OPEN_BLOCK_LINES, SPACE, WORD

# workers get the code itself, whatever is on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ANALYSIS = "struct<symbols:array<{symbol}>,imports:array<string>,global_vars:array<string>,total_lines:int>"
_TEXTS = pa.list_(pa.string())
_SAME_LINE = r"[^\n\r\x85\u2028\u2029]"


def compiled(pattern: str) -> re.Pattern:
    """A pattern of the engine for Python; ``(?md)`` and ``(?m)`` agree, for lines end at ``\\n`` only."""
    return re.compile(pattern.replace(SPACE, r"\s").replace(WORD, r"\w").replace(ML, "(?m)"))


_WORDS = [b for b in BRANCHES.split("|") if b.isalpha()]
#: Braces, line ends, the signs that branch and the words that do. That a word begins nowhere within another is asked
#: after it: so each way begins with a character of its own, and the others are skipped.
_TOKENS = re.compile(r"[{}\n]|&&|\|\||(?:" + "|".join(rf"{w}(?<!\w{w})" for w in _WORDS) + r")(?!\w)").findall


class Index:
    """Lines of the braces and branches of a file, and where blocks end."""

    def __init__(self, content: str):
        self.brace_lines: list[int] = []
        self.branch_lines: list[int] = []
        opens: list[bool] = []
        line = 1
        for token in _TOKENS(content):
            if token == "\n":
                line += 1
            elif token == "{" or token == "}":
                self.brace_lines.append(line)
                opens.append(token == "{")
            else:
                self.branch_lines.append(line)
        self.n_lines = line
        # from the last brace: the next closing brace of each depth
        depth = 2 * sum(opens) - len(opens)
        at_depth: dict[int, int] = {}
        self.closes: list[int | None] = [None] * len(opens)
        for i in range(len(opens) - 1, -1, -1):
            if opens[i]:
                depth -= 1
                self.closes[i] = at_depth.get(depth)
            else:
                self.closes[i] = at_depth.get(depth + 1)
                at_depth[depth] = self.brace_lines[i]
                depth += 1

    def block_end(self, start: int) -> int:
        first = bisect_left(self.brace_lines, start)
        end = self.closes[first] if first < len(self.closes) else None
        return min(start + OPEN_BLOCK_LINES - 1, self.n_lines) if end is None else end

    def complexity(self, start: int, end: int) -> int:
        hits = bisect_right(self.branch_lines, end) - bisect_left(self.branch_lines, start)
        return min(MAX_COMPLEXITY, max(hits, 0) + 1)


def class_heads(pattern: re.Pattern, content: str) -> Iterator[re.Match]:
    """The matches of a pattern of white space, ``public``, ``abstract`` and the like before ``class``, from left to right.

    They are looked for around the word only; elsewhere the pattern would be tried at all white space."""
    at = 0
    while (word := content.find("class", at)) >= 0:
        before = content[at:word].rstrip()
        for kinds in (("abstract", "final"), ("public", "private", "protected")):
            for kind in kinds:
                if before.endswith(kind):
                    before = before[: -len(kind)].rstrip()
                    break
        m = next((m for i in range(at + len(before), word + 1) if (m := pattern.match(content, i))), None)
        if m:
            yield m
        at = m.end() if m else word + 1


def placed(pattern: re.Pattern, content: str, found: Callable[[re.Pattern, str], Iterator[re.Match]] = re.Pattern.finditer) -> Iterator[tuple[re.Match, int]]:
    """Every match with the line it begins in."""
    line, at = 1, 0
    for m in found(pattern, content):
        line += content.count("\n", at, m.start())
        at = m.start()
        yield m, line


def split_list(text: str) -> list[str]:
    return [p for p in map(str.strip, text.split(",")) if p]


class Analyser:
    """The analysis of ``symbols.analyse_corpus`` with scores."""

    def __init__(self, patterns: dict[str, str], headings: tuple[str, ...], fillers: tuple[str, ...], drop: str | None):
        self.find = {n: compiled(p) for n, p in patterns.items()}
        self.heading = re.compile("|".join(headings), re.I | re.A).search
        self.end_verb = re.compile(drop, re.A).search if drop else lambda name: None
        self.filler = re.compile("|".join(fillers), re.I | re.A).fullmatch
        self.languages = {"c": self.cpp, "cpp": self.cpp, "cobol": self.cobol, "java": self.java, "rust": self.rust}

    def blocks(self, idx: Index, content: str, pattern: str, kind: str | None, name: int, params: int = 0, returns: int = 0, parents: bool = False, scored: bool = True) -> list[tuple]:
        made = []
        for m, start in placed(self.find[pattern], content, class_heads if pattern == "JAVA_CLASS" else re.Pattern.finditer):
            end = idx.block_end(start)
            made.append((
                m[name] or "", kind or ("struct" if "struct" in m[0] else "class"), start, end,
                split_list(m[params] or "") if params else [], (m[returns] or "").strip() if returns else "",
                self.parents(m) if parents else [], idx.complexity(start, end) if scored else 1,
            ))
        return made

    @staticmethod
    def parents(m: re.Match) -> list[str]:
        return ([m[2]] if m[2] else []) + ([f.strip() for f in m[3].split(",")] if m[3] else [])

    def cpp(self, content: str, idx: Index) -> tuple[list, list, list]:
        functions = self.blocks(idx, content, "CPP_FUNCTION", "function", 2, params=3, returns=1)
        symbols = functions + self.blocks(idx, content, "CPP_RECORD", None, 1) + self.blocks(idx, content, "CPP_ENUM", "enum", 1, scored=False)
        starts, ends = [f[2] for f in functions], list(accumulate((f[3] for f in functions), max))
        variables = []
        for m, line in placed(self.find["CPP_GLOBAL"], content):
            above = bisect_right(starts, line)
            if not above or ends[above - 1] < line:
                variables.append(m[2])
        return symbols, self.find["CPP_INCLUDE"].findall(content), variables

    def cobol(self, content: str, idx: Index) -> tuple[list, list, list]:
        hits = [(m[1], line) for m, line in placed(self.find["COBOL_PARAGRAPH"], content)]
        ends = [line - 1 for _, line in hits[1:]] + [idx.n_lines]
        symbols = [
            (name, "function", start, end, [], "", [], idx.complexity(start, end)) for (name, start), end in zip(hits, ends)
            if not self.heading(name) and not self.end_verb(name)
        ]
        imports = [f"{d} DIVISION" for d in self.find["COBOL_DIVISION"].findall(content)] + [f"COPY {c}" for c in self.find["COBOL_COPY"].findall(content)]
        return symbols, imports, [v for v in self.find["COBOL_VARIABLE"].findall(content) if not self.filler(v)]

    def java(self, content: str, idx: Index) -> tuple[list, list, list]:
        symbols = self.blocks(idx, content, "JAVA_CLASS", "class", 1, parents=True) + self.blocks(idx, content, "JAVA_METHOD", "function", 2, params=3, returns=1)
        package = self.find["JAVA_PACKAGE"].search(content)
        return symbols, ([f"package:{package[1]}"] if package else []) + self.find["JAVA_IMPORT"].findall(content), []

    def rust(self, content: str, idx: Index) -> tuple[list, list, list]:
        symbols = self.blocks(idx, content, "RUST_FUNCTION", "function", 1, params=2, returns=3) + self.blocks(idx, content, "RUST_STRUCT", "struct", 1, scored=False)
        return symbols, [u.strip() for u in self.find["RUST_USE"].findall(content)], []

    def __call__(self, language: str | None, content: str | None) -> tuple[list | None, list | None, list | None, int | None]:
        of = self.languages.get(language)
        if content is None:
            return (None, None, None if language in ("c", "cpp", "cobol") else [], None) if of else ([], [], [], None)
        if not of:
            return [], [], [], content.count("\n") + 1
        idx = Index(content)
        return (*of(content, idx), idx.n_lines)


def _lists(rows: list[list | None], of: Callable[[list], pa.Array]) -> pa.ListArray:
    """Lists from their elements in a row; a missing list is null."""
    offsets: list[int | None] = []
    flat: list = []
    for row in rows:
        offsets.append(None if row is None else len(flat))
        flat += row or ()
    return pa.ListArray.from_arrays(pa.array([*offsets, len(flat)], pa.int32()), of(flat))


def _texts(flat: list) -> pa.Array:
    return pa.array(flat, pa.string())


def _structs(flat: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.StructArray:
    columns = list(zip(*flat)) if flat else [()] * len(fields)
    made = [_lists(c, _texts) if t == _TEXTS else pa.array(c, t) for c, (_, t) in zip(columns, fields)]
    return pa.StructArray.from_arrays(made, names=[n for n, _ in fields])


_SYMBOL = [
    ("name", pa.string()), ("kind", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("params", _TEXTS),
    ("return_type", pa.string()), ("dependencies", _TEXTS), ("complexity", pa.int32()),
]
_SEGMENT = [
    ("name", pa.string()), ("id_part", pa.string()), ("kind", pa.string()), ("code", pa.string()), ("start_line", pa.int32()),
    ("end_line", pa.int32()), ("dependencies", _TEXTS), ("complexity", pa.int32()),
]


def analyser(patterns: dict[str, str], headings: tuple[str, ...], fillers: tuple[str, ...], drop: str | None) -> Callable[[pa.Array, pa.Array], pa.Array]:
    """(language, content) of a batch of files to their analyses. ``headings`` and ``fillers`` are no paragraphs and
    variables, nor are paragraphs that match ``drop``."""
    def analysed(language: pa.Array, content: pa.Array) -> pa.Array:
        one = Analyser(patterns, headings, fillers, drop)
        rows = [one(a, b) for a, b in zip(_plain(language), _plain(content))]
        symbols, imports, variables, lines = zip(*rows) if rows else ((), (), (), ())
        return pa.StructArray.from_arrays(
            [_lists(symbols, lambda flat: _structs(flat, _SYMBOL)), _lists(imports, _texts), _lists(variables, _texts), pa.array(lines, pa.int32())],
            names=["symbols", "imports", "global_vars", "total_lines"],
        )

    return analysed


class Cutter:
    """The segments of ``segments.with_segments``, all kinds of them."""

    def __init__(self, header_line: str):
        # a dot of the engine stops at every line end, also within what is a line here
        self.heads = re.compile(header_line.replace(SPACE, r"\s").replace(").*", f"){_SAME_LINE}*")).search

    def header(self, lines: list[str], imports: list[str]) -> list[tuple]:
        """First header line up to the first other line that is not blank."""
        first = next((i for i, x in enumerate(lines) if self.heads(x)), None) if imports else None
        if first is None:
            return []
        stop = next((i for i in range(first + 1, len(lines)) if lines[i].strip() and not self.heads(lines[i])), len(lines))
        return [("imports/includes", "header", "header", "\n".join(lines[first:stop]), 1, stop - first, [], 1)]

    @staticmethod
    def variables(lines: list[str], names: list[str]) -> list[tuple]:
        used = [i for i, x in enumerate(lines) if "=" in x and any(n in x for n in names)] if names else []
        return [("variables_globales", "globals", "globals", "\n".join(lines[i] for i in used), used[0] + 1, used[-1] + 1, [], 1)] if used else []

    @staticmethod
    def groups(symbols: list[tuple]) -> Iterator[tuple]:
        """(name, kind, start, end, dependencies, complexity) as ``segments.symbol_groups`` tells."""
        functions = [s for s in symbols if s[1] == "function"]
        by_start = sorted(functions, key=lambda f: f[2])
        starts = [f[2] for f in by_start]
        made: dict[str, tuple] = {}
        held = set()
        for c in symbols:
            if c[1] in ("struct", "class"):
                members = by_start[bisect_left(starts, c[2]) : bisect_right(starts, c[3])]
                held.update(f[0] for f in members)
                made[c[0]] = (c[0], c[1], c[2], max([c[3], *(f[3] for f in members)]), c[4], max([c[5], *(f[5] for f in members)]))
        for s in [f for f in functions if f[0] not in held] + [s for s in symbols if s[1] == "enum"]:
            made[s[0]] = s
        return iter(made.values())

    def __call__(self, content: str | None, imports: list | None, names: list | None, symbols: list | None) -> list | None:
        if content is None or symbols is None:
            return None if symbols is None else []
        lines = content.split("\n")
        cut = self.header(lines, imports or []) + self.variables(lines, names or [])
        for name, kind, start, end, dependencies, score in self.groups(symbols):
            code = "\n".join(lines[start - 1 : end])
            if code.strip():
                cut.append((name, name, kind, code, start, end, sorted(set(dependencies)), score))
        return cut


def _plain(column: pa.Array) -> list:
    """The values of texts or of whole numbers without nulls; several times as fast as ``to_pylist``."""
    return column.to_numpy(zero_copy_only=False).tolist()


def _rows(lists: pa.ListArray, flat: list) -> Iterator[list | None]:
    offsets, known = _plain(lists.offsets), _plain(lists.is_valid())
    return (flat[a:b] if k else None for a, b, k in zip(offsets, offsets[1:], known))


def cutter(header_line: str) -> Callable[[pa.Array, pa.Array, pa.Array, pa.Array], pa.Array]:
    """(content, imports, global_vars, symbols) of a batch of files to their segments."""
    def segments(content: pa.Array, imports: pa.Array, global_vars: pa.Array, symbols: pa.Array) -> pa.Array:
        cut = Cutter(header_line)
        texts = lambda lists: _rows(lists, _plain(lists.values))
        fields = [symbols.values.field(n) for n in ("name", "kind", "start_line", "end_line", "dependencies", "complexity")]
        flat = list(zip(*[list(texts(f)) if pa.types.is_list(f.type) else _plain(f) for f in fields]))
        made = [cut(*row) for row in zip(_plain(content), texts(imports), texts(global_vars), _rows(symbols, flat))]
        return _lists(made, lambda flat: _structs(flat, _SEGMENT))

    return segments
