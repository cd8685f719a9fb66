"""Text and array building blocks, all as JVM-side column expressions.

Everything that works on one source file stays inside its row: a file's lines,
matches and braces are arrays, so scanning a code base needs no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's \w, \s and \b are ASCII only; these spell out the Unicode meaning.
WORD = r"\p{L}\p{N}_"
SPACE = r" \n\t\r\f\x0B\x1C\x1D\x1E\x1F\x85\p{Z}"
W = f"[{WORD}]"
S = f"[{SPACE}]"
NOT_S = f"[^{SPACE}]"
WB = f"(?<!{W})"  # word boundary before a word
WE = f"(?!{W})"  # word boundary after a word
# (?md): ^ and $ stop at \n only.
ML = "(?md)"

_SPACE_CHARS = "".join(
    chr(c)
    for c in [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)


def strip(text: Column) -> Column:
    """Drop white space of any script from both ends."""
    return F.btrim(text, F.lit(_SPACE_CHARS))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def decode_text(content: Column) -> Column:
    """Bytes to text: invalid UTF-8 becomes U+FFFD, line ends become ``\\n``."""
    return normalise_newlines(F.make_valid_utf8(content.cast("string")))


def normalise_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def escape(text: Column, marks: str, by: str) -> Column:
    """Replaces each of ``marks`` (and ``by`` itself) by ``by`` and a letter, so the marks are free for use."""
    pairs = [(by, by + "a"), *((m, by + chr(ord("b") + i)) for i, m in enumerate(marks))]
    out = text
    for mark, code in pairs:
        out = F.replace(out, F.lit(mark), F.lit(code))
    return F.when(text.rlike(f"[{by}{marks}]"), out).otherwise(text)


def unescape(text: Column, marks: str, by: str) -> Column:
    """The inverse of ``escape``."""
    out = text
    for i, mark in reversed(list(enumerate(marks))):
        out = F.replace(out, F.lit(by + chr(ord("b") + i)), F.lit(mark))
    return F.when(text.contains(by), F.replace(out, F.lit(by + "a"), F.lit(by))).otherwise(text)


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def count_newlines(text: Column) -> Column:
    return F.array_size(split_lines(text)) - 1


def line_count_split(text: Column) -> Column:
    """Newlines plus one."""
    return count_newlines(text) + 1


# The characters that end a line when a text is split into lines.
_LINE_ENDS = "\n\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def line_count_splitlines(text: Column) -> Column:
    """Lines without a trailing empty one; an empty text has none."""
    ends = F.length(text) - F.length(F.translate(text, _LINE_ENDS, ""))
    open_end = (text != "") & ~text.rlike(f"[{_LINE_ENDS}]\\z")
    return ends + open_end.cast("int")


def line_count_stripped(text: Column) -> Column:
    return count_newlines(strip(text)) + 1


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    The optimizer may inline a projected column into a lambda, where it would
    be computed per element; a one-element array keeps the single evaluation.
    """
    return F.transform(F.array(value), body)[0]


def parts(text: Column, delimiter: str | Column, count: int | Column) -> Column:
    """The text before the count-th delimiter, from the right if negative."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.call_function("substring_index", text, as_column(delimiter), as_column(count))


_MARK = "\u0001"
_OTHER = "\u0002"


def _keep_marks(text: Column, pattern: str, replacement: str) -> Column:
    """Line ends and one mark per match; nothing else of the text is left."""
    clean = F.replace(text, F.lit(_MARK), F.lit(_OTHER))
    marked = F.regexp_replace(clean, F.lit(pattern), F.lit(replacement))
    return F.regexp_replace(marked, f"[^\n{_MARK}]+", "")


def _places(lines: Column, count: Callable[[Column], Column]) -> Column:
    """The line number of every element that ``count`` finds in a line, for all lines at once."""
    return F.flatten(F.transform(lines, lambda line, i: F.array_repeat(i + 1, count(line))))


# Hits of a file up to which running sums over its pieces are cheaper than a pass over its lines.
_FEW_HITS = 32


def match_table(text: Column, pattern: str) -> Column:
    """Every match with its start line: ``array<struct<text, start_line>>``.

    Marks are set around each match and the text is cut at them: a piece is a match and what follows it, and the line
    ends of the pieces before it give its line. A text that holds a mark of its own, or many matches, is gone over by
    lines: all but marks and line ends is dropped, and the marks of all lines give the start lines in one pass."""
    none = F.array().cast("array<struct<text:string,start_line:int>>")

    def by_lines(hits: Column) -> Column:
        lines = F.split(_keep_marks(text, pattern, f"{_MARK}$0"), "\n", -1)
        return F.zip_with(
            hits, _places(lines, F.length),
            lambda hit, line: F.struct(hit.alias("text"), line.alias("start_line")),
        )

    def by_pieces(pieces: Column) -> Column:
        def numbered(ends: Column) -> Column:
            def one(piece: Column, i: Column) -> Column:
                line = F.aggregate(F.slice(ends, 1, i + 1), F.lit(1), lambda n, more: n + more)
                return F.struct(parts(piece, _OTHER, 1).alias("text"), line.alias("start_line"))

            return F.transform(F.slice(pieces, 2, F.size(ends) - 1), one)

        few = let(F.transform(pieces, count_newlines), numbered)
        return (
            F.when(F.size(pieces) == 1, none).when(F.size(pieces) <= _FEW_HITS + 1, few)
            .otherwise(by_lines(find_all(text, pattern)))
        )

    marked = F.regexp_replace(text, F.lit(pattern), F.lit(f"{_MARK}$0{_OTHER}"))
    own_marks = text.contains(_MARK) | text.contains(_OTHER)
    return F.when(own_marks, by_lines(find_all(text, pattern))).otherwise(let(F.split(marked, _MARK, -1), by_pieces))


# The words and operators that add a branch, case-sensitive. None
# starts another, so they can be read back from a text that holds nothing else.
BRANCHES = r"if|else|for|while|switch|case|catch|PERFORM|IF|EVALUATE|match|&&|\|\|"
_BRANCHES_AND_LINES = (
    r"\n|(?=[cefimswEIP&|])"
    rf"(?:{WB}(?:if|else|for|while|switch|case|catch|PERFORM|IF|EVALUATE|match){WE}|&&|\|\|)"
)
MAX_COMPLEXITY = 10
# Lines given to a symbol whose block never closes.
OPEN_BLOCK_LINES = 20

_BRACE = "struct<line:int,ch:string>"


def _brace_list(braces: Column) -> Column:
    """All braces in order: ``array<struct<line, ch>>``."""
    def numbered(text: Column) -> Column:
        chars = F.split(F.replace(text, F.lit("\n"), F.lit("")), "")
        return let(
            _places(F.split(text, "\n", -1), F.length),
            lambda places: F.zip_with(places, F.slice(chars, 1, F.size(places)), lambda line, c: F.struct(line.alias("line"), c.alias("ch"))),
        )

    return let(braces, lambda text: F.when(text.rlike("[{}]"), numbered(text)).otherwise(F.array().cast(f"array<{_BRACE}>")))


def _is_open(brace: Column) -> Column:
    return brace["ch"] == "{"


def _depths(rows: Column) -> Column:
    """The depth behind each brace of the list: twice the opening ones up to it, less all up to it."""
    runs = F.split(F.array_join(rows["ch"], ""), r"\{", -1)
    opened = F.flatten(F.transform(runs, lambda run, k: F.array_repeat(k, F.length(run) + F.least(k, F.lit(1)))))
    return F.transform(opened, lambda n, i: 2 * n - i - 1)


def _closing_lines(rows: Column) -> Column:
    """For each brace of the list the line where a block that begins there ends, for any depth and braces without partners.

    A block is over at the next closing brace that comes back to the depth before its first brace. Braces that ask for
    a depth and closing braces that reach one are sorted by (depth, place); each asks the next closing one of its depth."""
    def answered(depths: Column) -> Column:
        event = lambda depth, i, closes, line: F.struct(depth.alias("depth"), i.alias("at"), closes.alias("closes"), line.alias("line"))
        asks = F.transform(rows, lambda b, i: event(F.get(depths, i) + F.when(_is_open(b), -1).otherwise(1), i, F.lit(False), b["line"]))
        ends = F.transform(rows, lambda b, i: event(F.get(depths, i), i, ~_is_open(b), b["line"]))
        events = F.sort_array(F.concat(asks, F.filter(ends, lambda e: e["closes"])))

        def joined(all_: Column) -> Column:
            runs = F.split(F.array_join(F.transform(all_, lambda e: F.when(e["closes"], "|").otherwise("a")), ""), r"\|", -1)
            nth = F.flatten(F.transform(runs, lambda run, k: F.array_repeat(k, F.length(run))))

            def of_ends(closing: Column) -> Column:
                answers = F.zip_with(F.filter(all_, lambda e: ~e["closes"]), nth, lambda ask, k: F.struct(
                    ask["at"].alias("at"), F.when(F.get(closing, k)["depth"] == ask["depth"], F.get(closing, k)["line"]).alias("close")
                ))
                return F.transform(F.sort_array(answers), lambda e: e["close"])

            return let(F.filter(all_, lambda e: e["closes"]), of_ends)

        return let(events, joined)

    return let(_depths(rows), answered)


def _first_braces(rows: Column) -> Column:
    """For each line the place of the first brace at or below it; no entry below the last brace."""
    above = lambda j: F.coalesce(F.get(rows, j - 1)["line"], F.lit(0))
    return F.flatten(F.transform(rows, lambda b, j: F.array_repeat(j, b["line"] - above(j))))


def line_index_parts(text: Column, braces: Column | None = None) -> dict[str, Column]:
    """What block ends and complexity need of a file, computed once: linear in the text, n log n in its braces.

    * ``braces``: all braces with their lines;
    * ``first_brace`` and ``closes``: see the functions above;
    * ``branches``: the number of branch words of each line;
    * ``n_lines``: newlines plus one.

    ``braces`` is the column that holds them already, if there is one.
    """
    braces = _brace_list(F.regexp_replace(text, "[^{}\n]++", "")) if braces is None else braces
    words = F.split(F.array_join(find_all(text, _BRANCHES_AND_LINES), ""), "\n", -1)
    return {
        "braces": braces,
        "first_brace": let(braces, _first_braces),
        "closes": let(braces, _closing_lines),
        "branches": F.transform(words, lambda line: F.when(line == "", 0).otherwise(count_matches(line, BRANCHES))),
        "n_lines": line_count_split(text),
    }


def line_index(text: Column) -> Column:
    """The same as one struct. As columns of a table, keep the parts apart: the
    optimizer takes a struct to pieces and computes a part at every use of it."""
    return F.struct(*[c.alias(n) for n, c in line_index_parts(text).items()])


def block_end(idx: Column, start_line: Column) -> Column:
    """Line of the brace that closes the first block at or below ``start_line``.

    A block that stays open gets ``OPEN_BLOCK_LINES``. The first brace may be a closing one whose block began above."""
    end = F.get(idx["closes"], F.get(idx["first_brace"], start_line - 1))
    return F.coalesce(end, F.least(start_line + (OPEN_BLOCK_LINES - 1), idx["n_lines"]))


def complexity(idx: Column, start_line: Column, end_line: Column, most: int = MAX_COMPLEXITY) -> Column:
    """One plus the branches in the lines, at most ``most``."""
    block = F.slice(idx["branches"], start_line, F.greatest(end_line - start_line + 1, F.lit(0)))
    return F.least(F.lit(most), F.aggregate(block, F.lit(0), lambda n, hits: n + hits) + 1)


def slice_lines(lines: Column, start_line: Column, end_line: Column) -> Column:
    """The text from one line to another, both included."""
    return F.array_join(
        F.slice(lines, start_line, F.greatest(end_line - start_line + 1, F.lit(0))), "\n"
    )


def split_list(text: Column) -> Column:
    """Comma list to trimmed parts, empty ones dropped."""
    return F.filter(F.transform(F.split(text, ",", -1), strip), lambda p: p != "")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def suffix(path: Column) -> Column:
    """Last ``.ext`` of the base name; a leading dot does not start one."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def stem(path: Column) -> Column:
    name = basename(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(path)))


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
