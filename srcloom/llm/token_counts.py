"""Token counts from a tokenizer compiled to finite-state transducers.

Two deterministic transducers stand for a tokenizer of pairwise merges with word ends:

* the splitter reads character classes and marks where pieces begin. It has seven states, so a stretch of text is a map
  from state to state: all chunks of a batch are mapped at once, the maps are composed by a parallel prefix scan, and with
  the states in which the chunks begin known, a second pass writes the marks;
* the counter reads the bytes of a piece, the last one as a symbol of its own, and each transition carries how many
  tokens it adds (or takes back) to those of the piece so far. Its states are a place in the trie of all tokens and, for each start
  that a coming token may have, the last token up to there with its count. They are compiled when first met.

The last token of each beginning of a piece is the longest token that ends there and may follow the last token of what
is before it. Two tokens may stand side by side if no merge across their border comes before the merges that used up
its two sides: one on the left must come strictly sooner, one on the right sooner or at the same rank, as equal merges go from
left to right.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcloom.llm.alignment import byte_alphabet, slices
from srcloom.llm.common import arrow_batches, byte_texts

# The pattern and the normalizers that the splitter stands for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]

# Classes of characters: letters that a quotation mark takes along alone, or with a second one, stand for themselves.
SPACE, LETTER, NUMBER, OTHER, QUOTE, ALONE, R, V, L, E = range(10)
LETTERS = {**dict.fromkeys("stmd", ALONE), "r": R, "v": V, "l": L, "e": E}
# States of the splitter: nothing open, in letters, in others, after a quotation mark, after it and r, v or l.
FREE, IN_LETTERS, IN_OTHERS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(7)
# What a transition writes: a piece begins here, or began one character before.
HERE, BEFORE = 1, 2

CHUNK = 256
#: Compiled states and counted pieces that a worker keeps; beyond them it begins anew.
STATES, PIECES = 1 << 17, 1 << 19
_LIBRARY = 0xFFFFFFFE
_UNKNOWN = 0xFFFFFFFF


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, what is written) by state and class."""
    go, write = np.zeros((7, 10), np.int8), np.zeros((7, 10), np.int8)
    letters = (LETTER, ALONE, R, V, L, E)
    for state in range(7):
        for c in range(10):
            inside = (state == IN_LETTERS and c in letters) or (state in (IN_OTHERS, QUOTED) and c in (OTHER, QUOTE))
            go[state, c] = FREE if c in (SPACE, NUMBER) else IN_LETTERS if c in letters else QUOTED if c == QUOTE and not inside else IN_OTHERS
            write[state, c] = HERE if c != SPACE and not inside else 0
    for c, to in ((ALONE, FREE), (R, QUOTED_R), (V, QUOTED_V), (L, QUOTED_L)):
        go[QUOTED, c], write[QUOTED, c] = to, 0
    for state, second in ((QUOTED_R, E), (QUOTED_V, E), (QUOTED_L, L)):
        # without its second letter the first one began a piece of letters
        go[state], write[state] = go[IN_LETTERS], write[IN_LETTERS] | BEFORE
        go[state, second], write[state, second] = FREE, 0
    return go, write


GO, WRITE = splitter()


def chunk_maps(classes: np.ndarray) -> np.ndarray:
    """For each chunk (row of classes) the state it ends in for each state it begins in; all chunks step together."""
    state = np.tile(np.arange(7, dtype=np.int8), (len(classes), 1))
    for column in classes.T:
        state = GO[state, column[:, None]]
    return state


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """The compositions of each map with all maps before it, in as many rounds as the count has binary digits."""
    out, reach = maps.copy(), 1
    while reach < len(out):
        out[reach:] = np.take_along_axis(out[reach:], out[:-reach].astype(np.int64), axis=1)
        reach *= 2
    return out


def piece_begins(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Places where pieces begin; the classes must end with a space."""
    n = len(classes)
    rows = np.zeros((-(-n // chunk), chunk), np.int8)
    rows.ravel()[:n] = classes
    state = np.zeros(len(rows), np.int8)
    state[1:] = prefix_scan(chunk_maps(rows))[:-1, FREE]
    written = np.empty_like(rows)
    for i, column in enumerate(rows.T):
        written[:, i] = WRITE[state, column]
        state = GO[state, column]
    written = written.ravel()
    begins = written & HERE > 0
    begins[:-1] |= written[1:] & BEFORE > 0
    return np.flatnonzero(begins)


class Counter:
    """The transducer of pieces to counts; ids are those of the vocabulary."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        letters = byte_alphabet()
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        made: dict[int, int] = {}
        for rank, (x, y) in enumerate(merges):
            whole = vocabulary[x + y]
            self.rank.setdefault((vocabulary[x], vocabulary[y]), rank)
            if whole not in made:
                made[whole], self.parts[whole] = rank, (vocabulary[x], vocabulary[y])
        self.made = made
        self.go: dict[int, int] = {}  # trie: node and symbol to node
        self.depth, self.token, self.fail = [0], [-1], [0]
        for name, i in vocabulary.items():
            last = name.endswith(suffix) and len(name) > len(suffix)
            symbols = [letters[c] for c in (name[: -len(suffix)] if last else name)]
            if last:
                symbols[-1] += 256
            if len(symbols) > 1 and i not in made:
                continue  # no merge makes it
            node = 0
            for s in symbols:
                key = node << 9 | s
                if key not in self.go:
                    self.go[key] = len(self.depth)
                    self.depth.append(self.depth[node] + 1)
                    self.token.append(-1)
                    self.fail.append(0)
                node = self.go[key]
            self.token[node] = i
        children: dict[int, list[tuple[int, int]]] = {}
        for key, node in self.go.items():
            children.setdefault(key >> 9, []).append((key & 511, node))
        waiting = deque([0])
        while waiting:
            node = waiting.popleft()
            for s, child in children.get(node, ()):
                self.fail[child] = self.follow(self.fail[node], s) if node else 0
                waiting.append(child)
        self.endings: dict[int, list[tuple[int, int]]] = {0: []}
        self.beside: dict[tuple[int, int], bool] = {}
        self.spines: dict[tuple[int, bool], list[tuple[int, float]]] = {}
        self.forget()

    def forget(self) -> None:
        self.states: list[tuple[int, tuple[tuple[int, int], ...]]] = [(0, ((-1, 0),))]
        self.number = {self.states[0]: 0}
        self.steps: dict[int, tuple[int, int]] = {}
        self.counted: dict[str, int] = {}

    def follow(self, node: int, symbol: int) -> int:
        """The longest beginning of a token that ends here."""
        while True:
            found = self.go.get(node << 9 | symbol)
            if found is not None or not node:
                return found or 0
            node = self.fail[node]

    def ends_at(self, node: int) -> list[tuple[int, int]]:
        """(length, token) of the tokens that end here, longest first."""
        if node not in self.endings:
            own = [(self.depth[node], self.token[node])] if self.token[node] >= 0 else []
            self.endings[node] = own + self.ends_at(self.fail[node])
        return self.endings[node]

    def spine(self, token: int, right: bool) -> list[tuple[int, float]]:
        """(token, rank of the merge that uses it up) of the parts along one side, outermost first."""
        key = (token, right)
        if key not in self.spines:
            out, used = [(token, float("inf"))], token
            while used in self.parts:
                rank, used = self.made[used], self.parts[used][right]
                out.append((used, rank))
            self.spines[key] = out
        return self.spines[key]

    def may_follow(self, one: int, two: int) -> bool:
        """Whether the tokens stay apart when they stand side by side."""
        key = (one, two)
        if key not in self.beside:
            if len(self.beside) >= PIECES:
                self.beside.clear()
            rank = self.rank.get
            none = float("inf")
            self.beside[key] = not any(
                (r := rank((x, y), none)) < gone_x and r <= gone_y and r < none for x, gone_x in self.spine(one, True) for y, gone_y in self.spine(two, False)
            )
        return self.beside[key]

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """(next state, tokens added), compiled when first met."""
        node, window = self.states[state]
        after = self.follow(node, symbol)
        for length, token in self.ends_at(after):
            before, count = window[-length]
            if before < 0 or self.may_follow(before, token):
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        added, depth = count + 1, self.depth[after]
        found = (after, (*((t, c - added) for t, c in window[len(window) - depth :]), (token, 0)))
        to = self.number.get(found)
        if to is None:
            to = self.number[found] = len(self.states)
            self.states.append(found)
        out = self.steps[state << 9 | symbol] = (to, added)
        return out

    def count(self, piece: bytes) -> int:
        """Tokens of a piece."""
        if len(self.states) > STATES or len(self.counted) > PIECES:
            self.forget()
        state = n = 0
        steps = self.steps
        for symbol in (*piece[:-1], piece[-1] + 256):
            found = steps.get(state << 9 | symbol)
            if found is None:
                found = self.step(state, symbol)
                if len(self.states) > 2 * STATES:  # a very long piece: keep only where it stands
                    here = self.states[found[0]]
                    self.states, self.number = [self.states[0], here], {self.states[0]: 0, here: 1}
                    steps.clear()
                    found = (1, found[1])
            state = found[0]
            n += found[1]
        return n


class Compiled:
    """A tokenizer file as splitter and counter, with the classes of characters as its library has them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        model, split = rules["model"], (rules["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix") or (split[0].get("pattern") or {}).get("Regex") != PATTERN or (rules["normalizer"] or {}).get("normalizers") != NORMALIZERS:
            raise ValueError(f"{path}: only tokenizers with word ends and the pattern {PATTERN} are compiled")
        library = Tokenizer.from_file(path)
        self.normalize, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.special = re.compile("|".join(re.escape(t["content"]) for t in rules["added_tokens"]) or r"(?!)")
        self.counter = Counter(model["vocab"], [tuple(m if isinstance(m, list) else m.split(" ", 1)) for m in model["merges"]], model["end_of_word_suffix"])
        self.lower = np.full(0x110000, _UNKNOWN, np.uint32)
        self.lower[:128] = [ord(chr(c).lower()) for c in range(128)]
        self.classes = np.full(0x110000, -1, np.int8)

    def lower_of(self, c: str) -> int:
        """The character in lower case; what is longer, or younger than Python's own tables, is left to the library."""
        found = self.normalize(c)
        return ord(found) if len(found) == 1 and unicodedata.category(c) != "Cn" else _LIBRARY

    def class_of(self, c: str) -> int:
        if c in LETTERS:
            return LETTERS[c]
        if c == "'":
            return QUOTE
        around = len(self.split(f"a{c}a"))
        return LETTER if around == 1 else SPACE if around == 2 else NUMBER if len(self.split(c + c)) == 2 else OTHER

    def filled(self, table: np.ndarray, codes: np.ndarray, empty: int, of) -> np.ndarray:
        """Entries of a table, asking for characters that were not met before."""
        out = table[codes]
        new = codes[out == table.dtype.type(empty)]
        if len(new):
            for code in np.unique(new).tolist():
                table[code] = of(chr(code))
            out = table[codes]
        return out

    def plain(self, text: str) -> tuple[str, np.ndarray]:
        """The text as the normalizer gives it (runs of white space apart), and its code points."""
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if not text.isascii():
            lower = self.filled(self.lower, codes, _UNKNOWN, self.lower_of)
            if (lower == _LIBRARY).any() or not unicodedata.is_normalized("NFC", text):
                text = self.normalize(text)
                return text, np.frombuffer(text.encode("utf-32-le"), np.uint32)
            return lower.tobytes().decode("utf-32-le"), lower
        return text.lower(), self.lower[codes]

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        n = np.zeros(len(texts), np.int64)
        owner, parts, codes = [], [], []
        blank = np.array([32], np.uint32)
        for i, text in enumerate(texts):
            own = [text]
            if "<" in text or len(self.special.pattern) < 4:
                own = self.special.split(text)
                n[i] += len(own) - 1
            for part in own:
                if part:
                    plain, code = self.plain(part)
                    owner.append((i, len(plain) + 1))
                    parts += [plain, " "]
                    codes += [code, blank]
        if not parts:
            return n
        line = "".join(parts)
        classes = self.filled(self.classes, np.concatenate(codes), -1, self.class_of)
        begins = piece_begins(classes)
        if not len(begins):
            return n
        # a piece ends where the next begins or at white space
        spaces = np.flatnonzero(classes == SPACE)
        ends = np.minimum(np.append(begins[1:], len(line)), spaces[np.searchsorted(spaces, begins)])
        known, count = self.counter.counted, self.counter.count
        sizes = np.empty(len(begins), np.int64)
        for i, (a, b) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True)):
            piece = line[a:b]
            found = known.get(piece)
            if found is None:
                found = count(piece.encode())
                known = self.counter.counted
                if b - a <= 64:
                    known[piece] = found
            sizes[i] = found
        text_of, length = (np.array(x) for x in zip(*owner, strict=True))
        np.add.at(n, text_of[np.searchsorted(np.cumsum(length), begins, "right")], sizes)
        return n


_compiled: dict[str, Compiled] = {}
_WHITE = re.compile(rb"[ \t\r\n]")


def compiled(path: str) -> Compiled:
    """Once for each worker."""
    if path not in _compiled:
        _compiled[path] = Compiled(path)
    return _compiled[path]


def stretches(text: bytes, most: int = 1 << 20) -> Iterator[bytes]:
    """A long text in stretches of some ``most`` bytes; they end at white space, where no token, no special string and no
    composed character goes on."""
    at = 0
    while len(text) - at > most:
        cut = _WHITE.search(text, at + most)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row: UTF-8 bytes, tokens without begin or end, more than ``limit``.

    Null and empty texts have 0 of both. Strings of special tokens inside a text are one token each, as the library has
    it. Ids may be null, repeated and of any type and are handed through; other columns are not read; an empty table
    gives an empty one. Long texts are read in stretches that end at white space; without any, a text is one stretch."""
    arrow_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = compiled(path)
        for batch in batches:
            texts = [t or b"" for t in byte_texts(batch)]
            cut = [(i, s) for i, t in enumerate(texts) for s in stretches(t)]
            n = np.zeros(len(texts), np.int64)
            for start, end in slices([s for _, s in cut]):
                np.add.at(n, [i for i, _ in cut[start:end]], tokenizer.counts([s.decode() for _, s in cut[start:end]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
