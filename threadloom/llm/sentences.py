"""Sentence boundaries across languages and scripts, by compiled finite transducers.

Two small rule sets are compiled to dense tables. The word transducer reads characters and
classifies each full stop (plain, after an abbreviation, after an initial, ...). The
sentence transducer reads the classes of characters and emits one bit: a sentence starts
here. Its states hold what is pending (an end mark, a quote just closed, a colon, a line
break), the open quote or bracket, and whether the script has no end marks.

A table run over a stretch of text is a function from state to state. Long texts are cut
into chunks, the functions of all chunks are computed side by side and composed by a
parallel prefix scan, and a last pass emits the output with every chunk's true start state.
Both transducers go this way, the word transducer first. Short texts are chunks whose start
state is known.

Brackets nest to any depth, which no finite table can count. They are paired by running
sums and running minima, scans as well, within each paragraph; only the outermost of a pair
reach the table. Brackets and quotes that are never closed are plain signs.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Hashable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from threadloom.llm.unify import _LATIN, is_invisible

CHUNK = 4096

# Abbreviations of English, German, French, Spanish, Portuguese, Italian, Dutch,
# Polish, Russian, Hindi and Arabic. Of these the first never end a sentence, the others end
# one if a capital, an opening quote or nothing follows.
NEVER_LAST = """
dr prof mr mrs ms mme st fig figs eq eqs éq cf vs ca bzw abb hr inż mgr hab ul os zob por np tzn tzw wg m.in vgl evtl inkl
e.g i.e z zzgl проф см рис табл ул напр т.е डॉ श्री सुश्री د أ
sgt gen col lt cpl capt cmdr maj adm gov sen rep hon rev pres messrs mt ft
sr sra srta dra dña prof.ª av ej pág núm sig sigg dott ing avv mlle mm dhr mevr
""".split()
MAYBE_LAST = """
no nr ok tab sec str approx etc usw itd itp al et.al p.m a.m u.s u.k u.n e.u ph.d jr inc ltd corp co vol ch pp art est др пр г гг в r w т.д т.п ex z.b u.a d.h
d.c u.s.a u.s.s.r b.a m.a m.d b.c a.d dept univ assn bros ave blvd rd jan feb mar apr jun jul aug sept oct nov dec mon tue wed thu fri sat sun
""".split()
#: Words before the number of a day; the stop after the number ends nothing.
BEFORE_DAY = "am vom zum bis ab seit dem den der".split()

# Symbols of the sentence transducer.
(UP, LOW, OTH, THAI, DIG, SP, NL, PLAIN, NEVER, MAYBE, EX, STRONG, ELL, OPEN_C, OPEN_L, OPEN_G, OPEN_K, CLOSE_C, CLOSE_G,
 CLOSE_K, STRAIGHT, OPEN_B, CLOSE_B, DASH, COLON, COMMA, OT, SKIP, LAST_C, LAST_S) = range(30)
N_SYMBOLS = 30

_CHARS = {
    EX: "!?‽⁇⁈⁉", STRONG: "。！？｡．।॥۔؟။።፧᙮", ELL: "…⋯", OPEN_C: "“‟", OPEN_L: "„‚", OPEN_G: "«‹", OPEN_K: "「『《〈",
    CLOSE_C: "”", CLOSE_G: "»›", CLOSE_K: "」』》〉", STRAIGHT: "\"＂", OPEN_B: "([{（［【〔", CLOSE_B: ")]}）］】〕",
    DASH: "-‐‑‒–—―", COLON: ":：", COMMA: ",;，；、،؛", NL: "\n\x0b\x0c\x85\u2028\u2029", SP: "\t",
    SKIP: "\r",
}


def _symbol(c: str) -> int:
    if is_invisible(c):
        return SKIP
    kind = unicodedata.category(c)
    if 0x0E00 <= ord(c) < 0x0F00 and kind[0] in "LM":
        return THAI
    if kind in ("Lu", "Lt"):
        return UP
    if kind == "Ll":
        return LOW
    if kind[0] == "M":
        return SKIP
    return {"L": OTH, "N": DIG, "Z": SP}.get(kind[0], OT)


def _compile(start: Hashable, step: Callable, symbols: int) -> tuple[np.ndarray, np.ndarray, dict]:
    """Dense next-state and output tables of every state reachable from ``start``."""
    index = {start: 0}
    states = [start]
    after: list[list[int]] = []
    out: list[list[int]] = []
    for state in states:
        rows = [step(state, s) for s in range(symbols)]
        for nxt, _ in rows:
            if nxt not in index:
                index[nxt] = len(states)
                states.append(nxt)
        after.append([index[nxt] for nxt, _ in rows])
        out.append([o for _, o in rows])
    return np.array(after, np.int32).ravel(), np.array(out, np.uint8).ravel(), index


# ---------------------------------------------------------------- word transducer

def _fold(c: str) -> str:
    """Lower-case look of a letter, so that its doubles and wide forms match rules as well."""
    plain = unicodedata.normalize("NFKC", c)
    plain = plain if len(plain) == 1 else c
    low = _LATIN.get(plain, plain).lower()
    low = low if len(low) == 1 else c
    return _LATIN.get(low, low)


class _Words:
    """The word transducer: what kind of full stop is this?"""

    def __init__(self) -> None:
        rules: dict[str, int] = {}
        for words, kind in ((MAYBE_LAST, MAYBE), (NEVER_LAST, NEVER)):
            for w in words:
                for form in ("NFC", "NFD"):
                    rule = "".join(map(_fold, unicodedata.normalize(form, w))) + "."
                    rules |= {rule: kind, rule.replace("fi", "ﬁ"): kind}
        for w in BEFORE_DAY:
            rules |= {f"{''.join(map(_fold, w))} {'#' * n}.": NEVER for n in (1, 2)}
        self.children: list[dict[str, int]] = [{}]
        self.kind: dict[int, int] = {}
        for rule, kind in rules.items():
            node = 0
            for c in rule:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                node = self.children[node][c]
            self.kind[node] = kind
        #: nodes behind a full stop
        self.stops = {child["."] for child in self.children if "." in child}
        letters = sorted({c for rule in rules for c in rule} - set(". #"))
        #: letter symbols come in pairs (small, capital); then other letter, mark, digit, stop, blank, rest, nothing
        self.alphabet = {c: k for k, c in enumerate(letters)}
        self.letters = letters
        n = 2 * len(letters)
        self.other, self.mark, self.digit, self.stop, self.blank, self.rest, self.skip = n, n + 2, n + 3, n + 4, n + 5, n + 6, n + 7
        self.symbols = n + 8
        self.after, self.out, index = _compile((0, ""), self._step, self.symbols)
        self.states = len(index)

    def _step(self, state: tuple[int, str], s: int) -> tuple[tuple[int, str], int]:
        node, single = state
        child = self.children[node] if node >= 0 else {}
        fresh = node == 0 or node in self.stops  # a letter here may begin a word
        if s == self.skip:
            return state, 0
        if s == self.mark:
            return (-1 if node else 0, single if single in "Ul" else ""), 0
        if s < self.mark:
            c = self.letters[s // 2] if s < self.other else ""
            if c not in child and fresh:
                return (self.children[0].get(c, -1), "U" if s % 2 else "l"), 0
            return (child.get(c, -1), ("U" if s % 2 else "l") if node == 0 else ""), 0
        if s == self.digit:
            digits = {0: "1"}.get(node, "") if not single else "2" if single == "1" and node == -1 else ""
            return (child.get("#", -1), digits), 0
        if s == self.stop:
            nxt = child.get(".", 0)
            kind = NEVER if single == "U" else self.kind.get(nxt) or (MAYBE if single else PLAIN)
            return (nxt if self.children[nxt] else 0, ""), kind
        if s == self.blank:
            return (child.get(" ", 0), ""), 0
        return (0, ""), 0

    def symbol(self, c: str) -> int:
        if is_invisible(c) or c == "\r":
            return self.skip
        kind = unicodedata.category(c)
        if kind[0] in "LM":
            k = self.alphabet.get(_fold(c))
            if k is not None:
                return 2 * k + (kind in ("Lu", "Lt"))
            return self.mark if kind[0] == "M" else self.other + (kind in ("Lu", "Lt"))
        if c == ".":
            return self.stop
        return self.digit if kind[0] == "N" else self.blank if kind[0] == "Z" or c in "\t\n\x0b\x0c\x85" else self.rest


# ------------------------------------------------------------ sentence transducer
#
# A state is (place, detail, line, thai). Places: "start" before a sentence, "in" inside it
# (detail "", ":" or "#" after a digit), "end" after an end mark (detail: symbol, blank
# seen), "said" after a closed quote with an end mark inside (detail: how the quote began,
# blank seen), "gap" after a blank in a script without end marks, "quote" (detail: kind, how
# it began, end mark last), "bracket" (detail: at the start, end mark last).
# ``line`` is 1 after a line break with nothing but blanks since. A straight quote after a
# digit is an inch mark. LAST_C and LAST_S are quotes that close but cannot open.

_QUOTES = {OPEN_C: "C", OPEN_L: "L", OPEN_G: "G", OPEN_K: "K", STRAIGHT: "S"}
_CLOSERS = {"C": (CLOSE_C, STRAIGHT, LAST_S), "L": (CLOSE_C, OPEN_C, STRAIGHT, LAST_C, LAST_S), "G": (CLOSE_G,), "K": (CLOSE_K,), "S": (STRAIGHT, LAST_S)}
_ENDS = (PLAIN, MAYBE, EX, STRONG, ELL)
_LATE = (CLOSE_C, CLOSE_G, CLOSE_K, CLOSE_B)


def _begin(s: int, how: str, thai: int) -> tuple:
    """The state after the visible symbol ``s`` outside quotes and brackets."""
    thai |= s == THAI
    if s in _QUOTES:
        return ("quote", (_QUOTES[s], how, 0), 0, thai)
    if s == OPEN_B:
        return ("bracket", (how == "lead", 0), 0, thai)
    if s in _ENDS:
        return ("end", (s, 0), 0, thai)
    return ("in", {COLON: ":", DIG: "#"}.get(s, ""), 0, thai)


def _starts(end: int, blank: int, s: int) -> bool:
    """Does a sentence start with ``s`` after the end mark ``end``?"""
    if end == STRONG:
        return True
    if s in _QUOTES:
        return end != MAYBE or bool(blank)
    if not blank:
        return s == UP and end in (PLAIN, EX) or s in (OTH, THAI) and end in (PLAIN, EX)
    if end == ELL:
        return s == UP
    if end == MAYBE:
        return s == UP
    return s != DASH


def _said(how: str, blank: int, s: int) -> bool:
    """Does a sentence start with ``s`` after a closed quote that holds an end mark?"""
    if s in _QUOTES:
        return True
    if how == "colon":
        return s in (UP, OTH, THAI, DIG)
    return bool(blank) and s in (UP, DIG)


def _step(state: tuple, s: int) -> tuple[tuple, int]:
    place, detail, line, thai = state
    if s == SKIP:
        return state, 0
    if s == NL:
        if line:
            return ("start", "", 1, 0), 0
        if place == "start":
            return ("start", "", 1, 0), 0
        if place in ("end", "said"):
            return (place, (detail[0], 1), 1, thai), 0
        return (place, detail, 1, thai), 0
    if s == SP:
        if place in ("end", "said"):
            return (place, (detail[0], 1), line, thai), 0
        if place == "in" and thai:
            return ("gap", "", line, thai), 0
        if place == "in" and detail == "#":
            return ("in", "", line, thai), 0
        return state, 0
    if place == "start":
        return _begin(s, "lead", 0), 1
    if place == "gap":
        return _begin(s, "lead", 0), 1
    if place == "in":
        if s == STRAIGHT and detail == "#":
            return ("in", "", 0, thai), 0
        return _begin(s, "colon" if detail == ":" else "mid", thai), 0
    if place == "end":
        end, blank = detail
        if s in _ENDS or s == NEVER:
            if blank:
                opens = s == ELL and end != MAYBE
                return (_begin(s, "lead", 0), 1) if opens else (_begin(s, "mid", thai), 0)
            both = ELL if end in (PLAIN, ELL) and s in (PLAIN, MAYBE, NEVER, ELL) else end if end in (EX, STRONG) else s
            return ("end", (both, 0), 0, thai), 0
        if s in _LATE and not blank:
            return ("end", (end, 0), 0, thai), 0
        if _starts(end, blank, s):
            return _begin(s, "lead", 0), 1
        return _begin(s, "mid", thai), 0
    if place == "said":
        how, blank = detail
        if s in _ENDS and not blank:
            return ("end", (s, 0), 0, thai), 0
        if s in _LATE and not blank:
            return state, 0
        if _said(how, blank, s):
            return _begin(s, "lead", 0), 1
        return _begin(s, "mid", thai), 0
    if place == "quote":
        kind, how, ended = detail
        if s in _CLOSERS[kind]:
            return (("said", (how, 0), 0, thai) if ended else ("in", "", 0, thai)), 0
        keep = s in _ENDS or ended and s in _LATE
        return ("quote", (kind, how, int(keep)), 0, thai | (s == THAI)), 0
    lead, ended = detail
    if s == CLOSE_B:
        return (("end", (PLAIN, 0), 0, thai) if lead and ended else ("in", "", 0, thai)), 0
    return ("bracket", (lead, int(s in _ENDS)), 0, thai | (s == THAI)), 0


# ------------------------------------------------- pairs of brackets and quotes

def _new_lows(steps: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Where the running sum of ``steps`` within a part falls below all before it, and below 0.

    ``part`` does not decrease. Each part's sums lie below those of all parts before it, so
    one running minimum serves all.
    """
    if not len(steps):
        return np.zeros(0, bool)
    total = np.cumsum(steps)
    first = np.r_[True, part[1:] != part[:-1]]
    before = (total - steps)[first][np.cumsum(first) - 1]
    shift = (np.cumsum(first) - 1) * np.int64(2 * len(steps) + 2)
    level = total - before - shift
    least = np.minimum.accumulate(np.minimum(level, -shift))
    return level < np.minimum(np.r_[0, least[:-1]], -shift)


def _pair_up(sym: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The symbols of texts one after the other, with only what pairs kept as brackets and quotes.

    ``starts`` are the places where texts begin. Nothing pairs across a blank line.
    """
    marks = np.isin(sym, (OPEN_B, CLOSE_B, OPEN_C, OPEN_L, OPEN_G, OPEN_K, STRAIGHT))
    if not marks.any():
        return sym
    sym = sym.copy()
    visible = np.cumsum(~np.isin(sym, (SP, NL, SKIP)))
    lines = np.flatnonzero(sym == NL)
    bounds = np.zeros(len(sym), np.int64)
    bounds[starts] = 1
    bounds[lines[1:][visible[lines[1:]] == visible[lines[:-1]]]] = 1
    paragraph = np.cumsum(bounds)
    at = np.flatnonzero((sym == OPEN_B) | (sym == CLOSE_B))
    padded = np.r_[[NL] * 3, sym]
    back = lambda n: np.where(paragraph[np.maximum(at - n, 0)] == paragraph[at], padded[at + 3 - n], NL)
    alone = lambda n: np.isin(back(n), (SP, NL))
    face = (back(1) == COLON) & alone(2) | (back(1) == DASH) & (back(2) == COLON) & alone(3)  # :( and :-(
    sym[at[face & (sym[at] == OPEN_B)]] = OT
    at = at[~face]
    steps = np.where(sym[at] == OPEN_B, 1, -1)
    part = paragraph[at]
    loose = (steps < 0) & _new_lows(steps, part)
    loose |= (steps > 0) & _new_lows(-steps[::-1], -part[::-1])[::-1]
    depth = np.cumsum(np.where(loose, 0, steps))
    outer = np.where(steps > 0, depth == 1, depth == 0)
    sym[at[(loose & (steps > 0)) | ~(loose | outer)]] = OT
    for opens, closers, dead in (
        (OPEN_C, (CLOSE_C, STRAIGHT), LAST_C), (OPEN_L, (CLOSE_C, OPEN_C, STRAIGHT), OT), (OPEN_G, (CLOSE_G,), OT), (OPEN_K, (CLOSE_K,), OT), (STRAIGHT, (STRAIGHT,), LAST_S),
    ):
        at, ends = np.flatnonzero(sym == opens), np.flatnonzero(np.isin(sym, (*closers, *((LAST_C,) if OPEN_C in closers else ()))))
        if len(at):
            k = np.searchsorted(ends, at, side="right")
            closed = (k < len(ends)) & (paragraph[ends[np.minimum(k, max(len(ends) - 1, 0))]] == paragraph[at] if len(ends) else False)
            sym[at[~closed]] = dead
    return sym


class Splitter:
    """Both transducers with the tables from characters to their symbols."""

    TABLE = 0x2_0000

    def __init__(self) -> None:
        self.words = _Words()
        self.after, self.out, index = _compile(("start", "", 0, 0), _step, N_SYMBOLS)
        self.states = len(index)
        chars = [chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(self.TABLE)]
        self.symbol = np.fromiter(map(_symbol, chars), np.uint8, self.TABLE)
        self.word_symbol = np.fromiter(map(self.words.symbol, chars), np.int32, self.TABLE)
        for s, members in _CHARS.items():
            for c in members:
                self.symbol[ord(c)] = s
        self.symbol[ord(".")] = PLAIN

    def _symbols(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        far = points >= self.TABLE
        near = np.where(far, 0x4E00, points)
        sent, word = self.symbol[near], self.word_symbol[near]
        if far.any():
            tags = points >= 0xE_0000
            sent[tags], word[tags] = SKIP, self.words.skip
        return sent, word

    @staticmethod
    def _run(after: np.ndarray, width: int, symbols: np.ndarray, state: np.ndarray, out: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
        """Run a table over the columns of ``symbols`` (steps x texts), all texts side by side."""
        bits = None if out is None else np.empty(symbols.shape, np.uint8)
        for t in range(symbols.shape[0]):
            at = state * width + symbols[t]
            state = after[at]
            if bits is not None:
                bits[t] = out[at]
        return state, bits

    @staticmethod
    def _functions(after: np.ndarray, width: int, states: int, symbols: np.ndarray) -> np.ndarray:
        """State-to-state function of each column; states that have met are run once."""
        steps, n = symbols.shape
        current = np.tile(np.arange(states, dtype=np.int64), (n, 1))
        merged = [np.arange(states)] * n
        t, stop = 0, 8
        while t < steps:
            for t in range(t, min(stop, steps)):
                current = after[current * width + symbols[t][:, None]]
            t, stop = t + 1, stop * 4
            rows = [np.unique(row, return_inverse=True) for row in current]
            most = max(len(u) for u, _ in rows)
            merged = [inverse[m] for (_, inverse), m in zip(rows, merged, strict=True)]
            current = np.array([np.pad(u, (0, most - len(u)), mode="edge") for u, _ in rows])
        return np.array([row[m] for row, m in zip(current, merged, strict=True)])

    @staticmethod
    def _scan(functions: np.ndarray) -> np.ndarray:
        """Prefix composition of the chunks of a text, in log2(chunks) rounds."""
        f = functions.copy()
        step = 1
        while step < len(f):
            later = np.take_along_axis(f[step:], f[:-step], axis=1)
            f[step:] = later
            step *= 2
        return f

    def _first_states(self, after: np.ndarray, width: int, states: int, symbols: np.ndarray, chunk: int) -> np.ndarray:
        """The true state at the start of each chunk of a long text, the last one included."""
        whole = len(symbols) // chunk
        functions = self._functions(after, width, states, symbols[: whole * chunk].reshape(whole, chunk).T)
        return np.r_[0, self._scan(functions)[:, 0]]

    def _transduce(self, after: np.ndarray, out: np.ndarray, width: int, states: int, symbols: list[np.ndarray], skip: int, chunk: int) -> list[np.ndarray]:
        """The output of a transducer for each text, all chunks of all texts side by side."""
        pieces: list[tuple[int, int, int, int]] = []
        for k, s in enumerate(symbols):
            first = self._first_states(after, width, states, s, chunk) if len(s) > chunk else (0,)
            pieces += [(k, a, min(a + chunk, len(s)), int(first[a // chunk])) for a in range(0, len(s), chunk)]
        pieces.sort(key=lambda x: x[2] - x[1])
        result = [np.zeros(len(s), np.uint8) for s in symbols]
        limit = max(1, (1 << 21) // chunk)
        at = 0
        while at < len(pieces):
            shortest = pieces[at][2] - pieces[at][1]
            stop = at + 1
            while stop < len(pieces) and stop - at < limit and (stop - at <= 64 or pieces[stop][2] - pieces[stop][1] <= 2 * shortest + 64):
                stop += 1
            group = pieces[at:stop]
            grid = np.full((max(b - a for _, a, b, _ in group), len(group)), skip, symbols[0].dtype)
            for x, (k, a, b, _) in enumerate(group):
                grid[: b - a, x] = symbols[k][a:b]
            _, bits = self._run(after, width, grid, np.array([g[3] for g in group], np.int64), out)
            columns = np.ascontiguousarray(bits.T)
            for x, (k, a, b, _) in enumerate(group):
                result[k][a:b] = columns[x, : b - a]
            at = stop
        return result

    def starts(self, texts: list[str], chunk: int = CHUNK) -> list[np.ndarray]:
        """For each text the code points where its sentences start."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        edges = np.r_[0, np.cumsum(sizes)]
        if not edges[-1]:
            return [np.empty(0, np.int64) for _ in texts]
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        sent, word = self._symbols(points)
        cut = lambda flat: [flat[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        words = self.words
        kinds = self._transduce(words.after, words.out, words.symbols, words.states, cut(word), words.skip, chunk)
        kind = np.concatenate(kinds)
        sent = _pair_up(np.where(kind > 0, kind, sent), edges[:-1][sizes > 0])
        bits = self._transduce(self.after, self.out, N_SYMBOLS, self.states, cut(sent), SKIP, chunk)
        return [np.flatnonzero(b) for b in bits]

    def spans(self, texts: list[str], chunk: int = CHUNK) -> list[list[tuple[int, int]]]:
        """(start, end) of the sentences of each text, without outer white space."""
        out = []
        for text, starts in zip(texts, self.starts(texts, chunk), strict=True):
            ends = [*starts[1:].tolist(), len(text)] if len(starts) else []
            row = []
            for a, b in zip(starts.tolist(), ends, strict=True):
                while b > a and (text[b - 1].isspace() or is_invisible(text[b - 1])):
                    b -= 1
                row.append((a, b))
            out.append(row)
        return out


@lru_cache(maxsize=1)
def splitter() -> Splitter:
    return Splitter()


def _split(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = splitter()
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                texts = part["text"].to_pylist()
                spans = cut.spans(texts, chunk)
                sizes = np.fromiter(map(len, spans), np.int64, len(spans))
                flat = np.array([x for row in spans for x in row], np.int32).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        part["id"].take(pa.array(np.repeat(np.arange(len(texts)), sizes))), pa.array(flat[:, 0]), pa.array(flat[:, 1]),
                        pa.array([t[a:b] for t, row in zip(texts, spans, strict=True) for a, b in row], pa.string()),
                    ],
                    names=["id", "start_pos", "end_pos", "sentence"],
                )

    return run


def split_sentences(strings: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(id, start_pos, end_pos, sentence) of every sentence of the rows (id, text).

    Positions count code points of the stored text, the end exclusive. NULL, empty and
    blank texts have no rows. Texts of any length are split whole. There is no shuffle.
    """
    rows = strings.select("id", "text").where("text IS NOT NULL")
    return rows.mapInArrow(_split(chunk), "id bigint, start_pos int, end_pos int, sentence string")
