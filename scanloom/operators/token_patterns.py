"""Patterns over tokens: automata with optional and repeated steps, compiled to one fold over an array of tokens.

A token is a run of letters, a run of figures or one sign, with what rules ask about it. A pattern is a list of steps, each
a test of a token and how often it may hold. Its automaton has a state before each step and one behind the last. The fold
goes from the last token to the first and keeps for each state the farthest end that a run in it can still reach, for what
a run can reach depends on its state and place alone. So a text costs time in proportion to its tokens times the pattern's
steps, whatever repeats. search() is a Column expression, which is looked up anew for each token; found_in() goes through
the same automata step by step for all tokens of many texts at once, as arrays.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property, lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType


def tokens(text: Column) -> Column:
    """Structs of text, lower, kind (letters, figures, sign), glued (no white space before it), starts and ends (at its
    begin or end a word begins or ends: no letter or figure is next to it), in their order; null for a null text."""
    raw = F.regexp_extract_all(text, F.lit(r"\s*(?:\p{L}+|\p{N}+|[^\s\p{L}\p{N}])"), F.lit(0))
    plain = F.transform(raw, lambda x: F.struct(F.regexp_replace(x, r"^\s+", "").alias("text"), (~x.rlike(r"^\s")).alias("glued"), (~x.rlike(r"[\p{L}\p{N}]$")).alias("sign")))
    near = lambda t, u: u.isNotNull() & ~t["sign"] & ~u["sign"]

    def told(all_: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            before, after = F.get(all_, i - 1), F.get(all_, i + 1)
            kind = F.when(t["sign"], "sign").when(t["text"].rlike(r"^\p{N}"), "figures").otherwise("letters")
            starts = ~F.coalesce(near(t, before) & t["glued"], F.lit(False))
            ends = ~F.coalesce(near(t, after) & after["glued"], F.lit(False))
            return F.struct(t["text"].alias("text"), F.lower(t["text"]).alias("lower"), kind.alias("kind"), t["glued"].alias("glued"), starts.alias("starts"), ends.alias("ends"))

        return F.transform(all_, one)

    # an array of one array, so that the plain tokens are computed once and not for each of their neighbours
    return F.get(F.transform(F.array(plain), told), F.lit(0))


@dataclass(frozen=True)
class Test:
    """What a token is asked: its kind, how many characters it has, its form (upper or title case), whether its lower case is
    one of words or it is one of chars, and its flags (glued, starts, ends)."""

    kind: str | None = None
    least: int = 1
    most: int | None = None
    form: str | None = None
    words: tuple[str, ...] = ()
    chars: str = ""
    flags: tuple[tuple[str, bool], ...] = ()

    def __call__(self, t: Column) -> Column:
        size, asked = F.length(t["text"]), []
        if self.kind:
            asked += [t["kind"] == self.kind, size >= self.least]
        if self.most:
            asked.append(size <= self.most)
        if self.form:
            asked.append(t["text"].rlike({"upper": r"^\p{Lu}+$", "title": r"^\p{Lu}\p{Ll}*$"}[self.form]))
        if self.words:
            asked.append(t["lower"].isin(*self.words))
        if self.chars:
            asked.append(t["text"].isin(*self.chars))
        return reduce(lambda a, b: a & b, [*asked, *[t[k] == v for k, v in self.flags]])

    def among(self, ts: _Tokens, at: np.ndarray | None) -> np.ndarray:
        """Those of the places `at` (None: of all) whose token passes."""
        if self.kind:
            kind = _KINDS.index(self.kind)
            at = ts.of[kind] if at is None else at[ts.kind[at] == kind]
        else:
            at = np.flatnonzero(ts.kind != _END) if at is None else at[ts.kind[at] != _END]
        for flag, value in self.flags:
            at = at[getattr(ts, flag)[at] == value]
        if self.kind and (self.least > 1 or self.most):
            size = ts.end[at] - ts.begin[at]
            at = at[(size >= self.least) & (size <= (self.most or size))]
        if self.form:
            size, uppers = ts.end[at] - ts.begin[at], ts.uppers[ts.end[at]] - ts.uppers[ts.begin[at]]
            if self.form == "title":
                lowers = ts.lowers[ts.end[at]] - ts.lowers[ts.begin[at]]
                at = at[(ts.code[ts.begin[at]] == _UPPER) & (uppers == 1) & (lowers == size - 1)]
            else:
                at = at[uppers == size]
        if self.words:
            at = np.unique(np.concatenate([ts.named(w, at) for w in self.words]))
        if self.chars:
            at = at[(ts.end[at] - ts.begin[at] == 1) & np.isin(ts.points[ts.begin[at]], [ord(c) for c in self.chars])]
        return at


@dataclass(frozen=True)
class Step:
    """A token that passes `test`; `optional`: it may be absent; `repeats`: any number more may follow."""

    test: Test
    optional: bool = False
    repeats: bool = False


def letters(least: int = 1, most: int | None = None, upper: bool = False, words: list[str] | None = None) -> Test:
    return Test("letters", least, most, "upper" if upper else None, tuple(words or ()))


def title(least: int = 1) -> Test:
    return Test("letters", least, form="title")


def figures(least: int, most: int | None = None) -> Test:
    return Test("figures", least, most or least)


def sign(chars: str) -> Test:
    return Test(chars=chars)


def also(test: Test, **flags: bool) -> Test:
    """test, and the token's flags (glued, starts, ends) as given."""
    return replace(test, flags=(*test.flags, *flags.items()))


def spans(toks: Column, pattern: list[Step]) -> Column:
    """Structs (first, last) of the places where the pattern holds: for each first token the farthest last one. They may
    overlap; see leftmost(). A pattern whose steps are all optional never holds on no token."""
    m = len(pattern)
    best = F.greatest  # which passes over nulls

    def before(after: Callable[[int], Column], end: Column, test: Callable[[int], Column] | None) -> tuple[Column, list[Column]]:
        """The farthest end from before the first step, and from behind each step, at a token; after(j): that from behind
        step j at the next token."""
        ahead, behind = end, [end] * m
        for j in range(m - 1, -1, -1):
            taken = F.when(test(j), after(j)) if test else F.lit(None).cast("int")
            behind[j] = best(ahead, taken) if pattern[j].repeats and test else ahead
            ahead = best(taken, ahead) if pattern[j].optional else taken
        return ahead, behind

    def merge(state: Column, t: Column) -> Column:
        i = state["i"] - 1
        end, behind = before(lambda j: state["behind"][j], i, lambda j: pattern[j].test(t))
        found = F.when(end > i, F.concat(state["found"], F.array(F.struct(i.alias("first"), (end - 1).alias("last"))))).otherwise(state["found"])
        return F.struct(i.alias("i"), F.array(*behind).alias("behind"), found.alias("found"))

    nothing = F.array().cast("array<struct<first:int,last:int>>")
    _, last = before(lambda j: F.lit(None), F.size(toks), None)
    start = F.struct(F.size(toks).alias("i"), F.array(*last).alias("behind"), nothing.alias("found"))
    # most texts lack a token that some step cannot do without, which is told much sooner
    able = reduce(lambda a, b: a & b, [F.exists(toks, step.test) for step in pattern if not step.optional], F.lit(True))
    return F.when(able, F.aggregate(F.reverse(toks), start, merge, lambda s: s["found"])).otherwise(F.when(toks.isNotNull(), nothing))


def leftmost(found: Column) -> Column:
    """Of spans those that a search from the left takes: the first to start, of these the longest, then on behind it."""
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["first"].alias("first"), (-s["last"]).alias("down"))))
    start = F.struct(F.lit(-1).alias("upto"), F.array().cast("array<struct<first:int,last:int>>").alias("got"))

    def merge(a: Column, s: Column) -> Column:
        taken = F.struct((-s["down"]).alias("upto"), F.concat(a["got"], F.array(F.struct(s["first"].alias("first"), (-s["down"]).alias("last")))).alias("got"))
        return F.when(s["first"] > a["upto"], taken).otherwise(a)

    return F.aggregate(ordered, start, merge, lambda a: a["got"])


def texts(toks: Column, found: Column) -> Column:
    """The text of each span, one blank where white space was."""
    def one(s: Column) -> Column:
        own = F.slice(toks, s["first"] + 1, s["last"] - s["first"] + 1)
        return F.array_join(F.transform(own, lambda t, i: F.concat(F.when((i > 0) & ~t["glued"], " ").otherwise(""), t["text"])), "")

    return F.transform(found, one)


def search(toks: Column, patterns: list[list[Step]]) -> Column:
    """The texts that one of the patterns finds, by a search from the left over all of them at once."""
    # an array of one array, so that the tokens are computed once, whatever expression they are
    return F.get(F.transform(F.array(toks), lambda ts: texts(ts, leftmost(F.concat(*[spans(ts, p) for p in patterns])))), F.lit(0))


# the same over arrays of many texts

#: Characters by what tokens are made of; kinds of tokens, of which an end closes each text and passes no test.
_WHITE, _OTHER, _UPPER, _LOWER, _FIGURE, _MARK = range(6)
_KINDS = ["", "letters", "figures", "sign"]
_SIGN, _END = 3, 4
_KIND_OF = np.array([0, 1, 1, 1, 2, 3], np.uint8)
#: Texts that are read at once.
TEXTS = 1000


@lru_cache(maxsize=4)
def _characters(planes: int) -> tuple[np.ndarray, np.ndarray]:
    """What each character of the first planes is, and its lower case (itself, if that is not one character)."""
    own = {"Lu": _UPPER, "Ll": _LOWER}
    all_ = [chr(k) for k in range(planes << 16)]
    names = [unicodedata.category(c) for c in all_]
    code = np.array([own.get(x, _OTHER if x[0] == "L" else _FIGURE if x[0] == "N" else _MARK) for x in names], np.uint8)
    code[[ord(c) for c in " \t\n\v\f\r"]] = _WHITE
    return code, np.array([ord(x) if len(x := c.lower()) == 1 else ord(c) for c in all_], np.uint32)


class _Tokens:
    """tokens() of many texts as arrays, one behind the other, each text closed by an end."""

    def __init__(self, texts: list[str]):
        self.whole = "\0".join(texts) + "\0"
        self.points = np.frombuffer(self.whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes, self._lower = _characters((int(self.points.max()) >> 16) + 1)
        self.code = codes[self.points]
        kinds = _KIND_OF[self.code]
        kinds[np.cumsum([len(t) + 1 for t in texts]) - 1] = _END
        alone = kinds >= _SIGN
        changes = kinds[1:] != kinds[:-1]
        self.begin = np.flatnonzero((kinds > 0) & (alone | np.r_[True, changes]))
        self.end = np.flatnonzero((kinds > 0) & (alone | np.r_[changes, True])) + 1
        self.kind = kinds[self.begin]
        self.glued = np.r_[np.uint8(_END), kinds][self.begin] > 0
        word = self.kind < _SIGN
        near = word & np.r_[False, word[:-1]] & self.glued
        self.starts, self.ends = ~near, ~np.r_[near[1:], False]
        self.of = [np.flatnonzero(self.kind == k) for k in range(_END)]
        self.text = np.r_[0, np.cumsum(self.kind == _END)[:-1]]

    @cached_property
    def uppers(self) -> np.ndarray:
        return np.r_[0, np.cumsum(self.code == _UPPER)]

    @cached_property
    def lowers(self) -> np.ndarray:
        return np.r_[0, np.cumsum(self.code == _LOWER)]

    @cached_property
    def spaced(self) -> np.ndarray:
        """How many tokens up to each have white space before them that is not one blank."""
        before = np.r_[0, self.end[:-1]]
        return np.cumsum(~self.glued & ((self.begin - before != 1) | (self.points[self.begin - 1] != ord(" "))))

    def named(self, word: str, at: np.ndarray) -> np.ndarray:
        at = at[self.end[at] - self.begin[at] == len(word)]
        for k, c in enumerate(word):
            at = at[self._lower[self.points[self.begin[at] + k]] == ord(c)]
        return at

    def between(self, first: int, last: int) -> str:
        if self.spaced[last] == self.spaced[first]:
            return self.whole[self.begin[first] : self.end[last]]
        return "".join(("" if k == first or self.glued[k] else " ") + self.whole[self.begin[k] : self.end[k]] for k in range(first, last + 1))


def _farthest(ts: _Tokens, pattern: list[Step]) -> tuple[np.ndarray, np.ndarray]:
    """spans() of all texts: the first tokens, ascending, and their last ones. From the last step to the first, `ends` has for
    each token the farthest end from before the step (-1: none), and `some` the tokens that have one (None: all)."""
    n = len(ts.kind)
    here, some = np.arange(n, dtype=np.int32), None
    ends = here
    for step in reversed(pattern):
        behind, known = ends, some
        if step.repeats:
            behind, known = _run_on(ends, step.test.among(ts, None)), None
        at = None if known is None else known[known > 0] - 1
        at = step.test.among(ts, at)
        at = at[behind[at + 1] >= 0]
        taken = behind[at + 1]
        if step.optional:
            ends = ends.copy()
            ends[at] = np.maximum(ends[at], taken)
            some = None if some is None else np.union1d(some, at)
        else:
            ends, some = np.full(n, -1, np.int32), at
            ends[at] = taken
    at = np.flatnonzero(ends > here) if some is None else some[ends[some] > some]
    return at, ends[at] - 1


def _run_on(ends: np.ndarray, passing: np.ndarray) -> np.ndarray:
    """For each token the largest of ends from it to the token behind the run of passing ones that it stands in."""
    stops = np.ones(len(ends), bool)  # whether the token behind is out of reach
    stops[passing] = False
    run = np.cumsum(stops[::-1]) * (len(ends) + 1)  # from the end on, so that no run's ends reach the next one's
    return (np.maximum.accumulate(run + ends[::-1] + 1) - run - 1)[::-1].astype(np.int32)


def _found(texts: list[str | None], patterns: list[list[list[Step]]]) -> list[pa.Array]:
    """For each list of patterns what search() finds in each text."""
    ts = _Tokens([t or "" for t in texts])
    null, out = pa.array([t is None for t in texts]), []
    for several in patterns:
        firsts, lasts = (np.concatenate(x) for x in zip(*[_farthest(ts, p) for p in several], strict=True))
        order = np.lexsort((-lasts, firsts))
        upto, kept = -1, []
        for first, last in zip(firsts[order].tolist(), lasts[order].tolist(), strict=True):
            if first > upto:
                kept.append((first, last))
                upto = last
        counts = np.bincount(ts.text[[f for f, _ in kept]], minlength=len(texts)) if kept else np.zeros(len(texts), np.int64)
        offsets = pa.array(np.r_[0, np.cumsum(counts)], pa.int32())
        out.append(pa.ListArray.from_arrays(offsets, pa.array([ts.between(*k) for k in kept], pa.string()), mask=null))
    return out


def found_in(rows: DataFrame, patterns: dict[str, list[list[Step]]], keep: list[str], text_col: str = "text") -> DataFrame:
    """keep's columns of rows, and under each of patterns' names what search() finds in the text. Texts go to Python once, many
    at a time, and are neither exchanged nor sorted. A null text has null, one without a match an empty array; equal rows have
    equal results; an empty table stays empty. Case is folded letter by letter."""
    schema = StructType([*[rows.schema[c] for c in keep], *[StructField(k, ArrayType(StringType())) for k in patterns]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in (b.slice(at, TEXTS) for at in range(0, b.num_rows, TEXTS)):
                found = _found(p.column(len(keep)).to_pylist(), list(patterns.values()))
                yield pa.RecordBatch.from_arrays([*p.columns[: len(keep)], *found], names=schema.names)

    return rows.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, schema)


# the rule profile's ids, addresses, salutations and offices

_glued = {"glued": True}
#: d4.d2.d3; letters/letters/d2/d3 with a letter or without; a number of four groups behind IdNr; d3/d4/d4 behind Steuernummer.
_SLASH = Step(also(sign("/"), **_glued))
_LABELS = ["idnr", "steuernummer", "steuernr"]


def _dotted() -> list[Step]:
    point = Step(also(sign(".,"), **_glued))
    return [Step(also(figures(4), starts=True)), point, Step(also(figures(2), **_glued)), point, Step(also(figures(3), ends=True, **_glued))]


def _slashed(letter: bool) -> list[Step]:
    head = [Step(also(letters(2, 4, upper=True), starts=True)), _SLASH, Step(also(letters(2, 4, upper=True), **_glued)), _SLASH, Step(also(figures(2), **_glued)), _SLASH]
    if letter:
        return [*head, Step(also(figures(3, 4), **_glued)), Step(also(letters(1, 1, upper=True), ends=True, **_glued))]
    return [*head, Step(also(figures(3, 4), ends=True, **_glued))]


def _labelled(words: list[str]) -> list[list[Step]]:
    """Openings of a labelled id: its label, and a point or colon at it or none."""
    mark = Step(also(sign(".:"), **_glued), optional=True)
    plain = [Step(also(letters(words=words), starts=True)), mark]
    hyphen = [Step(also(letters(words=["id"]), starts=True)), Step(also(sign("-"), **_glued)), Step(also(letters(words=["nr"]), **_glued)), mark]
    return [plain, hyphen] if "idnr" in words else [plain[:1]]


def id_patterns() -> list[list[Step]]:
    apart = lambda n, **f: Step(also(figures(n), glued=False, **f))
    four = [apart(2), apart(3), apart(3), apart(3, ends=True)]
    three = [apart(3), _SLASH, Step(also(figures(4), **_glued)), _SLASH, Step(also(figures(4), ends=True, **_glued))]
    return [_dotted(), _slashed(False), _slashed(True), *[[*x, *four] for x in _labelled(_LABELS)], *[[*x, *three] for x in _labelled(_LABELS[1:])]]


def address_patterns() -> list[list[Step]]:
    """Street, number, postcode and town; postcode and town."""
    street = [Step(letters()), Step(also(figures(1, 1_000_000), glued=False)), Step(sign(",")), Step(also(figures(5), ends=True)), Step(also(letters(), glued=False))]
    return [street, [Step(also(figures(5), starts=True)), Step(also(letters(), glued=False))]]


def recipient_patterns() -> list[list[Step]]:
    """Für Herrn or Frau and a proper noun; sehr geehrte and a proper noun, for which a title-case word stands."""
    name = Step(also(title(3), glued=False))
    two = lambda a, b: [Step(also(letters(words=a), starts=True)), Step(also(letters(words=b), glued=False)), name]
    return [two(["für", "fur"], ["herrn", "frau", "herr", "hr"]), two(["sehr"], ["geehrte"])]


def office_patterns() -> list[list[Step]]:
    """Finanzamt and the words behind it, each after white space."""
    return [[Step(also(letters(words=["finanzamt"]), starts=True)), Step(also(letters(), glued=False), optional=True, repeats=True)]]
