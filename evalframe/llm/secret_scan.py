"""Secret scans (operator 3): all rules as one minimal deterministic automaton.

Each rule has a pattern; how long a match must be is a check of its own, since
counted repeats that run side by side multiply an automaton's states. The
patterns of all rules become one automaton for "anything, then a match":
positions of the parsed patterns, then subset construction over byte classes,
then minimisation by partition refinement. The result is one transition array,
and each byte of a text is looked up once for all rules.

The states that a text goes through give the spans: a rule's accepting states
in a row are the last part of its matches, and enough of them in a row make a
match long enough. The first state means that no match is under way, so between
two of these lies all that decides where the match began; there the rule's
pattern finds its exact bounds, leftmost and without overlap. No other part of a
text is looked at again.

The array is applied to many pieces of text in step. Pieces begin at the start
of a text or behind a byte that leads from every state to the first one, so
each piece starts in a known state and no match can cross it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as sre
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evalframe.llm.textblocks import Block, blocks


@dataclass(frozen=True)
class Rule:
    """A kind of secret, whose ``pattern`` ends with a repeated class.

    ``least``: of a match's group (or all of it, 0), so many characters at least; ``tail``: of its last class, so many.
    """

    kind: str
    pattern: bytes
    group: int = 0
    least: int = 0
    tail: int = 1
    fold: bool = False


#: The first three are the contract's, the others are public formats of credentials.
_ASSIGN = rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
RULES = (
    Rule("assign", _ASSIGN + rb"([A-Za-z0-9+/_.=-]+)", 2, 8, 8, True),
    Rule("access", rb"AKIA[A-Z0-9]+", 0, 16, 12),
    Rule("hex", rb"[0-9a-f]+", 0, 32, 32),
    Rule("github", rb"gh[pousr]_[A-Za-z0-9]+", 0, 40, 36),
    Rule("slack", rb"xox[abprs]-[A-Za-z0-9-]+", 0, 15, 10),
    Rule("google", rb"AIza[0-9A-Za-z_-]+", 0, 39, 35),
    Rule("stripe", rb"sk_live_[0-9A-Za-z]+", 0, 24, 16),
    Rule("jwt", rb"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 32, 8),
    Rule("private_key", rb"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
)
BASE = ("assign", "access", "hex")


class _Positions:
    """A nondeterministic automaton: of each position, the bytes that it takes and the positions that may follow."""

    def __init__(self) -> None:
        self.takes: list[np.ndarray] = []
        self.follow: list[set[int]] = []

    def add(self, parsed, fold: bool) -> tuple[set[int], set[int], bool]:
        """First and last positions of a parsed sequence, and whether it can be empty."""
        first: set[int] = set()
        last: set[int] = set()
        empty = True
        for op, arg in parsed:
            f, e, skip = self._item(op, arg, fold)
            for p in last:
                self.follow[p] |= f
            first |= f if empty else set()
            last = e | (last if skip else set())
            empty = empty and skip
        return first, last, empty

    def _item(self, op, arg, fold: bool) -> tuple[set[int], set[int], bool]:
        if op is sre.SUBPATTERN:
            return self.add(arg[-1], fold)
        if op is sre.BRANCH:
            parts = [self.add(x, fold) for x in arg[1]]
            return set().union(*(p[0] for p in parts)), set().union(*(p[1] for p in parts)), any(p[2] for p in parts)
        if op is sre.MAX_REPEAT:
            low, high, item = arg
            if high is sre.MAXREPEAT:
                copies = [self.add(item, fold) for _ in range(max(low, 1))]
                for p in copies[-1][1]:
                    self.follow[p] |= copies[-1][0]
                if low == 0:
                    copies[-1] = (*copies[-1][:2], True)
            else:
                copies = [self.add(item, fold) for _ in range(low)] + [(*self.add(item, fold)[:2], True) for _ in range(high - low)]
            first, last, empty = set(), set(), True
            for f, e, skip in copies:
                for p in last:
                    self.follow[p] |= f
                first |= f if empty else set()
                last = e | (last if skip else set())
                empty = empty and skip
            return first, last, empty
        takes = np.zeros(256, bool)
        if op is sre.LITERAL:
            takes[arg] = True
        elif op is sre.IN:
            for kind, x in arg:
                if kind is sre.LITERAL:
                    takes[x] = True
                elif kind is sre.RANGE:
                    takes[x[0] : x[1] + 1] = True
                elif kind is not sre.NEGATE:
                    raise ValueError(f"pattern part not supported: {kind}")
            if arg[0][0] is sre.NEGATE:
                takes = ~takes
        else:
            raise ValueError(f"pattern part not supported: {op}")
        if fold:
            for upper in range(65, 91):
                takes[[upper, upper + 32]] = takes[upper] or takes[upper + 32]
        self.takes.append(takes)
        self.follow.append(set())
        return {len(self.takes) - 1}, {len(self.takes) - 1}, False


@dataclass(frozen=True)
class Automaton:
    """``step[state + code]`` is the next state, states being multiples of the number of byte classes.

    States from ``accepting`` on have ended a match; ``found`` has their rules as bits. A byte with
    ``resets`` leads from every state to state 0, in which no match is under way.
    """

    code: np.ndarray
    step: np.ndarray
    accepting: int
    found: np.ndarray
    resets: np.ndarray
    width: int

    @property
    def states(self) -> int:
        return len(self.step) // self.width


@lru_cache(maxsize=4)
def compile_rules(rules: tuple[Rule, ...] = RULES) -> Automaton:
    """The minimal automaton of all patterns."""
    nfa, starts, ends = _Positions(), set(), {}
    for i, rule in enumerate(rules):
        first, last, empty = nfa.add(_parser.parse(rule.pattern), rule.fold)
        if empty:
            raise ValueError(f"the pattern of {rule.kind} matches nothing")
        starts |= first
        for p in last:
            ends[p] = ends.get(p, 0) | 1 << i
    takes = np.array(nfa.takes)
    columns, code = np.unique(takes, axis=1, return_inverse=True)
    code, width = code.ravel(), columns.shape[1]
    allowed = [frozenset(np.flatnonzero(columns[:, c]).tolist()) for c in range(width)]
    # a state is the set of positions just taken; it always may start anew
    ids, todo, table = {frozenset(): 0}, [frozenset()], []
    for state in todo:
        reach = set(starts).union(*(nfa.follow[p] for p in state))
        row = []
        for c in range(width):
            to = frozenset(reach & allowed[c])
            if to not in ids:
                ids[to] = len(ids)
                todo.append(to)
            row.append(ids[to])
        table.append(row)
    step = np.array(table, np.int64)
    found = np.zeros(len(todo), np.int64)
    for i, state in enumerate(todo):
        for p in state:
            found[i] |= ends.get(p, 0)
    # states are alike if they find the same and lead to states that are alike
    part, parts = np.unique(found, return_inverse=True)[1].ravel(), 0
    while part.max() + 1 > parts:
        parts = part.max() + 1
        part = np.unique(np.column_stack([part, part[step]]), axis=0, return_inverse=True)[1].ravel()
    of = np.zeros(parts, np.int64)
    of[part] = np.arange(len(part))
    found, step, start = found[of], part[step[of]], part[0]
    order = np.lexsort([np.arange(parts) != start, found != 0])  # the first state first, accepting ones last
    place = np.empty(parts, np.int64)
    place[order] = np.arange(parts)
    step, found = place[step[order]], found[order]
    resets = (step == 0).all(axis=0)[code]
    accepting = int(np.argmax(found != 0))
    return Automaton(code.astype(np.uint8), (step * width).astype(np.int32).ravel(), accepting * width, found, resets, width)


PIECE = 512
#: How often a block's pieces are run anew from a state that outlasts a whole piece.
CARRIED = 8


def _rerun(out: np.ndarray, code: np.ndarray, dfa: Automaton, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Runs pieces from other states until each meets the state that is already there; which ones never did."""
    live, at, state, never = np.arange(len(start)), start.copy(), state.copy(), np.zeros(len(start), bool)
    while len(live):
        here = at[live]
        s = dfa.step[state[live] + code[here]]
        met = out[here] == s
        out[here] = state[live] = s
        at[live] += 1
        ended = at[live] >= end[live]
        never[live[ended & ~met]] = True
        live = live[~met & ~ended]
    return never


def scan_block(b: Block, dfa: Automaton) -> np.ndarray:
    """The automaton's state after each byte of a block, texts beginning in the first one.

    Pieces begin behind bytes that reset every state. Where there is none for long, they are cut anyway, begun in the first
    state, and their heads run anew from the true state until both agree, which they soon do but in a match that goes on.
    """
    out = np.zeros(len(b.data), np.int32)
    if not len(b.data):
        return out
    code = dfa.code[b.data]
    behind = np.flatnonzero(dfa.resets[b.data]) + 1
    at = np.searchsorted(behind, np.arange(PIECE, len(b.data), PIECE))
    start = np.unique(np.concatenate([b.start[b.end > b.start], behind[at[at < len(behind)]]]))
    start = start[start < len(b.data)]
    length = np.diff(np.append(start, len(b.data)))
    cuts = np.maximum(1, length // (2 * PIECE))  # of pieces that are longer than most: parts of two to four pieces' length
    sure = np.repeat(np.arange(len(start)), cuts)
    part = np.arange(len(sure)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    start, known = start[sure] + part * 2 * PIECE, part == 0
    end = np.append(start[1:], len(b.data))
    length = end - start
    order = np.argsort(-length, kind="stable")
    going = np.searchsorted(-length[order], -np.arange(length.max()), side="left")
    state, at = np.zeros(len(start), np.int32), start[order]
    for n in going.tolist():
        s = dfa.step[state[:n] + code[at[:n]]]
        state[:n] = s
        out[at[:n]] = s
        at[:n] += 1
    cut, begun, carried = np.flatnonzero(~known), np.zeros(len(start), np.int32), 0
    while len(wrong := cut[out[start[cut] - 1] != begun[cut]]):
        begun[wrong] = out[start[wrong] - 1]
        lost = wrong[_rerun(out, code, dfa, start[wrong], end[wrong], begun[wrong])]
        if len(lost) and carried < CARRIED:
            # such a state may last on: all that follows without a reset is run from it
            carried += 1
            lost = lost[np.unique(sure[lost], return_index=True)[1]]
            until = np.searchsorted(sure, sure[lost], side="right")
            n = until - lost - 1
            after = np.repeat(lost + 1, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            begun[after] = np.repeat(out[end[lost] - 1], n)
            _rerun(out, code, dfa, start[after], end[after], begun[after])
    return out


@lru_cache(maxsize=4)
def _patterns(rules: tuple[Rule, ...]) -> list[re.Pattern]:
    return [re.compile(r.pattern, re.IGNORECASE if r.fold else 0) for r in rules]


def matches(b: Block, dfa: Automaton, rules: tuple[Rule, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rule and range of the block around each run of a rule's accepting states that is long enough.

    A range goes from one first state to the next, within one text, so it holds whole matches and all of a match.
    """
    state = scan_block(b, dfa)
    accepts = np.zeros(len(dfa.step), np.int64)
    accepts[:: dfa.width] = dfa.found
    bits = accepts[state]
    edge = np.zeros(len(state) + 1, bool)
    edge[b.start] = edge[b.end] = True
    idle = np.flatnonzero((state == 0) | edge[1:])  # after these bytes no match is under way
    which, first, last = [], [], []
    for i, rule in enumerate(rules):
        on = (bits >> i & 1).astype(bool)
        change = np.flatnonzero(np.append(True, (on[1:] != on[:-1]) | edge[1:-1])) if len(on) else np.zeros(0, np.int64)
        size = np.diff(np.append(change, len(on)))
        kept = on[change] & (size >= rule.tail) if len(on) else np.zeros(0, bool)
        lo, hi = change[kept], change[kept] + size[kept]
        before = np.searchsorted(idle, lo) - 1
        lo = np.where(before >= 0, idle[before] + 1, 0) if len(idle) else lo
        hi = idle[np.searchsorted(idle, hi - 1)] + 1
        ranges = np.unique(np.column_stack([lo, hi]), axis=0)
        which.append(np.full(len(ranges), i))
        first.append(ranges[:, 0])
        last.append(ranges[:, 1])
    return np.concatenate(which), np.concatenate(first), np.concatenate(last)


def _each(column: pa.Array, rules: tuple[Rule, ...]) -> Iterator[tuple[Block, int, list[tuple[int, int, int]]]]:
    """Each text of a column with its (start, end, rule) in bytes, by start and rule."""
    dfa, patterns = compile_rules(rules), _patterns(rules)
    for b in blocks(column):
        found: dict[int, list[tuple[int, int, int]]] = {}
        which, first, last = matches(b, dfa, rules)
        owner = np.searchsorted(b.end, first, side="right")
        for k, lo, hi, i in zip(which.tolist(), first.tolist(), last.tolist(), owner.tolist()):
            g, least, base = rules[k].group, rules[k].least, lo - int(b.start[i])
            for m in patterns[k].finditer(b.data[lo:hi].tobytes()):
                if m.end(g) - m.start(g) >= least:
                    found.setdefault(i, []).append((base + m.start(), base + m.end(), k))
        for i in range(len(b)):
            yield b, i, sorted(found[i], key=lambda x: (x[0], x[2])) if i in found else []


def _points(raw: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not spans or raw.isascii():
        return spans
    to = np.append(0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))
    return [(int(to[a]), int(to[e]), i) for a, e, i in spans]


def _scanned(rules: tuple[Rule, ...]):
    base = [i for i, r in enumerate(rules) if r.kind in BASE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.schema.get_field_index("text")
            rest = [(f.name, batch.column(i)) for i, f in enumerate(batch.schema) if i != text]
            counts: dict[int, list[int]] = {i: [] for i in base}
            shas, joined = [], []
            none = hashlib.sha256(b"").hexdigest()
            for b, i, spans in _each(batch.column(text), rules):
                spans = _points(b.data[b.start[i] : b.end[i]].tobytes(), spans) if spans else spans
                for k in base:
                    counts[k].append(sum(x[2] == k for x in spans))
                said = [f"{rules[k].kind}:{a}:{e}" for a, e, k in spans]
                own = ",".join(s for s, x in zip(said, spans) if x[2] in counts)
                shas.append(hashlib.sha256(own.encode()).hexdigest() if own else none)
                joined.append(",".join(said))
            yield pa.RecordBatch.from_arrays([c for _, c in rest] + [pa.array(counts[k], pa.int64()) for k in base] + [pa.array(shas, pa.string()), pa.array(joined, pa.string())], [n for n, _ in rest] + [f"n_{rules[k].kind}" for k in base] + ["base_sha256", "spans"])

    return run


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Spans of secrets in every whole text: counts and digest of the base kinds, and all spans.

    A null text is an empty one and has no spans. Repeated rows are scanned alike; extra columns are not
    returned; an empty table gives an empty result. Spans are ``kind:start:end`` in code points, by start, then by
    the order of the rules.
    """
    kinds = "".join(f", n_{r.kind} bigint" for r in rules if r.kind in BASE)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scanned(rules), f"doc_id {kind}{kinds}, base_sha256 string, spans string")


def _redacted(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.schema.get_field_index("text")
            texts = batch.column(column).to_pylist()
            row = 0
            for b, i, spans in _each(batch.column(column), rules):
                if spans:
                    raw, parts, done = b.data[b.start[i] : b.end[i]].tobytes(), [], 0
                    for a, e, k in spans:
                        if a >= done:
                            parts += [raw[done:a], f"<{rules[k].kind}>".encode()]
                        done = max(done, e)
                    texts[row] = b"".join([*parts, raw[done:]]).decode()
                row += 1
            columns = batch.columns
            columns[column] = pa.array(texts, batch.schema.field(column).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return run


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The same rows and columns with every span of ``text`` replaced by its kind in angle brackets.

    Overlapping spans become one mark, of the span that starts first. Null texts stay null; repeated rows stay; an
    empty table gives an empty result. Other columns, whatever their names, are returned as they are.
    """
    return docs.mapInArrow(_redacted(rules), docs.schema)
