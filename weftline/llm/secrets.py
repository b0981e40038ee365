"""Operator 8: secret scan with one deterministic automaton for all rules.

The rules' regexes are parsed to an NFA, made deterministic by subset construction over byte classes, minimised
by partition refinement and kept as transition arrays. The state of the combined automaton says for which rules a
match of sufficient length ends at a byte. No rule's head matches a line end, so at a line end the automaton is in
its start state; a byte that UTF-8 never uses parts the documents. The base kinds stand in it in full. Of the other
rules it knows ``sign``, which each match holds: with their long counts the states would be the product of all
counts (the construction had not ended after two minutes); their own automata then decide.

Scan. The bytes of a batch are cut into lanes that advance together, one numpy gather a step: one pass for all
rules. A lane starts in the start state; where the lane before it ended in another state, the lane's first bytes
run again until both runs agree, so the states are those of a single sequential pass. In lines in which a rule
accepts, that rule's own automata give the leftmost non-overlapping spans: one for the reversed regex, run backwards,
marks all starts, and an anchored one goes from a start to the furthest end. Lines without an accepting state are
never looked at again. The work is linear in a text's length, whatever it holds.

Edge cases: a null text is empty; spans count code points; a match too short for its rule is dropped, and what it
covers is not searched again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

from .common import freed, table
from .wordhash import chunks, text_bytes


@dataclass(frozen=True)
class Rule:
    """``pattern`` gives the spans; those stay that ``kept``, the same with the least lengths, matches too.

    ``sign`` is what the combined automaton looks for: ``kept``, or a part that each match holds. ``tail`` goes on
    from a span's end, over line ends.
    """

    kind: str
    pattern: str
    kept: str
    sign: str
    tail: str = ""


def _either(words: str) -> str:
    """A word's letters in either case."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in words)


def _long(kind: str, pattern: str, least: int, sign: str = "") -> Rule:
    """A rule whose pattern ends in a class with ``+``, of which a match must have ``least`` characters."""
    kept = f"{pattern[:-1]}{{{least},}}"
    return Rule(kind, pattern, kept, sign or kept)


_KEYS = "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either("api") + "_?" + _either("key")
_GLUE = r"""["']?\x20*[:=]\x20*["']?"""
BASE = (
    _long("assign", f"({_KEYS}){_GLUE}[A-Za-z0-9+/_.=-]+", 6),
    _long("access", "AKIA[A-Z0-9]+", 16),
    _long("hex", "[0-9a-f]+", 24),
)
_JWT = r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}(\.[A-Za-z0-9_-]+)?"
_PEM = "-----BEGIN [A-Z ]*PRIVATE KEY-----"
#: The rest of a key: all up to its end mark, or the lines of base64 that follow.
_PEM_REST = r"[A-Za-z0-9+/=:,\x20\x0D\x0A]*-----END [A-Z ]*PRIVATE KEY-----|([\x20\x0D]*\x0A[A-Za-z0-9+/=]{16,})*"
#: Formats of issued credentials that the base kinds miss; fixed values.
MORE = (
    _long("github", "gh[pousr]_[A-Za-z0-9]+", 36, "gh[pousr]_"),
    _long("slack", "xox[abprs]-[A-Za-z0-9-]+", 10, "xox[abprs]-"),
    _long("google", "AIza[A-Za-z0-9_-]+", 35, "AIza"),
    Rule("jwt", _JWT, _JWT, "eyJ"),
    Rule("pem", _PEM, _PEM, "PRIVATE KEY-----", _PEM_REST),
)
RULES = BASE + MORE
#: Parts documents; not in any UTF-8 text.
SEPARATOR = 0xFF


# Regex to NFA: literals, classes, groups, |, ?, *, + and {n,}.


class _Nfa:
    def __init__(self):
        self.eps: list[list[int]] = []
        self.step: list[list[tuple[frozenset[int], int]]] = []
        #: The states of each counted repetition, in order.
        self.runs: dict[int, list[int]] = {}

    def state(self) -> int:
        self.eps.append([])
        self.step.append([])
        return len(self.eps) - 1

    def literal(self, chars: frozenset[int]) -> tuple[int, int]:
        a, b = self.state(), self.state()
        self.step[a].append((chars, b))
        return a, b

    def reversed(self) -> _Nfa:
        out = _Nfa()
        for _ in self.eps:
            out.state()
        for a, to in enumerate(self.eps):
            for b in to:
                out.eps[b].append(a)
        for a, to in enumerate(self.step):
            for chars, b in to:
                out.step[b].append((chars, a))
        return out


class _Parser:
    def __init__(self, source: str, nfa: _Nfa):
        self.s, self.i, self.nfa = source, 0, nfa

    def either(self) -> tuple[int, int]:
        ends = [self.chain()]
        while self.s[self.i : self.i + 1] == "|":
            self.i += 1
            ends.append(self.chain())
        if len(ends) == 1:
            return ends[0]
        a, b = self.nfa.state(), self.nfa.state()
        for x, y in ends:
            self.nfa.eps[a].append(x)
            self.nfa.eps[y].append(b)
        return a, b

    def chain(self) -> tuple[int, int]:
        a = b = self.nfa.state()
        while self.i < len(self.s) and self.s[self.i] not in "|)":
            x, y = self.repeat()
            self.nfa.eps[b].append(x)
            b = y
        return a, b

    def repeat(self) -> tuple[int, int]:
        at = self.i
        a, b = self.atom()
        what = self.s[self.i : self.i + 1]
        if what == "{":
            to = self.s.index(",}", self.i)
            n, after = int(self.s[self.i + 1 : to]), to + 2
            run, last = len(self.nfa.runs), a
            self.nfa.runs[run] = [a]
            for _ in range(n - 1):
                self.i = at
                last, y = self.atom()
                self.nfa.eps[b].append(last)
                self.nfa.runs[run].append(last)
                b = y
            self.nfa.eps[b].append(last)
            self.i = after
            return a, b
        if what and what in "?*+":
            self.i += 1
            x, y = self.nfa.state(), self.nfa.state()
            self.nfa.eps[x].append(a)
            self.nfa.eps[b].append(y)
            if what in "?*":
                self.nfa.eps[x].append(y)
            if what in "*+":
                self.nfa.eps[b].append(a)
            return x, y
        return a, b

    def atom(self) -> tuple[int, int]:
        c = self.s[self.i]
        if c == "(":
            self.i += 1
            out = self.either()
            self.i += 1
            return out
        if c == "[":
            return self.nfa.literal(self.choice())
        return self.nfa.literal(frozenset([self.char()]))

    def char(self) -> int:
        c = self.s[self.i]
        if c == "\\":
            if self.s[self.i + 1] == "x":
                self.i += 4
                return int(self.s[self.i - 2 : self.i], 16)
            self.i += 2
            return ord(self.s[self.i - 1])
        self.i += 1
        return ord(c)

    def choice(self) -> frozenset[int]:
        self.i += 1
        out: set[int] = set()
        while self.s[self.i] != "]":
            a = self.char()
            if self.s[self.i] == "-" and self.s[self.i + 1] != "]":
                self.i += 1
                out.update(range(a, self.char() + 1))
            else:
                out.add(a)
        self.i += 1
        return frozenset(out)


@dataclass(frozen=True)
class Automaton:
    """``move[state * classes + byte_class]`` is the next state times ``classes``; ``accepts[state]`` has a bit a rule.

    State 0 is the start; ``dead``, times ``classes``, is the state that nothing leaves, or -1.
    """

    byte_class: np.ndarray
    classes: int
    move: np.ndarray
    accepts: np.ndarray
    dead: int = -1

    @property
    def states(self) -> int:
        return len(self.accepts)


def _subsets(nfa: _Nfa, heads: list[int], finals: dict[int, int], *, anywhere: bool) -> Automaton:
    """The minimal automaton that says, after each byte, which finals are reached; from any byte on, or the first only."""
    closure_of: dict[int, frozenset[int]] = {}

    def closure(states) -> frozenset[int]:
        out, todo = set(), list(states)
        while todo:
            x = todo.pop()
            if x not in out:
                out.add(x)
                todo += nfa.eps[x]
        return frozenset(x for x in out if nfa.step[x] or x in finals)

    sets = {chars for to in nfa.step for chars, _ in to}
    groups: dict[tuple, int] = {}
    byte_class = np.zeros(256, dtype=np.uint8)
    samples = []
    for byte in range(256):
        own = tuple(byte in s for s in sets) if byte != SEPARATOR else ()
        if own not in groups:
            groups[own] = len(groups)
            samples.append(byte)
        byte_class[byte] = groups[own]
    count = {x: (run, i) for run, states in nfa.runs.items() for i, x in enumerate(states)}

    def furthest(states: set[int]) -> frozenset[int]:
        """Of a counted repetition's states only the furthest: where a shorter count reaches the end, a longer one has."""
        best: dict[int, int] = {}
        for x in states:
            if x in count:
                best[count[x][0]] = max(best.get(count[x][0], 0), count[x][1])
        return frozenset(x for x in states if x not in count or best[count[x][0]] == count[x][1])

    closure_heads = closure(heads)
    again = closure_heads if anywhere else frozenset()
    start = furthest(set(closure_heads))
    ids, todo, rows = {start: 0}, [start], []
    while todo:
        row = []
        now = todo.pop(0)
        for byte in samples:
            to = set(again)
            if byte != SEPARATOR:
                for x in now:
                    for chars, y in nfa.step[x]:
                        if byte in chars:
                            if y not in closure_of:
                                closure_of[y] = closure([y])
                            to |= closure_of[y]
            to = furthest(to)
            if to not in ids:
                ids[to] = len(ids)
                todo.append(to)
            row.append(ids[to])
        rows.append(row)
    move = np.array(rows, dtype=np.int64)
    accepts = np.zeros(len(ids), dtype=np.int64)
    for states, i in ids.items():
        accepts[i] = sum(bit for x, bit in finals.items() if x in states)
    part = np.unique(accepts, return_inverse=True)[1]
    while True:  # states stay together while they accept alike and move to the same parts
        new = np.unique(np.concatenate([part[:, None], part[move]], axis=1), axis=0, return_inverse=True)[1].ravel()
        if new.max() == part.max():
            break
        part = new
    order = np.full(part.max() + 1, -1)
    order[part[0]] = 0
    rest = [p for p in range(part.max() + 1) if p != part[0]]
    order[rest] = np.arange(1, len(rest) + 1)
    part = order[part]
    first = np.unique(part, return_index=True)[1]
    classes = len(samples)
    move = part[move[first]]
    dead = np.flatnonzero((move == np.arange(len(move))[:, None]).all(axis=1) & (accepts[first] == 0))
    return Automaton(byte_class, classes, (move * classes).astype(np.int32).ravel(), accepts[first], int(dead[0]) * classes if len(dead) else -1)


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Automaton:
    """The combined automaton: after each byte, the rules whose sign ends there."""
    nfa = _Nfa()
    heads, finals = [], {}
    for bit, rule in enumerate(rules):
        a, b = _Parser(rule.sign, nfa).either()
        heads.append(a)
        finals[b] = 1 << bit
    return _subsets(nfa, heads, finals, anywhere=True)


def _anchored(*patterns: str) -> Automaton:
    """From the first byte on; a bit for each pattern that matches up to a byte."""
    nfa = _Nfa()
    ends = [_Parser(p, nfa).either() for p in patterns]
    return _subsets(nfa, [a for a, _ in ends], {b: 1 << i for i, (_, b) in enumerate(ends)}, anywhere=False)


def _backwards(pattern: str) -> Automaton:
    """Over reversed bytes: accepts where a match of the pattern starts."""
    nfa = _Nfa()
    a, b = _Parser(pattern, nfa).either()
    return _subsets(nfa.reversed(), [b], {a: 1}, anywhere=True)


def run_automaton(dfa: Automaton, data: np.ndarray, width: int = 1024) -> np.ndarray:
    """The accepted rules after each byte, as from one sequential pass."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint16)
    lanes = -(-n // width)
    cls = np.zeros(lanes * width, dtype=np.int32)
    cls[:n] = dfa.byte_class[data]
    cls[n:] = dfa.byte_class[SEPARATOR]
    cls = np.ascontiguousarray(cls.reshape(lanes, width).T)
    states = np.empty((width, lanes), dtype=np.int32)
    now = np.zeros(lanes, dtype=np.int32)
    for i in range(width):
        now = dfa.move.take(now + cls[i])
        states[i] = now
    begun = np.zeros(lanes, dtype=np.int32)  # the state in which each lane's run began
    while True:
        should = np.concatenate([[0], states[-1, :-1]]).astype(np.int32)
        wrong = np.flatnonzero(should != begun)
        if not len(wrong):
            break
        begun[wrong] = should[wrong]
        now = should[wrong]
        for i in range(width):
            now = dfa.move.take(now + cls[i, wrong])
            differs = states[i, wrong] != now
            if not differs.any():
                break
            states[i, wrong] = now
            if not differs.all():  # the others have met the first run
                wrong, now = wrong[differs], now[differs]
    flags = dfa.accepts.astype(np.uint16)
    return flags[(states // dfa.classes)].T.ravel()[:n]


class _Spans:
    """A rule's own automata: leftmost non-overlapping spans in lines that hold its sign."""

    def __init__(self, rule: Rule):
        self.back = _backwards(rule.pattern)
        self.ahead = self._lists(_anchored(rule.pattern, rule.kept))
        self.tail = self._lists(_anchored(rule.tail)) if rule.tail else None

    @staticmethod
    def _lists(dfa: Automaton) -> tuple[list[int], list[int], list[int], int]:
        return dfa.byte_class.tolist(), dfa.move.tolist(), np.repeat(dfa.accepts, dfa.classes).tolist(), dfa.dead

    @staticmethod
    def _furthest(automaton: tuple, data: bytes, at: int) -> tuple[int, int]:
        """The furthest end of a match from ``at`` (or -1) and which patterns match up to it."""
        byte_class, move, accepts, dead = automaton
        state, end, which = 0, -1, 0
        while at < len(data):
            state = move[state + byte_class[data[at]]]
            if state == dead:
                break
            at += 1
            if accepts[state]:
                end, which = at, accepts[state]
        return end, which

    def find(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
        """Spans in the lines ``data[starts:ends]``, which end in a byte that no match holds."""
        n = ends - starts
        to = np.cumsum(n)
        raw = np.frombuffer(data, np.uint8)
        where = np.repeat(starts - (to - n), n) + np.arange(int(to[-1]))
        begins = where[::-1][np.flatnonzero(run_automaton(self.back, raw[where][::-1]))][::-1]
        out, free = [], 0
        for at in begins.tolist():
            if at >= free:
                free, which = self._furthest(self.ahead, data, at)
                if self.tail:
                    free = max(free, self._furthest(self.tail, data, free)[0])
                if which & 2:
                    out.append((at, free))
        return out


class Scanner:
    def __init__(self, rules: tuple[Rule, ...], dfa: Automaton):
        self.rules, self.dfa = rules, dfa
        self.own = [_Spans(r) for r in rules]

    def spans(self, column: pa.Array) -> dict[int, list[tuple[int, int, int]]]:
        """For each row with matches: (start, end, rule) in code points, by start, then rule."""
        raw, offs = text_bytes(column)
        rows = len(offs) - 1
        at = offs + np.arange(rows + 1)
        data = np.full(len(raw) + rows, SEPARATOR, dtype=np.uint8)
        keep = np.ones(len(data), dtype=bool)
        keep[at[1:] - 1] = False
        data[keep] = raw
        flags = run_automaton(self.dfa, data)
        hits = np.flatnonzero(flags)
        out: dict[int, list[tuple[int, int, int]]] = {}
        if not len(hits):
            return out
        breaks = np.flatnonzero((data == 10) | (data == SEPARATOR))
        text = data.tobytes()
        found: list[np.ndarray] = []
        for k, own in enumerate(self.own):
            mine = hits[(flags[hits] >> k & 1).astype(bool)]
            if len(mine):
                line = np.unique(np.searchsorted(breaks, mine))
                spans = own.find(text, np.where(line > 0, breaks[line - 1] + 1, 0), breaks[line] + 1)
                found.append(np.array([(a, b, k) for a, b in spans], np.int64).reshape(-1, 3))
        every = np.concatenate(found)
        doc = np.searchsorted(at, every[:, 0], side="right") - 1
        leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)])
        every[:, :2] = leads[every[:, :2]] - leads[at[doc]][:, None]
        order = np.lexsort((every[:, 2], every[:, 0], doc))
        for d, span in zip(doc[order].tolist(), every[order].tolist(), strict=True):
            out.setdefault(d, []).append(tuple(span))
        return out


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: id and its spans (kind, start, end) in text order."""
    dfa = compile_rules(rules)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules, dfa)
        for batch in batches:
            for a, b in chunks(batch.column(1)):
                found = scanner.spans(batch.column(1).slice(a, b - a))
                spans = [[{"kind": rules[k].kind, "start": s, "end": e} for s, e, k in found.get(i, ())] for i in range(b - a)]
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(spans, pa.list_(_SPAN))], ["doc_id", "spans"])

    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    return rows.mapInArrow(lambda b: freed(scan(b)), "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = {r.kind: i for i, r in enumerate(BASE)}
    joined = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    return scan_secrets(table(spark, sf_dir, "documents")).selectExpr(
        "doc_id",
        *(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long) n_{k}" for k in base),
        f"sha2(cast({joined.format("filter(spans, s -> s.kind in ('assign', 'access', 'hex'))")} as binary), 256) base_sha256",
        f"{joined.format('spans')} spans",
    )


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, with each secret's characters replaced by ``*`` in the text; clean ones stay as they are.

    n_chars stays right, since a span keeps its length.
    """
    dfa, at = compile_rules(RULES), docs.columns.index("text")

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(RULES, dfa)
        for batch in batches:
            column, found = batch.column(at), {}
            for a, b in chunks(column):
                found |= {a + d: s for d, s in scanner.spans(column.slice(a, b - a)).items()}
            if found:
                texts = column.to_pylist()
                for d, spans in found.items():
                    chars = list(texts[d])
                    for s, e, _ in spans:
                        chars[s:e] = "*" * (e - s)
                    texts[d] = "".join(chars)
                column = pa.array(texts, column.type)
            yield pa.record_batch([column if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return docs.mapInArrow(lambda b: freed(mask(b)), StructType([StructField(f.name, f.dataType) for f in docs.schema.fields]))
