"""Secret scans with one combined deterministic automaton.

All rule expressions are compiled together: each becomes a byte-level NFA, their union (with a free prefix, so that a
match may begin anywhere) goes through subset construction and minimisation into one transition array, and a text is
scanned once, byte by byte, for all rules. Where the automaton reports that some rule has a match ending here, the
rule's reversed automaton walks back to the leftmost start and its own forward automaton on to the longest end.

The work is one narrow map over the documents: no shuffle, no state between texts.

Defined results: null and empty texts have no spans; repeated rows each get theirs; ids are carried as they are, null
included; other columns are left alone (``scan`` adds ``spans``, replacing a column of that name).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from re import _constants as K
from re import _parser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import sliced


class Rule(NamedTuple):
    """``least``: a match counts if this group (0: all of it) has so many characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    ignore_case: bool = False
    base: bool = False


# The rules, base ones first; this order breaks ties between spans that start together.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, False, True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, False, True),
    Rule("forge", r"gh[opsru]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("cloud", r"AIza[0-9A-Za-z_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


class Nfa:
    """Thompson construction over bytes; ``back`` builds the automaton of the reversed language."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.edges: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.edges.append([])
        return len(self.empty) - 1

    def build(self, items, at: int, fold: bool, back: bool) -> int:
        for op, arg in reversed(list(items)) if back else items:
            at = self.piece(op, arg, at, fold, back)
        return at

    def piece(self, op, arg, at: int, fold: bool, back: bool) -> int:
        if op is K.LITERAL:
            return self.step(at, {arg}, fold)
        if op is K.IN:
            return self.step(at, _members(arg), fold)
        if op is K.SUBPATTERN:
            return self.build(arg[3], at, fold, back)
        if op is K.BRANCH:
            end = self.state()
            for branch in arg[1]:
                start = self.state()
                self.empty[at].append(start)
                self.empty[self.build(branch, start, fold, back)].append(end)
            return end
        if op is K.MAX_REPEAT:
            low, high, body = arg
            for _ in range(low):
                at = self.build(body, at, fold, back)
            if high is K.MAXREPEAT:
                loop, end = self.state(), self.state()
                self.empty[at] += [loop, end]
                self.empty[self.build(body, loop, fold, back)] += [loop, end]
                return end
            end = self.state()
            for _ in range(high - low):
                self.empty[at].append(end)
                at = self.build(body, at, fold, back)
            self.empty[at].append(end)
            return end
        raise ValueError(f"rules may not use {op}")

    def step(self, at: int, codes: set[int], fold: bool) -> int:
        if fold:
            codes = {ord(y) for c in codes for y in (chr(c).lower(), chr(c).upper())}
        if max(codes) > 127:
            raise ValueError("rules are written in ASCII")
        to = self.state()
        self.edges[at].append((frozenset(codes), to))
        return to

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


def _members(arg) -> set[int]:
    out: set[int] = set()
    for op, x in arg:
        if op is K.LITERAL:
            out.add(x)
        elif op is K.RANGE:
            out |= set(range(x[0], x[1] + 1))
        else:
            raise ValueError(f"rules may not use {op} in a set")
    return out


def _shortest(items) -> list:
    """The expression with a closing ``x+`` cut to ``x``: it ends where the first match ends, which is all that the
    combined automaton has to tell, and a value being read then costs it no states."""
    *head, (op, arg) = items
    if op is K.SUBPATTERN:
        arg = (*arg[:3], _shortest(arg[3]))
    elif op is K.MAX_REPEAT and arg[1] is K.MAXREPEAT and arg[0] > 0:
        arg = (arg[0], arg[0], arg[2])
    return [*head, (op, arg)]


class Dfa(NamedTuple):
    """``step[state * 256 + byte]`` is the next state times 256; states from ``first`` on accept ``rules[state]``.
    An anchored automaton's dead state is ``dead``."""

    step: list[int]
    start: int
    first: int
    rules: list[tuple[int, ...]]
    dead: int


def _determinise(nfa: Nfa, start: int, ends: dict[int, int], free: bool) -> Dfa:
    """Subset construction (free: a match may begin at any byte), then minimisation by partition refinement."""
    begin = nfa.closure([start])
    seen, rows, queue = {begin: 0}, [], [begin]
    for subset in queue:
        moves: list[set[int]] = [set() for _ in range(256)]
        for s in subset:
            for codes, to in nfa.edges[s]:
                for c in codes:
                    moves[c].add(to)
        row = []
        for m in moves:
            nxt = nfa.closure(m) | begin if free else nfa.closure(m)
            if nxt not in seen:
                seen[nxt] = len(queue)
                queue.append(nxt)
            row.append(seen[nxt])
        rows.append(row)
    accepts = [tuple(sorted({ends[s] for s in subset if s in ends})) for subset in queue]
    block, count = [0] * len(rows), 0
    keys = {}
    block = [keys.setdefault(a, len(keys)) for a in accepts]
    while count != len(keys):
        count, keys = len(keys), {}
        block = [keys.setdefault((b, *[block[t] for t in row]), len(keys)) for b, row in zip(block, rows, strict=True)]
    sample = {b: i for i, b in reversed(list(enumerate(block)))}
    order = sorted(sample, key=lambda b: (bool(accepts[sample[b]]), sample[b]))
    place = {b: n for n, b in enumerate(order)}
    step = [place[block[t]] * 256 for b in order for t in rows[sample[b]]]
    rules = [accepts[sample[b]] for b in order]
    first = sum(not r for r in rules)
    empty = seen.get(frozenset())
    return Dfa(step, place[block[0]] * 256, first * 256, rules, place[block[empty]] * 256 if empty is not None and not free else -1)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        parsed = [_parser.parse(r.pattern) for r in rules]
        union, start, ends = Nfa(), 0, {}
        start = union.state()
        for n, (rule, tree) in enumerate(zip(rules, parsed, strict=True)):
            own = union.state()
            union.empty[start].append(own)
            ends[union.build(_shortest(tree), own, rule.ignore_case, False)] = n
        self.all = _determinise(union, start, ends, True)
        self.forward = [self._own(r, t, False) for r, t in zip(rules, parsed, strict=True)]
        self.backward = [self._own(r, t, True) for r, t in zip(rules, parsed, strict=True)]
        self.whole = [re.compile(r.pattern.encode(), re.IGNORECASE if r.ignore_case else 0) for r in rules]

    @staticmethod
    def _own(rule: Rule, tree, back: bool) -> Dfa:
        nfa = Nfa()
        start = nfa.state()
        return _determinise(nfa, start, {nfa.build(tree, start, rule.ignore_case, back): 0}, False)

    @staticmethod
    def _longest(dfa: Dfa, data: bytes, places) -> int | None:
        step, s, first, dead, last = dfa.step, dfa.start, dfa.first, dfa.dead, None
        for i in places:
            s = step[s + data[i]]
            if s == dead:
                break
            if s >= first:
                last = i
        return last

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, end exclusive, by start and then by the order of the rules."""
        data = text.encode("utf-8", "replace")
        step, first, accepting = self.all.step, self.all.first, self.all.rules
        done, found, s = [0] * len(self.rules), [], self.all.start
        for i, byte in enumerate(data):
            s = step[s + byte]
            if s >= first:
                for n in accepting[s >> 8]:
                    if i >= done[n]:
                        begin = self._longest(self.backward[n], data, range(i, done[n] - 1, -1))
                        if begin is None:
                            continue
                        end = self._longest(self.forward[n], data, range(begin, len(data))) + 1
                        done[n] = end
                        rule = self.rules[n]
                        if end - begin >= rule.least and (not rule.group or len(self.whole[n].fullmatch(data, begin, end)[rule.group]) >= rule.least):
                            found.append((begin, n, end))
        if not found:
            return []
        found.sort()
        if len(data) == len(text):
            return [(self.rules[n].kind, b, e) for b, n, e in found]
        out, at, chars = [], 0, 0
        for b, n, e in found:  # spans hold ASCII only: their length is the same in code points
            chars += len(data[at:b].decode("utf-8", "replace"))
            at = b
            out.append((self.rules[n].kind, chars, chars + e - b))
        return out


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    """One compiled scanner for each Python worker."""
    return Scanner(rules)


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def scan(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with ``spans``: every secret of the text, by start and then by the order of the rules."""

    @F.pandas_udf(SPANS)
    def spans_of(texts):
        import pandas as pd

        find = scanner(rules).spans
        return pd.Series([[{"kind": k, "start": b, "end": e} for k, b, e in find(t)] if t else [] for t in texts], dtype=object)

    return df.withColumn("spans", spans_of(F.col(f"`{text}`")))


def redact(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with every secret of the text replaced by ``[kind]``; overlapping spans go as one, under the first's kind.
    Texts without a secret, null included, stay as they are."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = scanner(rules).spans
        for batch in sliced(batches):
            at = batch.schema.get_field_index(text)
            clear = pa.array([_redact(t, find(t)) if t else t for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([clear if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return df.mapInArrow(rows, df.schema)


def _redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, b, e in spans:
        if b >= at:
            out += [text[at:b], f"[{kind}]"]
        at = max(at, e)
    return "".join([*out, text[at:]]) if spans else text


def digest(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each document: counts by base kind, the digest of the base spans, and all spans as text."""
    base = [r.kind for r in rules if r.base]
    schema = "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in base) + ", base_sha256 string, spans string"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = scanner(rules).spans
        for batch in sliced(batches):
            found = [find(t) if t else [] for t in batch.column("text").to_pylist()]
            own = [[x for x in s if x[0] in base] for s in found]
            joined = [",".join(f"{k}:{b}:{e}" for k, b, e in s) for s in own]
            columns = [batch.column("doc_id").cast(pa.int64())]
            columns += [pa.array([sum(x[0] == k for x in s) for s in own], pa.int64()) for k in base]
            columns += [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in joined], pa.string()), pa.array([",".join(f"{k}:{b}:{e}" for k, b, e in s) for s in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *[f"n_{k}" for k in base], "base_sha256", "spans"])

    return df.select("doc_id", "text").mapInArrow(rows, schema)
