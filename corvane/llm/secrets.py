"""Secret scans: all rules in one pass over the bytes, by combined deterministic automata.

Rules are regular expressions over bytes.  Each becomes an automaton with
empty moves; subset construction over their union and minimisation give one
transition array.  The rules read backwards make the automaton that passes over
every text once, from its end, the texts of a chunk side by side: an accepting
state says which rules' matches begin at that byte.  From these places alone a second
automaton, of all rules read forwards, goes to the matches' ends.  No place is
read twice in vain: a state and place from which no end was reached is remembered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import chunks, flat, ids_and_texts

#: Bytes of text that are scanned side by side.
LANES_BYTES = 4 << 20


@dataclass(frozen=True)
class Rule:
    """span: what a match extends over, leftmost and longest; confirm: what it must also match from its start.

    head: what begins exactly where spans that can be confirmed do, that is, the span
    without all that may follow.  base: whether the rule is one of those whose spans
    are digested apart.
    """

    kind: str
    head: str
    span: str
    confirm: str
    base: bool = True


_KEY = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_ASSIGN = _KEY + "[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]"
_PEM = "-----BEGIN\\x20[A-Z\\x20]*PRIVATE\\x20KEY-----"
#: What follows it: all up to the first END line (with no two dashes in between), or without one
#: header lines, lines of base64 (also with line feeds written as \\n) and a last short one.
_BREAK = "([\\x09\\x0A\\x0D\\x20>]|\\\\n|\\\\r)"
_TO_END = "(-?[\\x09\\x0A\\x0D\\x20-,.-~])*-----END\\x20[A-Z\\x20]*PRIVATE\\x20KEY-----"
_BODY = f"([\\x0D\\x0A]+[A-Z][A-Za-z-]*:\\x20[\\x20-~]*)*({_BREAK}*[A-Za-z0-9+/]{{16,}}=*)+({_BREAK}+[A-Za-z0-9+/]+=*)?"
#: The rules.
RULES = (
    Rule("assign", _ASSIGN, _ASSIGN + "+", _ASSIGN + "{6,}"),
    Rule("access", "AKIA[A-Z0-9]", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}", "[0-9a-f]+", "[0-9a-f]{24,}"),
    Rule("github", "gh[opsur]_[A-Za-z0-9]", "gh[opsur]_[A-Za-z0-9]+", "gh[opsur]_[A-Za-z0-9]{20,}", False),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]", "xox[abprs]-[A-Za-z0-9-]+", "xox[abprs]-[A-Za-z0-9-]{10,}", False),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]", "eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+(\\.[A-Za-z0-9_-]+)*", "eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", False),
    Rule("pem", _PEM, f"{_PEM}({_TO_END}|{_BODY})?", _PEM, False),
)


# --- from rules to automata -----------------------------------------------


class _Machine:
    """An automaton with empty moves, built while a rule is read: literals, sets, groups, | ? * + {n,}."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[tuple[frozenset, int] | None] = []

    def node(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def add(self, rule: str, backward: bool) -> tuple[int, int]:
        self.rule, self.at = rule, 0
        tree = self._choice()
        if self.at != len(rule):
            raise ValueError(f"rule not understood at {self.at}: {rule}")
        return self._build(self._backward(tree) if backward else tree)

    def _backward(self, tree):
        kind, inner = tree
        if kind == "set":
            return tree
        if kind in "?*":
            return kind, self._backward(inner)
        return kind, [self._backward(x) for x in (reversed(inner) if kind == "row" else inner)]

    def _peek(self) -> str:
        return self.rule[self.at : self.at + 1]

    def _choice(self):
        options = [self._row()]
        while self._peek() == "|":
            self.at += 1
            options.append(self._row())
        return ("or", options) if len(options) > 1 else options[0]

    def _row(self):
        items = []
        while self._peek() not in ("", "|", ")"):
            items.append(self._repeated())
        return ("row", items)

    def _repeated(self):
        item = self._atom()
        while (c := self._peek()) and c in "?*+{":
            self.at += 1
            if c == "{":
                end = self.rule.index(",}", self.at)
                n, self.at = int(self.rule[self.at : end]), end + 2
                item = ("row", [item] * n + [("*", item)])
            else:
                item = ("row", [item, ("*", item)]) if c == "+" else (c, item)
        return item

    def _atom(self):
        c = self._peek()
        self.at += 1
        if c == "(":
            inner = self._choice()
            self.at += 1
            return inner
        if c != "[":
            return ("set", frozenset([self._char(c)]))
        chars: list[int] = []
        while (c := self._peek()) != "]":
            self.at += 1
            low = self._char(c)
            if self._peek() == "-" and self.rule[self.at + 1] != "]":
                self.at += 1
                c = self._peek()
                self.at += 1
                chars.extend(range(low, self._char(c) + 1))
            else:
                chars.append(low)
        self.at += 1
        return ("set", frozenset(chars))

    def _char(self, c: str) -> int:
        if c != "\\":
            return ord(c)
        c = self._peek()
        self.at += 1
        if c != "x":
            return ord(c)
        self.at += 2
        return int(self.rule[self.at - 2 : self.at], 16)

    def _build(self, tree) -> tuple[int, int]:
        kind, inner = tree
        first = self.node()
        if kind == "set":
            last = self.node()
            self.moves[first] = (inner, last)
        elif kind == "row":
            last = first
            for item in inner:
                a, b = self._build(item)
                self.empty[last].append(a)
                last = b
        else:
            last = self.node()
            for item in inner if kind == "or" else [inner]:
                a, b = self._build(item)
                self.empty[first].append(a)
                self.empty[b].append(last)
                if kind == "*":
                    self.empty[b].append(a)
            if kind in "?*":
                self.empty[first].append(last)
        return first, last

    def closure(self, nodes) -> frozenset:
        seen, todo = set(nodes), list(nodes)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(x for x in seen if self.moves[x] is not None or not self.empty[x])


@dataclass(frozen=True)
class Automaton:
    """step[state * 256 + byte]; accepts: a bit for each rule; the first state is 0; live: the rules that can accept further on."""

    step: np.ndarray
    accepts: np.ndarray
    live: np.ndarray


def compile_rules(rules: tuple[str, ...], anchored: bool, backward: bool = False) -> Automaton:
    """Subset construction over the union of the rules, then minimisation by splitting blocks of states.

    Unanchored, the first state's moves stay open at every byte, so that a state
    accepts wherever a match ends (or, if rules are read backwards, begins).
    """
    machine = _Machine()
    ends = {}
    firsts = []
    for k, rule in enumerate(rules):
        a, b = machine.add(rule, backward)
        firsts.append(a)
        ends[b] = k
    # bytes that no set tells apart form one class
    sets = sorted({m[0] for m in machine.moves if m}, key=sorted)
    profile: dict[tuple, int] = {}
    of_byte = np.array([profile.setdefault(tuple(c in s for s in sets), len(profile)) for c in range(256)])
    classes = len(profile)
    example = [int(np.flatnonzero(of_byte == k)[0]) for k in range(classes)]
    start = machine.closure(firsts)
    closed = [machine.closure([m[1]]) if m else None for m in machine.moves]
    index, states, rows = {start: 0}, [start], []
    for state in states:
        row = []
        for c in example:
            to = set(start) if not anchored else set()
            for x in state:
                if (m := machine.moves[x]) and c in m[0]:
                    to |= closed[x]
            to = frozenset(to)
            if to not in index:
                index[to] = len(states)
                states.append(to)
            row.append(index[to])
        rows.append(row)
    step = np.array(rows)
    accepts = np.array([sum(1 << ends[x] for x in s if x in ends) for s in states])
    block = np.unique(accepts, return_inverse=True)[1]
    while True:  # blocks split until equal states only share one
        finer = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    order = np.full(block.max() + 1, -1)
    order[block[0]] = 0
    rest = [b for b in range(block.max() + 1) if b != block[0]]
    order[rest] = np.arange(1, len(rest) + 1)
    block = order[block]
    picked = np.unique(block, return_index=True)[1]
    small, kinds = block[step[picked]], accepts[picked]
    live = np.zeros(len(small), np.int64)
    while ((more := np.bitwise_or.reduce((kinds | live)[small], axis=1)) != live).any():
        live = more
    return Automaton(small[:, of_byte].astype(np.int32).ravel(), kinds.astype(np.int64), live)


@lru_cache(8)
def _compiled(rules: tuple[Rule, ...]) -> tuple[Automaton, tuple[list, list, list]]:
    """The automaton that passes over texts from their ends, and the one that finds ends; of it, rule k's span has bit 2k and its confirm bit 2k + 1."""
    ends = compile_rules(tuple(x for r in rules for x in (r.span, r.confirm)), True)
    return compile_rules(tuple(r.head for r in rules), False, True), (ends.step.tolist(), ends.accepts.tolist(), ends.live.tolist())


# --- scanning -------------------------------------------------------------


def starts(data: np.ndarray, at: np.ndarray, automaton: Automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where matches begin: text, place in data and the rules' bits, in ascending order, from one pass backwards.

    Long texts are first: in every step the texts that go on are a prefix.
    """
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    size, end = size[order], at[1:][order] - 1
    state = np.zeros(len(size), np.int32)
    step, accepts = automaton.step, automaton.accepts
    marks = accepts != 0
    longest = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(longest), side="left")
    few = int(np.searchsorted(-alive, -8, side="left"))  # from there on too few texts go on for array steps to pay
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3]
    for k in range(few):
        n = alive[k]
        if n < len(state):
            state, end = state[:n], end[:n]
        state = step[(state << 8) + data[end - k]]
        if marks[state].any():
            here = np.flatnonzero(marks[state])
            found.append((order[here], end[here] - k, accepts[state[here]]))
    for t in range(int(alive[few]) if few < longest else 0):
        s, steps, kinds = int(state[t]), *_lists(automaton)
        first, own = int(end[t] - size[t] + 1), []
        for place, c in zip(range(int(end[t]) - few, first - 1, -1), reversed(data[first : end[t] + 1 - few].tobytes())):
            s = steps[(s << 8) + c]
            if kinds[s]:
                own.append((order[t], place, kinds[s]))
        if own:
            found.append(tuple(np.array(x, np.int64) for x in zip(*own)))
    text, place, kinds = (np.concatenate(x) for x in zip(*found))
    up = np.argsort(place)
    return text[up], place[up], kinds[up]


_AS_LISTS: dict[int, tuple] = {}


def _lists(automaton: Automaton) -> tuple:
    if id(automaton) not in _AS_LISTS:
        _AS_LISTS[id(automaton)] = (automaton.step.tolist(), automaton.accepts.tolist(), automaton)
    return _AS_LISTS[id(automaton)][:2]


#: Places at which a state that led nowhere is remembered.
EVERY = 64


def spans(text: bytes, found: list[tuple[int, int]], rules: tuple[Rule, ...]) -> list[tuple[int, int, int]]:
    """(start, rule, end) in bytes, by start and then rule: leftmost, longest, not overlapping within a rule.

    found: (place, rules' bits) where matches begin, ascending.
    """
    step, accepts, live = _compiled(rules)[1]
    states = len(accepts)
    out, free, nowhere = [], [0] * len(rules), [set() for _ in rules]
    for a, kinds in found:
        for k in range(len(rules)):
            if not kinds >> k & 1 or a < free[k]:
                continue
            bit, state, end, sure, passed = 1 << 2 * k, 0, a, False, []
            for j in range(a, len(text)):
                state = step[(state << 8) + text[j]]
                if (hit := accepts[state]) & bit:
                    end, passed = j + 1, []
                    sure = sure or hit & bit << 1 != 0
                if not live[state] & bit:
                    break
                if not j % EVERY:
                    if (here := j * states + state) in nowhere[k]:
                        break
                    passed.append(here)
            nowhere[k].update(passed)
            free[k] = end
            if sure:
                out.append((a, k, end))
    return out


def spans_by_text(data: np.ndarray, at: np.ndarray, rules: tuple[Rule, ...]) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """The spans of every text that has any, in bytes of the text."""
    text, place, kinds = starts(data, at, _compiled(rules)[0])
    edges = np.flatnonzero(np.diff(text, prepend=-1, append=-1)) if len(text) else np.zeros(0, int)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        t = int(text[a])
        if found := spans(data[at[t] : at[t + 1]].tobytes(), [*zip((place[a:b] - at[t]).tolist(), kinds[a:b].tolist())], rules):
            yield t, found


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>> in code points, end exclusive, by start and then by the rules' order.

    One row for each row in.  Null and empty texts, and texts without a match,
    have an empty array.  Repeated rows are scanned each for itself; a very long text
    is scanned whole, in time that grows with its length.  An empty table gives no rows.
    Other columns are not read, so their names can't clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, limit=LANES_BYTES):
                data, at = flat(part.column("text"))
                rows: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for t, found in spans_by_text(data, at, rules):
                    point = np.zeros(at[t + 1] - at[t] + 1, np.int64)
                    np.cumsum((data[at[t] : at[t + 1]] & 0xC0) != 0x80, out=point[1:])
                    rows[t] = [{"kind": rules[k].kind, "start": int(point[a]), "end": int(point[b])} for a, k, b in found]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

    return ids_and_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def digests(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the counts of the base kinds, base_sha256, and all spans as text."""
    base = [r.kind for r in rules if r.base]
    said = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    found = scan(docs, rules)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in base]
    return found.select("doc_id", *counts, F.sha2(said(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, with mark in place of every span; touching or overlapping spans share one mark.

    A null text stays null.  A column n_chars, if there is one, follows the new text.
    """
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = mark.encode()
        for batch in batches:
            for part in chunks(batch, text_col, LANES_BYTES):
                data, at = flat(part.column(text_col))
                if found := [*spans_by_text(data, at, rules)]:
                    texts = part.column(text_col).to_pylist()
                    for t, own_spans in found:
                        own, pieces, free = data[at[t] : at[t + 1]].tobytes(), [], 0
                        for a, _, b in own_spans:
                            if a > free or not pieces:
                                pieces += [own[free:a], sign]
                            free = max(free, b)
                        texts[t] = b"".join([*pieces, own[free:]]).decode()
                    columns = [pa.array(texts, f.type) if f.name == text_col else pa.array([n if x is None else len(x) for n, x in zip(part.column("n_chars").to_pylist(), texts)], f.type) if f.name == "n_chars" else part.column(f.name) for f in part.schema]
                    part = pa.RecordBatch.from_arrays(columns, schema=part.schema)
                yield part

    return docs.mapInArrow(run, schema)
