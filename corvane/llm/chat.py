"""Chat formatting: roles of a transcript's lines by a hidden Markov model, then canonical turns.

States are roles, each at a turn's first line or within a turn, in one of two
styles that a transcript keeps throughout: turns with markers, and turns apart by
blank lines.  What is seen of a line are its speaker marker and a few features.
Viterbi decoding is a product of matrices in the (max, +) semiring, so a transcript is
cut into segments: each gives its matrix, the matrices of a conversation fix the
states at the cuts, and each segment is then decoded for itself.  The result is
that of one pass over the whole transcript.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


ROLES = ("system", "user", "assistant")
#: The words by which transcripts mark speakers.
MARKERS = {"system": "system|context|instructions?", "user": "user|human|customer|question|q|me", "assistant": "assistant|bot|ai|agent|answer|a|model"}
MARKED = re.compile("[#*>\\[(\\s]*(?:" + "|".join(f"(?P<{k}>{v})" for k, v in MARKERS.items()) + ")[\\])*]*\\s*[:>-]+[*]*\\s*", re.IGNORECASE)
DASH = re.compile("\\s*[-–—]\\s+")
#: Features of a line: a marker of each role, a dash, none after a blank line, none.
SYSTEM, USER, ASSISTANT, DASHED, PARAGRAPH, PLAIN = range(6)
PER_STYLE = 2 * len(ROLES)  # in a style: role * 2 + (1 within a turn)
STATES = 2 * PER_STYLE


def role_of(state: int) -> int:
    return state % PER_STYLE // 2


def _logs() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log probabilities of first states, moves and features."""
    low = 1e-4
    first, move, see = np.full(STATES, low), np.full((STATES, STATES), low * low), np.full((STATES, 6), low)
    turn = {0: (0.02, 0.9, 0.08), 1: (0.02, 0.08, 0.9), 2: (0.04, 0.9, 0.06)}
    #: a turn's first line: its role's marker, a dash, after a blank line, none of these; then lines within a turn, without a marker
    seen = {0: ((0.85, 0.10, 0.02, 0.005), (0.01, 0.09, 0.90)), PER_STYLE: ((0.25, 0.05, 0.65, 0.05), (0.01, 0.01, 0.97))}
    for style, (begins, within) in seen.items():
        first[[style, style + 2, style + 4]] = 0.3, 0.6, 0.1
        for role in range(len(ROLES)):
            new, more = style + 2 * role, style + 2 * role + 1
            see[new, [role, DASHED, PARAGRAPH, PLAIN]] = begins
            see[more, [DASHED, PARAGRAPH, PLAIN]] = within
            for s in (new, more):
                move[s, style : style + PER_STYLE : 2] = 0.6 * np.array(turn[role])
                move[s, more] = 0.4
    return tuple(np.log(x / x.sum(-1, keepdims=True)) for x in (first, move, see))


FIRST, MOVE, SEE = _logs()


def feature(line: str, after_blank: bool) -> tuple[int, str]:
    """What is seen of a line, and the line without its marker."""
    if m := MARKED.match(line):
        return {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}[m.lastgroup], line[m.end() :]
    if m := DASH.match(line):
        return DASHED, line[m.end() :]
    return (PARAGRAPH if after_blank else PLAIN), line


def transfer(seen: np.ndarray) -> np.ndarray:
    """matrix[a, b]: the best score of the segment's lines from state a before them to state b at the last; the last a is the start."""
    score = np.vstack([MOVE, FIRST]) + SEE[:, seen[0]]
    for x in seen[1:]:
        score = (score[:, :, None] + MOVE[None]).max(1) + SEE[:, x]
    return score


def decode(seen: np.ndarray, before: int | None, last: int | None) -> list[int]:
    """The best states of the lines, between the state before them (none at the start) and their last one (none: any)."""
    score = (FIRST if before is None else MOVE[before]) + SEE[:, seen[0]]
    back = []
    for x in seen[1:]:
        ways = score[:, None] + MOVE
        back.append(ways.argmax(0))
        score = ways.max(0) + SEE[:, x]
    state = int(score.argmax()) if last is None else last
    out = [state]
    for ways in reversed(back):
        state = int(ways[state])
        out.append(state)
    return out[::-1]


def observed(lines: list[str]) -> tuple[np.ndarray, list[str], list[bool]]:
    """What is seen of each line, the line without its marker, and whether it follows a blank one."""
    blank = [x.startswith("\n") for x in lines]
    seen, bare = zip(*(feature(x.removeprefix("\n"), b) for x, b in zip(lines, blank)))
    return np.array(seen), [*bare], blank


def roles(lines: list[str]) -> tuple[list[int], list[str]]:
    """The state of each line of a transcript, none of them blank, and what joined() makes of them.  A line that follows a blank one begins with a line feed."""
    seen, bare, blank = observed(lines)
    states = decode(seen, None, None)
    return states, joined(bare, blank, states)


def _cuts(matrices: list[np.ndarray]) -> list[int]:
    """The last state of each segment, by Viterbi over the segments' matrices."""
    score, back = matrices[0][STATES], []
    for m in matrices[1:]:
        ways = score[:, None] + m[:STATES]
        back.append(ways.argmax(0).astype(np.int8))
        score = ways.max(0)
    state = int(score.argmax())
    out = [state]
    for ways in reversed(back):
        state = int(ways[state])
        out.append(state)
    return out[::-1]


def joined(bare: list[str], blank: list[bool], states: list[int]) -> list[str]:
    """The lines without markers; a blank line within a turn stays, as a leading line feed."""
    return ["\n" + x if b and s % 2 else x for x, b, s in zip(bare, blank, states)]


def parse(lines: DataFrame) -> DataFrame:
    """lines: conv_id, segment, line (what lines are sorted by, segment after segment), text, no text blank.

    Returns conv_id, segment, line, state, text without its marker.  A task holds a
    segment's lines at a time, and in the step between the matrices of a conversation,
    one for each of its segments.  An empty table gives an empty one.
    """
    line = lines.schema["line"].dataType.simpleString()

    def groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]).combine_chunks() if held is not None and held.num_rows else table
            if not table.num_rows:
                continue
            where = np.column_stack([table[k].to_numpy() for k in keys])
            cut = [0, *(np.flatnonzero((where[1:] != where[:-1]).any(1)) + 1).tolist()]
            for a, b in zip(cut, cut[1:]):
                yield table.slice(a, b - a)
            held = table.slice(cut[-1])
        if held is not None and held.num_rows:
            yield held

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ("conv_id", "segment")):
            matrix = transfer(observed(t["text"].to_pylist())[0])
            yield pa.RecordBatch.from_arrays([t["conv_id"][:1].combine_chunks(), t["segment"][:1].combine_chunks(), pa.array([matrix.ravel()], pa.list_(pa.float64()))], ["conv_id", "segment", "matrix"])

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ("conv_id",)):
            ends = _cuts([np.array(x).reshape(STATES + 1, STATES) for x in t["matrix"].to_pylist()])
            yield pa.RecordBatch.from_arrays([t["conv_id"].combine_chunks(), t["segment"].combine_chunks(), pa.array([None, *ends[:-1]], pa.int32()), pa.array(ends, pa.int32())], ["conv_id", "segment", "before", "last"])

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ("conv_id", "segment")):
            seen, bare, blank = observed(t["text"].to_pylist())
            out = decode(seen, t["before"][0].as_py(), t["last"][0].as_py())
            yield pa.RecordBatch.from_arrays([t["conv_id"].combine_chunks(), t["segment"].combine_chunks(), t["line"].combine_chunks(), pa.array(out, pa.int32()), pa.array(joined(bare, blank, out), pa.string())], ["conv_id", "segment", "line", "state", "text"])

    several = lines.join(lines.groupBy("conv_id").agg(F.min("segment").alias("a"), F.max("segment").alias("b")).where("a < b").select("conv_id"), "conv_id", "left_semi")
    parts = several.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "line").mapInArrow(matrices, "conv_id long, segment long, matrix array<double>")
    ends = parts.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(cuts, "conv_id long, segment long, before int, last int")
    known = lines.join(ends, ["conv_id", "segment"], "left")
    return known.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "line").mapInArrow(states, f"conv_id long, segment long, line {line}, state int, text string")


def transcript_lines(conversations: DataFrame) -> DataFrame:
    """conv_id, segment, line, text: conversations written out as plain transcripts, by one of five habits of each.

    Habits: words of three kinds, dashes, or a word for the first turn and blank lines
    before the others.  A null or blank text has no line, nor has a row without conv_id or
    turn.  Rows of one turn follow each other by text, then role; equal rows are each
    written.  line is (turn, row, place), negative turns first; segments are runs of 32
    turns.  A line after a blank one begins with a line feed; columns other than conv_id,
    turn, role and text are not read.
    """
    role = F.coalesce(F.lower(F.trim("role")), F.lit("user"))
    words = [("System", "User", "Assistant"), ("Instructions", "Human", "AI"), ("Context", "Q", "A")]
    mark: Column = F.lit("")
    habit = F.pmod(F.xxhash64("conv_id"), F.lit(5))
    spelled = [F.when(role == "system", names[0] + ": ").when(role == "assistant", names[2] + ": ").otherwise(names[1] + ": ") for names in words]
    for k in range(3):
        mark = F.when(habit == k, spelled[k]).otherwise(mark)
    mark = F.when(habit == 3, F.when((F.col("turn") == 0) | (role == "system"), F.concat(F.lit("**"), F.initcap(role), F.lit("**: "))).otherwise(F.lit("- "))).otherwise(mark)
    mark = F.when(habit == 4, F.when(F.col("turn") == 0, spelled[0]).otherwise(F.lit("\n"))).otherwise(mark)
    blank = lambda x: F.trim(F.translate(x, "\t\x0b\x0c", "   ")) == ""
    after = F.transform("lines", lambda x, i: F.struct(x.alias("body"), ((i > 0) & blank(F.get("lines", i - 1))).alias("after")))
    rows = conversations.where("conv_id is not null and turn is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.col("text").alias("text"), mark.alias("mark"))
    row = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("text", "role"))
    rows = rows.withColumn("row", row).withColumn("lines", F.split("text", "\r\n|[\n\r]"))
    each = rows.select("conv_id", "turn", "row", "mark", F.posexplode(F.filter(after, lambda x: ~blank(x["body"]))).alias("place", "found"))
    text = F.when(F.col("place") == 0, F.concat("mark", "found.body")).when(F.col("found.after"), F.concat(F.lit("\n"), "found.body")).otherwise(F.col("found.body"))
    # a segment is a run of turns, so that no count over a whole conversation is needed
    return each.select("conv_id", F.floor(F.col("turn") / 32).alias("segment"), F.struct("turn", "row", "place").alias("line"), text.alias("text"))


def rendered(states: DataFrame) -> DataFrame:
    """conv_id, segment, n_turns, n_lines, roles, rendered: the turns that begin in a segment's lines, in canonical form.

    A turn is <|role|>, a line feed, its lines, and <|end|> with a line feed after it.
    A segment whose first line goes on with the turn before it says <|more|> instead of a role.
    """
    names = F.array(*map(F.lit, ROLES))

    rows = states.groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list(F.struct("line", "state", "text"))).alias("rows"))
    said = F.transform("rows", lambda x, i: F.concat(F.when(x["state"] % 2 == 0, F.concat(F.when(i > 0, "\n<|end|>\n").otherwise(""), F.lit("<|"), F.get(names, F.floor(x["state"] % PER_STYLE / 2).cast("int")), F.lit("|>\n"))).otherwise(F.when(i > 0, "\n").otherwise("<|more|>\n")), x["text"]))
    starts = F.filter("rows", lambda x: x["state"] % 2 == 0)
    return rows.select("conv_id", "segment", F.size(starts).cast("long").alias("n_turns"), F.size("rows").cast("long").alias("n_lines"), F.array_join(F.transform(starts, lambda x: F.get(names, F.floor(x["state"] % PER_STYLE / 2).cast("int"))), ",").alias("roles"), F.concat(F.array_join(said, ""), F.lit("\n<|end|>\n")).alias("rendered"))


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id, segment, n_turns, n_lines, roles, rendered, of every conversation's transcript; a segment has up to 32 turns."""
    return rendered(parse(transcript_lines(conversations)))
