"""Secret scans: all rules in one pass over the bytes of a text.

What the rules begin with is joined by subset construction and minimised into one deterministic automaton of transition
arrays, whose accepting states say which rule begins here and how long ago. A rule that has begun steps through
its own minimal automaton alongside, byte by byte in the same pass, until it can go on no more; its last accepting position is
the match's end. No byte is read twice. (One automaton of the rules' whole length would need a state for each set of
rules that can be under way at once.) Matches of a rule are leftmost and longest and do not overlap; those that fail a rule's `enough` are
dropped, but what they covered stays used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from lodeseek.llm.automaton import compile_rules, parse, width
from lodeseek.llm.common import boxed, fields, slices, slim, utf8


@dataclass(frozen=True)
class Rule:
    """A match is one of the triggers, each of fixed length, and the longest `rest`; it counts if the rest is also an `enough`, where given."""

    kind: str
    triggers: tuple[str, ...]
    rest: str
    enough: str | None = None


_GAP, _VALUE = "[\"']?\\x20*[:=]\\x20*[\"']?", "[A-Za-z0-9+/_.=-]"
BASE = (
    Rule("assign", ("(?i:password)", "(?i:passwd)", "(?i:secret)", "(?i:token)", "(?i:api_key)", "(?i:apikey)"), f"{_GAP}{_VALUE}+", f"{_GAP}{_VALUE}{{8,}}"),
    Rule("access", ("AKIA",), "[A-Z0-9]+", "[A-Z0-9]{12,}"),
    Rule("hex", ("[0-9a-f]{32}",), "[0-9a-f]*"),  # a shorter run holds no start of another match
)
#: A key runs to its END line, wrapped, escaped or on one line. Without one, it runs over fields such as DEK-Info and
#: over pieces of 16 or more base64 characters, and the shorter piece that may follow them.
_PEM_END = "([A-Z]+ )*PRIVATE KEY-----"
_PEM_CLOSED = f"([^-]|-{{1,4}}[^-])*-----END {_PEM_END}"
_PEM_GAP = "(\\s|\\\\n|\\\\r)+"
_PEM_OPEN = f"({_PEM_GAP}[A-Z][A-Za-z-]*:[^\\n]*)*({_PEM_GAP}[A-Za-z0-9+/=]{{16,}})+({_PEM_GAP}[A-Za-z0-9+/=]+)?"
MORE = (
    Rule("github", ("gh[pousr]_",), "[A-Za-z0-9]+", "[A-Za-z0-9]{36,}"),
    Rule("slack", ("xox[abprs]-",), "[A-Za-z0-9-]+", "[A-Za-z0-9-]{10,}"),
    Rule("google", ("AIza",), "[A-Za-z0-9_-]+", "[A-Za-z0-9_-]{35,}"),
    Rule("stripe", ("[rs]k_live_", "[rs]k_test_"), "[A-Za-z0-9]+", "[A-Za-z0-9]{16,}"),
    Rule("private_key", ("-----BEGIN ",), f"{_PEM_END}({_PEM_CLOSED}|{_PEM_OPEN})?"),
    Rule("jwt", ("eyJ",), "[A-Za-z0-9_-]{6,}\\.eyJ[A-Za-z0-9_-]{6,}\\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", ("[a-z]://",), "[A-Za-z0-9._-]+:[A-Za-z0-9._~!$&*+=-]+@"),
)


_COMPILED: dict[tuple, tuple] = {}  # a function under functools.cache would not reach executors by value


def compiled(rules: tuple[Rule, ...]) -> tuple:
    """The combined automaton of the triggers, the (rule, length) of each trigger, and the automaton of each rule's rest."""
    if rules not in _COMPILED:
        begun = [(number, parse(t)) for number, r in enumerate(rules) for t in r.triggers]
        table = compile_rules([tree for _, tree in begun], search=True)
        rests = [compile_rules([parse(r.rest), parse(r.enough or r.rest)], search=False) for r in rules]
        _COMPILED[rules] = (table, [(number, width(tree)) for number, tree in begun], rests)
    return _COMPILED[rules]


def _rows(table: list[list[int]], marks: list) -> list[list]:
    """Transition arrays as rows of rows (None: no way on); entry 256 is the state's mark."""
    rows: list[list] = [[] for _ in table]
    for row, states, mark in zip(rows, table, marks):
        row += [rows[t] if t >= 0 else None for t in states] + [mark]
    return rows


def scanner(machine: tuple) -> tuple:
    (table, accepts), begun, rests = machine
    first = _rows(table, [tuple(begun[t] for t in found) for found in accepts])[0]
    return first, [_rows(states, [(0 in found) + (1 in found) for found in ends])[0] for states, ends in rests]


def scan(data: bytes, rules: tuple[Rule, ...] = BASE + MORE, using: tuple | None = None) -> list[tuple[int, int, int]]:
    """(start, end, rule number) in bytes, sorted. using: the rules' scanner, if it is there already."""
    state, rests = using or scanner(compiled(rules))
    found: list[tuple[int, int, int]] = []
    used = [0] * len(rules)
    tries: dict[int, list[list]] = {}  # rule -> [row or None, start, end or -1, enough], by start

    def settled(rule: int) -> None:
        """Decides the rule's tries up to the first that is still under way; the earlier one wins."""
        now = tries[rule]
        while now and now[0][0] is None:
            _, start, end, enough = now.pop(0)
            if end >= 0:
                used[rule] = end
                now[:] = [t for t in now if t[1] >= end]
                if enough:
                    found.append((start, end, rule))
        if not now:
            del tries[rule]

    for at, byte in enumerate(data, 1):
        state = state[byte]
        if tries:
            for rule, now in list(tries.items()):
                over = False
                for t in now:
                    if (row := t[0]) is not None:
                        row = t[0] = row[byte]
                        if row is None:
                            over = True
                        elif row[256]:
                            t[2], t[3] = at, row[256] == 2
                if over:
                    settled(rule)
        if state[256]:
            for rule, length in state[256]:
                row, now = rests[rule], tries.get(rule, ())
                # An earlier try that is at the same place covers whatever this one would match.
                if at - length >= used[rule] and not any(t[0] is row for t in now):
                    tries.setdefault(rule, []).append([row, at - length, at if row[256] else -1, row[256] == 2])
    for rule in list(tries):
        for t in tries[rule]:
            t[0] = None
        settled(rule)
    return sorted(found, key=lambda x: (x[0], x[2]))


def code_points(data: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same matches, counted in code points."""
    if data.isascii():
        return found
    places, at, n = {}, 0, 0
    for p in sorted({p for s, e, _ in found for p in (s, e)}):
        n += len(data[at:p].decode())
        places[p], at = n, p
    return [(places[s], places[e], r) for s, e, r in found]


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """A row for each row of docs: id_col, spans (kind, start, end in code points, end exclusive; by start, then rule).

    Null and empty texts have no spans. Null and repeated ids come back as they are. Other columns are not read.
    """
    rows, machine = slim(docs, id_col, text_col), compiled(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using = scanner(machine)
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches, "text"):
            found = [code_points(t, scan(t, rules, using)) if t else [] for t in utf8(batch.column("text"))]
            spans = [[{"kind": rules[r].kind, "start": s, "end": e} for s, e, r in x] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(spans, span)], names=["id", "spans"])

    found = rows.mapInArrow(run, fields(rows.schema["id"], "spans array<struct<kind:string,start:long,end:long>>"))
    return found.withColumnRenamed("id", id_col)


def redacted(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """docs with each span of text_col replaced by its kind in angle brackets; overlapping spans make one, of the first's kind.

    All columns come back in their order; a null text stays null.
    """
    rows, at, machine = boxed(docs), docs.columns.index(text_col), compiled(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using = scanner(machine)
        for batch in slices(batches, "row"):
            row = batch.column("row")
            columns = row.flatten()
            texts = [None if t is None else replaced(t, scan(t, rules, using)) for t in utf8(columns[at])]
            columns[at] = pa.array([None if t is None else t.decode() for t in texts], columns[at].type)
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(columns, fields=list(row.type))], names=["row"])

    def replaced(data: bytes, found: list[tuple[int, int, int]]) -> bytes:
        out, end = [], 0
        for s, e, rule in found:
            if s >= end:
                out += [data[end:s], b"<", rules[rule].kind.encode(), b">"]
            end = max(end, e)
        return b"".join([*out, data[end:]])

    return rows.mapInArrow(run, rows.schema).select("row.*")
