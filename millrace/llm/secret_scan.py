"""Operator 11: secrets by one deterministic automaton for all rules.

Each rule is a head (a regex) and a run of characters after it. The regexes are compiled together, by subset construction
and minimisation, into transition arrays, and one pass over the bytes of a batch tells where any rule's head is followed by
its run. Bytes that lead from every state to the first are where matches cannot go over: between two of them, the automata
of the heads of the rules that were seen there give the spans, leftmost first and without overlaps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._automaton import Automaton, compiled, hits
from ._shared import table
from ._words import chunks

#: Bytes of texts that are scanned at once.
SCAN_BYTES = 4 << 20


@dataclass(frozen=True)
class Rule:
    """Head, then as many characters of the class run as there are, of which a secret has at least `least`.

    Shorter matches are dropped, but the next match begins after them. waits: run characters that the pass over all bytes
    waits for; more of them make rarer hits but a larger automaton. No character of run may continue a complete head.
    """

    kind: str
    head: str
    run: str = ""
    least: int = 0
    any_case: bool = False
    waits: int = 1


#: The base rules.
BASE_RULES = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]", 12, True),
    Rule("access", "AKIA", "[A-Z0-9]", 14),
    Rule("hex", "", "[0-9a-f]", 16, waits=16),
]

#: Rules of the method. A parameter. Public formats of keys and tokens.
MORE_RULES = [
    Rule("code-host", "gh[opsur]_", "[A-Za-z0-9]", 36),
    Rule("chat", "xox[abeoprs]-", "[A-Za-z0-9-]", 10),
    Rule("cloud", "AIza", "[A-Za-z0-9_-]", 35),
    Rule("payment", "[rs]k_(live|test)_", "[A-Za-z0-9]", 16),
    Rule("signed", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", "[A-Za-z0-9_-]", 10),
    Rule("bearer", r"bearer\x20+", "[A-Za-z0-9+/_.~=-]", 20, True),
    Rule("private-key", "-----BEGIN ([A-Z]+ )?PRIVATE KEY-----"),
]

SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
SCHEMA = "spans array<struct<kind:string,start:long,end:long>>"


class Scanner:
    """The automata of some rules."""

    def __init__(self, rules: list[Rule]):
        for rule in rules:
            if rule.run and not 1 <= rule.waits <= rule.least or not rule.run and rule.least:
                raise ValueError(f"{rule.kind}: a run has a least length of waits or more, and only a run has one")
        self.rules = rules
        self.all = compiled([(rule.head + (f"{rule.run}{{{rule.waits}}}" if rule.run else ""), rule.any_case) for rule in rules], True)
        self.heads = [compiled([(rule.head, rule.any_case)], False) for rule in rules]
        self.runs = [_run_bytes(rule) for rule in rules]
        self.firsts = [_first_bytes(head, run) for head, run in zip(self.heads, self.runs, strict=True)]
        for rule, head, run in zip(rules, self.heads, self.runs, strict=True):
            ends = np.flatnonzero(head.accepts)
            if (run & (head.table[ends][:, head.classes] != head.dead).any(axis=0)).any():
                raise ValueError(f"{rule.kind}: characters of its run may continue its head")
        self.walks = [(head.table.tolist(), head.classes.tolist(), head.accepts.tolist(), head.dead) for head in self.heads]

    def spans(self, data: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, in this order. Texts in data are parted by line feeds, which no rule may hold."""
        places, rules = hits(self.all, data)
        if not len(places):
            return []
        safe = np.flatnonzero(self.all.resets[data])
        region = np.searchsorted(safe, places)
        found = []
        for first, last in _runs_of(region):
            k = int(region[first])
            low, high = int(safe[k - 1]) + 1 if k else 0, int(safe[k]) if k < len(safe) else len(data)
            seen = int(np.bitwise_or.reduce(rules[first:last]))
            for number in range(len(self.rules)):
                if seen >> number & 1:
                    found += [(start, number, end) for start, end in self._matches(number, data[low:high], low)]
        return sorted(found)

    def _matches(self, number: int, part: np.ndarray, low: int) -> Iterator[tuple[int, int]]:
        """The spans of one rule in a part that matches do not leave."""
        rule, run, symbols = self.rules[number], self.runs[number], part.tolist()
        steps, classes, accepts, dead = self.walks[number]
        ends, done = None, 0
        for start in np.flatnonzero(self.firsts[number][part]).tolist():
            if start < done:
                continue
            state, at, head = 0, start, start if accepts[0] else -1
            while at < len(symbols) and (state := steps[state][classes[symbols[at]]]) != dead:
                at += 1
                if accepts[state]:
                    head = at
            if head < 0:
                continue
            end = head
            if rule.run:
                if ends is None:
                    ends = np.append(np.flatnonzero(~run[part]), len(part))
                end = int(ends[np.searchsorted(ends, head)])
                if end == head:
                    continue
            done = end
            if end - head >= rule.least:
                yield low + start, low + end


def _run_bytes(rule: Rule) -> np.ndarray:
    if not rule.run:
        return np.zeros(256, bool)
    one = compiled([(rule.run, rule.any_case)], False)
    return (one.accepts[one.table[0]] != 0)[one.classes]


def _first_bytes(head: Automaton, run: np.ndarray) -> np.ndarray:
    begins = (head.table[0] != head.dead)[head.classes]
    return begins | run if head.accepts[0] else begins


def _runs_of(values: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(values)) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)], strict=True)


def spans_of_texts(scanner: Scanner, texts: pa.Array) -> pa.Array:
    """For each text its spans in code points, by start, then in the order of the rules."""
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    for first, data, offsets in chunks(texts, SCAN_BYTES):
        raw = data.tobytes()
        joined = np.frombuffer(b"\n".join(raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)), np.uint8)
        begins = offsets[:-1] + np.arange(len(offsets) - 1)
        found = scanner.spans(joined)
        owner = np.searchsorted(begins, [start for start, _, _ in found], "right") - 1
        for low, high in _runs_of(owner) if found else ():
            text = int(owner[low])
            begin = int(begins[text])
            own = joined[begin : begin + int(offsets[text + 1] - offsets[text])]
            points = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
            out[first + text] = [{"kind": scanner.rules[rule].kind, "start": int(points[start - begin]), "end": int(points[end - begin])} for start, rule, end in found[low:high]]
    return pa.array(out, pa.list_(SPAN))


def scan(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """docs and spans: kind, start and end (exclusive, in code points) of every secret, by start, then in the order of rules.

    A column of docs called spans is replaced. Null and empty texts have no spans; an empty table gives an empty result;
    repeated rows give repeated results. Texts are scanned whole, however long. Spans of one rule never overlap; of rules
    whose spans begin together, each has its own. Map-only: nothing is shuffled.
    """
    scanner = Scanner([*BASE_RULES, *MORE_RULES] if rules is None else rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = spans_of_texts(scanner, batch.column(batch.schema.names.index("__text")))
            keep = batch.drop_columns(["__text"])
            yield pa.RecordBatch.from_arrays([*keep.columns, found], names=[*keep.schema.names, "spans"])

    kept = docs.select(*[c for c in docs.columns if c not in ("spans", "__text")], F.col(text).alias("__text"))
    fields = [f for f in kept.schema.fields if f.name != "__text"]
    return kept.mapInArrow(run, StructType([*fields, *StructType.fromDDL(SCHEMA).fields]))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda x: x.kind.isin(*[rule.kind for rule in BASE_RULES]))
    count = lambda kind: F.size(F.filter("spans", lambda x: x.kind == kind)).cast("long")
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


QUERIES = {"op11_secret_scan": op11_secret_scan}
#: SQL has no places of matches; tests hold the query against plain regexes.
ORACLE_SQL: dict[str, str] = {}
