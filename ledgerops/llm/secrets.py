"""Secret scans with a trigram index: each rule's regex is turned into a Boolean query over trigrams, answered from postings.

For each block of texts the index keeps, per trigram that any rule asks for, the rows that hold it (letters folded to lower case). A rule's query is
intersected and united over these postings, and its regex runs on the rows left. A rule from which no trigram follows
runs on every row. The query only ever leaves out rows that cannot match, so results are those of a full scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as K
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerops.llm import words as W
from ledgerops.llm.tables import slices


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has at least ``least`` characters. ASCII classes only."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False

    @property
    def regex(self) -> re.Pattern:
        return _compiled(self.pattern, self.any_case)


@lru_cache(maxsize=None)
def _compiled(pattern: str, any_case: bool) -> re.Pattern:
    return re.compile(pattern, re.ASCII | (re.IGNORECASE if any_case else 0))


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # whole runs, as a greedy match takes
)
#: Further kinds, whose formats are published by their issuers.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"(?:sk|rk)_live_[A-Za-z0-9]{16,}"),
    # a token starts where its characters start, and no repeat gives back: repeated "eyJ" takes linear time
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:\s*[A-Za-z][A-Za-z0-9-]*+:(?:(?!-----)[^\n])*+\n)*+[A-Za-z0-9+/=\s]++-----END (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{0,20}://[^\s:/@]++:[^\s/@]{4,}+@"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9+/_.=-]{16,}", any_case=True),
)
RULES = BASE + MORE

# --- Boolean trigram queries: True (no condition), a trigram, or ("and" | "or", set of queries) ---------------------------------------

_MOST = 48  # exact strings that are followed before they are turned into a query


def _all(parts) -> object:
    parts = frozenset(p for p in parts if p is not True)
    return True if not parts else next(iter(parts)) if len(parts) == 1 else ("and", parts)


def _any(parts) -> object:
    parts = frozenset(parts)
    return True if True in parts or not parts else next(iter(parts)) if len(parts) == 1 else ("or", parts)


def _of_string(s: str) -> object:
    return _all(s[i : i + 3] for i in range(len(s) - 2))


def _of_strings(strings: set[str]) -> object:
    return _any(_of_string(s) for s in strings)


def _class(items) -> set[str] | None:
    """The characters of a class, in lower case, or None for many."""
    out: set[str] = set()
    for op, value in items:
        if op is K.LITERAL:
            out.add(chr(value).lower())
        elif op is K.RANGE and value[1] - value[0] < 16:
            out.update(chr(c).lower() for c in range(value[0], value[1] + 1))
        else:
            return None
    return out if len(out) <= 8 else None


def _walk(tree) -> tuple[set[str] | None, object]:
    """(all strings it can match, or None for many; a query that any text with a match satisfies)."""
    exact: set[str] | None = {""}  # exact strings of the stretch since the last open part
    query, whole = True, True
    for op, value in tree:
        part: set[str] | None
        need: object = True
        if op is K.LITERAL:
            part = {chr(value).lower()}
        elif op is K.IN:
            part = _class(value)
        elif op is K.SUBPATTERN:
            part, need = _walk(value[-1])
        elif op is K.BRANCH:
            walked = [_walk(t) for t in value[1]]
            part = set().union(*(w[0] for w in walked)) if all(w[0] is not None for w in walked) else None
            need = _any(_all([w[1], _of_strings(w[0]) if w[0] is not None else True]) for w in walked)
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
            low, high, inner = value
            part, need = _walk(inner)
            if (low, high) == (0, 1) and part is not None:
                part, need = part | {""}, True
            elif low == 0:
                part, need = None, True
            elif part is None or (low, high) != (1, 1):
                need = _all([need, _of_strings(part) if part is not None else True])
                if part is not None and low == high and len(part) == 1 and low <= 8:
                    part = {next(iter(part)) * low}
                else:
                    part = None
        elif op is K.AT:
            part = {""}
        else:
            part = None
        query = _all([query, need])
        if part is not None and len(exact) * len(part) <= _MOST:
            exact = {a + b for a in exact for b in part}
            continue
        query, whole = _all([query, _of_strings(exact)]), False
        exact = part if part is not None and len(part) <= _MOST else {""}
    return (exact, query) if whole else (None, _all([query, _of_strings(exact)]))


def trigram_query(pattern: str) -> object:
    """The Boolean query over lower-case trigrams that follows from a regex; True if none does."""
    exact, query = _walk(parser.parse(pattern))
    return _all([query, _of_strings(exact)]) if exact is not None else query


def _trigrams(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*(_trigrams(q) for q in query[1]))


def _answer(query, postings: dict[str, np.ndarray], n: int) -> np.ndarray:
    if query is True:
        return np.ones(n, dtype=bool)
    if isinstance(query, str):
        return postings[query]
    parts = [_answer(q, postings, n) for q in query[1]]
    return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)


def _postings(column: pa.Array, trigrams: list[str]) -> dict[str, np.ndarray]:
    """Rows that hold each trigram (of ASCII characters, in either case)."""
    raw, bounds = W.text_bytes(column)
    n = len(column)
    if len(raw) < 3:
        return {t: np.zeros(n, dtype=bool) for t in trigrams}
    folded = W._LOWER[raw]
    wanted = np.array([int.from_bytes(t.encode("latin-1"), "big") for t in trigrams], dtype=np.uint32)
    begins = np.zeros(1 << 16, dtype=bool)
    begins[wanted >> 8] = True
    pair = folded[:-2].astype(np.uint16) << np.uint16(8) | folded[1:-1]
    at = np.flatnonzero(begins[pair])
    code = pair[at].astype(np.uint32) << np.uint32(8) | folded[at + 2]
    row = np.searchsorted(bounds, at, side="right") - 1
    inside = (at + 3 <= bounds[row + 1]) & np.isin(code, wanted)
    found, row = code[inside], row[inside]
    out = {}
    for t, c in zip(trigrams, wanted):
        hit = np.zeros(n, dtype=bool)
        hit[row[found == c]] = True
        out[t] = hit
    return out


def spans_of(text: str, rule: Rule) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches that are long enough, as code points with the end left out."""
    return [m.span() for m in rule.regex.finditer(text) if len(m[rule.group]) >= rule.least]


def _scan(rules: tuple[Rule, ...]):
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted(set().union(*(_trigrams(q) for q in queries)))

    def run(batches):
        for piece in slices(batches, 4096):
            postings = _postings(piece.column(1), trigrams)
            found: list[list[tuple[int, int, int]]] = [[] for _ in range(piece.num_rows)]
            candidates = [np.flatnonzero(_answer(q, postings, piece.num_rows)) for q in queries]
            texts = piece.column(1)
            python: dict[int, str] = {}
            for k, rows in enumerate(candidates):
                for i in rows.tolist():
                    text = python.get(i)
                    if text is None:
                        text = python[i] = texts[i].as_py() or ""
                    found[i] += [(start, k, end) for start, end in spans_of(text, rules[k])]
            for f in found:
                f.sort()
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            spans = pa.array([[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in f] for f in found], type=kind)
            yield pa.RecordBatch.from_arrays([piece.column(0), spans], names=["id", "spans"])

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, spans) for each row: an array of (kind, start, end) by start, then in the rules' order; whole texts, code points.

    Null and empty texts have no spans. Every row is scanned for itself, so repeated rows and null ids are returned as they are.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = source.mapInArrow(_scan(rules), f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")
    return out.select(F.col("id").alias(id_col), "spans")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and a digest of the base kinds, and all spans as text."""
    base = F.filter("spans", lambda s: s.kind.isin(*[r.kind for r in BASE]))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select(id_col, *[count(r.kind) for r in BASE], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _redact(text: str | None, rules: tuple[Rule, ...]) -> str | None:
    if not text:
        return text
    marks = sorted((s, e) for r in rules for s, e in spans_of(text, r))
    if not marks:
        return text
    out, at = [], 0
    for start, end in marks:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], "[secret]"]
        at = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, count_col: str | None = None) -> DataFrame:
    """``docs`` with every span that any rule finds replaced by ``[secret]``; spans that overlap become one mark.

    ``count_col``, if given, holds the code points of each changed text. All other columns, and all rows, stay as they are.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted(set().union(*(_trigrams(q) for q in queries)))
    at, counted = docs.columns.index(text_col), docs.columns.index(count_col) if count_col else -1

    def run(batches):
        for piece in slices(batches, 4096, text=at):
            column = piece.column(at)
            postings = _postings(column, trigrams)
            rows = np.logical_or.reduce([_answer(q, postings, piece.num_rows) for q in queries])
            texts = column.to_pylist()
            changed = {i: new for i in np.flatnonzero(rows).tolist() if (new := _redact(texts[i], rules)) != texts[i]}
            for i, new in changed.items():
                texts[i] = new
            columns = list(piece.columns)
            columns[at] = pa.array(texts, type=column.type)
            if count_col is not None and changed:
                counts = columns[counted].to_pylist()
                for i, new in changed.items():
                    counts[i] = len(new)
                columns[counted] = pa.array(counts, type=columns[counted].type)
            yield pa.RecordBatch.from_arrays(columns, names=piece.schema.names)

    return docs.mapInArrow(run, docs.schema)

