"""Secret scans by a trigram index: Boolean trigram queries derived from the rules, postings, then verification.

Each rule's regex is parsed and turned into a query of AND and OR over the lower-cased trigrams that any match must
hold. Of each block of texts an inverted index is made: for each trigram that some query names, the posting bitmap of
the texts that hold it. Queries are evaluated on the postings, and only candidates are searched with the regex. A rule
without mandatory trigrams (a run of hexadecimal digits) searches all texts. Blocks are independent and need no
shuffle, so a lost task is simply run again.

Matches are leftmost and do not overlap within a rule; those that fail the rule's least length are dropped. Positions
are code points, end exclusive. Null texts are empty: no spans. Rows that repeat a doc_id are scanned each. Other
columns are ignored, and kept by `redact`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser as P

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    group: int = 0
    least: int = 1


def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYS = "|".join([any_case("password"), any_case("passwd"), any_case("secret"), any_case("token"), f"{any_case('api')}_?{any_case('key')}"])
BASE = (
    Rule("assign", rf"""({KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: A private key whole: up to its END line; where the next dashes are no such line, all header and base64 lines that follow.
PEM = (
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
    r"(?:(?:[^-]++|-(?!----))*+-----END [A-Z ]{0,30}PRIVATE KEY-----"
    r"|(?:\s+(?:Proc-Type|DEK-Info):[^\r\n]*)*(?:(?:\s|\\[nr])+[A-Za-z0-9+/]{16,}={0,2}|[\r\n]\s*[A-Za-z0-9+/]+={0,2}[\x20\t]*(?=[\r\n]|\Z))*)"
)
#: Public formats of well-known services. A web token starts a run of its characters, so that no run is tried from each place in it.
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("slack", r"xox[abprs]-[0-9A-Za-z-]{10,}"),
    Rule("stripe", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", PEM),
)
RULES = BASE + ADDED

#: Exact alternatives that are followed at once, and characters of a class that are tried one by one.
ALTERNATIVES, CLASS = 64, 8
ALL = True


def both(a, b):
    if a is ALL or a == b:
        return b
    return a if b is ALL else ("and", a, b)


def either(a, b):
    return ALL if a is ALL or b is ALL else a if a == b else ("or", a, b)


def of_strings(strings: set[str]):
    """Any match holds one of the strings."""
    out = None
    for s in sorted(strings):
        one = ALL
        for k in range(len(s) - 2):
            one = both(one, s[k : k + 3])
        out = one if out is None else either(out, one)
    return ALL if out is None else out


def analysed(items) -> tuple[set[str] | None, object]:
    """(all strings that can match, if few; a query that holds besides)."""
    strings, query, whole = {""}, ALL, True
    for op, arg in items:
        part, more = one(op, arg)
        query = both(query, more)
        if part is not None and len(part) * len(strings) <= ALTERNATIVES:
            strings = {a + b for a in strings for b in part}
        else:
            query = both(query, of_strings(strings))
            strings, whole = part if part is not None else {""}, False
    return (strings, query) if whole else (None, both(query, of_strings(strings)))


def one(op, arg) -> tuple[set[str] | None, object]:
    if op is C.LITERAL:
        return {chr(arg).lower()}, ALL
    if op is C.IN:
        found: set[str] = set()
        for kind, x in arg:
            if kind is C.LITERAL:
                found.add(chr(x).lower())
            elif kind is C.RANGE and x[1] - x[0] < CLASS:
                found.update(chr(c).lower() for c in range(x[0], x[1] + 1))
            else:
                return None, ALL
        return (found, ALL) if len(found) <= CLASS else (None, ALL)
    if op is C.SUBPATTERN:
        return analysed(arg[3])
    if op is C.BRANCH:
        strings, query = set(), None
        for branch in arg[1]:
            part, more = analysed(branch)
            if part is not None and more is ALL and strings is not None:
                strings = strings | part
            else:
                strings = None
            held = both(more, of_strings(part)) if part is not None else more
            query = held if query is None else either(query, held)
        return (strings, ALL) if strings is not None and len(strings) <= ALTERNATIVES else (None, query)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        low, high, inner = arg
        part, more = analysed(inner)
        if low == 0:
            return (part | {""}, ALL) if part is not None and high == 1 else (None, ALL)
        if part is not None and low == high and len(part) ** low <= ALTERNATIVES:
            out = {""}
            for _ in range(low):
                out = {a + b for a in out for b in part}
            return out, ALL
        return None, both(more, of_strings(part)) if part is not None else more
    return None, ALL


def trigram_query(regex: str):
    """The rule's query: True (no mandatory trigram), a trigram, or ("and" | "or", query, query)."""
    strings, query = analysed(P.parse(regex))
    return query if strings is None else both(query, of_strings(strings))


def trigrams(query) -> set[str]:
    return set() if query is ALL else {query} if isinstance(query, str) else trigrams(query[1]) | trigrams(query[2])


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = [(r, re.compile(r.regex), trigram_query(r.regex)) for r in rules]
        self.names = sorted({t for _, _, q in self.rules for t in trigrams(q)})
        self.slot = np.zeros(1 << 24, np.uint16)
        for k, t in enumerate(self.names):
            a, b, c = t.encode("latin-1")
            self.slot[a << 16 | b << 8 | c] = k + 1
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32

    def index(self, column: pa.Array) -> dict[str, np.ndarray]:
        """Posting bitmaps of a block of texts."""
        raw, off = common.utf8(column)
        raw = self.lower[raw].astype(np.uint32)
        hit = self.slot[raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]] if len(raw) > 2 else np.zeros(0, np.uint16)
        at = np.flatnonzero(hit)
        posting = np.zeros((len(self.names) + 1, len(column)), bool)
        posting[hit[at], np.searchsorted(off, at, "right") - 1] = True
        return {t: posting[k + 1] for k, t in enumerate(self.names)}

    def candidates(self, query, postings: dict[str, np.ndarray], n: int) -> np.ndarray:
        if query is ALL:
            return np.ones(n, bool)
        if isinstance(query, str):
            return postings[query]
        a, b = (self.candidates(q, postings, n) for q in query[1:])
        return a & b if query[0] == "and" else a | b

    def scan(self, column: pa.Array) -> list[list[dict]]:
        """Spans of each text, by start, then in the order of the rules."""
        postings, texts, n = self.index(column), column.to_pylist(), len(column)
        found: list[list] = [[] for _ in range(n)]
        for k, (rule, regex, query) in enumerate(self.rules):
            for i in np.flatnonzero(self.candidates(query, postings, n)).tolist():
                for m in regex.finditer(texts[i] or ""):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[i].append((m.start(), k, m.end()))
        return [[{"kind": self.rules[k][0].kind, "start": a, "end": b} for a, k, b in sorted(x)] for x in found]


SPANS = "array<struct<kind: string, start: long, end: long>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans) of each whole text."""

    def make():
        scanner = Scanner(rules)

        def run(batches):
            for batch in common.slices(batches):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(scanner.scan(batch.column("text")), _SPANS)], names=["doc_id", "spans"])

        return run

    return common.map_arrow(docs.select("doc_id", "text"), make, f"doc_id long, spans {SPANS}")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """docs with each secret in text replaced by mark, and n_chars (where there is one) of the new text."""

    def cut(text: str | None, spans: list[dict]) -> str | None:
        out, at = [], 0
        for s in spans:
            if s["end"] > at:
                if s["start"] >= at:
                    out += [text[at : s["start"]], mark]
                at = s["end"]
        return "".join([*out, text[at:]]) if spans else text

    def make():
        scanner = Scanner(rules)

        def run(batches):
            for batch in common.slices(batches):
                column = batch.column("text")
                texts = [cut(t, s) for t, s in zip(column.to_pylist(), scanner.scan(column), strict=True)]
                yield batch.set_column(batch.schema.get_field_index("text"), batch.schema.field("text"), pa.array(texts, column.type))

        return run

    out = common.map_whole(docs, make)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    spans = scan(common.table(spark, sf_dir, "documents"))
    kinds = [r.kind for r in BASE]
    of = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    count = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in kinds]
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return spans.select("doc_id", *count, F.sha2(told(F.filter("spans", lambda s: s["kind"].isin(kinds))), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


QUERIES = {"op5_secret_scans": op5_secret_scans}
