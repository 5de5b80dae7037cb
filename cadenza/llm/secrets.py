"""Secret scanning: a keyword automaton, anchored patterns at its hits, then checksums."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import kernels

# The base kinds in their order, keywords and patterns.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "forge", "slack", "pem", "jwt")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
FORGE = re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
SLACK = re.compile(r"xox[abprs]-[0-9A-Za-z]{8,}(?:-[0-9A-Za-z]{8,})+")
PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]{64,}-----END (?:[A-Z]+ )*PRIVATE KEY-----")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{20,}")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "forge": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"),
    "slack": ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-"),
    "pem": ("-----begin ",),
    "jwt": ("eyj",),
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_LOWER = {i: i + 32 for i in range(65, 91)}


def checksum_holds(body: str, check: str) -> bool:
    """Whether the last six characters are the body's crc32 in base 62."""
    value = 0
    for c in check:
        value = value * 62 + BASE62.index(c)
    return value == zlib.crc32(body.encode())


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


PATTERNS = {"assign": ASSIGN, "access": ACCESS, "forge": FORGE, "slack": SLACK, "pem": PEM, "jwt": JWT}


def _holds(kind: str, match: re.Match) -> bool:
    if kind == "assign":
        return len(match[2]) >= 6
    if kind == "access":
        return match.end() - match.start() >= 20
    return kind != "forge" or checksum_holds(match[1], match[2])


def scan(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """All (start, end, number of the kind) in a text, by start and then kind; code points, end exclusive."""
    spans, free = [(m.start(), m.end(), 2) for m in HEX.finditer(text)], {}
    for last, (kind, size) in automaton.iter(text.translate(_LOWER)):
        start = last - size + 1
        if start >= free.get(kind, 0) and (match := PATTERNS[kind].match(text, start)):
            free[kind] = match.end()  # a failing match also hides what it overlaps
            if _holds(kind, match):
                spans.append((start, match.end(), KINDS.index(kind)))
    return sorted(spans, key=lambda s: (s[0], s[2]))


def _merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end, _ in spans:
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The secrets of every document, one row for each input row:
    (id_col, n_assign, n_access, n_hex, base_sha256, spans).

    Base kinds: assign (a keyword, = or :, and a value of 6 characters or more), access (AKIA and 16 or more) and hex
    (24 or more). More kinds: forge tokens whose embedded base-62 crc32 holds, slack tokens, pem private keys, jwt.
    spans lists kind:start:end in code points by start and then kind; base_sha256 is the hash of the base ones joined
    alike. Null and empty texts have no spans; a null id stays null; repeated rows are scanned each; other columns are
    ignored. A text of any length is scanned whole, by one task. Ids must be numbers.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]):
        automaton = _automaton()
        for part in kernels.slices(batches, "__text"):
            rows = []
            for text in kernels.column(part, "__text").to_pylist():
                spans = scan(text, automaton) if text else []
                names = [f"{KINDS[k]}:{s}:{e}" for s, e, k in spans]
                base = ",".join(n for n, s in zip(names, spans, strict=True) if s[2] < 3)
                counts = [sum(s[2] == k for s in spans) for k in range(3)]
                rows.append((*counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(names)))
            columns = zip(*rows, strict=True)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [kernels.column(part, "__id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
                names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.mapInArrow(
        run, f"`{id_col}` long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


def redact(docs: DataFrame, text_col: str = "text", mark: str = "<secret>") -> DataFrame:
    """The same rows with every secret in the text replaced by a mark; overlapping spans become one. Null stays null,
    an empty text empty; repeated rows are changed alike, and an empty table stays empty. A text of any length is scanned whole, by one task."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]):
        automaton = _automaton()
        for part in kernels.slices(batches, text_col):
            texts = []
            for text in kernels.column(part, text_col).to_pylist():
                at, pieces = 0, []
                for start, end in _merged(scan(text, automaton)) if text else []:
                    pieces += [text[at:start], mark]
                    at = end
                texts.append(text if text is None else "".join(pieces) + text[at:])
            yield part.set_column(part.schema.get_field_index(text_col), text_col, pa.array(texts, pa.string()))

    return docs.mapInArrow(run, schema)
