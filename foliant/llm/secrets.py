"""Secret scans: keyword automaton, anchored patterns at its hits, checksums inside tokens."""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from foliant.llm.common import give_up_tables, id_field, map_texts, slices, texts_of

# Keywords and public token formats.
ASSIGN_WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
ACCESS_WORD = "AKIA"
CHECKED_WORDS = {"github": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], "npm": ["npm_"]}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KINDS = ["assign", "access", "hex", "github", "npm"]

_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")


@functools.cache
def automaton() -> ahocorasick.Automaton:
    """All keywords; letters of the assignment words in either case."""
    found = ahocorasick.Automaton()
    for word in ASSIGN_WORDS:
        for spelt in itertools.product(*({c, c.upper()} for c in word)):
            found.add_word("".join(spelt), ("assign", len(word)))
    found.add_word(ACCESS_WORD, ("access", len(ACCESS_WORD)))
    for kind, words in CHECKED_WORDS.items():
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def checksum_holds(body: str, check: str) -> bool:
    """Whether the last six characters are the CRC-32 of the body in base 62."""
    value, digits = zlib.crc32(body.encode()), ""
    while value:
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits.rjust(6, "0") == check


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) of all secrets of a text, in order.

    Patterns are tried only where the automaton meets a keyword, in order and from the end of the
    last match on, which gives the leftmost matches that do not overlap.  Hexadecimal runs have no
    keyword and are looked for directly.
    """
    spans, free = [], {"assign": 0, "access": 0}
    for last, (kind, size) in automaton().iter(text):
        start = last - size + 1
        if kind == "assign" or kind == "access":
            if start < free[kind]:
                continue
            m = (_ASSIGN if kind == "assign" else _ACCESS).match(text, start)
            if m:
                free[kind] = m.end()
                if len(m[2]) >= 6 if kind == "assign" else m.end() - start >= 20:
                    spans.append((start, KINDS.index(kind), m.end()))
        elif not start or not (text[start - 1].isascii() and text[start - 1].isalnum()):
            m = _CHECKED.match(text, start)
            if m and checksum_holds(m[1], m[2]):
                spans.append((start, KINDS.index(kind), m.end()))
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    spans.sort()
    return spans


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each run of touching or overlapping spans replaced by one mark."""
    out, at, upto = [], 0, -1
    for start, kind, end in spans:
        if start > upto:
            out.append(text[at:start] + f"<{KINDS[kind]}>")
        upto = max(upto, end)
        at = upto
    return "".join(out) + text[at:]


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Secrets in each whole text: assignments, access keys, hexadecimal runs, tokens with a valid checksum.

    Tokens whose last six characters are a checksum are reported only where it holds.  Spans are
    kind:start:end in code points, end exclusive, by start and then kind, joined by commas.

    A null text is empty and has no spans; repeated rows are scanned one by one; an empty table gives
    no rows; a null id is carried along; columns other than doc_id and text are not read.
    """
    schema = T.StructType([id_field(docs), *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:3]],
                           T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
                           T.StructField("n_checked", T.LongType())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, digests, listed = [], [], []
        for text in texts_of(batch):
            spans = find_spans(text)
            written = [(k, f"{KINDS[k]}:{s}:{e}") for s, k, e in spans]
            kinds = [k for _, k, _ in spans]
            counts.append((kinds.count(0), kinds.count(1), kinds.count(2), sum(k > 2 for k in kinds)))
            digests.append(hashlib.sha256(",".join(w for k, w in written if k < 3).encode()).hexdigest())
            listed.append(",".join(w for _, w in written))
        assign, access, hexes, checked = (pa.array(c, pa.int64()) for c in zip(*counts, strict=True))
        return pa.RecordBatch.from_arrays([batch.column(0), assign, access, hexes, pa.array(digests), pa.array(listed), checked], schema.names)

    return map_texts(docs.select("doc_id", "text"), work, schema)


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with the same columns, secrets in ``text`` replaced by marks and a null text left null."""
    at = docs.columns.index("text")

    def run(batches):
        give_up_tables()
        for part in (x for batch in batches for x in slices(batch, at)):
            texts = [None if t is None else redact(t, find_spans(t)) for t in part.column(at).to_pylist()]
            yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
