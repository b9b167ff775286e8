"""Secret scan: fixed patterns, and a token-efficiency test for random strings.

A subword vocabulary spends few tokens on words it knows and many on random strings. A run of credential characters is
reported if it gets fewer characters per token than ``most`` allows for its length, as a whole or in one of its parts
between separators. Known digests, UUIDs and numbers (dates, versions) count on neither side; nothing else is excluded,
so letters alone are scored as well. The patterns' own spans are never dropped.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters per token below which a candidate counts as random; words of natural languages get 2.5 to 5.
MAX_RATIO = 2.0
#: Runs under SHORTEST characters are not scored; from there to FULL the ratio allowed grows from SHORT_RATIO to MAX_RATIO, as few tokens say little.
SHORTEST, FULL, SHORT_RATIO = 12, 20, 1.6
#: A run whose parts are all under this length is a list of short names, such as a path.
LONGEST_PART = 6
#: A text is encoded in slices of this length, so that runs of any length take time in proportion.
_SLICE = 1024
#: Rows whose texts are redacted at once; a batch's are not all held as Python strings.
ROWS = 512
KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: Greedy runs of one class that are long enough: the same as all runs less those that are too short.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}")
_SEPARATORS = re.compile(r"[+/_=-]+")
_DIGESTS = frozenset({32, 40, 56, 64, 96, 128})
_HEXDIGITS = re.compile(r"[0-9a-fA-F]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")


@functools.lru_cache(2)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_known(part: str) -> bool:
    """Digests of the usual lengths, and numbers, to which one or two letters may be added as in dates and versions."""
    return len(part) in _DIGESTS and bool(_HEXDIGITS.fullmatch(part)) or sum(c.isalpha() for c in part) < 3


def most(n: int) -> float:
    """The characters per token under which ``n`` characters count as random."""
    return MAX_RATIO - (MAX_RATIO - SHORT_RATIO) * max(0, FULL - n) / (FULL - SHORTEST)


def is_random(text: str, vocabulary: str) -> bool:
    parts = [p for p in _SEPARATORS.split(_UUID.sub("/", text)) if p and not is_known(p)]
    if max(map(len, parts), default=0) < LONGEST_PART:
        return False
    encode = encoding(vocabulary).encode_ordinary
    sizes = [(len(p), sum(len(encode(p[at : at + _SLICE])) for at in range(0, len(p), _SLICE))) for p in parts]
    n, tokens = map(sum, zip(*sizes, strict=True))
    return any(n >= SHORTEST and n < most(n) * tokens for n, tokens in [(n, tokens), *sizes])


def find_spans(text: str, vocabulary: str) -> list[tuple[int, int, int]]:
    """(start, kind as a place in KINDS, end) in code points, sorted."""
    spans = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    spans += [(m.start(), 3, m.end()) for m in _CANDIDATE.finditer(text) if is_random(m[0], vocabulary)]
    return sorted(spans)


def redact(text: str, vocabulary: str, mark: str = "[SECRET]") -> str:
    """``text`` with each stretch of overlapping spans replaced by ``mark``."""
    out, at, upto = [], 0, -1
    for start, _, end in find_spans(text, vocabulary):
        if start >= upto:
            if upto >= 0:
                at = upto
            out += [text[at:start], mark]
        upto = max(upto, end)
        at = upto
    return "".join(out) + text[at:] if out else text


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) of each row, from its whole text.

    A null text counts as empty; a row without spans has counts of 0 and the digest of the empty string. Texts of any
    length are scanned whole, repeated rows each, null ids stay null, an empty table gives an empty result. Random
    strings of digits alone are not told from numbers: the token test leaves them out.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                spans = find_spans(text.as_py() or "", path)
                base = _join([s for s in spans if s[1] < 3])
                out.append((i, *(sum(s[1] == k for s in spans) for k in range(4)), hashlib.sha256(base.encode()).hexdigest(), _join(spans)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)] if out else [pa.array([], t) for t in schema.types], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def redact_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced and ``n_chars`` counted anew where a text changed; other columns as they are. Null texts stay null."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    at, n = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(a, ROWS) for b in batches for a in range(0, b.num_rows, ROWS)):
            columns = list(batch.columns)
            old = columns[at].to_pylist()
            new = [t if t is None else redact(t, path) for t in old]
            columns[at] = pa.array(new, columns[at].type)
            if n is not None:
                was = columns[n].to_pylist()
                columns[n] = pa.array([w if a == b else len(b) for w, a, b in zip(was, old, new, strict=True)], columns[n].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(rows, docs.schema)


def op7_token_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret in every document; odd rows as ``scan`` states."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_token_efficiency": op7_token_efficiency}
SQL: dict[str, str] = {}
