"""Secret scan: fixed formats plus a token-efficiency test.

Base formats (leftmost, non-overlapping per kind, failing matches dropped):
``assign`` (a key word, a separator and a value of 12 or more characters),
``access`` (AKIA key ids of 18 or more characters) and ``hex`` (16 or more).

Method: ordinary words, names and numbers compress well under a tokenizer's
vocabulary, random strings do not.  A run of at least ``MIN_RUN`` characters of
``[A-Za-z0-9+/_-]`` is a candidate when it holds a letter and a digit; known
digests (hex strings of a digest's length, UUIDs) and identifiers (alphabetic
pieces with trailing digits, joined by ``_``, ``-`` or ``/``) are excluded; the
rest is a ``random`` span when it has fewer than ``MAX_CHARS_PER_TOKEN``
characters per token and no base span covers it.  An identifier is excluded piece
by piece: a piece of ``MIN_RUN`` characters or more, letters or letters and then
digits, is ``random`` below the stricter ``MAX_CHARS_PER_WORD_TOKEN``, as unusual
words and names of other languages reach 1.6, random letters 1.4 to 1.5.

Scale: one pass, no shuffle; the tokenizer's vocabulary file (under 1 MB) is
read by the driver from a path parameter and broadcast, so executors need no
file of their own.  Positions are code points, ends exclusive.

Defined cases: a null text is empty and has no span; ``base_sha256`` of no span
is the digest of the empty string; repeated rows are kept; an empty table gives
no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from companion.llm.common import byte_rows

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# word splitting of the public byte-level vocabulary
SPLIT = (r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s")
MIN_RUN = 16
MAX_CHARS_PER_TOKEN = 2.2
MAX_CHARS_PER_WORD_TOKEN = 1.6
CHUNK = 1024          # characters that the tokenizer sees at a time
KINDS = ("assign", "access", "hex", "random")
REDACTED = "[SECRET]"

# Fixed patterns of the base formats.
ASSIGN = re.compile(
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    "|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{16,}")     # same as runs of any length, then 16 or more
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

RUN = re.compile("[A-Za-z0-9+/_-]{%d,}" % MIN_RUN)
DIGEST = re.compile("[0-9a-fA-F]+|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
DIGEST_LENGTHS = {32, 36, 40, 56, 64, 96, 128}
IDENTIFIER = re.compile("[A-Za-z]*[0-9]*([_/+-]+([A-Za-z]+[0-9]*|[0-9]+))*[_/+-]*")
PIECE = re.compile("[A-Za-z][A-Za-z0-9]{%d,}" % (MIN_RUN - 1))

IN_RUN = np.zeros(256, dtype=bool)
IN_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")] = True

FOUND = T.StructType([
    T.StructField("n_assign", T.LongType()), T.StructField("n_access", T.LongType()),
    T.StructField("n_hex", T.LongType()), T.StructField("n_random", T.LongType()),
    T.StructField("base", T.StringType()), T.StructField("spans", T.StringType())])

Span = tuple[int, int, int, int]          # start, kind number, end, start of the secret part


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed formats, by start and kind."""
    spans = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text)
             if m.end(2) - m.start(2) >= 12]
    spans += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)
              if m.end() - m.start() >= 18]
    spans += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(spans)


def unusual_parts(run: str, n_tokens) -> list[tuple[int, int]]:
    """Where a run holds text that the tokenizer cannot shorten: the run itself, or pieces
    of an identifier."""
    if not any(c.isalpha() for c in run) or (
            len(run) in DIGEST_LENGTHS and DIGEST.fullmatch(run)):
        return []
    if IDENTIFIER.fullmatch(run):
        return [m.span() for m in PIECE.finditer(run)
                if m.end() - m.start() < MAX_CHARS_PER_WORD_TOKEN * n_tokens(m.group())]
    found = any(c.isdigit() for c in run) and len(run) < MAX_CHARS_PER_TOKEN * n_tokens(run)
    return [(0, len(run))] if found else []


def random_spans(text: str, base: list[Span], n_tokens) -> list[Span]:
    """Runs that the tokenizer cannot shorten, beside those that ``base`` covers."""
    spans = []
    for m in RUN.finditer(text):
        for start, end in unusual_parts(m.group(), n_tokens):
            start, end = start + m.start(), end + m.start()
            if not any(s <= start and end <= e for s, _, e, _ in base):
                spans.append((start, 3, end, start))
    return spans


def token_counter(ranks: bytes, split: str = SPLIT):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    encoding = tiktoken.Encoding("efficiency", pat_str=split, mergeable_ranks=table,
                                 special_tokens={})
    # a run of any length in linear time
    return lambda run: sum(len(encoding.encode_ordinary(run[i:i + CHUNK]))
                           for i in range(0, len(run), CHUNK))


def has_long_run(rows: list[bytes]) -> list[bool]:
    """Which rows hold a run of at least ``MIN_RUN`` characters (any format's minimum)."""
    flags = [False] * len(rows)
    start = 0
    while start < len(rows):
        stop, size = start, 0
        while stop < len(rows) and (size < 1 << 21 or stop == start):
            size += len(rows[stop]) + 1
            stop += 1
        joined = b"\n" + b"\n".join(rows[start:stop]) + b"\n"
        inside = IN_RUN[np.frombuffer(joined, dtype=np.uint8)]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        long_ = edges[0::2][edges[1::2] - edges[0::2] >= MIN_RUN]
        ends = np.cumsum([len(r) + 1 for r in rows[start:stop]])
        for at in np.unique(np.searchsorted(ends, long_, side="right")).tolist():
            flags[start + at] = True
        start = stop
    return flags


def scan(rows: list[bytes], n_tokens) -> list[list[Span]]:
    """Spans of every text.  A row without a key word and without a long run of
    candidate characters cannot match any format and is not looked at again."""
    found = []
    for row, long_run in zip(rows, has_long_run(rows)):
        lower = row.lower()
        if not long_run and not any(word in lower for word in ASSIGN_WORDS):
            found.append([])
            continue
        text = row.decode()
        base = base_spans(text)
        found.append(sorted(base + random_spans(text, base, n_tokens)))
    return found


def _written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


def _scanner(spark: SparkSession, vocabulary: str):
    """A function for tasks that gives the token counter, built once per worker."""
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    return lambda: token_counter(shared.value)


def spans_column(spark: SparkSession, text: Column, vocabulary: str = VOCABULARY) -> Column:
    counter = _scanner(spark, vocabulary)

    @F.arrow_udf(returnType=FOUND)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        n_tokens = counter()
        for texts in batches:
            found = scan([t or b"" for t in byte_rows(texts)], n_tokens)
            yield pa.StructArray.from_arrays(
                [pa.array([sum(s[1] == k for s in spans) for spans in found], pa.int64())
                 for k in range(4)]
                + [pa.array([_written([s for s in spans if s[1] < 3]) for spans in found],
                            pa.string()),
                   pa.array([_written(spans) for spans in found], pa.string())],
                FOUND.names)

    return find(text)


def redacted_column(spark: SparkSession, text: Column, vocabulary: str = VOCABULARY) -> Column:
    """``text`` with the secret part of every span replaced; null stays null."""
    counter = _scanner(spark, vocabulary)

    @F.arrow_udf("string")
    def redact(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        n_tokens = counter()
        for texts in batches:
            rows = byte_rows(texts)
            out = rows[:]
            for at, spans in enumerate(scan([t or b"" for t in rows], n_tokens)):
                if spans:
                    out[at] = mask(rows[at].decode(), spans).encode()
            yield pa.array(out, pa.binary()).cast(pa.string())

    return redact(text)


def mask(text: str, spans: list[Span]) -> str:
    """Replace the union of the spans' secret parts, each stretch once."""
    parts, done = [], 0
    for start, end in sorted((secret, e) for _, _, e, secret in spans):
        if start > done or not parts:
            parts.append(text[done:start] + REDACTED)
        done = max(done, end)
    return "".join(parts) + text[done:]


def find_secrets(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    found = docs.select("doc_id", spans_column(
        docs.sparkSession, F.col("text").cast("string"), vocabulary).alias("f"))
    return found.select("doc_id", "f.n_assign", "f.n_access", "f.n_hex",
                        F.sha2("f.base", 256).alias("base_sha256"), "f.spans", "f.n_random")


def redact_secrets(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with secrets masked; ``n_chars``, where there is one, follows the text."""
    text = redacted_column(docs.sparkSession, F.col("text").cast("string"), vocabulary)
    out = docs.withColumn("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.length("text").cast(kind))
    return out.select(*docs.columns)
