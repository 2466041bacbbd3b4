"""Secret scans: fixed patterns, and novelty of strings by dictionary-primed zstandard.

Three fixed kinds of spans are found by pattern. Further candidates are all token-like runs
near a key or credential word, over schemes (``Basic``, ``Bearer``), quotes and line ends, and
the lines that go on with key material. A candidate's novelty is the number of bytes it adds
to the compressed text around it (plain text where there is little), other candidates left out, with a compressor primed by
common identifiers: names, words and paths add about half their length, random strings all of
it. Strings without small letters are judged in lower case, so that constants in capitals are
no novelty. Those that add most of their bytes are reported as ``novel``.

Cases: null or empty text has no spans; a span found by a fixed pattern is never reported
again as novel; equal starts are ordered assign, access, hex, novel; repeated rows are
scanned one by one; very long texts are scanned whole, in time linear in their length; an
empty table gives an empty result; further columns are ignored. Not reported: phrases of
plain words, and short strings of one or two kinds of characters.
"""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from railguard.llm.common import code_points, map_documents, sha256_hex

# Fixed values of the contract.
ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")  # maximal runs, as [0-9a-f]+ with a length of 24 at least
KINDS = ["assign", "access", "hex", "novel"]

#: Words one of which an assignment needs.
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Words that make the string after them sensitive; the pattern takes each of them, so that a
#: text without any has no candidates.
CONTEXT_WORDS = (
    b"auth", b"bearer", b"credential", b"private", b"signature", b"session", b"pwd", b"passphrase",
    b"password", b"passwd", b"secret", b"token", b"key",
)
CONTEXT = re.compile(rb"(?:" + b"|".join(CONTEXT_WORDS) + rb")([A-Za-z0-9_]*)", re.IGNORECASE)
RUN = re.compile(rb"[A-Za-z0-9+/][A-Za-z0-9+/_.=~-]{7,}")
#: A run starts within so many bytes after a context word.
WINDOW = 96
#: A run of so many bytes is key material: one that starts right after it is a candidate, too.
LINE_BYTES = 40
LINE_GAP = 3
#: Bytes before and after a candidate that it is compressed with.
AROUND = 256
#: Plain text put before surroundings shorter than that: bytes are told apart by how often they
#: occur, which a few of them do not show.
PLAIN = (
    b"This part of the file says how the service is set up. Most of what stands here is read once, when the "
    b"program begins, and does not change while it runs; later values win over earlier ones. Names are written "
    b"in small letters with lines between words, as in first_name or max_size, or joined as in firstName. Paths "
    b"like /var/log/app/current.log or docs.project.org/guide/index.html may be given in full. Numbers such as "
    b"0, 12, 345, 6789 or 2023-08-17 need no quotes. Old entries can be kept as notes, so that others see why."
)
#: A candidate is novel if it adds this share of its bytes at least; less where it has letters of
#: one case alone, of which a random one tells 4.7 bits and not 6.
NOVEL_SHARE = 0.85
ONE_CASE_SHARE = 0.68
#: Shorter strings tell too little by their bytes alone: they must also mix capitals, small
#: letters and digits.
SHORT_BYTES = 16
MIXED = (re.compile(rb"[A-Z]"), re.compile(rb"[a-z]"), re.compile(rb"[0-9]"))

IDENTIFIERS = b" ".join(
    b"""
    access_token refresh_token session_id client_id client_secret authorization authentication bearer
    username password passphrase credentials private_key public_key secret_key api_key signature certificate
    configuration environment variable default example placeholder your_token_here changeme undefined null
    true false none self this return function class import export const let var public private protected static
    string integer boolean double float object array list dictionary value values index length count number name
    description created_at updated_at timestamp request response header headers content type application json
    http https localhost database connection host port user server client service account region bucket
    abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000000000000000 xxxxxxxxxxxxxxxxxxxx
    """.split()
)


def base_spans(text: bytes) -> list[tuple[int, int, str]]:
    """Byte spans of the fixed patterns; matches that fail their check are dropped."""
    lowered = text.lower()
    spans = []
    if any(w in lowered for w in ASSIGN_WORDS):
        spans += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in text:
        spans += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return spans


class Novelty:
    """Marginal compressed bytes of a string against the text around it."""

    def __init__(self):
        primed = zstandard.ZstdCompressionDict(IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compress = zstandard.ZstdCompressor(level=6, dict_data=primed, write_content_size=False).compress

    def marginal(self, before: bytes, value: bytes, after: bytes) -> int:
        around = before + after
        around = PLAIN[: max(0, 2 * AROUND - len(around))] + around
        return len(self.compress(around + value)) - len(self.compress(around))

    def added(self, text: bytes, start: int, end: int) -> int:
        return self.marginal(text[max(0, start - AROUND) : start], text[start:end], text[end : end + AROUND])

    def spans(self, text: bytes, known: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        runs = candidates(text, known)
        if not runs:
            return []
        edges = [0, *[p for run in runs for p in run], len(text)]
        bare = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
        found, gone = [], 0
        for start, end in runs:
            at, value = start - gone, text[start:end]
            gone += end - start
            if len(value) < SHORT_BYTES and not all(kind.search(value) for kind in MIXED):
                continue
            if value.isdigit():
                continue
            before, after = bare[max(0, at - AROUND) : at], bare[at : at + AROUND]
            judged = value if MIXED[1].search(value) else value.lower()
            share = ONE_CASE_SHARE if judged.isalpha() and judged.islower() else NOVEL_SHARE
            if self.marginal(before, judged, after) >= share * len(value):
                found.append((start, end, "novel"))
        return found


def candidates(text: bytes, known: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Token-like runs in sensitive context that no known span touches, in order, none overlapping."""
    lowered = text.lower()
    if not any(w in lowered for w in CONTEXT_WORDS):
        return []
    runs: list[tuple[int, int]] = []
    done = 0
    for m in CONTEXT.finditer(text):
        # A long rest of the word may be the string itself, as in api_key_Qz8v...
        at = max(done, m.start(1) if len(m[1]) >= SHORT_BYTES else m.end())
        limit = m.end() + WINDOW
        while run := RUN.search(text, at, max(at, limit) + 8):
            if run.start() >= limit:
                break
            end = RUN.match(text, run.start()).end()
            at = done = end
            runs.append((run.start(), run.start() + len(text[run.start() : end].rstrip(b"."))))
            if end - run.start() >= LINE_BYTES:
                limit = max(limit, end + LINE_GAP)
    ranges = sorted((s, e) for s, e, _ in known)
    free, n, reach = [], 0, 0
    for start, end in runs:
        while n < len(ranges) and ranges[n][0] < end:
            reach = max(reach, ranges[n][1])
            n += 1
        if reach <= start:
            free.append((start, end))
    return free


def listed(text: bytes, spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end in code points, by start and then by kind as listed."""
    parts, at, points = [], 0, 0
    for start, end, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))):
        points += code_points(text[at:start])
        at = start
        parts.append(f"{kind}:{points}:{points + code_points(text[start:end])}")
    return ",".join(parts)


def redact(text: bytes, spans: list[tuple[int, int, str]], mask: bytes = b"[SECRET]") -> bytes:
    """The text with every run of overlapping spans replaced by the mask."""
    kept, at, masked = [], 0, -1
    for start, end, _ in sorted(spans):
        if start > masked:
            kept += [text[at:start], mask]
        at = masked = max(masked, end)
    return b"".join([*kept, text[max(at, 0) :]])


def scanned(docs: DataFrame, carry: list[str], redacted: bool = False) -> DataFrame:
    """``row``, counts per fixed kind, digest of the fixed spans, all spans, redacted text."""

    def make():
        novelty = Novelty()

        def step(texts, part):
            out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
            clean = []
            for text in texts:
                spans = base_spans(text) if text else []
                novel = novelty.spans(text, spans) if text else []
                for kind in KINDS[:3]:
                    out[f"n_{kind}"].append(sum(s[2] == kind for s in spans))
                base = listed(text or b"", spans)
                out["base_sha256"].append(sha256_hex(base))
                out["spans"].append(listed(text, spans + novel) if novel else base)
                clean.append(redact(text, spans + novel) if spans or novel else text)
            if redacted:
                out["redacted"] = pa.array(clean, pa.binary()).cast(pa.string())
            return out

        return step

    own = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    return map_documents(docs, carry, own + ", redacted string" * redacted, make)


def redact_documents(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with secrets masked in ``text`` and ``n_chars`` counted anew."""
    done = scanned(docs, docs.columns, redacted=True)
    columns = {"text": F.col("redacted"), "n_chars": F.coalesce(F.length("redacted"), F.lit(0)).cast("bigint")}
    return done.select(
        *[
            F.when(F.col("spans") != "", columns[c]).otherwise(F.col(f"row.`{c}`")).alias(c)
            if c in columns
            else F.col(f"row.`{c}`").alias(c)
            for c in docs.columns
        ]
    )


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scanned(docs, ["doc_id"]).select("row.doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
