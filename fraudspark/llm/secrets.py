"""Secret scan: Aho-Corasick keywords first, anchored patterns only at their hits, checksums where a token has one.

One automaton walks the lower-cased text and reports where a keyword ends; a pattern is then tried at that
place only. Runs of hexadecimal digits have no keyword: a byte map finds runs of sixteen, and the run itself
is the match. Tokens that carry a checksum (access tokens with a CRC32 in base 62, extended keys in base58
with a double SHA-256) are reported only where it is right.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame

from fraudspark.llm.common import UPPER, per_batch, whole_text

# Kinds in the order in which equal starts are listed, keywords, patterns, alphabets.
KINDS = ("assign", "access", "hex", "crc", "xkey")
BASE_KINDS = ("assign", "access", "hex")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS_WORD = "akia"
CRC_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
XKEY_WORDS = ("xprv", "xpub")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
CRC = r"(?:gh[pousr]|npm)_[A-Za-z0-9]{36}(?![A-Za-z0-9])"
XKEY = r"xp(?:rv|ub)[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16

LOWER = str.maketrans(UPPER, UPPER.lower())
HEX_MAP = bytes(ord("h") if chr(c) in "0123456789abcdef" else 32 for c in range(256))
HEX_RUN = b"h" * LEAST_HEX


def crc_holds(token: str) -> bool:
    """The last six characters are the CRC32 of those between the prefix and them, in base 62."""
    body, check = token[4:-6], token[-6:]
    value = zlib.crc32(body.encode())
    digits = ""
    while value:
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits.rjust(6, "0") == check


def xkey_holds(token: str) -> bool:
    """Base58 with the first four bytes of a double SHA-256 at its end."""
    value = 0
    for c in token:
        value = value * 58 + BASE58.index(c)
    data = value.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(data[:-4]).digest()).digest()[:4] == data[-4:]


class Scanner:
    """Built once per task, from constants only."""

    def __init__(self):
        import ahocorasick

        self.words = ahocorasick.Automaton()
        for kind, words in (("assign", ASSIGN_WORDS), ("access", (ACCESS_WORD,)), ("crc", CRC_WORDS), ("xkey", XKEY_WORDS)):
            for word in words:
                self.words.add_word(word, (kind, len(word)))
        self.words.make_automaton()
        self.assign, self.access = re.compile(ASSIGN, re.ASCII | re.IGNORECASE), re.compile(ACCESS)
        self.crc, self.xkey, self.hex = re.compile(CRC), re.compile(XKEY), re.compile(HEX)

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        found: list[tuple[int, str, int]] = []
        lower = text.lower() if text.isascii() else text.translate(LOWER)
        past = dict.fromkeys(KINDS, 0)
        hits = [(end + 1 - size, kind) for end, (kind, size) in self.words.iter(lower)]
        for start, kind in sorted(hits) if len(hits) > 1 else hits:
            if start < past[kind]:
                continue  # inside the last match of the kind
            match = getattr(self, kind).match(text, start)
            if match is None:
                continue
            past[kind] = match.end()
            if self._holds(kind, match):
                found.append((start, kind, match.end()))
        data = text.encode("latin-1", "replace").translate(HEX_MAP)  # a byte per code point
        at = data.find(HEX_RUN)
        while at >= 0:
            match = self.hex.match(text, at)
            found.append((at, "hex", match.end()))
            at = data.find(HEX_RUN, match.end())
        found.sort(key=lambda x: (x[0], KINDS.index(x[1])))
        return found

    @staticmethod
    def _holds(kind: str, match: re.Match) -> bool:
        if kind == "assign":
            return len(match[2]) >= LEAST_ASSIGN
        if kind == "access":
            return len(match[0]) >= LEAST_ACCESS
        return crc_holds(match[0]) if kind == "crc" else xkey_holds(match[0])


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per document of ``docs`` (doc_id, text): counts, digest and spans of all secrets in the whole text.

    Spans are code points, end exclusive. A null or empty text has none; repeated rows are scanned each.
    """
    schema = "doc_id {}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_checked long".format(docs.schema["doc_id"].dataType.simpleString())

    def scan_all(batches):
        scanner = Scanner()

        def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in batch["text"].to_pylist():
                found = scanner.spans(text)
                counts = [sum(k == kind for _, k, _ in found) for kind in BASE_KINDS]
                base = ",".join(f"{k}:{a}:{b}" for a, k, b in found if k in BASE_KINDS)
                rows.append((*counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for a, k, b in found), len(found) - sum(counts)))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            return pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_checked"],
            )

        yield from per_batch(scan)(batches)

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(scan_all, schema)
