"""Secret scans: pattern candidates, and spans whose decoded structure confirms a key or a token.

Patterns find the base kinds (assign, access, hex). Beside them, long runs of base64 or hex are
decoded and reported only if what comes out parses to its end: a DER sequence whose nested lengths
add up, an OpenSSH private key container or public key blob whose length-prefixed fields all fit, or a
signed token whose header and payload are JSON objects and whose header names an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans that start together are listed.
BASE_KINDS = ("assign", "access", "hex")
CONFIRMED_KINDS = ("token", "pem", "ssh", "der", "hexder")
KINDS = BASE_KINDS + CONFIRMED_KINDS

# re.ASCII with re.IGNORECASE: only A-Z and a-z are alike
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# a run is never cut short, so the shortest length may stand in the pattern
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
_ANY_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{32,}(?![0-9A-Fa-f])")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
# after the first line a block may have headers (a name, a colon, a value), which an empty line ends
_PEM = re.compile(
    r"-----BEGIN ([A-Z0-9 ]{1,40})-----[ \t]*\r?\n?((?:[A-Za-z0-9-]+:[^\n]*\n(?:[ \t][^\n]*\n)*)*)([A-Za-z0-9+/=\s]*?)-----END \1-----", re.ASCII
)
_LOCKED = re.compile(r"^DEK-Info:[ \t]*[A-Z0-9-]+,[ \t]*[0-9A-Fa-f]{16,32}[ \t]*\r?$", re.MULTILINE)


def _decoded(run: str) -> bytes | None:
    """Base64 in either alphabet, padded or not."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_end(data: bytes, at: int = 0, depth: int = 0, end: int | None = None) -> int | None:
    """Where the DER value at ``at`` ends, or None if it or a value inside it doesn't fit."""
    end = len(data) if end is None else end
    if depth > 16 or at + 2 > end:
        return None
    tag, length, at = data[at], data[at + 1], at + 2
    if tag & 0x1F == 0x1F:
        return None
    if length & 0x80:
        width = length & 0x7F
        if not 1 <= width <= 4 or at + width > end:
            return None
        length, at = int.from_bytes(data[at : at + width], "big"), at + width
        if length < 128:
            return None  # DER has the shortest form only
    stop = at + length
    if stop > end:
        return None
    if tag & 0x20:  # constructed: its members fill it
        while at < stop:
            if (at := der_end(data, at, depth + 1, stop)) is None:
                return None
        if at != stop:
            return None
    return stop


def is_der_key(data: bytes) -> bool:
    """A sequence over the whole of ``data`` that holds an integer or a sequence first, as keys do."""
    return len(data) >= 24 and data[0] == 0x30 and der_end(data) == len(data) and data[2 + (data[1] & 0x7F if data[1] & 0x80 else 0)] in (0x02, 0x30)


def _fields(data: bytes, at: int = 0) -> list[bytes] | None:
    """The length-prefixed fields from ``at`` on, if the last one ends with ``data``."""
    out = []
    while at + 4 <= len(data):
        stop = at + 4 + int.from_bytes(data[at : at + 4], "big")
        out.append(data[at + 4 : stop])
        at = stop
    return out if at == len(data) else None


_SSH_KIND = re.compile(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]{3,60}\Z")
_SSH_MAGIC = b"openssh-key-v1\0"
#: Names of ciphers end with one of these; of key derivations there are two.
_CIPHERS, _DERIVATIONS = re.compile(rb"(none|[a-z0-9-]+(-cbc|-ctr|@openssh\.com))\Z"), (b"none", b"bcrypt")


def is_ssh_blob(data: bytes) -> bool:
    """A public key: the name of its kind, then one field or more, the last of which ends the blob."""
    fields = _fields(data)
    return fields is not None and len(fields) >= 2 and _SSH_KIND.match(fields[0]) is not None and all(len(f) for f in fields[1:2])


def is_ssh_container(data: bytes) -> bool:
    """A private key file: cipher, derivation and its options, the number of keys, their blobs, and the encrypted part.

    Unencrypted parts begin with two equal check numbers and a kind, and are padded with 1, 2, 3 ...
    """
    at, fields = len(_SSH_MAGIC), []
    if not data.startswith(_SSH_MAGIC):
        return False

    def field() -> bytes | None:
        nonlocal at
        if at + 4 > len(data):
            return None
        start, stop = at + 4, at + 4 + int.from_bytes(data[at : at + 4], "big")
        if stop > len(data):
            return None
        at = stop
        return data[start:stop]

    fields = [field() for _ in range(3)]
    if None in fields or not _CIPHERS.match(fields[0]) or fields[1] not in _DERIVATIONS or (fields[0] == b"none") != (fields[1] == b"none"):
        return False
    count, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not 1 <= count <= 64:
        return False
    for _ in range(count):
        if (blob := field()) is None or not is_ssh_blob(blob):
            return False
    secret = field()
    if secret is None or len(secret) < 16 or len(secret) % 8:
        return False
    if fields[0] == b"none":
        kind = int.from_bytes(secret[8:12], "big")
        if secret[:4] != secret[4:8] or not _SSH_KIND.match(secret[12 : 12 + kind]):
            return False
    return len(data) - at in (0, 16)  # some ciphers leave a check sum behind


def is_ssh_key(data: bytes) -> bool:
    return is_ssh_container(data) if data.startswith(_SSH_MAGIC) else is_ssh_blob(data)


def is_signed_token(run: str) -> bool:
    header, payload, _ = run.split(".", 2)
    try:
        head, body = (json.loads(_decoded(x) or b"") for x in (header, payload))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(body, dict) and isinstance(head.get("alg"), str)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if any(len(x) >= 20 for x in text.split()):  # neither kind holds white space
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
        found += [(m.start(), m.end(), "hex") for m in _LONG_HEX.finditer(text)]
    return _sorted(found)


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans that decode to a key or a signed token."""
    found = []
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            data = _decoded(re.sub(r"\s", "", m[3]))
            # an encrypted body has no structure to see: its headers name the cipher, and it comes in whole blocks
            locked = "ENCRYPTED" in m[2] and _LOCKED.search(m[2]) is not None and bool(data) and len(data) % 8 == 0
            if data and (locked or is_der_key(data) or is_ssh_key(data)):
                found.append((m.start(), m.end(), "pem"))
    if any(len(x) >= 32 for x in text.split()):
        if "." in text:
            found += [(m.start(), m.end(), "token") for m in _TOKEN.finditer(text) if is_signed_token(m[0])]
        for m in _BASE64.finditer(text):
            data = _decoded(m[0])
            if data and is_der_key(data):
                found.append((m.start(), m.end(), "der"))
            elif data and is_ssh_key(data):
                found.append((m.start(), m.end(), "ssh"))
        for m in _ANY_HEX.finditer(text):
            if len(m[0]) % 2 == 0 and is_der_key(bytes.fromhex(m[0])):
                found.append((m.start(), m.end(), "hexder"))
    return _sorted(found)


def _sorted(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))


def _scan_batches(values: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digests, all_spans, records = [], [], [], []
            for x in b.column(1):
                text = x.as_py() or ""
                base = base_spans(text)
                spans = _sorted(base + confirmed_spans(text))
                counts.append([sum(s[2] == k for s in base) for k in BASE_KINDS])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                all_spans.append(joined(spans))
                records.append([{"kind": k, "start": i, "end": j, "value": text[i:j] if values else None} for i, j, k in spans])
            columns = [b.column(0), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(3))]
            columns += [pa.array(digests, pa.string()), pa.array(all_spans, pa.string()), pa.array(records, _SPAN)]
            yield pa.RecordBatch.from_arrays(
                columns, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"]
            )

    return run


def scan_secrets(docs: DataFrame, values: bool = True) -> DataFrame:
    """One row for each row of ``docs``, with all spans of its whole text.

    doc_id; n_assign, n_access, n_hex: base spans of each kind; base_sha256 of the joined base spans;
    spans: all spans joined as kind:start:end (code points, end exclusive); found: the same as an
    array of structs, with the text of each span where ``values`` is set.
    Null and empty texts have no span, as have texts without a match; repeated rows each get a row;
    overlapping spans of different kinds are all listed; other columns are not read.
    """
    schema = (
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
        "found array<struct<kind:string,start:long,end:long,value:string>>"
    )
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(_scan_batches(values), schema)
