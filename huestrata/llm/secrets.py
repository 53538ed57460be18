"""Secret scans: pattern candidates, confirmed by decoding and parsing their structure.

Base spans are the matches of three patterns. Structural confirmation adds spans: PEM blocks
whose body decodes to well-nested DER, base64 or hex strings that decode to such DER, to a
PEM block or to a base candidate, on one line or wrapped over several, and signed tokens whose header is a JSON object with an "alg".
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from huestrata.llm.common import per_text

# The base patterns and least lengths of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
KINDS = ["assign", "access", "hex", "pem", "der", "jwt", "nested"]

PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,40})-----([A-Za-z0-9+/=\s]*?)-----END \1-----")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_=-])")
HEX_ANY = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9a-f]{2}){16,}(?![0-9A-Fa-f])|(?<![0-9A-Fa-f])(?:[0-9A-F]{2}){16,}(?![0-9A-Fa-f])")
JWT = re.compile(r"(?<![A-Za-z0-9_.-])(ey[A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
#: A line's end of base64 with more at the start of the next line; wrapped values have lines of 16 letters at least.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?=[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-])")
_NEXT = re.compile(r"[ \t]*\r?\n[ \t]*([A-Za-z0-9+/_-]+={0,2})")
_BEFORE = re.compile(r"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]+)[ \t]*\r?\n[ \t]*\Z")
#: Letters that start a value one of the patterns above could match; without them a text has no such value.
_LONG = re.compile(r"[A-Za-z0-9+/_-]{24}")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """The contract's three kinds: leftmost non-overlapping matches, too short ones dropped afterwards."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def unbase64(value: str) -> bytes | None:
    """The bytes of a base64 or URL-safe base64 string, or None if it is not one in canonical form."""
    plain = value.rstrip("=").replace("-", "+").replace("_", "/")
    if len(plain) % 4 == 1:
        return None
    try:
        raw = base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None
    return raw if base64.b64encode(raw).decode().rstrip("=") == plain else None


def well_nested_der(raw: bytes, depth: int = 0) -> bool:
    """Whether raw is exactly one DER value that starts as key encodings do: a sequence whose nested lengths add up."""
    if depth == 0 and (len(raw) < 16 or raw[0] != 0x30):
        return False
    items, at = 0, 0
    while at < len(raw):
        if at + 2 > len(raw):
            return False
        tag, size = raw[at], raw[at + 1]
        at += 2
        if size & 0x80:
            k = size & 0x7F
            if not 1 <= k <= 4 or at + k > len(raw) or raw[at] == 0:
                return False
            size = int.from_bytes(raw[at : at + k], "big")
            at += k
            if size < 0x80:
                return False
        if at + size > len(raw) or tag & 0x1F == 0x1F:
            return False
        if tag & 0x20 and depth < 16 and not (size == 0 or well_nested_der(raw[at : at + size], depth + 1)):
            return False
        at += size
        items += 1
        if depth == 0 and items > 1:
            return False
    return items > 0


def openssh_key(raw: bytes) -> bool:
    """Whether raw has the length-prefixed fields of an OpenSSH private key."""
    magic = b"openssh-key-v1\0"
    if not raw.startswith(magic):
        return False
    at = len(magic)
    for _ in range(3):
        if at + 4 > len(raw):
            return False
        at += 4 + int.from_bytes(raw[at : at + 4], "big")
        if at > len(raw):
            return False
    return True


def key_encoding(raw: bytes | None) -> bool:
    return raw is not None and (well_nested_der(raw) or openssh_key(raw))


def signed_token(header: str, payload: str) -> bool:
    """Whether header and payload decode to JSON objects, the header with an "alg" string."""
    try:
        a, b = (json.loads((unbase64(x) or b"").decode("utf-8")) for x in (header, payload))
    except (ValueError, UnicodeDecodeError, RecursionError):
        return False
    return isinstance(a, dict) and isinstance(a.get("alg"), str) and isinstance(b, dict)


def hides_secret(raw: bytes | None) -> bool:
    """Whether decoded bytes are text that itself holds a base candidate or a PEM block."""
    if not raw:
        return False
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return bool(base_spans(text)) or any(key_encoding(unbase64("".join(m[2].split()))) for m in PEM.finditer(text))


def hidden_kind(raw: bytes | None) -> str:
    return "der" if key_encoding(raw) else "nested" if hides_secret(raw) else ""


def wrapped_spans(text: str) -> list[Span]:
    """Spans of base64 wrapped over lines: lines of one length, with or without a first and a shorter last one of another."""
    out: list[Span] = []
    at = 0
    while m := WRAPPED.search(text, at):
        pieces = [(m.start(), m.end())]
        if before := _BEFORE.search(text, max(at, m.start() - 400), m.start()):
            pieces.insert(0, before.span(1))
        while text[pieces[-1][1] - 1] != "=" and (more := _NEXT.match(text, pieces[-1][1])):
            pieces.append(more.span(1))
        size = [b - a for a, b in pieces]
        i = 0
        while i < len(pieces):
            j = i
            while j + 1 < len(pieces) and size[j + 1] == size[i]:
                j += 1
            if size[i] >= 16:
                for first, last in ((i - 1, j + 1), (i, j + 1), (i - 1, j), (i, j)):
                    if 0 <= first < last < len(pieces) and (last == j or size[last] < size[i]):
                        kind = hidden_kind(unbase64("".join(text[a:b] for a, b in pieces[first : last + 1])))
                        if kind:
                            out.append((kind, pieces[first][0], pieces[last][1]))
                            break
            i = j + 1
        at = max(m.end(), pieces[-1][1])
    return out


def confirmed_spans(text: str) -> list[Span]:
    """Spans that only decoding and parsing confirm."""
    out: list[Span] = []
    if "-----BEGIN " in text:
        out += [("pem", m.start(), m.end()) for m in PEM.finditer(text) if key_encoding(unbase64("".join(m[2].split())))]
    if "ey" in text and "." in text:
        out += [("jwt", m.start(), m.end()) for m in JWT.finditer(text) if signed_token(m[1], m[2])]
    if _LONG.search(text):
        for pattern, decode in ((BASE64, unbase64), (HEX_ANY, bytes.fromhex)):
            for m in pattern.finditer(text):
                kind = hidden_kind(decode(m[0]))
                if kind:
                    out.append((kind, m.start(), m.end()))
    whole = [x for x in wrapped_spans(text) if not any(k == "pem" and a <= x[1] and x[2] <= b for k, a, b in out)]
    if whole:  # a value found line by line as well counts once
        out = [x for x in out if x[0] not in ("der", "nested") or not any(a <= x[1] and x[2] <= b for _, a, b in whole)] + whole
    return out


def joined(spans: list[Span]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], order[s[0]], s[2])))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed.

    Offsets count code points, ends are exclusive. Null and empty texts have no spans (the
    digest is that of the empty string). Ids of any type, null and repeated ones pass through
    as they are; rows are handled one by one, without any shuffle; other columns are ignored.
    """

    def scan(texts: list[str]) -> list:
        out = []
        for text in texts:
            base, more = base_spans(text), confirmed_spans(text)
            n = [sum(s[0] == k for s in base) for k in ("assign", "access", "hex")]
            out.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more)))
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        return [pa.array([row[i] for row in out], kind) for i, kind in enumerate(kinds)]

    return per_text(docs, id_col, text_col, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long", scan)
