"""Secret scans with structural confirmation.

Three base kinds are reported by pattern alone. Further kinds are reported only after their bytes were decoded and
parsed:

* "jwt": a signed token, whose header is JSON with an algorithm and whose payload is a JSON object;
* "der": base64 or hex of a private key in DER whose nested lengths fill it exactly: PKCS#1, DSA, SEC1, or PKCS#8 with a
  known algorithm, plain or encrypted, each with its own number and types of fields;
* "ssh": base64 of an OpenSSH private key whose length-prefixed fields fill it exactly;
* "pem": a private key block whose body is one of the two.
Public keys, signatures and certificates are no secrets and are left out. Every candidate is looked at once, from
where its run of letters begins, so long runs cost time in proportion; nesting has no limit but the length.

Cases: a null or empty text has no spans; repeated rows give repeated results; other columns are ignored; an empty
table gives an empty result. Offsets are code points, the end exclusive; spans are ordered by start, then kind.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship, whole_text

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Three parts between dots; a part is looked at from its first letter only, and not consumed: it may be any of the three.
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(?=([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]*+))")
_B64 = re.compile(r"(?<![A-Za-z0-9+/])M[A-P][A-Za-z0-9+/]{30,}+={0,2}")
_HEX_DER = re.compile(r"(?<![0-9A-Fa-f])30(?:[0-9A-Fa-f]{2}){23,}+(?![0-9A-Fa-f])")
_SSH = re.compile(r"(?<![A-Za-z0-9+/])b3BlbnNzaC1rZXktdjE[A-Za-z0-9+/]++={0,2}")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----([A-Za-z0-9+/=\s]++)-----END \1-----", re.A)
KINDS = ("assign", "access", "hex", "jwt", "der", "ssh", "pem")

# Tags of ASN.1, algorithm identifiers of RFC 8017, 3279, 5480, 8410 and 8018, OpenSSH's magic.
_INTEGER, _BITS, _OCTETS, _OID, _SEQUENCE = 0x02, 0x03, 0x04, 0x06, 0x30
_KEY_ALGORITHMS = (
    "1.2.840.113549.1.1.1",  # RSA
    "1.2.840.113549.1.1.10",  # RSA with PSS
    "1.2.840.113549.1.3.1",  # Diffie-Hellman
    "1.2.840.10040.4.1",  # DSA
    "1.2.840.10045.2.1",  # elliptic curves
    "1.3.101.110",  # X25519
    "1.3.101.111",  # X448
    "1.3.101.112",  # Ed25519
    "1.3.101.113",  # Ed448
)
_ENCRYPTION_ALGORITHMS = ("1.2.840.113549.1.5.13", "1.2.840.113549.1.5.3", "1.2.840.113549.1.5.10", "1.2.840.113549.1.12.1.3")
_OPENSSH = b"openssh-key-v1\0"


def unbase64(s: str, url: bool = False) -> bytes | None:
    s = s.rstrip("=")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


@dataclass
class Element:
    """A tag, the bytes of its content, and the elements within, where it is a constructed one."""

    tag: int
    content: memoryview
    parts: list[Element]


def asn1(data: bytes) -> Element | None:
    """The one DER element that fills the bytes exactly, with all that it nests; None if any length doesn't fit."""
    view = memoryview(data)
    root: list[Element] = []
    open_: list[tuple[int, list[Element]]] = [(len(data), root)]  # ends of the elements that are being read, with their parts
    at = 0
    while open_:
        end, parts = open_[-1]
        if at == end:
            open_.pop()
            continue
        if end - at < 2:
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if tag & 0x1F == 0x1F:
            return None  # keys have no tags of several bytes
        if n >= 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > end or data[at] == 0:
                return None
            n = int.from_bytes(data[at : at + k], "big")
            if n < 0x80:
                return None
            at += k
        if at + n > end:
            return None
        element = Element(tag, view[at : at + n], [])
        parts.append(element)
        if tag & 0x20:
            open_.append((at + n, element.parts))
        else:
            at += n
    return root[0] if len(root) == 1 else None


def _tags(e: Element) -> list[int]:
    return [p.tag for p in e.parts]


def _whole(e: Element) -> int | None:
    """The value of a shortest-form INTEGER that is not negative."""
    c = e.content
    if e.tag != _INTEGER or not len(c) or c[0] & 0x80 or (len(c) > 1 and c[0] == 0 and not c[1] & 0x80):
        return None
    return int.from_bytes(c, "big")


def _object_id(e: Element) -> str:
    """The dotted form of an OBJECT IDENTIFIER; empty for anything else."""
    if e.tag != _OID or not len(e.content) or e.content[-1] & 0x80 or len(e.content) > 64:
        return ""
    numbers, n = [], 0
    for byte in e.content:
        n = n << 7 | byte & 0x7F
        if not byte & 0x80:
            numbers.append(n)
            n = 0
    first = min(numbers[0] // 40, 2)
    return ".".join(map(str, (first, numbers[0] - 40 * first, *numbers[1:])))


def _is_algorithm(e: Element, known: tuple[str, ...]) -> bool:
    return e.tag == _SEQUENCE and 1 <= len(e.parts) <= 2 and _object_id(e.parts[0]) in known


def _is_integers(key: Element) -> bool:
    """PKCS#1 RSA (nine numbers, and the further primes in version 1) or DSA (six): none is 0 but the version."""
    n = len(key.parts)
    more = n == 10 and key.parts[9].tag == _SEQUENCE and bool(key.parts[9].parts)
    values = [_whole(p) for p in key.parts[: 9 if more else n]]
    return (more or n in (6, 9)) and all(values[1:]) and values[0] == int(more)


def _is_curve_key(key: Element) -> bool:
    """SEC1: version 1, the private value, and optionally the curve and the public point."""
    tags = _tags(key)
    if tags[:2] != [_INTEGER, _OCTETS] or _whole(key.parts[0]) != 1 or not 16 <= len(key.parts[1].content) <= 66:
        return False
    rest = {p.tag: p.parts for p in key.parts[2:]}
    if tags[2:] not in ([], [0xA0], [0xA1], [0xA0, 0xA1]):
        return False
    curve, point = rest.get(0xA0), rest.get(0xA1)
    return (curve is None or (len(curve) == 1 and (bool(_object_id(curve[0])) or curve[0].tag == _SEQUENCE))) and (point is None or [p.tag for p in point] == [_BITS])


def _is_pkcs8(key: Element) -> bool:
    """PKCS#8: version, a key's algorithm, the key; or the encryption's algorithm and the encrypted key."""
    tags = _tags(key)
    if tags == [_SEQUENCE, _OCTETS]:
        return _is_algorithm(key.parts[0], _ENCRYPTION_ALGORITHMS) and len(key.parts[1].content) >= 8
    if tags[:3] != [_INTEGER, _SEQUENCE, _OCTETS] or _whole(key.parts[0]) not in (0, 1) or not len(key.parts[2].content):
        return False
    return tags[3:] in ([], [0xA0], [0xA1], [0x81], [0xA0, 0xA1], [0xA0, 0x81]) and _is_algorithm(key.parts[1], _KEY_ALGORITHMS)


def is_key_der(data: bytes | None) -> bool:
    """A private key in DER."""
    key = asn1(data) if data and data[0] == _SEQUENCE else None
    return key is not None and (_is_integers(key) or _is_curve_key(key) or _is_pkcs8(key))


def _field(data: bytes, at: int) -> tuple[bytes, int]:
    """A field with its length before it, and where the next one begins."""
    n = int.from_bytes(data[at : at + 4], "big")
    if at + 4 + n > len(data) or at + 4 > len(data):
        raise ValueError("field too long")
    return data[at + 4 : at + 4 + n], at + 4 + n


def is_openssh_key(data: bytes | None) -> bool:
    """OpenSSH's private key: magic, cipher, key derivation, its options, the number of keys, that many public keys and
    the private part, which fill the bytes; each public key starts with the name of its type."""
    if not data or not data.startswith(_OPENSSH):
        return False
    try:
        cipher, at = _field(data, len(_OPENSSH))
        derivation, at = _field(data, at)
        _, at = _field(data, at)
        n, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        if not cipher or not derivation or not 1 <= n <= len(data) // 8:
            return False
        for _ in range(n):
            public, at = _field(data, at)
            name, _ = _field(public, 0)
            if not name.isascii() or not name:
                return False
        private, at = _field(data, at)
    except ValueError:
        return False
    return at == len(data) and len(private) >= 8 and len(private) % 8 == 0


def is_signed_token(head: str, body: str, signature: str) -> bool:
    raw = [unbase64(p, url=True) for p in (head, body)]
    if not all(x and x[:1] == b"{" and x.rstrip().endswith(b"}") for x in raw):
        return False
    try:
        first, second = map(json.loads, raw)
    except (ValueError, RecursionError):
        return False
    return isinstance(first, dict) and isinstance(first.get("alg"), str) and isinstance(second, dict) and (bool(signature) or first["alg"] == "none")


def is_private_block(body: str) -> bool:
    data = unbase64("".join(body.split()))
    return is_key_der(data) or is_openssh_key(data)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three base kinds."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _tokens(text: str) -> Iterator[tuple[int, int, int]]:
    """Signed tokens; one starts at the first `eyJ` (base64 of an object's first two characters) of its part."""
    for m in _TOKEN.finditer(text):
        at = m[1].find("eyJ")
        if at >= 0 and is_signed_token(m[1][at:], m[2], m[3]):
            yield m.start(1) + at, 3, m.end(3)


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of candidates whose decoded structure holds."""
    out: list[tuple[int, int, int]] = []
    if "eyJ" in text:
        out += _tokens(text)
    out += [(m.start(), 4, m.end()) for m in _B64.finditer(text) if is_key_der(unbase64(m[0]))]
    out += [(m.start(), 4, m.end()) for m in _HEX_DER.finditer(text) if is_key_der(bytes.fromhex(m[0]))]
    if "b3BlbnNza" in text:
        out += [(m.start(), 5, m.end()) for m in _SSH.finditer(text) if is_openssh_key(unbase64(m[0]))]
    if "-----BEGIN" in text:
        out += [(m.start(), 6, m.end()) for m in _PEM.finditer(text) if is_private_block(m[2])]
    return sorted(set(out))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{i}:{j}" for i, k, j in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts, sha, spans = [[], [], []], [], []
        for text in b["text"].to_pylist():
            base = base_spans(text)
            for k in range(3):
                counts[k].append(sum(x[1] == k for x in base))
            sha.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined(sorted(base + confirmed_spans(text))))
        yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(spans, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    ship(docs.sparkSession)
    rows = docs.select("doc_id", whole_text().alias("text"))
    return rows.mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
