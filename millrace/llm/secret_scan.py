"""Secrets in texts: patterns, and structures that candidates must confirm.

Three patterns report by shape alone: assignments to names of credentials, access ids and runs of hex digits. The
method adds what only decoding can tell. Candidates are long base64 runs (wrapped lines included) and hex runs; their
bytes must parse as a private key: DER whose nested lengths fill each other exactly (PKCS#1, PKCS#8, encrypted or not,
SEC1, DSA), or an OpenSSH container whose length-prefixed fields do. Decoded ASCII is searched again, so a key inside
base64 inside hex is found. Three dotted base64url parts are a signed token if the first decodes to a JSON object with
a text `alg` other than none, and the others decode. A candidate that does not parse is not reported.

Null counts as empty and has no findings. Repeated rows get equal findings; an empty table gives no rows. Extra
columns pass through; `findings` and `redacted` replace columns of those names. Texts are scanned whole, one at a time.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.pretokens import slices

#: In the order in which findings of one start are listed; the first three are reported by shape alone.
KINDS = ("assign", "access", "hex", "pkcs1", "pkcs8", "sec1", "dsa", "openssh", "jwt")
BASE_KINDS = KINDS[:3]
ASSIGN_CHARS = 12
#: Decodings inside decodings that are looked into.
DEPTH = 3

# The patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: One of these is in every text with an assignment.
NAMES = ("passw", "secret", "token", "api")

BASE64_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}(?:(?:\r?\n|\\n)[ \t]*[A-Za-z0-9+/_-]+)*={0,2}")
HEX_RUN = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}(?![0-9A-Fa-f])")
#: The base64 of a brace and of what may follow it in JSON.
TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])(e[wy][A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]{2,})(?![A-Za-z0-9_.-])")
_BREAK = re.compile(r"(?:\r?\n|\\n)[ \t]*")

INTEGER, BITS, OCTETS, OID, SEQUENCE = 0x02, 0x03, 0x04, 0x06, 0x30
RSA = bytes.fromhex("2a864886f70d010101")
ELLIPTIC = bytes.fromhex("2a8648ce3d0201")
OPENSSH = b"openssh-key-v1\0"

Node = tuple[int, int, int, int]  # tag, first byte of the whole, of the content, end
Span = tuple[int, int, str]  # start, end, kind


def _node(raw: bytes, at: int, end: int) -> Node | None:
    """The DER element at `at`, if its length is minimal and ends by `end`."""
    if at + 2 > end:
        return None
    n, start = raw[at + 1], at + 2
    if n >= 0x80:
        width = n & 0x7F
        if not 0 < width <= 4 or start + width > end or raw[start] == 0:
            return None
        n = int.from_bytes(raw[start : start + width], "big")
        start += width
        if n < 0x80:
            return None
    return (raw[at], at, start, start + n) if start + n <= end else None


def _children(raw: bytes, node: Node, most: int = 12) -> list[Node] | None:
    """What fills a sequence exactly; None if something does not fit or there is too much."""
    found, at = [], node[2]
    while at < node[3]:
        child = _node(raw, at, node[3])
        if child is None or len(found) == most:
            return None
        found.append(child)
        at = child[3]
    return found


def _content(raw: bytes, node: Node) -> bytes:
    return raw[node[2] : node[3]]


def _algorithm(raw: bytes, node: Node) -> bytes | None:
    """The object id of an algorithm identifier: (id) or (id, parameters)."""
    if node[0] != SEQUENCE:
        return None
    parts = _children(raw, node)
    return _content(raw, parts[0]) if parts and len(parts) <= 2 and parts[0][0] == OID and parts[0][3] > parts[0][2] else None


def der_key(raw: bytes) -> tuple[str, int] | None:
    """The kind and length of the private key that the bytes start with."""
    top = _node(raw, 0, len(raw))
    if top is None or top[0] != SEQUENCE:
        return None
    parts = _children(raw, top)
    kind = _key_kind(raw, parts) if parts else None
    return (kind, top[3]) if kind else None


def _key_kind(raw: bytes, parts: list[Node]) -> str | None:
    tags = [p[0] for p in parts]
    if tags == [SEQUENCE, OCTETS]:  # encrypted: scheme with parameters, whole cipher blocks
        size = parts[1][3] - parts[1][2]
        scheme = _children(raw, parts[0])
        return "pkcs8" if scheme and len(scheme) == 2 and scheme[1][0] == SEQUENCE and _algorithm(raw, parts[0]) and size >= 16 and size % 8 == 0 else None
    if tags[0] != INTEGER or parts[0][3] - parts[0][2] != 1:
        return None
    version = raw[parts[0][2]]
    if all(t == INTEGER and p[3] > p[2] for t, p in zip(tags, parts, strict=True)):
        return "pkcs1" if (version == 0 and len(parts) == 9) else "dsa" if (version == 0 and len(parts) == 6) else None
    if tags[1] == OCTETS:
        size = parts[1][3] - parts[1][2]
        return "sec1" if version == 1 and 16 <= size <= 72 and set(tags[2:]) <= {0xA0, 0xA1} else None
    if version > 1 or len(parts) < 3 or tags[2] != OCTETS or not set(tags[3:]) <= {0xA0, 0x81, 0xA1}:
        return None
    name, inner = _algorithm(raw, parts[1]), _content(raw, parts[2])
    if name is None:
        return None
    node = _node(inner, 0, len(inner))
    if node is None or node[3] != len(inner):
        return None
    wanted = {RSA: ("pkcs1",), ELLIPTIC: ("sec1",)}.get(name)
    return "pkcs8" if wanted is None or (found := der_key(inner)) and found[0] in wanted else None


def _fields(raw: bytes, at: int, n: int) -> tuple[list[bytes], int] | None:
    """n fields with a length of four bytes each, and where they end."""
    found = []
    for _ in range(n):
        size = int.from_bytes(raw[at : at + 4], "big")
        if at + 4 + size > len(raw):
            return None
        found.append(raw[at + 4 : at + 4 + size])
        at += 4 + size
    return found, at


def openssh_key(raw: bytes) -> int | None:
    """The length of an OpenSSH private key that the bytes start with."""
    if not raw.startswith(OPENSSH):
        return None
    head = _fields(raw, len(OPENSSH), 3)  # cipher, derivation, its options
    if head is None or not all(x and x.isascii() for x in head[0][:2]) or head[1] + 4 > len(raw):
        return None
    keys = int.from_bytes(raw[head[1] : head[1] + 4], "big")
    if not 0 < keys <= 16:
        return None
    rest = _fields(raw, head[1] + 4, keys + 1)
    if rest is None or len(rest[0][-1]) < 8 or len(rest[0][-1]) % 8:
        return None
    for public in rest[0][:-1]:
        name = _fields(public, 0, 1)
        if name is None or not name[0][0] or not name[0][0].isascii():
            return None
    return rest[1]


def _decode(chars: str) -> bytes | None:
    """base64 or base64url without its padding; None if the number of characters fits no bytes."""
    if len(chars) % 4 == 1:
        return None
    try:
        return base64.b64decode(chars.replace("-", "+").replace("_", "/") + "=" * (-len(chars) % 4), validate=True)
    except binascii.Error:
        return None


def _object(chars: str) -> dict | None:
    raw = _decode(chars)
    try:
        found = json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def is_token(head: str, payload: str, signature: str) -> bool:
    found = _object(head)
    name = found.get("alg") if found else None
    return isinstance(name, str) and name != "" and name.lower() != "none" and _decode(payload) is not None and _decode(signature) is not None


def _inside(raw: bytes, depth: int) -> str | None:
    """The kind of the first structure in decoded text."""
    if depth >= DEPTH or not raw.isascii():
        return None
    found = structures(raw.decode("ascii"), depth + 1)
    return min(found)[2] if found else None


def _parsed(raw: bytes, depth: int) -> tuple[str, int] | None:
    """(kind, bytes that it takes) of a key at the start of raw, or of what its text holds."""
    if raw[:1] == b"\x30" and (key := der_key(raw)):
        return key
    if raw[:1] == b"o" and (size := openssh_key(raw)):
        return "openssh", size
    kind = _inside(raw, depth)
    return (kind, len(raw)) if kind else None


def _base64_spans(text: str, depth: int) -> Iterator[Span]:
    for m in BASE64_RUN.finditer(text):
        run = m.group().rstrip("=")
        lines, starts = _BREAK.split(run), [0, *[b.end() for b in _BREAK.finditer(run)]]
        for some in (lines, lines[:1]) if len(lines) > 1 else (lines,):  # other text may follow on the next line
            chars = "".join(some)
            raw = _decode(chars[: len(chars) - (len(chars) % 4 == 1)])
            if found := _parsed(raw, depth) if raw else None:
                break
        else:
            continue
        kind, size = found
        left = -(-size * 4 // 3)  # characters of the key, over the lines; it ends where a line does
        for line, start in zip(some, starts, strict=False):
            if left <= len(line):
                end = m.start() + start + len(line)
                if left == len(line):
                    yield m.start(), m.end() if start + len(line) == len(run) else end, kind
                break
            left -= len(line)


def _hex_spans(text: str, depth: int) -> Iterator[Span]:
    for m in HEX_RUN.finditer(text):
        if len(run := m.group()) % 2 == 0:
            raw = bytes.fromhex(run)
            found = _parsed(raw, depth)
            if found and found[1] == len(raw):
                yield m.start(), m.end(), found[0]


def structures(text: str, depth: int = 0) -> set[Span]:
    """Spans that decoding confirms."""
    found = set(_base64_spans(text, depth)) | set(_hex_spans(text, depth))
    for m in TOKEN.finditer(text) if "." in text else ():
        if is_token(*m.groups()):
            found.add((m.start(), m.end(), "jwt"))
    return found


def patterns(text: str) -> list[Span]:
    """Spans of the three patterns. Matches that are too short still use up their characters."""
    low = text.lower()
    found = []
    if any(n in low for n in NAMES):
        found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def findings(text: str) -> list[dict]:
    """What a text holds, by start, then kind in the order of KINDS; offsets are code points, the end is exclusive."""
    spans = [*patterns(text), *structures(text)]
    return [{"kind": k, "start": a, "end": b} for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))]


_FINDINGS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _found(texts: pa.Array) -> pa.Array:
    parts = [pa.array([findings(x) for x in texts.slice(a, b - a).to_pylist()], _FINDINGS) for a, b in slices(pc.binary_length(texts).to_pylist())]
    return pa.concat_arrays(parts) if parts else pa.array([], _FINDINGS)


def scan(docs: DataFrame) -> DataFrame:
    """docs with findings: array<struct<kind, start, end>>."""
    return docs.withColumn("findings", F.arrow_udf(_found, "array<struct<kind:string,start:int,end:int>>")(F.coalesce("text", F.lit(""))))


def redact(found: DataFrame, mark: str = "[secret]") -> DataFrame:
    """scan's rows with `redacted`: the text with each maximal run of found characters replaced by the mark."""
    starts = F.transform("findings", lambda f: F.struct(f["start"].alias("a"), f["end"].alias("b")))
    zero = F.struct(F.lit(0).alias("end"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        more = F.concat(state["out"], F.substring(F.col("text"), state["end"] + 1, s["a"] - state["end"]), F.lit(mark))
        return F.struct(F.greatest(state["end"], s["b"]).alias("end"), F.when(s["a"] < state["end"], state["out"]).otherwise(more).alias("out"))

    last = F.aggregate(starts, zero, step)
    return found.withColumn("redacted", F.concat(last["out"], F.substring(F.col("text"), last["end"] + 1, F.length("text"))))


def listed(kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of the findings of these kinds, comma-joined."""
    some = F.filter("findings", lambda f: f["kind"].isin(*kinds))
    return F.array_join(F.transform(some, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def count(kind: str) -> Column:
    return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
