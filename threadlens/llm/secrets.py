"""Secret scan with structural confirmation.

Base patterns (assignments, access keys, long hex runs) are reported as they stand.  Beyond them,
base64 and hex candidates are decoded and reported only if the bytes parse as a private key: nested
DER lengths (PKCS#1, PKCS#8, encrypted PKCS#8, SEC 1) or the OpenSSH container; dotted tokens are
reported only if their header decodes to a JSON object that names a signing algorithm.

Offsets are code points, ends exclusive.  Edge cases: null texts are empty and give zero counts,
an empty span list and the hash of the empty string; repeated rows each give their own row; extra
columns of the input are not carried.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "der", "openssh", "jwt")
_ORDER = {k: i for i, k in enumerate(KINDS)}
Span = tuple[str, int, int]

ASSIGN = re.compile(
    r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"""
    r"""|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
HEX_ANY = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){24,}(?![0-9A-Fa-f])")
# Where 40 characters of a base64 run start with a DER sequence or the OpenSSH magic: after any other
# character, or after a mark that may be of the run or of what stands before it (a path, armour, a name).
KEY_START = re.compile(r"(?<![A-Za-z0-9+])(?:M[A-P](?=[A-Za-z0-9+/_-]{38})|b3Bl(?=[A-Za-z0-9+/_-]{36}))")
# A run and the lines below it, as in an armoured body, above any armour line.
BLOCK = re.compile(r"[A-Za-z0-9+/_-]+(?:\r?\n(?!-----)[A-Za-z0-9+/_-]+)*")
RUN = re.compile(r"[A-Za-z0-9+/_-]+")
# The first part of a dotted triple; what follows is looked at only, as its second part may start one too.
JWT = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{12,}+(?=(\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*+))")


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of the base patterns, per kind."""
    out: list[Span] = []
    if "=" in text or ":" in text:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def _tlv(b: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the DER value at ``at``; None if the length does not fit."""
    if at + 2 > end:
        return None
    tag, n = b[at], b[at + 1]
    at += 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end:
            return None
        n = int.from_bytes(b[at:at + k], "big")
        at += k
    return (tag, at, at + n) if at + n <= end else None


def _header(b: bytes) -> int:
    """Length of the DER value, header included, that ``b`` (six bytes or more) starts; 0 if its form is wrong."""
    k = b[1] & 0x7F if b[1] & 0x80 else 0
    if k > 4 or b[1] == 0x80:
        return 0
    return 2 + k + (int.from_bytes(b[2:2 + k], "big") if k else b[1])


def _children(b: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """All values that fill ``b[at:end]`` exactly, or None."""
    out = []
    while at < end:
        v = _tlv(b, at, end)
        if v is None:
            return None
        out.append(v)
        at = v[2]
    return out


def _is_algorithm(b: bytes, v: tuple[int, int, int]) -> bool:
    parts = _children(b, v[1], v[2]) if v[0] == 0x30 else None
    return bool(parts) and parts[0][0] == 0x06 and parts[0][2] > parts[0][1]


def is_private_der(b: bytes) -> bool:
    """Does ``b`` start with a DER sequence that is a private key by its nested structure?"""
    top = _tlv(b, 0, len(b))
    if top is None or top[0] != 0x30 or top[2] != len(b):
        return False
    parts = _children(b, top[1], top[2])
    if not parts or len(parts) < 2:
        return False
    tags = [p[0] for p in parts]
    version = b[parts[0][1]:parts[0][2]] if tags[0] == 0x02 else None
    if version in (b"\x00", b"\x01") and len(parts) >= 3 and _is_algorithm(b, parts[1]) and tags[2] == 0x04:
        return True                                             # PKCS#8
    if version in (b"\x00", b"\x01") and len(parts) >= 9 and set(tags[:9]) == {0x02}:
        return True                                             # PKCS#1: nine integers
    if version == b"\x01" and tags[1] == 0x04 and parts[1][2] - parts[1][1] >= 16:
        return all(t in (0xA0, 0xA1) for t in tags[2:])         # SEC 1
    return len(parts) == 2 and _is_algorithm(b, parts[0]) and tags[1] == 0x04   # encrypted PKCS#8


_SSH_MAGIC = b"openssh-key-v1\x00"


def is_openssh(b: bytes) -> bool:
    """OpenSSH container: magic, three length-prefixed strings, then at least one key."""
    if not b.startswith(_SSH_MAGIC):
        return False
    at = len(_SSH_MAGIC)
    for _ in range(3):
        if at + 4 > len(b):
            return False
        at += 4 + int.from_bytes(b[at:at + 4], "big")
    return at + 4 <= len(b) and 1 <= int.from_bytes(b[at:at + 4], "big") <= 64


def _unbase64(s: str) -> bytes | None:
    s = s.replace("\r", "").replace("\n", "").rstrip("=").translate(str.maketrans("-_", "+/"))
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _is_signed_header(segment: str) -> bool:
    raw = _unbase64(segment)
    if raw is None:
        return False
    try:
        head = json.loads(raw)
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def _key_kind(b: bytes | None) -> str | None:
    if b is None or len(b) < 24:
        return None
    if is_openssh(b):
        return "openssh"
    return "der" if b[0] == 0x30 and is_private_der(b) else None


def _base64_keys(text: str) -> Iterator[Span]:
    """Base64 keys, each from its start to the line end where it is whole.

    The header of a DER key gives the number of its characters, so lines below it that look like base64 do not
    matter. An OpenSSH container goes to the last line that leaves a length base64 can have.
    """
    done = block_end = 0
    for m in KEY_START.finditer(text):
        at = m.start()
        if at < done:
            continue
        if at >= block_end:
            block_end = BLOCK.match(text, at).end()
            runs = [r.span() for r in RUN.finditer(text, at, block_end)]
            total = [0, *accumulate(e - s for s, e in runs)]
        i = bisect_right(runs, at, key=lambda r: r[0]) - 1
        before = total[i] + at - runs[i][0]                     # characters of the block above this start
        if m[0] == "b3Bl":
            last = next((j for j in range(len(runs), i, -1) if (total[j] - before) % 4 != 1), i)
            end = runs[last - 1][1] if last > i else at
        else:
            top = _header(_unbase64(text[at:at + 8]))
            size = -(-4 * top // 3)
            last = bisect_left(total, before + size)
            if last == len(total) or not top:
                continue
            end = runs[last - 1][1] - (total[last] - before - size)
            if end != runs[last - 1][1] and not text.startswith("-----", end):
                continue
        while end < len(text) and text[end] == "=" and end - runs[last - 1][1] < 2:
            end += 1
        kind = _key_kind(_unbase64(text[at:end]))
        if kind:
            done = end
            yield kind, at, end


def confirmed_spans(text: str) -> list[Span]:
    """Spans that decode to a key or a signed token."""
    out: list[Span] = []
    out += _base64_keys(text)
    for m in HEX_ANY.finditer(text):
        kind = _key_kind(bytes.fromhex(m[0]))
        if kind and not any(k == kind and s <= m.start() < e for k, s, e in out):
            out.append((kind, m.start(), m.end()))
    done = 0
    for m in JWT.finditer(text):
        if m.start() >= done and _is_signed_header(m[0]):
            done = m.end(1)
            out.append(("jwt", m.start(), done))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], _ORDER[x[0]], x[2])))


_SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: base counts, the digest of the base spans and all spans. No shuffle."""
    src = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    id_type = src.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for value in batch.column(1):
                text = value.as_py()
                base = base_spans(text)
                more = confirmed_spans(text)
                kinds = [k for k, _, _ in base]
                for col, x in zip(rows, (kinds.count("assign"), kinds.count("access"), kinds.count("hex"),
                                         hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more),
                                         len(more))):
                    col.append(x)
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(rows, types))],
                names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"])

    return src.mapInArrow(run, f"`{id_col}` {id_type}, {_SCHEMA}")
