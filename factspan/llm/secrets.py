"""Secret scans confirmed by structure.

Base spans come from three fixed patterns. On top, candidates in base64, base64url or hex
are decoded and parsed before they are reported:

* ``jwt``: a signed token whose header decodes to a JSON object with a string ``alg``;
* ``pem``: an armoured private or other key whose body decodes to a well-formed encoding;
* ``key``: a base64 or hex run that decodes to a DER structure whose nested lengths fit to the
  last byte and that holds a large integer, an object identifier or a key octet string, to the
  SSH wire format, or to an OpenSSH key file; up to two layers of encoding are peeled.

Nothing unconfirmed is added. Defined results: a null text is empty; null ids keep their row;
repeated rows each get the same result; an empty table gives an empty result; extra columns
are ignored. Work is linear in the length of a text.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from factspan.llm.common import documents, id_text, map_texts
from factspan.llm.pii import spans_text

KINDS = ("assign", "access", "hex")
ADDED = ("jwt", "pem", "key")
_ORDER = {k: i for i, k in enumerate(KINDS + ADDED)}
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]++")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")
_JWT = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z0-9_-]{8,}+)\.([A-Za-z0-9_-]{2,}+)\.([A-Za-z0-9_-]*+)(?![A-Za-z0-9_-])")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,60}+)-----((?:[A-Za-z0-9+/=\s:,]|-(?!----))*+)-----END \1-----")
_B64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}+={0,2}")
_ANYHEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{32,}+")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if "=" in text or ":" in text:
        out += (("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6)
    if "AKIA" in text:
        out += (("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20)
    out += (("hex", m.start(), m.end()) for m in _HEX.finditer(text))
    return sorted(out, key=lambda s: (s[1], _ORDER[s[0]]))


def decode64(run: str) -> bytes | None:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _der(data: bytes, lo: int, hi: int, depth: int, facts: set[str]) -> bool:
    """True if data[lo:hi] is a gapless run of DER elements; notes what they hold."""
    while lo < hi:
        if lo + 2 > hi:
            return False
        tag, size, lo = data[lo], data[lo + 1], lo + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or lo + n > hi or data[lo] == 0:
                return False
            size = int.from_bytes(data[lo : lo + n], "big")
            lo += n
            if size < 0x80:
                return False
        if lo + size > hi:
            return False
        if tag in (0x30, 0x31) or tag & 0xE0 == 0xA0:
            if depth >= 12 or not _der(data, lo, lo + size, depth + 1, facts):
                return False
        elif tag == 0x02:
            if not size:
                return False
            if size >= 16:
                facts.add("integer")
        elif tag == 0x06:
            if not size or data[lo + size - 1] & 0x80:
                return False
            facts.add("oid")
        elif tag in (0x03, 0x04):
            if size >= 16:
                facts.add("octets")
        elif tag not in (0x01, 0x05, 0x0A, 0x0C, 0x13, 0x16, 0x17, 0x18) and tag & 0xC0 != 0x80:
            return False
        lo += size
    return True


def is_der_key(data: bytes) -> bool:
    if len(data) < 24 or data[0] != 0x30:
        return False
    facts: set[str] = set()
    return _der(data, 0, len(data), 0, facts) and ("integer" in facts or {"oid", "octets"} <= facts)


def is_ssh_wire(data: bytes) -> bool:
    """Length-prefixed fields to the last byte, the first of them a known key type."""
    if data.startswith(b"openssh-key-v1\0"):
        return True
    lo, first = 0, None
    while lo + 4 <= len(data):
        n = int.from_bytes(data[lo : lo + 4], "big")
        if n > len(data) - lo - 4:
            return False
        first = data[lo + 4 : lo + 4 + n] if first is None else first
        lo += 4 + n
    return lo == len(data) and first is not None and re.match(rb"ssh-(rsa|dss|ed25519)$|ecdsa-sha2-nistp\d+$", first) is not None


def is_signed_token(text: str) -> bool:
    m = _JWT.fullmatch(text)
    head = m and decode64(m.group(1))
    if not head:
        return False
    try:
        parsed = json.loads(head)
    except (ValueError, RecursionError):
        return False
    return isinstance(parsed, dict) and isinstance(parsed.get("alg"), str) and decode64(m.group(2)) is not None


def is_pem(text: str) -> bool:
    m = _PEM.search(text)
    if not m:
        return False
    body = "".join(x for x in m.group(2).split("\n") if ":" not in x)
    data = decode64(re.sub(r"[\s,]", "", body))
    return data is not None and (is_der_key(data) or is_ssh_wire(data) or ("ENCRYPTED" in m.group(1) or "Proc-Type" in m.group(2)) and len(data) >= 32)


def confirms(data: bytes | None, layers: int = 2) -> bool:
    """Does decoded data hold a key, directly or under one more layer of encoding?"""
    if not data:
        return False
    if is_der_key(data) or is_ssh_wire(data):
        return True
    if layers > 1:
        try:
            text = data.decode("ascii").strip()
        except UnicodeDecodeError:
            return False
        if is_signed_token(text) or "-----BEGIN " in text and is_pem(text):
            return True
        if _ANYHEX.fullmatch(text) and len(text) % 2 == 0 and confirms(bytes.fromhex(text), layers - 1):
            return True
        return bool(_B64.fullmatch(text)) and confirms(decode64(text), layers - 1)
    return False


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if "-----BEGIN " in text:
        out += (("pem", m.start(), m.end()) for m in _PEM.finditer(text) if is_pem(m.group()))
    taken = [(a, b) for _, a, b in out]
    free = lambda a, b: all(b <= x or a >= y for x, y in taken)
    found = []
    if "." in text:
        found += (("jwt", m.start(), m.end()) for m in _JWT.finditer(text) if is_signed_token(m.group()))
    for m in _B64.finditer(text):
        run = m.group()
        if _ANYHEX.fullmatch(run) and len(run) % 2 == 0 and confirms(bytes.fromhex(run)) or confirms(decode64(run)):
            found.append(("key", m.start(), m.end()))
    jwts = [(a, b) for k, a, b in found if k == "jwt"]
    out += (s for s in found if free(s[1], s[2]) and (s[0] == "jwt" or all(s[2] <= x or s[1] >= y for x, y in jwts)))
    return out


def find_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    base = base_spans(text)
    more = confirmed_spans(text)
    return base, sorted(base + more, key=lambda s: (s[1], _ORDER[s[0]], s[2])) if more else base


SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS),
    T.StructField("base_sha256", T.StringType()),
    T.StructField("spans", T.StringType()),
])


def detect(df: DataFrame) -> DataFrame:
    def make():
        def step(ids, texts):
            counts, shas, spans = [[], [], []], [], []
            for text in texts:
                base, every = find_spans(text or "")
                for k, kind in enumerate(KINDS):
                    counts[k].append(sum(s[0] == kind for s in base))
                shas.append(hashlib.sha256(spans_text(base).encode()).hexdigest())
                spans.append(spans_text(every))
            return [ids, *counts, shas, spans]

        return step

    return map_texts(id_text(df), make, SCHEMA)


def op7_secret_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(documents(spark, sf_dir))
