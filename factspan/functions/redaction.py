"""Redaction to a fixed point, in all the forms a secret may be written in (survey L14).

Whatever must go is an interval with a name, from three finders: plain patterns, long runs right
behind a mark, and short runs of tokens one of whose *readings* holds a secret. A reading is what
the run becomes by normalising, percent-decoding or base64-decoding, in any order, a few times
over. The intervals of all finders are merged and replaced together, and that is repeated until
the text stays the same. A null text stays null.

A text goes to Python only if the JVM finds something in it that a secret could be made of.
"""

from __future__ import annotations

import base64
import json
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import unquote, unquote_plus

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The secret patterns and the group each one hides.
REDACT = (
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?(?:-----END [A-Z ]*PRIVATE KEY-----|\z)"),
    ("sk_ant", r"sk-ant-[A-Za-z0-9_\-]{8,}"),
    ("github_pat", r"github_pat_[A-Za-z0-9_]{20,}"),
    ("gh_token", r"gh[pousr]_[A-Za-z0-9]{20,}"),
    ("aws_akia", r"AKIA[0-9A-Z]{16}"),
    ("google_api_key", r"AIza[0-9A-Za-z_\-]{35}"),
    ("slack_token", r"xox[abprs]-[A-Za-z0-9\-]{10,}"),
    ("sk", r"sk-[A-Za-z0-9_\-]{12,}"),
)
REDACT_AFTER = (
    ("bearer", r"((?i:Bearer)\s+)(?!\[REDACTED)[A-Za-z0-9._~+/\-]{20,}=*"),
    ("kv_secret", r"((?i:api[_-]?key|token|secret|password)[\"']?\s*[=:]\s*[\"']?)(?!\[REDACTED)[^\s\"']{8,}"),
)
# Passes before a text is given up, names of the marks, tokens, keys of secret values.
PASSES = 8
UNBOUNDED = "[REDACTED:unbounded]"
TOKEN = r"[^\s\"']+"
WINDOW = 3
LEAST_CODED = 16
SECRET_KEY = r"(?i)(?:.*[_-])?(?:api[_-]?key|token|secret|password)"
LEAST_VALUE = 8
#: How often a reading is read again.
DEPTH = 4

#: What every plain match contains, and what makes a text read otherwise than it is written. The
#: letters left out of the last class are their own normal form.
_SIGNS = r"PRIVATE KEY-----|sk-|github_pat_|gh[pousr]_|AKIA|AIza|xox[abprs]-|(?i:bearer|api[_-]?key|token|secret|password)|\[REDACTED:"
_CODED = r"\+|%[0-9A-Fa-f]{2}|[A-Za-z0-9+/_\-]{16,}|[^\x00-\x7F\u00C0-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E\u2013\u2014\u2018-\u201E\u3001\u3002\u3041-\u3094\u30A1-\u30FA\u30FC\u4E00-\u9FFF]"
SUSPECT = f"{_SIGNS}|{_CODED}"


class Span(NamedTuple):
    start: int
    end: int
    name: str


def _python(pattern: str) -> str:
    return pattern.replace(r"\z", r"\Z")


# a look-ahead tries a pattern at every character, so that no match hides another; the whole match
# is group 1, the key in front of a value group 2
_SEARCH = {name: re.compile(_python(p)) for name, p in REDACT + REDACT_AFTER}
_EACH = {name: re.compile(f"(?=({_python(p)}))") for name, p in REDACT + REDACT_AFTER}
_ESCAPE, _ODD = re.compile("%[0-9A-Fa-f]{2}"), re.compile(r"[%+]|[^\x00-\x7F]")
_LONG = re.compile(TOKEN[:-1] + f"{{{LEAST_CODED},}}")
_TOKENS, _BEHIND = re.compile(TOKEN), re.compile(r"\[REDACTED:[a-z_]+\]([A-Za-z0-9_\-]{8,})")
_KEY = re.compile(SECRET_KEY, re.DOTALL)
_RUNS = re.compile(r"[A-Za-z0-9+/]{16,}|[A-Za-z0-9_\-]{16,}")


#: What a text must contain (by case, or folded) for a pattern to be tried; looking for it is much cheaper.
_NEEDS = {
    "private_key": ("PRIVATE KEY-----",), "sk_ant": ("sk-ant-",), "github_pat": ("github_pat_",), "gh_token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "aws_akia": ("AKIA",),
    "google_api_key": ("AIza",), "slack_token": ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-"), "sk": ("sk-",), "bearer": ("bearer",), "kv_secret": ("api", "token", "secret", "password"),
}
_FOLDED = frozenset(name for name, _ in REDACT_AFTER)


def plain(text: str) -> Iterator[Span]:
    folded = text.casefold()
    for name, pattern in _EACH.items():
        where = folded if name in _FOLDED else text
        if any(w in where for w in _NEEDS[name]) and _SEARCH[name].search(text):
            for m in pattern.finditer(text):
                start = m.end(2) if pattern.groups > 1 else m.start(1)
                if start < m.end(1):
                    yield Span(start, m.end(1), name)


def merged(spans: list[Span]) -> list[Span]:
    """Overlapping intervals become one, under the name of the one that starts first (of those the longest)."""
    out: list[Span] = []
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if out and s.start < out[-1].end:
            out[-1] = out[-1]._replace(end=max(out[-1].end, s.end))
        else:
            out.append(s)
    return out


def _decoded(text: str) -> Iterator[tuple[str, str]]:
    """One step of reading: (form, text)."""
    if not text.isascii():
        yield "nfkc", unicodedata.normalize("NFKC", text)
    escaped = _ESCAPE.search(text)
    if escaped:
        yield "pct", unquote(text)
    if escaped or "+" in text:
        yield "pct", unquote_plus(text)
    if not any(c.isspace() for c in text):
        for run in _RUNS.findall(text):
            run = run.replace("-", "+").replace("_", "/")
            for lead in range(4):  # a group may begin at any of four places; later ones read the end of one of these
                part = run[lead:]
                part = part[: len(part) - (len(part) % 4 == 1)]
                if len(part) >= LEAST_CODED:
                    yield "b64", base64.b64decode(part + "=" * (-len(part) % 4)).decode("utf-8", "replace")


def disguise(text: str) -> str | None:
    """The name of a secret that a reading of the text holds, with the form it was found by; the
    readings are gone through nearest first."""
    seen, layer = {text}, [("", text)]
    for _ in range(DEPTH):
        following = []
        for form, now in layer:
            for by, then in _decoded(now):
                if then not in seen:
                    seen.add(then)
                    following.append((form or by, then))
        for form, then in following:
            first = min(plain(then), key=lambda s: (s.start, -s.end), default=None)
            if first:
                return f"{first.name}:{form}"
        layer = following
    return None


def _changes(text: str) -> bool:
    """Can a reading of several tokens together be another than theirs?"""
    return "+" in text or bool(_ESCAPE.search(text)) or not (text.isascii() or unicodedata.is_normalized("NFKC", text))


def disguised(text: str) -> Iterator[Span]:
    """Runs of up to WINDOW tokens with a reading that holds a secret; none that holds a shorter such run."""
    if not _changes(text):  # then tokens only change by themselves, and only what is long enough to be coded
        for m in _LONG.finditer(text):
            name = disguise(m.group())
            if name:
                yield Span(*m.span(), name)
        return
    places = [m.span() for m in _TOKENS.finditer(text)]
    starts = [a for a, _ in places]
    near = {max(0, bisect_right(starts, m.start()) - 1) for m in _ODD.finditer(text)} if places else ()
    odd = [k for k in near if _changes(text[starts[k] : starts[k + 1] if k + 1 < len(starts) else len(text)])]
    hit: set[int] = set()
    for size in range(1, WINDOW + 1):
        asked = {k - back for k in odd for back in range(size) if 0 <= k - back <= len(places) - size}
        if size == 1:
            asked.update(k for k, (a, b) in enumerate(places) if b - a >= LEAST_CODED)
        for first in sorted(asked):
            run = range(first, first + size)
            if hit.isdisjoint(run):
                start, end = places[first][0], places[run[-1]][1]
                name = disguise(text[start:end])
                if name:
                    hit.update(run)
                    yield Span(start, end, name)


def redact_text(text: str) -> tuple[str, int]:
    """The text without secrets, and how many were hidden; a text that does not settle is hidden whole."""
    total = 0
    for _ in range(PASSES):
        own = merged(list(plain(text)))
        behind = [Span(*m.span(1), "") for m in _BEHIND.finditer(text)]
        # a disguise counts only where nothing plain is: what it holds beside that comes with the next pass
        other = [] if own or behind else list(disguised(text))
        spans = merged([*own, *behind, *other])
        if not spans:
            return text, total
        total += len(spans)
        cuts = [0, *(x for s in spans for x in (s.start, s.end)), len(text)]
        kept = [text[a:b] for a, b in zip(cuts[::2], cuts[1::2])]
        text = "".join(k + m for k, m in zip(kept, [f"[REDACTED:{s.name}]" if s.name else "" for s in spans] + [""]))
    return UNBOUNDED, total + 1


def redact_value(value: object) -> tuple[object, int]:
    """A JSON value with every string redacted, keys too; a long enough string under a secret's key goes whole."""
    hidden = 0

    def one(x: object, key: str | None = None) -> object:
        nonlocal hidden
        if isinstance(x, list):
            return [one(y) for y in x]
        if not isinstance(x, str):
            return x
        if key is not None and _KEY.fullmatch(key) and len(x) >= LEAST_VALUE and not x.startswith("[REDACTED"):
            now, n = "[REDACTED:kv_secret]", 1
        else:
            now, n = redact_text(x)
        hidden += n
        return now

    def pairs(found: list[tuple[str, object]]) -> dict:
        return {one(k): one(v, k) for k, v in found}

    # objects are handed over innermost first, so what pairs() sees of a nested object is done
    done = json.loads(json.dumps([value]), object_pairs_hook=pairs)
    return one(done)[0], hidden


REDACTED = T.StructType([T.StructField("text", T.StringType()), T.StructField("hidden", T.LongType())])


def _in_python(c: Column, run) -> Column:
    """struct(text, hidden) of c: `run` sees suspect texts alone, all others stay as they are."""

    @F.pandas_udf(REDACTED)
    def each(texts):
        import pandas as pd

        return pd.DataFrame([(None, None) if t is None else run(t) for t in texts], columns=["text", "hidden"]).astype({"hidden": "Int64"})

    got = each(F.when(c.rlike(SUSPECT), c))
    clean = F.when(c.isNotNull(), F.lit(0).cast("long"))
    return F.struct(F.coalesce(got["text"], c).alias("text"), F.coalesce(got["hidden"], clean).alias("hidden"))


def redact_fully(c: Column) -> Column:
    """Struct (text, hidden)."""
    return _in_python(c, redact_text)


def _json_text(text: str) -> tuple[str, int]:
    try:
        value = json.loads(text)
    except ValueError:
        return redact_text(text)
    done, hidden = redact_value(value)
    return (json.dumps(done, ensure_ascii=False, sort_keys=True, separators=(",", ":")), hidden) if hidden else (text, 0)


def redact_json(c: Column) -> Column:
    """L14 over JSON texts, by key names too: struct (text, hidden). What is hidden in comes back in
    canonical form, anything else as it is; a text that is not JSON is redacted as a text."""
    return _in_python(c, _json_text)
