"""Secret scans: Aho-Corasick keywords, anchored regular expressions near hits, embedded checksums."""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .util import per_text

# The patterns of the contract and the public formats of checksummed tokens.
ASSIGN = re.compile(
    rb"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    rb"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
#: Prefix, then 30 letters or digits, then six base-62 digits: the CRC-32 of the 30.
CHECKED = re.compile(rb"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign",
    "api_key": "assign", "akia": "access", "ghp_": "checked", "gho_": "checked", "ghu_": "checked",
    "ghs_": "checked", "ghr_": "checked", "npm_": "checked",
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KINDS = ("assign", "access", "hex", "checked")


def checksum62(body: bytes) -> str:
    """The CRC-32 of body as six base-62 digits."""
    n, out = zlib.crc32(body), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


def scan(text: bytes, automaton) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes, by start and kind."""
    out: list[tuple[int, int, int]] = []
    free = {"assign": 0, "access": 0, "checked": 0}  # where the next match of a kind may start
    # Lower-cased bytes as Latin-1, so that a place in the string is a place in the bytes. Keywords of
    # different lengths end in another order than they start in, so hits are put in order of their start.
    hits = sorted((end + 1 - n, kind) for end, (kind, n) in automaton.iter(text.lower().decode("latin-1")))
    for at, kind in hits:
        if at < free[kind]:
            continue
        if kind == "assign" and (m := ASSIGN.match(text, at)):
            free[kind] = m.end()
            if m.end(2) - m.start(2) >= 6:
                out.append((at, m.end(), 0))
        elif kind == "access" and (m := ACCESS.match(text, at)):
            free[kind] = m.end()
            if m.end() - at >= 20:
                out.append((at, m.end(), 1))
        elif kind == "checked" and (m := CHECKED.match(text, at)) and checksum62(m[1]) == m[2].decode():
            free[kind] = m.end()
            out.append((at, m.end(), 3))
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], x[2]))


def _code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if text.isascii():
        return spans
    before = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    at = lambda p: int(before[p - 1]) if p else 0
    return [(at(a), at(b), k) for a, b, k in spans]


def find_secrets(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Struct `row` (the carried columns) and `found`: array of (kind, start, end, value) by start, then kind.

    Kinds: assign, access and hex by their patterns (leftmost, not overlapping within a kind; too
    short ones dropped), checked for tokens whose last six characters are the CRC-32 of the rest.
    Offsets are code points, end exclusive. Only keyword hits are looked at by the anchored patterns;
    hex runs have no keyword and are found by their own pattern over the whole text. One narrow pass;
    a null text counts as empty; repeated rows are scanned one by one.
    """

    def start():
        automaton = _automaton()

        def run(texts: list) -> dict:
            out = []
            for t in texts:
                spans = scan(t, automaton) if t else []
                points = _code_points(t, spans) if spans else []
                out.append(
                    [
                        {"kind": KINDS[k], "start": a, "end": b, "value": t[x:y].decode()}
                        for (x, y, k), (a, b, _) in zip(spans, points)
                    ]
                )
            return {"found": out}

        return run

    return per_text(docs, text, carry, "found array<struct<kind:string,start:long,end:long,value:string>>", start)
