"""URL rules by a bit-parallel wildcard automaton.

Glob rules are laid side by side in the bits of several 64-bit words.  A bit is a state: the rule
has matched so far.  For each byte two masks tell which states move on and which stay (`*`), so
one Shift-And step with carries between words takes all rules over one byte of all URLs at once.

Canonical form of a URL: a dot, the host with A-Z lower-cased, and the path.  The host is what
follows the first `://` up to `/`, `?`, `#` or the end; the path goes on to `?`, `#` or the end.
A rule host/path becomes the glob `**.host/path*`, where `**` stays within the host.  Of the rules
that match the longest wins; of equally long ones the first.  Without a match the verdict is the
method's default, allow.

Cases: a null URL, or one without `://`, has empty host and path and no rule; a URL of any length
is read in whole; repeated rows are judged each for itself; of rules of one length that both fit the
first counts; a null id stays null; an empty table gives no rows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import column_values, map_arrow, slabs, text_bytes

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
PARTS = re.compile(rb"([^/?#]*)([^?#]*)", re.S)
SLAB_BYTES = 4 << 20


def host_and_path(url: bytes) -> tuple[bytes, bytes]:
    """The canonical host and path."""
    _, found, rest = url.partition(b"://")
    if not found:
        return b"", b""
    host, path = PARTS.match(rest).groups()
    return host.translate(LOWER), path


class Globs:
    """Globs as bits of words: `*` is any run of bytes, `**` any run without a slash, `?` any byte."""

    def __init__(self, globs: list[bytes]) -> None:
        states: list[tuple[int | None, str]] = []  # the byte that leads to a state (None: any), and what it stays on
        self.first, self.last = [], []
        for glob in globs:
            self.first.append(len(states))
            states.append((-1, ""))
            i = 0
            while i < len(glob):
                if glob[i : i + 2] == b"**":
                    states[-1] = (states[-1][0], states[-1][1] or "host")
                    i += 2
                    continue
                if glob[i : i + 1] == b"*":
                    states[-1] = (states[-1][0], "any")
                elif glob[i : i + 1] == b"?":
                    states.append((None, ""))
                else:
                    states.append((glob[i], ""))
                i += 1
            self.last.append(len(states) - 1)
        self.words = max(1, -(-len(states) // 64))
        move, stay = np.zeros((256, self.words * 64), bool), np.zeros((256, self.words * 64), bool)
        for n, (byte, kind) in enumerate(states):
            if byte is None:
                move[:, n] = True
            elif byte >= 0:
                move[byte, n] = True
            stay[:, n] = bool(kind)
            if kind == "host":
                stay[ord("/"), n] = False
        self.move, self.stay = self.as_words(move), self.as_words(stay)
        start = np.zeros((1, self.words * 64), bool)
        start[0, self.first] = True
        self.start = self.as_words(start)[0]

    def as_words(self, bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits, axis=1, bitorder="little").view("<u8").astype(np.uint64)

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """A row for each text, a column for each glob: whether the whole text matches."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-lengths, kind="stable")
        data = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
        begin = (np.cumsum(lengths) - lengths)[order]
        ordered = lengths[order]
        state = np.repeat(self.start[:, None], len(texts), axis=1)
        one, top = np.uint64(1), np.uint64(63)
        for step in range(int(ordered[0]) if len(ordered) else 0):
            on = int(np.searchsorted(-ordered, -step, side="left"))  # texts longer than step
            byte = data[begin[:on] + step]
            now = state[:, :on]
            moved = now << one
            moved[1:] |= now[:-1] >> top
            state[:, :on] = (moved & self.move[byte].T) | (now & self.stay[byte].T)
        out = np.empty((len(texts), len(self.last)), bool)
        for k, n in enumerate(self.last):
            out[order, k] = (state[n // 64] >> np.uint64(n % 64) & one).astype(bool)
        return out


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The id, host, path, rule (null if none matches) and verdict of each URL; `rules` are (verdict, host/path)."""
    ranked = sorted(rules, key=lambda r: -len(r[1]))
    escaped = [b"**." + rule.encode() + b"*" for _, rule in ranked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        globs = Globs(escaped)
        for batch in batches:
            parts = [host_and_path(u) for u in column_values(batch, "_url")]
            texts = [b"." + h + p if h or p else b"" for h, p in parts]
            rule, verdict = [], []
            for a, b in slabs(texts, SLAB_BYTES):
                hits = globs.matches(texts[a:b])
                best = np.where(hits.any(axis=1), hits.argmax(axis=1), -1) if ranked else np.full(b - a, -1)
                rule += [ranked[k][1] if k >= 0 else None for k in best]
                verdict += [ranked[k][0] if k >= 0 else default for k in best]
            hosts, paths = (pa.array([x[k].decode("utf-8", "replace") for x in parts], pa.string()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), hosts, paths, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], [id_col, "host", "path", "rule", "verdict"])

    rows = pages.select(F.col(id_col).cast("long").alias(id_col), text_bytes(url_col).alias("_url"))
    return map_arrow(rows, f"{id_col} long, host string, path string, rule string, verdict string", run)
