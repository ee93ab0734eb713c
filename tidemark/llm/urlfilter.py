"""URL filter: all glob rules at once by a bit-parallel wildcard automaton.

A URL's canonical form is its host, A-Z lower-cased, and its path; scheme, query and fragment are left out. Rules (verdict, host,
path) and globs are packed into one Shift-And automaton over several 64-bit words: a glob has a start bit and one bit for each
symbol; a wildcard is a loop on the bit before it. Reading one character moves all states of all globs of all URLs of a batch:
``D = (D << 1) & B[c] | D & S[c]``, with the top bit of a word carried into the next one. What holds at the end of the URL matches.

Globs: ``*`` is any run without ``/``, ``**`` any run, ``?`` one character but ``/``, a backslash takes the next character as it
is. A rule is the globs ``host path**`` and ``*.host path**``, so it fits its host and all subdomains. Of the rules that fit, the
longest (host and path together) wins; of equally long ones that of the longer host, then one that blocks. Where none fits, a URL
that a glob of the block list matches is blocked and any other is allowed.

A null URL or one without ``://`` has an empty host and path and no rule; its verdict is what the globs say of the empty string
(allowed, by the default ones). Every row gives one row, repeated ones and null ids too; very long URLs are read whole; other columns
don't matter. No shuffle: one narrow stage over the url column.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path)
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: What is blocked where no rule fits.
GLOBS = ["*casino**", "*-bets**", "*ads-**", "**/ads/**", "**/**.exe", "**/wp-login.ph?"]
ANY, NO_SLASH = "**", "*"


def parsed(glob: str) -> list[tuple[str, str]]:
    """Symbols of a glob: ("loop", "*" or "**"), ("one", "") and ("char", c)."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**", i):
            out.append(("loop", ANY))
            i += 2
        elif glob[i] == "*":
            out.append(("loop", NO_SLASH))
            i += 1
        elif glob[i] == "?":
            out.append(("one", ""))
            i += 1
        else:
            i += glob[i] == "\\" and i + 1 < len(glob)
            out.append(("char", glob[i]))
            i += 1
    return out


def escaped(text: str) -> str:
    return "".join("\\" + c if c in "*?\\" else c for c in text)


class Automaton:
    """All globs as masks over `words` 64-bit words; ``matches`` simulates them over many strings at once."""

    def __init__(self, globs: list[str]) -> None:
        symbols = [parsed(g) for g in globs]
        chars = sorted({c for s in symbols for kind, c in s if kind == "char"} | {"/"})
        self.kinds = np.zeros(0x110000, np.uint16)  # 0: a character that no glob names
        for i, c in enumerate(chars):
            self.kinds[ord(c)] = i + 1
        slash = chars.index("/") + 1
        bits = sum(1 + sum(kind != "loop" for kind, _ in s) for s in symbols)
        self.words = max(1, -(-bits // 64))
        step = np.zeros((len(chars) + 1, self.words), np.uint64)
        loop = np.zeros_like(step)
        self.first = np.zeros(self.words, np.uint64)
        self.last: list[tuple[int, np.uint64]] = []
        others = np.arange(len(chars) + 1) != slash
        bit = 0
        for s in symbols:
            word, mask = bit // 64, np.uint64(1 << bit % 64)
            self.first[word] |= mask
            for kind, c in s:
                if kind == "loop":
                    loop[others if c == NO_SLASH else slice(None), word] |= mask
                    continue
                bit += 1
                word, mask = bit // 64, np.uint64(1 << bit % 64)
                step[chars.index(c) + 1 if kind == "char" else others, word] |= mask
            self.last.append((word, mask))
            bit += 1
        self.step, self.loop = step, loop

    def matches(self, texts: list[str]) -> np.ndarray:
        """(texts, globs): whether each whole text matches each glob."""
        size = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-size, kind="stable")
        size, read = size[order], self.kinds[np.frombuffer("".join(texts[i] for i in order).encode("utf-32-le"), np.uint32)]
        start, state = np.cumsum(size) - size, np.tile(self.first, (len(texts), 1))
        longest = int(size[0]) if len(texts) else 0
        # the first `live` texts, by falling length, have a character at position i
        live = np.searchsorted(-size, -np.arange(longest), side="left")
        for i in range(longest):
            d = state[: live[i]]
            c = read[start[: live[i]] + i]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[: live[i]] = (moved & self.step[c]) | (d & self.loop[c])
        out = np.empty((len(texts), len(self.last)), bool)
        for g, (word, mask) in enumerate(self.last):
            out[order, g] = (state[:, word] & mask) != 0
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null URL or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(F.regexp_extract(after, r"^[^?#]*", 0), F.lit(""))


def judged(df: DataFrame, rules: list[tuple[str, str, str]] = RULES, globs: list[str] = GLOBS, ident: str = "page_id", url: str = "url") -> DataFrame:
    """ident, host, path, rule (host and path of the one that decides, or null), verdict."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block", r[1:]))
    both = [g for _, host, path in ranked for g in (escaped(host + path) + ANY, "*." + escaped(host + path) + ANY)]
    machine, n = Automaton(both + list(globs)), len(ranked)
    names = pa.array([host + path for _, host, path in ranked] + [None], pa.string())
    verdicts = pa.array([verdict for verdict, _, _ in ranked] + ["block", "allow"], pa.string())

    def run(batches):
        for batch in batches:
            texts = [h + p for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            hit = machine.matches(texts)
            fits = np.concatenate([hit[:, : 2 * n : 2] | hit[:, 1 : 2 * n : 2], np.ones((len(texts), 1), bool)], axis=1)
            rule = fits.argmax(1)
            verdict = np.where(rule < n, rule, np.where(hit[:, 2 * n :].any(1), n, n + 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, names.take(pa.array(rule)), verdicts.take(pa.array(verdict))], [ident, "host", "path", "rule", "verdict"])

    host, path = host_and_path(F.col(url))
    kind = df.schema[ident].dataType.simpleString()
    return df.select(ident, host.alias("host"), path.alias("path")).mapInArrow(run, f"`{ident}` {kind}, host string, path string, rule string, verdict string")
