"""Secret scans: known forms, and sliding-window Shannon entropy over candidate strings.

Base kinds are regular expressions.  Beyond them, every run of ``WINDOW`` or more token characters is a candidate.  A
window slides over it; the entropy, and the numbers of small letters, capitals, digits and signs, are updated from the
character that leaves and the one that enters, so a step costs the same whatever the window.  The classes that occur in
the window set its threshold: a random string of few letters has less entropy than one of many.  Stretches of
hexadecimal digits have a class of their own.  Windows at or above their threshold are joined to spans of kind
``entropy``.  Suppressed are spans that an allow-list pattern covers, and windows that read like words: whose letter
pairs are rather those of ``words`` (a parameter) than of random strings.  Base spans are cut out of entropy spans, and
the rest is kept.  Texts are never shuffled.  Strings shorter than the window are found in the base kinds only.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field, per_text

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")              # the stated [0-9a-f]+ of 16 characters or more: runs are maximal
LEAST = {"assign": 12, "access": 18}

WINDOW, REST, SIGNS = 20, 8, "+/_=-"
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}")
HEXADECIMAL = re.compile(rf"[0-9A-Fa-f]{{{WINDOW},}}")
# Bits a character, by what occurs in a window: about what 95 of 100 random windows of that alphabet reach.
THRESHOLDS = {"hex": 3.0, "lower": 3.35, "upper": 3.35, "lower, digit": 3.5, "upper, digit": 3.5, "lower, upper": 3.7, "lower, upper, digit": 3.75}
# Harmless strings of high entropy (UUIDs, data-URI media types, alphabets, digests of nothing).
ALLOWED = (
    r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
    r"(?:abcdefghijklmnopqrstuvwxyz|ABCDEFGHIJKLMNOPQRSTUVWXYZ|0123456789)+[+/]*",
    r"d41d8cd98f00b204e9800998ecf8427e",
    r"da39a3ee5e6b4b0d3255bfef95601890afd80709",
    r"e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855",
)


def high_windows(s: str, window: int, threshold: float) -> list[tuple[int, int]]:
    """Joined spans of the windows of ``s`` whose Shannon entropy in bits is ``threshold`` or more."""
    logs = [0.0] + [c * math.log2(c) for c in range(1, window + 2)]
    counts: dict[str, int] = {}
    total, out = 0.0, []                  # total: sum of c * log2(c) over the window's characters
    limit = window * (math.log2(window) - threshold) + 1e-9
    for i, ch in enumerate(s):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += logs[c + 1] - logs[c]
        if i >= window:
            old = s[i - window]
            c = counts[old]
            counts[old] = c - 1
            total += logs[c - 1] - logs[c]
        if i >= window - 1 and total <= limit:
            if out and i - window + 1 <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((i - window + 1, i + 1))
    return out


def class_windows(s: str, window: int, thresholds: dict[str, float]) -> list[tuple[int, int]]:
    """Joined spans of the windows of ``s`` whose entropy reaches the threshold of the classes in them; windows without
    letters have none.  Signs count as characters, but make no class."""
    logs = [0.0] + [c * math.log2(c) for c in range(1, window + 2)]
    limits = {k: window * (math.log2(window) - t) + 1e-9 for k, t in thresholds.items()}
    by_class = [-1.0, limits["lower"], limits["upper"], limits["lower, upper"],
                -1.0, limits["lower, digit"], limits["upper, digit"], limits["lower, upper, digit"]]
    kinds = [0 if ch.islower() else 1 if ch.isupper() else 2 if ch.isdigit() else 3 for ch in s]
    counts: dict[str, int] = {}
    held = [0, 0, 0, 0]
    total, out = 0.0, []
    for i, ch in enumerate(s):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += logs[c + 1] - logs[c]
        held[kinds[i]] += 1
        if i >= window:
            old = s[i - window]
            c = counts[old]
            counts[old] = c - 1
            total += logs[c - 1] - logs[c]
            held[kinds[i - window]] -= 1
        if i >= window - 1 and total <= by_class[(held[0] > 0) + 2 * (held[1] > 0) + 4 * (held[2] > 0)]:
            out.append((out.pop()[0] if out and i - window + 1 <= out[-1][1] else i - window + 1, i + 1))
    return out


# Plain words of several languages and of identifiers, for the frequency of letter pairs.
PLAIN = """the and that have with this from they would there their what about which when make like time just know take people into year your good some
could them other than then look only come over think also back after work first well even want because these give most where through between another
under never system number world area money story fact month different right study book word business issue side kind head house service friend father power
hour game line member city community president team minute idea body information nothing ago lead social understand whether watch together follow around
parent stop face anything create public already speak others read level allow add office spend door health person art sure such war history party within grow
result open change morning walk reason low win research girl guy early food before moment himself air teacher force offer enough both education across although
remember foot second boy maybe toward able age everything love process music including consider appear actually buy probably human wait serve market die send
expect home sense build stay fall nation plan cut college interest death course someone experience behind reach local kill six remain effect use very long
without any digits letters all in it path some module file name thing value string index list type class function method object test data user request response
config settings default error message handler client server session manager factory service controller interface implementation abstract property attribute
component container element document window event listener callback promise account invoice payment transaction reference description configuration
application development production environment version library package import export source target directory resource template generator parser builder
und der die das nicht ein eine ich sie wir werden haben sein mit auf fuer auch nach bei aus wie noch nur oder aber wenn schon mehr immer sehr wieder gegen
zwischen Versicherung Gesellschaft Entwicklung Wirtschaft Regierung Rechnung Arbeit Zeit Jahr Leben Geschichte Verwaltung Bundes Strasse Kapitaen schaft keit
les des est pas pour dans une sur avec qui que par plus tout comme mais nous vous leur fait entre temps sans monde toujours chose gouvernement homme histoire
jour notre beaucoup travail pendant question politique developpement el los las por con para una como pero sus este cuando muy sin sobre tambien hasta hay donde
quien desde todo nos durante todos uno les contra otros ese eso ante ellos porque trabajo tiempo gobierno desarrollo informacion nacional ciudad persona"""
BROKEN = -1.5                                   # a digit beside a letter, or a capital after a small letter


def letter_pairs(words: str) -> dict[str, float]:
    """Log odds of each pair of letters: in ``words`` over random strings, given the first letter."""
    counts: dict[str, int] = {}
    for w in words.lower().split():
        for x in map("".join, zip(w, w[1:])):
            counts[x] = counts.get(x, 0) + 1
    letters = "abcdefghijklmnopqrstuvwxyz"
    return {a + b: math.log(26 * (counts.get(a + b, 0) + 0.5) / (sum(counts.get(a + c, 0) for c in letters) + 13)) for a in letters for b in letters}


class Scanner:
    def __init__(self, allowed: Sequence[str], words: str = PLAIN) -> None:
        self.allowed = [re.compile(a) for a in allowed]
        self.pairs = letter_pairs(words)

    def odds(self, s: str) -> list[float]:
        """Per character of ``s``, the log odds of words over random strings, given the character before it."""
        get = self.pairs.get
        return [0.0, *(BROKEN if a.isdigit() != b.isdigit() and a.isalnum() and b.isalnum() or a.islower() and b.isupper() else get((a + b).lower(), 0.0)
                       for a, b in zip(s, s[1:]))]

    def unlike_words(self, s: str, window: int) -> list[tuple[int, int]]:
        """Joined spans of the windows of ``s`` that are rather random than words."""
        sums = [0.0]
        for x in self.odds(s):
            sums.append(sums[-1] + x)
        out: list[tuple[int, int]] = []
        for i in range(len(s) - window + 1):
            if sums[i + window] - sums[i + 1] < 0:          # the first character's pair is not in the window
                out.append((out.pop()[0] if out and i <= out[-1][1] else i, i + window))
        return out

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, number of the kind, end), in order."""
        out = []
        low = text.lower()
        if any(h in low for h in ASSIGN_HINTS):
            out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST["assign"]]
        if "AKIA" in text:
            out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
        out += [(m.start() + at, 2, m.end() + at) for at, t in _long_tokens(text, 16) for m in HEX.finditer(t)]
        return sorted(out)

    def entropy(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
        found: list[tuple[int, int]] = []
        for at, token in _long_tokens(text, WINDOW):
            for m in CANDIDATE.finditer(token):
                fine = [a.span() for p in self.allowed for a in p.finditer(m[0])]
                spans = [(run.start() + s, run.start() + e) for run in HEXADECIMAL.finditer(m[0]) for s, e in high_windows(run[0], WINDOW, THRESHOLDS["hex"])]
                spans += [(s + a, s + z) for s, e in class_windows(m[0], WINDOW, THRESHOLDS) for a, z in self.unlike_words(m[0][s:e], WINDOW)]
                found += [(at + m.start() + s, at + m.start() + e) for s, e in spans if not any(a <= s and e <= z for a, z in fine)]
        joined: list[tuple[int, int]] = []
        for s, e in sorted(found):
            if joined and s <= joined[-1][1]:
                joined[-1] = (joined[-1][0], max(joined[-1][1], e))
            else:
                joined.append((s, e))
        return [x for span in joined for x in self._rest(text, span, base)]

    def _rest(self, text: str, span: tuple[int, int], base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
        """``span`` without the base spans in it: the stretches of ``REST`` or more characters besides signs at their ends
        that are not words."""
        inside = [(s, e) for s, _, e in base if s < span[1] and span[0] < e]
        if not inside:
            return [span]
        out, at = [], span[0]
        for s, e in [*sorted(inside), (span[1], span[1])]:
            part = text[at:max(at, s)]
            start, end = at + len(part) - len(part.lstrip(SIGNS)), at + len(part.rstrip(SIGNS))
            if end - start >= REST and sum(self.odds(text[start:end])) < 0:
                out.append((start, end))
            at = max(at, e)
        return out

    def scan(self, text: str) -> tuple[int, int, int, str, str]:
        base = self.base(text)
        named = [(s, o, f"{KINDS[o]}:{s}:{e}") for s, o, e in base]
        every = sorted(named + [(s, len(KINDS), f"entropy:{s}:{e}") for s, e in self.entropy(text, base)])
        digest = hashlib.sha256(",".join(x for *_, x in named).encode()).hexdigest()
        return (*(sum(o == k for _, o, _ in base) for k in range(len(KINDS))), digest, ",".join(x for *_, x in every))


def _long_tokens(text: str, least: int) -> Iterator[tuple[int, str]]:
    at = 0
    for t in text.split():
        if len(t) >= least:
            at = text.index(t, at)
            yield at, t
            at += len(t)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allowed: Sequence[str] = ALLOWED,
            words: str = PLAIN) -> DataFrame:
    """Per document row: id, n_assign, n_access, n_hex, base_sha256 (of kind:start:end of the base spans) and
    spans (those and the entropy ones).  Positions count code points, ends are exclusive.

    Null and empty texts have no spans; texts of any length are scanned whole; repeated rows and null ids
    give rows of their own; extra columns are ignored; an empty table gives an empty result."""
    allowed = tuple(allowed)
    scan = per_text(lambda scanner, text: scanner.scan(text), "n_assign long, n_access long, n_hex long, base_sha256 string, spans string",
                    lambda: Scanner(allowed, words))
    out = docs.select(F.col(id_col).alias("id_"), scan(F.col(text_col)).alias("found_"))
    return out.select(F.col("id_").alias(id_col), *[field("found_", c).alias(c) for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")])
