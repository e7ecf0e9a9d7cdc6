"""Secret scan: three base patterns, and values that are hard to guess in credential contexts.

The guess cost of a value is the least total cost over all its segmentations into words, dates, repeats, keyboard walks
and brute-force spans, found by dynamic programming; a segmentation of k parts costs the product of its parts' guesses
times k factorial, kept as base-10 logarithms. Values in a credential context whose cost reaches ``LEAST_COST`` add
spans of kind ``guess`` unless a base span overlaps them.

Words are listed ones and those of the documents: ``fit`` counts every word of all texts with the different words before it
(64 bits by hash, joined by or), so copies of one passage, or of one secret, count once. The ``MOST_WORDS`` most frequent of
those with at least ``LEAST_CONTEXTS`` are broadcast; rarer ones would save a guesser next to nothing.

Defined results: a null text counts as empty and has no spans; equal texts give equal spans; spans are code-point
offsets of whole matches, end exclusive; values of any length are costed as a whole, and costs of ``MOST_COST`` and more,
which no value of up to 64 characters has, are reported as ``MOST_COST``.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Mapping
from types import MappingProxyType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows, slices, texts

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so this drops the short ones only
CONTEXT = re.compile(r"""(?:pass(?:phrase|code|wort)?|pwd|credentials?|auth(?:orization)?|bearer|(?:private|access|signing)[_\x20-]?key|clave|contraseña|mot\x20de\x20passe)["']?\x20*(?:[:=]|\x20is\x20)\x20*["']?([^\s"',;<>]{6,})""", re.I)
# Every context holds one of these; a cheap test before the pattern.
_HINTS = ("pass", "pwd", "credential", "auth", "bearer", "key", "clave", "contraseña")
_IS_HEX = bytes(120 if chr(c) in "0123456789abcdef" else 32 for c in range(256))
LEAST_COST = 8.0
MOST_COST = 128.0
LONGEST = 20  # characters of a word at most
MOST_WORDS = 100_000  # of the documents, some 3 MB
LEAST_CONTEXTS = 12  # of 64
HELD = 100_000  # different words that a task counts before they go out
# Frequent password words, most frequent first.
WORDS = (
    "password qwerty dragon monkey letmein login welcome admin master hello freedom whatever shadow sunshine princess football baseball iloveyou trustno secret "
    "summer winter spring autumn love test user root guest default changeme example sample dummy placeholder none null true false string value your the and for not "
    "with this that from have required optional redacted hidden company service server database token access private public superman batman charlie jordan michael "
    "michelle jessica jennifer ashley nicole daniel thomas robert matthew andrew joshua george hunter soccer hockey tigger ginger pepper cookie cheese banana orange "
    "purple flower butterfly angel lovely heaven jesus killer ranger mustang harley ferrari porsche mercedes yankees arsenal liverpool chelsea barcelona london paris "
    "berlin madrid america canada mexico computer internet windows linux oracle mysql postgres cisco router system manager office security network backup support "
    "temp demo work home house school family mother father brother sister baby king queen star moon night blue green black white silver golden diamond magic power music "
    "passwort kennwort geheim hallo schatz contrasena clave hola amor soleil bonjour motdepasse azerty"
).split()
# Words that texts put after the name of a credential.
TERMS = (
    "authentication authorization authenticated authorized unauthorized credentials provided provider providers unavailable available required requires disabled enabled expired invalid "
    "unknown missing failed failure denied granted carrying module method methods header headers request requests response session sessions cookies username account accounts "
    "password passwords protected private generated rotated stored encrypted encryption plaintext hashed hashing signing signature signatures certificate certificates translation translations "
    "please contact administrator settings configuration configured environment variable variables version application applications client clients customer customers developer "
    "document documentation documents information instructions interface internal external integration management permission permissions policy policies production development staging"
).split()
_RANK = {w: i + 1 for i, w in reversed(list(enumerate(WORDS + TERMS)))}
_LETTERS = re.compile(r"[^\W\d_]+")
# Rows of two keyboards.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "yxcvbnm", "azertyuiop", "qsdfghjklm", "wxcvbn", "abcdefghijklmnopqrstuvwxyz")
_NEXT = {a + b for r in ROWS for a, b in zip(r, r[1:], strict=False)} | {b + a for r in ROWS for a, b in zip(r, r[1:], strict=False)} | {x + y for top, low in zip(ROWS[:3], ROWS[1:4], strict=True) for x, y in zip(top, low, strict=False)}
_LEET = str.maketrans("01345@$7!", "oleasast" + "i")
_YEAR = re.compile(r"(?:19|20)\d\d")
_DAY, _MONTH = r"(?:0?[1-9]|[12]\d|3[01])", r"(?:0?[1-9]|1[0-2])"
_DATE = re.compile(rf"(?:19|20)\d\d([-/._]?){_MONTH}\1{_DAY}|(?:{_DAY}([-/._]?){_MONTH}\2|{_MONTH}([-/._]?){_DAY}\3)(?:19|20)\d\d")
_SHORT_DATE = re.compile(rf"\d\d([-/._]?){_MONTH}\1{_DAY}|(?:{_DAY}([-/._]?){_MONTH}\2|{_MONTH}([-/._]?){_DAY}\3)\d\d")


def date_cost(part: str) -> float | None:
    """log10 of the guesses of a year or a day of one, the year having two or four digits; None for other parts."""
    if not part[0].isdigit() or not 4 <= len(part) <= 10:
        return None
    if _YEAR.fullmatch(part):
        return math.log10(120)
    return math.log10(365 * 120) if _DATE.fullmatch(part) else math.log10(365 * 100) if _SHORT_DATE.fullmatch(part) else None


def fit(docs: DataFrame) -> dict[str, int]:
    """Ranks of the words of all documents, after the listed ones."""

    def run(batches):
        number: dict[str, int] = {}
        count, before = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        bits = np.zeros(0, np.uint64)

        def out():
            words = list(number)
            size = np.fromiter(map(len, words), np.int64, len(words))
            keep = np.flatnonzero((size >= 3) & (size <= LONGEST))
            return pa.RecordBatch.from_arrays([pa.array([words[i] for i in keep.tolist()], pa.string()), pa.array(count[keep]), pa.array(before.view(np.int64)[keep])], ["word", "n", "before"])

        for b in slices(batches, "text", 4 << 20):
            flat, ends = [], []
            for text in texts(b.column("text")):
                flat += [number.setdefault(w, len(number)) for w in _LETTERS.findall(text.lower())]
                ends.append(len(flat))
            ids, fresh = np.array(flat, np.int64), list(number)[len(bits) :]
            more = np.zeros(len(fresh), np.int64)
            bits = np.concatenate([bits, np.uint64(1) << np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) & 63 for w in fresh), np.uint64, len(fresh))])
            count, before = np.concatenate([count, more]), np.concatenate([before, more.view(np.uint64)])
            count += np.bincount(ids, minlength=len(count))
            follows = np.ones(len(ids), bool)
            follows[[0, *[e for e in ends if e < len(ids)]] if len(ids) else []] = False  # the first word of a text
            at = np.flatnonzero(follows)
            np.bitwise_or.at(before, ids[at], bits[ids[at - 1]])
            if len(number) > HELD:
                yield out()
                number.clear()
                count, before, bits = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        if number:
            yield out()

    counted = docs.select("text").mapInArrow(run, "word string, n long, before long").groupBy("word").agg(F.sum("n").alias("n"), F.bit_or("before").alias("before"))
    best = counted.where(F.bit_count("before") >= LEAST_CONTEXTS).orderBy(F.desc("n"), "word").limit(MOST_WORDS).select("word")
    return {r["word"]: len(_RANK) + i + 1 for i, r in enumerate(best.collect())}


def word_cost(part: str, ranks: Mapping[str, int] = MappingProxyType({})) -> float | None:
    """log10 of the guesses of a listed word, or one of ``ranks``, whatever its case, with signs for letters, or backwards."""
    low, best = part.lower(), None
    for form, extra in ((low, 0.0), (low.translate(_LEET), 0.5), (low[::-1], 0.3)):
        rank = _RANK.get(form) or ranks.get(form)
        if rank and (best is None or math.log10(rank + 1) + extra < best):
            best = math.log10(rank + 1) + extra
    upper = sum(c.isupper() for c in part)
    return None if best is None else best + (0.3 if upper in (1, len(part)) else 0.3 * upper)


def _alphabet(c: str) -> float:
    """log10 of the number of characters a guesser would try in place of ``c``."""
    return 1.0 if c.isdigit() else math.log10(26) if c.isascii() and c.isalpha() else math.log10(33) if c.isascii() else 2.0


def _repeats(value: str, brute: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(start, end, period, cost of a unit) of the longest stretches that repeat a unit which isn't itself a repeat.

    A unit has at least a tenfold cost a character, so longer ones than ``MOST_COST`` don't count.
    """
    codes, out = np.array([ord(c) for c in value]), []
    for p in range(1, min(len(value) // 2, int(MOST_COST)) + 1):
        same = np.concatenate([[False], codes[p:] == codes[:-p], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        long = edges[1::2] - edges[::2] >= p
        for a, e in zip(edges[::2][long].tolist(), edges[1::2][long].tolist(), strict=True):
            unit = value[a : a + p]
            if (unit + unit).find(unit, 1) == p:
                out.append((a, e + p, p, float(brute[a + p] - brute[a])))
    return sorted(out)


def guess_cost(value: str, ranks: Mapping[str, int] = MappingProxyType({})) -> float:
    """log10 of the least number of guesses over all segmentations of ``value``, ``MOST_COST`` at most.

    best[end][k]: the least cost of k parts up to an end. Brute-force spans and keyboard walks cost a fixed amount for each
    further character, so they are carried along from end to end. Within a stretch that repeats a unit, parts can change
    places, so repeats need to start only where a part that began before the stretch may end.
    """
    n, low = len(value), value.lower()
    if not n:
        return 0.0
    if len(low) != n:  # a letter whose small form is longer
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in value)
    step = [_alphabet(c) for c in value]
    brute = np.concatenate([[0.0], np.cumsum(step)])
    most = min(n, 84)  # parts; 85! has more than MOST_COST digits
    order = np.array([math.lgamma(k + 1) / math.log(10) for k in range(most + 1)])
    runs, begun = _repeats(value, brute), 0
    reach = 2 * min(n // 2, int(MOST_COST)) + LONGEST + 1
    live: list[tuple[int, int, int, float, dict[int, np.ndarray]]] = []
    none = np.full(most + 1, np.inf)

    def more(row: np.ndarray, cost: float) -> np.ndarray:
        return np.concatenate([[np.inf], row[:-1] + cost])

    best = {0: np.concatenate([[0.0], none[1:]])}
    spans = walks = none
    for j in range(1, n + 1):
        spans = np.minimum(spans, more(best[j - 1], 0.0)) + step[j - 1]
        walks = walks + 0.35 if j > 1 and low[j - 2 : j] in _NEXT else none
        if j > 2 and low[j - 2 : j] in _NEXT and low[j - 3 : j - 1] in _NEXT:
            walks = np.minimum(walks, more(best[j - 3], math.log10(40 * 4) + 0.7))
        own = np.minimum(spans, walks)
        for i in range(max(0, j - LONGEST), j - 2):
            for cost in (word_cost(value[i:j], ranks), date_cost(value[i:j])):
                if cost is not None:
                    own = np.minimum(own, more(best[i], cost))
        while begun < len(runs) and runs[begun][0] < j:
            live.append((*runs[begun], {}))
            begun += 1
        live = [x for x in live if x[1] >= j]
        for a, e, p, cost, kept in live:
            starts = range(a + (j - a) % p, min(j - 2 * p, a + reach) + 1, p)
            if starts:
                if j % p not in kept or len(kept[j % p]) < len(starts):
                    kept[j % p] = np.stack([best[i] for i in starts])
                own = np.minimum(own, more((kept[j % p][: len(starts)] + np.log10((j - np.array(starts)) // p)[:, None]).min(0), cost))
        own = np.where(own + order < MOST_COST, own, np.inf)
        spans, walks = np.where(spans + order < MOST_COST, spans, np.inf), np.where(walks + order < MOST_COST, walks, np.inf)
        best[j] = own
        best.pop(j - 3 * reach, None)
        if not live and np.isinf(spans).all() and np.isinf(walks).all() and all(np.isinf(best[i]).all() for i in range(max(0, j - LONGEST), j + 1)):
            return MOST_COST
    return max(0.0, min(MOST_COST, float((best[n] + order).min())))


def scan(text: str, least: float = LEAST_COST, ranks: Mapping[str, int] = MappingProxyType({})) -> list[tuple[str, int, int, float | None]]:
    """All spans as (kind, start, end, guess cost or None), by start, then kind."""
    out: list[tuple[str, int, int, float | None]] = []
    low = text.lower()
    if any(k in low for k in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        out += [("assign", m.start(), m.end(), guess_cost(m[2], ranks)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"x" * 24 in text.encode("ascii", "replace").translate(_IS_HEX):
        out += [("hex", m.start(), m.end(), None) for m in HEX.finditer(text)]
    if any(h in low for h in _HINTS):
        base = sorted((a, b) for _, a, b, _ in out)
        for m in CONTEXT.finditer(text):
            value = m[1].rstrip(".)]}")
            if len(value) >= 6 and not any(a < m.start(1) + len(value) and m.start() < b for a, b in base) and (cost := guess_cost(value, ranks)) >= least:
                out.append(("guess", m.start(), m.start(1) + len(value), cost))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)


def redact(text: str, spans, mark: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones as one, replaced by ``mark``."""
    out, at = [], 0
    for _, a, b, _ in sorted(spans, key=lambda x: (x[1], x[2])):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256, spans, and the largest guess cost in the text; one pass after that of ``fit``."""
    ranks = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches):
        for b in batches:
            every = [scan(t, ranks=ranks.value) for t in texts(b.column("text"))]
            base = [[s for s in x if s[0] != "guess"] for x in every]
            count = lambda kind: pa.array([sum(s[0] == kind for s in x) for x in every], pa.int64())
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"), **{f"n_{k}": count(k) for k in KINDS},
                "base_sha256": pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base], pa.string()), "spans": pa.array([joined(x) for x in every], pa.string()),
                "max_cost": pa.array([max((s[3] for s in x if s[3] is not None), default=None) for x in every], pa.float64()),
            })

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string, max_cost double")


def redacted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` with secrets in ``text`` replaced, null texts kept null, and ``n_chars`` (if there) renewed."""
    source = rows(docs, columns)
    schema = source.schema["row"].dataType
    at, ranks = columns.index("text"), docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches):
        for b in batches:
            r = b.column("row")
            new = [None if t is None else redact(t, scan(t, ranks=ranks.value)) for t in r.field(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else r.field(i) for i in range(len(columns))], columns)

    out = source.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in columns else out
