"""Licence scan by sentence rules: sentences are normalised and named, and ordered rules match sequences of names.

A sentence ends at a line end or at ``.``, ``!`` or ``?`` before white space (not after a lone ``v``, as in ``v. 2.0``). Normalised, it is its lower-case words and
numbers, joined by blanks. Known sentences have an identifier; the identifiers of a text in order are matched against the
rules, first rule first, leftmost first; matched identifiers are used up, and may have ``GAP`` unknown sentences between.

Lines are read twice: by themselves, and joined to sentences that run over the lines of a paragraph (up to a line without a
word), comment signs aside. There a known sentence starts and ends at a line's start and end where its pattern isn't open;
it counts if it runs over a line end, from its first line's start to its last one's end. Unknown lines of a joined sentence
that holds known ones don't count for the gap, and a known line that only starts a longer known sentence gives way to it.

A sentence of identifiers (``SPDX-License-Identifier: A OR B``) shows each licence that it names, as it is written there.
Licences of a family are named with their version, too, where the sentence tells it (``versions``). A reference to a licence
doesn't count behind a negation (``not licensed under ...``).

Defined results: null and empty texts have no sentences and no licence; repeated sentences give repeated identifiers and
each licence once, in order of first match; whole texts are scanned.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts

GAP = 6
LATER = 120  # characters behind a known sentence that may still tell its version
# Cheap marks, one of which every known sentence holds (tested by writing out all patterns). Each is within one
# word, so it's in the lower-case text if and only if it's in the normalised one.
MARKS = ("licen", "copyright", "permission", "warrant", "redistribut", "liable", "reserved", "released", "commons", "cc0", "domain", "endorse", "useful", "bsd", "wtfpl", "cddl", "unencumbered")
# Identifiers of known licence sentences and patterns of their normalised form.
SENTENCES = {
    "apache-2-title": r"apache licen[sc]e version 2 0 january 2004.*",
    "gpl-3-title": r"gnu general public licen[sc]e version 3 29 june 2007.*",
    "gpl-2-title": r"gnu general public licen[sc]e version 2 june 1991.*",
    "lgpl-3-title": r"gnu lesser general public licen[sc]e version 3 29 june 2007.*",
    "lgpl-2-1-title": r"gnu lesser general public licen[sc]e version 2 1 february 1999.*",
    "agpl-3-title": r"gnu affero general public licen[sc]e version 3 19 november 2007.*",
    "mpl-2-title": r"mozilla public licen[sc]e version 2 0",
    "copyright": r"(?:copyright|c copyright).*\d{4}.*",
    "apache-2-ref": r".*licensed under (?:the )?apache licen[sc]e version 2(?: 0)?(?: the license)?",
    "apache-2-run-on": r".*licensed under (?:the )?apache licen[sc]e version 2 0 the licen[sc]e\x20you.*",  # within one line
    "apache-2-name": r"(?:the )?apache licen[sc]e(?: version)? 2(?: 0)?",
    "apache-notuse": r"you may not use this (?:file|work) except in compliance with the licen[sc]e",
    "apache-copy": r"you may obtain a copy of the licen[sc]e at.*",
    "as-is-basis": r".*distributed under the licen[sc]e is distributed on an as is basis.*",
    "mit-ref": r".*(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?mit licen[sc]e",
    "mit-name": r"(?:the )?mit licen[sc]e(?: mit)?",
    "mit-grant": r"permission is hereby granted free of charge to any person obtaining a copy.*",
    "mit-condition": r"the above copyright notice and this permission notice shall be included in all copies.*",
    "mit-warranty": r"the software is provided as is without warranty of any kind.*",
    "mit-liability": r"in no event shall the (?:authors|copyright holders).* liable for any claim.*",
    "bsd-grant": r"redistribution and use in source and binary forms with or without modification are permitted.*",
    "bsd-source": r"(?:\d )?redistributions of source code must retain.*",
    "bsd-binary": r"(?:\d )?redistributions in binary form must reproduce.*",
    "bsd-endorse": r"(?:\d )?neither the name .* may be used to endorse or promote products.*",
    "bsd-warranty": r"this software is provided by .* as is and any express or implied warranties.*",
    "gpl-3-ref": r".*licensed under (?:the )?gnu general public licen[sc]e(?: gpl)? version 3(?: 0)?",
    "gpl-2-ref": r".*licensed under (?:the )?gnu general public licen[sc]e(?: gpl)? version 2(?: 0)?",
    "gpl-free": r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license.*either version (?:2|3).*",
    "gpl-hope": r"this program is distributed in the hope that it will be useful.*",
    "gpl-copy": r"you should have received a copy of the gnu general public licen[sc]e.*",
    "lgpl-ref": r".*gnu (?:lesser|library) general public licen[sc]e.*",
    "agpl-ref": r".*gnu affero general public licen[sc]e.*",
    "mpl-2-ref": r".*(?:subject to|under) the (?:terms of the )?mozilla public licen[sc]e v(?:ersion)? ?2(?: 0)?.*",
    "epl-ref": r".*(?:under|terms of) the eclipse public licen[sc]e.*",
    "boost-ref": r".*distributed under the boost software licen[sc]e.*",
    "isc-grant": r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice.*",
    "zero-bsd-grant": r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc-warranty": r"the software is provided as is and the author disclaims all warranties.*",
    "zlib-warranty": r"this software is provided as is without any express or implied warranty.*",
    "cc-by-nc-4-ref": r".*(?:licensed|released) under (?:a |the )?(?:cc by nc|creative commons attribution noncommercial)(?: 4(?: 0)?)?(?: international)?(?: licen[sc]e)?",
    "cc-by-sa-4-ref": r".*(?:licensed|released) under (?:a |the )?(?:cc by sa|creative commons attribution sharealike)(?: 4(?: 0)?)?(?: international)?(?: licen[sc]e)?",
    "cc-by-4-ref": r".*(?:licensed|released) under (?:a |the )?(?:cc by|creative commons attribution)(?: 4(?: 0)?)?(?: international)?(?: licen[sc]e)?",
    "cc0-ref": r".*(?:cc0(?: 1(?: 0)?)?|creative commons zero).*",
    "unlicense": r"this is free and unencumbered software released into the public domain.*",
    "bsd-3-ref": r".*(?:licensed|released|distributed|available) under (?:a |the )?(?:terms of the )?(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)(?: licen[sc]e)?",
    "bsd-2-ref": r".*(?:licensed|released|distributed|available) under (?:a |the )?(?:terms of the )?(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: licen[sc]e)?",
    "bsd-ref": r".*(?:licensed|released|distributed|available) under (?:a |the )?(?:terms of the )?bsd(?: style)? licen[sc]e",
    "wtfpl": r".*(?:wtfpl|do what the fuck you want to public licen[sc]e).*",
    "cddl-ref": r".*(?:common development and distribution licen[sc]e|cddl).*",
    "artistic-ref": r".*artistic licen[sc]e.*",
    "public-domain": r".*(?:is|are|released into|placed in|dedicated to) (?:in )?the public domain.*",
    "spdx": r"spdx licen[sc]e identifier .*",
    "reserved": r"all rights reserved",
}
# Kinds of Creative Commons licences as they are written short and in full, and their versions.
COMMONS = {
    "BY": ("cc by", "creative commons attribution"),
    "BY-SA": ("cc by sa", "creative commons attribution sharealike"),
    "BY-ND": ("cc by nd", "creative commons attribution noderivatives"),
    "BY-NC": ("cc by nc", "creative commons attribution noncommercial"),
    "BY-NC-SA": ("cc by nc sa", "creative commons attribution noncommercial sharealike"),
    "BY-NC-ND": ("cc by nc nd", "creative commons attribution noncommercial noderivatives"),
}
COMMONS_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")


def _commons() -> dict[str, tuple[str, str]]:
    """Identifier: licence and pattern, of each kind and version; without a version it is the last one."""
    out = {}
    for kind, (short, full) in COMMONS.items():
        for v in COMMONS_VERSIONS:
            whole, part = v.split(".")
            number = rf" v?{whole}(?: 0)?" if part == "0" else rf" v?{whole} {part}"
            number = rf"(?:(?: version)?{number})" + ("?" if v == COMMONS_VERSIONS[-1] else "")
            out[f"cc-{kind.lower()}-{whole if part == '0' else v}-ref"] = (f"CC-{kind}-{v}", rf".*(?:licensed|released) under (?:a |the )?(?:{short}|{full})(?: licen[sc]e)?{number}(?: [a-z]+)?(?: licen[sc]e)?")
    return {k: x for k, x in out.items() if k not in SENTENCES}


_COMMONS = _commons()
SENTENCES |= {k: pattern for k, (_, pattern) in _COMMONS.items()}
# Licences and the identifier sequences that show them, longer rules first.
RULES = [
    ("MIT", ("mit-grant", "mit-condition", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-grant", "mit-condition", "mit-warranty")),
    ("BSD-3-Clause", ("reserved", "bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty")),
    ("BSD-2-Clause", ("reserved", "bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty")),
    ("Apache-2.0", ("apache-2-ref", "apache-notuse", "apache-copy", "as-is-basis")),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("0BSD", ("zero-bsd-grant", "isc-warranty")),
    ("Apache-2.0", ("apache-2-title",)),
    ("GPL-3.0", ("gpl-3-title",)),
    ("GPL-2.0", ("gpl-2-title",)),
    ("LGPL-3.0", ("lgpl-3-title",)),
    ("LGPL-2.1", ("lgpl-2-1-title",)),
    ("AGPL-3.0", ("agpl-3-title",)),
    ("MPL-2.0", ("mpl-2-title",)),
    ("GPL-family", ("gpl-free", "gpl-hope", "gpl-copy")),
    ("Apache-2.0", ("apache-2-ref", "apache-notuse")),
    ("Apache-2.0", ("apache-2-ref",)),
    ("Apache-2.0", ("apache-2-run-on",)),
    ("Apache-2.0", ("apache-2-name",)),
    ("MIT", ("mit-ref",)),
    ("MIT", ("mit-name",)),
    ("MIT", ("mit-grant",)),
    ("GPL-3.0", ("gpl-3-ref",)),
    ("GPL-2.0", ("gpl-2-ref",)),
    ("GPL-family", ("gpl-free",)),
    ("LGPL", ("lgpl-ref",)),
    ("AGPL", ("agpl-ref",)),
    ("MPL-2.0", ("mpl-2-ref",)),
    ("EPL", ("epl-ref",)),
    ("BSL-1.0", ("boost-ref",)),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("zero-bsd-grant",)),
    ("Zlib", ("zlib-warranty",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-ref",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-ref",)),
    ("CC-BY-4.0", ("cc-by-4-ref",)),
    ("CC0-1.0", ("cc0-ref",)),
    ("Unlicense", ("unlicense",)),
    ("BSD-3-Clause", ("bsd-3-ref",)),
    ("BSD-2-Clause", ("bsd-2-ref",)),
    ("BSD", ("bsd-ref",)),
    ("WTFPL", ("wtfpl",)),
    ("CDDL", ("cddl-ref",)),
    ("Artistic", ("artistic-ref",)),
    *[(licence, (name,)) for name, (licence, _) in _COMMONS.items()],
    ("public-domain", ("public-domain",)),
    ("proprietary", ("copyright", "reserved")),
    ("proprietary", ("reserved",)),
]
_KNOWN = re.compile("|".join(f"(?P<g{i}>{p})" for i, p in enumerate(SENTENCES.values())))
_NAMES = list(SENTENCES)
_END = re.compile(r"\n|(?<!\b[vV])[.!?](?=\s|$)")
_SPDX = re.compile(r"identifier\W*", re.I)
_ID = re.compile(r"(?<![A-Za-z0-9.+-])(?!(?:AND|OR|WITH)\b)[A-Za-z0-9][A-Za-z0-9.+-]*(?<!\.)")
_WORD = re.compile(r"[^\W_]+")
# Comment signs that are words, and lines without any other word; the other signs go when a line is normalised.
_COMMENT = re.compile(r"[\W_]*+(?:rem|dnl)\s", re.I)
_WORDLESS = re.compile(r"[\W_]*+(?:(?:rem|dnl)(?![^\W_])[\W_]*+)?\Z", re.I)


# Words that turn a reference round, and how many words before it they reach.
_NOT = re.compile(r"(?<!\S)(?:not|never|neither|nor|cannot|dont|don t|doesnt|doesn t|isnt|isn t|arent|aren t|won t|can t|no longer)(?!\S)")
REACH = 8
_REFERRED = re.compile(r"under|cc0|creative commons|public domain|wtfpl|cddl|(?:gnu|mozilla|eclipse|artistic|common development)\b")
_REFERENCES = {n for n in SENTENCES if n.endswith("-ref")} | {"wtfpl", "public-domain"}


def blocked(name: str, words: str, start: int = 0) -> bool:
    """Whether a reference is turned round by a word just before it (``start``: where to look for it in ``words``)."""
    if name not in _REFERENCES or not (m := _REFERRED.search(words, start)):
        return False
    return bool(_NOT.search(" ".join(words[: m.start()].split()[-REACH:])))


# Families whose sentences tell a version, and the words before it.
FAMILIES = {"gpl-free": ("GPL", "version"), "lgpl-ref": ("LGPL", "version"), "agpl-ref": ("AGPL", "version"), "epl-ref": ("EPL", "eclipse public licen[sc]e(?: version)?"), "cddl-ref": ("CDDL", "(?:licen[sc]e|cddl)(?: version)?"), "artistic-ref": ("Artistic", "artistic licen[sc]e(?: version)?")}


def version(name: str, words: str) -> str | None:
    """The licence of a family with the version that its sentence tells, ``-or-later`` if it says so; None without one."""
    if name not in FAMILIES:
        return None
    family, before = FAMILIES[name]
    m = re.search(rf"{before} v?(\d)(?: (\d)(?!\d))?", words)
    return m and f"{family}-{m[1]}.{m[2] or 0}" + ("-or-later" if "any later version" in words else "")


def _over_lines(pattern: str) -> list[re.Pattern]:
    """A known sentence's pattern cut at what is free, for lines of normalised words: a blank may be a line end."""
    first, *rest = pattern.replace(" ", "[ \n]").split(".*")
    parts = [f"^{first}" if first else "", *rest]
    if parts[-1]:
        parts[-1] += "$"
    return [re.compile(p, re.M) for p in parts if p]


_OVER_LINES = {name: _over_lines(p) for name, p in SENTENCES.items()}


def normalised(sentence: str) -> str:
    return " ".join(_WORD.findall(sentence.lower()))


def _words(line: str) -> str:
    """The normalised form without a comment sign."""
    m = _COMMENT.match(line)
    return normalised(line[m.end() :] if m else line)


def _line_words(part: str) -> str:
    """The normalised form of lines without their comment signs."""
    return " ".join(filter(None, map(_words, part.split("\n"))))


def _joined(lines: list[str]) -> tuple[list[tuple[int, int, str]], set[tuple[int, str]]]:
    """Known sentences over several lines as (first line, last line, identifier), and (line, identifier) of mere starts of them."""
    words = [_words(x) for x in lines]
    text, starts = "\n".join(words), [0]
    for w in words[:-1]:
        starts.append(starts[-1] + len(w) + 1)
    found = []
    for name, parts in _OVER_LINES.items():
        end = 0
        while m := parts[0].search(text, end):
            start, end = m.span()
            for p in parts[1:]:
                if not (m := p.search(text, end)):
                    break
                end = m.end()
            if not m:  # nor does it follow any later start
                break
            if not blocked(name, text.replace("\n", " "), start):
                found.append((start, end, name))
    longest: dict[int, int] = {}
    for start, end, _ in found:
        longest[start] = max(end, longest.get(start, 0))
    line = lambda at: bisect_right(starts, at) - 1
    whole = [(line(a), line(e - 1), n) for a, e, n in found if longest[a] == e]
    return [x for x in whole if x[0] < x[1]], {(line(a), n) for a, e, n in found if e < longest[a] and line(a) < line(longest[a] - 1)}


def _merged(text: str, group: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The sentences of lines that may be one sentence, with those that run over several of the lines."""
    over, mere = _joined([text[a:e] for a, e, _ in group])
    names = [n for *_, n in group]
    over = [x for x in over if x[2] not in names[x[0] : x[1] + 1]]
    # a bare name that goes on with a negated reference of the line before
    words = [_words(text[a:e]) for a, e, _ in group]
    turned = lambda i: bool(i) and names[i].endswith("-name") and bool(re.search(r"under(?: the)?$", words[i - 1])) and bool(_NOT.search(" ".join(words[i - 1].split()[-REACH:])))
    lines = [(a, e, "?" if (i, n) in mere or turned(i) else n) for i, (a, e, n) in enumerate(group)]
    known = [x for x in lines if x[2] != "?"] + [(group[i][0], group[j][1], n) for i, j, n in over]
    return sorted(known, key=lambda x: x[:2]) or lines


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, identifier or ``?``) of each sentence that isn't blank; those without a mark aren't normalised."""
    out, at = [], 0
    group, marked = 0, False  # where the lines start that may be one sentence, and whether they hold a mark
    for m in [*_END.finditer(text), None]:
        end = m.start() if m else len(text)
        part = text[at:end]
        wordless = bool(_WORDLESS.match(part))
        if part.strip():
            low = part.lower()
            mark = any(x in low for x in MARKS)
            words = _words(part) if mark else ""
            k = _KNOWN.fullmatch(words) if mark else None
            name = _NAMES[int(k.lastgroup[1:])] if k else "?"
            out.append((at, end, "?" if blocked(name, words) else name))
            marked |= mark
        if wordless or not m or m[0] != "\n":
            last = len(out) - (1 if wordless and part.strip() else 0)
            if marked and last - group > 1:
                out[group:last] = _merged(text, out[group:last])
            group, marked = len(out), False
        at = m.end() if m else end
    return out


def spdx_ids(sentence: str) -> list[str]:
    """The licences that a sentence of identifiers names; an exception after ``WITH`` is part of its licence's name."""
    rest = sentence[m.end() :] if (m := _SPDX.search(sentence)) else ""
    return [re.sub(r"\s+", "-", x.strip()) for x in re.findall(rf"{_ID.pattern}(?:\s+WITH\s+{_ID.pattern})?", rest)]


def licences(names: list[str], ids: dict[int, list[str]] | None = None) -> list[str]:
    """Licences that the rules find in a sequence of names (``?`` for unknown sentences); ids: those named, by place."""
    left = list(names)
    found: dict[str, int] = {}
    for licence, rule in RULES:
        i = 0
        while i < len(left):
            at, used = i, []
            for step, want in enumerate(rule):
                skipped = 0
                while at < len(left) and left[at] != want and left[at] in ("?", "copyright", "") and step and skipped < GAP:
                    at, skipped = at + 1, skipped + 1
                if at >= len(left) or left[at] != want:
                    used = []
                    break
                used.append(at)
                at += 1
            for u in used:
                left[u] = ""
            if used:
                found[licence] = min(found.get(licence, i), i)
            i += 1
    for i, named in (ids or {}).items():
        for x in named:
            found[x] = min(found.get(x, i), i)
    return sorted(found, key=lambda x: (found[x], x))


def scan(text: str) -> tuple[list[tuple[int, int, str]], list[str]]:
    """Known sentences with their places, and the licences."""
    low = text.lower()
    if not any(m in low for m in MARKS):
        return [], []
    every = sentences(text)
    ids = {i: spdx_ids(text[a:e]) for i, (a, e, n) in enumerate(every) if n == "spdx"}
    return [s for s in every if s[2] != "?"], licences([s[2] for s in every], ids)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, sentence_ids (name:start:end, joined), licenses and versions (joined); one pass, no shuffle."""

    def run(batches):
        for b in batches:
            every = list(texts(b.column("text")))
            found = [scan(t) for t in every]
            told = [[x for a, e, n in known if (x := version(n, _line_words(t[a : e + LATER])))] for t, (known, _) in zip(every, found, strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_sentences": pa.array([len(k) for k, _ in found], pa.int64()), "sentence_ids": pa.array([",".join(f"{n}:{a}:{e}" for a, e, n in k) for k, _ in found], pa.string()), "licenses": pa.array([",".join(x) for _, x in found], pa.string()), "versions": pa.array([",".join(dict.fromkeys(x)) for x in told], pa.string())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_sentences long, sentence_ids string, licenses string, versions string")
