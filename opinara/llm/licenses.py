"""License scans by ordered signature rules.

Each rule is a regex with a keyword and a priority: sentences of licenses' own texts, customary notices and addresses, and the
names of license families with their versions and uses. One Aho-Corasick pass finds the keywords of a text; only rules whose
keyword occurs are tried. A detection inside another one of at least its priority is suppressed, so that a notice silences
the names it contains. Every identifier of an SPDX expression is a detection of its own. Besides, the four base phrases are
found as runs of words, wherever they stand.

Defined results: null text counts as empty: no words, null first_word and last_word, empty labels, score 0. Texts are
scanned whole. Repeated rows give repeated rows; an empty table an empty one; other columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.common import slices
from opinara.llm.license_signatures import BODIES, REFERENCES, lines

SCANNED = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
DETECTED = "doc_id long, rule string, label string, priority int, start int, end int"

#: Fixed values of the base scan: phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: License families: label, how the name is written (a regex over lower-case text), its keyword, versions.
FAMILIES = [
    ("gpl", r"(?:gnu )?general public licen[sc]e|gnu gpl|gpl", "gpl|general public", "1.0 2.0 3.0"),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public licen[sc]e|lgpl", "lgpl|general public", "2.0 2.1 3.0"),
    ("agpl", r"(?:gnu )?affero general public licen[sc]e|agpl", "agpl|affero", "1.0 3.0"),
    ("gfdl", r"(?:gnu )?free documentation licen[sc]e|gfdl", "gfdl|free documentation", "1.1 1.2 1.3"),
    ("apache", r"apache(?: software)? licen[sc]e", "apache", "1.0 1.1 2.0"),
    ("mit", r"(?:mit|expat|x11) licen[sc]e", "mit licen|expat|x11 licen", ""),
    ("bsd-2-clause", r"(?:simplified bsd|2[- ]clause bsd|bsd 2[- ]clause)(?: licen[sc]e)?", "bsd", ""),
    ("bsd-3-clause", r"(?:new bsd|modified bsd|3[- ]clause bsd|bsd 3[- ]clause)(?: licen[sc]e)?", "bsd", ""),
    ("bsd-4-clause", r"(?:original bsd|4[- ]clause bsd|bsd 4[- ]clause)(?: licen[sc]e)?", "bsd", ""),
    ("bsd", r"bsd(?:[- ]style)? licen[sc]e", "bsd", ""),
    ("mpl", r"mozilla public licen[sc]e|mpl", "mozilla public|mpl", "1.0 1.1 2.0"),
    ("epl", r"eclipse public licen[sc]e", "eclipse public", "1.0 2.0"),
    ("cddl", r"common development and distribution licen[sc]e|cddl", "common development|cddl", "1.0 1.1"),
    ("cpl", r"common public licen[sc]e", "common public", "1.0"),
    ("eupl", r"european union public licen[sc]e|eupl", "european union public|eupl", "1.0 1.1 1.2"),
    ("isc", r"isc licen[sc]e", "isc licen", ""),
    ("zlib", r"zlib(?:/libpng)? licen[sc]e", "zlib", ""),
    ("bsl", r"boost software licen[sc]e", "boost software", "1.0"),
    ("artistic", r"(?:perl )?artistic licen[sc]e", "artistic licen", "1.0 2.0"),
    ("python", r"python(?: software foundation)? licen[sc]e|psf licen[sc]e", "python|psf licen", "2.0"),
    ("ofl", r"(?:sil )?open font licen[sc]e", "open font", "1.0 1.1"),
    ("odbl", r"open (?:data commons )?database licen[sc]e|odbl", "database licen|odbl", "1.0"),
    ("osl", r"open software licen[sc]e", "open software", "1.0 2.0 2.1 3.0"),
    ("afl", r"academic free licen[sc]e", "academic free", "2.0 2.1 3.0"),
    ("ecl", r"educational community licen[sc]e", "educational community", "1.0 2.0"),
    ("ms-pl", r"microsoft public licen[sc]e|ms-pl", "microsoft public|ms-pl", ""),
    ("ms-rl", r"microsoft reciprocal licen[sc]e|ms-rl", "microsoft reciprocal|ms-rl", ""),
    ("cecill", r"cecill(?:-[bc])?(?: licen[sc]e)?", "cecill", "1.0 1.1 2.0 2.1"),
    ("postgresql", r"postgresql licen[sc]e", "postgresql licen", ""),
    ("php", r"php licen[sc]e", "php licen", "3.0 3.01"),
    ("ruby", r"ruby licen[sc]e", "ruby licen", ""),
    ("openssl", r"openssl(?: and ssleay)? licen[sc]e", "openssl", ""),
    ("ncsa", r"(?:university of illinois/)?ncsa(?: open source)? licen[sc]e", "ncsa", ""),
    ("qpl", r"q public licen[sc]e", "q public", "1.0"),
    ("lppl", r"latex project public licen[sc]e|lppl", "latex project|lppl", "1.0 1.1 1.2 1.3"),
    ("upl", r"universal permissive licen[sc]e", "universal permissive", "1.0"),
    ("blueoak", r"blue oak model licen[sc]e", "blue oak", "1.0"),
    ("mulan", r"mulan (?:psl|permissive software licen[sc]e)", "mulan", "1.0 2.0"),
    ("rail", r"(?:open)?rail(?:-m)?(?: licen[sc]e)", "rail", ""),
    ("wtfpl", r"wtfpl|do what the fuck you want to public licen[sc]e", "wtfpl|do what the", "1.0 2.0"),
    ("unlicense", r"the unlicense|unlicense\.org", "unlicense", ""),
    ("cc0", r"cc0|creative commons zero", "cc0|commons zero", "1.0"),
    ("cc-by", r"cc[- ]by|creative commons attribution(?: \d\.\d)?(?: international)? licen[sc]e", "cc by|cc-by|creative commons", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-sa", r"cc[- ]by[- ]sa|creative commons attribution[- ]share-?alike", "cc by|cc-by|creative commons", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nd", r"cc[- ]by[- ]nd|creative commons attribution[- ]no-?deriv(?:ative)?s?", "cc by|cc-by|creative commons", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc", r"cc[- ]by[- ]nc|creative commons attribution[- ]non-?commercial", "cc by|cc-by|creative commons", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc-sa", r"cc[- ]by[- ]nc[- ]sa|creative commons attribution[- ]non-?commercial[- ]share-?alike", "cc by|cc-by|creative commons", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc-nd", r"cc[- ]by[- ]nc[- ]nd|creative commons attribution[- ]non-?commercial[- ]no-?deriv(?:ative)?s?", "cc by|cc-by|creative commons", "1.0 2.0 2.5 3.0 4.0"),
    ("proprietary", r"all rights reserved|proprietary and confidential", "all rights|proprietary and", ""),
    ("public-domain", r"(?:in|into) the public domain", "public domain", ""),
]
#: Priority and weight in the score of a license's sentence, of a reference, and of an identifier in an SPDX expression.
BODY, REFERENCE, SPDX = (60, 0.97), (45, 0.9), (90, 1.0)
#: How a name is used, best evidence first: rule suffix, priority, weight in the score, what stands around the name.
USES = [
    ("notice", 40, 0.95, r"(?:licen[sc]ed|released|distributed|available|redistributed?|published)(?: [a-z]+){{0,3}} under (?:the )?(?:terms of )?(?:the )?(?:{name})"),
    ("version", 30, 0.8, r"\b(?:{name})(?:,| )*(?:version |v\.? ?|-)?{version}\b"),
    ("name", 20, 0.6, r"\b(?:{name})\b"),
]


_GAP_SIGNS = r"[\s*#/]+"  # a line may begin with comment signs
_SPDX = re.compile(r"spdx-license-identifier:[ \t(]*([a-z0-9][\w.+:() \t-]*)")
_IDENTIFIER = re.compile(r"[a-z0-9][\w.+:-]*")


class Rule(NamedTuple):
    name: str
    label: str
    priority: int
    weight: float
    keywords: tuple[str, ...]
    pattern: re.Pattern


Detection = tuple[Rule, int, int]


@lru_cache(1)
def rules() -> list[Rule]:
    """All rules, best first: written signatures, and for each family its uses and versions."""
    space = lambda p: p.replace(" ", r"\s+").replace(r"[-\s+]", r"[-\s]")
    out = []
    for kind, block, (priority, weight) in (("text", BODIES, BODY), ("reference", REFERENCES, REFERENCE)):
        for n, (label, keywords, pattern) in enumerate(lines(block)):
            out.append(Rule(f"{label}-{kind}-{n}", label, priority, weight, keywords, re.compile(pattern.replace(" ", _GAP_SIGNS))))
    for label, name, keywords, versions in FAMILIES:
        keys, list_of = tuple(keywords.split("|")), versions.split()
        for use, priority, weight, form in USES:
            for version in list_of if use == "version" else [""]:
                number = re.escape(version).replace(r"\.0", r"(?:\.0)?")
                pattern = form.format(name=name, version=number)
                longer = len(label) // 2  # of two names, the more particular one
                out.append(Rule(f"{label}-{version or use}", f"{label}-{version}" if version else label, priority + longer, weight, keys, re.compile(space(pattern))))
    return sorted(out, key=lambda r: (-r.priority, r.name))


def plainly(text: str) -> str:
    """text as keywords are looked for: each run of white space and comment signs as one space."""
    return " ".join(text.replace("*", " ").replace("#", " ").replace("/", " ").split())


@lru_cache(1)
def keyword_machine():
    """Keywords, to the rules they gate."""
    import ahocorasick

    machine, gated = ahocorasick.Automaton(), {}
    for at, rule in enumerate(rules()):
        for key in rule.keywords:
            gated.setdefault(key, []).append(at)
    gated["spdx-license-identifier"] = [-1]
    for key, value in gated.items():
        machine.add_word(plainly(key), tuple(value))
    machine.make_automaton()
    return machine


@lru_cache(1024)
def _spdx_rule(identifier: str) -> Rule:
    label = re.sub(r"-(?:only|or-later)$|\+$", "", identifier)
    return Rule(f"{label}-spdx", label, *SPDX, ("spdx-license-identifier",), _IDENTIFIER)


def spdx(text: str) -> Iterator[Detection]:
    """Each identifier of each SPDX expression; operators and exceptions are none."""
    for line in _SPDX.finditer(text):
        exception = False
        for m in _IDENTIFIER.finditer(text, line.start(1), line.end(1)):
            if m.group() in ("and", "or", "with"):
                exception = m.group() == "with"
            elif not exception:
                yield _spdx_rule(m.group()), m.start(), m.end()


def suppress(found: list[Detection]) -> list[Detection]:
    """Detections, best first, without those inside another of at least their priority.

    A tree over starts holds the furthest end among those kept that begin no later, so that many mentions cost little each."""
    found = sorted(found, key=lambda x: (-x[0].priority, x[1], -x[2], x[0].name))
    starts = sorted({a for _, a, _ in found})
    furthest = [-1] * (len(starts) + 1)
    kept: list[Detection] = []
    for one in found:
        _, a, b = one
        own = at = bisect_right(starts, a)
        reach = -1
        while at:
            reach = max(reach, furthest[at])
            at &= at - 1
        if reach < b:
            kept.append(one)
            while own <= len(starts):
                furthest[own] = max(furthest[own], b)
                own += own & -own
    return kept


def detect(text: str) -> list[Detection]:
    """Detections in a text in lower case that outlast suppression, best first."""
    own = rules()
    due = {at for _, gated in keyword_machine().iter(plainly(text)) for at in gated}
    found = [(own[at], m.start(), m.end()) for at in sorted(due - {-1}) for m in own[at].pattern.finditer(text)]
    return suppress(found + (list(spdx(text)) if -1 in due else []))


def evidence(kept: list[Detection], base: set[str]) -> float:
    """How sure it is that a text names a license: the chance that not all detections are wrong, 0.6 at least with a base phrase."""
    doubt = sum(math.log1p(-min(rule.weight, 1 - 1e-12)) for rule, _, _ in kept)
    return max(0.0 - math.expm1(doubt), 0.6 if base else 0.0)


_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_GAP = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
_IN = rb"[0-9a-z\x80-\xff]"
_BASE = [(p.split()[0].encode(), re.compile(rb"(?<!" + _IN + rb")" + _GAP.join(w.encode() for w in p.split()) + rb"(?!" + _IN + rb")"), label) for p, label in BASE.items()]


def base_scan(text: bytes) -> tuple[int, int, int | None, int | None, set[str]]:
    """n_words, places, first and last start in words, and labels of a text whose A-Z are in lower case."""
    word = _WORD[np.frombuffer(text, np.uint8)]
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    at, labels = [], set()
    for key, pattern, label in _BASE:
        if key in text:
            places = [m.start() for m in pattern.finditer(text)]
            at += places
            labels |= {label} if places else set()
    first, last = (int(np.count_nonzero(starts[: f(at)])) if at else None for f in (min, max))
    return int(np.count_nonzero(starts)), len(at), first, last, labels


_UPPER = {c: c + 32 for c in range(65, 91)}
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1):
            rows = []
            for doc_id, raw in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                low = (raw or b"").translate(_LOWER)
                n_words, n_base, first, last, base = base_scan(low)
                kept = detect(low.decode("utf-8", "replace"))
                labels = base | {rule.label for rule, _, _ in kept}
                rows.append((doc_id, n_words, n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), evidence(kept, base)))
            columns = list(zip(*rows)) or [()] * 8
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in SCANNED.split(", ")])


def _detections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1):
            rows = [
                (doc_id, rule.name, rule.label, rule.priority, a, b)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist())
                for rule, a, b in detect((text or "").translate(_UPPER))
            ]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 6, kinds)], names=[x.split()[0] for x in DETECTED.split(", ")])


def detections(docs: DataFrame) -> DataFrame:
    """The detections that outlast suppression: doc_id, rule, label, priority, start and end in characters."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_detections, DETECTED)


def scan(docs: DataFrame) -> DataFrame:
    """Per document: its words, the base phrases' places and labels, all labels, and the evidence as a score of 0 to 1."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan, SCANNED)
