"""Licence scans: an Aho-Corasick automaton finds identifier tags and notice phrases, and a shunting-yard parser evaluates the expressions behind tags.

Words are runs of ASCII letters, digits and characters beyond ASCII, after lower-casing A-Z.  A phrase is found wherever its words stand
consecutively, whatever stands between them.  Tagged identifiers come out as they are listed (``gpl-2.0+`` as ``gpl-2.0-or-later``), those that no list
has as ``unknown:``.  Defined results: null and empty texts have no words and no labels; overlapping places all count;
repeated rows each get their own result; an empty table gives an empty one; other columns of the input are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.llm.common import as_bytes, slices

#: Phrases that every scan counts.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notice phrases of well-known licences, with how sure a finding makes.
NOTICES = {
    "apache license version 2 0": ("apache-2.0", 0.95),
    "licensed under the apache license": ("apache", 0.8),
    "mit license": ("mit", 0.9),
    "permission is hereby granted free of charge": ("mit", 0.7),
    "redistribution and use in source and binary forms": ("bsd", 0.8),
    "bsd 2 clause": ("bsd-2-clause", 0.9),
    "bsd 3 clause": ("bsd-3-clause", 0.9),
    "gnu general public license": ("gpl", 0.95),
    "gnu lesser general public license": ("lgpl", 0.95),
    "gnu affero general public license": ("agpl", 0.95),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "creative commons attribution": ("cc-by", 0.85),
    "cc by sa": ("cc-by-sa", 0.8),
    "cc by nc": ("cc-by-nc", 0.8),
    "cc0 1 0": ("cc0-1.0", 0.9),
    "public domain": ("public-domain", 0.5),
    "this is free and unencumbered software released into the public domain": ("unlicense", 0.95),
    "proprietary and confidential": ("proprietary", 0.8),
}
TAGS = ("spdx license identifier",)
BASE_SURE, TAG_SURE, UNKNOWN_SURE = 0.6, 0.99, 0.3
# Public identifiers of licences and exceptions, in lower case.
GNU_VERSIONS = {"gpl": ("1.0", "2.0", "3.0"), "lgpl": ("2.0", "2.1", "3.0"), "agpl": ("1.0", "3.0"), "gfdl": ("1.1", "1.2", "1.3")}
CC_KINDS, CC_VERSIONS = ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"), ("1.0", "2.0", "2.5", "3.0", "4.0")
SINGLE = (
    "0bsd aal afl-1.1 afl-1.2 afl-2.0 afl-2.1 afl-3.0 apache-1.0 apache-1.1 apache-2.0 apsl-1.0 apsl-1.1 apsl-1.2 apsl-2.0 artistic-1.0 artistic-1.0-perl artistic-2.0"
    " beerware blueoak-1.0.0 bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-3-clause-lbnl bsd-4-clause bsl-1.0 busl-1.1 bzip2-1.0.6"
    " cc-pddc cc0-1.0 cddl-1.0 cddl-1.1 cecill-1.0 cecill-2.0 cecill-2.1 cecill-b cecill-c cpal-1.0 cpl-1.0 curl ecl-1.0 ecl-2.0 efl-1.0 efl-2.0 elastic-2.0 epl-1.0 epl-2.0"
    " etalab-2.0 eudatagrid eupl-1.0 eupl-1.1 eupl-1.2 fsfap fsful ftl hpnd icu ijg imagemagick intel ipl-1.0 isc json lpl-1.0 lpl-1.02 lppl-1.0 lppl-1.1 lppl-1.2 lppl-1.3a"
    " lppl-1.3c libpng libpng-2.0 libtiff mit mit-0 mit-cmu mpl-1.0 mpl-1.1 mpl-2.0 mpl-2.0-no-copyleft-exception ms-pl ms-rl mulanpsl-1.0 mulanpsl-2.0 ncsa netcdf nist-pd"
    " npl-1.0 npl-1.1 oclc-2.0 odbl-1.0 odc-by-1.0 ofl-1.0 ofl-1.1 ogl-uk-3.0 oldap-2.8 openssl osl-1.0 osl-2.0 osl-2.1 osl-3.0 pddl-1.0 php-3.0 php-3.01 postgresql psf-2.0"
    " python-2.0 qpl-1.0 ruby sgi-b-2.0 sissl sleepycat sspl-1.0 tcl unicode-dfs-2016 unicode-3.0 unlicense upl-1.0 vim w3c wtfpl x11 xnet zend-2.0 zlib zlib-acknowledgement"
    " zpl-2.0 zpl-2.1"
).split()
EXCEPTIONS = (
    "389-exception autoconf-exception-2.0 autoconf-exception-3.0 bison-exception-2.2 bootloader-exception classpath-exception-2.0 clisp-exception-2.0 ecos-exception-2.0"
    " font-exception-2.0 freertos-exception-2.0 gcc-exception-2.0 gcc-exception-3.1 gpl-cc-1.0 libtool-exception linux-syscall-note llvm-exception ocaml-lgpl-linking-exception"
    " openvpn-openssl-exception qt-gpl-exception-1.0 qt-lgpl-exception-1.1 swift-exception u-boot-exception-2.0 universal-foss-exception-1.0 wxwindows-exception-3.1"
).split()
#: Licences an expression may rest on to be evaluated as permissive.
PERMISSIVE = frozenset({"mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "zlib", "unlicense", "cc0-1.0", "cc-by-4.0", "0bsd"})

NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "expressions array<struct<expression:string, valid:boolean, permissive:boolean>>"
)


def _identifiers() -> dict[str, str]:
    """Every known identifier, deprecated forms too, and its label: a version with ``+`` is one "or later", one without either stays as it is written."""
    known = {x: x for x in SINGLE} | {f"cc-{k}-{v}": f"cc-{k}-{v}" for k in CC_KINDS for v in CC_VERSIONS}
    for family, versions in GNU_VERSIONS.items():
        for v in versions:
            only, later = f"{family}-{v}-only", f"{family}-{v}-or-later"
            known |= {only: only, later: later, f"{family}-{v}": f"{family}-{v}", f"{family}-{v}+": later}
    return known


IDENTIFIERS = _identifiers()


def _versioned_notices() -> dict[str, tuple[str, float]]:
    """Notices that name a version, for the families above: the longer phrase says more than the family's own."""
    made = {}
    names = {"gpl": "gnu general public license", "lgpl": "gnu lesser general public license", "agpl": "gnu affero general public license"}
    for family, name in names.items():
        for v in GNU_VERSIONS[family]:
            spelled = v.removesuffix(".0").replace(".", " ")
            made |= {f"{name} version {spelled}": (f"{family}-{v}", 0.95), f"{name} v{spelled}": (f"{family}-{v}", 0.95), f"{family}v{spelled}": (f"{family}-{v}", 0.85)}
    for kind in CC_KINDS:
        for v in CC_VERSIONS:
            made[f"cc {kind.replace('-', ' ')} {v.replace('.', ' ')}"] = (f"cc-{kind}-{v}", 0.9)
    for v in ("1.0", "1.1", "2.0"):
        made[f"mozilla public license version {v.replace('.', ' ')}"] = (f"mpl-{v}", 0.95)
    return made


def resolved(name: str) -> tuple[str, float]:
    """A tagged identifier's label and how sure it is: what nobody lists is marked as unknown, names of one's own stay."""
    licence, _, exception = name.partition(" with ")
    if licence.startswith(("licenseref-", "documentref-")):
        label = licence
    else:
        label = IDENTIFIERS.get(licence) or (IDENTIFIERS.get(licence.removesuffix("+")) and licence)
    if not label:
        return f"unknown:{name}", UNKNOWN_SURE
    if not exception:
        return label, TAG_SURE
    return (f"{label} with {exception}", TAG_SURE) if exception in EXCEPTIONS else (f"{label} with unknown:{exception}", UNKNOWN_SURE)


def to_postfix(expression: str) -> list[str] | None:
    """Shunting-yard: the expression's postfix order, or None if it isn't well formed."""
    out: list[str] = []
    held: list[str] = []
    operand_next = True
    for token in TOKEN.findall(expression):
        word = token.lower()
        if word in PRECEDENCE:
            if operand_next:
                return None
            while held and held[-1] != "(" and PRECEDENCE[held[-1]] >= PRECEDENCE[word]:
                out.append(held.pop())
            held.append(word)
            operand_next = True
        elif word == "(":
            if not operand_next:
                return None
            held.append(word)
        elif word == ")":
            if operand_next:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        else:
            if not operand_next:
                return None
            out.append(word)
            operand_next = False
    if operand_next or "(" in held:
        return None
    return out + held[::-1]


def evaluate(expression: str, permissive: frozenset[str] = PERMISSIVE) -> tuple[list[str], bool] | None:
    """(licences named, whether a choice rests on permissive ones only); None if the expression isn't well formed.

    ``or`` leaves a choice, ``and`` binds to both; ``with`` adds an exception, which permits more, never less.
    """
    postfix = to_postfix(expression)
    if postfix is None:
        return None
    stack: list[tuple[str, frozenset[str], bool]] = []
    for token in postfix:
        if token not in PRECEDENCE:
            stack.append((token, frozenset((token,)), token in permissive))
            continue
        (right, r_names, r_ok), (left, l_names, l_ok) = stack.pop(), stack.pop()
        if token == "with":
            if len(l_names) != 1 or len(r_names) != 1:
                return None
            stack.append((f"{left} with {right}", frozenset((f"{left} with {right}",)), l_ok))
        else:
            stack.append((token, l_names | r_names, l_ok or r_ok if token == "or" else l_ok and r_ok))
    return sorted(stack[0][1]), stack[0][2]


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Every phrase between blanks, so that it meets whole words only.  A phrase may be base, notice and tag at once."""
    found: dict[str, dict] = {}
    for phrase, label in BASE_PHRASES.items():
        found.setdefault(phrase, {})["base"] = label
    for phrase, notice in (_versioned_notices() | NOTICES).items():
        found.setdefault(phrase, {})["notice"] = notice
    for phrase in TAGS:
        found.setdefault(phrase, {})["tag"] = True
    made = ahocorasick.Automaton()
    for phrase, kinds in found.items():
        made.add_word(f" {phrase} ", (len(phrase.split()), kinds))
    made.make_automaton()
    return made


def scan_text(raw: bytes) -> tuple:
    """One row of SCHEMA without its doc_id."""
    cut = raw.translate(NORMAL)
    words = cut.split()
    places: list[tuple[int, str]] = []
    unsure: dict[str, float] = {}
    tagged: list[int] = []
    line = f" {b' '.join(words).decode('latin-1')} "
    blanks = upto = 0
    for end, (size, kinds) in automaton().iter(line):
        blanks += line.count(" ", upto, end + 1)
        upto = end + 1
        start = blanks - 1 - size
        if "base" in kinds:
            places.append((start, kinds["base"]))
        if "notice" in kinds:
            label, sure = kinds["notice"]
            unsure[label] = unsure.get(label, 1.0) * (1 - sure)
        if "tag" in kinds:
            tagged.append(start + size)
    for _, label in places:
        unsure[label] = unsure.get(label, 1.0) * (1 - BASE_SURE)
    expressions = []
    if tagged:
        ends = [m.end() for m in re.finditer(rb"[^ ]+", cut)]
        for word in tagged:
            text = raw[ends[word - 1] :].split(b"\n", 1)[0].decode("utf-8", "replace").lstrip(" :\t").rstrip()
            got = evaluate(text)
            expressions.append({"expression": text, "valid": got is not None, "permissive": bool(got and got[1])})
            for name in got[0] if got else ():
                label, sure = resolved(name)
                unsure[label] = unsure.get(label, 1.0) * (1 - sure)
    starts = [s for s, _ in places]
    score = 1 - min(unsure.values(), default=1.0)
    return (
        len(words), len(places), min(starts, default=None), max(starts, default=None),
        ",".join(sorted({x for _, x in places})), ",".join(sorted(unsure)), score, expressions,
    )


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("expressions", pa.list_(pa.struct([("expression", pa.string()), ("valid", pa.bool_()), ("permissive", pa.bool_())]))),
    ])
    for part in slices(batches, "text"):
        rows = [scan_text(x) for x in as_bytes(part.column("text"))]
        columns = [part.column("doc_id"), *(pa.array(c, kinds.field(i + 1).type) for i, c in enumerate(zip(*rows, strict=True)))]
        yield pa.RecordBatch.from_arrays(columns, schema=kinds)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words, base places, labels, confidence and tag expressions of every whole text."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scan, SCHEMA)
