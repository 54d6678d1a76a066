"""Licence scan by sentence rules, with DataFrame functions only.

Texts are normalised (lower case, everything but letters and digits becomes one
blank, with line and sentence ends marked). A known sentence counts wherever it
stands from one line or sentence end to another; line ends inside it are blanks,
sentence ends and blank lines are not. The identifiers found, in text order, are matched against the licence rules: a rule
is an ordered run of identifiers; longer rules come first, and an identifier
used by a longer rule is not used again by a shorter one. A sentence that names licences (SPDX
expressions with OR, AND and WITH; "License: MIT"; "dual licensed under the MIT and GPL licenses") gives
the identifier of each; a notice whose subject is denied gives none. All licences of a choice count.

Only documents with a keyword (``WORDS``) are normalised. No text and no
sentence is left out for its length, blanks, rules or comment marks.

Result: one row per input row with ``n_sentences`` (known sentences found),
``sentence_ids``, ``licenses`` (licences of the matched rules in rule order),
``verdict``: the strictest class among them (``noncommercial``, ``copyleft``,
``permissive``; ``unspecified``: a sentence of several licences alone;
``reserved``: all rights reserved and no licence) or ``none``. Null and empty texts: none. Very long texts are
searched whole. Repeated rows are scanned each for itself; other columns, whatever
their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import textarrays as T

# Short notices, normalised, and their rules. Fixed values.
SENTENCES = {
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-not-use": "you may not use this file except in compliance with the license",
    "apache-obtain": "you may obtain a copy of the license at",
    "apache-asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed "
                   "on an as is basis without warranties or conditions of any kind either express or implied",
    "mit-notice": "released under the mit license",
    "mit-title": "the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl-copy": "you should have received a copy of the gnu general public license along with this program",
    "bync-notice": "licensed under cc by nc 4 0",
    "bync-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "by-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "bsd-redistribute": "redistribution and use in source and binary forms with or without modification are permitted",
    "bsd-warranty": "this software is provided by the copyright holders and contributors as is",
    "reserved": "all rights reserved",
}
# Ordered rules: (licence, class, run of identifiers); the longest first.
RULES = [
    ("Apache-2.0", "permissive", ["apache-notice", "apache-not-use", "apache-obtain", "apache-asis"]),
    ("GPL-3.0", "copyleft", ["gpl-free", "gpl-warranty", "gpl-copy"]),
    ("Apache-2.0", "permissive", ["apache-notice", "apache-not-use"]),
    ("MIT", "permissive", ["mit-title", "mit-grant"]),
    ("MIT", "permissive", ["mit-grant", "mit-warranty"]),
    ("BSD", "permissive", ["bsd-redistribute", "bsd-warranty"]),
    ("Apache-2.0", "permissive", ["apache-notice"]),
    ("MIT", "permissive", ["mit-notice"]),
    ("GPL-3.0", "copyleft", ["gpl3-notice"]),
    ("CC-BY-NC-4.0", "noncommercial", ["bync-notice"]),
    ("CC-BY-NC-4.0", "noncommercial", ["bync-work"]),
    ("CC-BY-4.0", "permissive", ["by-work"]),
]
STRICTEST = ("noncommercial", "copyleft", "permissive")
KEYWORDS = "licen[cs]e|permission|warrant|redistribut|rights reserved|as is|by-nc"
# The sentences of the licence texts and headers as they are published, with their usual variants: regular expressions
# over normalised words. <m,n> stands for m to n words (a name), <<m,n>> also over a point (Inc.), ~ for a gap with a point.
_UNDER = "(?:<1,8>(?:is|are) )?(?:dual )?(?:licensed|released|distributed|published|available|made available) under (?:the terms of )?(?:an? |the )?"
_SEE = "(?: see <1,8>for (?:more )?(?:details|information))?"
_FSF = "(?:this (?:program|library) )?is free software you (?:can|may) redistribute it and or modify it under the terms of (?:version {v} of )?the gnu {n} public license "
_CC = "(?:creative commons attribution {n}4 0(?: international)?(?: public)?(?: license)?(?: cc by {c}4 0)?|cc by {c}4 0(?: international)?(?: license)?)"


def _gnu(ident: str, name: str, v: str) -> list[tuple[str, str]]:
    """The version sentence of a GNU header, with the version before or after the publisher."""
    head, by = _FSF.format(v=v, n=name), "as published by the free software foundation(?: inc)?"
    later = "(?: or at your option any later version)?"
    return [(f"{ident}-free", f"{head}(?:either )?version {v} (?:of the license )?{by}{later}"),
            (f"{ident}-free", f"{head}{by}(?: either)?(?: under)? version {v}(?: of the license)?(?: only)?{later}"),
            (f"{ident}-notice", f"{_UNDER}gnu {name} public license (?:<0,1>version |v)?{v}(?: 0)?(?: only| or later| or any later version)?{_SEE}")]


TEXTS = [
    ("apache-header", "licensed under the apache license version 2 0 the license you may not use <1,6>except in compliance with the license"),
    ("apache-notice", f"{_UNDER}apache(?: software)? license(?: version| v)? 2 0(?: the license)?{_SEE}(?! (?:the license )?you may not use)"),
    ("apache-obtain", "you may obtain a copy of the license (?:at|from)"),
    ("apache-asis", "unless required by applicable law or agreed to in writing <1,4>distributed under the license is distributed on an as is basis "
                    "without warranties or conditions of any kind(?: either express or implied)?"),
    ("apache-see", "see the license for the specific language governing permissions and limitations under the license"),
    ("apache-title", "apache license version 2 0 january 2004"),
    ("mit-title", "(?:the )?(?:mit|mit x11|expat) license(?: mit| expat)?"),
    ("mit-notice", f"{_UNDER}(?:mit|expat) license(?: mit)?{_SEE}"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and(?: or)? associated documentation(?: files)? "
                  "the software to deal in the software without restriction including without limitation(?: on)? the rights to use copy modify merge "
                  "publish distribute(?: distribute with modifications)? sublicense and or sell copies of the software and to permit persons to whom the "
                  "software is furnished to do so(?: subject to the following conditions?)?"),
    ("mit-keep", "the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial "
                 "portions of the software"),
    ("mit-warranty", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
                     "merchantability fitness for a particular purpose and non ?infringement"),
    *_gnu("gpl3", "general", "3"), *_gnu("gpl2", "general", "2"), *_gnu("agpl3", "affero general", "3"),
    *_gnu("lgpl3", "lesser general", "3"), *_gnu("lgpl21", "(?:lesser|library) general", "2(?: 1)?"),
    ("gpl-free", _FSF.replace("(?:version {v} of )?", "").format(n="general").rstrip() + "(?: as published by the free software foundation(?: inc)?)?"),
    ("gpl-warranty", "(?:this (?:program|library) )?(?:is|are) distributed in the hope that (?:it|they) will be useful but without any warranty without even the implied warranty of "
                     "merchantability or fitness for a particular purpose"),
    ("gpl-copy", "you should have received a copy of the gnu general public license(?: version [23])?(?: along with(?: <0,5>[a-z0-9]+))?"),
    ("agpl-copy", "you should have received a copy of the gnu affero general public license(?: version 3)?(?: along with(?: <0,5>[a-z0-9]+))?"),
    ("lgpl-copy", "you should have received a copy of the gnu (?:lesser|library) general public license(?: along with(?: <0,5>[a-z0-9]+))?"),
    ("gpl3-title", "gnu general public license version 3 29 june 2007"),
    ("gpl2-title", "gnu general public license version 2 june 1991"),
    ("agpl3-title", "gnu affero general public license version 3 19 november 2007"),
    ("lgpl3-title", "gnu lesser general public license version 3 29 june 2007"),
    ("lgpl21-title", "gnu lesser general public license version 2 1 february 1999"),
    ("bsd-redistribute", "redistribution and use(?: of this software)? in source and binary forms with or without modification are permitted"
                         "(?: provided that the following conditions are met)?"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice(?: and)? this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice(?: and)? this list of conditions and the following disclaimer "
                   "in the documentation and or other materials provided with the distribution"),
    ("bsd-advert", "all advertising materials mentioning features or use of this software must display the following ac?knowledge?ment"),
    ("bsd-endorse", "(?:neither )?the names? (?:of )?<<1,16>>(?:may|must) (?:not )?be used to endorse or promote products derived from this software without "
                    "specific prior written permission"),
    ("bsd-warranty", "this software is provided by <<1,12>>as is and any express or implied warranties including but not limited to the implied warranties "
                     "of merchantability and fitness for a particular purpose are disclaimed"),
    ("bsd2-notice", f"{_UNDER}(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd) license{_SEE}"),
    ("bsd3-notice", f"{_UNDER}(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd) license{_SEE}"),
    ("bsd-notice", f"{_UNDER}bsd(?: style)? license{_SEE}"),
    ("mpl2-header", "this source code form is subject to the terms of the mozilla public license v(?:ersion)?~2 0"),
    ("mpl2-title", "mozilla public license version 2 0"),
    ("isc-grant", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the "
                  "above copyright notice and this permission notice appear in all copies"),
    ("by-work", _UNDER + _CC.format(n="", c="")), ("bync-work", _UNDER + _CC.format(n="non ?commercial ", c="nc ")),
    ("bysa-work", _UNDER + _CC.format(n="share ?alike ", c="sa ")), ("byncsa-work", _UNDER + _CC.format(n="non ?commercial share ?alike ", c="nc sa ")),
    ("byncnd-work", _UNDER + _CC.format(n="non ?commercial no ?deriv(?:ative|ativework)s ", c="nc nd ")),
    ("reserved", "(?:copyright <<0,16>>)?all rights reserved"),
    ("unlicense-text", "this is free and unencumbered software released into the public domain"),
]
# Names of licences in SPDX expressions and short notices, normalised: identifier (with -spdx): name, class, pattern. CC licences
# follow by rule from their kinds and versions.
_V, _LATER = "(?: version| ?v)? ?", "(?: only| or later)?"
NAMES = {
    "apache": ("Apache-2.0", "permissive", f"apache{_V}2 0|apache2|apache 2"),
    "mit": ("MIT", "permissive", "mit|expat|mit x11"),
    "mit0": ("MIT-0", "permissive", "mit 0"),
    "isc": ("ISC", "permissive", "isc"),
    "zlib": ("Zlib", "permissive", "zlib"),
    "bsd0": ("0BSD", "permissive", "0bsd"),
    "bsd2": ("BSD-2-Clause", "permissive", "bsd 2 clause|2 clause bsd"),
    "bsd3": ("BSD-3-Clause", "permissive", "bsd 3 clause|3 clause bsd"),
    "boost": ("BSL-1.0", "permissive", f"(?:bsl|boost|boost software license){_V}1 0"),
    "unlicense": ("Unlicense", "permissive", "unlicense"),
    "cc0": ("CC0-1.0", "permissive", "(?:cc0|creative commons zero|cc zero)(?: v?1 0)?(?: universal)?"),
    "ofl": ("OFL-1.1", "permissive", f"(?:sil )?(?:ofl|open font license){_V}1 1"),
    "epl2": ("EPL-2.0", "copyleft", f"(?:epl|eclipse public license){_V}2 0"),
    "mpl2": ("MPL-2.0", "copyleft", f"(?:mpl|mozilla public license){_V}2 0"),
    "gpl3": ("GPL-3.0", "copyleft", f"(?:gnu )?gpl{_V}3(?: 0)?{_LATER}"),
    "gpl2": ("GPL-2.0", "copyleft", f"(?:gnu )?gpl{_V}2(?: 0)?{_LATER}"),
    "agpl3": ("AGPL-3.0", "copyleft", f"(?:gnu )?agpl{_V}3(?: 0)?{_LATER}"),
    "lgpl3": ("LGPL-3.0", "copyleft", f"(?:gnu )?lgpl{_V}3(?: 0)?{_LATER}"),
    "lgpl21": ("LGPL-2.1", "copyleft", f"(?:gnu )?lgpl{_V}2(?: [01])?{_LATER}"),
    "gpl": ("GPL", "copyleft", "(?:gnu )?gpl"),
    "agpl": ("AGPL", "copyleft", "(?:gnu )?agpl"),
    "lgpl": ("LGPL", "copyleft", "(?:gnu )?lgpl"),
    "bsd": ("BSD", "permissive", "bsd"),
}
_KINDS = {"by": ("BY", "permissive", "", ""), "bync": ("BY-NC", "noncommercial", "nc ", "non ?commercial "),
          "bysa": ("BY-SA", "copyleft", "sa ", "share ?alike "), "bynd": ("BY-ND", "copyleft", "nd ", "no ?deriv(?:ative|ativework)?s "),
          "byncsa": ("BY-NC-SA", "noncommercial", "nc sa ", "non ?commercial share ?alike "),
          "byncnd": ("BY-NC-ND", "noncommercial", "nc nd ", "non ?commercial no ?deriv(?:ative|ativework)?s ")}
_PLACE = "(?: international| unported| generic)?"
NAMES |= {i + ("" if v == "4.0" else v.replace(".", "")):
          (f"CC-{name}-{v}", kind, f"cc by {short}{v.replace('.', ' ')}{_PLACE}|creative commons attribution {full}{v.replace('.', ' ')}{_PLACE}")
          for i, (name, kind, short, full) in _KINDS.items() for v in ("4.0", "3.0", "2.5", "2.0", "1.0")}
_NAME = "(?:" + "|".join(sorted((p for _, _, p in NAMES.values()), key=len, reverse=True)) + ")"
_NAMED = f"(?:{_NAME}|apache license{_V}2 0)(?: license)?"
# Sentences that name licences; each name in them gives its identifier. An SPDX expression goes to the line's end, unknown names included.
LISTS = ["spdx license identifier <0,15>[a-z0-9]+", f"{_UNDER}(?:either )?(?:of )?(?:the )?{_NAMED}(?:(?: and| or| and or)(?: the)? {_NAMED})+(?: licenses)?", f"{_UNDER}{_NAME}",
         f"(?:the )?license (?:is )?{_NAME}", f"{_NAME} licensed"]
# For both engines, on words with one blank between: what stands before, behind and between the names.
LIST_HEAD, LIST_TAIL = "^(?:spdx licen[cs]e identifier|.*? under|(?:the )?licen[cs]e) (?:the terms of )?(?:either )?(?:of )?(?:an? |the |is )?", " licen[cs](?:e|es|ed)$"
LIST_SPLIT = "(?: licen[cs]e)? (?:and or|or|and|with) (?:the )?"
# A notice whose subject is denied ("none of this is licensed under") is none; [^a-z0-9]+ stands for any gap.
NEGATED = "^(?:[a-z0-9]+[^a-z0-9]+){0,8}?(?:no|none|not|nothing|neither|never|nor|nobody)[^a-z0-9]+(?:[a-z0-9]+[^a-z0-9]+){0,8}?(?:is|are)[^a-z0-9]+" \
          "(?:dual[^a-z0-9]+)?(?:licen[cs]ed|released|distributed|published|available|made)[^a-z0-9]"
# Sentences long enough to count inside a line too (unwrapped texts, after a copyright line without a point).
ANYWHERE = {"apache-header", "apache-asis", "apache-see", "mit-grant", "mit-keep", "mit-warranty", "gpl3-free", "gpl2-free", "agpl3-free", "lgpl3-free",
            "lgpl21-free", "gpl-free", "gpl-warranty", "gpl-copy", "agpl-copy", "lgpl-copy", "bsd-redistribute", "bsd-source", "bsd-binary", "bsd-advert",
            "bsd-endorse", "bsd-warranty", "mpl2-header", "isc-grant"}
_BSD = ["bsd-redistribute", "bsd-source", "bsd-binary"]
_GNU_RUNS = [("AGPL-3.0", "agpl3", "agpl-copy"), ("GPL-3.0", "gpl3", "gpl-copy"), ("GPL-2.0", "gpl2", "gpl-copy"), ("LGPL-3.0", "lgpl3", "lgpl-copy"), ("LGPL-2.1", "lgpl21", "lgpl-copy")]
# Rules over the published sentences. The long runs stand before RULES, the single sentences after them.
TEXT_RULES = [
    ("BSD-4-Clause", "permissive", [*_BSD, "bsd-advert", "bsd-endorse", "bsd-warranty"]),
    ("BSD-3-Clause", "permissive", [*_BSD, "bsd-endorse", "bsd-warranty"]),
    ("MIT", "permissive", ["mit-title", "mit-grant", "mit-keep", "mit-warranty"]),
    ("Apache-2.0", "permissive", ["apache-header", "apache-obtain", "apache-asis", "apache-see"]),
    ("Apache-2.0", "permissive", ["apache-notice", "apache-not-use", "apache-obtain", "apache-asis", "apache-see"]),
    ("BSD-2-Clause", "permissive", [*_BSD, "bsd-warranty"]),
    ("MIT", "permissive", ["mit-grant", "mit-keep", "mit-warranty"]),
    *[(name, "copyleft", [f"{i}-free", "gpl-warranty", copy]) for name, i, copy in _GNU_RUNS],
    ("BSD-3-Clause", "permissive", [*_BSD, "bsd-endorse"]),
]
SINGLE_RULES = [
    ("Apache-2.0", "permissive", ["apache-header"]), ("Apache-2.0", "permissive", ["apache-title"]), ("Apache-2.0", "permissive", ["apache-spdx"]),
    ("MIT", "permissive", ["mit-spdx"]), ("ISC", "permissive", ["isc-grant"]), ("ISC", "permissive", ["isc-spdx"]),
    *[(name, "copyleft", [f"{i}-{part}"]) for name, i, _ in _GNU_RUNS for part in ("free", "notice", "title", "spdx") if (i, part) != ("gpl3", "notice")],
    ("BSD-2-Clause", "permissive", ["bsd2-notice"]), ("BSD-2-Clause", "permissive", ["bsd2-spdx"]), ("BSD-3-Clause", "permissive", ["bsd3-notice"]),
    ("BSD-3-Clause", "permissive", ["bsd3-spdx"]), ("BSD", "permissive", ["bsd-notice"]),
    ("MPL-2.0", "copyleft", ["mpl2-header"]), ("MPL-2.0", "copyleft", ["mpl2-title"]), ("MPL-2.0", "copyleft", ["mpl2-spdx"]),
    ("CC-BY-4.0", "permissive", ["by-spdx"]), ("CC-BY-NC-4.0", "noncommercial", ["bync-spdx"]),
    *[(name, kind, [f"{i}-{part}"]) for name, kind, i in (("CC-BY-SA-4.0", "copyleft", "bysa"), ("CC-BY-NC-SA-4.0", "noncommercial", "byncsa"),
                                                         ("CC-BY-NC-ND-4.0", "noncommercial", "byncnd")) for part in ("work", "spdx")],
]
_ruled = {i for _, _, run in SINGLE_RULES for i in run}
_bare = ("GPL", "AGPL", "LGPL", "BSD")
SINGLE_RULES += [(name, kind, [f"{i}-spdx"]) for i, (name, kind, _) in NAMES.items() if name not in _bare and f"{i}-spdx" not in _ruled]
SINGLE_RULES += [("Unlicense", "permissive", ["unlicense-text"])]
ALL_RULES = [*TEXT_RULES, *RULES, *SINGLE_RULES]
# Sentences that stand alone or apart from their run, after all other rules. UNSPECIFIED: some licence, but the sentence stands in
# several of different classes (Apache and MPL headers, MIT and Unlicense warranties).
UNSPECIFIED, RESERVED = "Unspecified", "All-Rights-Reserved"
FALLBACK_RULES = [
    ("MIT", "permissive", ["mit-grant"]), ("MIT", "permissive", ["mit-title"]),
    ("AGPL", "copyleft", ["agpl-copy"]), ("LGPL", "copyleft", ["lgpl-copy"]),
    ("GPL", "copyleft", ["gpl-free"]), ("GPL", "copyleft", ["gpl-warranty"]), ("GPL", "copyleft", ["gpl-copy"]),
    *[("BSD", "permissive", [f"bsd-{x}"]) for x in ("redistribute", "source", "binary", "advert", "endorse", "warranty")],
    *[(UNSPECIFIED, "unspecified", [x]) for x in ("apache-not-use", "apache-obtain", "apache-asis", "apache-see", "mit-warranty", "mit-keep")],
    *[(name, kind, [f"{i}-spdx"]) for i, (name, kind, _) in NAMES.items() if name in _bare],
    (RESERVED, "reserved", ["reserved"]),
]
# A name without a version gives way to one of the same kind with a version; the last two give way to any licence.
GIVES_WAY = {"AGPL": "AGPL", "LGPL": "LGPL", "GPL": ".*GPL", "BSD": "BSD", UNSPECIFIED: ".", RESERVED: "."}
CLASSES = (*STRICTEST, "unspecified", "reserved")
# One of these stands in every known sentence, also where it is wrapped.
WORDS = r"licen[cs]e|permission|warrant|redistribut|advertis|cc[^a-z0-9]+by|creative[^a-z0-9]+commons|rights[^a-z0-9]+reserved|as[^a-z0-9]+is|by[^a-z0-9]+nc|unencumbered|(?:released|distributed|published|available)[^a-z0-9]+under"


# A sentence may run over lines (a blank in it matches one line end) and begins and ends at a sentence or line end (see ANYWHERE).
_GAP, _EDGE = r"[ \n]", r"[\n\x01]"


def _pattern(p: str) -> str:
    p = p.replace("license", "licen[cs]e").replace("~", r"[ \n\x01]?").replace(" ?", "\0").replace(" ", _GAP).replace("\0", _GAP + "?")
    p = re.sub(r"<<(\d+,\d+)>>", lambda m: rf"(?:[a-z0-9]++[ \n\x01]){{{m[1]}}}?", p)
    return re.sub(r"<(\d+,\d+)>", lambda m: rf"(?:[a-z0-9]++{_GAP}){{{m[1]}}}?", p)


def marked(text: Column) -> Column:
    """A text as lower-case words with one blank, line feed (line end) or \\x01
    (sentence end, blank line) between them. A line of marks only is blank; a web
    address, a colon or a semicolon ends a line. No step depends on lengths."""
    t = F.lower(F.concat(F.lit("\n"), text, F.lit("\n")))
    for find, put in ((r"\r\n|[\r\f\x0b]", "\n"), (r"(?:https?://|www\.)\S*", "\n"), (r"[^a-z0-9.!?:;\n]+", " "), (r" ?\n ?", "\n"), (r"(?<=\n)\n+|\n(?=\n)", "\x01"),
                      (r"[.!?][ \n\x01]", "\x01"), (r"[:;][ \n]", "\n"), (r"[.!?:;]+", " "), (r" +", " "), (r" ?([\n\x01]) ?", "$1")):
        t = F.regexp_replace(t, find, put)
    return t


def name_pattern(p: str) -> str:
    """A name as it stands between the marks of ``LIST_SPLIT``."""
    return "^(?:" + p.replace("license", "licen[cs]e").replace(" or later", " later") + ")(?: licen[cs]e)?$"


def _named(s: Column) -> Column:
    """The identifiers of the licences that a sentence of ``LISTS`` names; exceptions and unknown names have none."""
    words = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", " "), LIST_HEAD, ""), LIST_TAIL, "")
    parts = F.split(F.regexp_replace(words, " or later", " later"), LIST_SPLIT)
    listed = [*((i, p) for i, (_, _, p) in NAMES.items()), ("apache", f"apache license{_V}2 0")]
    names = F.transform(parts, lambda x: F.coalesce(*[F.when(x.rlike(name_pattern(p)), F.lit(f"{i}-spdx")) for i, p in listed]))
    return F.filter(names, lambda x: x.isNotNull())


def identifiers(text: Column) -> Column:
    """The identifiers of the known sentences of a text, in order."""
    known = [*SENTENCES.items(), *TEXTS]
    # the longest first; a gap, or for short sentences an edge, on both sides; one look for what begins with _UNDER
    long = [p for i, p in TEXTS if i in ANYWHERE]
    under = [p[len(_UNDER):] for i, p in TEXTS if p.startswith(_UNDER)]
    short = [p for i, p in known if p not in long and not p.startswith(_UNDER)]
    long, under, short = ("|".join(map(_pattern, sorted(x, key=len, reverse=True))) for x in (long, under, short))
    lists = "|".join(map(_pattern, LISTS))
    any_of = rf"(?<=[ \n\x01])(?:{long})(?=[ \n\x01])|(?<={_EDGE})(?:{lists}|{_pattern(_UNDER)}(?:{under})|{short})(?={_EDGE})"
    found = F.filter(F.regexp_extract_all(marked(text), F.lit(any_of), F.lit(0)), lambda s: ~s.rlike(NEGATED))
    return F.flatten(F.transform(found, lambda s: F.coalesce(*[F.when(s.rlike(f"^(?:{_pattern(p)})$"), F.array(F.lit(i))) for i, p in known], _named(s))))


def scan(docs: DataFrame) -> DataFrame:
    d = T.strip_columns(docs, "doc_id", "text")
    hit = F.coalesce(F.col("text"), F.lit("")).rlike(f"(?i){WORDS}")
    d = d.select("doc_id", F.when(hit, identifiers(F.col("text"))).otherwise(F.array().cast("array<string>")).alias("ids"))
    # sequences as text: "|a||b|"; a rule's run must stand in it unbroken
    rest = F.array_join(F.transform("ids", lambda i: F.concat(F.lit("|"), i, F.lit("|"))), "")
    found, single, late = [], {}, {}
    d = d.withColumn("rest", rest)
    for n, (name, kind, run) in enumerate([*ALL_RULES, *FALLBACK_RULES]):
        seq = "".join(f"|{i}|" for i in run)
        here = F.instr("rest", seq) > 0
        if len(run) > 1:
            d = d.withColumn(f"r{n}", here).withColumn("rest", F.replace("rest", F.lit(seq), F.lit("|#|")))
        elif n < len(ALL_RULES):  # after all runs; no two rules share a single identifier
            single[f"r{n}"] = here
        else:
            late[f"r{n}"] = here, name
        found.append((f"r{n}", name, kind))
    d = d.withColumns(single).withColumns({r: here for r, (here, _) in late.items()})
    give = {}
    for r, (_, name) in late.items():
        over = [F.col(x) for x, other, _ in found if other != name and re.match(GIVES_WAY.get(name, "$"), other) and (other not in (UNSPECIFIED, RESERVED) or name == RESERVED)]
        give[r] = F.col(r) & ~reduce(or_, over, F.lit(False))
    d = d.withColumns(give)
    names = F.array_distinct(F.filter(F.array(*[F.when(F.col(r), F.lit(n)) for r, n, _ in found]), lambda x: x.isNotNull()))
    verdict = F.lit("none")
    for kind in reversed(CLASSES):
        any_of = F.lit(False)
        for r, _, k in found:
            if k == kind:
                any_of = any_of | F.col(r)
        verdict = F.when(any_of, kind).otherwise(verdict)
    return d.select("doc_id", F.size("ids").cast("bigint").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"),
                    F.array_join(names, ",").alias("licenses"), verdict.alias("verdict"))
