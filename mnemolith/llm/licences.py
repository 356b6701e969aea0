"""License scans by sentence rules.

Texts that mention licensing are cut into sentences, each sentence is
normalised (lower case, letters and digits only, single spaces) and mapped to the
identifier of a known licence sentence. A sentence that is not known as a whole, but says that
something is licensed, released or distributed under a licence, has the identifiers
of the references to licences in it, whatever stands around them; so has one that lists
nothing but licences. The identifiers of a text, in order and
without the unknown sentences, are matched against ordered licence rules: a rule
is a sequence of identifiers that must stand together. All of it is column
expressions over whole texts in one pass, without a shuffle; the tables of
sentences and rules are fixed and small.

Defined cases: null and empty texts, and texts without a known sentence, have
empty lists; known sentences that fit no rule give ``UNMATCHED``; a licence
found twice is listed once, in order of its rules; a rule that is part of another
licence's longer rule counts only outside of it (BSD-2 in BSD-3). Licences named in
``SPDX-License-Identifier`` lines follow as they are written there, whether or not
the tables know them; rules that match the same text are all listed, in their
order; a sentence that denies a licence is another sentence and names none;
repeated rows are scanned one by one; a text of any length is scanned whole, in
one task; extra columns, whatever their names, are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expressions import let

# Normalised licence sentences and their identifiers. A sentence
# that ends in "*" stands for all that begin with what is before it.
SENTENCES = {
    "copyright c *": "COPYRIGHT",
    "copyright 19*": "COPYRIGHT",
    "copyright 20*": "COPYRIGHT",
    "all rights reserved": "RESERVED",
    "licensed under the apache license version 2 0": "APACHE2_REF",
    "licensed under the apache license version 2 0 the license": "APACHE2_REF",
    "you may not use this file except in compliance with the license": "APACHE2_USE",
    "you may obtain a copy of the license at *": "APACHE2_COPY",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "APACHE2_ASIS",
    "see the license for the specific language governing permissions and limitations under the license": "APACHE2_SEE",
    "this work is licensed under the gnu general public license version 3": "GPL3_REF",
    "this work is licensed under the gnu general public license version 2": "GPL2_REF",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPL3_LATER",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GPL2_LATER",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GPL_WARRANTY",
    "see the gnu general public license for more details": "GPL_SEE",
    "licensed under cc by nc 4 0": "CCBYNC4_REF",
    "licensed under cc by 4 0": "CCBY4_REF",
    "licensed under cc by sa 4 0": "CCBYSA4_REF",
    "released under cc0 1 0": "CC0_REF",
    "licensed under the mit license": "MIT_REF",
    "released under the mit license": "MIT_REF",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MIT_GRANT",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MIT_NOTICE",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MIT_ASIS",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSD_GRANT",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSD_SOURCE",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSD_BINARY",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISC_GRANT",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "MPL2_REF",
    "this is free and unencumbered software released into the public domain": "UNLICENSE_REF",
    "neither the name of *": "BSD_NEITHER",
    "neither the names of *": "BSD_NEITHER",
    "the name of the author may not be used to endorse *": "BSD_NEITHER",
    "the names of its contributors may not be used to endorse *": "BSD_NEITHER",
    "the contents of this file are subject to the mozilla public license version 1 1 the license": "MPL11_REF",
    "distributed under the boost software license version 1 0": "BOOST_REF",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license *": "BOOST_GRANT",
    "either version 2 of the license or at your option any later version": "V2_LATER",
    "either version 2 1 of the license or at your option any later version": "V21_LATER",
    "either version 3 of the license or at your option any later version": "V3_LATER",
}
# The notices of the GNU licences, which are cut at their colons and semicolons.
_terms = "you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation"
for _name, _id in (("general public license", "GPL"), ("lesser general public license", "LGPL"), ("library general public license", "LGPL"), ("affero general public license", "AGPL")):
    SENTENCES[_terms.format(_name)] = f"{_id}_TERMS"
    SENTENCES[f"{_terms.format(_name)} either version 3 of the license or at your option any later version"] = f"{_id}3_LATER"
    for _version, _short in (("2", "2"), ("2 1", "21"), ("3", "3")):
        SENTENCES[_terms.format(f"{_name} version {_version}")] = f"{_id}{_short}_REF"
# References by name.
for _name, _id in (
    ("gnu lesser general public license version 3", "LGPL3_REF"),
    ("gnu lesser general public license version 2 1", "LGPL21_REF"),
    ("gnu affero general public license version 3", "AGPL3_REF"),
    ("gnu general public license version 3", "GPL3_REF"),
    ("gnu general public license version 2", "GPL2_REF"),
    ("bsd 3 clause license", "BSD3_REF"),
    ("bsd 2 clause license", "BSD2_REF"),
    ("mozilla public license version 1 1", "MPL11_REF"),
    ("boost software license version 1 0", "BOOST_REF"),
    ("business source license 1 1", "BUSL_REF"),
    ("eclipse public license version 2 0", "EPL2_REF"),
    ("eclipse public license v 2 0", "EPL2_REF"),
    ("eclipse public license version 1 0", "EPL1_REF"),
    ("mozilla public license version 2 0", "MPL2_REF"),
    ("apache license 2 0", "APACHE2_REF"),
):
    for _start in ("", "this work is ", "this software is ", "this project is ", "this program is "):
        SENTENCES[f"{_start}licensed under the {_name}"] = _id
for _name, _words in (("by", "attribution"), ("by sa", "attribution sharealike"), ("by nc", "attribution noncommercial"), ("by nd", "attribution noderivatives"), ("by nc sa", "attribution noncommercial sharealike"), ("by nc nd", "attribution noncommercial noderivatives")):
    _id = f"CC{_name.replace(' ', '').upper()}4_REF"
    for _start in ("", "this work is "):
        SENTENCES[f"{_start}licensed under cc {_name} 4 0"] = _id
        for _article in ("a", "the"):
            SENTENCES[f"{_start}licensed under {_article} creative commons {_words} 4 0 international license"] = _id
# Licences and the sentences that must follow each other, longer rules first.
RULES = [
    ("Apache-2.0", ["APACHE2_REF", "APACHE2_USE", "APACHE2_COPY", "APACHE2_ASIS", "APACHE2_SEE"]),
    ("Apache-2.0", ["APACHE2_REF"]),
    ("GPL-3.0-or-later", ["GPL3_LATER", "GPL_WARRANTY", "GPL_SEE"]),
    ("GPL-3.0-or-later", ["GPL3_LATER"]),
    ("GPL-3.0-only", ["GPL3_REF"]),
    ("GPL-2.0-or-later", ["GPL2_LATER", "GPL_WARRANTY", "GPL_SEE"]),
    ("GPL-2.0-or-later", ["GPL2_LATER"]),
    ("GPL-2.0-only", ["GPL2_REF"]),
    ("MIT", ["MIT_GRANT", "MIT_NOTICE", "MIT_ASIS"]),
    ("MIT", ["MIT_REF"]),
    ("BSD-3-Clause", ["BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_NEITHER"]),
    ("BSD-3-Clause", ["BSD3_REF"]),
    ("BSD-2-Clause", ["BSD_GRANT", "BSD_SOURCE", "BSD_BINARY"]),
    ("ISC", ["ISC_GRANT"]),
    ("MPL-2.0", ["MPL2_REF"]),
    ("CC-BY-NC-4.0", ["CCBYNC4_REF"]),
    ("CC-BY-SA-4.0", ["CCBYSA4_REF"]),
    ("CC-BY-4.0", ["CCBY4_REF"]),
    ("CC0-1.0", ["CC0_REF"]),
    ("Unlicense", ["UNLICENSE_REF"]),
    ("GPL-3.0-or-later", ["GPL_TERMS", "V3_LATER"]),
    ("GPL-2.0-or-later", ["GPL_TERMS", "V2_LATER"]),
    ("AGPL-3.0-or-later", ["AGPL3_LATER"]),
    ("AGPL-3.0-or-later", ["AGPL_TERMS", "V3_LATER"]),
    ("AGPL-3.0-only", ["AGPL3_REF"]),
    ("LGPL-3.0-or-later", ["LGPL3_LATER"]),
    ("LGPL-3.0-or-later", ["LGPL_TERMS", "V3_LATER"]),
    ("LGPL-3.0-only", ["LGPL3_REF"]),
    ("LGPL-2.1-or-later", ["LGPL_TERMS", "V21_LATER"]),
    ("LGPL-2.1-only", ["LGPL21_REF"]),
    ("LGPL-2.0-or-later", ["LGPL_TERMS", "V2_LATER"]),
    ("LGPL-2.0-only", ["LGPL2_REF"]),
    ("BSD-2-Clause", ["BSD2_REF"]),
    ("MPL-1.1", ["MPL11_REF"]),
    ("BSL-1.0", ["BOOST_REF"]),
    ("BSL-1.0", ["BOOST_GRANT"]),
    ("BUSL-1.1", ["BUSL_REF"]),
    ("EPL-2.0", ["EPL2_REF"]),
    ("EPL-1.0", ["EPL1_REF"]),
    ("CC-BY-ND-4.0", ["CCBYND4_REF"]),
    ("CC-BY-NC-SA-4.0", ["CCBYNCSA4_REF"]),
    ("CC-BY-NC-ND-4.0", ["CCBYNCND4_REF"]),
]
# Titles of licence texts, alone on their line or before what follows them.
TITLES = {
    "MIT": ["mit license", "the mit license", "the mit license mit", "mit license copyright *", "the mit license copyright *", "the mit license mit copyright *"],
    "Apache-2.0": ["version 2 0 january 2004", "apache license version 2 0 january 2004*"],
    "GPL-3.0-only": ["gnu general public license version 3 29 june 2007*"],
    "GPL-2.0-only": ["gnu general public license version 2 june 1991*"],
    "LGPL-3.0-only": ["gnu lesser general public license version 3 29 june 2007*"],
    "LGPL-2.1-only": ["gnu lesser general public license version 2 1 february 1999*"],
    "AGPL-3.0-only": ["gnu affero general public license version 3 19 november 2007*"],
    "MPL-2.0": ["mozilla public license version 2 0"],
    "BSD-3-Clause": ["bsd 3 clause license"],
    "BSD-2-Clause": ["bsd 2 clause license"],
    "ISC": ["isc license"],
}
for _licence, _lines in TITLES.items():
    _id = f"{_licence.upper().replace('.', '').replace('-', '')}_TITLE"
    SENTENCES |= dict.fromkeys(_lines, _id)
    RULES.append((_licence, [_id]))
RULES += [("ISC", ["ISC_REF"]), ("LGPL-2.1-or-later", ["LGPL21_LATER"])]
# How a sentence refers to a licence, and to its later versions, in normalised words.
_version, _later = "(?: version)? ?v? ?", " or (?:at your option )?(?:any )?(?:later|newer)\\b"
REFERENCES = {
    "APACHE2": f"\\bapache(?: software)?(?: licen[cs]e)?{_version}2(?: 0)?\\b",
    "MIT": "\\bmit(?: expat| x11)? licen[cs]e\\b",
    "BSD3": "\\bbsd 3 clause\\b|\\b3 clause bsd\\b|\\b(?:new|modified|revised) bsd licen[cs]e\\b",
    "BSD2": "\\bbsd 2 clause\\b|\\b2 clause bsd\\b|\\bsimplified bsd licen[cs]e\\b",
    "ISC": "\\bisc licen[cs]e\\b",
    "MPL2": f"\\b(?:mozilla public licen[cs]e|mpl){_version}2(?: 0)?\\b",
    "EPL2": f"\\b(?:eclipse public licen[cs]e|epl){_version}2(?: 0)?\\b",
    "AGPL3": f"\\b(?:gnu affero general public licen[cs]e|affero gpl|agpl){_version}3(?: 0)?\\b",
    "LGPL3": f"\\b(?:gnu lesser general public licen[cs]e|lgpl){_version}3(?: 0)?\\b",
    "LGPL21": f"\\b(?:gnu lesser general public licen[cs]e|lgpl){_version}2 1\\b",
    "GPL3": f"\\b(?:gnu general public licen[cs]e|gpl){_version}3(?: 0)?\\b",
    "GPL2": f"\\b(?:gnu general public licen[cs]e|gpl){_version}2(?: 0)?\\b",
    "BOOST": "\\bboost software licen[cs]e\\b",
    "UNLICENSE": "\\bunder the unlicense\\b",
}
HAVE_LATER = ("AGPL3", "LGPL3", "LGPL21", "GPL3", "GPL2")
PHRASE = "\\b(?:licen[cs]ed|released|distributed|available|published|offered|provided) (?:[^ ]+ ){0,6}?under\\b"
DENIED = "\\b(?:not|never|nor) (?:[^ ]+ )?(?:licen[cs]ed|released|distributed|available|published|offered|provided)\\b"
_one = f"(?:the )?(?:gnu )?(?:mit|{'|'.join(x.replace(chr(92) + 'b', '') for x in REFERENCES.values())})(?: licen[cs]e)?"
ONLY_NAMES = f"^{_one}(?: (?:and|or|and or) {_one})+$"
_named = "[A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?"
SPDX = f"(?i)SPDX-License-Identifier:[ \\t]*([( ]*{_named}(?:[ )]+(?:AND|OR|WITH)[ (]+{_named})*)"
#: Every sentence of the table has one of these, so other texts need no splitting.
MENTIONS = "(?i)licen|copyright|rights reserved|warrant|permission|redistribut|public domain|cc0|gpl|released under"


def _sentences(text: Column, wrapped: bool) -> Column:
    """Normalised sentences; they end at line breaks too, or (``wrapped``) go on over them."""
    ends = "(?<=[.!?;:])\\s+"
    pieces = F.split(F.regexp_replace(text, "\\s*\\n\\s*", " "), ends, -1) if wrapped else F.split(text, ends + "|\\s*\\n\\s*", -1)
    return F.transform(pieces, lambda s: F.btrim(F.regexp_replace(F.lower(s), "[^\\p{L}\\p{N}]+", " ")))


def _identifier(sentence: Column) -> Column:
    whole = {s: i for s, i in SENTENCES.items() if not s.endswith("*")}
    known = F.create_map(*[F.lit(x) for pair in whole.items() for x in pair])
    out = F.element_at(known, sentence)
    for start, name in SENTENCES.items():
        if start.endswith("*"):
            out = F.coalesce(out, F.when(F.startswith(sentence, F.lit(start[:-1])), F.lit(name)))
    return out


def _references(sentence: Column) -> Column:
    """Identifiers of the licences that a sentence refers to, in the order of the table."""
    listed = F.regexp_replace(sentence, "\\bmit\\b", "mit license")
    said = F.when(sentence.rlike(PHRASE) & ~sentence.rlike(DENIED), sentence).when(sentence.rlike(ONLY_NAMES), listed)

    def found(text: Column) -> Column:
        out = []
        for name, pattern in REFERENCES.items():
            here = F.when(text.rlike(f"(?:{pattern}){_later}"), f"{name}_LATER") if name in HAVE_LATER else F
            out.append(here.when(text.rlike(pattern), f"{name}_REF"))
        return F.filter(F.array(*out), lambda i: i.isNotNull())

    return let(said, lambda text: F.when(text.isNull(), F.array().cast("array<string>")).otherwise(found(text)))


def _identifiers(sentence: Column) -> Column:
    """The identifier of a known sentence, or those of the references in another."""
    return let(_identifier(sentence), lambda known: F.when(known.isNotNull(), F.array(known)).otherwise(_references(sentence)))


def _spdx(text: Column) -> Column:
    """Licences of SPDX lines; exceptions and operators of an expression are left out."""
    lines = F.regexp_extract_all(text, F.lit(SPDX), F.lit(1))
    named = F.transform(lines, lambda x: F.regexp_replace(x, "(?i)\\bWITH\\s+[A-Za-z0-9.+-]+", " "))
    parts = F.flatten(F.transform(named, lambda x: F.regexp_extract_all(x, F.lit(f"({_named})"), F.lit(1))))
    return F.filter(parts, lambda x: ~F.upper(x).isin("AND", "OR", "WITH"))


def _within(name: str, rule: list[str]) -> list[str]:
    """Lines of the other licences' longer rules that hold ``rule``, longest first."""
    line = f" {' '.join(rule)} "
    longer = [f" {' '.join(r)} " for other, r in RULES if other != name and len(r) > len(rule)]
    return sorted((x for x in longer if line in x), key=len, reverse=True)


def scan_licences(docs: DataFrame) -> DataFrame:
    """Return ``doc_id, licences, sentence_ids`` for every row of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = F.array().cast("array<string>")

    def identifiers(wrapped: bool) -> Column:
        found = F.flatten(F.transform(_sentences(text, wrapped), _identifiers))
        return F.when(text.rlike(MENTIONS), found).otherwise(none)

    spdx = F.when(text.rlike("(?i)spdx-license"), _spdx(text)).otherwise(none)

    def matched(one: Column, other: Column) -> Column:
        lines = [F.concat(F.lit(" "), F.array_join(ids, " "), F.lit(" ")) for ids in (one, other)]

        def holds(line: Column, name: str, rule: list[str]) -> Column:
            for longer in _within(name, rule):
                line = F.replace(line, F.lit(longer), F.lit(" "))
            return F.contains(line, F.lit(f" {' '.join(rule)} "))

        rules = [F.when(holds(lines[0], name, rule) | holds(lines[1], name, rule), F.lit(name)) for name, rule in RULES]
        some = F.array_distinct(F.concat(F.filter(F.array(*rules), lambda name: name.isNotNull()), spdx))
        known = (F.size(one) > 0) | (F.size(other) > 0) | (F.size(spdx) > 0)
        return F.when(~known, none).when(F.size(some) == 0, F.array(F.lit("UNMATCHED"))).otherwise(some)

    def result(both: Column) -> Column:
        one, other = both["one"], both["other"]
        longer = F.when(F.size(other) > F.size(one), other).otherwise(one)
        return F.struct(matched(one, other).alias("licences"), longer.alias("ids"))

    both = F.struct(identifiers(False).alias("one"), identifiers(True).alias("other"))
    scanned = docs.select(F.col("doc_id").cast("long").alias("doc_id"), let(both, result).alias("scan"))
    return scanned.select("doc_id", F.col("scan.licences").alias("licences"), F.col("scan.ids").alias("sentence_ids"))
