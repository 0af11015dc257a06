"""License detection by ordered signature rules, in DataFrame functions alone.

A text is brought to its words, lower-cased (A-Z); where it has any keyword, they are joined with two spaces, so that rules are written in words and hold for any
punctuation and line breaks, and a place in words is half the number of spaces before it. A rule has a label, a priority, the
keywords without which it cannot match, and a regular expression. One intersection with the text's words finds the keywords that occur; only rules whose keywords all occur are tried, each over the whole text. Detections (rule, first word, end) overlap: one
goes if it lies within a detection of a higher priority, or within a longer one of the same. As maxima over sorted
detections say whether one is contained, no two detections of a document are ever paired.

The texts are read once; beyond that step only detections are shuffled, by the row's number.

Defined cases: null and empty texts have no words, no labels and score 0; texts of any length are searched whole; rows that repeat
are each judged; equal detections of one priority fall to the rule that comes first in the list; an empty table gives an empty
result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from svloom.llm.common import Workspace

#: What stands between words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrases that count wherever their words stand, and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Priorities of the kinds of rules, and what a detection of the kind says about the text (0 to 1).
TEXT, NOTICE, TAG, ADDRESS, NAME, HINT = 6, 5, 4, 3, 2, 1
CONFIDENCE = {TEXT: 1.0, NOTICE: 0.95, TAG: 0.95, ADDRESS: 0.8, NAME: 0.6, HINT: 0.3}


RULE_SCHEMA = "array<struct<rule:int,label:string,priority:int,keywords:array<array<string>>,pattern:string>>"


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    #: All must occur; "a|b" occurs where a or b does.
    keywords: tuple[str, ...]
    #: Words and groups, one space between words; `w` stands for any word.
    pattern: str


L = "licen[cs]e"
UNDER = "(?:licen[cs]ed|released|distributed|available|published|provided|covered|made available|dual licen[cs]ed|redistributed) (?:to you )?under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?"

#: label, keyword, pattern of the name in words (no version), versions, names of the tag. Each makes rules of every kind.
FAMILIES = (
    ("mit", "mit", f"mit {L}", (), ("mit", "mit 0", "mit modern variant", "mit advertising")),
    ("x11", "x11", f"x11 {L}", (), ("x11",)),
    ("isc", "isc", f"isc {L}", (), ("isc",)),
    ("bsd", "bsd", f"bsd(?: style)? {L}", (), ("bsd source code", "bsd protection")),
    ("bsd-2-clause", "bsd", f"(?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd|freebsd)(?: {L})?", (), ("bsd 2 clause", "bsd 2 clause patent", "bsd 2 clause views")),
    ("bsd-3-clause", "bsd", f"(?:new bsd|revised bsd|modified bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: {L})?", (), ("bsd 3 clause", "bsd 3 clause clear", "bsd 3 clause lbnl")),
    ("bsd-4-clause", "bsd", f"(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)(?: {L})?", (), ("bsd 4 clause", "bsd 4 clause uc")),
    ("0bsd", "bsd", f"(?:zero clause bsd|0bsd|bsd zero clause)(?: {L})?", (), ("0bsd",)),
    ("apache", "apache", f"apache(?: software)? {L}", ("1 0", "1 1", "2 0", "2"), ("apache",)),
    ("apache", "apache", "apache", ("1 1", "2 0"), ()),
    ("gpl", "gpl", "(?:gnu )?gpl", ("1", "2", "3", "1 0", "2 0", "3 0"), ("gpl",)),
    ("gpl", "general", f"(?:gnu )?general public {L}", ("1", "2", "3", "2 0", "3 0"), ()),
    ("lgpl", "lgpl", "(?:gnu )?lgpl", ("2", "2 1", "3", "2 0", "3 0"), ("lgpl",)),
    ("lgpl", "lesser", f"(?:gnu )?(?:lesser|library) general public {L}", ("2", "2 1", "3"), ()),
    ("agpl", "agpl", "(?:gnu )?agpl", ("1", "3", "3 0"), ("agpl",)),
    ("agpl", "affero", f"(?:gnu )?affero general public {L}", ("1", "3"), ()),
    ("gfdl", "documentation", f"(?:gnu )?free documentation {L}", ("1 1", "1 2", "1 3"), ("gfdl",)),
    ("mpl", "mozilla", f"mozilla public {L}", ("1 0", "1 1", "2 0"), ()),
    ("mpl", "mpl", "mpl", ("1 0", "1 1", "2 0"), ("mpl",)),
    ("epl", "eclipse", f"eclipse public {L}", ("1 0", "2 0"), ()),
    ("epl", "epl", "epl", ("1 0", "2 0"), ("epl",)),
    ("edl", "eclipse", f"eclipse distribution {L}", ("1 0",), ()),
    ("cddl", "cddl", "cddl", ("1 0", "1 1"), ("cddl",)),
    ("cddl", "distribution", f"common development and distribution {L}", ("1 0", "1 1"), ()),
    ("cpl", "public", f"common public {L}", ("1 0",), ("cpl",)),
    ("ipl", "public", f"ibm public {L}", ("1 0",), ("ipl",)),
    ("eupl", "eupl", "eupl", ("1 0", "1 1", "1 2"), ("eupl",)),
    ("eupl", "european", f"european union public {L}", ("1 0", "1 1", "1 2"), ()),
    ("artistic", "artistic", f"artistic {L}", ("1 0", "2 0"), ("artistic",)),
    ("boost", "boost", f"boost software {L}", ("1 0",), ()),
    ("boost", "bsl", "bsl", ("1 0",), ("bsl",)),
    ("zlib", "zlib", f"zlib(?: libpng)? {L}", (), ("zlib", "zlib acknowledgement")),
    ("libpng", "libpng", f"libpng {L}", ("2 0",), ("libpng",)),
    ("unlicense", "unlicense", "unlicense", (), ("unlicense",)),
    ("wtfpl", "wtfpl", "wtfpl", ("2",), ("wtfpl",)),
    ("python", "python", f"python software foundation {L}", ("2", "2 0"), ("python", "psf")),
    ("ruby", "ruby", f"ruby(?: s)? {L}", (), ("ruby",)),
    ("php", "php", f"php {L}", ("3 0", "3 01"), ("php",)),
    ("perl", "perl", "same terms as perl(?: itself)?", (), ()),
    ("ofl", "font", f"(?:sil )?open font {L}", ("1 0", "1 1"), ("ofl",)),
    ("ofl", "ofl", "ofl", ("1 0", "1 1"), ()),
    ("openssl", "openssl", f"openssl {L}", (), ("openssl",)),
    ("postgresql", "postgresql", f"postgresql {L}", (), ("postgresql",)),
    ("curl", "curl", f"curl {L}", (), ("curl",)),
    ("ncsa", "ncsa", f"(?:university of illinois )?ncsa(?: open source)? {L}", (), ("ncsa",)),
    ("afl", "academic", f"academic free {L}", ("1 1", "2 0", "2 1", "3 0"), ("afl",)),
    ("osl", "osl", "osl", ("1 0", "2 0", "2 1", "3 0"), ("osl",)),
    ("osl", "open", f"open software {L}", ("1 0", "2 1", "3 0"), ()),
    ("ms-pl", "microsoft", f"microsoft public {L}", (), ("ms pl",)),
    ("ms-rl", "microsoft", f"microsoft reciprocal {L}", (), ("ms rl",)),
    ("qpl", "public", f"q public {L}", ("1 0",), ("qpl",)),
    ("vim", "vim", f"vim {L}", (), ("vim",)),
    ("tcl", "tcl", f"tcl(?: tk)? {L}", (), ("tcl",)),
    ("w3c", "w3c", f"w3c (?:software )?(?:notice and )?{L}", (), ("w3c",)),
    ("zpl", "zope", f"zope public {L}", ("2 0", "2 1"), ("zpl",)),
    ("ecl", "community", f"educational community {L}", ("1 0", "2 0"), ("ecl",)),
    ("upl", "universal", f"universal permissive {L}", ("1 0",), ("upl",)),
    ("mulan", "mulan", f"mulan (?:permissive software|psl)(?: {L})?", ("1", "2"), ("mulanpsl",)),
    ("sspl", "sspl", "sspl", ("1", "1 0"), ("sspl",)),
    ("sspl", "server", f"server side public {L}", ("1",), ()),
    ("elastic", "elastic", f"elastic {L}", ("2 0",), ("elastic",)),
    ("busl", "business", f"business source {L}", ("1 1",), ("busl",)),
    ("polyform", "polyform", f"polyform (?:noncommercial|small business|strict|shield)(?: {L})?", ("1 0 0",), ("polyform noncommercial", "polyform small business")),
    ("commons-clause", "clause", "commons clause", ("1 0",), ()),
    ("odbl", "odbl", "odbl", ("1 0",), ("odbl",)),
    ("odbl", "database", f"open database {L}", ("1 0",), ()),
    ("odc-by", "attribution", f"open data commons attribution {L}", ("1 0",), ("odc by",)),
    ("cc0", "cc0", "cc0", ("1 0",), ("cc0",)),
    ("cc-by", "cc", "cc by", ("1 0", "2 0", "2 5", "3 0", "4 0"), ("cc by",)),
    ("cc-by-sa", "cc", "cc by sa", ("1 0", "2 0", "2 5", "3 0", "4 0"), ("cc by sa",)),
    ("cc-by-nc", "cc", "cc by nc", ("1 0", "2 0", "2 5", "3 0", "4 0"), ("cc by nc",)),
    ("cc-by-nd", "cc", "cc by nd", ("1 0", "2 0", "2 5", "3 0", "4 0"), ("cc by nd",)),
    ("cc-by-nc-sa", "cc", "cc by nc sa", ("1 0", "2 0", "2 5", "3 0", "4 0"), ("cc by nc sa",)),
    ("cc-by-nc-nd", "cc", "cc by nc nd", ("1 0", "2 0", "2 5", "3 0", "4 0"), ("cc by nc nd",)),
)

#: label, kind, keywords, pattern: sentences of licenses and notices, addresses, hints.
SINGLE = (
    ("mit", TEXT, ("permission", "granted", "sublicense"), "permission is hereby granted free of charge to any person obtaining a copy of this software(?: w){0,20} to deal in the software without restriction(?: w){0,20} sublicense and or sell copies of the software"),
    ("mit", TEXT, ("substantial", "portions"), "above copyright notice and this permission notice(?: w){0,5} shall be included in all copies or substantial portions of the software"),
    ("mit-0", TEXT, ("permission", "granted", "sublicense"), "permission is hereby granted free of charge to any person obtaining a copy of this software(?: w){0,45} and to permit persons to whom the software is furnished to do so the software is provided as is"),
    ("isc", TEXT, ("permission", "fee", "hereby"), "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("0bsd", TEXT, ("permission", "fee", "hereby"), "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("bsd", TEXT, ("redistribution", "binary", "modification"), "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3-clause", TEXT, ("neither", "endorse", "derived"), "neither the names? of (?:the )?(?:w ){1,12}nor the names of (?:its|any|other|the|their) (?:w ){0,4}?may be used to endorse or promote products derived"),
    ("bsd-4-clause", TEXT, ("advertising", "mentioning"), "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2.0", NOTICE, ("apache", "compliance"), f"licensed under the apache {L} version 2 0 the {L} you may not use this file except in compliance with the {L}"),
    ("apache-2.0", TEXT, ("apache", "terms", "reproduction"), f"apache {L} version 2 0 january 2004(?: w){{0,6}} terms and conditions for use reproduction and distribution"),
    ("gpl-2-or-later", NOTICE, ("general", "later", "foundation"), f"redistribute it and or modify it under the terms of the gnu general public {L} as published by the free software foundation either version 2 of the {L} or at your option any later version"),
    ("gpl-3-or-later", NOTICE, ("general", "later", "foundation"), f"redistribute it and or modify it under the terms of the gnu general public {L} as published by the free software foundation either version 3 of the {L} or at your option any later version"),
    ("lgpl-2.1-or-later", NOTICE, ("lesser", "later", "foundation"), f"redistribute it and or modify it under the terms of the gnu lesser general public {L} as published by the free software foundation either version 2 1 of the {L} or at your option any later version"),
    ("lgpl-3-or-later", NOTICE, ("lesser", "later", "foundation"), f"redistribute it and or modify it under the terms of the gnu lesser general public {L} as published by the free software foundation either version 3 of the {L} or at your option any later version"),
    ("agpl-3-or-later", NOTICE, ("affero", "later", "foundation"), f"redistribute it and or modify it under the terms of the gnu affero general public {L} as published by the free software foundation either version 3 of the {L} or at your option any later version"),
    ("gpl", NOTICE, ("general", "warranty", "merchantability"), f"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public {L} for more details"),
    ("lgpl", NOTICE, ("lesser", "warranty", "merchantability"), f"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public {L} for more details"),
    ("agpl", NOTICE, ("affero", "warranty", "merchantability"), f"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public {L} for more details"),
    ("gpl", TEXT, ("verbatim", "preamble"), f"everyone is permitted to copy and distribute verbatim copies of this {L} document but changing it is not allowed preamble"),
    ("mpl-2.0", NOTICE, ("mozilla", "source", "mpl"), f"this source code form is subject to the terms of the mozilla public {L} v 2 0 if a copy of the mpl was not distributed with this file"),
    ("mpl-1.1", NOTICE, ("mozilla", "contents"), f"the contents of this file are subject to the mozilla public {L} version 1 1"),
    ("epl", NOTICE, ("eclipse", "accompanying"), f"this program and the accompanying materials are made available under the terms of the eclipse public {L}"),
    ("cddl", NOTICE, ("distribution", "contents"), f"the contents of this file are subject to the terms of (?:either )?the (?:w ){{0,8}}?common development and distribution {L}"),
    ("zlib", TEXT, ("altered", "misrepresented"), "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", TEXT, ("express", "implied", "arising"), "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("boost", TEXT, ("derivative", "executable"), "unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor"),
    ("unlicense", TEXT, ("unencumbered", "domain"), "this is free and unencumbered software released into the public domain"),
    ("wtfpl", TEXT, ("public", "want"), "you just do what the (?:fuck|f w) you want to"),
    ("wtfpl", NAME, ("public", "want"), f"do what the (?:fuck|f w) you want to public {L}"),
    ("beerware", TEXT, ("beer",), "you can buy me a beer in return"),
    ("beerware", NAME, ("beerware",), f"(?:the )?beerware {L}"),
    ("json", TEXT, ("evil",), "the software shall be used for good not evil"),
    ("ofl", TEXT, ("font", "reserved"), "no modified version of the font software may use the reserved font name"),
    ("artistic", TEXT, ("package", "holder"), "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains"),
    ("openssl", TEXT, ("openssl", "product"), "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ncsa", TEXT, ("redistributions", "contributors"), "neither the names of (?:w ){1,10}nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("cc0", TEXT, ("cc0", "waived"), "to the extent possible under law (?:w ){1,10}has waived all copyright and related or neighboring rights"),
    ("cc-by", NAME, ("creative", "attribution"), "creative commons attribution(?: (?:1 0|2 0|2 5|3 0|4 0))?(?: (?:international|unported|generic))?"),
    ("cc-by-sa", NAME, ("creative", "sharealike"), "creative commons attribution sharealike(?: (?:1 0|2 0|2 5|3 0|4 0))?(?: (?:international|unported|generic))?"),
    ("cc-by-nc", NAME, ("creative", "noncommercial"), "creative commons attribution noncommercial(?: (?:1 0|2 0|2 5|3 0|4 0))?(?: (?:international|unported|generic))?"),
    ("cc-by-nd", NAME, ("creative", "noderivatives"), "creative commons attribution noderiv(?:ative)?s(?: (?:1 0|2 0|2 5|3 0|4 0))?(?: (?:international|unported|generic))?"),
    ("cc-by-nc-sa", NAME, ("creative", "noncommercial", "sharealike"), "creative commons attribution noncommercial sharealike(?: (?:1 0|2 0|2 5|3 0|4 0))?(?: (?:international|unported|generic))?"),
    ("cc-by-nc-nd", NAME, ("creative", "noncommercial", "noderivatives"), "creative commons attribution noncommercial noderiv(?:ative)?s(?: (?:1 0|2 0|2 5|3 0|4 0))?(?: (?:international|unported|generic))?"),
    ("cc0", NAME, ("creative", "zero"), "creative commons zero(?: 1 0)?"),
    ("mit", ADDRESS, ("opensource", "mit"), f"opensource org {L}s? mit(?: {L})?(?: php)?"),
    ("apache", ADDRESS, ("apache", "licenses"), "(?:www )?apache org licenses(?: license 2 0)?(?: html| txt)?"),
    ("gpl", ADDRESS, ("gnu", "gpl"), "(?:www )?gnu org (?:licenses|copyleft) (?:old licenses )?gpl(?: [123] 0)?(?: html| txt)?"),
    ("lgpl", ADDRESS, ("gnu", "lgpl"), "(?:www )?gnu org (?:licenses|copyleft) (?:old licenses )?lgpl(?: [23] [01])?(?: html| txt)?"),
    ("agpl", ADDRESS, ("gnu", "agpl"), "(?:www )?gnu org licenses agpl(?: 3 0)?(?: html| txt)?"),
    ("gpl", ADDRESS, ("gnu", "licenses"), "(?:www )?gnu org licenses"),
    ("mpl", ADDRESS, ("mozilla", "mpl"), "(?:www )?mozilla org (?:en us )?mpl(?: [12] [01])?"),
    ("epl", ADDRESS, ("eclipse", "legal"), "(?:www )?eclipse org legal epl(?: v10| v20| 2 0)?(?: html)?"),
    ("bsd", ADDRESS, ("opensource", "bsd"), f"opensource org {L}s? bsd (?:2 clause|3 clause|{L})(?: php)?"),
    ("boost", ADDRESS, ("boost", "txt"), "(?:www )?boost org license 1 0 txt"),
    ("unlicense", ADDRESS, ("unlicense", "org"), "unlicense org"),
    ("cc-by", ADDRESS, ("creativecommons",), "creativecommons org licenses by [1234] [05]"),
    ("cc-by-sa", ADDRESS, ("creativecommons",), "creativecommons org licenses by sa [1234] [05]"),
    ("cc-by-nc", ADDRESS, ("creativecommons",), "creativecommons org licenses by nc [1234] [05]"),
    ("cc-by-nd", ADDRESS, ("creativecommons",), "creativecommons org licenses by nd [1234] [05]"),
    ("cc-by-nc-sa", ADDRESS, ("creativecommons",), "creativecommons org licenses by nc sa [1234] [05]"),
    ("cc-by-nc-nd", ADDRESS, ("creativecommons",), "creativecommons org licenses by nc nd [1234] [05]"),
    ("cc0", ADDRESS, ("creativecommons", "publicdomain"), "creativecommons org publicdomain zero 1 0"),
    ("mit", NOTICE, ("mit", "under"), UNDER + "mit"),
    ("public-domain", NOTICE, ("public", "domain"), "(?:released|placed|dedicated|donated) (?:in|into|to) the public domain"),
    ("public-domain", HINT, ("public", "domain"), "public domain"),
    ("proprietary", NOTICE, ("confidential", "proprietary"), "confidential and proprietary|proprietary and confidential"),
    ("proprietary", NOTICE, ("strictly", "prohibited"), "unauthorized (?:copying|use|distribution|reproduction) (?:w ){0,12}?is strictly prohibited"),
    ("all-rights-reserved", HINT, ("rights", "reserved"), "all rights reserved"),
    ("unknown-license", HINT, ("eula",), "end user licen[cs]e agreement eula|eula"),
    ("unknown-license", HINT, ("license", "file"), "see the license file|see license file|license file for (?:details|more)"),
)


#: Families whose name says enough without the word license.
BARE = ("unlicense", "wtfpl", "cc0", "perl", "commons-clause")


def _family_rules() -> list[Rule]:
    """Rules of all families: notices with and without a version, tags, names with and without a version, mentions of a bare name."""
    out = []
    for label, keyword, name, versions, tags in FAMILIES:
        core = (keyword, "license|licence") if name.endswith(L) else (keyword,)
        for version in sorted(versions, key=len, reverse=True):
            numbered = f"{name} (?:version |v |v)?{version}(?: (?:only|or later|or newer|{L}))?"
            exact = f"{label}-{version.replace(' ', '.')}"
            out.append(Rule(exact, NOTICE, (*core, "under"), UNDER + numbered))
            out.append(Rule(exact, NAME, core, numbered))
            out += [Rule(exact, TAG, ("spdx", tag.split(" ")[0]), f"spdx license identifier {tag} {version}(?: only| or later)?") for tag in tags]
        out.append(Rule(label, NOTICE, (*core, "under"), UNDER + name))
        out += [Rule(label, TAG, ("spdx", tag.split(" ")[0]), f"spdx license identifier {tag}") for tag in tags]
        if L in name or label in BARE:
            out.append(Rule(label, NAME, core, name))
    return out


#: In their order: of equal detections with one priority the first rule's stays.
RULES: tuple[Rule, ...] = (*[Rule(*x) for x in SINGLE], *_family_rules())


def spaced(pattern: str) -> str:
    """A rule's pattern for texts whose words stand between two spaces each: every space becomes two, `w` a word."""
    return f" (?:{re.sub(r'\bw\b', '[^ ]+', pattern.replace(' ', '  '))}) "


def plain(phrase: str) -> str:
    """A phrase as it stands in such a text."""
    return f" {phrase.replace(' ', '  ')} "


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, with an empty string before and behind them."""
    text = F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" "))
    # what lower does to other letters neither makes nor breaks words in a-z, but for these two
    odd = F.contains(text, F.lit("\u212a")) | F.contains(text, F.lit("\u0130"))
    return F.split(F.when(odd, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text)), BETWEEN)


def spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def prepared(docs: DataFrame, rules: tuple[Rule, ...], base) -> DataFrame:
    """A row for every row of docs: what the base phrases give, and hits (rule, label, priority, before, inside): words before and in each match."""
    norm = F.col("norm")
    keywords = {x for r in rules for k in r.keywords for x in k.split("|")} | {phrase.split(" ")[0] for phrase, _ in base}
    rows = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    rows = rows.select("doc_id", (F.size("words") - 2).cast("long").alias("n_words"), F.array_intersect("words", F.from_json(F.lit(json.dumps(sorted(keywords))), "array<string>")).alias("here"), "words")
    gate = F.lit(True) if any(not r.keywords for r in rules) else F.size("here") > 0
    rows = rows.withColumn("norm", F.when(gate, F.array_join("words", "  "))).drop("words")
    n_base, first, last, labels = F.lit(0).cast("long"), [], [], []
    for k, (phrase, label) in enumerate(base):
        part = F.split(norm, plain(phrase), -1)
        n, length = F.size(part) - 1, len(phrase.split(" "))
        found = F.struct(n.cast("long").alias("n"), F.floor(spaces(F.get(part, 0)) / 2).alias("first"), (F.col("n_words") - F.floor(spaces(F.element_at(part, -1)) / 2) - length).alias("last"))
        name = f"base_{k}"
        # few texts have the words side by side; only these are split
        rows = rows.withColumn(name, F.when(F.contains(norm, F.lit(plain(phrase))), found))
        n_base = n_base + F.coalesce(F.col(f"{name}.n"), F.lit(0))
        first.append(F.col(f"{name}.first"))
        last.append(F.col(f"{name}.last"))
        labels.append(F.when(F.col(name).isNotNull(), F.lit(label)))
    names = F.array_sort(F.array_distinct(F.array_compact(F.array(*labels))))
    # one constant; a column of thousands of literals would take longer to plan than to run
    listed = json.dumps([{"rule": k, "label": r.label, "priority": r.priority, "keywords": [k.split("|") for k in r.keywords], "pattern": spaced(r.pattern)} for k, r in enumerate(rules)])
    tried = F.filter(F.from_json(F.lit(listed), RULE_SCHEMA), lambda r: F.forall(r["keywords"], lambda k: F.arrays_overlap(k, F.col("here"))))

    def found_by(rule: Column) -> Column:
        gaps = F.transform(F.split(norm, rule["pattern"], -1), spaces)
        inside = F.transform(F.regexp_extract_all(norm, rule["pattern"], F.lit(0)), spaces)
        return F.struct(rule["rule"].alias("rule"), rule["label"].alias("label"), rule["priority"].alias("priority"), gaps.alias("before"), inside.alias("inside"))

    hits = F.when(gate, F.filter(F.transform(tried, found_by), lambda h: F.size(h["inside"]) > 0))
    return rows.select("doc_id", "n_words", n_base.alias("n_base"), F.array_min(F.array(*first)).alias("first_word"), F.array_max(F.array(*last)).alias("last_word"), names.alias("base"), hits.alias("hits"))


def detections(hits: DataFrame) -> DataFrame:
    """row, rule, label, priority, start, end (in words) of every match; hits has row and hits."""
    each = hits.select("row", F.explode("hits").alias("h")).select("row", "h.rule", "h.label", "h.priority", F.explode(F.arrays_zip(F.slice("h.before", F.lit(1), F.size("h.inside")).alias("before"), F.col("h.inside").alias("inside"), F.sequence(F.lit(1), F.size("h.inside")).alias("nth"))).alias("m"))
    upto = Window.partitionBy("row", "rule").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    flat = each.select("row", "rule", "label", "priority", "m.nth", "m.before", "m.inside").repartition("row")
    run = flat.withColumn("upto", F.sum(F.col("before") + F.col("inside")).over(upto))
    return run.select("row", "rule", "label", "priority", F.floor((F.col("upto") - F.col("inside")) / 2).alias("start"), F.floor(F.col("upto") / 2).alias("end"))


def unsuppressed(found: DataFrame) -> DataFrame:
    """The detections that do not lie within one of a higher priority, or within a longer or earlier listed one of the same."""
    order = [F.asc("start"), F.desc("end"), F.desc("priority"), F.asc("rule")]
    ahead = Window.partitionBy("row").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # whatever comes before in this order starts no later; one that reaches as far contains the row's interval
    covered = F.lit(False)
    for level in sorted(CONFIDENCE):
        reach = F.max(F.when(F.col("priority") == level, F.col("end"))).over(ahead)
        covered = covered | F.coalesce((F.col("priority") <= level) & (reach >= F.col("end")), F.lit(False))
    return found.withColumn("covered", covered).filter("not covered").drop("covered")


def scan_licenses(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base=BASE, space: Workspace | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections for every row of docs.

    labels: those of the base phrases and of the detections that stay. score: 1 minus the product over the labels' best detections
    of what their kind leaves open.
    """
    space = space or Workspace(docs.sparkSession, "licenses")
    rows = space.save(prepared(docs, rules, base).withColumn("row", F.monotonically_increasing_id()), "texts")
    kept = unsuppressed(detections(rows.filter("size(hits) > 0").select("row", "hits")))
    per_label = kept.groupBy("row", "label").agg(F.max("priority").alias("priority"), F.count("*").alias("n"))
    surely = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])
    per_row = per_label.groupBy("row").agg(F.array_sort(F.collect_set("label")).alias("own"), F.collect_list(F.element_at(surely, F.col("priority"))).alias("sure"), F.sum("n").alias("n_detections"))
    joined = rows.drop("hits").join(per_row, "row", "left")
    names = F.array_sort(F.array_union("base", F.coalesce("own", F.array().cast("array<string>"))))
    score = F.round(1 - F.aggregate(F.array_sort("sure"), F.lit(1.0), lambda acc, x: acc * (1 - x)), 6)
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(names, ",").alias("labels"), F.coalesce(score, F.lit(0.0)).alias("score"), F.coalesce("n_detections", F.lit(0)).cast("long").alias("n_detections"),
    )
