"""Licence scans by ordered signature rules.

A rule is a pattern over the words of a text, a keyword that the text must hold before the pattern is tried, a label,
a priority and a confidence. Detections are intervals of words. One that lies within an interval of a higher priority,
or of the same priority and larger, or equal to one of an earlier rule, is suppressed.

Patterns are written word by word: each item is a regular expression for one whole word, `~` before an item makes it
optional. Words are lower case and hold digits, letters a-z and all characters beyond ASCII, so that
`SPDX-License-Identifier: GPL-2.0-only` is `spdx license identifier gpl 2 0 only`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters that are lowered; those of other scripts stay as they are.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What separates words, in a text whose A-Z are not lowered yet.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Base phrases: their places are counted before any suppression.
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

#: Priorities: a licence's own words beat a tag, a tag beats an address, that beats a name, that beats a hint.
FULL, TAG, ADDRESS, NAME, HINT = 5, 4, 3, 2, 1
CONFIDENCE = {FULL: 1.0, TAG: 0.95, ADDRESS: 0.9, NAME: 0.8, HINT: 0.4}


@dataclass(frozen=True)
class Rule:
    number: int
    label: str
    priority: int
    keyword: str
    pattern: str

    @property
    def regex(self) -> str:
        """Over a text written as ` word:place ` for each word."""
        items = []
        for item in self.pattern.split(" "):
            one = rf" (?:{item.removeprefix('~')}):\d+ "
            items.append(f"(?:{one})?" if item[0] == "~" else one)
        return "".join(items)


# label | keyword | names, tags (without the leading `spdx license identifier`), addresses, own words.
# Within a cell alternatives are separated by `;`.
FAMILIES = """
mit | mit | mit licen[cs]e; expat licen[cs]e; mit licensed; licensed under ~the mit; released under ~the mit; mit x11 licen[cs]e | mit | opensource org licen[cs]es? mit; spdx org licenses mit; mit license org | permission is hereby granted free of charge to any person obtaining a copy; the above copyright notice and this permission notice shall be included
mit-0 | attribution | mit no attribution | mit 0 | spdx org licenses mit 0 |
apache-2.0 | apache | apache licen[cs]e ~version 2 ~0; apache software licen[cs]e ~version 2; licensed under ~the apache; asl 2 0; apache 2 0 licen[cs]e | apache 2 0 | apache org licenses license 2 0; opensource org licen[cs]es? apache 2 0 | licensed under the apache license version 2 0 the license; unless required by applicable law or agreed to in writing software
apache-1.1 | apache | apache software license version 1 1; apache licen[cs]e ~version 1 1 | apache 1 1 | apache org licenses license 1 1 | this product includes software developed by the apache software foundation
apache-1.0 | apache | apache licen[cs]e ~version 1 0 | apache 1 0 | apache org licenses license 1 0 |
gpl-1.0 | general | general public licen[cs]e ~version 1 ~0; gnu gpl v1 | gpl 1 0 ~only; gpl 1 0 or later | gnu org licenses old licenses gpl 1 0 |
gpl-2.0 | general | general public licen[cs]e ~as ~published ~by ~the ~free ~software ~foundation ~either version 2; gnu gpl v2; gplv2; general public licen[cs]e v2 | gpl 2 0 ~only; gpl 2 0 or later; gpl 2 0 with classpath exception 2 0 | gnu org licenses old licenses gpl 2 0; gnu org licenses gpl 2 0 | gnu general public license version 2 june 1991; either version 2 of the license or at your option any later version
gpl-3.0 | general | general public licen[cs]e ~as ~published ~by ~the ~free ~software ~foundation ~either version 3; gnu gpl v3; gplv3; general public licen[cs]e v3 | gpl 3 0 ~only; gpl 3 0 or later | gnu org licenses gpl 3 0 | gnu general public license version 3 29 june 2007; either version 3 of the license or at your option any later version
gpl | general | gnu general public licen[cs]e; gnu gpl; licensed under ~the gpl | gpl | gnu org licenses gpl; gnu org copyleft gpl | this program is free software you can redistribute it and or modify it under the terms of the gnu general
lgpl-2.0 | lesser | gnu library general public licen[cs]e ~version 2 ~0; library general public licen[cs]e | lgpl 2 0 ~only; lgpl 2 0 or later | gnu org licenses old licenses lgpl 2 0 |
lgpl-2.1 | lesser | lesser general public licen[cs]e ~version 2 1; lgplv2 ~1 | lgpl 2 1 ~only; lgpl 2 1 or later | gnu org licenses old licenses lgpl 2 1; gnu org licenses lgpl 2 1 | gnu lesser general public license version 2 1 february 1999
lgpl-3.0 | lesser | lesser general public licen[cs]e ~version 3 ~0; lgplv3 | lgpl 3 0 ~only; lgpl 3 0 or later | gnu org licenses lgpl 3 0 | gnu lesser general public license version 3 29 june 2007
lgpl | lesser | gnu lesser general public licen[cs]e; gnu lgpl | lgpl | gnu org licenses lgpl | this library is free software you can redistribute it and or modify it under the terms of the gnu lesser
agpl-3.0 | affero | affero general public licen[cs]e ~version 3 ~0; gnu agpl ~v3; agplv3 | agpl 3 0 ~only; agpl 3 0 or later | gnu org licenses agpl ~3 ~0 | gnu affero general public license version 3 19 november 2007
gfdl | documentation | gnu free documentation licen[cs]e ~version ~1 ~\\d; gnu fdl | gfdl 1 \\d ~only; gfdl 1 \\d or later | gnu org licenses fdl ~1 ~\\d; gnu org copyleft fdl | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation
bsd-2-clause | bsd | bsd 2 clause; simplified bsd ~licen[cs]e; two clause bsd; freebsd licen[cs]e | bsd 2 clause | opensource org licen[cs]es? bsd 2 clause |
bsd-3-clause | bsd | bsd 3 clause; new bsd licen[cs]e; modified bsd licen[cs]e; three clause bsd; revised bsd licen[cs]e | bsd 3 clause | opensource org licen[cs]es? bsd 3 clause | neither the name of .{1,40} nor the names of its contributors may be used to endorse
bsd-4-clause | bsd | bsd 4 clause; original bsd licen[cs]e; four clause bsd | bsd 4 clause | spdx org licenses bsd 4 clause | all advertising materials mentioning features or use of this software must display
bsd-0-clause | bsd | zero clause bsd; bsd zero clause; free public licen[cs]e 1 0 0 | 0bsd | opensource org licen[cs]es? 0bsd | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd | bsd | bsd licen[cs]e; bsd style licen[cs]e; berkeley software distribution licen[cs]e; licensed under ~the bsd | bsd | opensource org licen[cs]es? bsd license | redistributions of source code must retain the above copyright notice; redistributions in binary form must reproduce the above copyright notice
isc | isc | isc licen[cs]e; internet systems consortium licen[cs]e | isc | opensource org licen[cs]es? isc | permission to use copy modify and distribute this software for any purpose
mpl-1.1 | mozilla | mozilla public licen[cs]e ~version 1 1; mpl 1 1 | mpl 1 1 | mozilla org mpl mpl 1 1 | the contents of this file are subject to the mozilla public license version 1 1
mpl-2.0 | mozilla | mozilla public licen[cs]e ~version ~v 2 ~0; mpl 2 0 | mpl 2 0 ~no ~copyleft ~exception | mozilla org ~en ~us mpl 2 0 | this source code form is subject to the terms of the mozilla public license
mpl | mozilla | mozilla public licen[cs]e | mpl | mozilla org mpl |
epl-1.0 | eclipse | eclipse public licen[cs]e ~version ~v 1 ~0; epl 1 0 | epl 1 0 | eclipse org legal epl v10 | the accompanying program is provided under the terms of this eclipse public license
epl-2.0 | eclipse | eclipse public licen[cs]e ~version ~v 2 ~0; epl 2 0 | epl 2 0 | eclipse org legal epl 2 0 |
edl-1.0 | eclipse | eclipse distribution licen[cs]e ~version ~v 1 ~0 | | eclipse org org documents edl v10 |
cddl-1.0 | common | common development and distribution licen[cs]e ~version 1 0; cddl 1 0 | cddl 1 0 | opensource org licen[cs]es? cddl1 |
cddl-1.1 | common | common development and distribution licen[cs]e ~version 1 1; cddl 1 1 | cddl 1 1 | |
cpl-1.0 | common | common public licen[cs]e ~version ~v 1 ~0 | cpl 1 0 | opensource org licen[cs]es? cpl ~1 ~0 |
ipl-1.0 | ibm | ibm public licen[cs]e ~version ~1 ~0 | ipl 1 0 | opensource org licen[cs]es? ibmpl |
cc0-1.0 | cc0 | cc0 1 0 ~universal; cc0 licen[cs]e; dedicated under cc0 | cc0 1 0 | creativecommons org publicdomain zero 1 0 | the person who associated a work with this deed has dedicated the work to the public domain
cc-by-4.0 | commons | creative commons attribution 4 0; cc by 4 0 | cc by 4 0 | creativecommons org licenses by 4 0 |
cc-by-3.0 | commons | creative commons attribution 3 0; cc by 3 0 | cc by 3 0 | creativecommons org licenses by 3 0 |
cc-by-2.0 | commons | creative commons attribution 2 0; cc by 2 0 | cc by 2 0 | creativecommons org licenses by 2 0 |
cc-by-sa-4.0 | commons | creative commons attribution share ~alike 4 0; creative commons attribution sharealike 4 0; cc by sa 4 0 | cc by sa 4 0 | creativecommons org licenses by sa 4 0 |
cc-by-sa-3.0 | commons | creative commons attribution sharealike 3 0; cc by sa 3 0 | cc by sa 3 0 | creativecommons org licenses by sa 3 0 |
cc-by-nc-4.0 | commons | creative commons attribution noncommercial 4 0; cc by nc 4 0 | cc by nc 4 0 | creativecommons org licenses by nc 4 0 |
cc-by-nd-4.0 | commons | creative commons attribution noderiv[a-z]* 4 0; cc by nd 4 0 | cc by nd 4 0 | creativecommons org licenses by nd 4 0 |
cc-by-nc-sa-4.0 | commons | creative commons attribution noncommercial sharealike 4 0; cc by nc sa 4 0 | cc by nc sa 4 0 | creativecommons org licenses by nc sa 4 0 |
cc-by-nc-nd-4.0 | commons | creative commons attribution noncommercial noderiv[a-z]* 4 0; cc by nc nd 4 0 | cc by nc nd 4 0 | creativecommons org licenses by nc nd 4 0 |
cc | commons | creative commons licen[cs]e; creative commons attribution | | creativecommons org licenses |
unlicense | unlicense | the unlicense; unlicense licen[cs]e | unlicense | unlicense org | this is free and unencumbered software released into the public domain
public-domain | domain | public domain dedication; released into the public domain; placed in the public domain; in the public domain | | | 
zlib | zlib | zlib licen[cs]e; zlib libpng licen[cs]e | zlib | opensource org licen[cs]es? zlib; zlib net zlib license | this software is provided as is without any express or implied warranty in no event
libpng | libpng | libpng licen[cs]e; png reference library licen[cs]e | libpng ~2 ~0 | libpng org pub png src libpng license | this copy of the libpng notices is provided for your convenience
boost-1.0 | boost | boost software licen[cs]e ~version ~1 ~0; bsl 1 0 | bsl 1 0 | boost org license 1 0; boost org users license | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
wtfpl | want | do what the .{1,6} you want to public licen[cs]e; wtfpl | wtfpl | wtfpl net | everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed
artistic-1.0 | artistic | artistic licen[cs]e ~version 1 ~0; perl artistic licen[cs]e | artistic 1 0 ~perl | opensource org licen[cs]es? artistic license 1 0 |
artistic-2.0 | artistic | artistic licen[cs]e ~version 2 ~0 | artistic 2 0 | opensource org licen[cs]es? artistic license 2 0 | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
python-2.0 | python | python software foundation licen[cs]e; psf licen[cs]e ~agreement | psf 2 0; python 2 0 | python org psf license; docs python org license | this license agreement is between the python software foundation
ruby | ruby | ruby licen[cs]e; ruby s licen[cs]e | ruby | ruby lang org en about license |
php-3.01 | php | php licen[cs]e ~version ~3 ~01; php software licen[cs]e | php 3 01 | php net license 3 01 | this product includes php software freely available from
openssl | openssl | openssl licen[cs]e; openssl toolkit licen[cs]e | openssl | openssl org source license | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | ssleay | ssleay licen[cs]e; original ssleay licen[cs]e | | | this product includes cryptographic software written by eric young
w3c | w3c | w3c software ~notice ~and licen[cs]e; w3c software and document notice | w3c | w3 org consortium legal copyright software | 
x11 | x11 | x11 licen[cs]e; x consortium licen[cs]e | x11 | | except as contained in this notice the name of the x consortium shall not be used
xfree86 | xfree86 | xfree86 licen[cs]e ~version ~1 ~1 | xfree86 1 1 | xfree86 org legal licenses | this product includes software developed by the xfree86 project
ncsa | illinois | university of illinois ncsa open source licen[cs]e; ncsa open source licen[cs]e | ncsa | opensource org licen[cs]es? ncsa |
afl-3.0 | academic | academic free licen[cs]e ~version ~v 3 ~0 | afl 3 0 | opensource org licen[cs]es? afl 3 0 | licensed under the academic free license version 3 0
osl-3.0 | open | open software licen[cs]e ~version ~v 3 ~0 | osl 3 0 | opensource org licen[cs]es? osl 3 0 | licensed under the open software license version 3 0
eupl-1.1 | european | european union public licen[cs]e ~version ~v 1 1 | eupl 1 1 | | licensed under the eupl version 1 1
eupl-1.2 | european | european union public licen[cs]e ~version ~v 1 2 | eupl 1 2 | joinup ec europa eu software page eupl | licensed under the eupl version 1 2
cecill-2.1 | cecill | cecill licen[cs]e ~version ~2 ~1; cecill free software licen[cs]e agreement | cecill 2 1 | cecill info licences | this software is governed by the cecill license under french law
cecill-b | cecill | cecill b licen[cs]e | cecill b | cecill info licences licence cecill b |
ms-pl | microsoft | microsoft public licen[cs]e | ms pl | opensource org licen[cs]es? ms pl | 
ms-rl | microsoft | microsoft reciprocal licen[cs]e | ms rl | opensource org licen[cs]es? ms rl |
odbl-1.0 | database | open database licen[cs]e ~v ~1 ~0; odbl | odbl 1 0 | opendatacommons org licenses odbl | this database is made available under the open database license
odc-by-1.0 | commons | open data commons attribution licen[cs]e | odc by 1 0 | opendatacommons org licenses by |
pddl-1.0 | domain | public domain dedication and licen[cs]e | pddl 1 0 | opendatacommons org licenses pddl |
ofl-1.1 | font | sil open font licen[cs]e ~version ~1 ~1; open font licen[cs]e | ofl 1 1 | scripts sil org ofl; openfontlicense org | this font software is licensed under the sil open font license
bitstream-vera | vera | bitstream vera fonts? copyright; bitstream vera licen[cs]e | bitstream vera | | permission is hereby granted free of charge to any person obtaining a copy of the fonts accompanying this license
postgresql | postgresql | postgresql licen[cs]e | postgresql | postgresql org about licence; opensource org licen[cs]es? postgresql | in no event shall the university of california be liable
curl | curl | curl licen[cs]e | curl | curl se docs copyright |
icu | icu | icu licen[cs]e | icu | | 
unicode-dfs | unicode | unicode licen[cs]e ~agreement; unicode inc licen[cs]e agreement | unicode dfs 201[56]; unicode 3 0 | unicode org copyright; unicode org license | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
vim | vim | vim licen[cs]e | vim | | vim is charityware
sleepycat | sleepycat | sleepycat licen[cs]e; berkeley db licen[cs]e | sleepycat | opensource org licen[cs]es? sleepycat |
sspl-1.0 | server | server side public licen[cs]e ~version ~1; sspl ~v1 | sspl 1 0 | mongodb com licensing server side public license |
busl-1.1 | business | business source licen[cs]e ~version ~1 ~1 | busl 1 1 | mariadb com bsl11 | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use
elastic-2.0 | elastic | elastic licen[cs]e ~version ~2 ~0 | elastic 2 0 | elastic co licensing elastic license | 
commons-clause | clause | commons clause ~licen[cs]e ~condition | | commonsclause com | the license does not grant to you the right to sell the software
json | evil | json licen[cs]e | json | json org license | the software shall be used for good not evil
beerware | beerware | beer ware licen[cs]e; beerware licen[cs]e | beerware | | as long as you retain this notice you can do whatever you want with this stuff
upl-1.0 | universal | universal permissive licen[cs]e ~version ~v ~1 ~0 | upl 1 0 | opensource org licen[cs]es? upl | 
ecl-2.0 | educational | educational community licen[cs]e ~version ~2 ~0 | ecl 2 0 | opensource org licen[cs]es? ecl 2 0 |
qpl-1.0 | q | q public licen[cs]e ~version ~1 ~0; the q public licen[cs]e | qpl 1 0 | opensource org licen[cs]es? qtpl |
spl-1.0 | sun | sun public licen[cs]e ~version ~1 ~0 | spl 1 0 | | 
proprietary | rights | all rights reserved | | | this software is proprietary and confidential; unauthorized copying of this file via any medium is strictly prohibited
""".strip()  # noqa: E501

#: Signs of some licence, whatever its name.
HINTS = {
    "unknown-license": ["licen[cs]ed under", "licen[cs]e agreement", "terms of the licen[cs]e", "see the licen[cs]e", "open source licen[cs]e", "free software licen[cs]e", "spdx license identifier"],
    "copyright": ["copyright c ~\\d{4}", "copyright \\d{4}", "copyright holders?"],
    "warranty": ["without warranty of any kind", "provided as is without", "without any warranty"],
}


def _rules() -> list[Rule]:
    out: list[Rule] = []

    def add(label: str, priority: int, keyword: str, pattern: str) -> None:
        if pattern := pattern.strip():
            out.append(Rule(len(out), label, priority, keyword, pattern))

    for line in FAMILIES.splitlines():
        label, word, names, tags, addresses, own = (cell.strip() for cell in line.split("|"))
        for priority, cell, lead in ((FULL, own, ""), (TAG, tags, "spdx license identifier "), (ADDRESS, addresses, ""), (NAME, names, "")):
            for pattern in filter(None, map(str.strip, cell.split(";"))):
                add(label, priority, _keyword(lead + pattern), lead + pattern)
    for label, patterns in HINTS.items():
        for pattern in patterns:
            add(label, HINT, _keyword(pattern), pattern)
    return out


def _keyword(pattern: str) -> str:
    """What every match must hold: the longest run of plain words of the pattern."""
    runs, run = [], []
    for item in [*pattern.split(" "), "."]:
        if item.isalnum():
            run.append(item)
        else:
            runs.append(" ".join(run))
            run = []
    return max(runs, key=len)


RULES = _rules()
BASE_RULES = [Rule(-1, label, NAME, phrase, phrase) for label, phrase in BASE.items()]

#: The longest word of each keyword. A text without any of them is spared the rest.
ANCHORS = sorted({max(r.keyword.split(" "), key=len) for r in [*RULES, *BASE_RULES]})


def _table(rules: list[Rule]) -> Column:
    """The rules as an array of constants."""
    return F.array(
        *(
            F.struct(
                F.lit(max(r.keyword.split(" "), key=len)).alias("anchor"),
                F.lit(f" {r.keyword} ").alias("keyword"),
                F.lit(r.regex).alias("regex"),
                F.lit(r.number).alias("number"),
                F.lit(r.priority).alias("priority"),
                F.lit(r.label).alias("label"),
            )
            for r in rules
        )
    )


def _places(table: Column, anchors: Column, plain: Column, placed: Column) -> Column:
    """All detections of the rules whose keyword the text holds, as intervals of words."""
    tried = F.filter(table, lambda r: F.array_contains(anchors, r["anchor"]) & F.contains(plain, r["keyword"]))

    def one(r: Column) -> Column:
        return F.transform(
            F.regexp_extract_all(placed, r["regex"], F.lit(0)),
            lambda m: F.struct(
                F.regexp_extract(m, r":(\d+) ", 1).cast("long").alias("start"),
                F.regexp_extract(m, r":(\d+) $", 1).cast("long").alias("last"),
                r["number"].alias("number"),
                r["priority"].alias("priority"),
                r["label"].alias("label"),
            ),
        )

    return F.flatten(F.transform(tried, one))


def _survivors(found: Column) -> Column:
    """Labels and best priority of the detections that no other one suppresses.

    In order of start, then longer first, then priority, then rule, whatever can contain a detection comes before it;
    so the furthest end so far, kept for each priority and those above it, tells whether it lies within one.
    """
    ordered = F.sort_array(
        F.transform(
            found,
            lambda d: F.struct(
                d["start"].alias("start"), (-d["last"]).alias("minus_last"), (-d["priority"]).alias("minus_priority"),
                d["number"].alias("number"), d["label"].alias("label"),
            ),
        )
    )
    begin = F.struct(
        F.array_repeat(F.lit(-1).cast("long"), FULL + 1).alias("ends"),
        F.array().cast("array<string>").alias("labels"),
        F.lit(0).alias("best"),
    )

    def step(state: Column, d: Column) -> Column:
        last, priority = -d["minus_last"], -d["minus_priority"]
        free = F.element_at(state["ends"], priority + 1) < last
        return F.struct(
            F.transform(state["ends"], lambda e, p: F.when(p <= priority, F.greatest(e, last)).otherwise(e)).alias("ends"),
            F.when(free, F.array_union(state["labels"], F.array(d["label"]))).otherwise(state["labels"]).alias("labels"),
            F.when(free, F.greatest(state["best"], priority)).otherwise(state["best"]).alias("best"),
        )

    return F.aggregate(ordered, begin, step)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licences of each whole text: doc_id, n_words, n_base (places of a base phrase, all of them), first_word and
    last_word (smallest and largest start of such a place, else null), base_labels, labels (with those of surviving
    detections; distinct, sorted, comma-joined), score (confidence of the best surviving detection, 0 without one).

    A null or empty text has no words, no labels and score 0. Every row gets its own result, repeated ones too; other
    columns are ignored. All work stays within the row, so nothing is shuffled.
    """
    out = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    flat = F.trim(F.regexp_replace(F.translate("text", UPPER, UPPER.lower()), BREAK, " "))
    none = F.array().cast("array<string>")
    out = out.select("doc_id", F.when(flat == "", none).otherwise(F.split(flat, " ")).alias("words"))
    out = out.withColumn("anchors", F.array_intersect("words", F.array(*map(F.lit, ANCHORS))))
    candidate = F.size("anchors") > 0
    words = F.col("words")
    out = out.select(
        "doc_id",
        F.size(words).cast("long").alias("n_words"),
        "anchors",
        F.when(candidate, F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))).otherwise("").alias("plain"),
        F.when(candidate, F.array_join(F.transform(words, lambda w, i: F.concat(F.lit(" "), w, F.lit(":"), i.cast("string"), F.lit(" "))), "")).otherwise("").alias("placed"),
    )
    empty = F.array().cast("array<struct<start:bigint,last:bigint,number:int,priority:int,label:string>>")
    held = lambda rules: F.when(F.size("anchors") > 0, _places(_table(rules), F.col("anchors"), F.col("plain"), F.col("placed"))).otherwise(empty)
    out = out.select("doc_id", "n_words", held(BASE_RULES).alias("base"), held(RULES).alias("found"))
    out = out.withColumn("alive", F.when(F.size("found") > 0, _survivors(F.col("found"))))
    base_labels = F.transform("base", lambda d: d["label"])
    confidence = F.element_at(F.array(F.lit(0.0), *(F.lit(CONFIDENCE[p]) for p in sorted(CONFIDENCE))), F.coalesce(F.col("alive.best"), F.lit(0)) + 1)
    return out.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda d: d["start"])).alias("first_word"),
        F.array_max(F.transform("base", lambda d: d["start"])).alias("last_word"),
        F.array_join(F.sort_array(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base_labels, F.coalesce(F.col("alive.labels"), none))), ",").alias("labels"),
        F.greatest(confidence, F.when(F.size("base") > 0, F.lit(CONFIDENCE[NAME])).otherwise(F.lit(0.0))).alias("score"),
    )
