"""Operator 5, licence scans by sentence rules, in DataFrame operations.

Sentences are normalised and mapped to identifiers of known licence sentences; the
identifiers of a document, in order, are matched against rules, each an ordered
sequence of sentences that names a licence.
"""

from __future__ import annotations

from functools import reduce
from itertools import chain
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence sentences, normalised (lower case, runs of other characters than letters and digits as one space).
SENTENCES: dict[str, str] = {
    "mit-name": "the mit license",
    "mit-notice": "released under the mit license",
    "mit-notice-2": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-warranty": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-notice-2": "licensed under the apache license version 2 0 the license",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-details": "see the gnu general public license for more details",
    "mpl2-terms": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-nc-4": "licensed under cc by nc 4 0",
    "cc-by-4": "licensed under cc by 4 0",
    "cc-by-sa-4": "licensed under cc by sa 4 0",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "reserved": "all rights reserved",
    "mit0-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "bsd4-advert": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "zlib-warranty": "this software is provided as is without any express or implied warranty",
    "zlib-liability": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "bsl-notice": "distributed under the boost software license version 1 0",
    "bsl-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "postgresql-grant": "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    "ncsa-title": "university of illinois ncsa open source license",
    "mspl-title": "microsoft public license ms pl",
    "afl3-notice": "licensed under the academic free license version 3 0",
    "osl3-notice": "licensed under the open software license version 3 0",
    "artistic2-title": "the artistic license 2 0",
    "apache-title": "apache license version 2 0 january 2004",
    "gpl3-title": "gnu general public license version 3 29 june 2007",
    "gpl2-title": "gnu general public license version 2 june 1991",
    "gpl2-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gpl3-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation",
    "lgpl3-title": "gnu lesser general public license version 3 29 june 2007",
    "lgpl21-title": "gnu lesser general public license version 2 1 february 1999",
    "lgpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl21-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "agpl3-title": "gnu affero general public license version 3 19 november 2007",
    "agpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "mpl2-copy-2": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "epl2-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "epl1-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html",
    "cddl-terms": "the contents of this file are subject to the terms of the common development and distribution license the license",
    "eupl-notice": "licensed under the eupl version 1 2 or as soon they will be approved by the european commission subsequent versions of the eupl the licence",
    "ofl-notice": "this font software is licensed under the sil open font license version 1 1",
    "cc0-title": "cc0 1 0 universal",
    "cc0-deed": "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law including all related and neighboring rights to the extent allowed by law",
    "unlicense-use": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "wtfpl-title": "do what the fuck you want to public license",
}

#: Rules in order of rank: licence, class of its duties, sentences that follow one another among a document's known sentences.
RULES: list[tuple[str, str, tuple[str, ...]]] = [
    ("MIT", "permissive", ("mit-grant", "mit-condition", "mit-warranty")),
    ("MIT", "permissive", ("mit-notice",)),
    ("MIT", "permissive", ("mit-notice-2",)),
    ("ISC", "permissive", ("isc-grant", "isc-warranty")),
    ("BSD-3-Clause", "permissive", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "bsd-warranty")),
    ("BSD-2-Clause", "permissive", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty")),
    ("Apache-2.0", "permissive", ("apache-notice-2", "apache-use")),
    ("Apache-2.0", "permissive", ("apache-notice",)),
    ("GPL-3.0", "copyleft", ("gpl3-free", "gpl-hope")),
    ("GPL-3.0", "copyleft", ("gpl3-notice",)),
    ("GPL-2.0", "copyleft", ("gpl2-free", "gpl-hope")),
    ("MPL-2.0", "copyleft", ("mpl2-terms",)),
    ("CC-BY-4.0", "permissive", ("cc-by-4",)),
    ("CC-BY-SA-4.0", "copyleft", ("cc-by-sa-4",)),
    ("CC-BY-NC-4.0", "restricted", ("cc-by-nc-4",)),
    ("CC0-1.0", "public domain", ("cc0",)),
    ("Unlicense", "public domain", ("unlicense-free",)),
    ("MIT-0", "permissive", ("mit0-grant", "mit-warranty")),
    ("0BSD", "permissive", ("0bsd-grant", "isc-warranty")),
    ("BSD-4-Clause", "permissive", ("bsd-grant", "bsd-source", "bsd-binary", "bsd4-advert")),
    ("Zlib", "permissive", ("zlib-warranty", "zlib-liability", "zlib-grant")),
    ("BSL-1.0", "permissive", ("bsl-notice",)),
    ("BSL-1.0", "permissive", ("bsl-grant",)),
    ("PostgreSQL", "permissive", ("postgresql-grant",)),
    ("NCSA", "permissive", ("ncsa-title",)),
    ("MS-PL", "permissive", ("mspl-title",)),
    ("AFL-3.0", "permissive", ("afl3-notice",)),
    ("OSL-3.0", "copyleft", ("osl3-notice",)),
    ("Artistic-2.0", "permissive", ("artistic2-title",)),
    ("Apache-2.0", "permissive", ("apache-title",)),
    ("GPL-3.0", "copyleft", ("gpl3-title",)),
    ("GPL-3.0", "copyleft", ("gpl3-only",)),
    ("GPL-2.0", "copyleft", ("gpl2-title",)),
    ("GPL-2.0", "copyleft", ("gpl2-only",)),
    ("LGPL-3.0", "copyleft", ("lgpl3-title",)),
    ("LGPL-3.0", "copyleft", ("lgpl3-free", "gpl-hope")),
    ("LGPL-2.1", "copyleft", ("lgpl21-title",)),
    ("LGPL-2.1", "copyleft", ("lgpl21-free", "lgpl-hope")),
    ("AGPL-3.0", "copyleft", ("agpl3-title",)),
    ("AGPL-3.0", "copyleft", ("agpl3-free", "gpl-hope")),
    ("EPL-2.0", "copyleft", ("epl2-terms",)),
    ("EPL-1.0", "copyleft", ("epl1-terms",)),
    ("CDDL-1.0", "copyleft", ("cddl-terms",)),
    ("EUPL-1.2", "copyleft", ("eupl-notice",)),
    ("OFL-1.1", "copyleft", ("ofl-notice",)),
    ("CC0-1.0", "public domain", ("cc0-title",)),
    ("CC0-1.0", "public domain", ("cc0-deed",)),
    ("Unlicense", "public domain", ("unlicense-use",)),
    ("WTFPL", "permissive", ("wtfpl-title",)),
]

# The elements of the later Creative Commons licences, and the words of their notices.
CC_ELEMENTS = [("BY", "attribution", "permissive"), ("BY-SA", "attribution sharealike", "copyleft"), ("BY-ND", "attribution noderivatives", "restricted"), ("BY-NC", "attribution noncommercial", "restricted"), ("BY-NC-SA", "attribution noncommercial sharealike", "restricted"), ("BY-NC-ND", "attribution noncommercial noderivatives", "restricted")]


def _notices() -> None:
    """Notices that follow a form: Creative Commons' sentence and short notice, and the SPDX line of every licence."""
    for code, words, duty in CC_ELEMENTS:
        name = f"CC-{code}-4.0"
        SENTENCES[f"{name.lower()}-work"] = f"this work is licensed under a creative commons {words} 4 0 international license"
        RULES.append((name, duty, (f"{name.lower()}-work",)))
        if not any(rule[0] == name for rule in RULES[:-1]):
            SENTENCES[f"{name.lower()}-notice"] = f"licensed under {normal(name)}"
            RULES.append((name, duty, (f"{name.lower()}-notice",)))
    for name, duty in dict.fromkeys((name, duty) for name, duty, _ in RULES):
        forms = [name] + ([f"{name}-only", f"{name}-or-later"] if "GPL" in name else [])
        for i, form in enumerate(forms):
            SENTENCES[f"spdx-{form.lower()}"] = f"spdx license identifier {normal(form)}"
            RULES.append((name, duty, (f"spdx-{form.lower()}",)))


def normal(sentence: str) -> str:
    """Lower case, and runs of other characters than letters and digits as one space."""
    return " ".join("".join(c if c.isalnum() else " " for c in sentence.lower()).split())


def _cover() -> list[str]:
    """Few words, one of which each known sentence has: those that most of the sentences left have, long ones first."""
    left, out = [set(s.split()) for s in SENTENCES.values()], []
    while left:
        words = sorted(set().union(*left))
        out.append(max(words, key=lambda w: (sum(w in s for s in left) * (len(w) > 4), len(w))))
        left = [s for s in left if out[-1] not in s]
    return out


_notices()

#: A sentence ends at punctuation before white space, or at the end of a line.
END = r"[.!?;:]+[\s]+|[.!?;:]+$|[\r\n]+"
OTHER = r"[^\p{L}\p{N}]+"
#: Stands for a sentence's end in lowered text, which has no capital.
MARK = "Z"
#: A text with a known sentence has one of these words; others are not read at all.
WORDS = _cover()
#: Ends that may stand within a known sentence: those of its wrapped lines, and its own ("v. 2.0", "free software: you").
WITHIN = f"(?:{MARK} )*+"


def _known(text: Column) -> Column:
    """Identifiers of the known sentences that stand from one end to another, in order, longer ones first."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable((s, k) for k, s in SENTENCES.items())])
    sentences = "|".join(s.replace(" ", f" {WITHIN}") for s in sorted(SENTENCES.values(), key=len, reverse=True))
    marked = F.regexp_replace(F.concat(F.lit(f"{MARK} "), F.regexp_replace(F.lower(text), END, f" {MARK} "), F.lit(f" {MARK}")), OTHER, " ")
    found = F.regexp_extract_all(marked, F.lit(f"(?<={MARK} )(?:{sentences})(?= {MARK})"), F.lit(0))
    return F.transform(found, lambda s: F.element_at(table, F.regexp_replace(s, f" (?:{MARK} )+", " ")))


def scan_licences(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append `sentences` (known identifiers in order), `licences` and `duties` to the columns `keep` (default: all).

    Lines are sentences of their own, and a known sentence may go on over line ends and
    hold the ends that its licence's text has, so one reading finds all in the order of
    the text, at any width of lines. A rule holds where its
    sentences stand side by side in that sequence; licences come in order of the rules,
    once each. There is no shuffle and no Python on the executors. Null and empty texts
    have empty arrays; repeated rows stay; columns named as the appended ones are replaced.
    """
    kept = [x for x in (docs.columns if keep is None else keep) if x not in ("sentences", "licences", "duties")]
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<string>")
    likely = reduce(or_, (F.contains(F.lower(t), F.lit(w)) for w in WORDS))
    rows = docs.select(*kept, F.when(likely, _known(t)).otherwise(none).alias("sentences"))
    chain_ = F.concat(F.lit(","), F.array_join("sentences", ","), F.lit(","))
    matched = lambda what: F.array_distinct(F.filter(F.array(*[F.when(chain_.contains("," + ",".join(rule) + ","), F.lit(what(name, duty))) for name, duty, rule in RULES]), lambda x: x.isNotNull()))
    return rows.select(*kept, "sentences", matched(lambda name, _: name).alias("licences"), matched(lambda _, duty: duty).alias("duties"))


def licences_query(docs: DataFrame) -> DataFrame:
    """Known sentences, licences and duties of every row as joined lists; null and empty texts have none."""
    found = scan_licences(docs, keep=["doc_id"])
    joined = lambda c: F.array_join(c, ",").alias(c)
    return found.select("doc_id", F.size("sentences").cast("long").alias("n_sentences"), joined("sentences"), joined("licences"), joined("duties"))


def oracle_sql() -> str:
    """The query in DuckDB's SQL, whose patterns cannot look around: ends are marked twice, so that each of two neighbours has its own."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    table = "MAP {" + ", ".join(f"{quote(s)}: {quote(k)}" for k, s in SENTENCES.items()) + "}"
    within = f"(?:{MARK} )*"
    sentences = "|".join(s.replace(" ", f" {within}") for s in sorted(SENTENCES.values(), key=len, reverse=True))
    end = f"' {MARK} {MARK} '"
    marked = f"regexp_replace({end} || regexp_replace(lower(t), {quote(END)}, {end}, 'g') || {end}, {quote(OTHER)}, ' ', 'g')"
    found = f"regexp_extract_all({marked}, {quote(f' {MARK} ({sentences}) {MARK}')}, 1)"
    once = lambda what, names: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'contains(c, {quote(chr(44) + chr(44).join(r) + chr(44))})' for n, d, r in RULES if what(n, d) == x)} THEN {quote(x)} END" for x in names) + "], lambda x: x IS NOT NULL), ',')"
    licences = list(dict.fromkeys(n for n, _, _ in RULES))
    # Duties come in the order in which matching rules name them.
    first = "list_filter([" + ", ".join(f"CASE WHEN contains(c, {quote(',' + ','.join(r) + ',')}) THEN {quote(d)} END" for _, d, r in RULES) + "], lambda x: x IS NOT NULL)"
    ordered = "array_to_string(list_filter(list_transform(generate_series(1, len(d)), lambda i: CASE WHEN list_position(d, d[i]) = i THEN d[i] END), lambda x: x IS NOT NULL), ',')"
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (SELECT doc_id, CASE WHEN {" OR ".join(f"contains(lower(t), {quote(w)})" for w in WORDS)} THEN {found} ELSE [] END AS f, {table} AS known FROM texts),
listed AS (SELECT doc_id, list_transform(f, lambda x: element_at(known, regexp_replace(x, ' (?:{MARK} )+', ' ', 'g'))[1]) AS s FROM found),
chained AS (SELECT doc_id, s, ',' || array_to_string(s, ',') || ',' AS c FROM listed),
named AS (SELECT *, {first} AS d FROM chained)
SELECT doc_id, len(s)::BIGINT AS n_sentences, array_to_string(s, ',') AS sentences, {once(lambda n, _: n, licences)} AS licences, {ordered} AS duties FROM named
"""
