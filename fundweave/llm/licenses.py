"""License recognition by sentence rules, in DataFrame operations only.

A text is cut into sentences, each is normalised (lower case, runs of anything but a-z and 0-9 become
one space) and mapped to the identifier of a known licence sentence. A sentence that was wrapped over
lines is looked up whole and line by line. The identifiers in text order are matched against ordered
rules, longest first; what a rule matches is taken out before the next rule is tried. Sentences that
are not known between two known ones do not part a sequence.

Null and empty texts have no licence: n_sentences 0 and empty strings. Each row is judged alone, so
repeated rows and ids, null ids and ties need no order. The cost is linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: identifier -> normalised sentence.
SENTENCES = {
    "apache-short": "licensed under the apache license version 2 0",
    "apache-1": "licensed under the apache license version 2 0 the license",
    "apache-2": "you may not use this file except in compliance with the license",
    "apache-3": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-4": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-5": "see the license for the specific language governing permissions and limitations under the license",
    "mit-short": "released under the mit license",
    "mit-under": "licensed under the mit license",
    "mit-head": "mit license",
    "mit-1": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-2": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-3": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc-1": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-head": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-1": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-2": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-3": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl3-short": "this work is licensed under the gnu general public license version 3",
    "gpl3-under": "licensed under the gnu general public license version 3",
    "gpl-1": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-1": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-2": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "mpl-1": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "ccby-short": "licensed under cc by 4 0",
    "ccbysa-short": "licensed under cc by sa 4 0",
    "ccbync-short": "licensed under cc by nc 4 0",
    "ccby-1": "this work is licensed under a creative commons attribution 4 0 international license",
    "ccbysa-1": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc0-1": "this work is dedicated to the public domain",
    "reserved": "all rights reserved",
    "spdx-mit": "spdx license identifier mit",
    "spdx-apache": "spdx license identifier apache 2 0",
    "spdx-gpl3": "spdx license identifier gpl 3 0 or later",
    "spdx-bsd3": "spdx license identifier bsd 3 clause",
    "lgpl-1": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "agpl-1": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "unlicense-1": "this is free and unencumbered software released into the public domain",
    "zlib-1": "this software is provided as is without any express or implied warranty",
    "zlib-2": "in no event will the authors be held liable for any damages arising from the use of this software",
    "epl-1": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "bsl-1": "distributed under the boost software license version 1 0",
    "spdx-isc": "spdx license identifier isc",
    "spdx-mpl-2-0": "spdx license identifier mpl 2 0",
    "spdx-lgpl-2-1-or-later": "spdx license identifier lgpl 2 1 or later",
    "spdx-agpl-3-0-or-later": "spdx license identifier agpl 3 0 or later",
    "spdx-gpl-2-0-only": "spdx license identifier gpl 2 0 only",
    "spdx-gpl-2-0-or-later": "spdx license identifier gpl 2 0 or later",
    "spdx-gpl-3-0-only": "spdx license identifier gpl 3 0 only",
    "spdx-bsd-2-clause": "spdx license identifier bsd 2 clause",
    "spdx-unlicense": "spdx license identifier unlicense",
    "spdx-zlib": "spdx license identifier zlib",
    "spdx-bsl-1-0": "spdx license identifier bsl 1 0",
    "spdx-epl-2-0": "spdx license identifier epl 2 0",
    "spdx-cc0-1-0": "spdx license identifier cc0 1 0",
    "spdx-cc-by-4-0": "spdx license identifier cc by 4 0",
}
#: What stands before the cut that the usual punctuation or layout makes inside a known sentence.
HEADS = (
    "spdx license identifier",
    "this program is free software",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    "this library is free software",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "this program is distributed in the hope that it will be useful but without any warranty",
    "this source code form is subject to the terms of the mozilla public license v",
    "you may obtain a copy of the license at",
)
#: (licence, identifiers in order).
RULES = (
    ("Apache-2.0", ("apache-1", "apache-2", "apache-3", "apache-4", "apache-5")),
    ("BSD-3-Clause", ("bsd-head", "bsd-1", "bsd-2", "bsd-3")),
    ("MIT", ("mit-head", "mit-1", "mit-2", "mit-3")),
    ("MIT", ("mit-1", "mit-2", "mit-3")),
    ("BSD-2-Clause", ("bsd-head", "bsd-1", "bsd-2")),
    ("Apache-2.0", ("apache-1", "apache-2")),
    ("ISC", ("isc-1", "mit-3")),
    ("MIT", ("mit-1", "mit-2")),
    ("GPL-3.0-or-later", ("gpl-1", "gpl-2")),
    ("GPL-2.0-or-later", ("gpl2-1", "gpl-2")),
    ("Apache-2.0", ("apache-short",)),
    ("MIT", ("mit-short",)),
    ("MIT", ("mit-under",)),
    ("ISC", ("isc-1",)),
    ("GPL-3.0-only", ("gpl3-short",)),
    ("GPL-3.0-only", ("gpl3-under",)),
    ("GPL-3.0-or-later", ("gpl-1",)),
    ("GPL-2.0-or-later", ("gpl2-1",)),
    ("MPL-2.0", ("mpl-1",)),
    ("CC-BY-4.0", ("ccby-short",)),
    ("CC-BY-SA-4.0", ("ccbysa-short",)),
    ("CC-BY-NC-4.0", ("ccbync-short",)),
    ("CC-BY-4.0", ("ccby-1",)),
    ("CC-BY-SA-4.0", ("ccbysa-1",)),
    ("CC0-1.0", ("cc0-1",)),
    ("MIT", ("spdx-mit",)),
    ("Apache-2.0", ("spdx-apache",)),
    ("GPL-3.0-or-later", ("spdx-gpl3",)),
    ("BSD-3-Clause", ("spdx-bsd3",)),
    ("LGPL-2.1-or-later", ("lgpl-1",)),
    ("AGPL-3.0-or-later", ("agpl-1",)),
    ("Zlib", ("zlib-1", "zlib-2")),
    ("Unlicense", ("unlicense-1",)),
    ("EPL-2.0", ("epl-1",)),
    ("BSL-1.0", ("bsl-1",)),
    ("ISC", ("spdx-isc",)),
    ("MPL-2.0", ("spdx-mpl-2-0",)),
    ("LGPL-2.1-or-later", ("spdx-lgpl-2-1-or-later",)),
    ("AGPL-3.0-or-later", ("spdx-agpl-3-0-or-later",)),
    ("GPL-2.0-only", ("spdx-gpl-2-0-only",)),
    ("GPL-2.0-or-later", ("spdx-gpl-2-0-or-later",)),
    ("GPL-3.0-only", ("spdx-gpl-3-0-only",)),
    ("BSD-2-Clause", ("spdx-bsd-2-clause",)),
    ("Unlicense", ("spdx-unlicense",)),
    ("Zlib", ("spdx-zlib",)),
    ("BSL-1.0", ("spdx-bsl-1-0",)),
    ("EPL-2.0", ("spdx-epl-2-0",)),
    ("CC0-1.0", ("spdx-cc0-1-0",)),
    ("CC-BY-4.0", ("spdx-cc-by-4-0",)),
    ("All-Rights-Reserved", ("reserved",)),
)
RESTRICTED = ("CC-BY-NC-4.0", "All-Rights-Reserved", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "AGPL-3.0-or-later")
CUT = r"(?<=[.!?;:])\s+|\n\s*\n"


def _norm(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))


def recognise(text: Column) -> tuple[Column, Column]:
    """Identifiers of the known sentences in text order, and the licences of the rules that match, by rule."""
    known = F.create_map(*(F.lit(x) for k, v in SENTENCES.items() for x in (v, k)))
    heads = F.array(*map(F.lit, HEADS))
    units = F.transform(F.split(text, CUT), lambda u: F.when(F.contains(u, F.lit("\n")), F.concat(F.array(_norm(u)), F.transform(F.split(u, "\n"), _norm))).otherwise(F.array(_norm(u))))
    none = F.array().cast("array<string>")

    def step(a: Column, u: Column) -> Column:
        """ids so far; open: the heads that end with this unit. An open head goes on with the unit or its first line."""
        made = F.array_distinct(F.flatten(F.transform(a["open"], lambda h: F.transform(F.slice(u, 1, 2), lambda t: F.concat(h, F.lit(" "), t)))))
        ids = F.array_compact(F.transform(F.concat(made, u), lambda s: F.get(F.array(F.try_element_at(known, s)), F.lit(0))))
        ends = F.concat(F.array(F.get(u, F.lit(0)), F.element_at(u, -1)), F.transform(a["open"], lambda h: F.concat(h, F.lit(" "), F.get(u, F.lit(0)))))
        return F.struct(F.concat(a["ids"], ids).alias("ids"), F.array_intersect(heads, ends).alias("open"))

    ids = F.aggregate(units, F.struct(none.alias("ids"), none.alias("open")), step, lambda a: a["ids"])
    return ids, rules_of(ids)


def rules_of(ids: Column) -> Column:
    rules = F.array(*(F.struct(F.lit(f" {' '.join(seq)} ").alias("seq"), F.lit(name).alias("name")) for name, seq in RULES))
    start = F.struct(F.concat(F.lit(" "), F.array_join(ids, " "), F.lit(" ")).alias("s"), F.array().cast("array<string>").alias("names"))
    step = lambda a, r: F.when(F.contains(a["s"], r["seq"]), F.struct(F.replace(a["s"], r["seq"], F.lit(" | ")).alias("s"), F.array_append(a["names"], r["name"]).alias("names"))).otherwise(a)
    return F.when(F.size(ids) > 0, F.array_distinct(F.aggregate(rules, start, step, lambda a: a["names"]))).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentences (identifiers in order) and licenses of every row."""
    ids = docs.select("doc_id", recognise(F.coalesce("text", F.lit("")))[0].alias("sentences"))
    return ids.select("doc_id", "sentences", rules_of(F.col("sentences")).alias("licenses"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", F.size("sentences").cast("long").alias("n_sentences"), F.array_join("sentences", ",").alias("sentences"), F.array_join("licenses", ",").alias("licenses"),
        F.exists("licenses", lambda x: x.isin(*RESTRICTED)).alias("restricted"),
    )


def sql() -> str:
    """The same rule: units, their lines, and heads that an earlier unit left open (a head that goes on to a longer head included)."""
    known = ", ".join(f"('{v}', '{k}')" for k, v in SENTENCES.items())
    steps, hits = [], []
    for k, (name, seq) in enumerate(RULES):
        before, want = ("s" if k == 0 else f"s{k - 1}"), f"' {' '.join(seq)} '"
        steps.append(f"replace({before}, {want}, ' | ') AS s{k}")
        hits.append(f"CASE WHEN contains({before}, {want}) THEN '{name}' END")
    restricted = ", ".join(f"'{r}'" for r in RESTRICTED)
    heads = "[" + ", ".join(f"'{h}'" for h in HEADS) + "]"
    nested = max(sum(h.startswith(g) for g in HEADS) for h in HEADS)  # units that a head is made of
    opened = "list_filter({heads}, lambda h: list_contains(list_transform(coalesce({before}, []), lambda g: g || ' ' || us[1]), h)) AS o{k}"
    opens = [f"e{k} AS (SELECT *, {opened.format(heads=heads, before=f'x{k}', k=k)} FROM (SELECT *, lag(o{k - 1}) OVER (PARTITION BY doc_id ORDER BY p) AS x{k} FROM e{k - 1}))" for k in range(2, nested + 1)]
    is_open = " OR ".join(f"list_contains(o{k}, h)" for k in range(1, nested + 1))
    norm = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
    return rf"""
WITH known(sentence, id) AS (VALUES {known}),
u AS (SELECT doc_id, p, unit FROM (SELECT doc_id, unnest(cut) AS unit, generate_subscripts(cut, 1) AS p FROM (SELECT doc_id, string_split_regex(regexp_replace(text, '([.!?;:])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n\s*\n') AS cut FROM documents WHERE text IS NOT NULL))),
v AS (SELECT doc_id, p, CASE WHEN contains(unit, chr(10)) THEN list_prepend({norm('unit')}, list_transform(string_split(unit, chr(10)), lambda l: {norm('l')})) ELSE [{norm('unit')}] END AS us FROM u),
e1 AS (SELECT *, list_filter({heads}, lambda h: h = us[1] OR h = us[-1]) AS o1 FROM v),
{', '.join(opens)},
o AS (SELECT doc_id, p, us, coalesce(lag(list_filter({heads}, lambda h: {is_open})) OVER (PARTITION BY doc_id ORDER BY p), []) AS open FROM e{nested}),
m AS (SELECT doc_id, p, us, flatten(list_transform(open, lambda h: list_transform(us[1:2], lambda t: h || ' ' || t))) AS made FROM o),
a AS (SELECT doc_id, p, list_concat(list_filter(made, lambda x, i: list_position(made, x) = i), us) AS every FROM m),
c AS (SELECT doc_id, p, unnest(every) AS s, generate_subscripts(every, 1) AS i FROM a),
h AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY p, i) AS ids FROM c JOIN known ON c.s = known.sentence GROUP BY doc_id),
r AS (SELECT doc_id, coalesce(n, 0) AS n, coalesce(ids, '') AS ids, ' ' || replace(coalesce(ids, ''), ',', ' ') || ' ' AS s FROM documents LEFT JOIN h USING (doc_id)),
q AS (SELECT *, {', '.join(steps)} FROM r),
z AS (SELECT *, list_filter([{', '.join(hits)}], lambda x: x IS NOT NULL) AS names FROM q),
y AS (SELECT *, list_filter(names, lambda x, i: list_position(names, x) = i) AS licenses FROM z)
SELECT doc_id, CAST(n AS BIGINT) AS n_sentences, ids AS sentences, array_to_string(licenses, ',') AS licenses, list_has_any(licenses, [{restricted}]) AS restricted FROM y
"""
