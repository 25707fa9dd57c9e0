"""License scans by sentence rules, with DataFrame functions alone.

A text is cut into sentences; a sentence is normalised (A-Z lower-cased, all but letters and digits blanked, the
"this work is licensed under the terms of the" of a grant shortened to "under") and looked up among known licence
sentences. The identifiers found form a sequence, against which ordered rules are matched: each rule names a licence
and the run of identifiers that shows it, and takes its runs out of the sequence before the next rule looks; what stood on either side of a taken run does not become adjacent. A
sentence may be wrapped over lines or share its line's neighbours' full stops, so one that is not known whole is tried line by line.

Everything is a projection of one row: no shuffle, no join, and texts without a licence word are not cut at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.common import col

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Every known sentence holds one of these.
HINT = "licen[sc]e|under|domain|permi|redistribut|copyright|warrant|liable|reserved"
GRANT = (
    "^((this|the) (work|file|software|project|program|code|source code|document|documentation|library|package|text|content|dataset|data) )?"
    "((is|are|has been|may be) )?(dual )?(licensed|licenced|released|distributed|available|provided|published|made available|used|shared) under (the )?(terms of )?(the )?"
)
_LICENSES = {
    "MIT": ("mit license", "mit licence", "mit x11 license", "expat license"),
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache license version 2", "apache 2 license"),
    "GPL-3.0": ("gnu general public license version 3", "gnu general public license v3", "gpl version 3", "gplv3", "gnu gpl v3", "gnu gpl version 3", "gnu general public license version 3 0"),
    "GPL-2.0": ("gnu general public license version 2", "gnu general public license v2", "gpl version 2", "gplv2", "gnu gpl v2", "gnu gpl version 2"),
    "LGPL-3.0": ("gnu lesser general public license version 3", "gnu lesser general public license v3", "lgplv3", "lgpl version 3"),
    "LGPL-2.1": ("gnu lesser general public license version 2 1", "gnu lesser general public license v2 1", "lgplv2 1", "lgpl version 2 1"),
    "AGPL-3.0": ("gnu affero general public license version 3", "gnu affero general public license v3", "agplv3"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v 2 0"),
    "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license"),
    "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license"),
    "ISC": ("isc license",),
    "EPL-2.0": ("eclipse public license 2 0", "eclipse public license version 2 0", "eclipse public license v 2 0"),
    "BSL-1.0": ("boost software license version 1 0", "boost software license 1 0"),
    "CC-BY-4.0": ("cc by 4 0", "creative commons attribution 4 0 international license", "cc by 4 0 license"),
    "CC-BY-SA-4.0": ("cc by sa 4 0", "creative commons attribution sharealike 4 0 international license", "cc by sa 4 0 license"),
    "CC-BY-NC-4.0": ("cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license", "cc by nc 4 0 license"),
    "CC-BY-ND-4.0": ("cc by nd 4 0", "creative commons attribution noderivatives 4 0 international license"),
    "CC-BY-NC-SA-4.0": ("cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0 international license"),
    "CC0-1.0": ("cc0 1 0", "cc0 1 0 universal license", "cc0 license"),
}
#: Normalised sentence -> identifier.
SENTENCES = {f"under {name}": f"{license}~" for license, names in _LICENSES.items() for name in names} | {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "as-is",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "no-liability",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "you may not use this file except in compliance with the license": "apache-comply",
    "you may obtain a copy of the license at": "apache-copy",
    "under apache license version 2 0 the license": "Apache-2.0~",
    "under apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-header",
    "the asf licenses this file to you under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-header",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-later",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-later",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "this work is in the public domain": "public-domain",
}
#: (licence, run of identifiers), the more telling first.
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "as-is", "no-liability")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-grant",)),
    ("ISC", ("isc-grant",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", ("gpl3-later", "gpl-warranty")),
    ("GPL-3.0-or-later", ("gpl3-later",)),
    ("GPL-2.0-or-later", ("gpl2-later", "gpl-warranty")),
    ("GPL-2.0-or-later", ("gpl2-later",)),
    ("Apache-2.0", ("Apache-2.0~", "apache-comply", "apache-copy")),
    ("Apache-2.0", ("apache-header", "apache-copy")),
    ("Apache-2.0", ("apache-header",)),
    ("Unlicense", ("unlicense",)),
    ("Public-Domain", ("public-domain",)),
    *((license, (f"{license}~",)) for license in _LICENSES),
)


def normalised(sentence: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.translate(sentence, _UPPER, _LOWER), "[^a-z0-9]+", " "))
    return F.regexp_replace(plain, GRANT, "under ")


def _lookup(known: dict[str, str]):
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return lambda s: F.try_element_at(table, s)


def sentence_ids(text: Column, known: dict[str, str] | None = None) -> Column:
    """The identifiers of the text's known sentences, in order."""
    find = _lookup(known or SENTENCES)
    sentences = F.split(F.regexp_replace(text, r"[.!?:]+([ \t\r\n]|\z)|\n[ \t\r]*\n", "\u0001"), "\u0001")

    def ids(sentence: Column) -> Column:
        whole = find(normalised(sentence))
        lines = F.array_compact(F.transform(F.split(sentence, "\n"), lambda line: find(normalised(line))))
        return F.when(~F.translate(sentence, _UPPER, _LOWER).rlike(HINT), F.array().cast("array<string>")).when(whole.isNotNull(), F.array(whole)).otherwise(lines)

    return F.flatten(F.transform(sentences, ids))


def licences(ids: Column, rules: tuple = RULES) -> Column:
    """The licences that ordered rules find in an identifier sequence, each once, in the rules' order."""
    ordered = F.array(*(F.struct(F.lit(name).alias("name"), F.lit("".join(f",{i}," for i in run)).alias("run")) for name, run in rules))
    start = F.struct(F.array_join(F.transform(ids, lambda i: F.concat(F.lit(","), i, F.lit(","))), "").alias("rest"), F.array().cast("array<string>").alias("found"))

    def look(state: Column, rule: Column) -> Column:
        hit = F.contains(state["rest"], rule["run"])
        return F.struct(
            F.when(hit, F.replace(state["rest"], rule["run"], F.lit("|"))).otherwise(state["rest"]).alias("rest"),
            F.when(hit, F.array_union(state["found"], F.array(rule["name"]))).otherwise(state["found"]).alias("found"),
        )

    return F.aggregate(ordered, start, look)["found"]


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: dict[str, str] | None = None, rules: tuple = RULES) -> DataFrame:
    """A row for each row of docs: id_col, sentence_ids (array), licenses (array; empty without one).

    Null, empty and licence-free texts have empty arrays. Null and repeated ids come back as they are; other columns are not read.
    known: a short map of normalised sentences (each must hold a HINT) to identifiers without commas.
    """
    text = col(text_col)
    hinted = F.translate(text, _UPPER, _LOWER).rlike(HINT)
    ids = F.when(hinted, sentence_ids(text, known)).otherwise(F.array().cast("array<string>"))
    found = docs.select(col(id_col), F.coalesce(ids, F.array().cast("array<string>")).alias("sentence_ids"))
    return found.withColumn("licenses", licences(F.col("sentence_ids"), rules))
