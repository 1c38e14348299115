"""Licence notices in texts: sentences to identifiers, identifier sequences to licences. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: sentences of public licence texts and notices, normalised (lower case, other signs as one space)
SENTENCES = {
    "mit_released": "released under the mit license",
    "mit_licensed": "licensed under the mit license",
    "mit_project": "this project is licensed under the mit license",
    "mit_spdx": "spdx license identifier mit",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit_as_is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache_short": "licensed under the apache license version 2.0",
    "apache_header": "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license",
    "apache_copy": "you may obtain a copy of the license at http www.apache.org licenses license 2.0",
    "apache_basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache_spdx": "spdx license identifier apache 2.0",
    "gpl3_work": "this work is licensed under the gnu general public license version 3",
    "gpl3_short": "licensed under the gnu general public license version 3",
    "gpl_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl_hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl3_spdx": "spdx license identifier gpl 3.0 only",
    "gpl3_later_spdx": "spdx license identifier gpl 3.0 or later",
    "bsd_redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd3_spdx": "spdx license identifier bsd 3 clause",
    "bsd2_spdx": "spdx license identifier bsd 2 clause",
    "cc_by": "licensed under cc by 4.0",
    "cc_by_sa": "licensed under cc by sa 4.0",
    "cc_by_nc": "licensed under cc by nc 4.0",
    "cc_by_nd": "licensed under cc by nd 4.0",
    "cc_by_full": "this work is licensed under a creative commons attribution 4.0 international license",
    "cc_by_nc_full": "this work is licensed under a creative commons attribution noncommercial 4.0 international license",
    "cc_by_sa_full": "this work is licensed under a creative commons attribution sharealike 4.0 international license",
    "cc0": "this work has been dedicated to the public domain under cc0 1.0",
    "rights": "all rights reserved",
}

# fixed values: rule, licence and the sentences that must follow one another (unknown sentences between them do not matter)
RULES = [
    ("MIT", ["mit_released"]), ("MIT", ["mit_licensed"]), ("MIT", ["mit_project"]), ("MIT", ["mit_spdx"]),
    ("MIT", ["mit_grant", "mit_notice", "mit_as_is"]),
    ("Apache-2.0", ["apache_short"]), ("Apache-2.0", ["apache_header", "apache_copy", "apache_basis"]), ("Apache-2.0", ["apache_spdx"]),
    ("GPL-3.0", ["gpl3_work"]), ("GPL-3.0", ["gpl3_short"]), ("GPL-3.0", ["gpl_free", "gpl_hope"]), ("GPL-3.0", ["gpl3_spdx"]), ("GPL-3.0", ["gpl3_later_spdx"]),
    ("BSD-3-Clause", ["bsd_redistribution", "bsd_source", "bsd_binary", "bsd_names"]), ("BSD-3-Clause", ["bsd3_spdx"]),
    ("BSD-2-Clause", ["bsd_redistribution", "bsd_source", "bsd_binary"]), ("BSD-2-Clause", ["bsd2_spdx"]),
    ("CC-BY-4.0", ["cc_by"]), ("CC-BY-4.0", ["cc_by_full"]), ("CC-BY-SA-4.0", ["cc_by_sa"]), ("CC-BY-SA-4.0", ["cc_by_sa_full"]),
    ("CC-BY-NC-4.0", ["cc_by_nc"]), ("CC-BY-NC-4.0", ["cc_by_nc_full"]), ("CC-BY-ND-4.0", ["cc_by_nd"]), ("CC0-1.0", ["cc0"]),
    ("Proprietary", ["rights"]),
]


# fixed values: other wordings of sentences above, and the sentences of further licences
_LATER = "either version {} of the license or at your option any later version"
_FREE = "this {} is free software you can redistribute it and or modify it under the terms of the gnu {}general public license as published by the free software foundation "
_CC = "this work is licensed under a creative commons attribution {} 4.0 international license"
MORE_SENTENCES = {
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "mit_notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and non infringement": "mit_as_is",
    "you may obtain a copy of the license at": "apache_copy",
    "you may obtain a copy of the license at https www.apache.org licenses license 2.0": "apache_copy",
    "the asf licenses this file to you under the apache license version 2.0 the license you may not use this file except in compliance with the license": "apache_header",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd_grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc_as_is",
    _FREE.format("program", "") + _LATER.format("2"): "gpl2_free",
    _FREE.format("program", "affero ") + _LATER.format("3"): "agpl3_free",
    _FREE.format("library", "lesser ") + _LATER.format("2.1"): "lgpl21_free",
    _FREE.format("library", "lesser ") + _LATER.format("3"): "lgpl3_free",
    _FREE.format("program", "lesser ") + _LATER.format("3"): "lgpl3_free",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl_hope",
    "this source code form is subject to the terms of the mozilla public license v": "mpl2_form",
    "this is free and unencumbered software released into the public domain": "unlicense_free",
    "distributed under the boost software license version 1.0": "bsl1_short",
    "this software is provided as is without any express or implied warranty": "zlib_as_is",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib_grant",
    "licensed under cc by nc sa 4.0": "cc_by_nc_sa", _CC.format("noncommercial sharealike"): "cc_by_nc_sa",
    "licensed under cc by nc nd 4.0": "cc_by_nc_nd", _CC.format("noncommercial noderivatives"): "cc_by_nc_nd",
    _CC.format("noderivatives"): "cc_by_nd",
}
_FURTHER_SPDX = {x.replace("-only", "").replace("-or-later", ""): [] for x in (
    "GPL-2.0-only LGPL-2.1-only LGPL-3.0-only AGPL-3.0-only ISC 0BSD MPL-2.0 Unlicense BSL-1.0 Zlib EPL-2.0").split()}
for _name, _forms in _FURTHER_SPDX.items():
    for _form in [_name, *([f"{_name}-only", f"{_name}-or-later"] if "GPL" in _name else [])]:
        MORE_SENTENCES["spdx license identifier " + _form.lower().replace("-", " ")] = f"{_form.lower().replace('-', '_')}_spdx"
        _forms.append(f"{_form.lower().replace('-', '_')}_spdx")
MORE_RULES = [
    ("ISC", ["isc_grant", "isc_as_is"]), ("0BSD", ["0bsd_grant", "isc_as_is"]), ("GPL-2.0", ["gpl2_free", "gpl_hope"]),
    ("AGPL-3.0", ["agpl3_free", "gpl_hope"]), ("LGPL-2.1", ["lgpl21_free", "gpl_hope"]), ("LGPL-3.0", ["lgpl3_free", "gpl_hope"]),
    ("MPL-2.0", ["mpl2_form"]), ("Unlicense", ["unlicense_free"]), ("BSL-1.0", ["bsl1_short"]), ("Zlib", ["zlib_as_is", "zlib_grant"]),
    ("CC-BY-NC-SA-4.0", ["cc_by_nc_sa"]), ("CC-BY-NC-ND-4.0", ["cc_by_nc_nd"]),
    *((_name, [_form]) for _name, _forms in _FURTHER_SPDX.items() for _form in _forms),
]

_SIGNS = "licen|permi|right|software|warrant|redistrib|cc0|neither"
_LEAST, _MOST = min(map(len, SENTENCES.values())), 2 * max(map(len, SENTENCES.values()))  # _MOST: of the SQL alone
_KNOWN = {sentence: name for name, sentence in SENTENCES.items()} | MORE_SENTENCES

# marks of ends of sentences, from sure to possible ones; every later mark cuts what the earlier ones leave
_SURE, _APART, _LISTED, _BULLET, _LINE = "\x01", "\x02", "\x03", "\x04", "\n"
_MARKS = [
    (r"([.!?])[ \t\r\n]+", f"$1{_SURE}"),
    # lines without letters or digits, copyright lines, addresses that end a line
    (r"\n[^\p{L}\p{N}\n\x01]*(?=\n)", _APART),
    (r"(?i)(^|[\n\x01\x02])([^\p{L}\p{N}\n]*(?:copyright[ \t:]*(?:\(c\)|\u00a9|[0-9]{4}|[\[<{])|\u00a9|\(c\)[ \t]*[0-9]{4})[^\n\x01\x02]*)",
     f"$1{_APART}$2{_APART}"),
    (r"(https?://[^ \t\r\n\x01\x02]+)[ \t\r]*\n", f"$1{_APART}"),
    # colons that end a line, addresses that open one, list marks, titles
    (r":[ \t\r]*\n", f":{_LISTED}"),
    (r"\n([^\p{L}\p{N}\n]*https?://)", f"{_LISTED}$1"),
    (r"(^|[\n\x01-\x03])[^\p{L}\p{N}\n\x01-\x03]*(?:[0-9]{1,2}|[a-z]|[ivx]{1,4})[.)](?:[ \t]+|(?=\x01))", f"$1{_LISTED}"),
    (r"(?i)((?:^|[\n\x01-\x03])[^\n\x01-\x03]{0,30}licen[sc]e(?:[ \t]*\([^)\n]*\))?[^\p{L}\p{N}\n\x01-\x03]*)\n", f"$1{_LISTED}"),
    (r"\n[ \t]*[*\u2022\u00b7\u2013-][ \t]+", _BULLET),
]


def _plain(s: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9.+]+", " "), r"[. ]+( |$)|(^| )[. ]+", " "))
    return F.regexp_replace(plain, "^neither the names? of .{1,200}? nor the names of (?:its|their|any|the) contributors may be ",
                            "neither the name of the copyright holder nor the names of its contributors may be ")


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text in their order.

    Sentences end at . ! ? before white space. What is no known sentence is cut further and
    looked up again: at empty lines, copyright lines and addresses, then at colons that end a
    line, list marks and titles, then at bullets, at last at every line end. So each part of a text is
    read by itself, wrapped or on lines of its own; a whole sentence goes before its parts.
    """
    known = F.create_map(*[F.lit(x) for pair in _KNOWN.items() for x in pair])
    marked = F.translate(text, _SURE + _APART + _LISTED + _BULLET, "    ")
    for pattern, mark in _MARKS:
        marked = F.regexp_replace(marked, pattern, mark)

    def read(part: Column, marks: list[str]) -> Column:
        def piece(s: Column) -> Column:
            # every known sentence has one of these signs: the others are not normalised at all
            likely = (F.length(s) >= _LEAST) & F.lower(s).rlike(_SIGNS)
            none = F.array().cast("array<string>")

            def found(name: Column) -> Column:
                finer = F.when(s.rlike("[\x02-\x04\n]"), read(s, marks[1:])).otherwise(none) if len(marks) > 1 else none
                return F.when(name.isNotNull(), F.array(name)).otherwise(finer)

            return F.when(likely, F.transform(F.array(F.try_element_at(known, _plain(s))), found)[0]).otherwise(none)

        return F.flatten(F.transform(F.split(part, marks[0]), piece))

    return read(marked, [_SURE, _APART, _LISTED, _BULLET, _LINE])


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with license_sentences (array of identifiers in order) and licenses (sorted array).

    A licence is found when the identifiers of one of its rules follow one another in
    the sequence of known sentences; of BSD rules only the longest counts. Null texts have no
    sentences. Columns of these names are replaced, all rows and other columns stay.
    A map of fixed size and array functions do the work: no shuffle, no Python.
    """
    ids = docs.withColumn("license_sentences", F.coalesce(sentence_ids(F.col(text)), F.array().cast("array<string>")))
    joined = F.concat(F.lit("|"), F.array_join("license_sentences", "|"), F.lit("|"))
    found = [F.when(joined.contains("|" + "|".join(rule) + "|"), F.lit(name)) for name, rule in RULES + MORE_RULES]
    names = F.array_distinct(F.array_compact(F.array(*found)))
    longest = F.when(F.array_contains(names, "BSD-3-Clause") & ~F.array_contains("license_sentences", "bsd2_spdx"),
                     F.array_remove(names, "BSD-2-Clause")).otherwise(names)
    return ids.withColumn("licenses", F.when(F.size("license_sentences") > 0, F.sort_array(longest)).otherwise(F.array().cast("array<string>")))


def oracle() -> str:
    """DuckDB's SQL, per document as text: the sentences and rules of one line or one paragraph, without ``MORE_SENTENCES`` and finer cuts."""
    keys = ", ".join(f"'{s}'" for s in SENTENCES.values())
    names = ", ".join(f"'{n}'" for n in SENTENCES)
    rules = ", ".join(f"CASE WHEN contains(j, '|{'|'.join(rule)}|') THEN '{name}' END" for name, rule in RULES)

    def recognised(text: str) -> str:
        return rf"""list_filter(list_transform(list_transform(list_filter(
      string_split(regexp_replace({text}, '([.!?])[ \t\r\n]+', '\1' || chr(10), 'g'), chr(10)),
      lambda s: length(s) BETWEEN {_LEAST} AND {_MOST} AND regexp_matches(lower(s), '{_SIGNS}')),
      lambda s: trim(regexp_replace(regexp_replace(lower(s), '[^a-z0-9.+]+', ' ', 'g'), '[. ]+( |$)|(^| )[. ]+', ' ', 'g'))),
      lambda s: map([{keys}], [{names}])[s]), lambda s: s IS NOT NULL)"""

    return rf"""
WITH readings AS (
  SELECT doc_id, {recognised("coalesce(text, '')")} AS a,
    {recognised("regexp_replace(coalesce(text, ''), '[ \t\r\n]+', ' ', 'g')")} AS b FROM documents),
ids AS (SELECT doc_id, CASE WHEN len(b) > len(a) THEN b ELSE a END AS i FROM readings),
joined AS (SELECT doc_id, i, '|' || array_to_string(i, '|') || '|' AS j FROM ids),
found AS (SELECT doc_id, i, list_distinct(list_filter([{rules}], lambda x: x IS NOT NULL)) AS n FROM joined)
SELECT doc_id, CAST(len(i) AS BIGINT) AS n_sentences, array_to_string(i, '|') AS sentences,
  array_to_string(list_sort(CASE WHEN list_contains(n, 'BSD-3-Clause') AND NOT list_contains(i, 'bsd2_spdx')
    THEN list_filter(n, lambda x: x <> 'BSD-2-Clause') ELSE n END), '|') AS licenses
FROM found"""
