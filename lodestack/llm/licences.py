"""Licence recognition by sentence rules, in DataFrame expressions only.

Lines that are a known sentence by themselves, and copyright lines, stand alone; other lines of a paragraph are one running text
(comment marks at their beginnings go), cut into sentences at blank lines and after . ! ? ; followed by white space. A sentence
is normalised (lower case, runs of anything but letters, digits, dots and plus signs become one space; "this work is licensed
under the terms of the" and the like become "under"; names of holders become x), known sentences map to identifiers, and the
identifiers of a document, in order, are matched against an ordered list of rules. A rule is a sequence of identifiers; where it
occurs without other sentences between (copyright lines aside) it names its licence, is taken out, and later rules see only what is left.

Narrow: no join and no shuffle. The dictionary and the rules are constants of fixed size in the plan.

Results: one row per document. Null and empty texts have no sentences and the licence list "none"; sentences that
speak of a licence but are not known are counted in n_unknown; a document whose identifiers match no rule, or which has
unknown licence sentences only, is "unmatched"; licences are listed once, in the order of their first place in the document;
repeated rows give repeated results.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# SPDX identifiers and the names under which sentences refer to the licences.
NAMES = {
    "MIT": ("MIT", "MIT license", "Expat license", "MIT/X11 license"),
    "Apache-2.0": ("Apache 2.0", "Apache-2.0", "Apache license version 2.0", "Apache license 2.0", "Apache 2.0 license", "Apache license v2.0", "Apache license version 2.0 the license", "Apache software license 2.0"),
    "BSD-2-Clause": ("BSD 2-clause license", "2-clause BSD license", "simplified BSD license", "FreeBSD license", "BSD-2-Clause license"),
    "BSD-3-Clause": ("BSD 3-clause license", "3-clause BSD license", "new BSD license", "modified BSD license", "revised BSD license", "BSD-3-Clause license"),
    "ISC": ("ISC", "ISC license"),
    "Zlib": ("zlib license", "zlib/libpng license"),
    "Unlicense": ("unlicense", "Unlicense license"),
    "BSL-1.0": ("Boost software license version 1.0", "Boost software license 1.0"),
    "MPL-2.0": ("MPL 2.0", "MPL-2.0", "Mozilla public license version 2.0", "Mozilla public license 2.0", "Mozilla public license v. 2.0"),
    "EPL-2.0": ("EPL 2.0", "Eclipse public license 2.0", "Eclipse public license version 2.0", "Eclipse public license v2.0"),
    "GPL-2.0-only": ("GNU general public license version 2", "GNU GPL version 2", "GNU GPL v2", "GPLv2", "GPL v2", "GPL version 2", "GPL 2.0"),
    "GPL-2.0-or-later": ("GNU general public license version 2 or later", "GNU GPL version 2 or later", "GPLv2+", "GPL v2 or later", "GPLv2 or later"),
    "GPL-3.0-only": ("GNU general public license version 3", "GNU general public license v3.0", "GNU GPL version 3", "GNU GPL v3", "GPLv3", "GPL v3", "GPL version 3", "GPL 3.0"),
    "GPL-3.0-or-later": ("GNU general public license version 3 or later", "GNU GPL version 3 or later", "GPLv3+", "GPL v3 or later", "GPLv3 or later"),
    "LGPL-2.1-only": ("GNU lesser general public license version 2.1", "GNU LGPL version 2.1", "LGPLv2.1", "LGPL v2.1", "LGPL 2.1"),
    "LGPL-2.1-or-later": ("GNU lesser general public license version 2.1 or later", "LGPLv2.1+", "LGPL v2.1 or later"),
    "LGPL-3.0-only": ("GNU lesser general public license version 3", "GNU LGPL version 3", "LGPLv3", "LGPL v3", "LGPL 3.0"),
    "LGPL-3.0-or-later": ("GNU lesser general public license version 3 or later", "LGPLv3+", "LGPL v3 or later"),
    "AGPL-3.0-only": ("GNU affero general public license version 3", "GNU AGPL version 3", "AGPLv3", "AGPL v3", "AGPL 3.0"),
    "AGPL-3.0-or-later": ("GNU affero general public license version 3 or later", "AGPLv3+", "AGPL v3 or later"),
    "CC0-1.0": ("CC0", "CC0 1.0", "CC0 1.0 universal", "creative commons zero v1.0 universal", "creative commons CC0 1.0 universal license"),
}
# Creative Commons' conditions, their letters and names. Every licence has versions 3.0 and 4.0.
CONDITIONS = {
    "BY": "attribution", "BY-SA": "attribution-sharealike", "BY-ND": "attribution-noderivatives", "BY-NC": "attribution-noncommercial",
    "BY-NC-SA": "attribution-noncommercial-sharealike", "BY-NC-ND": "attribution-noncommercial-noderivatives",
}
# Sentences of licence texts and notices.
SENTENCES = {
    "MitGrant": ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',),
    "MitNotice": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software"),
    "MitAsIs": ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',),
    "MitLiability": ("IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",),
    "IscGrant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    "IscAsIs": ('THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',),
    "BsdGrant": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "BsdSource": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",),
    "BsdBinary": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",),
    "BsdEndorse": ("Neither the name of x nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "BsdAsIs": ('THIS SOFTWARE IS PROVIDED BY x "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',),
    "ApacheCompliance": ("you may not use this file except in compliance with the License",),
    "CopyAt": ("You may obtain a copy of the License at", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    "ApacheUrl": ("http://www.apache.org/licenses/LICENSE-2.0", "https://www.apache.org/licenses/LICENSE-2.0"),
    "ApacheAsIs": ('Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',),
    "ApacheSee": ("See the License for the specific language governing permissions and limitations under the License",),
    "FreeSoftware": ("This program is free software", "This library is free software"),
    "GplTerms": ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",),
    "LgplTerms": ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",),
    "Version2Plus": ("either version 2 of the License, or (at your option) any later version",),
    "Version21Plus": ("either version 2.1 of the License, or (at your option) any later version",),
    "Version3Plus": ("either version 3 of the License, or (at your option) any later version",),
    "Gpl2Only": ("you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 2", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 2 of the License"),
    "Gpl2Header": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version",),
    "Gpl3Header": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    "Lgpl3Header": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    "Agpl3Header": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "GplHope": ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"),
    "GplImplied": ("without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",),
    "GplSee": ("See the GNU General Public License for more details", "See the GNU Lesser General Public License for more details", "See the GNU Affero General Public License for more details"),
    "GplReceived": ("You should have received a copy of the GNU General Public License along with this program", "You should have received a copy of the GNU General Public License along with this program; if not, see <https://www.gnu.org/licenses/>", "If not, see <https://www.gnu.org/licenses/>", "If not, see <http://www.gnu.org/licenses/>"),
    "MplForm": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
    "MplCopy": ("If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    "UnlicenseDomain": ("This is free and unencumbered software released into the public domain",),
    "AllRights": ("All rights reserved",),
}
# Rules in the order in which they are tried, after which come the references by name ("under ...") and SPDX lines.
RULES = (
    ("AGPL-3.0-or-later", ("Agpl3Header",)),
    ("LGPL-3.0-or-later", ("Lgpl3Header",)),
    ("GPL-3.0-or-later", ("Gpl3Header", "GplHope")), ("GPL-3.0-or-later", ("FreeSoftware", "GplTerms", "Version3Plus", "GplHope")), ("GPL-3.0-or-later", ("FreeSoftware", "GplTerms", "Version3Plus")), ("GPL-3.0-or-later", ("Gpl3Header",)),
    ("GPL-2.0-or-later", ("FreeSoftware", "GplTerms", "Version2Plus", "GplHope")), ("GPL-2.0-or-later", ("FreeSoftware", "GplTerms", "Version2Plus")), ("GPL-2.0-or-later", ("Gpl2Header",)),
    ("GPL-2.0-only", ("FreeSoftware", "Gpl2Only")),
    ("LGPL-3.0-or-later", ("FreeSoftware", "LgplTerms", "Version3Plus")), ("LGPL-2.1-or-later", ("FreeSoftware", "LgplTerms", "Version21Plus")),
    ("Apache-2.0", ("under Apache-2.0", "ApacheCompliance", "CopyAt", "ApacheUrl", "ApacheAsIs", "ApacheSee")), ("Apache-2.0", ("under Apache-2.0", "ApacheCompliance", "CopyAt", "ApacheAsIs", "ApacheSee")),
    ("Apache-2.0", ("under Apache-2.0", "ApacheCompliance", "CopyAt", "ApacheSee")), ("Apache-2.0", ("under Apache-2.0", "ApacheCompliance")),
    ("MIT", ("MitGrant", "MitNotice", "MitAsIs", "MitLiability")), ("MIT", ("MitGrant", "MitNotice", "MitAsIs")), ("MIT", ("under MIT", "MitNotice", "MitAsIs")), ("MIT", ("MitNotice", "MitAsIs")), ("MIT", ("MitGrant",)),
    ("ISC", ("IscGrant", "IscAsIs")), ("ISC", ("IscGrant",)),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse")), ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary")),
    ("MPL-2.0", ("MplForm", "MplCopy")), ("MPL-2.0", ("MplForm",)),
    ("Unlicense", ("UnlicenseDomain",)),
)
LAST_RULES = (("AllRightsReserved", ("AllRights",)),)
#: A sentence that holds one of these may speak of a licence; every known sentence holds one.
SIGN = "licen[sc]|creative commons|permitted|permission|copyright|redistribut|software|warrant|all rights|spdx|mozilla.org|gnu.org|version [23][.0-9]* of|under (the )?(terms (and conditions )?of )?(the )?(mit|apache|bsd|cc|gpl|lgpl|agpl|mpl|epl|gnu|isc|zlib|unlicense|mozilla|eclipse|boost)|contributors|conditions"
#: (pattern, put) of the normaliser after other signs have become spaces; in Java's, Python's and RE2's common syntax.
CANONICAL = (
    (r"^[0-9]{1,2}\.? ", ""),
    (r"^(?:(?:this|the|our|all|these) (?:work|project|program|file|files|code|source code|software|library|document|documentation|repository|package|content|text|dataset|data|article|page|material|model) (?:is|are) )?(?:also )?(?:dual )?(?:licensed|released|distributed|published|provided|made available|available) (?:to you )?under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?", "under "),
    (r"^licen[sc]e (?:is )?(?:under )?(?:the )?", "under "),
    (r"^under (?:an? )?(.*) see .*$", r"under \1"),
    (r"^under an? ", "under "),
    (r"licence", "license"),
    (r"^(under cc by[a-z ]* [34]\.0) (?:international |unported )?license$", r"\1"),
    (r"^neither the name of .* nor the names of .*contributors may", "neither the name of x nor the names of its contributors may"),
    (r"^this software is provided by .* as is and", "this software is provided by x as is and"),
)
_COPYRIGHT = r"^(?:c )?copyright (?:c |by )*(?:[0-9]|c )"
_COMMENT = r"^[ \t]*(?:/\*+|\*+/?|//+|#+|;+|--+|- |%+|<!--)?[ \t]*"
#: "v. 2.0" is no end of a sentence.
_VERSION = (r"\b([vV])\.[ \t\n]+([0-9])", r"\1 \2")
_PARAGRAPH = r"\n[ \t]*\n[ \t\n]*"


def normal(sentence: str) -> str:
    """The normalised form of a sentence, as the expressions make it."""
    s = re.sub(r"[. ]+$", "", re.sub(r"[^a-z0-9.+]+", " ", re.sub(*_VERSION, sentence).lower()).strip())
    for pattern, put in CANONICAL:
        s = re.sub(pattern, put, s)
    return s.strip()


def dictionary() -> dict[str, str]:
    """Normalised sentence to identifier."""
    found = {}
    for letters, name in CONDITIONS.items():
        for version in ("4.0", "3.0"):
            spdx = f"CC-{letters}-{version}"
            for form in (spdx, f"CC {letters} {version}", f"Creative Commons {name} {version} international", f"Creative Commons {name} {version} international license", f"Creative Commons {name} {version} unported license", f"Creative Commons {name} {version} license"):
                found[normal(f"licensed under {form}")] = f"under {spdx}"
            found[normal(f"SPDX-License-Identifier: {spdx}")] = f"under {spdx}"
    for spdx, names in NAMES.items():
        for name in names:
            found[normal(f"licensed under the {name}")] = f"under {spdx}"
        found[normal(f"SPDX-License-Identifier: {spdx}")] = f"under {spdx}"
    for identifier, sentences in SENTENCES.items():
        for s in sentences:
            found[normal(s)] = identifier
    return found


def all_rules() -> tuple[tuple[str, tuple[str, ...]], ...]:
    """The rules, then one for each licence that a sentence or an SPDX line can name, then the last ones."""
    named = [i for i in dict.fromkeys(dictionary().values()) if i.startswith("under ")]
    return (*RULES, *((i.removeprefix("under "), (i,)) for i in named), *LAST_RULES)


def _normalised(sentence: Column) -> Column:
    s = F.trim(F.regexp_replace(F.lower(sentence), r"[^a-z0-9.+]+", " "))
    s = F.regexp_replace(s, r"[. ]+$", "")
    for pattern, put in CANONICAL:
        s = F.regexp_replace(s, pattern, put.replace("\\1", "$1"))
    return F.trim(s)


def scan(docs: DataFrame, sentences: dict[str, str] | None = None, rules: tuple | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_sentences (that may speak of a licence), n_unknown, sentence_ids and licenses ("|"-separated, in order) of every document.

    ``sentences`` maps normalised sentences (``normal``) to identifiers, which hold none of the signs | ~ ? =.
    """
    sentences, rules = sentences or dictionary(), rules or all_rules()
    known = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])
    identified = lambda s: F.element_at(known, _normalised(s))
    signed = lambda s: F.lower(s).rlike(SIGN)
    plain = F.regexp_replace(F.regexp_replace(F.col(text_col), r"\r\n?", "\n"), rf"(?md){_COMMENT}", "")
    alone = F.transform(F.split(plain, "\n"), lambda s: F.when(signed(s) & (identified(s).isNotNull() | _normalised(s).rlike(_COPYRIGHT)), F.concat(F.lit("\n"), s, F.lit("\n"))).otherwise(s))
    cut_up = F.split(F.regexp_replace(F.regexp_replace(F.array_join(alone, "\n"), _VERSION[0], "$1 $2"), r"([.!?;])[ \t\n]+", "$1\n\n"), _PARAGRAPH)
    told = F.filter(cut_up, lambda s: s.rlike("[A-Za-z]"))
    name = lambda s: F.when(~signed(s), "~").otherwise(F.coalesce(identified(s), F.when(_normalised(s).rlike(_COPYRIGHT), "=").otherwise("?")))
    ids = F.filter(F.transform(told, name), lambda i: i != "=")
    none = F.array().cast("array<string>")
    base = docs.select(F.col(id_col), F.when(signed(F.col(text_col)), ids).otherwise(none).alias("_ids"))
    # Rules over the text "|A||B|" (each identifier has its own borders, so that neighbouring matches share none): what a rule
    # matches becomes "|=k|", which no later rule can span and which keeps its place.
    found = F.concat(F.lit("|"), F.array_join("_ids", "||"), F.lit("|"))
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit("|" + "||".join(seq) + "|").alias("seq")) for k, (_, seq) in enumerate(rules)])
    left = F.aggregate(table, found, lambda s, rule: F.replace(s, rule["seq"], F.concat(F.lit("|="), rule["k"].cast("string"), F.lit("|"))))
    names = F.array(*[F.lit(n) for n, _ in rules])
    named = F.array_distinct(F.transform(F.regexp_extract_all("_left", F.lit(r"\|=(\d+)\|"), F.lit(1)), lambda k: F.element_at(names, k.cast("int") + 1)))
    spoken = F.filter("_ids", lambda i: i != "~")
    out = base.withColumn("_spoken", spoken).withColumn("_left", F.when(F.size("_spoken") > 0, left).otherwise("")).withColumn("_found", named)
    return out.select(
        id_col, F.size("_spoken").cast("long").alias("n_sentences"), F.size(F.filter("_spoken", lambda i: i == "?")).cast("long").alias("n_unknown"), F.array_join("_spoken", "|").alias("sentence_ids"),
        F.when(F.size("_spoken") == 0, "none").when(F.size("_found") == 0, "unmatched").otherwise(F.array_join("_found", "|")).alias("licenses"),
    )


def oracle_sql() -> str:
    """The same in DuckDB's SQL, over the view documents."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    normalised = lambda c: _sql_normal(c, quote)
    values = ", ".join(f"({quote(s)}, {quote(i)})" for s, i in dictionary().items())
    rules = all_rules()
    steps, last = [], "listed"
    for at in range(0, len(rules), 10):
        step = "s"
        for k in range(at, min(at + 10, len(rules))):
            step = f"replace({step}, {quote('|' + '||'.join(rules[k][1]) + '|')}, '|={k}|')"
        steps.append(f"s{at} as (select doc_id, rid, ids, {step} as s from {last})")
        last = f"s{at}"
    names = ", ".join(quote(n) for n, _ in rules)
    return f"""
with known(norm, id) as (values {values}),
texts as (select doc_id, row_number() over () as rid, regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '(?m){_COMMENT}', '', 'g') as t, regexp_matches(lower(text), {quote(SIGN)}) as signed from documents),
lines as (select rid, unnest(string_split(t, chr(10))) as s, generate_subscripts(string_split(t, chr(10)), 1) as pos from texts where signed),
marked as (select rid, pos, s, regexp_matches(lower(s), {quote(SIGN)}) as signed, case when regexp_matches(lower(s), {quote(SIGN)}) then {normalised('s')} end as norm from lines),
alone as (select rid, string_agg(case when signed and (k.id is not null or regexp_matches(m.norm, {quote(_COPYRIGHT)})) then chr(10) || s || chr(10) else s end, chr(10) order by pos) as t from marked m left join known k on k.norm = m.norm group by rid),
parts as (select rid, string_split_regex(regexp_replace(regexp_replace(t, {quote(_VERSION[0])}, {quote(_VERSION[1])}, 'g'), '([.!?;])[ \\t\\n]+', '\\1' || chr(10) || chr(10), 'g'), {quote(_PARAGRAPH)}) as p from alone),
cut as (select rid, unnest(p) as s, generate_subscripts(p, 1) as pos from parts),
told as (select rid, pos, regexp_matches(lower(s), {quote(SIGN)}) as signed, case when regexp_matches(lower(s), {quote(SIGN)}) then {normalised('s')} end as norm from cut where regexp_matches(s, '[A-Za-z]')),
named as (select rid, pos, case when not signed then '~' else coalesce(k.id, case when regexp_matches(t.norm, {quote(_COPYRIGHT)}) then '=' else '?' end) end as id from told t left join known k on k.norm = t.norm),
gathered as (select rid, list(id order by pos) as ids from named where id <> '=' group by rid),
listed as (select x.doc_id, x.rid, coalesce(g.ids, []::varchar[]) as ids, '|' || array_to_string(coalesce(g.ids, []::varchar[]), '||') || '|' as s from texts x left join gathered g on g.rid = x.rid),
{', '.join(steps)},
spoken as (select doc_id, rid, list_filter(ids, lambda x: x <> '~') as ids, case when len(list_filter(ids, lambda x: x <> '~')) > 0 then regexp_extract_all(s, '\\|=(\\d+)\\|', 1) else []::varchar[] end as hits from {last}),
hit as (select rid, n, min(pos) as pos from (select rid, ([{names}])[cast(unnest(hits) as int) + 1] as n, generate_subscripts(hits, 1) as pos from spoken) group by rid, n),
found as (select rid, string_agg(n, '|' order by pos) as licenses from hit group by rid)
select doc_id, cast(len(ids) as bigint) as n_sentences, cast(len(list_filter(ids, lambda x: x = '?')) as bigint) as n_unknown, array_to_string(ids, '|') as sentence_ids,
  case when len(ids) = 0 then 'none' else coalesce(f.licenses, 'unmatched') end as licenses
from spoken s left join found f on f.rid = s.rid"""


def _sql_normal(column: str, quote) -> str:
    s = f"regexp_replace(trim(regexp_replace(lower({column}), '[^a-z0-9.+]+', ' ', 'g')), '[. ]+$', '')"
    for pattern, put in CANONICAL:
        s = f"regexp_replace({s}, {quote(pattern)}, {quote(put)}, 'g')"
    return f"trim({s})"
