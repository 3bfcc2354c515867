"""Operator 7, licence scan by sentence rules.

A text is read as words (lower case, letters and digits only).  Wherever a sentence can begin
(at the start, after a sentence end, or on a new line) the known licence sentences are tried as
a word trie; the longest one that also stops at a sentence end or line end is recognised, also
across wrapped lines.  The recognised identifiers, in text order, are then matched against the
licence rules, ordered sequences of identifiers: at each place the longest rule that fits
wins, copyright lines may stand between its parts, and its sentences are used up.  Recognised
sentences that complete no rule are counted.  An ``SPDX-License-Identifier`` line is a sentence
whose identifiers are named by its expression, one rule each.

The built-in table holds the short licences sentence by sentence and the headings and notices by
which the long ones are applied.  Whole licence texts are a parameter (``texts``): ``with_texts`` cuts
them into sentences by the rules the scan reads by, sentences that several licences share get
one identifier, and each text's identifiers in order become a rule.  The table is broadcast; given
texts above MOST_CHARS characters in all are an error.

Only texts that hold one of a few key words leave the JVM, unless a known sentence holds none.

Cases: null or empty text and texts without a known sentence give empty lists.  Rules that fit at
one place and are equally long: the first in the table.  Repeated rows and any keys are passed
through, one result row per row.  Given texts that are null or hold no word add nothing.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.llm.common import query, sub_batches, table

# Sentences of public licence texts (identifier -> normalised words).
SENTENCES = {
    "mit-released": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-project": "this project is licensed under the mit license",
    "mit-software": "this software is released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "apache2-short": "licensed under the apache license version 2 0",
    "apache2-header": "licensed under the apache license version 2 0 the license",
    "apache2-comply": "you may not use this file except in compliance with the license",
    "apache2-obtain": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "gpl2-work": "this work is licensed under the gnu general public license version 2",
    "gpl3-program": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-program": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl3-work": "this work is licensed under the gnu lesser general public license version 3",
    "agpl3-work": "this work is licensed under the gnu affero general public license version 3",
    "mpl2-form": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "cc-by-4": "licensed under cc by 4 0",
    "cc-by-sa-4": "licensed under cc by sa 4 0",
    "cc-by-nc-4": "licensed under cc by nc 4 0",
    "cc-by-nd-4": "licensed under cc by nd 4 0",
    "cc-by-nc-sa-4": "licensed under cc by nc sa 4 0",
    "cc0": "released under cc0 1 0 license",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "rights-reserved": "all rights reserved",
    "mit-heading": "mit license",
    "mit-heading-the": "the mit license",
    "mit0-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "isc-liability": "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd-liability": "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "bsd-advert": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd3-heading": "bsd 3 clause license",
    "bsd2-heading": "bsd 2 clause license",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-liability": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "bsl1-heading": "boost software license version 1 0 august 17th 2003",
    "bsl1-short": "distributed under the boost software license version 1 0",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "wtfpl-heading": "do what the fuck you want to public license",
    "apache2-heading": "apache license version 2 0 january 2004",
    "apache2-terms": "terms and conditions for use reproduction and distribution",
    "apache2-unless": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2-see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl1-heading": "gnu general public license version 1 february 1989",
    "gpl2-heading": "gnu general public license version 2 june 1991",
    "gpl3-heading": "gnu general public license version 3 29 june 2007",
    "lgpl2-heading": "gnu library general public license version 2 june 1991",
    "lgpl21-heading": "gnu lesser general public license version 2 1 february 1999",
    "lgpl3-heading": "gnu lesser general public license version 3 29 june 2007",
    "agpl3-heading": "gnu affero general public license version 3 19 november 2007",
    "gfdl13-heading": "gnu free documentation license version 1 3 3 november 2008",
    "fsf-copies": "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    "gpl2-only-program": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "lgpl21-library": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3-program": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3-program": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-received": "you should have received a copy of the gnu general public license along with this program",
    "mpl2-heading": "mozilla public license version 2 0",
    "mpl11-heading": "mozilla public license version 1 1",
    "epl2-heading": "eclipse public license v 2 0",
    "epl2-notice": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "cc-by-4-heading": "creative commons attribution 4 0 international public license",
    "cc-by-sa-4-heading": "creative commons attribution sharealike 4 0 international public license",
    "cc-by-nc-4-heading": "creative commons attribution noncommercial 4 0 international public license",
    "cc-by-nd-4-heading": "creative commons attribution noderivatives 4 0 international public license",
    "cc-by-nc-sa-4-heading": "creative commons attribution noncommercial sharealike 4 0 international public license",
    "cc-by-nc-nd-4-heading": "creative commons attribution noncommercial noderivatives 4 0 international public license",
    "cc-by-4-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-4-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-4-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-nc-sa-4-work": "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license",
    "cc0-heading": "cc0 1 0 universal",
    "artistic2-heading": "the artistic license 2 0",
    "ofl11-heading": "sil open font license version 1 1 26 february 2007",
}
#: (licence, its sentences in order)
RULES = [
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is", "mit-liability")),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-project",)),
    ("MIT", ("mit-software",)),
    ("MIT", ("mit-heading", "mit-grant", "mit-notice", "mit-as-is", "mit-liability")),
    ("MIT", ("mit-heading-the", "mit-grant", "mit-notice", "mit-as-is", "mit-liability")),
    ("MIT", ("mit-heading",)),
    ("MIT", ("mit-heading-the",)),
    ("MIT-0", ("mit0-grant", "mit-as-is", "mit-liability")),
    ("MIT-0", ("mit0-grant",)),
    ("ISC", ("isc-grant", "isc-as-is", "isc-liability")),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant", "isc-as-is", "isc-liability")),
    ("0BSD", ("0bsd-grant",)),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse", "bsd-as-is", "bsd-liability")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse")),
    ("BSD-3-Clause", ("bsd3-heading", "bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is", "bsd-liability")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is", "bsd-liability")),
    ("BSD-3-Clause", ("bsd3-heading",)),
    ("BSD-2-Clause", ("bsd2-heading", "bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liability")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liability")),
    ("BSD-2-Clause", ("bsd2-heading",)),
    ("Zlib", ("zlib-as-is", "zlib-liability", "zlib-grant")),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("bsl1-heading",)),
    ("BSL-1.0", ("bsl1-short",)),
    ("WTFPL", ("wtfpl-heading",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache2-heading", "apache2-terms")),
    ("Apache-2.0", ("apache2-heading",)),
    ("Apache-2.0", ("apache2-header", "apache2-comply", "apache2-obtain", "apache2-unless", "apache2-see")),
    ("Apache-2.0", ("apache2-header", "apache2-comply", "apache2-obtain")),
    ("Apache-2.0", ("apache2-header", "apache2-comply")),
    ("Apache-2.0", ("apache2-short",)),
    ("GPL-3.0", ("gpl3-work",)),
    ("GPL-2.0", ("gpl2-work",)),
    ("GPL-3.0-or-later", ("gpl3-program", "gpl-hope")),
    ("GPL-3.0-or-later", ("gpl3-program",)),
    ("GPL-2.0-or-later", ("gpl2-program", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl2-program",)),
    ("GPL-3.0-or-later", ("gpl3-program", "gpl-hope", "gpl-received")),
    ("GPL-2.0-or-later", ("gpl2-program", "gpl-hope", "gpl-received")),
    ("GPL-2.0-only", ("gpl2-only-program", "gpl-hope")),
    ("GPL-2.0-only", ("gpl2-only-program",)),
    ("GPL-1.0", ("gpl1-heading", "fsf-copies")),
    ("GPL-1.0", ("gpl1-heading",)),
    ("GPL-2.0", ("gpl2-heading", "fsf-copies")),
    ("GPL-2.0", ("gpl2-heading",)),
    ("GPL-3.0", ("gpl3-heading", "fsf-copies")),
    ("GPL-3.0", ("gpl3-heading",)),
    ("LGPL-2.0", ("lgpl2-heading", "fsf-copies")),
    ("LGPL-2.0", ("lgpl2-heading",)),
    ("LGPL-2.1", ("lgpl21-heading", "fsf-copies")),
    ("LGPL-2.1", ("lgpl21-heading",)),
    ("LGPL-2.1-or-later", ("lgpl21-library",)),
    ("LGPL-3.0", ("lgpl3-heading", "fsf-copies")),
    ("LGPL-3.0", ("lgpl3-heading",)),
    ("LGPL-3.0-or-later", ("lgpl3-program",)),
    ("AGPL-3.0", ("agpl3-heading", "fsf-copies")),
    ("AGPL-3.0", ("agpl3-heading",)),
    ("AGPL-3.0-or-later", ("agpl3-program",)),
    ("GFDL-1.3", ("gfdl13-heading", "fsf-copies")),
    ("GFDL-1.3", ("gfdl13-heading",)),
    ("LGPL-3.0", ("lgpl3-work",)),
    ("AGPL-3.0", ("agpl3-work",)),
    ("MPL-2.0", ("mpl2-form", "mpl2-copy")),
    ("MPL-2.0", ("mpl2-form",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-4",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4",)),
    ("CC0-1.0", ("cc0",)),
    ("MPL-2.0", ("mpl2-heading",)),
    ("MPL-1.1", ("mpl11-heading",)),
    ("EPL-2.0", ("epl2-heading",)),
    ("EPL-2.0", ("epl2-notice",)),
    ("CC-BY-4.0", ("cc-by-4-heading",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-heading",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-heading",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-4-heading",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4-heading",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-4-heading",)),
    ("CC-BY-4.0", ("cc-by-4-work",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-work",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-work",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4-work",)),
    ("CC0-1.0", ("cc0-heading",)),
    ("Artistic-2.0", ("artistic2-heading",)),
    ("OFL-1.1", ("ofl11-heading",)),
    ("Unlicense", ("unlicense", "unlicense-anyone")),
    ("Unlicense", ("unlicense",)),
    ("All-Rights-Reserved", ("rights-reserved",)),
]
# Identifiers of the public list that an SPDX line may name
SPDX = ["0BSD", "AFL-3.0", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.1", "Apache-2.0", "Artistic-1.0", "Artistic-2.0",
        "BSD-1-Clause", "BSD-2-Clause", "BSD-2-Clause-Patent", "BSD-3-Clause", "BSD-3-Clause-Clear", "BSD-4-Clause", "BSL-1.0", "CC-BY-3.0", "CC-BY-4.0",
        "CC-BY-NC-4.0", "CC-BY-NC-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC0-1.0", "CDDL-1.0", "CDDL-1.1",
        "CECILL-2.1", "ECL-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.1", "EUPL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later",
        "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.0", "LGPL-2.0-only", "LGPL-2.0-or-later", "LGPL-2.1", "LGPL-2.1-only",
        "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "LPPL-1.3c", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "MS-PL", "MS-RL",
        "MulanPSL-2.0", "NCSA", "ODbL-1.0", "OFL-1.1", "OSL-3.0", "PostgreSQL", "PSF-2.0", "Python-2.0", "Ruby", "UPL-1.0", "Unicode-3.0",
        "Unlicense", "Vim", "W3C", "WTFPL", "X11", "Zlib", "ZPL-2.1"]
_SPDX = {x.lower(): x for x in SPDX}
_SPDX_WORDS = ["spdx", "license", "identifier"]
#: A text without any of these words is looked at no further, if every known sentence holds one.
KEY_WORDS = ["licen", "permission", "redistribution", "copyright", "rights", "warrant", "mpl", "unencumbered", "cc0", "liable", "terms and conditions",
             "permitted", "anyone is free", "advertising materials"]
#: May stand between the sentences of one rule.
FILLERS = {"copyright", "rights-reserved"}
MOST_CHARS = 20_000_000

_WORD = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s")
_ID = re.compile(r"[a-z0-9][a-z0-9.+-]*")


def cut_words(low: str) -> tuple[list[str], list[bool], list[bool], list[int]]:
    """Words of a lower-case text, whether a sentence can begin at each and end after it, and
    where each ends."""
    words, starts, ends, stops = [], [], [], []
    last = 0
    for m in _WORD.finditer(low):
        gap = low[last : m.start()]
        # a sentence end is a mark followed by white space; a line end counts as well
        cut = "\n" in gap or "\r" in gap or any(c in ".!?:;" and i + 1 < len(gap) and _SPACE.match(gap[i + 1]) for i, c in enumerate(gap))
        if words:
            ends.append(cut)
        starts.append(not words or cut)
        words.append(m.group())
        stops.append(m.end())
        last = m.end()
    if words:
        ends.append(True)
    return words, starts, ends, stops


class Rules:
    """Known sentences as a word trie, and the ordered rules by their first sentence."""

    def __init__(self, sentences: dict[str, str], rules: list[tuple[str, tuple[str, ...]]]):
        self.sentences, self.rules = sentences, rules
        self.trie: dict = {}
        for name, text in sentences.items():
            node = self.trie
            for w in text.split():
                node = node.setdefault(w, {})
            node.setdefault("", name)
        self.by_first: dict[str, list[tuple[str, tuple[str, ...]]]] = {}
        for r in sorted(rules, key=lambda r: -len(r[1])):
            self.by_first.setdefault(r[1][0], []).append(r)
        self.filtered = all(any(k in s for k in KEY_WORDS) for s in sentences.values())

    def recognise(self, text: str) -> list[str]:
        """Identifiers of the known sentences of a text, in its order."""
        low = text.lower()
        words, starts, ends, stops = cut_words(low)
        found, i = [], 0
        while i < len(words):
            name, stop = None, i
            if starts[i]:
                if words[i] == "spdx" and words[i : i + 3] == _SPDX_WORDS:
                    line = re.split(r"[\r\n]", low[stops[i + 2] :], maxsplit=1)[0]
                    ids = [x.rstrip(".-") for x in _ID.findall(line)]
                    found += [f"spdx:{_SPDX[x.removesuffix('+')]}" for x in ids if x.removesuffix("+") in _SPDX]
                    i += 3
                    while i < len(words) and not starts[i]:
                        i += 1
                    continue
                if words[i] == "copyright":
                    name, stop = "copyright", i + 1
                node, j = self.trie, i
                while j < len(words) and words[j] in node:
                    node = node[words[j]]
                    j += 1
                    if "" in node and ends[j - 1]:
                        name, stop = node[""], j
            if name:
                found.append(name)
                i = stop
            else:
                i += 1
        return found

    def match(self, ids: list[str]) -> tuple[list[str], int]:
        """(licences in order, recognised licence sentences that belong to no complete rule)."""
        used, out = [False] * len(ids), []
        for i in range(len(ids)):
            if used[i]:
                continue
            if ids[i].startswith("spdx:"):
                used[i] = True
                out.append(ids[i][5:])
                continue
            for name, parts in self.by_first.get(ids[i], ()):
                at, j = [], i
                for p in parts:
                    while at and j < len(ids) and ids[j] != p and ids[j] in FILLERS:
                        j += 1
                    if j >= len(ids) or ids[j] != p or used[j]:
                        break
                    at.append(j)
                    j += 1
                if len(at) == len(parts):
                    for k in at:
                        used[k] = True
                    out.append(name)
                    break
        return out, sum(1 for i, u in zip(ids, used, strict=True) if not u and i != "copyright")


def with_texts(texts: list[tuple[str, str]], sentences: dict[str, str] = SENTENCES, rules: list = RULES) -> Rules:
    """The table with whole licence texts (licence, text) added: each is cut into its sentences,
    known ones keep their identifiers, new ones get ``<licence>#<number>``; all in order are a rule."""
    known = {s: name for name, s in sentences.items()}
    given = [(licence, text) for licence, text in texts if text]
    for licence, text in given:
        words, _, ends, _ = cut_words(one_line(text.lower()))
        sentence: list[str] = []
        for w, end in zip(words, ends, strict=True):
            sentence.append(w)
            if end:
                known.setdefault(" ".join(sentence), f"{licence}#{len(known)}")
                sentence = []
    # a rule is what the scan reads in its own text: a longer known sentence may span several
    table = Rules({name: s for s, name in known.items()}, [])
    more = [(licence, tuple(x for x in table.recognise(text) if x not in FILLERS)) for licence, text in given]
    return Rules(table.sentences, [r for r in more if r[1]] + list(rules))


def one_line(text: str) -> str:
    """The lines of each paragraph joined."""
    return re.sub(r"(?<=\S)[ \t]*\r?\n[ \t]*(?=\S)", " ", text)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", texts: DataFrame | None = None) -> DataFrame:
    """Per row: key, licenses, sentence_ids, n_unmatched.  ``texts``: whole licence texts to know
    besides the built-in table (licence, text)."""
    kind = docs.schema[key].dataType.simpleString()
    given = []
    if texts is not None:
        size = texts.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
        if size > MOST_CHARS:
            raise ValueError(f"licence texts of {size} characters, the limit is {MOST_CHARS}")
        given = [tuple(r) for r in texts.where("text IS NOT NULL").select("licence", "text").orderBy("licence", "text").collect()]
    rules = with_texts(given)
    shared = docs.sparkSession.sparkContext.broadcast(rules)
    low = F.lower(F.col(text))
    held = F.lit(not rules.filtered)
    for w in [*KEY_WORDS, "spdx"]:
        held = held | low.contains(w)

    def run(batches):
        known = shared.value
        for batch in batches:
            for part in sub_batches(batch, "t"):
                ids = [known.recognise(t) if t else [] for t in part.column(1).to_pylist()]
                got = [known.match(x) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g[0] for g in got], pa.list_(pa.string())), pa.array(ids, pa.list_(pa.string())), pa.array([g[1] for g in got], pa.int64())], names=["k", "licenses", "sentence_ids", "n_unmatched"])

    src = docs.select(F.col(key).alias("k"), F.when(held, F.col(text)).alias("t"))
    return src.mapInArrow(run, f"k {kind}, licenses array<string>, sentence_ids array<string>, n_unmatched long").withColumnRenamed("k", key)


@query("op7_licenses")
def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences recognised in every document."""
    return scan(table(spark, sf_dir, "documents"))
