"""License scan by sentences: known licence sentences become identifiers, ordered rules match identifier sequences.

A text is split into sentences: at ends of sentences, at blank lines, before list marks and
comment marks, and where a line ends in a stop. A sentence is normalised (lower case, plain quotes and
dashes, comment and list marks away, white space as one space, copyright holders and years as one mark, "licence" as "license")
and looked up among the known sentences: as a whole, by its parts between semicolons, and by what begins at one of its lines, as
texts run into each other. Reference sentences name a licence by a phrase
("licensed under the ...", "distributed under the terms of ...") and a name from the list of public licences, or several
("either of A or B", "A and B"; under "dual" they are a choice); a phrase behind a negation names none.
SPDX expressions are parsed into a tree: identifiers, ``+``, WITH, AND, OR and brackets; "-only" counts as no suffix, an
exception stays with its licence, an unknown identifier keeps its case. Of OR the best branch counts for the verdict, of AND the worst. Rules are tried in
order: each matches its identifiers in sequence, with at most ``gap`` characters
of other text between two, and uses up the sentences it matched.

NULL and empty texts have no licence. Repeated rows scan alike; of two rules at
one place the earlier counts. Texts of any length are scanned whole, in time linear in their length and, for
every rule, in the number of known sentences. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, lean

# Public licences by SPDX identifier, with the names that reference sentences use, and what they permit (fixed values).
NAMES = {
    "Apache-2.0": ["apache license, version 2.0", "apache license version 2.0", "apache license 2.0", "apache 2.0 license", "apache 2.0", "apache software license 2.0", "apache-2.0", "apache-2.0 license", "apache license, version 2.0 (the \"license\")"],
    "MIT": ["mit license", "mit", "mit/x11 license", "expat license", "mit license (mit)"],
    "BSD-2-Clause": ["bsd 2-clause license", "2-clause bsd license", "simplified bsd license", "bsd-2-clause", "bsd-2-clause license", "freebsd license"],
    "BSD-3-Clause": ["bsd 3-clause license", "3-clause bsd license", "new bsd license", "modified bsd license", "revised bsd license", "bsd-3-clause", "bsd-3-clause license", "bsd license", "bsd-style license"],
    "ISC": ["isc license", "isc"],
    "Zlib": ["zlib license", "zlib/libpng license", "zlib"],
    "BSL-1.0": ["boost software license, version 1.0", "boost software license 1.0", "boost software license"],
    "Unlicense": ["unlicense", "the unlicense"],
    "CC0-1.0": ["cc0 1.0", "cc0", "cc0 1.0 universal", "creative commons zero v1.0 universal", "creative commons cc0 1.0 universal license", "cc0 1.0 universal public domain dedication"],
    "GPL-2.0": ["gnu general public license, version 2", "gnu general public license version 2", "gnu general public license v2.0", "gnu general public license v2", "gnu gpl v2", "gnu gpl version 2", "gplv2", "gpl v2", "gpl version 2", "gpl-2.0"],
    "GPL-3.0": ["gnu general public license, version 3", "gnu general public license version 3", "gnu general public license v3.0", "gnu general public license v3", "gnu gpl v3", "gnu gpl version 3", "gplv3", "gpl v3", "gpl version 3", "gpl-3.0"],
    "GPL": ["gnu general public license", "gnu gpl", "gpl"],
    "LGPL-2.1": ["gnu lesser general public license, version 2.1", "gnu lesser general public license version 2.1", "gnu lesser general public license v2.1", "lgpl v2.1", "lgplv2.1", "lgpl-2.1", "gnu lgpl version 2.1"],
    "LGPL-3.0": ["gnu lesser general public license, version 3", "gnu lesser general public license version 3", "gnu lesser general public license v3.0", "gnu lesser general public license v3", "lgpl v3", "lgplv3", "lgpl-3.0"],
    "LGPL": ["gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lgpl"],
    "AGPL-3.0": ["gnu affero general public license, version 3", "gnu affero general public license version 3", "gnu affero general public license v3.0", "gnu affero general public license v3", "gnu affero general public license", "agplv3", "agpl v3", "agpl-3.0", "gnu agpl v3", "gnu agpl"],
    "MPL-1.1": ["mozilla public license, version 1.1", "mozilla public license version 1.1", "mpl 1.1", "mpl-1.1"],
    "MPL-2.0": ["mozilla public license, version 2.0", "mozilla public license version 2.0", "mozilla public license, v. 2.0", "mozilla public license 2.0", "mpl 2.0", "mpl-2.0", "mpl v2.0"],
    "EPL-1.0": ["eclipse public license, version 1.0", "eclipse public license v1.0", "eclipse public license - v 1.0", "eclipse public license 1.0", "epl-1.0"],
    "EPL-2.0": ["eclipse public license, version 2.0", "eclipse public license v2.0", "eclipse public license - v 2.0", "eclipse public license 2.0", "epl-2.0"],
    "EUPL-1.2": ["european union public licence v. 1.2", "european union public license v. 1.2", "european union public license 1.2", "eupl-1.2", "eupl v1.2"],
    "CDDL-1.0": ["common development and distribution license 1.0", "common development and distribution license, version 1.0", "common development and distribution license", "cddl 1.0", "cddl-1.0"],
    "Artistic-2.0": ["artistic license 2.0", "artistic license, version 2.0", "artistic-2.0"],
    "PSF-2.0": ["python software foundation license", "psf license", "python software foundation license version 2"],
    "WTFPL": ["do what the fuck you want to public license", "wtfpl"],
    "OFL-1.1": ["sil open font license, version 1.1", "sil open font license 1.1", "sil open font license", "ofl-1.1"],
    "CC-BY-4.0": ["cc by 4.0", "cc-by-4.0", "cc by 4.0 license", "creative commons attribution 4.0 international license", "creative commons attribution 4.0 international", "creative commons attribution 4.0 license"],
    "CC-BY-3.0": ["cc by 3.0", "cc-by-3.0", "creative commons attribution 3.0 unported license", "creative commons attribution 3.0 license"],
    "CC-BY-SA-4.0": ["cc by-sa 4.0", "cc-by-sa-4.0", "cc by-sa 4.0 license", "creative commons attribution-sharealike 4.0 international license", "creative commons attribution-sharealike 4.0 international", "creative commons attribution-sharealike 4.0 license"],
    "CC-BY-SA-3.0": ["cc by-sa 3.0", "cc-by-sa-3.0", "creative commons attribution-sharealike 3.0 unported license", "creative commons attribution-sharealike license"],
    "CC-BY-NC-4.0": ["cc by-nc 4.0", "cc-by-nc-4.0", "cc by-nc 4.0 license", "creative commons attribution-noncommercial 4.0 international license", "creative commons attribution-noncommercial 4.0 international"],
    "CC-BY-ND-4.0": ["cc by-nd 4.0", "cc-by-nd-4.0", "creative commons attribution-noderivatives 4.0 international license"],
    "CC-BY-NC-SA-4.0": ["cc by-nc-sa 4.0", "cc-by-nc-sa-4.0", "creative commons attribution-noncommercial-sharealike 4.0 international license"],
    "CC-BY-NC-ND-4.0": ["cc by-nc-nd 4.0", "cc-by-nc-nd-4.0", "creative commons attribution-noncommercial-noderivatives 4.0 international license"],
    "OpenRAIL-M": ["openrail-m license", "creativeml open rail-m license", "openrail-m"],
}
#: What stands before a licence's name in a reference sentence, at its beginning or behind a subject (fixed values).
PHRASES = ["licensed under", "is licensed under", "are licensed under", "released under", "is released under", "distributed under", "is distributed under", "made available under", "is made available under", "is available under", "available under", "provided under", "is provided under", "published under", "is published under", "covered by", "is covered by", "subject to the terms of", "is subject to the terms of", "governed by", "is governed by", "use of this source code is governed by", "license:", "licensed:", "licence:", "under"]
# Sentences of licence texts and notices by identifier (fixed values).
SENTENCES = {
    "apache-comply": ["you may not use this file except in compliance with the license"],
    "apache-obtain": ["you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0", "you may obtain a copy of the license at https://www.apache.org/licenses/license-2.0", "you may obtain a copy of the license at"],
    "apache-basis": ["unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an \"as is\" basis, without warranties or conditions of any kind, either express or implied"],
    "mit-grant": ["permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"software\"), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions"],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit-as-is": ["the software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement"],
    "isc-grant": ["permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "zlib-grant": ["permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "bsd-grant": ["redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-endorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "gpl2-free": ["this program is free software; you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation; either version 2 of the license, or (at your option) any later version"],
    "gpl3-free": ["this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version"],
    "agpl3-free": ["this program is free software: you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version"],
    "lgpl21-free": ["this library is free software; you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation; either version 2.1 of the license, or (at your option) any later version"],
    "lgpl3-free": ["this library is free software: you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version"],
    "gpl-hope": ["this program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose", "this library is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose"],
    "mpl2-notice": ["this source code form is subject to the terms of the mozilla public license, v. 2.0"],
    "mpl2-obtain": ["if a copy of the mpl was not distributed with this file, you can obtain one at https://mozilla.org/mpl/2.0/", "if a copy of the mpl was not distributed with this file, you can obtain one at http://mozilla.org/mpl/2.0/"],
    "unlicense-free": ["this is free and unencumbered software released into the public domain"],
    "boost-grant": ["permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"software\") to use, reproduce, display, distribute, execute, and transmit the software, and to prepare derivative works of the software, and to permit third-parties to whom the software is furnished to do so, all subject to the following"],
    "all-rights": ["all rights reserved"],
    "public-domain": ["this work is in the public domain", "released into the public domain", "this file is in the public domain"],
}
# (licence, identifiers) in order of precedence; "name:X" is a reference to X (fixed values).
RULES = [
    ("Apache-2.0", ["name:Apache-2.0", "apache-comply", "apache-obtain", "apache-basis"]),
    ("Apache-2.0", ["name:Apache-2.0", "apache-comply", "apache-obtain"]),
    ("Apache-2.0", ["name:Apache-2.0", "apache-comply"]),
    ("MIT", ["name:MIT", "mit-grant", "mit-notice", "mit-as-is"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-3.0-or-later", ["gpl3-free", "gpl-hope"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope"]),
    ("AGPL-3.0-or-later", ["agpl3-free", "gpl-hope"]),
    ("LGPL-2.1-or-later", ["lgpl21-free", "gpl-hope"]),
    ("LGPL-3.0-or-later", ["lgpl3-free", "gpl-hope"]),
    ("MPL-2.0", ["mpl2-notice", "mpl2-obtain"]),
    ("GPL-3.0-or-later", ["gpl3-free"]),
    ("GPL-2.0-or-later", ["gpl2-free"]),
    ("AGPL-3.0-or-later", ["agpl3-free"]),
    ("LGPL-2.1-or-later", ["lgpl21-free"]),
    ("LGPL-3.0-or-later", ["lgpl3-free"]),
    ("MPL-2.0", ["mpl2-notice"]),
    ("MIT", ["mit-grant"]),
    ("ISC", ["isc-grant"]),
    ("Zlib", ["zlib-grant"]),
    ("BSL-1.0", ["boost-grant"]),
    ("Unlicense", ["unlicense-free"]),
    *[(name, [f"name:{name}"]) for name in NAMES],
    ("Public-Domain", ["public-domain"]),
    ("Proprietary", ["all-rights"]),
]
PERMISSIVE = frozenset({"Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "BSL-1.0", "Unlicense", "CC0-1.0", "PSF-2.0", "WTFPL", "CC-BY-4.0", "CC-BY-3.0", "Public-Domain"})
GAP = 400

_QUOTES = str.maketrans({"“": '"', "”": '"', "‘": "'", "’": "'", "–": "-", "—": "-", " ": " "})
#: Marks of comments and lists at the beginning of a line, those of lists alone, and marks that close a comment.
_MARKS = re.compile(r"^(?:[\s*#>%|;]|//+|/\*+|<!--|\(?(?:[0-9]{1,2}|[a-z])[.)](?=\s)|-{1,2}(?=\s)|(?:rem|dnl)\s)+")
_LISTED = re.compile(r"[\s*#>%|;/]*(?:\(?(?:[0-9]{1,2}|[a-z])[.)]|-)\s")
_CLOSES = re.compile(r"\s*(?:\*+/|-->)\s*$")
_TAIL = re.compile(r"[\s.;:,!]+$")
#: A sentence ends behind a stop before white space; abbreviations of versions do not end one.
_END = re.compile(r"(?:(?<!\bv)(?<!\bno)[.!?]|(?<!identifier)(?<!license)(?<!licensed):)(?=[\"')]?(?:\s|$))[\"')]?|;(?=\s(?:and|or)\s*$)")
_NOTICE = re.compile(r"^(?:copyright|\(c\)|©).{0,300}?(?=all rights reserved|$)")
_SPDX = re.compile(r"spdx-license-identifier:\s*(.*)$")
_SPDX_TOKEN = re.compile(r"\(|\)|[a-z0-9][a-z0-9.\-]*\+?")
_SPELT = re.compile(r"[A-Za-z0-9][A-Za-z0-9.\-]*\+?")
_NEGATED = re.compile(r"(?:\b(?:not|never|neither|no longer)|n't)(?: (?:yet|currently|be|been))?\s*$")
_CHOICE = re.compile(r"^(?:either (?:of )?|both (?:of )?|one of |your choice of |any of )?")
_NEXT = re.compile(r"(?:\s*licen[sc]es?)?(?:\s*\([^)]{0,40}\))?\s*,?\s*(and/or|and|or)\s+(?:either\s+)?(?:the |a |an )?(?:terms of (?:the )?)?")
_THE = re.compile(r"^(?:the |a |an )?(?:terms (?:and conditions )?of |conditions of )?(?:the |a |an )?")


def _names() -> dict[str, str]:
    return {v: f"name:{name}" for name, variants in NAMES.items() for v in variants}


class Scanner:
    def __init__(self, sentences: dict[str, list[str]] | None = None, rules: list | None = None, gap: int = GAP):
        self.rules, self.gap = rules or RULES, gap
        self.known = {v: name for name, variants in (sentences or SENTENCES).items() for v in variants}
        self.names = _names()
        self.spdx = {name.lower(): name for name in NAMES}
        self.phrase = re.compile(r"(?:^|\s)(?:" + "|".join(re.escape(p) for p in sorted(PHRASES, key=len, reverse=True)) + r")\s+")
        #: a sentence without any of these words is no licence sentence
        self.words = re.compile("licen[sc]|spdx|permi|redistribut|copyright|rights reserved|public domain|free software|warrant|neither the name|this program|this library|you may|mpl|software is provided|unless required")
        self.longest = max(map(len, self.known), default=0)
        self.heads = {" ".join(v.split()[:3]) for v in self.known}

    def paragraphs(self, text: str) -> Iterator[tuple[int, list[str]]]:
        """(place, normalised lines): lines up to a blank line or a list mark; places count characters of the normalised text."""
        at, held, start = 0, [], 0
        for line in text.split("\n"):
            low = line.strip().lower().translate(_QUOTES)
            s = _CLOSES.sub("", _MARKS.sub("", low))
            s = " ".join(s.split()).replace("licence", "license") if s else s
            if held and (not s or _LISTED.match(low)):
                yield start, held
                held = []
            if s:
                if not held:
                    start = at
                held.append(s)
                at += len(s) + 1
        if held:
            yield start, held

    def _sentences(self, lines: list[str]) -> Iterator[tuple[int, int, list[int]]]:
        """(from, to, places of line starts inside) of the sentences of a paragraph."""
        paragraph, starts, at = " ".join(lines), [], 0
        for s in lines:
            starts.append(at)
            at += len(s) + 1
        at, k = 0, 0
        for end in [*(m.end() for m in _END.finditer(paragraph)), len(paragraph)]:
            if end <= at:
                continue
            inside = []
            while k < len(starts) and starts[k] < end:
                if starts[k] > at:
                    inside.append(starts[k])
                k += 1
            yield at, end, inside
            at = end

    def _found(self, paragraph: str, a: int, b: int, inside: list[int]) -> Iterator[tuple[int, int, str]]:
        """Known sentences in a sentence: the whole, its parts between semicolons, or what begins at one of its lines."""
        whole = paragraph[a:b].strip()
        if not self.words.search(whole):
            return
        got = self._lookup(whole) if len(whole) <= self.longest + 9 else None
        if got is None and "; " in whole:
            at, some = a, []
            for part in paragraph[a:b].split("; "):
                name = self.identify(part.strip())
                if name:
                    some.append((at, at + len(part), name))
                at += len(part) + 2
            if some:
                yield from some
                return
        got = got or self.identify(whole)
        if got:
            yield a, b, got
            return
        edges, done = [a, *inside, b], a
        for i, x in enumerate(edges[:-1]):
            if x < done:
                continue
            # a sentence of several lines, the longest first, or a line by itself
            if " ".join(paragraph[x : x + 80].split()[:3]) in self.heads:
                last = i + 1
                while last + 1 < len(edges) and edges[last + 1] - x <= self.longest + 9:
                    last += 1
                for j in range(last, i, -1):
                    name = self._lookup(paragraph[x : edges[j]].strip())
                    if name:
                        yield x, edges[j], name
                        done = edges[j]
                        break
            if done <= x and inside:
                line = paragraph[x : edges[i + 1]].strip()
                name = self.identify(line) if self.words.search(line) else None
                if name:
                    yield x, edges[i + 1], name
                    done = edges[i + 1]

    def _lookup(self, sentence: str) -> str | None:
        return self.known.get(_TAIL.sub("", sentence).strip(" \"'")) or self.known.get(sentence)

    def identify(self, sentence: str) -> str | None:
        """Identifier of a normalised sentence."""
        got = self._lookup(sentence) if len(sentence) <= self.longest + 9 else None
        if got:
            return got
        if sentence.startswith(("copyright", "(c)", "©")):
            return self._lookup(_NOTICE.sub("", sentence[:600], count=1).strip())
        m = _SPDX.search(sentence)
        if m:
            return "spdx:" + _CLOSES.sub("", m.group(1)).strip()
        s = _TAIL.sub("", sentence)
        for m in self.phrase.finditer(s):
            if _NEGATED.search(s[max(0, m.start() - 20) : m.start()]):
                continue
            got = self._names_in(s[m.end() : m.end() + 240], "dual" in s[max(0, m.start() - 20) : m.start()])
            if got:
                return got
        return self.names.get(_THE.sub("", s, count=1)) if 8 < len(s) < 200 else None

    def _names_in(self, rest: str, dual: bool) -> str | None:
        """The licence that a text begins with, or several as an expression."""
        plain = _THE.sub("", rest, count=1)
        chosen = _CHOICE.match(plain).end()
        choice = dual or plain[:chosen].startswith(("either", "one", "your", "any"))
        plain = _THE.sub("", plain[chosen:], count=1)
        found, at, words = [], 0, []
        while one := self._name(plain[at:]):
            found.append(one[0])
            at += one[1]
            more = _NEXT.match(plain, at)
            if not more:
                break
            words.append(more[1])
            at = more.end()
        if len(found) < 2:
            return found[0] if found else None
        return "spdx:" + (" or " if choice or any(w != "and" for w in words) else " and ").join(x[5:].lower() for x in found)

    def _name(self, rest: str) -> tuple[str, int] | None:
        """The longest licence name that begins a text, at a word's end, and where it ends."""
        ends = [m.end() for m in re.finditer(r"[^\s,;()]+[,;()]?", rest[:120])]
        for end in reversed(ends):
            for name in (rest[:end], rest[:end].rstrip(",;.)")):
                got = self.names.get(name)
                if got:
                    later = rest[end : end + 40]
                    return got + ("-or-later" if got[5:].startswith(("GPL-", "LGPL-", "AGPL-")) and ("or later" in later or "any later" in later) else ""), len(name)
        return None

    def expression(self, text: str, spelling: dict[str, str] | None = None) -> tuple[list[str], bool]:
        """Licences of an SPDX expression in order, and whether it permits: any branch of OR, all of AND.

        An unknown identifier keeps its spelling; what does not parse is read as a list.
        """
        tokens, at, out = _SPDX_TOKEN.findall(text), 0, []
        spelling = spelling or {}

        def licence(token: str) -> str:
            base, suffix = token, ""
            for mark, put in (("-or-later", "-or-later"), ("-only", ""), ("+", "-or-later")):
                if token.endswith(mark):
                    base, suffix = token[: -len(mark)], put
            return self.spdx.get(base, spelling.get(token, token)[: len(base)]) + suffix

        # brackets open and close a level: (operands of the whole OR, operands of the running AND)
        levels: list[tuple[list[bool], list[bool]]] = [([], [])]
        while at < len(tokens):
            token = tokens[at]
            at += 1
            if token == "(":
                levels.append(([], []))
            elif token == ")" and len(levels) > 1:
                some, every = levels.pop()
                levels[-1][1].append(any([*some, *([all(every)] if every else [])]))
            elif token == "or":
                some, every = levels[-1]
                some.append(all(every) if every else False)
                every.clear()
            elif token not in (")", "and", "with"):
                name = licence(token)
                good = permissive(name)
                if at + 1 < len(tokens) and tokens[at] == "with":
                    name += " WITH " + spelling.get(tokens[at + 1], tokens[at + 1])
                    at += 2
                out.append(name)
                levels[-1][1].append(good)
        result = True
        for some, every in levels:
            result = result and any([*some, *([all(every)] if every else [])]) if some or every else result
        return out, result

    def sentences(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, identifier) of known sentences, in order."""
        out = []
        if not self.words.search(text.lower()):
            return out
        for at, lines in self.paragraphs(text):
            paragraph = " ".join(lines)
            if self.words.search(paragraph):
                for a, b, inside in self._sentences(lines):
                    out.extend((at + x, at + y, name) for x, y, name in self._found(paragraph, a, b, inside))
        return out

    def scan(self, text: str | None) -> tuple[list[str], list[tuple[int, int, str]]]:
        """Licences in the order of their place, and the known sentences."""
        hits, known = self._hits(text)
        return [x[2] for x in hits], known

    def judge(self, text: str | None) -> tuple[list[str], list[tuple[int, int, str]], str]:
        """Licences, known sentences, and none, permissive or restricted."""
        hits, known = self._hits(text)
        verdict = "none" if not hits else "permissive" if all(x[3] for x in hits) else "restricted"
        return [x[2] for x in hits], known, verdict

    def _hits(self, text: str | None) -> tuple[list[tuple[int, int, str, bool]], list[tuple[int, int, str]]]:
        """(place, number, licence, whether it or its expression permits) in order, and the known sentences."""
        if not text:
            return [], []
        known = self.sentences(text)
        hits: list[tuple[int, int, str, bool]] = []
        lines = [x for x in text.split("\n") if "spdx" in x.lower()] if any(x[2].startswith("spdx:") for x in known) else []
        spelling = {t.lower(): t for x in lines for t in _SPELT.findall(x)}
        left: dict[str, int] = {}
        for i, (a, _, name) in enumerate(known):
            if name.startswith("spdx:"):
                found, good = self.expression(name[5:], spelling)
                hits += [(a, j, x, good) for j, x in enumerate(found)]
            else:
                left[name] = left.get(name, 0) + 1
                if name.endswith("-or-later") and name.startswith("name:"):
                    hits.append((a, i, name[5:], permissive(name[5:])))
        free = [i for i, x in enumerate(known) if not x[2].startswith("spdx:") and not (x[2].startswith("name:") and x[2].endswith("-or-later"))]
        for licence, want in self.rules:
            if not all(left.get(w) for w in want):
                continue
            used: set[int] = set()
            for i in range(len(free)):
                chain = self._chain(known, free, i, want, used) if i not in used else None
                if chain is not None:
                    hits.append((known[free[chain[0]]][0], free[chain[0]], licence, permissive(licence)))
                    used.update(chain)
                    for w in want:
                        left[w] -= 1
            if used:
                free = [x for i, x in enumerate(free) if i not in used]
        return sorted(hits), known

    def _chain(self, known: list, free: list[int], i: int, want: list[str], used: set[int]) -> list[int] | None:
        """Indices in ``free`` of a rule's identifiers in sequence from i on, or None; looks no further than the gap allows."""
        if known[free[i]][2] != want[0]:
            return None
        chain, j = [i], i + 1
        for w in want[1:]:
            end = known[free[chain[-1]]][1] + self.gap
            while j < len(free) and (j in used or known[free[j]][2] != w) and known[free[j]][0] <= end:
                j += 1
            if j >= len(free) or known[free[j]][2] != w or known[free[j]][0] > end:
                return None
            chain.append(j)
            j += 1
        return chain


def permissive(licence: str) -> bool:
    return licence in PERMISSIVE


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, licences in order, identifiers, n_sentences, verdict): verdict is none, permissive or restricted."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for b in batches:
            lic, ids, n, verdict = [], [], [], []
            for t in b.column(1).to_pylist():
                found, known, said = scanner.judge(t)
                lic.append(found)
                ids.append([x[2] for x in known])
                n.append(len(known))
                verdict.append(said)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lic, pa.list_(pa.string())), pa.array(ids, pa.list_(pa.string())), pa.array(n, pa.int64()), pa.array(verdict, pa.string())], names=[key, "licences", "sentences", "n_sentences", "verdict"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key), F.col(text)).mapInArrow(lean(run), f"`{key}` {kind}, licences array<string>, sentences array<string>, n_sentences long, verdict string")
