"""Licence scan by sentence rules (DataFrame functions only).

A text is cut into sentences, by line and, for licence texts wrapped over lines, by paragraph. Each
sentence is normalised (lower case, runs of other signs one space, owners named in it masked) and mapped to
the identifiers of known licence sentences: it is one, it is an SPDX expression or a label with one, or it
says that something is under licences of known names, but not what it says to be under no longer or not. A
sentence with several identifiers joins them by |. The identifiers in text order are then held against
ordered rules. A rule asks for its identifiers in order, with anything
between (joined by + they must be next to each other); the rules of one licence go from most to least
specific and the first that matches counts. Every step is an expression over one row, so nothing is shuffled.

Texts that lack all ANCHORS aren't cut: a known sentence holds one of these words, and a word of a normalised
sentence stands in the lower-case text as it is, between other signs.

Covered are the licences of NAMES; of the GNU ones, "only" and "or later" are licences of their own. Defined results: a null, empty or blank text has no sentences and no
licence; repeated sentences are listed as often as they occur; equal rows give equal results; an empty table
gives no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ASIS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
_TERMS = "you can redistribute it and or modify it under the terms of the {} as published by the free software foundation"
_LATER = "either version {} of the license or at your option any later version"
#: Stands for what differs from text to text; (regex, what it becomes) over normalised sentences.
_SLOT = "xslotx"
SLOTS = [
    (r"^(?:[0-9] )?neither the name of .{1,200}? nor the names of (?:its|their|the|any|other) contributors ", f"neither the name of {_SLOT} nor the names of {_SLOT} contributors "),
    (r"^(?:[0-9] )?neither the names? of .{1,200}? nor the names of (?:its|their|the|any|other) contributors ", f"neither the name of {_SLOT} nor the names of {_SLOT} contributors "),
    (r"^(?:[0-9] )?the names? of .{1,200}? may not be used to endorse ", f"the name of {_SLOT} may not be used to endorse "),
]

# Identifiers and texts of licence sentences, normalised as below.
SENTENCES = {
    "apache2-head": ["licensed under the apache license version 2 0 the license"],
    "apache2-comply": ["you may not use this file except in compliance with the license"],
    "apache2-copy": ["you may obtain a copy of the license at"],
    "apache2-asis": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "asis-software": [_ASIS],
    "isc-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "isc0-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "bsd-redist": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-noendorse": [f"neither the name of {_SLOT} nor the names of {_SLOT} contributors may be used to endorse or promote products derived from this software without specific prior written permission", f"the name of {_SLOT} may not be used to endorse or promote products derived from this software without specific prior written permission"],
    "zlib-grant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "zlib-origin": ["the origin of this software must not be misrepresented", "1 the origin of this software must not be misrepresented"],
    "boost-grant": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"],
    "unlicense-free": ["this is free and unencumbered software released into the public domain"],
    "unlicense-anyone": ["anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"],
    "mpl2-head": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "mpl2-copy": ["if a copy of the mpl was not distributed with this file you can obtain one at"],
    "epl2-head": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0"],
    "gpl-free": ["this program is free software", "this library is free software"],
    "gpl-terms": [_TERMS.format("gnu general public license")],
    "lgpl-terms": [_TERMS.format("gnu lesser general public license")],
    "agpl-terms": [_TERMS.format("gnu affero general public license")],
    **{f"later-{v.replace(' ', '')}": [_LATER.format(v)] for v in ("2", "2 1", "3")},
    **{f"{f}-terms-{v.replace(' ', '')}": [f"{_TERMS.format(f'gnu {long}general public license')} {_LATER.format(v)}"] for f, long, v in (("gpl", "", "2"), ("gpl", "", "3"), ("lgpl", "lesser ", "2 1"), ("lgpl", "lesser ", "3"), ("agpl", "affero ", "3"))},
    "cc0-dedication": ["the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"],
    "reserved": ["all rights reserved"],
    "spdx": ["spdx license identifier"],
}

# What a sentence calls a licence that something is under. Longer names come first.
NAMES = {
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache license v2 0", "apache 2 0 license", "apache 2 0"],
    "MIT": ["mit license", "expat license"],
    "ISC": ["isc license"],
    "BSD-3-Clause": ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license", "revised bsd license"],
    "BSD-2-Clause": ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "freebsd license"],
    "AGPL-3.0": ["gnu affero general public license version 3", "gnu affero general public license v3", "gnu agpl v3", "agplv3", "agpl 3 0"],
    "LGPL-3.0": ["gnu lesser general public license version 3", "gnu lesser general public license v3", "gnu lgpl v3", "lgplv3", "lgpl 3 0"],
    "LGPL-2.1": ["gnu lesser general public license version 2 1", "gnu lesser general public license v2 1", "gnu lgpl v2 1", "lgplv2 1", "lgpl 2 1"],
    "GPL-3.0": ["gnu general public license version 3", "gnu general public license v3", "gnu gpl version 3", "gnu gpl v3", "gplv3", "gpl 3 0"],
    "GPL-2.0": ["gnu general public license version 2", "gnu general public license v2", "gnu gpl version 2", "gnu gpl v2", "gplv2", "gpl 2 0"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license 2 0", "mpl 2 0"],
    "EPL-2.0": ["eclipse public license version 2 0", "eclipse public license v 2 0", "eclipse public license 2 0", "epl 2 0"],
    "BSL-1.0": ["boost software license version 1 0", "boost software license 1 0"],
    "Zlib": ["zlib license"],
    "Artistic-2.0": ["artistic license 2 0", "artistic license version 2 0"],
    "Unlicense": ["unlicense"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial 4 0"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike 4 0"],
    "CC-BY-4.0": ["cc by 4 0", "creative commons attribution 4 0 international license", "creative commons attribution 4 0"],
    "CC0-1.0": ["cc0 1 0", "creative commons zero"],
}

# Rule, licence, identifiers that must follow each other in a text.
_TEXTS = [
    ("apache-2.0-header", "Apache-2.0", ["apache2-head", "apache2-comply", "apache2-asis"]),
    ("apache-2.0-notice", "Apache-2.0", ["apache2-head"]),
    ("mit-text", "MIT", ["mit-grant", "mit-notice", "asis-software"]),
    ("mit-grant", "MIT", ["mit-grant"]),
    ("isc-text", "ISC", ["isc-grant"]),
    ("isc-0-text", "0BSD", ["isc0-grant"]),
    ("bsd-3-text", "BSD-3-Clause", ["bsd-redist", "bsd-noendorse"]),
    ("bsd-2-text", "BSD-2-Clause", ["bsd-redist"]),
    ("zlib-text", "Zlib", ["zlib-grant", "zlib-origin"]),
    ("zlib-grant", "Zlib", ["zlib-grant"]),
    ("boost-1.0-text", "BSL-1.0", ["boost-grant"]),
    ("unlicense-text", "Unlicense", ["unlicense-free", "unlicense-anyone"]),
    ("unlicense-notice", "Unlicense", ["unlicense-free"]),
    ("mpl-2.0-header", "MPL-2.0", ["mpl2-head", "mpl2-copy"]),
    ("mpl-2.0-notice", "MPL-2.0", ["mpl2-head"]),
    ("epl-2.0-notice", "EPL-2.0", ["epl2-head"]),
    ("cc0-1.0-deed", "CC0-1.0", ["cc0-dedication"]),
    ("all-rights-reserved", "LicenseRef-reserved", ["reserved"]),
    *[(f"{f}-{long}-notice", f"{f.upper()}-{long}-or-later", [f"{f}-terms+later-{v}"]) for f, long, v in (("gpl", "3.0", "3"), ("gpl", "2.0", "2"), ("lgpl", "3.0", "3"), ("lgpl", "2.1", "21"), ("agpl", "3.0", "3"))],
    *[(f"{f}-{long}-joined-notice", f"{f.upper()}-{long}-or-later", [f"{f}-terms-{v}"]) for f, long, v in (("gpl", "3.0", "3"), ("gpl", "2.0", "2"), ("lgpl", "3.0", "3"), ("lgpl", "2.1", "21"), ("agpl", "3.0", "3"))],
]
# Every licence with the suffixes that it may have; where "only" and "or later" make no other licence, they are left out.
LICENCES = {n: {"": n, "only": f"{n}-only", "or later": f"{n}-or-later"} if "GPL" in n else {"": n, "only": n, "or later": n} for n in NAMES}
_FAMILY = {licence: k for k, licence in enumerate([*(x for n in NAMES for x in dict.fromkeys(LICENCES[n].values())), "0BSD", "LicenseRef-reserved"])}
# A tag, on one line with the name or before it, a label and a sentence that names the licence come last of a licence's rules.
_SHORT = [(f"{n.lower()}-{kind}", x, [sequence.format(x)]) for kind, sequence in (("tag", "spdx+tag-{}"), ("tag-line", "spdx-{}"), ("label", "label-{}"), ("reference", "ref-{}")) for n in NAMES for x in dict.fromkeys(LICENCES[n].values())]
RULES = sorted([*_TEXTS, *_SHORT], key=lambda rule: _FAMILY[rule[1]])
# BSD's two-clause text is the start of its three-clause text.
UNLESS = {"bsd-2-text": "bsd-3-text"}


def _plain(name: str) -> str:
    return " ".join("".join(c if c.isalnum() else " " for c in name.lower()).split())


#: Whole sentences; what stands for a licence in an expression ("or later" in one word there) and after a label; names
#: after "under", the longest first, and the token of each.
KNOWN = {s: i for i, sentences in SENTENCES.items() for s in sentences}
TAGS = {f"{_plain(n)} {suffix.replace(' ', '')}".strip(): x for n in NAMES for suffix, x in LICENCES[n].items()}
LABELS = TAGS | {f"{name} {suffix.replace(' ', '')}".strip(): x for n, names in NAMES.items() for name in names for suffix, x in LICENCES[n].items()}
REFERENCES = sorted({(name, f"{k}s" if name.isalpha() else str(k)) for k, (n, names) in enumerate(NAMES.items()) for name in [*names, _plain(n)]}, key=lambda x: (-len(x[0]), x))
TOKENS = {f"{k}{letter}": f"ref-{LICENCES[n][suffix]}" for k, n in enumerate(NAMES) for letter, suffix in (("", ""), ("o", "only"), ("l", "or later"))}
#: What is under a licence, in turn: articles go, what is said not to be under one is marked, names become tokens
#: between two of @, and those that follow "under" one after the other count.
_BEFORE = [(r" not only ", " "), (r" (?:not|nor|never|neither|no longer|isn t|aren t|wasn t) (?:[a-z]+ ){0,2}under ", " notunder "), (r" under (?:the terms (?:and conditions )?of )?(?:(?:the|a|an|either|both|any) )*", " under ")]
#: Names of one word (s) count only at the end or before certain words.
_AFTER = [(r" +", " "), (r"@([0-9]+)s@( $| (?:and|or|as|plus|also|only|in|for|but|with|licen[cs]es?) )", r"@\1@\2"), (r"@([0-9]+)@ (?:or )?(?:at your option )?(?:or )?(?:any )?later(?: version)?(?:s)? ", r"@\1l@ "), (r"@([0-9]+)@ only ", r"@\1o@ ")]
_CHAIN = r" under (@[0-9]+[ol]?@(?:(?: and| or| as well as| plus| also| the| a| an| either| both| under| terms| of| licenses?| at your option)+ @[0-9]+[ol]?@)*)"
#: In an expression: exceptions to a licence go.
_LEFT_OUT = [(" or later", " orlater"), (" with [a-z0-9 ]*?exception(?: [0-9]+)*", "")]
#: Before texts are cut: a label and what follows stay one sentence, "+" after a version is "or later", a company's
#: abbreviation ends no sentence if a small letter follows.
_JOINED = [(r"\b([Ii]nc|[Cc]orp|[Ll]td|[Cc]o|LLC|GmbH|[Ee][.]V)[.]([\x20\x09]+[a-z])", r"\1\2"), (r"(?i)(\blicen[cs]e)[\x20\x09]*:[\x20\x09]*", r"\1 "), (r"([0-9])\+", r"\1 or later")]


def _anchors() -> list[str]:
    """Words such that every known sentence and name holds one; greedily, so that there are few."""
    left, found = [set(s.split()) for s in [*KNOWN, *map(_plain, NAMES), *(name for name, _ in REFERENCES)]], []
    common = set(f"{_SLOT} the this is of or and to at in on an a by be may you any as it its not with without under for all copy 0 1 2 3 4".split())
    while left:
        counts = Counter(w for s in left for w in s - common) or Counter(w for s in left for w in s)
        word = max(counts, key=lambda w: (counts[w], w))
        found.append(word)
        left = [s for s in left if word not in s]
    return found


ANCHORS = _anchors()


def _replaced(text: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by.replace("\\", "$"))
    return text


def _sentences(text: Column) -> Column:
    """Normalised sentences of a text in which line breaks end sentences."""
    cut = F.split(F.regexp_replace(_replaced(text, _JOINED), r"([.!?;:])[\x20\x09\x0B-\x0D]+", "$1\n"), "\n")
    return F.transform(cut, lambda s: _replaced(F.trim(F.regexp_replace(F.lower(s), r"[^a-z0-9]+", " ")), SLOTS))


def _mapped(names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])


def _expression(rest: Column, names: dict[str, str], prefix: str, whole: bool) -> Column:
    """Identifiers of the licences of an expression; null if it has none or, for ``whole``, holds something else."""
    parts = F.split(_replaced(rest, _LEFT_OUT), " (?:or|and|with) ")
    found = F.filter(F.transform(parts, lambda p: _mapped(names)[p]), lambda x: x.isNotNull())
    enough = F.size(found) == F.size(parts) if whole else F.size(found) > 0
    return F.when(enough, F.concat_ws("|", F.transform(found, lambda x: F.concat(F.lit(prefix), x))))


def _referred(sentence: Column) -> Column:
    marked = F.replace(_replaced(F.concat(F.lit(" "), sentence, F.lit(" ")), _BEFORE), F.lit(" "), F.lit("  "))
    for name, k in REFERENCES:
        marked = F.replace(marked, F.lit(f" {name} ".replace(" ", "  ")), F.lit(f"  @{k}@  "))
    chains = F.regexp_extract_all(_replaced(marked, _AFTER), F.lit(_CHAIN), F.lit(1))
    tokens = F.regexp_extract_all(F.concat_ws(" ", chains), F.lit("@([0-9a-z]+)@"), F.lit(1))
    return F.when(F.size(tokens) > 0, F.concat_ws("|", F.array_distinct(F.transform(tokens, lambda t: _mapped(TOKENS)[t]))))


def _identifier(sentence: Column) -> Column:
    spdx = _expression(F.substring(sentence, 25, 1 << 20), TAGS, "spdx-", False)
    label = _expression(F.substring(sentence, 9, 1 << 20), LABELS, "label-", True)
    return F.coalesce(
        _mapped(KNOWN)[sentence], F.when(F.startswith(sentence, F.lit("spdx license identifier ")), spdx),
        F.when(sentence.rlike("^licen[cs]e "), label), F.when(F.length(sentence) <= 200, _expression(sentence, TAGS, "tag-", True)),
        F.when(F.contains(F.concat(F.lit(" "), sentence), F.lit(" under ")), _referred(sentence)),
    )


def _identifiers(text: Column) -> Column:
    return F.filter(F.transform(_sentences(text), _identifier), lambda i: i.isNotNull())


def _pattern(sequence: list[str]) -> str:
    """A regex over identifiers joined as ;id;;id; where id may be several joined by |."""
    one = lambda i: rf";(?:[^;]*\|)?{i.replace('.', '[.]')}(?:\|[^;]*)?;"
    return ".*".join("".join(map(one, i.split("+"))) for i in sequence)


def _matched(ids: Column) -> list[tuple[str, str, Column]]:
    """(rule, licence, whether the rule counts), given ids joined as ;id;;id;."""
    out, taken = [], {}
    for rule, licence, sequence in RULES:
        hit = ids.rlike(_pattern(sequence))
        free = hit & ~taken[licence] if licence in taken else hit
        if rule in UNLESS:
            free = free & ~ids.rlike(_pattern(next(q for r, _, q in RULES if r == UNLESS[rule])))
        taken[licence] = hit | taken[licence] if licence in taken else hit
        out.append((rule, licence, free))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known ones), sentences, rules and licenses (joined by commas, in the order of
    RULES) of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<string>")
    flat = F.regexp_replace(text, r"([^\n])\n([^\n])", "$1 $2")
    may = F.lower(text).rlike(rf"(?<![a-z0-9])(?:{'|'.join(ANCHORS)})(?![a-z0-9])")
    rows = docs.select("doc_id", F.when(may, F.struct(_identifiers(text).alias("l"), _identifiers(flat).alias("p"))).otherwise(F.struct(none.alias("l"), none.alias("p"))).alias("_ids"))
    # The cutting that knows more sentences counts, by line if both know as many.
    ids = F.when(F.size("_ids.p") > F.size("_ids.l"), F.col("_ids.p")).otherwise(F.col("_ids.l"))
    rows = rows.select("doc_id", ids.alias("_ids")).withColumn("_row", F.concat_ws("", F.transform("_ids", lambda i: F.concat(F.lit(";"), i, F.lit(";")))))
    # Almost all texts have no identifiers; theirs need no rules.
    hits = [(rule, licence, (F.col("_row") != "") & c) for rule, licence, c in _matched(F.col("_row"))]
    return rows.select(
        "doc_id",
        F.size("_ids").cast("long").alias("n_sentences"),
        F.array_join("_ids", ",").alias("sentences"),
        F.concat_ws(",", *[F.when(c, F.lit(rule)) for rule, _, c in hits]).alias("rules"),
        F.concat_ws(",", *[F.when(c, F.lit(licence)) for _, licence, c in hits]).alias("licenses"),
    )


def oracle() -> str:
    """The same in DuckDB SQL, from the same fixed values; every text is cut."""
    table = lambda names: "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in names.items()) + "}"

    def replaced(text: str, steps: list[tuple[str, str]]) -> str:
        for pattern, by in steps:
            text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
        return text

    def expression(rest: str, names: str, prefix: str, whole: bool) -> str:
        parts = f"string_split_regex({replaced(rest, _LEFT_OUT)}, ' (?:or|and|with) ')"
        found = f"list_filter(list_transform({parts}, lambda p: {names}[p]), lambda x: x IS NOT NULL)"
        enough = f"len({found}) = len({parts})" if whole else f"len({found}) > 0"
        return f"CASE WHEN {enough} THEN array_to_string(list_transform({found}, lambda x: '{prefix}' || x), '|') END"

    marked = f"replace({replaced(chr(39) + ' ' + chr(39) + ' || s || ' + chr(39) + ' ' + chr(39), _BEFORE)}, ' ', '  ')"
    for name, k in REFERENCES:
        doubled = f" {name} ".replace(" ", "  ")
        marked = f"replace({marked}, '{doubled}', '  @{k}@  ')"
    norm = r"list_transform(string_split(regexp_replace({t}, '([.!?;:])[\x20\x09\x0B-\x0D]+', '\1' || chr(10), 'g'), chr(10)), lambda s: trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')))"
    cut = norm.format(t=replaced("t", _JOINED))
    flat = norm.format(t=replaced(r"regexp_replace(t, '([^\n])\n([^\n])', '\1 \2', 'g')", _JOINED))
    ctes, each_rule = [], []
    for k, (rule, licence, sequence) in enumerate(RULES):
        earlier = [f"NOT h{j}" for j, (r, other, _) in enumerate(RULES) if j < k and other == licence or UNLESS.get(rule) == r]
        ctes.append(f"regexp_matches(row_ids, '{_pattern(sequence)}') AS h{k}")
        each_rule.append((" AND ".join([f"h{k}", *earlier]), rule, licence))
    each = lambda at: ", ".join(f"CASE WHEN {cond} THEN '{(rule, licence)[at]}' END" for cond, rule, licence in each_rule)
    return f"""
WITH maps AS MATERIALIZED (SELECT {table(KNOWN)} AS known, {table(TAGS)} AS tags, {table(LABELS)} AS labels, {table(TOKENS)} AS tokens),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
u AS (SELECT rid, 'l' AS how, unnest({cut}) AS s, generate_subscripts({cut}, 1) AS i FROM d
      UNION ALL SELECT rid, 'p', unnest({flat}), generate_subscripts({flat}, 1) FROM d),
v AS MATERIALIZED (SELECT rid, how, i, {replaced("s", SLOTS)} AS s FROM u),
q AS (SELECT DISTINCT s FROM v WHERE s <> ''),
k AS (SELECT s, CASE WHEN contains(' ' || s, ' under ') THEN regexp_extract_all(array_to_string(regexp_extract_all({replaced(marked, _AFTER)}, '{_CHAIN}', 1), ' '), '@([0-9a-z]+)@', 1) ELSE [] END AS ks FROM q),
w AS (SELECT s, coalesce(known[s], CASE WHEN starts_with(s, 'spdx license identifier ') THEN {expression("s[25:]", "tags", "spdx-", False)} END,
    CASE WHEN regexp_matches(s, '^licen[cs]e ') THEN {expression("s[9:]", "labels", "label-", True)} END, CASE WHEN length(s) <= 200 THEN {expression("s", "tags", "tag-", True)} END,
    CASE WHEN len(ks) > 0 THEN array_to_string(list_transform(list_filter(ks, lambda x, j: list_position(list_transform(ks, lambda y: tokens[y]), tokens[x]) = j), lambda x: tokens[x]), '|') END) AS id
  FROM k, maps),
x AS (SELECT rid, how, i, id FROM v JOIN w USING (s) WHERE id IS NOT NULL),
m AS (SELECT rid, how, list(id ORDER BY i) AS ids FROM x GROUP BY rid, how),
b AS (SELECT doc_id, CASE WHEN len(coalesce(p.ids, [])) > len(coalesce(l.ids, [])) THEN p.ids ELSE coalesce(l.ids, []) END AS ids
      FROM d LEFT JOIN m l ON l.rid = d.rid AND l.how = 'l' LEFT JOIN m p ON p.rid = d.rid AND p.how = 'p'),
r AS (SELECT doc_id, ids, coalesce(array_to_string(list_transform(ids, lambda x: ';' || x || ';'), ''), '') AS row_ids FROM b),
h AS (SELECT *, {", ".join(ctes)} FROM r)
SELECT doc_id, len(ids)::BIGINT AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentences,
  concat_ws(',', {each(0)}) AS rules, concat_ws(',', {each(1)}) AS licenses FROM h
"""
