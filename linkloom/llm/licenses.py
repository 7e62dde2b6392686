"""License scans by ordered signature rules, as Spark expressions.

Every text is searched for a few keywords; only texts with a keyword meet the
rules that it gates.  Each alternative of a rule needs one of the rule's keywords
(parted by |), and no keyword has blanks, so gating loses no match.  A rule is a
regular expression over the text in lower case (A-Z) with runs of blanks collapsed,
with a label, a rank (lower ranks are more specific and win) and a confidence.  A
match that lies inside a match of a lower rank is suppressed; what survives gives
the labels and the score.

Beside the rules stand four base phrases, found as consecutive words wherever
they occur.

Defined results: null and empty texts have no words, no places, empty labels
and score 0.  Equal matches of one rule count once in the labels.  Very long texts
are scanned whole; places and suppression are found in sums and maxima by blocks
of ``BLOCK`` matches, so time follows the matches, not their square.  Matches at
equal places and of equal rank all stay.  Repeated rows are scanned alike.  Columns
of the results' names are replaced.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.native import let

# The base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Words of the base phrases: ASCII letters and digits, and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Rule(NamedTuple):
    label: str
    keyword: str
    pattern: str
    rank: int
    confidence: float


# Names by which texts refer to a license: label, keyword, pattern of the name.
NAMES = [
    ("gpl-1.0", "gnu", r"gnu general public licen[sc]e,? (?:version |v\.? ?)1(?:\.0)?\b"),
    ("gpl-2.0", "gnu", r"gnu general public licen[sc]e,? (?:version |v\.? ?)2(?:\.0)?\b"),
    ("gpl-3.0", "gnu", r"gnu general public licen[sc]e,? (?:version |v\.? ?)3(?:\.0)?\b"),
    ("gpl-2.0-or-later", "gnu", r"gnu general public licen[sc]e,? (?:version |v\.? ?)2(?:\.0)?,? or (?:\(at your option\) )?any later version"),
    ("gpl-3.0-or-later", "gnu", r"gnu general public licen[sc]e,? (?:version |v\.? ?)3(?:\.0)?,? or (?:\(at your option\) )?any later version"),
    ("gpl-2.0", "gpl", r"\bgpl[ -]?v?2(?:\.0)?(?:-only)?\b"),
    ("gpl-3.0", "gpl", r"\bgpl[ -]?v?3(?:\.0)?(?:-only)?\b"),
    ("gpl-2.0-or-later", "gpl", r"\bgpl[ -]?v?2(?:\.0)?(?:\+|-or-later)"),
    ("gpl-3.0-or-later", "gpl", r"\bgpl[ -]?v?3(?:\.0)?(?:\+|-or-later)"),
    ("lgpl-2.0", "gnu", r"gnu library general public licen[sc]e"),
    ("lgpl-2.1", "gnu", r"gnu lesser general public licen[sc]e,? (?:version |v\.? ?)2\.1\b"),
    ("lgpl-3.0", "gnu", r"gnu lesser general public licen[sc]e,? (?:version |v\.? ?)3(?:\.0)?\b"),
    ("lgpl", "gnu", r"gnu lesser general public licen[sc]e"),
    ("lgpl-2.1", "gpl", r"\blgpl[ -]?v?2\.1\b"),
    ("lgpl-3.0", "gpl", r"\blgpl[ -]?v?3(?:\.0)?\b"),
    ("agpl-3.0", "gnu", r"gnu affero general public licen[sc]e,? (?:version |v\.? ?)3(?:\.0)?\b"),
    ("agpl", "gnu", r"gnu affero general public licen[sc]e"),
    ("agpl-3.0", "gpl", r"\bagpl[ -]?v?3(?:\.0)?\b"),
    ("gfdl", "gnu", r"gnu free documentation licen[sc]e"),
    ("gfdl-1.3", "gnu", r"gnu free documentation licen[sc]e,? (?:version |v\.? ?)1\.3\b"),
    ("apache-1.0", "apache", r"apache (?:software )?licen[sc]e,? (?:version |v\.? ?)1\.0\b"),
    ("apache-1.1", "apache", r"apache (?:software )?licen[sc]e,? (?:version |v\.? ?)1\.1\b"),
    ("apache-2.0", "apache", r"apache (?:software )?licen[sc]e,? (?:version |v\.? ?)?2(?:\.0)?\b"),
    ("apache-2.0", "apache", r"\bapache[ -]2(?:\.0)?\b"),
    ("apache-2.0", "apache", r"apache\.org/licenses/license-2\.0"),
    ("mit", "licen", r"\bmit licen[sc]e\b"),
    ("mit", "licen", r"\bexpat licen[sc]e\b"),
    ("mit-0", "attribution|mit-0", r"\bmit no attribution\b|\bmit-0\b"),
    ("x11", "licen", r"\bx11 licen[sc]e\b"),
    ("bsd-2-clause", "bsd|licen", r"\b(?:simplified|freebsd|2-clause|two-clause) (?:bsd )?licen[sc]e\b|\bbsd[ -](?:2|two)[ -]clause\b"),
    ("bsd-3-clause", "bsd", r"\b(?:new|modified|revised|3-clause|three-clause) bsd licen[sc]e\b|\bbsd[ -](?:3|three)[ -]clause\b"),
    ("bsd-4-clause", "bsd", r"\b(?:original|old|4-clause|four-clause) bsd licen[sc]e\b|\bbsd[ -](?:4|four)[ -]clause\b"),
    ("bsd", "bsd", r"\bbsd(?:-style)? licen[sc]es?\b"),
    ("0bsd", "bsd", r"\bzero[- ]clause bsd\b|\b0bsd\b"),
    ("isc", "licen", r"\bisc licen[sc]e\b"),
    ("zlib", "licen", r"\bzlib(?:/libpng)? licen[sc]e\b"),
    ("libpng", "licen", r"\blibpng licen[sc]e\b"),
    ("boost-1.0", "licen", r"\bboost software licen[sc]e\b"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[sc]e,? (?:version |v\.? ?)1\.1\b"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[sc]e,? (?:version |v\.? ?)2(?:\.0)?\b"),
    ("mpl", "mozilla", r"mozilla public licen[sc]e"),
    ("epl-1.0", "eclipse", r"eclipse public licen[sc]e,? (?:version |v\.? ?|- ?)1(?:\.0)?\b"),
    ("epl-2.0", "eclipse", r"eclipse public licen[sc]e,? (?:version |v\.? ?|- ?)2(?:\.0)?\b"),
    ("epl", "eclipse", r"eclipse public licen[sc]e"),
    ("edl-1.0", "eclipse", r"eclipse distribution licen[sc]e"),
    ("cddl-1.0", "licen", r"common development and distribution licen[sc]e"),
    ("cpl-1.0", "licen", r"common public licen[sc]e"),
    ("ipl-1.0", "licen", r"ibm public licen[sc]e"),
    ("eupl-1.2", "licen", r"european union public licen[sc]e"),
    ("cecill", "licen", r"\bcecill(?:-[bc])? licen[sc]e\b"),
    ("artistic-1.0", "licen", r"\bartistic licen[sc]e(?! 2)"),
    ("artistic-2.0", "licen", r"\bartistic licen[sc]e,? (?:version )?2(?:\.0)?\b"),
    ("perl", "perl", r"same terms as perl itself"),
    ("php-3.01", "licen", r"\bphp licen[sc]e\b"),
    ("python-2.0", "licen", r"\bpython software foundation licen[sc]e\b|\bpsf licen[sc]e\b"),
    ("ruby", "licen", r"\bruby licen[sc]e\b"),
    ("openssl", "licen", r"\bopenssl licen[sc]e\b"),
    ("ms-pl", "licen", r"microsoft public licen[sc]e"),
    ("ms-rl", "licen", r"microsoft reciprocal licen[sc]e"),
    ("ofl-1.1", "licen", r"\bsil open font licen[sc]e\b"),
    ("w3c", "licen", r"\bw3c (?:software )?(?:notice and )?licen[sc]e\b"),
    ("unicode", "licen", r"\bunicode licen[sc]e\b"),
    ("postgresql", "licen", r"\bpostgresql licen[sc]e\b"),
    ("ncsa", "licen", r"university of illinois/?(?: ?ncsa)? open source licen[sc]e"),
    ("afl-3.0", "licen", r"academic free licen[sc]e"),
    ("osl-3.0", "licen", r"\bopen software licen[sc]e\b"),
    ("upl-1.0", "licen", r"universal permissive licen[sc]e"),
    ("vim", "licen", r"\bvim licen[sc]e\b"),
    ("beerware", "licen", r"beer-?ware licen[sc]e"),
    ("wtfpl", "licen|wtfpl", r"do what the f\w+ you want to public licen[sc]e|\bwtfpl\b"),
    ("unlicense", "licen", r"\bthe unlicense\b|unlicense\.org"),
    ("odbl-1.0", "licen|odbl", r"open database licen[sc]e|\bodbl\b"),
    ("odc-by", "licen", r"open data commons attribution licen[sc]e"),
    ("pddl-1.0", "licen|pddl", r"public domain dedication and licen[sc]e|\bpddl\b"),
    ("sspl-1.0", "licen", r"server side public licen[sc]e"),
    ("busl-1.1", "licen", r"business source licen[sc]e"),
    ("elastic-2.0", "licen", r"\belastic licen[sc]e\b"),
    ("bigscience-rail", "licen", r"\b(?:bigscience|responsible ai|open ?rail)(?:-m)? licen[sc]e\b"),
    ("cc0-1.0", "cc0", r"\bcc0(?:[ -]1\.0)?\b"),
    ("cc0-1.0", "creative", r"creative commons (?:zero|cc0)"),
    ("cc-by", "creative", r"creative commons attribution(?! ?-| non| share| no)"),
    ("cc-by-sa", "creative", r"creative commons attribution[ -]share ?-?alike"),
    ("cc-by-nc", "creative", r"creative commons attribution[ -]non-?commercial(?! ?-| share| no)"),
    ("cc-by-nd", "creative", r"creative commons attribution[ -]no-?deriv\w*"),
    ("cc-by-nc-sa", "creative", r"creative commons attribution[ -]non-?commercial[ -]share ?-?alike"),
    ("cc-by-nc-nd", "creative", r"creative commons attribution[ -]non-?commercial[ -]no-?deriv\w*"),
    ("cc", "creative", r"creative commons"),
    ("public-domain", "domain", r"(?:released|placed|dedicated|is|are) (?:in|into|to) the public domain"),
    ("public-domain", "domain", r"\bpublic domain\b"),
    ("copyleft", "copyleft", r"\bcopyleft\b"),
]

# Sentences of license texts: label, keyword, pattern.
SENTENCES = [
    ("mit", "permission", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mit", "permission", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("isc", "permission", r"permission to use, copy, modify,? and/?(?:or )?distribute this software for any purpose with or without fee"),
    ("mit", "warranty", r"the software is provided \W?as is\W?,? without warranty of any kind, express or implied"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms,? with or without modification"),
    ("bsd", "redistribution", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistribution", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse", r"neither the name of .{1,80}? may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software"),
    ("apache-2.0", "licen", r"you may not use this file except in compliance with the licen[sc]e"),
    ("apache-2.0", "licen", r"unless required by applicable law or agreed to in writing, software distributed under the licen[sc]e"),
    ("gpl", "redistribut", r"this program is free software[:;,]? you can redistribute it and/or modify"),
    ("gpl", "warranty", r"in the hope that it will be useful,? but without any warranty"),
    ("lgpl", "redistribut", r"this library is free software[:;,]? you can redistribute it and/or modify"),
    ("mpl-2.0", "licen", r"this source code form is subject to the terms of the mozilla public licen[sc]e"),
    ("zlib", "warranty", r"this software is provided \W?as-is\W?,? without any express or implied warranty"),
    ("zlib", "misrepresent", r"the origin of this software must not be misrepresented"),
    ("boost-1.0", "permission", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("cc0-1.0", "waive", r"to the extent possible under law, .{1,80}? has waived all copyright"),
    ("ofl-1.1", "font", r"the fonts? and derivatives, however, cannot be released under any other type of licen[sc]e"),
    ("wtfpl", "just", r"you just do what the f\w+ you want to"),
    ("beerware", "beer", r"you can buy me a beer in return"),
    ("all-rights-reserved", "reserved", r"all rights reserved"),
    ("all-rights-reserved", "droits", r"tous droits r[ée]serv[ée]s"),
    ("all-rights-reserved", "rechte", r"alle rechte vorbehalten"),
    ("all-rights-reserved", "derechos", r"todos los derechos reservados"),
    ("some-rights-reserved", "reserved", r"some rights reserved"),
    ("no-rights-reserved", "reserved", r"no rights reserved"),
    ("proprietary", "proprietary", r"proprietary and confidential|confidential and proprietary"),
    ("proprietary", "permission", r"without (?:the )?(?:prior )?(?:express )?(?:written )?permission of"),
    ("copyright-notice", "copyright", r"\bcopyright (?:\(c\)|©)? ?(?:by )?(?:19|20)\d\d"),
    ("copyright-notice", "©", r"© ?(?:copyright )?(?:19|20)\d\d"),
]

# Identifiers that the tag SPDX-License-Identifier may carry, and license names in URLs.
IDENTIFIERS = """0bsd afl-3.0 agpl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.1 apache-2.0 artistic-1.0 artistic-2.0 bsd-1-clause
bsd-2-clause bsd-3-clause bsd-4-clause bsl-1.0 busl-1.1 cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc-by-sa-3.0 cc-by-sa-4.0
cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nd-4.0 cc-by-nc-sa-4.0 cc-by-nc-nd-4.0 cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.1 cpl-1.0 ecl-2.0 elastic-2.0
epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 gfdl-1.2 gfdl-1.3 gpl-1.0 gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later
isc lgpl-2.0 lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later lppl-1.3c mit mit-0 mpl-1.1 mpl-2.0
ms-pl ms-rl mulanpsl-2.0 ncsa odbl-1.0 ofl-1.1 openssl osl-3.0 pddl-1.0 php-3.01 postgresql psf-2.0 python-2.0 ruby sspl-1.0
unlicense upl-1.0 vim w3c wtfpl x11 zlib""".split()


def _rules() -> list[Rule]:
    """All rules; a rank is lower the more specific the rule: license sentences, tags, versioned names, plain names, mentions."""
    tag = r"spdx-license-identifier: ?\(?"
    out = [Rule(label, "spdx", tag + i.replace(".", r"\.") + r"(?![\w.-])", 1, 0.99) for i in IDENTIFIERS for label in [i]]
    for kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"):
        out.append(Rule(f"cc-{kind}", "creativecommons", rf"creativecommons\.org/licenses/{kind}/\d\.\d", 2, 0.99))
        spaced = kind.replace("-", "[ -]")
        out.append(Rule(f"cc-{kind}", "cc", rf"\bcc[ -]{spaced}(?![\w-])", 5, 0.9))
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            out.append(Rule(f"cc-{kind}-{version}", "cc", rf"\bcc[ -]{spaced}[ -]{version}(?![\w-])".replace(".", r"\."), 3, 0.95))
    out += [Rule(label, k, p, 2, 0.97) for label, k, p in SENTENCES]
    for label, k, p in NAMES:
        exact = any(c.isdigit() for c in label)
        out.append(Rule(label, k, rf"(?:licen[sc]ed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:{p})", 3 if exact else 4, 0.98))
        out.append(Rule(label, k, p, 5 if exact else 6, 0.9))
    out.append(Rule("gpl", "gnu", r"gnu general public licen[sc]e", 7, 0.85))
    out.append(Rule("apache", "apache", r"apache (?:software )?licen[sc]e", 7, 0.85))
    out.append(Rule("unknown-license", "licen", r"(?:licen[sc]ed|released|distributed) under (?:the )?(?:terms of )?(?:the |a |an )?\w+(?: \w+){0,3} licen[sc]e", 8, 0.5))
    out.append(Rule("license-mention", "licen", r"\blicen[sc]ed under\b", 9, 0.3))
    return out


RULES = _rules()
KEYWORDS = sorted({k for r in RULES for k in r.keyword.split("|")})
RANKS = sorted({r.rank for r in RULES})
#: Matches whose lengths or ends are summed up together: two to this power.
BLOCK_POWER = 8
BLOCK = 1 << BLOCK_POWER
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_IN_WORD, _BETWEEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Any base phrase, in a text of any case.
_ANY_PHRASE = rf"(?i)(?<!{_IN_WORD})(?:{'|'.join(_BETWEEN.join(p.split()) for p in PHRASES)})(?!{_IN_WORD})"


def _places(words: Column) -> Column:
    """Starts of the base phrases, with their labels, in a list of words."""
    tagged = F.transform(words, lambda x, i: F.struct(x.alias("w"), i.alias("at")))

    def of(phrase: str, label: str) -> Column:
        parts = phrase.split()

        def here(s: Column) -> Column:
            all_ = s["w"] == parts[0]
            for k, w in enumerate(parts[1:], 1):
                all_ = all_ & F.coalesce(F.get(words, s["at"] + k) == w, F.lit(False))
            return all_

        return F.transform(F.filter(tagged, here), lambda s: F.struct(s["at"].cast("long").alias("at"), F.lit(label).alias("label")))

    return F.concat(*(of(phrase, label) for phrase, label in PHRASES.items()))


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, x: a + x)


def _own_block(xs: Column, at: Column) -> Column:
    """The elements of a block of xs that stand before place at."""
    inside = at.bitwiseAND(F.lit(BLOCK - 1))
    return F.slice(xs, at - inside + 1, inside)


def _by_block(xs: Column, of: Callable[[Column], Column]) -> Column:
    """of(block) for the blocks of xs, in order."""
    return F.transform(F.sequence(F.lit(0), F.shiftright(F.size(xs), BLOCK_POWER)), lambda b: of(F.slice(xs, b * BLOCK + 1, BLOCK)))


def _sums_before(xs: Column) -> Column:
    """For every place the sum of what stands before it."""
    heads = let(_by_block(xs, _total), lambda sums: F.transform(sums, lambda _, b: _total(F.slice(sums, F.lit(1), b))))
    return let(heads, lambda h: F.transform(xs, lambda _, j: F.get(h, F.shiftright(j, BLOCK_POWER)) + _total(_own_block(xs, j))))


def _matches(canon: Column, hit: Column) -> Column:
    """Intervals of all matches of the rules numbered in hit: start, back (minus the end), rank, label, confidence."""
    table = F.from_json(F.lit(json.dumps([r._asdict() for r in RULES])), "array<struct<label:string,pattern:string,rank:int,confidence:double>>")

    def intervals(r: Column) -> Column:
        def spans(parts: Column) -> Column:
            gaps, hits = parts["gaps"], parts["hits"]
            steps = F.transform(hits, lambda x, j: F.length(F.get(gaps, j)) + F.length(x))
            place = lambda before: F.transform(hits, lambda x, j: let(F.get(before, j) + F.length(F.get(gaps, j)), lambda s: F.struct(s.alias("start"), (-s - F.length(x)).alias("back"), r["rank"].alias("rank"), r["label"].alias("label"), r["confidence"].alias("confidence"))))
            return let(let(steps, _sums_before), place)

        return let(F.struct(F.split(canon, r["pattern"], -1).alias("gaps"), F.regexp_extract_all(canon, r["pattern"], F.lit(0)).alias("hits")), spans)

    return F.flatten(F.transform(hit, lambda i: let(F.get(table, i), intervals)))


def _surviving(found: Column) -> Column:
    """The matches that lie in no match of a lower rank.  In the order of start and falling end whatever holds a match
    stands before it: it is sought among the match's own block, and in the farthest ends by rank of the blocks before."""
    ends = lambda block: F.transform(F.array(*map(F.lit, RANKS)), lambda k: F.aggregate(block, F.lit(-1), lambda a, y: F.when(y["rank"] == k, F.greatest(a, -y["back"])).otherwise(a)))

    def kept(all_: Column) -> Column:
        def before(blocks: Column) -> Column:
            return F.transform(blocks, lambda _, b: F.transform(F.array(*map(F.lit, RANKS)), lambda k, at: F.aggregate(F.slice(blocks, F.lit(1), b), F.lit(-1), lambda a, x: F.greatest(a, F.get(x, at)))))

        def free(heads: Column) -> Column:
            def held(x: Column, j: Column) -> Column:
                far = F.exists(F.arrays_zip(F.array(*map(F.lit, RANKS)).alias("rank"), F.get(heads, F.shiftright(j, BLOCK_POWER)).alias("end")), lambda y: (y["rank"] < x["rank"]) & (y["end"] >= -x["back"]))
                return far | F.exists(_own_block(all_, j), lambda y: (y["rank"] < x["rank"]) & (y["back"] <= x["back"]))

            return F.filter(all_, lambda x, j: ~held(x, j))

        return let(let(_by_block(all_, ends), before), free)

    survivors = let(F.array_sort(found), kept)
    return F.transform(survivors, lambda x: F.struct(x["start"], (-x["back"]).alias("end"), x["rank"], x["label"], x["confidence"]))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, the base places (n_base, first_word, last_word, base_labels), and the method's matches, labels and score."""
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "matches", "labels", "score"]
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    low = F.translate(t, _UPPER, _LOWER)
    # all of Unicode in lower case holds every keyword that the text in lower A-Z holds, and is made faster
    out = docs.drop(*names).withColumn("__l", F.lower(t)).withColumns(
        {"__has": F.array(*(F.contains("__l", F.lit(k)) for k in KEYWORDS)), "__based": (F.contains("__l", F.lit("license")) | F.contains("__l", F.lit("cc"))) & F.rlike(t, F.lit(_ANY_PHRASE))}
    )
    out = out.withColumn("__canon", F.when(F.array_contains("__has", True), F.regexp_replace(low, r"\s+", " ")))
    has = {k: F.get("__has", F.lit(i)) for i, k in enumerate(KEYWORDS)}
    gate = lambda r: functools.reduce(lambda a, b: a | b, (has[k] for k in r.keyword.split("|")))
    out = out.withColumn("__hit", F.when(F.col("__canon").isNotNull(), F.array_compact(F.array(*(F.when(gate(r) & F.rlike("__canon", F.lit(r.pattern)), F.lit(i)) for i, r in enumerate(RULES))))))
    empty_places, empty_matches = "array<struct<at:bigint,label:string>>", "array<struct<start:int,end:int,rank:int,label:string,confidence:double>>"
    places = let(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), _places)
    out = out.withColumns(
        {
            "n_words": F.regexp_count(t, F.lit(_IN_WORD + "+")).cast("long"),
            "__places": F.when(F.col("__based"), places).otherwise(F.array().cast(empty_places)),
            "matches": F.when(F.size("__hit") > 0, let(_matches(F.col("__canon"), F.col("__hit")), _surviving)).otherwise(F.array().cast(empty_matches)),
        }
    )
    base = F.array_sort(F.array_distinct(F.transform("__places", lambda x: x["label"])))
    labels = F.array_sort(F.array_distinct(F.concat(F.transform("__places", lambda x: x["label"]), F.transform("matches", lambda x: x["label"]))))
    doubt = F.aggregate("matches", F.lit(1.0), lambda a, x: a * (F.lit(1.0) - x["confidence"]))
    return out.withColumns(
        {
            "n_base": F.size("__places").cast("long"),
            "first_word": F.array_min(F.transform("__places", lambda x: x["at"])),
            "last_word": F.array_max(F.transform("__places", lambda x: x["at"])),
            "base_labels": F.array_join(base, ","),
            "labels": F.array_join(labels, ","),
            "score": F.greatest(F.lit(1.0) - doubt, F.when(F.size("__places") > 0, F.lit(0.5)).otherwise(F.lit(0.0))),
        }
    ).drop("__l", "__has", "__based", "__canon", "__hit", "__places")
