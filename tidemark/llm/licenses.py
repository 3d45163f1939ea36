"""License scans by ordered signature rules.

A rule is a label, a tier (0 best), a keyword and a pattern over the normalised words of a text. A rule's pattern runs only
where its keyword and the longest run of fixed words of its pattern stand in the text; every match holds both. Detections are
intervals of words. One that lies within another goes if the other's tier is better, or equal and it is longer, or it
is the same interval of an earlier rule.

Only DataFrame functions. The rule table holds notices as they are written in files (NOTICES) and, built from families and versions, names
and tags. Arrays that a text's detections would lengthen one by one are made in chunks, so time is near linear in the detections of a text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The phrases whose places are counted, and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
TIERS = (1.0, 0.9, 0.8, 0.6, 0.3)  # confidence of a detection, by tier
CHUNK = 256  # detections whose array is made by appending

# Sentences of license texts and notices, written by hand: label, wording ("{a|b}" alternatives, "?" after it: may be missing).
NOTICES = (
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "you should have received a copy of the gnu general public license along with {this|the} {program|file|software|library|package}"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gpl-3.0-or-later", "either version 3 of the license or at your option any later version"),
    ("gpl-2.0-or-later", "either version 2 of the license or at your option any later version"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu {lesser|library} general public license"),
    ("lgpl", "you should have received a copy of the gnu {lesser|library} general public license along with this {library|program|file}"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("gpl-exception", "as a special exception the copyright holders of this {library|program} give you permission to link"),
    ("gpl-classpath", "as a special exception the copyright holders of this library give you permission to link this library with independent modules"),
    ("gfdl", "with no invariant sections no front cover texts and no back cover texts"),
    ("gpl-copyleft", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("apache-2.0", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2.0", "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations"),
    ("apache-1.1", "this product includes software developed by the apache software foundation"),
    ("mit", "any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mit-style", "use of this source code is governed by an mit style license"),
    ("bsd", "use of this source code is governed by a bsd style license that can be found in the license file"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", "neither the name of the {copyright holder|author|organization|company|university} nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd", "any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("bsd", "this software is provided by the copyright holders and contributors as is"),
    ("isc", "provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("bsl-1.0", "distributed under the boost software license version 1 0 see accompanying file license 1 0 txt"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.1", "alternatively the contents of this file may be used under the terms of either the gnu general public license"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("epl", "which accompanies this distribution and is available at http www eclipse org legal"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl", "when distributing covered code include this cddl header in each file"),
    ("cpl", "this program and the accompanying materials are made available under the terms of the common public license"),
    ("eupl", "licensed under the eupl version 1 {1|2} or as soon they will be approved by the european commission"),
    ("artistic", "you may redistribute it and or modify it under the same terms as perl itself"),
    ("artistic", "under the terms of either the gnu general public license or the artistic license"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("wtfpl", "you just do what the fuck you want to"),
    ("beerware", "if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("json", "the software shall be used for good not evil"),
    ("ofl-1.1", "this font software is licensed under the sil open font license"),
    ("ofl-1.1", "with reserved font name"),
    ("psf-2.0", "psf is making python available to licensee on an as is basis"),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("x11", "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("ncsa", "neither the names of the copyright holders nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("postgresql", "and this paragraph and the following two paragraphs appear in all copies"),
    ("libpng", "this copy of the libpng notices is provided for your convenience"),
    ("curl", "the name of a copyright holder shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
    ("public-domain", "the author disclaims copyright to this source code"),
    ("public-domain", "in place of a legal notice here is a blessing"),
    ("public-domain", "this {file|code|software|work} is in the public domain"),
    ("public-domain", "to the extent possible under law the author has {waived|dedicated} all copyright"),
    ("cc0-1.0", "has waived all copyright and related or neighboring rights to this work"),
    ("cc0-1.0", "dedicate any and all copyright interest in the software to the public domain"),
    ("public-domain", "no rights reserved"),
    ("cc", "this work is licensed under {a|the} creative commons"),
    ("cc", "to view a copy of this license visit http creativecommons org"),
    ("cc", "except where otherwise noted content on this site is licensed under a creative commons"),
    ("cc-by", "you are free to share copy and redistribute the material in any medium or format"),
    ("cc-by-sa", "if you remix transform or build upon the material you must distribute your contributions under the same license"),
    ("cc-by-nc", "you may not use the material for commercial purposes"),
    ("cc-by-nd", "if you remix transform or build upon the material you may not distribute the modified material"),
    ("sspl-1.0", "server side public license"),
    ("busl-1.1", "business source license"),
    ("elastic-2.0", "elastic license {2 0|v2}"),
    ("commons-clause", "commons clause license condition"),
    ("llama-community", "llama {2|3|3 1}? community license agreement"),
    ("openrail", "responsible ai license"),
    ("openrail", "openrail m"),
    ("proprietary", "{this document|this file|this software} is {proprietary and}? confidential"),
    ("proprietary", "proprietary and confidential"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "no part of this {publication|document|work|book} may be reproduced"),
    ("proprietary", "may not be reproduced {or distributed}? without {prior}? {written}? permission"),
    ("proprietary", "use is subject to license terms"),
    ("proprietary", "for evaluation purposes only"),
    ("non-commercial", "for {non commercial|noncommercial|personal} use only"),
    ("non-commercial", "not {intended}? for commercial use"),
    ("non-commercial", "free for personal {and educational}? use"),
    ("permission", "{reprinted|reproduced|used} with {kind}? permission"),
    ("permission", "courtesy of the copyright {holder|owner}"),
    ("all-rights-reserved", "alle rechte vorbehalten"),
    ("all-rights-reserved", "tous droits réservés"),
    ("all-rights-reserved", "todos los derechos reservados"),
)


@dataclass(frozen=True)
class Rule:
    label: str
    tier: int
    keyword: str  # words that every match holds, the last of them as a word or its beginning
    pattern: str  # over words written " w1  w2 ": each with a space on either side

    @property
    def fixed(self) -> str:
        """The longest part of the pattern that every match holds as it is: what stands outside its alternatives."""
        return max(re.split(r"\(\?:[^)]*\)\??", self.pattern), key=len)


def _words(text: str) -> str:
    """A wording with alternatives in braces, "a {b c|d} e", as a pattern; "?" after a brace: it may be missing."""
    out, rest = "", text
    while rest:
        head, brace, tail = rest.partition("{")
        out += "".join(f" {w} " for w in head.split())
        if not brace:
            break
        inside, _, rest = tail.partition("}")
        maybe = rest.startswith("?")
        rest = rest[1:] if maybe else rest
        out += "(?:" + "|".join("".join(f" {w} " for w in x.split()) for x in inside.split("|")) + ")" + "?" * maybe
    return out


@cache
def rules() -> tuple[Rule, ...]:
    """All rules in order. SPDX tags and addresses are tier 0, names with a version 1, wordings of the text itself 2,
    bare names 3, hints that some license is meant 4."""
    out: list[Rule] = []

    def add(label: str, tier: int, keyword: str, *wordings: str) -> None:
        out.extend(Rule(label, tier, keyword, _words(w)) for w in wordings)

    def version(v: str) -> str:
        whole = v.removesuffix(".0")
        spoken = " ".join(v.split("."))
        return "{" + "|".join(dict.fromkeys(["version " + spoken, "version " + " ".join(whole.split(".")), "v" + spoken, "v " + spoken, "v" + " ".join(whole.split(".")), spoken, " ".join(whole.split("."))])) + "}"

    tag = lambda name: "spdx license identifier " + " ".join(name.lower().replace(".", "-").split("-"))
    gnu = {"gpl": ("general public", ("1.0", "2.0", "3.0")), "lgpl": ("{lesser|library} general public", ("2.0", "2.1", "3.0")), "agpl": ("affero general public", ("1.0", "3.0")), "gfdl": ("free documentation", ("1.1", "1.2", "1.3"))}
    for short, (name, versions) in gnu.items():
        for v in versions:
            for suffix, words in (("-or-later", "{or later|or any later version|or at your option any later version}"), ("-only", "only"), ("", "")):
                label = f"{short}-{v}{suffix}"
                add(label, 0, "spdx", tag(label))
                add(label, 1, name.rpartition("}")[2].split()[0] if "{" in name else name.split()[0], f"gnu {name} {{license|licence}} {version(v)} {words}")
                add(label, 1, short, f"{{gnu}}? {short} {version(v)} {words}", f"{short}v{v[0]} {words}")
            add(f"{short}-{v}", 0, "gnu org", f"gnu org licenses {short} {v.replace('.', ' ')}")
        add(short, 3, "gnu", f"gnu {name} {{license|licence}}", f"gnu {short}")
    for v in ("1.0", "1.1", "2.0"):
        add(f"apache-{v}", 0, "spdx", tag(f"apache-{v}"))
        add(f"apache-{v}", 0, "apache org", f"apache org licenses license {v.replace('.', ' ')}")
        add(f"apache-{v}", 1, "apache", f"apache {{software}}? {{license|licence}} {version(v)}", f"apache {version(v)} {{license|licence}}", f"licensed under {{the}}? apache {version(v)}")
    add("apache", 3, "apache", "apache {software}? {license|licence}")
    parts = {"by": "attribution", "by-sa": "attribution {sharealike|share alike}", "by-nd": "attribution {noderivatives|no derivatives|noderivs}", "by-nc": "attribution {noncommercial|non commercial}", "by-nc-sa": "attribution {noncommercial|non commercial} {sharealike|share alike}", "by-nc-nd": "attribution {noncommercial|non commercial} {noderivatives|no derivatives|noderivs}"}
    for short, name in parts.items():
        spoken = short.replace("-", " ")
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            label = f"cc-{short}-{v}"
            add(label, 0, "spdx", tag(label))
            add(label, 0, "creativecommons", f"creativecommons org licenses {spoken} {v.replace('.', ' ')}")
            add(label, 1, "cc", f"cc {spoken} {version(v)}")
            add(label, 1, "creative", f"creative commons {name} {version(v)}", f"creative commons {name} {{international|unported|generic}}? {{license|licence}} {version(v)}")
        add(f"cc-{short}", 3, "cc", f"cc {spoken}")
        add(f"cc-{short}", 3, "creative", f"creative commons {name}")
    add("cc0-1.0", 0, "spdx", tag("cc0-1.0"))
    add("cc0-1.0", 0, "creativecommons", "creativecommons org publicdomain zero 1 0")
    add("cc0-1.0", 1, "cc0", f"cc0 {version('1.0')}", "cc0")
    for label in ("mit", "isc", "zlib", "unlicense", "wtfpl", "psf-2.0", "bsl-1.0", "ofl-1.1", "postgresql", "python-2.0", "ncsa", "x11", "0bsd", "mit-0", "upl-1.0", "vim", "curl", "openssl"):
        add(label, 0, "spdx", tag(label))
    for label, name in (("mit", "mit"), ("isc", "isc"), ("zlib", "zlib"), ("ncsa", "university of illinois ncsa"), ("x11", "x11"), ("vim", "vim"), ("postgresql", "postgresql"), ("openssl", "openssl"), ("psf-2.0", "python software foundation"), ("wtfpl", "do what the fuck you want to public")):
        add(label, 1, name.split()[0], f"{{released|licensed|available|distributed}} under {{the|an}}? {name} {{license|licence}}")
        add(label, 3, name.split()[0], f"{name} {{license|licence}}")
    for n, word in (("2", "two"), ("3", "three"), ("4", "four")):
        label = f"bsd-{n}-clause"
        add(label, 0, "spdx", tag(label))
        add(label, 1, "bsd", f"bsd {{{n}|{word}}} clause {{license|licence}}?", f"{{{n}|{word}}} clause bsd {{license|licence}}?")
    add("bsd", 3, "bsd", "bsd {style}? {license|licence}")
    named = (("mpl", "mozilla public", ("1.0", "1.1", "2.0")), ("epl", "eclipse public", ("1.0", "2.0")), ("cddl", "common development and distribution", ("1.0", "1.1")), ("eupl", "european union public", ("1.0", "1.1", "1.2")), ("ofl", "sil open font", ("1.0", "1.1")), ("artistic", "artistic", ("1.0", "2.0")), ("bsl", "boost software", ("1.0",)), ("osl", "open software", ("1.0", "2.0", "2.1", "3.0")), ("afl", "academic free", ("1.2", "2.0", "2.1", "3.0")), ("cpl", "common public", ("1.0",)), ("ms-pl", "microsoft public", ("1.0",)), ("odbl", "open database", ("1.0",)), ("odc-by", "open data commons attribution", ("1.0",)), ("zpl", "zope public", ("1.1", "2.0", "2.1")), ("lppl", "latex project public", ("1.0", "1.1", "1.2", "1.3")), ("cecill", "cecill free software", ("1.0", "2.0", "2.1")), ("qpl", "q public", ("1.0",)), ("apsl", "apple public source", ("1.0", "1.2", "2.0")), ("rpl", "reciprocal public", ("1.1", "1.5")))
    for short, name, versions in named:
        for v in versions:
            add(f"{short}-{v}", 0, "spdx", tag(f"{short}-{v}"))
            add(f"{short}-{v}", 1, name.split()[0], f"{name} {{license|licence}} {version(v)}")
            add(f"{short}-{v}", 1, short.split("-")[0], f"{short.replace('-', ' ')} {version(v)} {{license|licence}}")
        add(short, 3, name.split()[0], f"{name} {{license|licence}}")
    for label, wording in NOTICES:
        add(label, 2, max(Rule(label, 2, "", _words(wording)).fixed.split(), key=len), wording)
    add("mit", 2, "permission", "permission is hereby granted free of charge to any person obtaining a copy")
    add("isc", 2, "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted")
    add("bsd", 2, "redistribution", "redistribution and use in source and binary forms with or without modification are permitted")
    add("unlicense", 2, "public", "this is free and unencumbered software released into the public domain")
    add("zlib", 2, "provided", "this software is provided as is without any express or implied warranty in no event will the authors be held liable")
    add("apache-2.0", 2, "compliance", "you may not use this file except in compliance with the license")
    add("public-domain", 2, "public", "{released|placed|dedicated} {in|into|to} the public domain")
    add("all-rights-reserved", 2, "reserved", "all rights reserved")
    add("some-license", 4, "license", "licensed under {the}?", "license terms", "see {the}? license {file}? {for details}?", "this license")
    add("some-license", 4, "warranty", "without warranty of any kind", "without any warranty")
    return tuple(dict.fromkeys(out))


def normal_words(text: Column) -> Column:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text in lower case, one space between.

    lower() also changes letters beyond A-Z, which stay letters beyond ASCII, but for two that would become
    ASCII; those are put aside first.
    """
    beyond = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("é")), F.lit("İ"), F.lit("é"))
    return F.trim(F.regexp_replace(F.lower(beyond), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def _spaces(x: Column) -> Column:
    return F.char_length(x) - F.char_length(F.replace(x, F.lit(" "), F.lit("")))


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body (or a lambda in it) names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _chunks(items: Column) -> Column:
    """An array in arrays of CHUNK. items: a bound value."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / CHUNK).cast("int") - 1, F.lit(0))), lambda c: F.slice(items, c * CHUNK + 1, CHUNK))


def _scan(items: Column, start: Column, moved: Callable[[Column, Column], Column], made: Callable[[Column, Column], Column], kind: str) -> Column:
    """made(state, item) of every item, null left out; a state moves on with each item. kind: of what is made.

    The state before each chunk comes from a scan over the chunks, so no long array is built by appending.
    """
    one = kind.removeprefix("array<").removesuffix(">")

    def ahead(s: Column, chunk: Column) -> Column:
        after = F.aggregate(chunk, s["state"], moved)
        return F.struct(after.alias("state"), F.concat(s["before"], F.array(s["state"])).alias("before"))

    def inside(chunk: Column, state: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            return F.struct(moved(s["state"], x).alias("state"), F.concat(s["out"], F.array(made(s["state"], x).cast(one))).alias("out"))

        return F.aggregate(chunk, F.struct(state.alias("state"), F.array().cast(kind).alias("out")), step)["out"]

    def whole(chunks: Column) -> Column:
        before = F.aggregate(chunks, F.struct(start.alias("state"), F.slice(F.array(start), 1, 0).alias("before")), ahead)["before"]
        return F.filter(F.flatten(F.zip_with(chunks, before, inside)), lambda x: x.isNotNull())

    return _bind(items, lambda v: _bind(_chunks(v), whole))


SPOTS = "array<struct<start:bigint,stop:bigint,tier:int,number:int,label:string>>"


def _found(double: Column, rule: Column) -> Column:
    """Word intervals (start, stop) of the rule's matches: marks before each match cut the text, words before it are counted."""
    pieces = F.split(F.regexp_replace(double, F.concat(F.lit("("), rule["pattern"], F.lit(")")), F.lit("\u0001$1")), "\u0001")

    def spot(words: Column, p: Column) -> Column:
        size = (_spaces(F.regexp_substr(p, F.concat(F.lit("^("), rule["pattern"], F.lit(")")))) / 2).cast("long")
        return F.struct(words.alias("start"), (words + size).alias("stop"), rule["tier"].alias("tier"), rule["number"].alias("number"), rule["label"].alias("label"))

    def spots(pieces: Column) -> Column:
        first = (_spaces(F.get(pieces, F.lit(0))) / 2).cast("long")
        matches = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(1)))
        return F.when(F.size(pieces) > 1, _scan(matches, first, lambda words, p: words + (_spaces(p) / 2).cast("long"), spot, SPOTS)).otherwise(F.array().cast(SPOTS))

    return _bind(pieces, spots)


def _kept(found: Column) -> Column:
    """Sorted by start, longest first, what contains a detection comes before it; a running maximum of the ends of
    each tier then tells whether a better or equal tier does."""
    key = F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["stop"]).alias("stop"), d["tier"].alias("tier"), d["number"].alias("number"), d["label"].alias("label")))
    tiers = range(len(TIERS))

    def moved(s: Column, d: Column) -> Column:
        return F.struct(*[F.when(d["tier"] == t, F.greatest(s[f"e{t}"], -d["stop"])).otherwise(s[f"e{t}"]).alias(f"e{t}") for t in tiers])

    def made(s: Column, d: Column) -> Column:
        inside = s["e0"] >= -d["stop"]
        for t in tiers[1:]:
            inside = inside | ((d["tier"] >= t) & (s[f"e{t}"] >= -d["stop"]))
        return F.when(~inside, F.struct(d["start"].alias("start"), (-d["stop"]).alias("stop"), d["tier"].alias("tier"), d["label"].alias("label")))

    start = F.struct(*[F.lit(-1).cast("long").alias(f"e{t}") for t in tiers])
    return _scan(F.sort_array(key), start, moved, made, "array<struct<start:bigint,stop:bigint,tier:int,label:string>>")


def license_scan(docs: DataFrame) -> DataFrame:
    """docs with n_words, base (array of (start, label)) and detections (array of (start, stop, tier, label), words from 0).

    Looks at the whole `text`; null is empty: no words, empty arrays. Columns of the new names are replaced, others stay.
    Every row gives one row. base: all places of the BASE phrases; detections: what the rules find, after suppression.
    """
    own = ["n_words", "base", "detections"]
    words = docs.drop(*own).withColumn("_norm", normal_words(F.col("text")))
    norm, double = F.col("_norm"), F.col("_double")
    by_keyword: dict[str, list[Column]] = {}
    for i, r in enumerate(rules()):
        by_keyword.setdefault(r.keyword, []).append(F.struct(F.lit(r.label).alias("label"), F.lit(r.tier).alias("tier"), F.lit(i).alias("number"), F.lit(r.fixed).alias("fixed"), F.lit(r.pattern).alias("pattern")))
    table = F.array(*[F.struct(F.lit(f" {keyword}").alias("keyword"), F.array(*some).alias("rules")) for keyword, some in by_keyword.items()])
    phrases = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(0).alias("tier"), F.lit(i).alias("number"), F.lit(_words(phrase)).alias("fixed"), F.lit(_words(phrase)).alias("pattern")) for i, (phrase, label) in enumerate(BASE)])

    def found(which: Column) -> Column:
        near = F.filter(which, lambda r: F.contains(double, r["fixed"]))
        return F.flatten(F.transform(near, lambda r: _found(double, r)))

    # No phrase overlaps itself, so a pattern finds all its places.
    base = F.transform(found(phrases), lambda d: F.struct(d["start"].alias("start"), d["label"].alias("label")))
    # Each keyword is looked for once, not once a rule.
    likely = F.flatten(F.transform(F.filter(table, lambda k: F.contains(F.col("_padded"), k["keyword"])), lambda k: k["rules"]))
    n_words = F.when(norm == "", F.lit(0)).otherwise(_spaces(norm) + 1).cast("long")
    scanned = words.withColumn("_padded", F.concat(F.lit(" "), norm)).withColumn("_double", F.concat(F.lit(" "), F.replace(norm, F.lit(" "), F.lit("  ")), F.lit(" ")))
    scanned = scanned.withColumn("n_words", n_words).withColumn("base", base).withColumn("detections", _kept(found(likely)))
    return scanned.drop("_norm", "_padded", "_double")
