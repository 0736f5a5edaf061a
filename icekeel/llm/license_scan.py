"""License scans with ordered signature rules, in DataFrame functions only.

The words of every text are joined by single blanks, and the rules' keywords are looked up there.
A rule is tried where one of its keywords stands; every match of its regex holds one, so nothing
is lost. A detection inside the interval of another with a higher priority (or as high and wider)
is suppressed. Detections are found and sifted in one pass each, however many there are.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What lies between words of any case.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Detections in a run, and what holds one: sorted by it, detections stand by start, the wider and then the higher first.
BLOCK, HIT = 256, "struct<first:int,back:int,rank:int,label:string>"
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: label; keywords, one of which begins a word in every match; the names' regex over words joined by blanks; the SPDX identifier's regex.
LICENSES = (
    ("mit", "mit licen|mit x11|mit expat", r"mit(?: x11| expat)? licen[cs]e|mit licensed", r"mit"),
    ("mit-0", "mit no attribution", r"mit no attribution(?: licen[cs]e)?", r"mit 0"),
    ("apache", "apache", r"apache (?:software )?licen[cs]e(?: version)?(?: v?2(?: 0)?)?", r"apache 2 0"),
    ("apache-1.1", "apache", r"apache (?:software )?licen[cs]e(?: version)? 1 1", r"apache 1 1"),
    ("gpl", "general public", r"(?:gnu )?general public licen[cs]e", r"gpl(?: [23] 0)?(?: only| or later)?"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public licen[cs]e(?: as published by the free software foundation)?(?: either)? (?:version|v) ?2", r"gpl 2 0(?: only| or later)?"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public licen[cs]e(?: as published by the free software foundation)?(?: either)? (?:version|v) ?3", r"gpl 3 0(?: only| or later)?"),
    ("gpl-short", "gpl", r"(?:gnu )?gpl ?v?[23](?: 0)?", r"gpl"),
    ("lgpl", "lesser general", r"(?:gnu )?lesser general public licen[cs]e(?: (?:version|v) ?[23](?: [01])?)?", r"lgpl [23] [01](?: only| or later)?"),
    ("lgpl-short", "lgpl", r"(?:gnu )?lgpl ?v?[23]?(?: [01])?", r"lgpl"),
    ("library-gpl", "library general", r"(?:gnu )?library general public licen[cs]e", r"lgpl 2 0"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e(?: (?:version|v) ?3)?", r"agpl 3 0(?: only| or later)?"),
    ("agpl-short", "agpl", r"(?:gnu )?agpl ?v?3?(?: 0)?", r"agpl"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[cs]e", r"gfdl 1 [123]"),
    ("bsd", "bsd", r"(?:modified |simplified |revised |new )?bsd(?: style)? licen[cs]e", r"bsd"),
    ("bsd-2", "bsd", r"(?:bsd 2|2|two) clause bsd(?: licen[cs]e)?|bsd (?:2|two) clause(?: licen[cs]e)?", r"bsd 2 clause"),
    ("bsd-3", "bsd", r"(?:3|three) clause bsd(?: licen[cs]e)?|bsd (?:3|three) clause(?: licen[cs]e)?", r"bsd 3 clause"),
    ("bsd-4", "bsd", r"(?:4|four) clause bsd(?: licen[cs]e)?|bsd (?:4|four) clause(?: licen[cs]e)?", r"bsd 4 clause"),
    ("0bsd", "bsd", r"(?:zero|0) clause bsd(?: licen[cs]e)?", r"0bsd"),
    ("isc", "isc", r"isc licen[cs]e", r"isc"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e(?: (?:version|v) ?[12](?: [01])?)?", r"mpl [12] [01]"),
    ("mpl-short", "mpl", r"mpl ?v?[12](?: [01])?", r"mpl"),
    ("epl", "eclipse", r"eclipse public licen[cs]e(?: (?:version|v)? ?[12](?: 0)?)?", r"epl [12] 0"),
    ("edl", "eclipse", r"eclipse distribution licen[cs]e", r"edl 1 0"),
    ("cddl", "common development", r"common development and distribution licen[cs]e", r"cddl 1 [01]"),
    ("cpl", "common public", r"common public licen[cs]e", r"cpl 1 0"),
    ("ipl", "ibm", r"ibm public licen[cs]e", r"ipl 1 0"),
    ("apsl", "apple", r"apple public source licen[cs]e", r"apsl 2 0"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e", r"ms pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e", r"ms rl"),
    ("artistic", "artistic", r"artistic licen[cs]e(?: (?:version |v)?[12](?: 0)?)?", r"artistic [12] 0"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", r"zlib"),
    ("libpng", "libpng", r"libpng licen[cs]e", r"libpng"),
    ("unlicense", "unlicense", r"the unlicense|unlicense", r"unlicense"),
    ("wtfpl", "do what", r"do what the \S+ you want to public licen[cs]e", r"wtfpl"),
    ("boost", "boost", r"boost software licen[cs]e(?: (?:version )?1 0)?", r"bsl 1 0"),
    ("psf", "python software|psf", r"python software foundation licen[cs]e|psf licen[cs]e", r"psf 2 0|python 2 0"),
    ("php", "php", r"php licen[cs]e", r"php 3 01?"),
    ("ruby", "ruby", r"ruby licen[cs]e", r"ruby"),
    ("perl", "perl", r"same terms as perl(?: itself)?", r"perl"),
    ("openssl", "openssl", r"openssl licen[cs]e", r"openssl"),
    ("openldap", "openldap", r"openldap public licen[cs]e", r"oldap 2 8"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", r"postgresql"),
    ("sqlite", "may you do good", r"may you do good and not evil", r"blessing"),
    ("w3c", "w3c", r"w3c(?: software)?(?: notice and)? licen[cs]e", r"w3c"),
    ("ofl", "open font", r"(?:sil )?open font licen[cs]e(?: (?:version )?1 1)?", r"ofl 1 1"),
    ("ncsa", "illinois", r"university of illinois(?: ncsa)? open source licen[cs]e", r"ncsa"),
    ("afl", "academic free", r"academic free licen[cs]e", r"afl 3 0"),
    ("osl", "open software", r"open software licen[cs]e", r"osl 3 0"),
    ("eupl", "european union", r"european union public licen[cs]e", r"eupl 1 [12]"),
    ("cecill", "cecill", r"cecill(?: [bc])?(?: free software)?(?: licen[cs]e)?", r"cecill 2 [01]"),
    ("upl", "universal permissive", r"universal permissive licen[cs]e", r"upl 1 0"),
    ("bsl", "business source", r"business source licen[cs]e(?: 1 1)?", r"busl 1 1"),
    ("sspl", "server side public", r"server side public licen[cs]e", r"sspl 1 0"),
    ("elastic", "elastic", r"elastic licen[cs]e(?: 2 0)?", r"elastic 2 0"),
    ("vim", "vim", r"vim licen[cs]e", r"vim"),
    ("beerware", "beer", r"beer ?ware licen[cs]e", r"beerware"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?", r"cc0 1 0"),
    ("cc-by", "cc by", r"cc by(?: [1234] [05])?", r"cc by [1234] [05]"),
    ("cc-by-sa", "cc by sa", r"cc by sa(?: [1234] [05])?", r"cc by sa [1234] [05]"),
    ("cc-by-nc", "cc by nc", r"cc by nc(?: [1234] [05])?", r"cc by nc [1234] [05]"),
    ("cc-by-nd", "cc by nd", r"cc by nd(?: [1234] [05])?", r"cc by nd [1234] [05]"),
    ("cc-by-nc-sa", "cc by nc sa", r"cc by nc sa(?: [1234] [05])?", r"cc by nc sa [1234] [05]"),
    ("cc-by-nc-nd", "cc by nc nd", r"cc by nc nd(?: [1234] [05])?", r"cc by nc nd [1234] [05]"),
    ("cc-by", "creative commons", r"creative commons attribution(?: licen[cs]e)?(?: [1234] [05])?", r"cc by"),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike(?: licen[cs]e)?(?: [1234] [05])?", r"cc by sa"),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial(?: licen[cs]e)?(?: [1234] [05])?", r"cc by nc"),
    ("odbl", "open database", r"open database licen[cs]e", r"odbl 1 0"),
    ("odc-by", "open data commons", r"open data commons attribution licen[cs]e", r"odc by 1 0"),
    ("ogl", "open government", r"open government licen[cs]e", r"ogl uk 3 0"),
    ("openrail", "responsible ai|openrail", r"responsible ai licen[cs]e|openrail(?: m)?", r"openrail"),
)

#: Sentences of the licenses themselves and of other notices: label, keywords, regex, priority.
CLAUSES = (
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy", 95),
    ("mit", "merge publish distribute", r"use copy modify merge publish distribute sublicense and or sell copies of the software", 80),
    ("mit", "substantial portions", r"shall be included in all copies or substantial portions of the software", 75),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose", 95),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted", 90),
    ("bsd-3", "neither the name", r"neither the name of .{1,120}? nor the names of its contributors may be used", 92),
    ("bsd-4", "advertising materials", r"all advertising materials mentioning features or use of this software", 93),
    ("apache", "limitations under", r"see the license for the specific language governing permissions and limitations under the license", 85),
    ("apache", "compliance with the license", r"you may not use this file except in compliance with the license", 90),
    ("apache", "apache org", r"www apache org licenses license 2 0", 90),
    ("gpl", "redistribute it and", r"redistribute it and or modify it under the terms of the gnu general public license", 90),
    ("lgpl", "redistribute it and", r"redistribute it and or modify it under the terms of the gnu lesser general public license", 91),
    ("agpl", "redistribute it and", r"redistribute it and or modify it under the terms of the gnu affero general public license", 92),
    ("gpl", "gnu org licenses", r"www gnu org licenses(?: gpl)?", 60),
    ("mpl", "mozilla public", r"subject to the terms of the mozilla public license", 92),
    ("epl", "eclipse public", r"made available under the terms of the eclipse public license", 92),
    ("zlib", "as is without any express", r"provided as is without any express or implied warranty in no event will the authors", 90),
    ("unlicense", "free and unencumbered", r"free and unencumbered software released into the public domain", 95),
    ("public-domain", "public domain", r"(?:released|placed|dedicated|in)(?: in| into| to)? the public domain", 60),
    ("cc0", "creativecommons org", r"creativecommons org publicdomain zero 1 0", 90),
    ("cc-by", "creativecommons org", r"creativecommons org licenses by [1234] [05]", 90),
    ("cc-by-sa", "creativecommons org", r"creativecommons org licenses by sa [1234] [05]", 90),
    ("cc-by-nc", "creativecommons org", r"creativecommons org licenses by nc(?: sa| nd)? [1234] [05]", 90),
    ("proprietary", "all rights reserved", r"copyright .{1,80}? all rights reserved", 40),
    ("proprietary", "all rights reserved", r"all rights reserved", 30),
    ("proprietary", "proprietary", r"proprietary and confidential", 60),
    ("proprietary", "written permission|written consent", r"without (?:the )?(?:express |prior )*written (?:permission|consent)", 35),
    ("mit", "without warranty of any kind", r"the software is provided as is without warranty of any kind express or implied", 70),
    ("mit", "authors or copyright", r"in no event shall the authors or copyright holders be liable for any claim", 65),
    ("json", "good not evil", r"the software shall be used for good not evil", 97),
    ("boost", "person or organization obtaining", r"permission is hereby granted free of charge to any person or organization obtaining a copy", 96),
    ("unicode", "unicode data", r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files", 97),
    ("bsd", "redistributions of source", r"redistributions of source code must retain the above copyright notice", 85),
    ("bsd", "redistributions in binary", r"redistributions in binary form must reproduce the above copyright notice", 85),
    ("bsd", "contributors as is", r"this software is provided by the (?:copyright holders|regents|author) and contributors as is", 80),
    ("isc", "disclaims all warranties", r"the software is provided as is and the author disclaims all warranties", 85),
    ("curl", "with or without fee", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", 94),
    ("ntp", "with or without fee", r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee", 94),
    ("hpnd", "is hereby granted without fee", r"permission to use copy modify(?: and)? distribute(?: and sell)? this software and its documentation for any purpose is hereby granted without fee", 93),
    ("postgresql", "without fee and without", r"and its documentation for any purpose without fee and without a written agreement is hereby granted", 94),
    ("apache", "licensed to the apache", r"licensed to the apache software foundation asf under one or more contributor license agreements", 95),
    ("apache", "unless required by applicable", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 85),
    ("apache", "perpetual worldwide non", r"perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license", 85),
    ("apache-1.1", "this product includes software", r"this product includes software developed by the apache software foundation", 90),
    ("openssl", "this product includes software", r"this product includes software developed by the openssl project", 93),
    ("openssl", "names openssl", r"the names openssl toolkit and openssl project must not be used", 92),
    ("php", "this product includes php", r"this product includes php software freely available from", 92),
    ("gpl", "this program is free", r"this program is free software you can redistribute it", 88),
    ("gpl", "you should have received", r"you should have received a copy of the gnu general public license", 80),
    ("lgpl", "you should have received", r"you should have received a copy of the gnu (?:lesser|library) general public license", 82),
    ("agpl", "you should have received", r"you should have received a copy of the gnu affero general public license", 83),
    ("gpl", "hope that it will", r"in the hope that it will be useful but without any warranty", 70),
    ("gpl-classpath", "linking this library", r"linking this library statically or dynamically with other modules", 90),
    ("gfdl", "distribute and or modify this", r"permission is granted to copy distribute and or modify this document", 93),
    ("gfdl", "no invariant sections", r"with no invariant sections no front cover texts and no back cover texts", 90),
    ("mpl", "this source code form", r"this source code form is subject to the terms of the mozilla public license", 94),
    ("mpl", "contents of this file", r"the contents of this file are subject to the mozilla public license", 93),
    ("mpl", "copy of the mpl", r"if a copy of the mpl was not distributed with this file", 90),
    ("cddl", "contents of this file", r"the contents of this file are subject to the terms of the common development and distribution license", 94),
    ("cddl", "include this cddl", r"when distributing covered (?:code|software) include this cddl header", 90),
    ("epl", "accompanying materials", r"this program and the accompanying materials are made available under", 80),
    ("artistic", "verbatim copies of the source", r"you may make and give away verbatim copies of the source form", 85),
    ("artistic", "this package is provided", r"this package is provided as is and without any express or implied warranties", 85),
    ("zlib", "altered source", r"altered source versions must be plainly marked as such", 90),
    ("zlib", "origin of this software", r"the origin of this software must not be misrepresented", 90),
    ("wtfpl", "you just do", r"you just do what the \S+ you want to", 90),
    ("beerware", "buy me a beer", r"you can buy me a beer in return", 90),
    ("unlicense", "anyone is free", r"anyone is free to copy modify publish use compile sell or distribute this software", 95),
    ("cc0", "copyright and related", r"waived all (?:of his or her )?(?:rights to the work worldwide under )?copyright and related (?:or|and) neighboring rights", 92),
    ("cc0", "associated a work", r"the person who associated a work with this deed", 90),
    ("cc", "appropriate credit", r"you must give appropriate credit provide a link to the license and indicate if changes were made", 75),
    ("cc", "redistribute the material", r"share copy and redistribute the material in any medium or format", 70),
    ("cc-by-nc", "material for commercial", r"you may not use the material for commercial purposes", 80),
    ("cc-by-sa", "contributions under the same", r"you must distribute your contributions under the same license as the original", 80),
    ("cc-by-nd", "distribute the modified material", r"you may not distribute the modified material", 80),
    ("ofl", "this font software", r"this font software is licensed under the sil open font license", 95),
    ("ofl", "original or modified versions", r"neither the font software nor any of its individual components in original or modified versions may be sold by itself", 90),
    ("ftl", "freetype project", r"portions of this software are copyright .{1,60}? the freetype project", 92),
    ("ijg", "independent jpeg", r"based in part on the work of the independent jpeg group", 90),
    ("imagemagick", "imagemagick studio", r"imagemagick studio llc", 70),
    ("psf", "psf is making|psf hereby", r"psf is making python(?: .{1,20}?)? available to licensee on an as is basis|psf hereby grants licensee a nonexclusive royalty free", 92),
    ("w3c", "obtaining and or copying", r"by obtaining and or copying this work you the licensee agree", 92),
    ("vim", "no restrictions on distributing", r"there are no restrictions on distributing unmodified copies of vim", 92),
    ("elastic", "hosted or managed", r"you may not provide the software to third parties as a hosted or managed service", 92),
    ("sspl", "third parties as a service", r"functionality of the program or a modified version available to third parties as a service", 92),
    ("bsl", "non production use", r"redistribute and make non production use of the licensed work", 92),
    ("commons-clause", "commons clause", r"commons clause(?: license condition)?", 80),
    ("commons-clause", "right to sell the software", r"does not include and the license does not grant to you the right to sell the software", 92),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|internal use|perimeter|shield|strict)", 85),
    ("llama", "llama", r"llama(?: [234](?: [123])?)? community license", 85),
    ("openrail", "use based restrictions", r"use based restrictions as set forth in attachment a", 90),
    ("perl", "same terms as perl", r"(?:modify|redistribute) it under the same terms as perl itself", 90),
    ("public-domain", "copyright protection", r"not subject to copyright protection(?: in the united states)?", 70),
    ("public-domain", "no copyright is", r"no copyright is claimed", 55),
    ("dual", "dual licensed", r"dual licensed under", 40),
    ("eula", "end user", r"end user licen[cs]e agreement", 45),
    ("see-file", "see the license|see the file|see license", r"see the license file for|see the file (?:license|copying) for|see license (?:txt|md) for", 25),
    ("proprietary", "no part of this", r"no part of this (?:publication|document|work) may be reproduced", 55),
    ("proprietary", "reproduced in any form", r"may not be reproduced in any form", 50),
    ("proprietary", "unauthorized|unauthorised", r"unauthori[sz]ed (?:copying|reproduction|distribution|use) of this (?:file|document|software)", 50),
    ("proprietary", "evaluation purposes", r"for evaluation purposes only", 45),
    ("proprietary", "trade secrets", r"contains (?:confidential information and )?trade secrets of", 50),
    ("non-commercial", "personal and non", r"for (?:your )?personal and non ?commercial use", 50),
    ("non-commercial", "research purposes", r"for (?:academic or |non commercial )?research purposes only", 45),
    ("non-commercial", "non commercial use|noncommercial use", r"(?:for )?non ?commercial use only", 55),
)


def rules() -> list[tuple[str, str, str, int]]:
    """(label, keywords parted by |, regex, priority): the clauses, and every license named plainly, granted, and by identifier."""
    grant = r"(?:licensed|released|distributed|available|provided|published|redistributed|covered) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:gnu )?"
    out = list(CLAUSES)
    for label, keyword, name, spdx in LICENSES:
        out += [(label, keyword, rf"(?:{name})", 50), (label, keyword, rf"{grant}(?:{name})", 70), (label, "spdx", rf"spdx license identifier (?:{spdx})", 100)]
    return out


def any_of(words: list[str]) -> str:
    """A regex that finds any of words; what words have in common in front is written once, so that few letters are tried at a place."""
    if "" in words:
        return ""
    heads = list(dict.fromkeys(w[0] for w in words))
    parts = [re.escape(h) + any_of([w[1:] for w in words if w[0] == h]) for h in heads]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def _keywords(keywords: str) -> list[Column]:
    return [F.lit(f" {k}") for k in keywords.split("|")]


def _positions(words: Column, phrase: str) -> Column:
    """The places, from 0, where the phrase's words stand consecutively."""
    parts = phrase.split()

    def place(word: Column, i: Column) -> Column:
        return F.when(reduce(lambda a, b: a & b, [word == parts[0], *(F.get(words, i + k) == p for k, p in enumerate(parts[1:], 1))]), i)

    return F.filter(F.transform(words, place), lambda i: i.isNotNull())


def _in_blocks(values: Column) -> Column:
    """values cut in runs of BLOCK: arrays grow within a run, so that building one costs as much for each of its values."""
    starts = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.slice(values, s, F.lit(BLOCK)))


def _detections(text: Column, rule: Column) -> Column:
    """The intervals [start, end) of a rule's matches, from the lengths of matches and of what lies between."""
    regex = F.concat(F.lit("(?<= )"), rule["regex"], F.lit("(?= )"))
    found, between = F.regexp_extract_all(text, regex, F.lit(0)), F.split(text, regex, -1)
    sizes = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, m: F.struct(F.length(b).alias("b"), F.length(m).alias("m")))

    def run(at: Column, block: Column) -> Column:
        empty = F.struct(at.alias("at"), F.array().cast(f"array<{HIT}>").alias("out"))

        def step(acc: Column, s: Column) -> Column:
            first = acc["at"] + s["b"]
            hit = F.struct(first.alias("first"), (-(first + s["m"])).alias("back"), (-rule["priority"]).alias("rank"), rule["label"].alias("label"))
            return F.struct((first + s["m"]).alias("at"), F.concat(acc["out"], F.array(hit)).alias("out"))

        return F.aggregate(block, empty, step, lambda acc: acc["out"])

    def offset(acc: Column, block: Column) -> Column:
        return F.struct(F.aggregate(block, acc["at"], lambda n, s: n + s["b"] + s["m"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.flatten(F.transform(F.array(_in_blocks(sizes)), lambda blocks: F.flatten(F.zip_with(F.aggregate(blocks, none, offset, lambda acc: acc["out"]), blocks, run))))


def _unsuppressed(found: Column) -> Column:
    """Detections that no other one covers with a higher priority, or with the same and a wider interval, by their places.

    One pass in the order of starts, wider intervals first: reach holds, for each priority from the highest, how far the
    intervals before reach, and here the same for those that equal the one at hand.
    """
    levels = sorted({p for *_, p in rules()}, reverse=True)
    level = F.create_map(*(F.lit(x) for k, p in enumerate(levels) for x in (-p, k)))
    none = F.array_repeat(F.lit(-1), len(levels))
    kept = "array<struct<label:string,priority:int,first:int,last:int>>"

    def step(acc: Column, d: Column) -> Column:
        fresh = (d["first"] != acc["first"]) | (d["back"] != acc["back"])
        reach = F.when(fresh, F.zip_with(acc["reach"], acc["here"], lambda a, b: F.greatest(a, b))).otherwise(acc["reach"])
        here = F.when(fresh, none).otherwise(acc["here"])
        k, last = level[d["rank"]], -d["back"]
        higher = F.exists(F.slice(reach, F.lit(1), k), lambda r: r >= last) | F.exists(F.slice(here, F.lit(1), k), lambda r: r >= last)
        covered = higher | (F.get(reach, k) >= last)
        hit = F.struct(d["label"].alias("label"), (-d["rank"]).alias("priority"), d["first"].alias("first"), last.alias("last"))
        out = F.when(covered, acc["out"]).otherwise(F.concat(acc["out"], F.array(hit)))
        here = F.transform(here, lambda r, i: F.when(i == k, F.greatest(r, last)).otherwise(r))
        return F.struct(d["first"].alias("first"), d["back"].alias("back"), reach.alias("reach"), here.alias("here"), out.alias("out"))

    def block(acc: Column, b: Column) -> Column:
        own = F.struct(*(acc[c].alias(c) for c in ("first", "back", "reach", "here")), F.array().cast(kept).alias("out"))
        return F.transform(F.array(F.aggregate(b, own, step)), lambda r: F.struct(*(r[c].alias(c) for c in ("first", "back", "reach", "here")), F.concat(acc["out"], r["out"]).alias("out")))[0]

    start = F.struct(F.lit(-1).alias("first"), F.lit(0).alias("back"), none.alias("reach"), none.alias("here"), F.array().cast(kept).alias("out"))
    return F.aggregate(_in_blocks(F.sort_array(found)), start, block, lambda acc: acc["out"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    Words are runs of digits, letters a-z and everything beyond ASCII, after lower-casing A-Z. The base
    counts all places of the phrases BASE; labels adds those of the rules. score is the highest
    priority among detections over 100, at least 0.5 where the base matched, and 0 where nothing
    did. detections holds (label, priority, first, last) in characters of the words joined by blanks.
    A null or empty text has n_words 0, no labels (""), null places and score 0. Rows are
    independent; repeated rows repeat their result; other columns are ignored.
    """
    table = F.array(*(F.struct(F.lit(a).alias("label"), F.array(*_keywords(b)).alias("keywords"), F.lit(c).alias("regex"), F.lit(d).alias("priority")) for a, b, c, d in rules()))
    names = list(dict.fromkeys(k for _, b, _, _ in rules() for k in b.split("|")))
    every = F.array(*_keywords("|".join(names)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Lower-cased beyond ASCII as well, which is quick: words begin and end alike, and hold the same keywords at least.
    rows = rows.select("doc_id", "text", F.regexp_replace(F.concat(F.lit(" "), F.lower("text"), F.lit(" ")), BETWEEN, " ").alias("low"))
    n_words = F.octet_length("low") - F.octet_length(F.replace("low", F.lit(" "), F.lit(""))) - 1
    rows = rows.select("doc_id", "text", n_words.cast("long").alias("n_words"), F.col("low").rlike(any_of([f" {k}" for k in sorted(names)])).alias("any"), "low")
    rows = rows.select("doc_id", "text", "n_words", F.when(F.col("any"), F.filter(every, lambda k: F.contains(F.col("low"), k))).alias("held"))
    line = F.regexp_replace(F.concat(F.lit(" "), F.translate("text", UPPER, LOWER), F.lit(" ")), BETWEEN, " ")
    rows = rows.select("doc_id", "n_words", "held", F.when(F.size("held") > 0, line).alias("line"))
    rows = rows.select("doc_id", "n_words", "held", "line", F.when(reduce(or_, [F.contains("line", F.lit(f" {p} ")) for p in BASE]), F.split(F.trim("line"), " ", -1)).alias("words"))
    rows = rows.select("doc_id", "n_words", "held", "line", F.array(*(_positions(F.col("words"), p) for p in BASE)).alias("places"))
    tried = F.filter(table, lambda r: F.arrays_overlap(r["keywords"], F.col("held")))
    rows = rows.select("doc_id", "n_words", "places", F.when(F.col("line").isNotNull(), F.flatten(F.transform(tried, lambda r: _detections(F.col("line"), r)))).alias("found"))
    rows = rows.withColumn("found", F.coalesce("found", F.array().cast(f"array<{HIT}>")))
    rows = rows.select("doc_id", "n_words", "places", _unsuppressed(F.col("found")).alias("detections"))
    places = F.flatten("places")
    base = F.array_sort(F.array_compact(F.array(*(F.when(F.size(F.col("places")[k]) > 0, F.lit(label)) for k, label in enumerate(BASE.values())))))
    n_base = reduce(add, [F.greatest(F.size(F.col("places")[k]), F.lit(0)) for k in range(len(BASE))])
    own = F.coalesce(F.transform("detections", lambda d: d["label"]), F.array().cast("array<string>"))
    best = F.coalesce(F.array_max(F.transform("detections", lambda d: d["priority"])), F.lit(0)) / 100.0
    return rows.select(
        "doc_id", "n_words", F.coalesce(n_base, F.lit(0)).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        F.greatest(best, F.when(n_base > 0, 0.5).otherwise(0.0)).alias("score"), "detections",
    )
