"""Signature rules of the license scan.

Texts are matched as lower-cased words with single blanks between and around them, so ``2.0`` reads ``2 0``.  A family
is written by hand as (label, words one of which every mention holds, pattern of its name); the forms below turn each name into
rules of rising priority: a bare name, a grant under that name, a declaration of the license.  Each label also is a
machine-readable tag.  Notices have no name and stand alone.  A rule runs only where its keyword and its second word both occur in the document.
"""

from __future__ import annotations

L = "licen[cs]e"
V = "(?: version| v)?"  # before a number, which may hold the v itself: "v3"

# (label, word in every mention, name)
FAMILIES = [
    ("apache-1.0", "apache", rf"apache (?:software )?{L}{V} v?1 0"),
    ("apache-1.1", "apache", rf"apache (?:software )?{L}{V} v?1 1"),
    ("apache-2.0", "apache", rf"apache (?:software )?(?:{L} )?(?:version |v)?2(?: 0)?(?: {L})?"),
    ("apache", "apache", rf"apache (?:software )?{L}"),
    ("mit", "mit", rf"mit {L}"),
    ("mit-0", "mit", rf"mit (?:no attribution|0) {L}"),
    ("x11", "x11", rf"x11 {L}"),
    ("expat", "expat", rf"expat {L}"),
    ("isc", "isc", rf"isc {L}"),
    ("bsd-1-clause", "bsd", rf"bsd (?:1|one) clause(?: {L})?"),
    ("bsd-2-clause", "bsd|freebsd", rf"(?:bsd (?:2|two) clause|simplified bsd|freebsd)(?: {L})?"),
    ("bsd-3-clause", "bsd", rf"(?:bsd (?:3|three) clause|(?:new|modified|revised) bsd)(?: {L})?"),
    ("bsd-4-clause", "bsd", rf"(?:bsd (?:4|four) clause|original bsd)(?: {L})?"),
    ("bsd", "bsd", rf"bsd(?: style)? {L}"),
    ("0bsd", "0bsd", rf"0bsd(?: {L})?"),
    ("gpl-1.0", "general", rf"(?:gnu )?general public {L}{V} v?1(?: 0)?"),
    ("gpl-2.0", "general", rf"(?:gnu )?general public {L}{V} v?2(?: 0)?"),
    ("gpl-2.0-or-later", "general", rf"(?:gnu )?general public {L} (?:either )?version 2 (?:of the {L} )?or (?:at your option )?any later version"),
    ("gpl-3.0", "general", rf"(?:gnu )?general public {L}{V} v?3(?: 0)?"),
    ("gpl-3.0-or-later", "general", rf"(?:gnu )?general public {L} (?:either )?version 3 (?:of the {L} )?or (?:at your option )?any later version"),
    ("gpl-2.0", "gpl|gpl2", r"(?:gnu )?gpl(?: version| v)? ?2(?: 0)?"),
    ("gpl-3.0", "gpl|gpl3", r"(?:gnu )?gpl(?: version| v)? ?3(?: 0)?"),
    ("lgpl-2.0", "general", rf"(?:gnu )?library general public {L}(?:{V} v?2(?: 0)?)?"),
    ("lgpl-2.1", "general", rf"(?:gnu )?lesser general public {L}{V} v?2 1"),
    ("lgpl-3.0", "general", rf"(?:gnu )?lesser general public {L}{V} v?3(?: 0)?"),
    ("lgpl", "general", rf"(?:gnu )?(?:lesser|library) general public {L}"),
    ("lgpl", "lgpl|lgpl2|lgpl3", r"(?:gnu )?lgpl(?: version| v)?(?: ?[23](?: [01])?)?"),
    ("agpl-3.0", "general", rf"(?:gnu )?affero general public {L}(?:{V} v?3(?: 0)?)?"),
    ("agpl-1.0", "general", rf"affero general public {L}{V} v?1(?: 0)?"),
    ("agpl-3.0", "agpl|agpl3", r"(?:gnu )?agpl(?: version| v)?(?: ?3(?: 0)?)?"),
    ("gfdl", "documentation", rf"(?:gnu )?free documentation {L}(?:{V} v?1 [123])?"),
    ("mpl-1.0", "mozilla", rf"mozilla public {L}{V} v?1 0"),
    ("mpl-1.1", "mozilla", rf"mozilla public {L}{V} v?1 1"),
    ("mpl-2.0", "mozilla", rf"mozilla public {L}{V} v?2(?: 0)?"),
    ("mpl", "mozilla", rf"mozilla public {L}"),
    ("epl-1.0", "eclipse", rf"eclipse public {L}{V} v?1 0"),
    ("epl-2.0", "eclipse", rf"eclipse public {L}{V} v?2(?: 0)?"),
    ("epl", "eclipse", rf"eclipse public {L}"),
    ("eclipse-distribution", "eclipse", rf"eclipse distribution {L}(?:{V} v?1 0)?"),
    ("cddl-1.0", "distribution", rf"common development and distribution {L}{V} v?1 0"),
    ("cddl-1.1", "distribution", rf"common development and distribution {L}{V} v?1 1"),
    ("cddl", "distribution", rf"common development and distribution {L}"),
    ("cpl-1.0", "common", rf"common public {L}(?:{V} v?1 0)?"),
    ("ipl-1.0", "ibm", rf"ibm public {L}(?:{V} v?1 0)?"),
    ("eupl-1.1", "european", rf"european union public {L}{V} v?1 1"),
    ("eupl-1.2", "european", rf"european union public {L}{V} v?1 2"),
    ("eupl", "european", rf"european union public {L}"),
    ("artistic-1.0", "artistic", rf"artistic {L}{V} v?1(?: 0)?"),
    ("artistic-2.0", "artistic", rf"artistic {L}{V} v?2(?: 0)?"),
    ("artistic", "artistic", rf"artistic {L}"),
    ("zlib", "zlib", rf"zlib(?: libpng)? {L}"),
    ("libpng", "libpng", rf"libpng {L}"),
    ("boost-1.0", "boost", rf"boost software {L}(?:{V} v?1 0)?"),
    ("psf-2.0", "python", rf"python software foundation {L}(?:{V} v?2)?"),
    ("php-3.01", "php", rf"php {L}(?:{V} v?3 0 ?1?)?"),
    ("postgresql", "postgresql", rf"postgresql {L}"),
    ("openssl", "openssl", rf"openssl {L}"),
    ("ruby", "ruby", rf"ruby(?: s)? {L}"),
    ("w3c", "w3c", rf"w3c (?:software )?(?:notice and )?{L}"),
    ("wtfpl", "wtfpl", rf"wtfpl(?: {L})?"),
    ("wtfpl", "want", rf"do what the f\S* you want to public {L}"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("ncsa", "ncsa", rf"(?:university of illinois )?ncsa(?: open source)? {L}"),
    ("ms-pl", "microsoft", rf"microsoft public {L}"),
    ("ms-rl", "microsoft", rf"microsoft reciprocal {L}"),
    ("ofl-1.1", "font", rf"(?:sil )?open font {L}(?:{V} v?1 1)?"),
    ("osl-3.0", "open", rf"open software {L}{V} v?3 0"),
    ("afl-3.0", "academic", rf"academic free {L}(?:{V} v?[23] [01])?"),
    ("ecl-2.0", "community", rf"educational community {L}(?:{V} v?2 0)?"),
    ("upl-1.0", "universal", rf"universal permissive {L}(?:{V} v?1 0)?"),
    ("cecill", "cecill", rf"cecill(?: [bc])?(?: free software)?(?: {L})?(?: agreement)?"),
    ("qpl-1.0", "public", rf"q public {L}(?:{V} v?1 0)?"),
    ("sleepycat", "sleepycat", rf"sleepycat {L}"),
    ("vim", "vim", rf"vim {L}"),
    ("beerware", "beer", rf"beer ?ware {L}"),
    ("odbl-1.0", "database", rf"open database {L}(?:{V} v?1 0)?"),
    ("odc-by-1.0", "data", rf"open data commons attribution {L}(?:{V} v?1 0)?"),
    ("pddl-1.0", "domain", rf"(?:open data commons )?public domain dedication and {L}"),
    ("ogl-uk", "government", rf"open government {L}(?:{V} v?[123] 0)?"),
    ("llama", "llama", rf"llama (?:[23] )?(?:\d )?community {L}(?: agreement)?"),
    ("rail", "responsible|rail|openrail", rf"(?:open ?)?rail(?: m)? (?:responsible ai )?{L}|responsible ai {L}"),
    ("sspl-1.0", "server", rf"server side public {L}(?:{V} v?1)?"),
    ("bsl-1.1", "business", rf"business source {L}(?:{V} v?1 1)?"),
    ("elastic-2.0", "elastic", rf"elastic {L}(?:{V} v?2(?: 0)?)?"),
    ("commons-clause", "clause", rf"commons clause(?: {L} condition)?(?:{V} v?1 0)?"),
    ("polyform", "polyform", rf"polyform \w+(?: \w+)? {L}(?: 1 0 0)?"),
    ("cc0-1.0", "cc0", r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-sa", "cc", r"cc by sa(?: [1234] [05])?"),
    ("cc-by-nc", "cc", r"cc by nc(?: [1234] [05])?"),
    ("cc-by-nd", "cc", r"cc by nd(?: [1234] [05])?"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: [1234] [05])?"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: [1234] [05])?"),
    ("cc-by", "cc", r"cc by [1234] [05]"),
    ("cc-by", "creative", rf"creative commons attribution(?: [1234] [05])?(?: international| unported| generic)?(?: public)?(?: {L})?"),
    ("cc-by-sa", "creative", rf"creative commons attribution share ?alike(?: [1234] [05])?(?: international| unported| generic)?(?: public)?(?: {L})?"),
    ("cc-by-nc", "creative", rf"creative commons attribution non ?commercial(?: [1234] [05])?(?: international| unported| generic)?(?: public)?(?: {L})?"),
    ("cc-by-nd", "creative", rf"creative commons attribution no ?deriv(?:s|atives)(?: [1234] [05])?(?: international| unported| generic)?(?: public)?(?: {L})?"),
    ("cc-by-nc-sa", "creative", rf"creative commons attribution non ?commercial share ?alike(?: [1234] [05])?(?: international| unported| generic)?(?: public)?(?: {L})?"),
    ("cc-by-nc-nd", "creative", rf"creative commons attribution non ?commercial no ?deriv(?:s|atives)(?: [1234] [05])?(?: international| unported| generic)?(?: public)?(?: {L})?"),
    ("creative-commons", "creative", rf"creative commons(?: public)? {L}"),
]

# (priority, confidence, form): {} is the family's name
FORMS = [
    (1, 0.7, "{}"),
    (2, 0.9, "(?:(?:re)?licensed|released|distributed|published|provided|available|covered|shared|used|made available)(?: to you)?(?: only)? (?:under|subject to|in accordance with) "
             "(?:the )?(?:terms (?:and conditions )?of )?(?:either )?(?:the |a |an )?{}"),
    (3, 0.97, "(?:spdx )?license(?: s)?(?: identifier| type| name| expression)?(?: is)? (?:the )?{}"),
]

# (label, keyword, second word, priority, confidence, pattern)
NOTICES = [
    ("mit", "permission", "charge", 4, 0.99, "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "sublicense", "merge", 3, 0.95, "to use copy modify merge publish distribute sublicense and or sell copies"),
    ("isc", "permission", "fee", 4, 0.99, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", "binary", 3, 0.95, "redistribution and use in source and binary forms(?: with or without modification)?(?: are permitted)?"),
    ("bsd-3-clause", "permission", "endorse", 4, 0.97, "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "acknowledgment|acknowledgement", "advertising", 4, 0.97, "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("gpl", "redistribute", "redistribute", 3, 0.95, f"you can redistribute it and or modify it under the terms of the gnu general public {L}"),
    ("gpl", "copyleft", "copyleft", 1, 0.5, "copyleft"),
    ("apache-2.0", "license|licence", "compliance", 3, 0.95, f"you may not use this file except in compliance with the {L}"),
    ("zlib", "warranty", "express", 3, 0.9, "this software is provided as is without any express or implied warranty in no event"),
    ("warranty-disclaimer", "warranty", "warranty", 1, 0.4, "without (?:any )?warranty of any kind"),
    ("warranty-disclaimer", "warranty", "warranty", 1, 0.4, "without even the implied warranty of merchantability"),
    ("warranty-disclaimer", "merchantability", "fitness", 1, 0.4, "merchantability (?:and|or) fitness for a particular purpose"),
    ("liability-disclaimer", "liable", "liable", 1, 0.4, "in no event shall .{0,80}be liable for any (?:claim |direct )?(?:indirect )?.{0,40}damages"),
    ("public-domain", "domain", "public", 1, 0.6, "(?:in|into|to) the public domain"),
    ("public-domain", "domain", "dedicated", 2, 0.9, "dedicated to the public domain"),
    ("public-domain", "domain", "released", 2, 0.9, "released (?:in)?to the public domain"),
    ("public-domain", "unencumbered", "free", 4, 0.97, "this is free and unencumbered software released into the public domain"),
    ("proprietary", "proprietary", "confidential", 2, 0.9, "(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "proprietary", "proprietary", 1, 0.6, f"proprietary (?:software|{L}|information)"),
    ("proprietary", "unauthorized", "copying", 2, 0.85, "unauthorized copying of this (?:file|document|software|work)"),
    ("proprietary", "reproduced", "permission", 2, 0.85, "(?:no part of .{0,60})?may (?:not )?be reproduced .{0,80}without (?:the )?(?:prior )?(?:written )?permission"),
    ("proprietary", "consent", "written", 1, 0.6, "without (?:the )?(?:express |prior )?written consent"),
    ("eula", "eula", "eula", 1, 0.6, "eula"),
    ("eula", "license|licence", "user", 2, 0.85, f"end user {L} agreement"),
    ("terms", "terms", "service", 1, 0.3, "terms of service"),
    ("terms", "terms", "use", 1, 0.3, "terms of use"),
    ("copyright", "copyright", "copyright", 1, 0.5, r"copyright(?: c)? (?:19|20)\d\d(?: (?:19|20)\d\d)?"),
    ("copyright", "copyright", "copyright", 1, 0.4, r"copyright(?: c)? (?:by )?the (?:authors|contributors)"),
    ("copyright", "copyrighted", "copyrighted", 1, 0.4, "copyrighted (?:material|work)"),
    ("copyright", "copyright", "holder|owner", 1, 0.5, "copyright (?:holders?|owners?)"),
    ("non-commercial", "commercial|noncommercial", "non", 1, 0.5, "(?:for )?non ?commercial (?:use|purposes)(?: only)?"),
    ("personal-use", "personal", "use", 1, 0.4, "for personal use only"),
    ("educational-use", "educational", "purposes", 1, 0.4, "for educational purposes only"),
    ("royalty-free", "royalty", "free", 1, 0.5, "royalty free"),
    ("patent-grant", "perpetual", "perpetual", 3, 0.9, f"perpetual worldwide non ?exclusive no ?charge royalty ?free irrevocable (?:patent|copyright) {L}"),
    ("trademark", "trademark|trademarks", "registered", 1, 0.4, "registered trademarks? of"),
    ("trademark", "trademarks", "registered", 1, 0.4, "registered trademarks of"),
    ("some-rights-reserved", "reserved", "some", 2, 0.8, "some rights reserved"),
    ("no-rights-reserved", "reserved", "no", 2, 0.8, "no rights reserved"),
    ("license-file", "license|licence", "see", 1, 0.4, f"see (?:the )?(?:file )?{L}(?: file)?(?: txt| md)? for (?:more )?(?:details|information)"),
    ("license-file", "received", "received", 1, 0.5, f"you should have received a copy of the .{{0,60}}{L}"),
    ("dual-license", "dual", "dual", 1, 0.6, "dual licensed"),
    ("shareware", "shareware", "shareware", 1, 0.5, "shareware"),
    ("freeware", "freeware", "freeware", 1, 0.5, "freeware"),
]

# Base phrases keep their places and labels whatever else is found.
BASE = [("cc-by", "cc", "cc by"), ("gpl", "license", "general public license"), ("reserved", "reserved", "all rights reserved")]
BASE_PRIORITY, BASE_CONFIDENCE, TOP = 1, 0.6, 4

# Words that put a document to the rules of a family: its own name, or a word for licensing beside it.
NAMES = {"apache", "clause", "bsd", "0bsd", "gpl", "lgpl", "agpl", "mozilla", "eclipse", "unlicense", "wtfpl", "cc0", "cc", "creative", "cecill", "polyform", "zlib", "openssl", "sleepycat", "postgresql"}


def rules() -> list[dict]:
    """All rules in order.  A pattern has a row for each spelling of its keyword and second word, and every text that it
    matches passes the gate of one of these rows."""
    out = []

    def add(label, keyword, also, priority, confidence, pattern, base=False):
        out.append({"no": len(out), "label": label, "keyword": keyword, "also": f" {also}", "priority": priority, "confidence": confidence, "pattern": f"(?<= )(?:{pattern})(?= )", "base": base})

    for label, keyword, phrase in BASE:
        add(label, keyword, phrase.split()[0], BASE_PRIORITY, BASE_CONFIDENCE, phrase, True)
    for label, keywords, others, priority, confidence, pattern in NOTICES:
        for keyword in keywords.split("|"):
            for also in others.split("|"):
                add(label, keyword, also, priority, confidence, pattern)
    for label in dict.fromkeys(f[0] for f in FAMILIES):
        words = label.replace("-", " ").replace(".", " ")
        add(label, "license", words.split()[0], TOP, 0.99, f"(?:spdx )?license identifier {words}(?: only)?")
    for label, word, name in FAMILIES:
        for priority, confidence, form in FORMS:
            for own in word.split("|"):
                for keyword in [own] if word.split("|")[0] in NAMES else ["license", "licence"]:
                    add(label, keyword, own, priority, confidence, form.format(f"(?:{name})"))
    return out
