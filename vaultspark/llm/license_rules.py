"""Signatures of licences, written by hand, and the language they are written in.

A signature is a phrase of words, lower-case, as a text's words are. One word is the anchor, marked '@': the keyword that gates the
signature. A word may hold a character class ('licen[cs]e', also as an anchor); 'w?' is an optional word, '{a b|c}' one of several
phrases, '{a b|c}?' one or none. Words within the phrase follow each other, whatever stood between them in the text.
"""

from __future__ import annotations

import itertools
import re

#: The phrases whose places and labels every scan reports.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Words of a text that a signature may use to the left and to the right of its anchor.
LEFT, RIGHT = 24, 24
TOP, NOTICE, NAME, WEAK = 3, 2, 1, 0
_CONFIDENCE = {"text": (NOTICE, 1.0), "spdx": (NOTICE, 0.95), "notice": (NOTICE, 0.9), "name": (NAME, 0.7), "loose": (NAME, 0.5), "weak": (WEAK, 0.3)}

#: (label, kind, signature). Kinds: text, from a licence's own text; spdx, an identifier; notice, how works refer to it; name; loose and weak mentions.
SIGNATURES = [
    ("mit", "text", "permission is @hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "text", "to use copy modify merge publish distribute @sublicense and or sell copies of the software"),
    ("mit", "text", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the @software"),
    ("mit", "notice", "{licensed|released|distributed|available|provided} under {the|an}? @mit {x11|expat}? licen[cs]e"),
    ("mit", "notice", "under the terms of the @mit licen[cs]e"),
    ("mit", "notice", "{this|the} {project|software|code|package|library} is @mit licensed"),
    ("mit", "notice", "licen[cs]e @mit"),
    ("mit", "spdx", "@spdx licen[cs]e identifier mit"),
    ("mit", "name", "@mit licen[cs]e"),
    ("mit", "name", "the? @expat licen[cs]e"),
    ("mit", "name", "@mit x11 licen[cs]e"),
    ("mit", "name", "opensource org licenses @mit"),
    ("mit", "name", "badge licen[cs]e @mit"),
    ("mit-0", "name", "@mit no attribution licen[cs]e?"),
    ("mit-0", "spdx", "@spdx licen[cs]e identifier mit 0"),
    ("x11", "text", "except as contained in this notice the name of {the}? {x consortium|[0-9a-z]+} shall not be used in @advertising"),
    ("x11", "name", "the? @x11 licen[cs]e"),
    ("isc", "text", "permission to use copy modify and or distribute this software for any purpose with or without fee is @hereby granted"),
    ("isc", "notice", "{licensed|released|distributed} under the @isc licen[cs]e"),
    ("isc", "spdx", "@spdx licen[cs]e identifier isc"),
    ("isc", "name", "@isc licen[cs]e"),
    ("0bsd", "spdx", "@spdx licen[cs]e identifier 0bsd"),
    ("0bsd", "name", "zero clause @bsd licen[cs]e?"),
    ("bsd", "text", "@redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "text", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following @disclaimer"),
    ("bsd", "notice", "use of this source code is governed by a @bsd style licen[cs]e"),
    ("bsd", "notice", "{licensed|released|distributed|available|provided} under {the|a} @bsd {style}? licen[cs]e"),
    ("bsd", "name", "@bsd licen[cs]e"),
    ("bsd", "name", "@berkeley software distribution licen[cs]e?"),
    ("bsd-2", "notice", "under the {simplified|freebsd} @bsd licen[cs]e"),
    ("bsd-2", "name", "{2|two} clause @bsd licen[cs]e?"),
    ("bsd-2", "name", "@bsd {2|two} clause licen[cs]e?"),
    ("bsd-2", "name", "simplified @bsd licen[cs]e"),
    ("bsd-2", "name", "@freebsd licen[cs]e"),
    ("bsd-2", "spdx", "@spdx licen[cs]e identifier bsd 2 clause?"),
    ("bsd-3", "text", "neither the name of [0-9a-z]+ {[0-9a-z]+}? {[0-9a-z]+}? {[0-9a-z]+}? nor the names of its contributors may be used to @endorse or promote products"),
    ("bsd-3", "name", "{3|three} clause @bsd licen[cs]e?"),
    ("bsd-3", "name", "@bsd {3|three} clause licen[cs]e?"),
    ("bsd-3", "name", "{new|modified|revised} @bsd licen[cs]e"),
    ("bsd-3", "spdx", "@spdx licen[cs]e identifier bsd 3 clause?"),
    ("bsd-4", "text", "all advertising materials mentioning features or use of this software must display the following @acknowledgement"),
    ("bsd-4", "name", "{4|four} clause @bsd licen[cs]e?"),
    ("bsd-4", "name", "original @bsd licen[cs]e"),
    ("bsd-4", "spdx", "@spdx licen[cs]e identifier bsd 4 clause?"),
    ("apache-2", "text", "@apache licen[cs]e version 2 0 january 2004"),
    ("apache-2", "notice", "licensed under the @apache licen[cs]e version 2 0? the license you may not use this file except in compliance"),
    ("apache-2", "notice", "{licensed|released|distributed|available|provided} under the @apache {software}? licen[cs]e {version|v}? 2 0?"),
    ("apache-2", "notice", "www @apache org licenses license 2 0"),
    ("apache-2", "spdx", "@spdx licen[cs]e identifier apache 2 0?"),
    ("apache-2", "name", "@apache {software}? licen[cs]e {version|v}? 2 0?"),
    ("apache-2", "name", "@apache 2 0? licen[cs]e?"),
    ("apache-2", "name", "the? @asl 2 0"),
    ("apache-1.1", "name", "@apache {software}? licen[cs]e {version|v}? 1 1"),
    ("apache-1.1", "spdx", "@spdx licen[cs]e identifier apache 1 1"),
    ("apache-1", "name", "@apache {software}? licen[cs]e {version|v}? 1 0"),
    ("apache", "notice", "{licensed|released|distributed|available|provided} under the @apache {software}? licen[cs]e"),
    ("apache", "name", "@apache {software}? licen[cs]e"),
    ("gpl-3", "text", "under the terms of the gnu general public licen[cs]e as published by the free software @foundation either version 3 of the license"),
    ("gpl-3", "text", "gnu @general public licen[cs]e version 3 29 june 2007"),
    ("gpl-3", "notice", "gnu @general public licen[cs]e {version|v}? 3 0? {or any? later|only}?"),
    ("gpl-3", "notice", "gnu? @gpl {version|v}? 3 0? {or later|only}?"),
    ("gpl-3", "name", "gnu? @gplv3"),
    ("gpl-3", "spdx", "@spdx licen[cs]e identifier gpl 3 0? {or later|only}?"),
    ("gpl-2", "text", "under the terms of the gnu general public licen[cs]e as published by the free software @foundation either version 2 of the license"),
    ("gpl-2", "text", "gnu @general public licen[cs]e version 2 june 1991"),
    ("gpl-2", "notice", "gnu @general public licen[cs]e {version|v}? 2 0? {or any? later|only}?"),
    ("gpl-2", "notice", "gnu? @gpl {version|v}? 2 0? {or later|only}?"),
    ("gpl-2", "name", "gnu? @gplv2"),
    ("gpl-2", "spdx", "@spdx licen[cs]e identifier gpl 2 0? {or later|only}?"),
    ("gpl-1", "notice", "gnu @general public licen[cs]e {version|v}? 1 0?"),
    ("gpl-1", "spdx", "@spdx licen[cs]e identifier gpl 1 0? {or later|only}?"),
    ("gpl", "text", "this program is free software you can redistribute it and or modify it under the terms of the gnu @general public licen[cs]e"),
    ("gpl", "text", "you should have received a copy of the gnu @general public licen[cs]e along with this {program|software|file}"),
    ("gpl", "text", "without even the implied warranty of @merchantability or fitness for a particular purpose see the gnu general public licen[cs]e"),
    ("gpl", "notice", "{licensed|released|distributed|available|provided} under {the}? gnu? @gpl"),
    ("gpl", "name", "gnu @general public licen[cs]e"),
    ("gpl", "name", "gnu @gpl"),
    ("gpl", "name", "www gnu org licenses @gpl"),
    ("gpl", "loose", "@gpl {licen[cs]e|licensed}"),
    ("lgpl-3", "text", "gnu @lesser general public licen[cs]e as published by the free software foundation either version 3"),
    ("lgpl-3", "notice", "gnu @lesser general public licen[cs]e {version|v}? 3 0?"),
    ("lgpl-3", "name", "gnu? @lgpl {version|v}? 3 0?"),
    ("lgpl-3", "name", "gnu? @lgplv3"),
    ("lgpl-3", "spdx", "@spdx licen[cs]e identifier lgpl 3 0? {or later|only}?"),
    ("lgpl-2.1", "text", "gnu @lesser general public licen[cs]e as published by the free software foundation either version 2 1"),
    ("lgpl-2.1", "notice", "gnu @lesser general public licen[cs]e {version|v}? 2 1"),
    ("lgpl-2.1", "name", "gnu? @lgpl {version|v}? 2 1"),
    ("lgpl-2.1", "spdx", "@spdx licen[cs]e identifier lgpl 2 1 {or later|only}?"),
    ("lgpl-2", "notice", "gnu @library general public licen[cs]e {version|v}? 2 0?"),
    ("lgpl-2", "spdx", "@spdx licen[cs]e identifier lgpl 2 0 {or later|only}?"),
    ("lgpl", "name", "gnu @lesser general public licen[cs]e"),
    ("lgpl", "name", "gnu @library general public licen[cs]e"),
    ("lgpl", "name", "gnu @lgpl"),
    ("lgpl", "notice", "{licensed|released|distributed|available|provided} under {the}? gnu? @lgpl"),
    ("agpl-3", "text", "gnu @affero general public licen[cs]e as published by the free software foundation either version 3"),
    ("agpl-3", "notice", "gnu? @affero general public licen[cs]e {version|v}? 3 0?"),
    ("agpl-3", "name", "gnu? @agpl {version|v}? 3 0?"),
    ("agpl-3", "name", "gnu? @agplv3"),
    ("agpl-3", "spdx", "@spdx licen[cs]e identifier agpl 3 0? {or later|only}?"),
    ("agpl", "name", "gnu? @affero general public licen[cs]e"),
    ("agpl", "notice", "{licensed|released|distributed|available|provided} under {the}? gnu? @agpl"),
    ("mpl-2", "text", "this source code form is subject to the terms of the @mozilla public licen[cs]e v 2 0"),
    ("mpl-2", "notice", "@mozilla public licen[cs]e {version|v}? 2 0?"),
    ("mpl-2", "name", "@mpl {version|v}? 2 0?"),
    ("mpl-2", "spdx", "@spdx licen[cs]e identifier mpl 2 0?"),
    ("mpl-1.1", "text", "the contents of this file are subject to the @mozilla public licen[cs]e version 1 1"),
    ("mpl-1.1", "notice", "@mozilla public licen[cs]e {version|v}? 1 1"),
    ("mpl-1.1", "name", "@mpl {version|v}? 1 1"),
    ("mpl", "name", "@mozilla public licen[cs]e"),
    ("mpl", "notice", "{licensed|released|distributed|available|provided} under {the}? @mpl"),
    ("epl-2", "notice", "@eclipse public licen[cs]e {version|v}? 2 0?"),
    ("epl-2", "spdx", "@spdx licen[cs]e identifier epl 2 0?"),
    ("epl-1", "notice", "@eclipse public licen[cs]e {version|v}? 1 0?"),
    ("epl-1", "spdx", "@spdx licen[cs]e identifier epl 1 0?"),
    ("epl", "text", "the accompanying program is provided under the terms of this @eclipse public licen[cs]e"),
    ("epl", "name", "@eclipse public licen[cs]e"),
    ("edl", "name", "@eclipse distribution licen[cs]e"),
    ("eupl-1.2", "notice", "european union public @licen[cs]e {version|v}? 1 2"),
    ("eupl-1.2", "name", "@eupl {version|v}? 1 2"),
    ("eupl-1.1", "notice", "european union public @licen[cs]e {version|v}? 1 1"),
    ("eupl", "name", "european union public @licen[cs]e"),
    ("eupl", "notice", "licensed under the @eupl"),
    ("cddl-1", "name", "common development and distribution @licen[cs]e {version|v}? 1 0?"),
    ("cddl-1.1", "name", "common development and distribution @licen[cs]e {version|v}? 1 1"),
    ("cddl", "name", "common development and distribution @licen[cs]e"),
    ("cddl", "notice", "{under|subject to} the @cddl"),
    ("cpl", "name", "common public @licen[cs]e {{version|v}? 1 0?}?"),
    ("ibm-pl", "name", "ibm public @licen[cs]e"),
    ("osl-3", "name", "open software @licen[cs]e {version|v}? 3 0?"),
    ("osl", "name", "open software @licen[cs]e"),
    ("afl", "name", "academic free @licen[cs]e"),
    ("afl-3", "name", "academic free @licen[cs]e {version|v}? 3 0?"),
    ("artistic-2", "name", "@artistic licen[cs]e {version|v}? 2 0?"),
    ("artistic-2", "spdx", "@spdx licen[cs]e identifier artistic 2 0?"),
    ("artistic-1", "name", "@artistic licen[cs]e {version|v}? 1 0?"),
    ("artistic", "name", "perl? @artistic licen[cs]e"),
    ("artistic", "notice", "under the same terms as @perl itself"),
    ("boost", "text", "permission is @hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("boost-1", "notice", "@boost software licen[cs]e {version|v}? 1 0"),
    ("boost-1", "spdx", "@spdx licen[cs]e identifier bsl 1 0"),
    ("boost", "name", "@boost software licen[cs]e"),
    ("zlib", "text", "altered source versions must be plainly marked as such and must not be @misrepresented as being the original software"),
    ("zlib", "text", "this software is provided as is without any express or implied @warranty in no event will the authors be held liable for any damages"),
    ("zlib", "spdx", "@spdx licen[cs]e identifier zlib"),
    ("zlib", "name", "@zlib {libpng}? licen[cs]e"),
    ("libpng", "name", "@libpng licen[cs]e"),
    ("unlicense", "text", "this is free and @unencumbered software released into the public domain"),
    ("unlicense", "spdx", "@spdx licen[cs]e identifier unlicense"),
    ("unlicense", "name", "the @unlicense"),
    ("wtfpl", "name", "do what the fuck you want to public @licen[cs]e"),
    ("wtfpl", "notice", "{under|licen[cs]e} {the}? @wtfpl"),
    ("beerware", "text", "the @beer ware licen[cs]e"),
    ("beerware", "name", "@beerware licen[cs]e"),
    ("json", "text", "the software shall be used for good not @evil"),
    ("openssl", "text", "this product includes software developed by the @openssl project"),
    ("openssl", "name", "@openssl licen[cs]e"),
    ("php", "name", "the? @php licen[cs]e {{version|v}? 3 [01]*}?"),
    ("python-2", "name", "@python software foundation licen[cs]e {{version|v}? 2}?"),
    ("python-2", "name", "@psf licen[cs]e {agreement}?"),
    ("ruby", "name", "the? @ruby licen[cs]e"),
    ("ncsa", "name", "university of illinois @ncsa open source licen[cs]e"),
    ("ncsa", "spdx", "@spdx licen[cs]e identifier ncsa"),
    ("postgresql", "name", "the? @postgresql licen[cs]e"),
    ("upl-1", "name", "@universal permissive licen[cs]e"),
    ("ms-pl", "name", "@microsoft public licen[cs]e"),
    ("ms-rl", "name", "@microsoft reciprocal licen[cs]e"),
    ("sspl-1", "name", "server side public @licen[cs]e"),
    ("busl-1.1", "name", "business source @licen[cs]e {{version|v}? 1 1}?"),
    ("elastic-2", "name", "@elastic licen[cs]e {{version|v}? 2 0?}?"),
    ("commons-clause", "name", "the? @commons clause {licen[cs]e condition}?"),
    ("polyform", "name", "@polyform {noncommercial|small business|shield|strict} licen[cs]e"),
    ("ofl-1.1", "text", "this font software is licensed under the @sil open font licen[cs]e version 1 1"),
    ("ofl-1.1", "notice", "@sil open font licen[cs]e {version|v}? 1 1"),
    ("ofl-1.1", "spdx", "@spdx licen[cs]e identifier ofl 1 1"),
    ("ofl", "name", "sil? open @font licen[cs]e"),
    ("gfdl-1.3", "text", "permission is granted to copy distribute and or modify this document under the terms of the gnu free @documentation licen[cs]e version 1 3"),
    ("gfdl-1.3", "notice", "gnu free @documentation licen[cs]e {version|v}? 1 3"),
    ("gfdl-1.2", "notice", "gnu free @documentation licen[cs]e {version|v}? 1 2"),
    ("gfdl", "name", "gnu free @documentation licen[cs]e"),
    ("gfdl", "notice", "under the @gfdl"),
    ("odbl-1", "notice", "open @database licen[cs]e {{version|v}? 1 0}?"),
    ("odbl", "name", "the? open @database licen[cs]e"),
    ("odbl", "notice", "under the @odbl"),
    ("odc-by", "name", "open data commons @attribution licen[cs]e"),
    ("pddl", "name", "public domain @dedication and licen[cs]e"),
    ("cdla", "name", "community data @licen[cs]e agreement {permissive|sharing}?"),
    ("ogl", "notice", "contains public sector information licensed under the open @government licen[cs]e {v? [0-9] 0?}?"),
    ("ogl", "name", "open @government licen[cs]e"),
    ("etalab", "name", "@licence ouverte {etalab}?"),
    ("cc0", "text", "to the extent possible under law {the author|[0-9a-z]+ [0-9a-z]+} has @waived all copyright and related or neighboring rights"),
    ("cc0", "notice", "@creativecommons org publicdomain zero"),
    ("cc0", "notice", "creative @commons {zero|cc0} {licen[cs]e}? {1 0}? {universal}?"),
    ("cc0", "spdx", "@spdx licen[cs]e identifier cc0 1 0"),
    ("cc0", "name", "@cc0 {1 0}? {universal|licen[cs]e}?"),
    ("cc-pdm", "notice", "public @domain mark {1 0}?"),
    ("cc-by", "text", "this work is licensed under a creative @commons attribution {[1-4] [05]}? {international|unported}? licen[cs]e"),
    ("cc-by", "notice", "creative @commons attribution {licen[cs]e}? {[1-4] [05]}? {international|unported}? {licen[cs]e}?"),
    ("cc-by", "notice", "@creativecommons org licenses by [1-4]"),
    ("cc-by", "spdx", "@spdx licen[cs]e identifier cc by [1-4] [05]"),
    ("cc-by", "name", "@cc by {licen[cs]e}? [1-4] [05]"),
    ("cc-by", "loose", "{under|licen[cs]e} {a|the}? @cc by {licen[cs]e}?"),
    ("cc-by", "loose", "@cc by"),
    ("cc-by-sa", "notice", "creative @commons attribution {sharealike|share alike} {licen[cs]e}? {[1-4] [05]}? {international|unported}? {licen[cs]e}?"),
    ("cc-by-sa", "notice", "@creativecommons org licenses by sa"),
    ("cc-by-sa", "spdx", "@spdx licen[cs]e identifier cc by sa [1-4] [05]"),
    ("cc-by-sa", "name", "@cc by sa {licen[cs]e}? {[1-4] [05]}?"),
    ("cc-by-nd", "notice", "creative @commons attribution {noderivatives|noderivs|no derivatives|no derivs} {licen[cs]e}? {[1-4] [05]}? {international|unported}? {licen[cs]e}?"),
    ("cc-by-nd", "notice", "@creativecommons org licenses by nd"),
    ("cc-by-nd", "name", "@cc by nd {licen[cs]e}? {[1-4] [05]}?"),
    ("cc-by-nc", "notice", "creative @commons attribution {noncommercial|non commercial} {licen[cs]e}? {[1-4] [05]}? {international|unported}? {licen[cs]e}?"),
    ("cc-by-nc", "notice", "@creativecommons org licenses by nc"),
    ("cc-by-nc", "spdx", "@spdx licen[cs]e identifier cc by nc [1-4] [05]"),
    ("cc-by-nc", "name", "@cc by nc {licen[cs]e}? {[1-4] [05]}?"),
    ("cc-by-nc-sa", "notice", "creative @commons attribution {noncommercial|non commercial} {sharealike|share alike} {licen[cs]e}? {[1-4] [05]}? {international|unported}? {licen[cs]e}?"),
    ("cc-by-nc-sa", "notice", "@creativecommons org licenses by nc sa"),
    ("cc-by-nc-sa", "name", "@cc by nc sa {licen[cs]e}? {[1-4] [05]}?"),
    ("cc-by-nc-nd", "notice", "creative @commons attribution {noncommercial|non commercial} {noderivatives|noderivs|no derivatives|no derivs} {licen[cs]e}? {[1-4] [05]}? {international|unported}? {licen[cs]e}?"),
    ("cc-by-nc-nd", "notice", "@creativecommons org licenses by nc nd"),
    ("cc-by-nc-nd", "name", "@cc by nc nd {licen[cs]e}? {[1-4] [05]}?"),
    ("cc", "loose", "{under|a} a? creative @commons licen[cs]e"),
    ("public-domain", "notice", "{dedicated|released|placed} {to|into|in} the public @domain"),
    ("public-domain", "notice", "{this|the} {work|file|code|software} is in the public @domain"),
    ("public-domain", "notice", "no copyright is claimed in the united states under title 17 u s @code"),
    ("proprietary", "notice", "@confidential and proprietary"),
    ("proprietary", "notice", "unauthorized copying of this file via any medium is strictly @prohibited"),
    ("proprietary", "notice", "may not be reproduced or distributed without {the}? {prior|express} {written}? @permission"),
    ("all-rights-reserved", "weak", "all rights @reserved"),
]


def _pattern(phrase: str) -> str:
    """A phrase as a regex over words that are each followed by a space."""
    out, at = [], 0
    while at < len(phrase):
        if phrase[at] == " ":
            at += 1
        elif phrase[at] == "{":
            depth, parts, lo = 0, [], at + 1
            for end in range(at, len(phrase)):
                depth += (phrase[end] == "{") - (phrase[end] == "}")
                if depth == 1 and phrase[end] == "|" or not depth:
                    parts.append(phrase[lo:end])
                    lo = end + 1
                if not depth:
                    break
            at = end + 1
            maybe = phrase[at : at + 1] == "?"
            at += maybe
            out.append(f"(?:{'|'.join(map(_pattern, parts))}){'?' if maybe else ''}")
        else:
            word = re.match(r"\S+", phrase[at:])[0]
            at += len(word)
            out.append(f"(?:{word[:-1]} )?" if word[-1] == "?" else f"{word} ")
    return "".join(out)


def rule(label: str, signature: str, priority: int, confidence: float, base: bool = False) -> list[dict]:
    """The rules of a signature, one for each spelling of its anchor."""
    at = signature.index("@")
    anchor = re.match(r"[0-9a-z\[\]]+", signature[at + 1 :])[0]
    before, after = signature[:at], signature[at + 1 + len(anchor) :]
    spellings = ["".join(x) for x in itertools.product(*[x[1:-1] if x[0] == "[" else [x] for x in re.findall(r"\[[a-z]+\]|[0-9a-z]+", anchor)])]
    return [{"label": label, "anchor": s, "before": _pattern(before), "after": _pattern(after), "priority": priority, "confidence": confidence, "base": base} for s in spellings]


def rules() -> list[dict]:
    """All rules in order: the base phrases first, then the signatures."""
    out: list[dict] = []
    for phrase, label in BASE_PHRASES.items():
        anchor = {"mit": "mit", "apache-2": "apache", "cc-by-nc": "cc"}[label]
        out += rule(label, phrase.replace(anchor, f"@{anchor}", 1), TOP, 1.0, True)
    for label, kind, signature in SIGNATURES:
        out += rule(label, signature, *_CONFIDENCE[kind])
    return out
