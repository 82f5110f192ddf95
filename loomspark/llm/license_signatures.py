"""Signatures of licences, written by hand over words of lower case joined by one space.

A row is (label, keyword, priority, confidence, pattern). A text is searched for a pattern only if the keyword stands in it. Of overlapping detections the longer one of
equal or higher priority wins, of equal intervals the higher priority, then the earlier row. Priorities: 6 denials, 5 identifiers and full grants, 4 whole
sentences of a licence's text, 3 names with a version or a verb, 2 names, 1 hints. No pattern matches over MAX_WORDS words.
"""

from __future__ import annotations

MAX_WORDS = 48

# Signatures in order of the families.
SIGNATURES = [
    # denials: what they contain is no licence of the text
    ("not-licensed", "not", 6, 0.1, "(?:is |are )?not (?:licen[sc]ed|released|available|distributed|covered|provided) (?:under|by) (?:the |a |an )?(?:terms of (?:the )?)?(?:[^ ]+ ){1,6}licen[sc]e"),
    ("not-licensed", "not", 6, 0.1, "(?:is |are )?not (?:under )?(?:the |a |an )?(?:mit|apache|bsd|gpl|lgpl|agpl|mpl|isc|zlib|general public|gnu general public|mozilla public|creative commons) licen[sc]e"),
    ("not-licensed", "unlike", 6, 0.1, "unlike (?:the )?(?:mit|apache|bsd|gpl|gnu general public|mozilla public) licen[sc]es?"),
    ("not-licensed", "no longer", 6, 0.1, "no longer (?:licen[sc]ed|released|available|distributed) under (?:the )?(?:[^ ]+ ){1,6}licen[sc]e"),
    ("not-licensed", "incompatible", 6, 0.2, "incompatible with (?:the )?(?:[^ ]+ ){1,4}licen[sc]e"),
    ("not-licensed", "without a licen", 6, 0.2, "without a licen[sc]e"),
    # MIT and its variants
    ("mit", "mit", 2, 0.85, "mit licen[sc]e"),
    ("mit", "spdx", 5, 1.0, "spdx licen[sc]e identifier mit"),
    ("mit", "mit", 5, 0.98, "licen[sc]ed under (?:the )?(?:terms of (?:the )?)?mit(?: licen[sc]e)?"),
    ("mit", "mit", 5, 0.96, "(?:released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?mit(?: licen[sc]e)?"),
    ("mit", "mit", 3, 0.9, "the mit licen[sc]e mit"),
    ("mit", "mit", 3, 0.88, "mit licen[sc]ed"),
    ("mit", "mit", 1, 0.6, "licen[sc]e mit"),
    ("mit", "opensource org", 3, 0.9, "opensource org licen[sc]es mit(?: licen[sc]e)?(?: php)?"),
    ("mit", "permission is hereby granted", 4, 0.97, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "deal in the software", 4, 0.95, "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"),
    ("mit", "substantial portions", 4, 0.95, "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "permission notice", 3, 0.85, "(?:the )?above copyright notice and this permission notice"),
    ("mit-0", "mit no attribution", 3, 0.95, "mit no attribution(?: licen[sc]e)?"),
    ("mit-0", "spdx", 5, 1.0, "spdx licen[sc]e identifier mit 0"),
    ("mit-advertising", "enlightenment", 3, 0.8, "enlightenment (?:mit )?licen[sc]e"),
    ("x11", "x11", 2, 0.85, "(?:mit )?x11 licen[sc]e"),
    ("x11", "x consortium", 4, 0.95, "(?:the )?name of the x consortium shall not be used in advertising"),
    ("expat", "expat", 2, 0.9, "expat licen[sc]e"),
    ("bsl-1.0", "boost", 3, 0.95, "boost software licen[sc]e(?: version 1 0)?"),
    ("bsl-1.0", "spdx", 5, 1.0, "spdx licen[sc]e identifier bsl 1 0"),
    ("bsl-1.0", "machine executable", 4, 0.95, "solely in the form of machine executable object code generated by a source language processor"),
    ("isc", "isc", 2, 0.85, "isc licen[sc]e"),
    ("isc", "spdx", 5, 1.0, "spdx licen[sc]e identifier isc"),
    ("isc", "with or without fee", 4, 0.95, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "isc disclaims", 4, 0.9, "isc disclaims all warranties"),
    ("0bsd", "zero clause", 3, 0.95, "(?:bsd )?zero clause(?: bsd)?(?: licen[sc]e)?"),
    ("0bsd", "spdx", 5, 1.0, "spdx licen[sc]e identifier 0bsd"),
    # BSD
    ("bsd", "bsd", 2, 0.85, "bsd licen[sc]e"),
    ("bsd", "bsd", 3, 0.88, "bsd style licen[sc]e"),
    ("bsd", "bsd", 5, 0.95, "(?:licen[sc]ed|released|distributed|available) under (?:the |a )?(?:terms of (?:the )?)?(?:new |modified |simplified |revised )?bsd(?: style)?(?: licen[sc]e)?"),
    ("bsd", "redistribution and use", 4, 0.95, "redistribution and use in source and binary forms(?: with or without modification)?(?: are permitted)?"),
    ("bsd", "redistributions of source", 4, 0.93, "redistributions of source code must retain the above copyright notice this list of conditions"),
    ("bsd", "redistributions in binary", 4, 0.93, "redistributions in binary form must reproduce the above copyright notice this list of conditions"),
    ("bsd", "contributors as is", 4, 0.9, "this software is provided by the (?:copyright holders|regents|authors?) and contributors as is"),
    ("bsd-2-clause", "bsd", 3, 0.95, "(?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd|freebsd)(?: licen[sc]e)?"),
    ("bsd-2-clause", "spdx", 5, 1.0, "spdx licen[sc]e identifier bsd 2 clause"),
    ("bsd-3-clause", "bsd", 3, 0.95, "(?:bsd (?:3|three) clause|(?:3|three) clause bsd|new bsd|modified bsd|revised bsd)(?: licen[sc]e)?"),
    ("bsd-3-clause", "spdx", 5, 1.0, "spdx licen[sc]e identifier bsd 3 clause"),
    ("bsd-3-clause", "endorse or promote", 4, 0.93, "neither the names? of (?:[^ ]+ ){1,14}may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "bsd", 3, 0.95, "(?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd|old bsd)(?: licen[sc]e)?"),
    ("bsd-4-clause", "spdx", 5, 1.0, "spdx licen[sc]e identifier bsd 4 clause"),
    ("bsd-4-clause", "all advertising materials", 4, 0.95, "all advertising materials mentioning features or use of this software must display"),
    ("bsd-3-clause-clear", "clear bsd", 3, 0.95, "clear bsd licen[sc]e"),
    ("bsd-patent", "bsd", 3, 0.95, "bsd (?:2 clause )?plus patent(?: licen[sc]e)?"),
    # Apache
    ("apache", "apache", 2, 0.85, "apache licen[sc]e"),
    ("apache", "apache", 2, 0.85, "apache software licen[sc]e"),
    ("apache", "apache", 5, 0.96, "(?:licen[sc]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?apache(?: software)?(?: licen[sc]e)?"),
    ("apache-2.0", "apache", 5, 0.98, "(?:licen[sc]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?apache(?: software)?(?: licen[sc]e)?(?: version| v)? ?2(?: 0)?"),
    ("apache-1.0", "apache", 3, 0.93, "apache (?:software )?licen[sc]e (?:version |v)?1 0"),
    ("apache-1.1", "apache", 3, 0.93, "apache (?:software )?licen[sc]e (?:version |v)?1 1"),
    ("apache-2.0", "apache", 3, 0.95, "apache (?:software )?licen[sc]e (?:version |v)?2 0"),
    ("apache-2.0", "apache", 3, 0.92, "apache 2(?: 0)?(?: licen[sc]ed?)?"),
    ("apache-2.0", "asl", 1, 0.6, "asl 2 0 licen[sc]ed?"),
    ("apache-2.0", "spdx", 5, 1.0, "spdx licen[sc]e identifier apache 2 0"),
    ("apache-2.0", "apache org", 3, 0.95, "(?:www )?apache org licen[sc]es licen[sc]e 2 0(?: txt| html)?"),
    ("apache-2.0", "you may not use this file", 4, 0.93, "you may not use this file except in compliance with the licen[sc]e"),
    ("apache-2.0", "governing permissions", 4, 0.9, "see the licen[sc]e for the specific language governing permissions and limitations under the licen[sc]e"),
    ("apache-2.0", "on an as is basis", 4, 0.85, "distributed on an as is basis without warranties or conditions of any kind"),
    ("apache-2.0", "irrevocable copyright license", 4, 0.9, "perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    # GPL
    ("gpl", "general public", 2, 0.85, "general public licen[sc]e"),
    ("gpl", "general public", 2, 0.87, "gnu general public licen[sc]e"),
    ("gpl", "gpl", 3, 0.85, "gnu gpl"),
    ("gpl", "gpl", 5, 0.95, "(?:licen[sc]ed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl"),
    ("gpl-2.0", "gpl", 5, 0.97, "(?:licen[sc]ed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl(?: version| v)? ?2(?: 0)?"),
    ("gpl-3.0", "gpl", 5, 0.97, "(?:licen[sc]ed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl(?: version| v)? ?3(?: 0)?"),
    ("gpl", "general public", 5, 0.97, "(?:licen[sc]ed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?general public licen[sc]e"),
    ("gpl-2.0", "general public", 5, 0.98, "(?:licen[sc]ed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?general public licen[sc]e (?:version |v ?)2(?: 0)?"),
    ("gpl-3.0", "general public", 5, 0.98, "(?:licen[sc]ed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?general public licen[sc]e (?:version |v ?)3(?: 0)?"),
    ("gpl", "free software foundation", 4, 0.95, "redistribute it and or modify it under the terms of the gnu general public licen[sc]e as published by the free software foundation"),
    ("gpl", "general public", 3, 0.92, "under the terms of the gnu general public licen[sc]e"),
    ("gpl", "merchantability", 4, 0.75, "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl", "received a copy", 4, 0.9, "you should have received a copy of the gnu general public licen[sc]e along with this (?:program|package|software|library)"),
    ("gpl-1.0", "spdx", 5, 1.0, "spdx licen[sc]e identifier gpl 1 0(?: only| or later)?"),
    ("gpl-2.0", "spdx", 5, 1.0, "spdx licen[sc]e identifier gpl 2 0(?: only| or later)?"),
    ("gpl-3.0", "spdx", 5, 1.0, "spdx licen[sc]e identifier gpl 3 0(?: only| or later)?"),
    ("gpl-2.0", "gpl", 3, 0.93, "(?:gnu )?gpl ?(?:v|version )?2(?: 0)?"),
    ("gpl-3.0", "gpl", 3, 0.93, "(?:gnu )?gpl ?(?:v|version )?3(?: 0)?"),
    ("gpl-2.0", "general public", 3, 0.95, "(?:gnu )?general public licen[sc]e (?:version |v ?)2(?: 0)?"),
    ("gpl-3.0", "general public", 3, 0.95, "(?:gnu )?general public licen[sc]e (?:version |v ?)3(?: 0)?"),
    ("gpl-2.0", "version 2 of the licen", 3, 0.85, "either version 2 of the licen[sc]e or at your option any later version"),
    ("gpl-3.0", "version 3 of the licen", 3, 0.85, "either version 3 of the licen[sc]e or at your option any later version"),
    ("gpl", "gnu org", 3, 0.9, "(?:www )?gnu org (?:licen[sc]es|copyleft) gpl(?: [0-9] 0)?(?: html| txt)?"),
    ("gpl-classpath", "classpath", 3, 0.93, "(?:gpl |general public licen[sc]e )?(?:with )?classpath exception"),
    ("gpl-linking", "exception", 3, 0.85, "(?:gpl )?(?:with )?(?:runtime library|linking) exception"),
    # LGPL, AGPL, documentation
    ("lgpl", "lesser general", 3, 0.92, "(?:gnu )?lesser general public licen[sc]e"),
    ("lgpl", "library general", 3, 0.92, "(?:gnu )?library general public licen[sc]e"),
    ("lgpl", "lgpl", 2, 0.85, "(?:gnu )?lgpl(?: ?v ?[0-9](?: [0-9])?)?"),
    ("lgpl", "lgpl", 5, 0.95, "(?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?lgpl"),
    ("lgpl-2.1", "lesser general", 4, 0.95, "(?:gnu )?lesser general public licen[sc]e (?:version |v ?)2 1"),
    ("lgpl-3.0", "lesser general", 4, 0.95, "(?:gnu )?lesser general public licen[sc]e (?:version |v ?)3(?: 0)?"),
    ("lgpl-2.0", "library general", 4, 0.95, "(?:gnu )?library general public licen[sc]e (?:version |v ?)2(?: 0)?"),
    ("lgpl-2.0", "spdx", 5, 1.0, "spdx licen[sc]e identifier lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "spdx", 5, 1.0, "spdx licen[sc]e identifier lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", "spdx", 5, 1.0, "spdx licen[sc]e identifier lgpl 3 0(?: only| or later)?"),
    ("agpl", "affero", 3, 0.92, "(?:gnu )?affero general public licen[sc]e"),
    ("agpl", "agpl", 2, 0.87, "(?:gnu )?agpl(?: ?v ?[0-9](?: [0-9])?)?"),
    ("agpl-3.0", "affero", 4, 0.95, "(?:gnu )?affero general public licen[sc]e (?:version |v ?)3(?: 0)?"),
    ("agpl-3.0", "spdx", 5, 1.0, "spdx licen[sc]e identifier agpl 3 0(?: only| or later)?"),
    ("agpl", "remote network interaction", 4, 0.9, "remote network interaction use with the gnu general public licen[sc]e"),
    ("gfdl", "free documentation", 3, 0.93, "(?:gnu )?free documentation licen[sc]e(?: (?:version|v) ?1 [0-9])?"),
    ("gfdl", "invariant sections", 4, 0.9, "with no invariant sections no front cover texts and no back cover texts"),
    ("gfdl", "spdx", 5, 1.0, "spdx licen[sc]e identifier gfdl 1 [0-9](?: only| or later)?"),
    # weak copyleft
    ("mpl", "mozilla public", 3, 0.92, "mozilla public licen[sc]e"),
    ("mpl-1.1", "mozilla public", 4, 0.95, "mozilla public licen[sc]e (?:version |v ?)1 1"),
    ("mpl-2.0", "mozilla public", 4, 0.95, "mozilla public licen[sc]e (?:version |v ?)2 0"),
    ("mpl-1.1", "spdx", 5, 1.0, "spdx licen[sc]e identifier mpl 1 1"),
    ("mpl-2.0", "spdx", 5, 1.0, "spdx licen[sc]e identifier mpl 2 0"),
    ("mpl-2.0", "mozilla org mpl", 4, 0.93, "(?:you can obtain one at )?(?:https? )?mozilla org mpl 2 0"),
    ("mpl", "this source code form", 4, 0.95, "this source code form is subject to the terms of the mozilla public licen[sc]e"),
    ("epl", "eclipse public", 3, 0.92, "eclipse public licen[sc]e"),
    ("epl-1.0", "eclipse public", 4, 0.95, "eclipse public licen[sc]e (?:version |v ?)?1 0"),
    ("epl-2.0", "eclipse public", 4, 0.95, "eclipse public licen[sc]e (?:version |v ?)?2 0"),
    ("epl-1.0", "spdx", 5, 1.0, "spdx licen[sc]e identifier epl 1 0"),
    ("epl-2.0", "spdx", 5, 1.0, "spdx licen[sc]e identifier epl 2 0"),
    ("edl", "eclipse distribution", 3, 0.93, "eclipse distribution licen[sc]e"),
    ("cddl", "common development", 3, 0.93, "common development and distribution licen[sc]e(?: (?:version|v) ?1 [0-9])?"),
    ("cddl", "cddl", 2, 0.85, "cddl(?: (?:version |v ?)?1 [0-9])?"),
    ("cddl", "spdx", 5, 1.0, "spdx licen[sc]e identifier cddl 1 [0-9]"),
    ("cpl", "common public", 3, 0.92, "common public licen[sc]e(?: (?:version|v) ?1 0)?"),
    ("cpal", "common public attribution", 4, 0.93, "common public attribution licen[sc]e"),
    ("ipl", "ibm public", 3, 0.92, "ibm public licen[sc]e"),
    ("eupl", "european union public", 3, 0.93, "european union public licen[sc]e(?: (?:version|v) ?1 [0-9])?"),
    ("eupl", "eupl", 2, 0.87, "eupl(?: ?(?:version |v ?)?1 [0-9])?"),
    ("eupl", "spdx", 5, 1.0, "spdx licen[sc]e identifier eupl 1 [0-9]"),
    ("osl", "open software licen", 3, 0.9, "open software licen[sc]e(?: (?:version |v ?)?[0-9] [0-9])?"),
    ("afl", "academic free", 3, 0.9, "academic free licen[sc]e(?: (?:version |v ?)?[0-9] [0-9])?"),
    ("artistic", "artistic", 2, 0.85, "(?:perl )?artistic licen[sc]e"),
    ("artistic-1.0", "artistic", 3, 0.93, "artistic licen[sc]e (?:version |v ?)?1 0"),
    ("artistic-2.0", "artistic", 3, 0.93, "artistic licen[sc]e (?:version |v ?)?2 0"),
    ("artistic-2.0", "spdx", 5, 1.0, "spdx licen[sc]e identifier artistic 2 0"),
    ("perl", "same terms as perl", 4, 0.9, "under the same terms as perl itself"),
    ("ms-pl", "microsoft public", 3, 0.93, "microsoft public licen[sc]e"),
    ("ms-rl", "microsoft reciprocal", 3, 0.93, "microsoft reciprocal licen[sc]e"),
    ("ms-pl", "spdx", 5, 1.0, "spdx licen[sc]e identifier ms pl"),
    ("ms-rl", "spdx", 5, 1.0, "spdx licen[sc]e identifier ms rl"),
    ("qpl", "q public", 3, 0.9, "q public licen[sc]e"),
    ("sleepycat", "sleepycat", 3, 0.9, "sleepycat licen[sc]e"),
    ("cecill", "cecill", 3, 0.9, "cecill(?: [abc])?(?: free software)?(?: licen[sc]e)?(?: agreement)?"),
    ("cecill", "spdx", 5, 1.0, "spdx licen[sc]e identifier cecill (?:[0-9] [0-9]|[abc])"),
    # public domain and near it
    ("unlicense", "unlicense", 2, 0.88, "the unlicense"),
    ("unlicense", "spdx", 5, 1.0, "spdx licen[sc]e identifier unlicense"),
    ("unlicense", "unencumbered", 4, 0.97, "this is free and unencumbered software released into the public domain"),
    ("unlicense", "unlicense org", 3, 0.95, "(?:https? )?(?:www )?unlicense org"),
    ("unlicense", "anyone is free to copy", 4, 0.95, "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("public-domain", "public domain", 2, 0.75, "(?:is |are )?(?:placed |released |dedicated )?(?:in|into|to) the public domain"),
    ("public-domain", "public domain", 3, 0.85, "hereby (?:placed|released|dedicated|dedicates?|places?|releases?) (?:[^ ]+ ){0,6}(?:in|into|to) the public domain"),
    ("public-domain", "disclaims copyright", 4, 0.9, "(?:the )?author disclaims copyright to this source code"),
    ("cc0", "cc0", 3, 0.93, "cc0(?: 1 0)?(?: universal)?(?: licen[sc]e)?"),
    ("cc0", "commons zero", 3, 0.95, "creative commons zero(?: (?:v1 0|1 0))?(?: universal)?"),
    ("cc0", "spdx", 5, 1.0, "spdx licen[sc]e identifier cc0 1 0"),
    ("wtfpl", "wtfpl", 2, 0.9, "wtfpl"),
    ("wtfpl", "want to public", 4, 0.97, "do what the f[^ ]* you want to public licen[sc]e"),
    ("wtfpl", "you just do what", 4, 0.95, "you just do what the f[^ ]* you want to"),
    ("beerware", "beerware", 2, 0.9, "(?:the )?beerware licen[sc]e"),
    ("beerware", "beer ware", 3, 0.93, "the beer ware licen[sc]e"),
    ("beerware", "buy me a beer", 4, 0.9, "you can buy me a beer in return"),
    ("fsfap", "copying and distribution", 4, 0.93, "copying and distribution of this file with or without modification are permitted in any medium without royalty"),
    # Creative Commons
    ("cc-by", "creative commons", 2, 0.85, "creative commons(?: attribution)? licen[sc]e"),
    ("cc-by", "commons attribution", 3, 0.93, "creative commons attribution(?: [0-9] [0-9])?(?: (?:international|unported|generic))?(?: licen[sc]e)?"),
    ("cc-by-sa", "share", 4, 0.95, "creative commons attribution share ?alike(?: [0-9] [0-9])?(?: (?:international|unported|generic))?(?: licen[sc]e)?"),
    ("cc-by-nc", "commercial", 4, 0.95, "creative commons attribution non ?commercial(?: [0-9] [0-9])?(?: (?:international|unported|generic))?(?: licen[sc]e)?"),
    ("cc-by-nd", "deriv", 4, 0.95, "creative commons attribution no ?deriv(?:atives|s)?(?: [0-9] [0-9])?(?: (?:international|unported|generic))?(?: licen[sc]e)?"),
    ("cc-by-nc-sa", "share", 5, 0.96, "creative commons attribution non ?commercial share ?alike(?: [0-9] [0-9])?(?: (?:international|unported|generic))?(?: licen[sc]e)?"),
    ("cc-by-nc-nd", "deriv", 5, 0.96, "creative commons attribution non ?commercial no ?deriv(?:atives|s)?(?: [0-9] [0-9])?(?: (?:international|unported|generic))?(?: licen[sc]e)?"),
    ("cc-by", "cc by", 2, 0.85, "cc by(?: [0-9] [0-9])?"),
    ("cc-by-sa", "cc by sa", 3, 0.9, "cc by sa(?: [0-9] [0-9])?"),
    ("cc-by-nc", "cc by nc", 3, 0.9, "cc by nc(?: [0-9] [0-9])?"),
    ("cc-by-nd", "cc by nd", 3, 0.9, "cc by nd(?: [0-9] [0-9])?"),
    ("cc-by-nc-sa", "cc by nc sa", 4, 0.92, "cc by nc sa(?: [0-9] [0-9])?"),
    ("cc-by-nc-nd", "cc by nc nd", 4, 0.92, "cc by nc nd(?: [0-9] [0-9])?"),
    ("cc-by", "creativecommons org", 3, 0.93, "creativecommons org licen[sc]es by [0-9] [0-9]"),
    ("cc-by-sa", "creativecommons org", 3, 0.94, "creativecommons org licen[sc]es by sa [0-9] [0-9]"),
    ("cc-by-nc", "creativecommons org", 3, 0.94, "creativecommons org licen[sc]es by nc [0-9] [0-9]"),
    ("cc-by-nd", "creativecommons org", 3, 0.94, "creativecommons org licen[sc]es by nd [0-9] [0-9]"),
    ("cc-by-nc-sa", "creativecommons org", 3, 0.95, "creativecommons org licen[sc]es by nc sa [0-9] [0-9]"),
    ("cc-by-nc-nd", "creativecommons org", 3, 0.95, "creativecommons org licen[sc]es by nc nd [0-9] [0-9]"),
    ("cc0", "creativecommons org", 3, 0.95, "creativecommons org publicdomain zero 1 0"),
    ("cc-by", "spdx", 5, 1.0, "spdx licen[sc]e identifier cc by [0-9] [0-9]"),
    ("cc-by-sa", "spdx", 5, 1.0, "spdx licen[sc]e identifier cc by sa [0-9] [0-9]"),
    ("cc-by-nc", "spdx", 5, 1.0, "spdx licen[sc]e identifier cc by nc [0-9] [0-9]"),
    # languages and projects
    ("zlib", "zlib", 2, 0.85, "zlib(?: libpng)? licen[sc]e"),
    ("zlib", "spdx", 5, 1.0, "spdx licen[sc]e identifier zlib"),
    ("zlib", "plainly marked", 4, 0.95, "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "origin of this software", 4, 0.95, "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("libpng", "libpng", 2, 0.85, "libpng licen[sc]e"),
    ("python", "python", 2, 0.85, "python licen[sc]e"),
    ("python", "python software foundation", 3, 0.93, "python software foundation licen[sc]e(?: (?:version |v ?)?2)?"),
    ("python", "psf", 2, 0.8, "psf licen[sc]e"),
    ("python", "spdx", 5, 1.0, "spdx licen[sc]e identifier (?:psf|python) 2 0"),
    ("ruby", "ruby", 2, 0.85, "ruby licen[sc]e"),
    ("ruby", "same terms as ruby", 4, 0.9, "under the same terms as ruby(?: itself)?"),
    ("php", "php", 2, 0.85, "php licen[sc]e"),
    ("php", "php", 3, 0.93, "php licen[sc]e (?:version |v ?)3 0[0-9]?"),
    ("openssl", "openssl", 2, 0.85, "openssl licen[sc]e"),
    ("openssl", "openssl project", 4, 0.93, "this product includes software developed by the openssl project"),
    ("ssleay", "ssleay", 2, 0.85, "(?:original )?ssleay licen[sc]e"),
    ("postgresql", "postgresql", 2, 0.85, "postgresql licen[sc]e"),
    ("postgresql", "spdx", 5, 1.0, "spdx licen[sc]e identifier postgresql"),
    ("tcl", "tcl", 2, 0.85, "tcl(?: tk)? licen[sc]e"),
    ("vim", "vim", 2, 0.85, "vim licen[sc]e"),
    ("curl", "curl", 2, 0.85, "curl licen[sc]e"),
    ("json", "json", 2, 0.85, "json licen[sc]e"),
    ("json", "good not evil", 4, 0.95, "the software shall be used for good not evil"),
    ("ncsa", "ncsa", 3, 0.9, "(?:university of illinois )?ncsa(?: open source)? licen[sc]e"),
    ("ncsa", "university of illinois", 4, 0.93, "university of illinois(?: ncsa)? open source licen[sc]e"),
    ("ncsa", "spdx", 5, 1.0, "spdx licen[sc]e identifier ncsa"),
    ("llvm-exception", "llvm", 3, 0.9, "(?:apache 2 0 )?with llvm exceptions?"),
    ("icu", "icu", 2, 0.8, "icu licen[sc]e"),
    ("unicode", "unicode", 3, 0.9, "unicode (?:licen[sc]e agreement|inc licen[sc]e)"),
    ("w3c", "w3c", 3, 0.9, "w3c (?:software notice and licen[sc]e|software licen[sc]e|licen[sc]e)"),
    ("upl", "universal permissive", 3, 0.93, "universal permissive licen[sc]e(?: (?:version |v ?)?1 0)?"),
    ("upl", "spdx", 5, 1.0, "spdx licen[sc]e identifier upl 1 0"),
    ("ecl", "educational community", 3, 0.93, "educational community licen[sc]e(?: (?:version |v ?)?2 0)?"),
    ("mulan", "mulan", 3, 0.93, "mulan (?:permissive software licen[sc]e|psl)(?: v ?[0-9])?"),
    ("hpnd", "historical permission", 3, 0.9, "historical permission notice and disclaimer"),
    ("blueoak", "blue oak", 3, 0.93, "blue oak model licen[sc]e(?: 1 0 0)?"),
    ("bittorrent", "bittorrent", 3, 0.9, "bittorrent open source licen[sc]e"),
    ("nasa", "nasa open source", 3, 0.9, "nasa open source agreement"),
    ("intel", "intel open source", 3, 0.9, "intel open source licen[sc]e"),
    ("apsl", "apple public source", 3, 0.92, "apple public source licen[sc]e(?: (?:version |v ?)?[0-9] [0-9])?"),
    ("sissl", "sun industry standards", 3, 0.92, "sun industry standards source licen[sc]e"),
    ("npl", "netscape public", 3, 0.92, "netscape public licen[sc]e"),
    ("zpl", "zope public", 3, 0.92, "zope public licen[sc]e(?: (?:version |v ?)?[0-9] [0-9])?"),
    ("lppl", "latex project", 3, 0.92, "latex project public licen[sc]e(?: (?:version |v ?)?1 [0-9][a-c]?)?"),
    # data and fonts
    ("ofl", "open font", 3, 0.93, "(?:sil )?open font licen[sc]e(?: (?:version |v ?)?1 [01])?"),
    ("ofl", "spdx", 5, 1.0, "spdx licen[sc]e identifier ofl 1 [01]"),
    ("ofl", "reserved font name", 3, 0.85, "with reserved font names?"),
    ("odbl", "open database", 3, 0.93, "open database licen[sc]e"),
    ("odbl", "odbl", 2, 0.87, "odbl(?: (?:v ?)?1 0)?"),
    ("odc-by", "open data commons", 3, 0.92, "open data commons attribution licen[sc]e"),
    ("pddl", "open data commons", 3, 0.92, "open data commons public domain dedication(?: and licen[sc]e)?"),
    ("cdla", "community data licen", 3, 0.92, "community data licen[sc]e agreement (?:permissive|sharing)"),
    ("ogl", "open government", 3, 0.92, "open government licen[sc]e(?: v ?[0-9](?: 0)?)?"),
    # source available and proprietary
    ("sspl", "server side public", 3, 0.93, "server side public licen[sc]e(?: (?:version |v ?)?1)?"),
    ("sspl", "sspl", 2, 0.85, "sspl"),
    ("busl", "business source", 3, 0.93, "business source licen[sc]e(?: (?:version |v ?)?1 1)?"),
    ("busl", "spdx", 5, 1.0, "spdx licen[sc]e identifier busl 1 1"),
    ("elastic", "elastic", 3, 0.9, "elastic licen[sc]e(?: (?:version |v ?)?2 0)?"),
    ("commons-clause", "commons clause", 3, 0.92, "commons clause(?: licen[sc]e condition)?(?: v1 0)?"),
    ("polyform", "polyform", 3, 0.9, "polyform (?:noncommercial|small business|shield|strict|perimeter)(?: licen[sc]e)?"),
    ("openrail", "openrail", 3, 0.9, "(?:creativeml |bigscience )?(?:open ?rail|openrail)(?: ?m)?(?: licen[sc]e)?"),
    ("rail", "responsible ai", 3, 0.9, "responsible ai licen[sc]e"),
    ("research-only", "research purposes", 2, 0.6, "for (?:non commercial )?(?:academic |scientific )?research purposes only"),
    ("non-commercial", "commercial", 2, 0.6, "for non ?commercial (?:use|purposes) only"),
    ("proprietary", "all rights reserved", 2, 0.6, "copyright(?: [^ ]+){0,10} all rights reserved"),
    ("proprietary", "all rights reserved", 1, 0.4, "all rights reserved"),
    ("proprietary", "confidential", 3, 0.75, "(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "end user licen", 3, 0.8, "end user licen[sc]e agreement"),
    ("proprietary", "unauthorized copying", 4, 0.85, "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "may not be reproduced", 3, 0.7, "may not be (?:copied )?reproduced (?:[^ ]+ ){0,8}without (?:the )?(?:prior )?(?:express )?written (?:permission|consent)"),
    # hints of no licence in particular
    ("copyleft", "copyleft", 1, 0.4, "copyleft"),
    ("no-warranty", "warrant", 1, 0.4, "without warrant(?:y|ies) (?:of|or) (?:any|conditions)(?: kind)?"),
    ("no-warranty", "warrant", 1, 0.4, "without (?:any |express |implied )warrant(?:y|ies)"),
    ("dual", "dual licen", 3, 0.7, "dual licen[sc]ed under (?:the )?(?:[^ ]+ ){1,6}(?:and|or) (?:the )?[^ ]+(?: licen[sc]es?)?"),
    ("see-file", "see", 2, 0.4, "see (?:the )?(?:accompanying )?(?:file )?(?:licen[sc]e|copying)(?: txt| md)?(?: file)? for (?:more )?(?:details|information)"),
    ("open-source", "open source licen", 1, 0.4, "open source licen[sc]es?"),
    ("unknown-spdx", "spdx", 2, 0.5, "spdx licen[sc]e identifier [^ ]+"),
]
