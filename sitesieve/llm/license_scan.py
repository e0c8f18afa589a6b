"""License scan: ordered signature rules, as DataFrame expressions only.

Every license gives a rule per form (machine-readable tag, field, grant sentence, address, bare
name), and every version of a license with versions rules of its own: a label has a version only where the
text states it. The characteristic sentences of the licenses' own notices and the usual short forms are rules
written one by one. A rule is a regular expression with a keyword that each of its matches holds, a priority and a confidence.
A text is searched with the rules whose keyword it contains, and only if it contains one of a few
``ANCHORS`` at all.  A detection whose interval lies inside that of a detection of the same or
a higher priority is suppressed, so the sentence "under the terms of the GNU General Public License,
version 3" is one detection, and the bare name in it none.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases of the base search and their labels (fixed by the contract).
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Licenses without versions: label, regular expression of the name (lower case, single spaces), keyword in every match of the name, SPDX
#: identifier, address
LICENSES = [
    ("0bsd", r"(?:bsd zero[- ]clause|zero[- ]clause bsd|0bsd) licen[cs]e", "bsd", "0bsd", "opensource.org/licenses/0bsd"),
    ("bsd-2-clause", r"(?:bsd 2[- ]clause|2[- ]clause bsd|simplified bsd|freebsd) licen[cs]e", "bsd", "bsd-2-clause", "opensource.org/licenses/bsd-2-clause"),
    ("bsd-3-clause", r"(?:bsd 3[- ]clause|3[- ]clause bsd|new bsd|modified bsd|revised bsd) licen[cs]e", "bsd", "bsd-3-clause", "opensource.org/licenses/bsd-3-clause"),
    ("bsd-4-clause", r"(?:bsd 4[- ]clause|4[- ]clause bsd|original bsd) licen[cs]e", "bsd", "bsd-4-clause", "spdx.org/licenses/bsd-4-clause"),
    ("clear-bsd", r"clear bsd licen[cs]e", "clear bsd", "bsd-3-clause-clear", "spdx.org/licenses/bsd-3-clause-clear"),
    ("hpnd", r"historical permission notice and disclaimer licen[cs]e", "historical permission", "hpnd", "opensource.org/licenses/hpnd"),
    ("ijg", r"independent jpeg group licen[cs]e", "independent jpeg", "ijg", "spdx.org/licenses/ijg"),
    ("isc", r"isc licen[cs]e", "isc", "isc", "opensource.org/licenses/isc"),
    ("mit", r"(?:mit|expat)(?:/x11)? licen[cs]e", " licen", "mit", "opensource.org/licenses/mit"),
    ("mit-0", r"mit no attribution licen[cs]e", "mit no attribution", "mit-0", "spdx.org/licenses/mit-0"),
    ("ms-pl", r"microsoft public licen[cs]e", "microsoft public", "ms-pl", "opensource.org/licenses/ms-pl"),
    ("ncsa", r"university of illinois/ncsa open source licen[cs]e", "ncsa", "ncsa", "opensource.org/licenses/ncsa"),
    ("openssl", r"openssl licen[cs]e", "openssl", "openssl", "openssl.org/source/license"),
    ("postgresql", r"postgresql licen[cs]e", "postgresql", "postgresql", "opensource.org/licenses/postgresql"),
    ("public-domain", r"(?:dedicated to|released into|placed in) the public domain", "public domain", "licenseref-public-domain", "creativecommons.org/publicdomain/mark"),
    ("unlicense", r"(?:the )?unlicense", "unlicense", "unlicense", "unlicense.org"),
    ("vim", r"vim licen[cs]e", "vim", "vim", "spdx.org/licenses/vim"),
    ("wtfpl", r"do what the f\S{2,4} you want to public licen[cs]e", "do what the", "wtfpl", "wtfpl.net"),
    ("w3c", r"w3c software(?: notice and)? licen[cs]e", "w3c", "w3c", "w3.org/consortium/legal/copyright-software"),
    ("x11", r"x11 licen[cs]e", "x11", "x11", "spdx.org/licenses/x11"),
    ("zlib", r"zlib(?:/libpng)? licen[cs]e", "zlib", "zlib", "opensource.org/licenses/zlib"),
]

#: Licenses with versions: label, name, keyword, address, versions.  The name alone gives the label alone, as does a version not listed.
FAMILIES = [
    ("afl", r"academic free licen[cs]e", "academic free", "", "1.1 1.2 2.0 2.1 3.0"),
    ("agpl", r"(?:gnu )?affero general public licen[cs]e", "affero", "gnu.org/licenses/agpl", "1.0 3.0"),
    ("apache", r"apache(?: software)? licen[cs]e", "apache", "apache.org/licenses", "1.0 1.1 2.0"),
    ("artistic", r"artistic licen[cs]e", "artistic", "", "1.0 2.0"),
    ("blueoak", r"blue oak model licen[cs]e", "blue oak", "blueoakcouncil.org/license", "1.0.0"),
    ("bsl", r"boost software licen[cs]e", "boost", "", "1.0"),
    ("busl", r"business source licen[cs]e", "business source", "", "1.1"),
    ("cc-by", r"creative commons attribution(?: (?:unported|international|generic))?", "creative commons", "creativecommons.org/licenses/by", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc", r"creative commons attribution[- ]non-?commercial(?: (?:unported|international|generic))?", "creative commons", "creativecommons.org/licenses/by-nc", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc-nd", r"creative commons attribution[- ]non-?commercial[- ]no ?deriv(?:ative)?s(?: (?:unported|international|generic))?", "creative commons", "creativecommons.org/licenses/by-nc-nd", "2.0 2.5 3.0 4.0"),
    ("cc-by-nc-sa", r"creative commons attribution[- ]non-?commercial[- ]share ?alike(?: (?:unported|international|generic))?", "creative commons", "creativecommons.org/licenses/by-nc-sa", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nd", r"creative commons attribution[- ]no ?deriv(?:ative)?s(?: (?:unported|international|generic))?", "creative commons", "creativecommons.org/licenses/by-nd", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-sa", r"creative commons attribution[- ]share ?alike(?: (?:unported|international|generic))?", "creative commons", "creativecommons.org/licenses/by-sa", "1.0 2.0 2.5 3.0 4.0"),
    ("cc0", r"cc0(?: universal)?", "cc0", "creativecommons.org/publicdomain/zero", "1.0"),
    ("cddl", r"common development and distribution licen[cs]e", "common development", "", "1.0 1.1"),
    ("cecill", r"cecill(?: free software)? licen[cs]e", "cecill", "cecill.info/licences", "1.0 2.0 2.1"),
    ("cpl", r"common public licen[cs]e", "common public", "", "1.0"),
    ("ecl", r"educational community licen[cs]e", "educational community", "", "1.0 2.0"),
    ("elastic", r"elastic licen[cs]e", "elastic", "elastic.co/licensing/elastic-license", "2.0"),
    ("epl", r"eclipse public licen[cs]e", "eclipse", "", "1.0 2.0"),
    ("eupl", r"european union public licen[cs]e", "european union", "joinup.ec.europa.eu/collection/eupl", "1.0 1.1 1.2"),
    ("gfdl", r"(?:gnu )?free documentation licen[cs]e", "free documentation", "gnu.org/licenses/fdl", "1.1 1.2 1.3"),
    ("gpl", r"(?:gnu )?general public licen[cs]e", "general public", "gnu.org/licenses/gpl", "1.0 2.0 3.0"),
    ("ipl", r"ibm public licen[cs]e", "ibm public", "", "1.0"),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public licen[cs]e", "general public", "gnu.org/licenses/lgpl", "2.0 2.1 3.0"),
    ("lppl", r"latex project public licen[cs]e", "latex", "latex-project.org/lppl", "1.0 1.1 1.2 1.3a 1.3c"),
    ("mpl", r"mozilla public licen[cs]e", "mozilla", "mozilla.org/mpl", "1.0 1.1 2.0"),
    ("mulanpsl", r"mulan permissive software licen[cs]e", "mulan", "license.coscl.org.cn/mulanpsl", "1.0 2.0"),
    ("odbl", r"open database licen[cs]e", "open database", "opendatacommons.org/licenses/odbl", "1.0"),
    ("ofl", r"(?:sil )?open font licen[cs]e", "open font", "scripts.sil.org/ofl", "1.0 1.1"),
    ("osl", r"open software licen[cs]e", "open software", "", "1.0 1.1 2.0 2.1 3.0"),
    ("php", r"php licen[cs]e", "php", "php.net/license", "3.0 3.01"),
    ("psf", r"python software foundation licen[cs]e", "python software", "docs.python.org/license", "2.0"),
    ("sspl", r"server side public licen[cs]e", "server side", "mongodb.com/licensing/server-side-public-license", "1.0"),
    ("upl", r"universal permissive licen[cs]e", "universal permissive", "", "1.0"),
    ("zpl", r"zope public licen[cs]e", "zope", "", "1.1 2.0 2.1"),
]

#: Other names of the same: label, name, keyword, versions
ALIASES = [
    ("cc-by", r"cc[- ]by", "cc", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc", r"cc[- ]by[- ]nc", "cc", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc-nd", r"cc[- ]by[- ]nc[- ]nd", "cc", "2.0 2.5 3.0 4.0"),
    ("cc-by-nc-sa", r"cc[- ]by[- ]nc[- ]sa", "cc", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nd", r"cc[- ]by[- ]nd", "cc", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-sa", r"cc[- ]by[- ]sa", "cc", "1.0 2.0 2.5 3.0 4.0"),
    ("cc0", r"creative commons zero(?: universal)?", "creative commons", "1.0"),
    ("gpl", r"gnu gpl", "gnu gpl", "2.0 3.0"),
    ("gpl", r"gpl", "gpl", "2.0 3.0"),
]

#: label, address: pages of one version
ADDRESSES = [
    *[(f"{key}-{v}", f"opensource.org/licenses/{key}-{v}") for key, v in (("afl", "3.0"), ("artistic", "2.0"), ("cddl", "1.0"), ("cpl", "1.0"), ("ecl", "2.0"), ("ipl", "1.0"), ("osl", "3.0"))],
    *[(f"{key}-{v}", f"gnu.org/licenses/{page}-{v}") for key, page, v in (("agpl", "agpl", "3.0"), ("gfdl", "fdl", "1.3"), ("gpl", "gpl", "1.0"), ("gpl", "gpl", "2.0"), ("gpl", "gpl", "3.0"), ("lgpl", "lgpl", "2.1"), ("lgpl", "lgpl", "3.0"))],
    *[(f"{key}-{v}", f"creativecommons.org/licenses/{key[3:]}/{v}") for key in ("cc-by", "cc-by-nc", "cc-by-nc-nd", "cc-by-nc-sa", "cc-by-nd", "cc-by-sa") for v in ("2.0", "2.5", "3.0", "4.0")],
    ("apache-1.1", "apache.org/licenses/license-1.1"), ("apache-2.0", "apache.org/licenses/license-2.0"), ("bsl-1.0", "boost.org/license_1_0"), ("busl-1.1", "mariadb.com/bsl11"),
    ("cc0-1.0", "creativecommons.org/publicdomain/zero/1.0"), ("epl-1.0", "eclipse.org/legal/epl-v10"), ("epl-2.0", "eclipse.org/legal/epl-2.0"), ("mpl-1.1", "mozilla.org/mpl/1.1"),
    ("mpl-2.0", "mozilla.org/mpl/2.0"), ("mulanpsl-2.0", "license.coscl.org.cn/mulanpsl2"), ("upl", "opensource.org/licenses/upl"), ("zpl", "opensource.org/licenses/zpl"),
]

#: No further digit of a version follows.
_END = r"(?!\.?\d)"


def _version(v: str) -> str:
    """A version as written: 2.0 as 2 or 2.0, 2.1 as itself; not the beginning of another one."""
    whole, _, rest = v.partition(".")
    return (whole + r"(?:\.0)?" if rest == "0" else v.replace(".", r"\.")) + _END


#: Beginnings that several notices share
_GRANT = r"permission is hereby granted, free of charge, to any person obtaining a copy of this software"
_FORMS = r"redistribution and use in source and binary forms"
_UMD = r"permission to use, copy, modify,? (?:and|and/or|and /or) distribute this software"
_GNU = r"(?:redistribute (?:it|them) and ?/ ?or modify (?:it|them) )?under the terms of (?:version {0} of )?the gnu {1}general public licen[cs]e"
_PUBLISHED = r",? (?:version {0}(?:\.0)?,? )?as published by the free software foundation(?:[,;:]? (?:either )?version {0}(?:\.0)?(?: of the licen[cs]e)?(?:,? or \(at your option\) any later version)?)"

#: label, regular expression, keyword that every match holds: sentences that the licenses' own notices hold, without naming them
NOTICES = [
    ("mit", _GRANT + r"(?: and associated documentation files)?(?: \(the .{1,2}software.{1,2}\))?,? to deal in the software without restriction[\s\S]{20,400}?subject to the following conditions", "permission is hereby granted"),
    ("mit-0", _GRANT + r"(?: and associated documentation files)?(?: \(the .{1,2}software.{1,2}\))?,? to deal in the software without restriction[\s\S]{20,300}?furnished to do so\. the software is provided", "permission is hereby granted"),
    ("x11", _GRANT + r"[\s\S]{200,1300}?except as contained in this notice, the names? of", "except as contained in this notice"),
    ("ncsa", _GRANT + r"[\s\S]{10,120}?to deal with the software without restriction", "permission is hereby granted"),
    ("mit", _GRANT, "permission is hereby granted"),
    ("mit", r"the above copyright notice and this permission notice(?: \(including the next paragraph\))? shall be included in all copies or substantial portions of the software", "substantial portions of the software"),
    ("json", r"the software shall be used for good, not evil", "good, not evil"),
    ("bsl-1.0", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation", "permission is hereby granted"),
    ("upl-1.0", r"permission is hereby granted to any person obtaining a copy of this software, associated documentation and/or data", "permission is hereby granted"),
    ("unicode-dfs", r"permission is hereby granted, free of charge, to any person obtaining a copy of (?:the unicode )?data files", "permission is hereby granted"),
    ("isc", _UMD + r" for any purpose with or without fee is hereby granted,? provided that the above copyright notice and this permission notice appear in all copies", "with or without fee is hereby granted"),
    ("0bsd", _UMD + r" for any purpose with or without fee is hereby granted\. the software is provided", "with or without fee is hereby granted"),
    ("hpnd", _UMD + r" and its documentation for any purpose(?: and)? without fee is hereby granted", "without fee is hereby granted"),
    ("postgresql", _UMD + r" and its documentation for any purpose, without fee, and without a written agreement is hereby granted", "agreement is hereby granted"),
    ("libtiff", r"permission to use, copy, modify, distribute, and sell this software and its documentation for any purpose is hereby granted without fee", "is hereby granted without fee"),
    ("openssl", _FORMS + r"[\s\S]{100,2000}?redistributions of any form whatsoever must retain the following acknowledge?ment", "of any form whatsoever"),
    ("apache-1.1", _FORMS + r"[\s\S]{100,1400}?the end-user documentation included with the redistribution", "end-user documentation included"),
    ("php", _FORMS + r"[\s\S]{100,1400}?products derived from this software may not be called .{1,2}php", "may not be called"),
    ("bsd-4-clause", _FORMS + r"[\s\S]{100,1400}?all advertising materials mentioning features or use of this software must display(?:[\s\S]{0,600}?neither the names? of)?", "all advertising materials"),
    ("clear-bsd", _FORMS + r"(?:, with or without modification,)? are permitted \(subject to the limitations in the disclaimer below\)(?:[\s\S]{100,1200}?neither the names? of)?", "subject to the limitations in the disclaimer below"),
    ("bsd-3-clause", _FORMS + r"[\s\S]{100,1200}?neither the names? of", "neither the name"),
    ("bsd-3-clause", _FORMS + r"[\s\S]{100,1200}?the names? of [\s\S]{1,120}? may not be used to endorse", "may not be used to endorse"),
    ("bsd-2-clause", _FORMS + r"[\s\S]{100,1000}?materials provided with the distribution\W{1,4}this software is provided", "materials provided with the distribution"),
    ("bsd", _FORMS + r", with or without modification, are permitted", "redistribution and use in source"),
    ("zlib", r"this software is provided .{1,2}as-is.{1,2},? without any express or implied warranty\. in no event will the authors? be held liable", "without any express or implied warranty"),
    ("zlib", r"the origin of this software must not be misrepresented; you must not claim that you wrote the original software", "must not be misrepresented"),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered software"),
    ("blessing", r"the authors? disclaims? copyright to this source code", "copyright to this source code"),
    ("public-domain", r"(?:this (?:file|work|software|code|document) is|has been (?:placed|put|released) (?:in|into)) (?:in )?the public domain", "public domain"),
    ("cc0-1.0", r"to the extent possible under law,[\s\S]{1,160}? ha(?:s|ve) waived all copyright and related or neighbou?ring rights", "waived all copyright"),
    ("cc0-1.0", r"the laws of most jurisdictions throughout the world automatically confer exclusive copyright and related rights", "automatically confer exclusive copyright"),
    ("beerware", r"as long as you retain this notice,? you can do whatever you want with this stuff", "retain this notice"),
    ("wtfpl", r"you just do what the f\S{2,4} you want to", "you just do what the"),
    ("apache-2.0", r"unless required by applicable law or agreed to in writing, software distributed under the licen[cs]e is distributed on an .{1,2}as is.{1,2} basis", "unless required by applicable law"),
    ("apache-2.0", r"subject to the terms and conditions of this licen[cs]e, each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable", "each contributor hereby grants"),
    *[(f"{key}-{v}.0", _GNU.format(v, prefix) + _PUBLISHED.format(v), "published by the free software foundation") for key, prefix, v in (("gpl", "", 1), ("gpl", "", 2), ("gpl", "", 3), ("lgpl", "lesser ", 3), ("agpl", "affero ", 3))],
    ("lgpl-2.0", _GNU.format(r"2", "(?:lesser|library) ") + _PUBLISHED.format(r"2(?!\.[1-9])"), "published by the free software foundation"),
    ("lgpl-2.1", _GNU.format(r"2\.1", "(?:lesser|library) ") + _PUBLISHED.format(r"2\.1"), "published by the free software foundation"),
    ("gpl-3.0", r"the gnu general public licen[cs]e is a free, copyleft licen[cs]e for software and other kinds of works", "other kinds of works"),
    ("agpl-3.0", r"the gnu affero general public licen[cs]e is a free, copyleft licen[cs]e for software and other kinds of works", "other kinds of works"),
    ("gpl", r"you should have received a copy of the gnu general public licen[cs]e", "you should have received a copy"),
    *[(f"gfdl{v and '-' + v}", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation licen[cs]e" + (v and ",? version " + _version(v)), "permission is granted to copy")
      for v in ("", "1.1", "1.2", "1.3")],
    ("mpl-2.0", r"if a copy of the mpl was not distributed with this file,? you can obtain one at", "copy of the mpl"),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public licen[cs]e version 1\.1", "mozilla public"),
    ("epl-2.0", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e (?:version |v\.? ?)?" + _version("2.0"), "eclipse public"),
    ("epl-1.0", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e (?:version |v\.? ?)?" + _version("1.0"), "eclipse public"),
    *[(f"cddl{v and '-' + v}", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e" + (v and ",? version " + _version(v)), "common development") for v in ("", "1.0", "1.1")],
    ("ofl", r"the goals of the open font licen[cs]e \(ofl\) are to stimulate worldwide development", "open font"),
    ("artistic-1.0", r"the intent of this document is to state the conditions under which a package may be copied", "conditions under which a package may be copied"),
    ("artistic-2.0", r"this licen[cs]e establishes the terms under which a given free software package may be copied", "free software package may be copied"),
    ("busl-1.1", r"the licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use of the licensed work", "non-production use of the licensed work"),
    ("elastic-2.0", r"you may not provide the software to third parties as a hosted or managed service", "hosted or managed service"),
    ("psf", r"this licen[cs]e agreement is between the python software foundation", "python software foundation"),
    ("vim", r"there are no restrictions on distributing unmodified copies of vim", "copies of vim"),
    ("ijg", r"this software is based in part on the work of the independent jpeg group", "independent jpeg group"),
    ("cecill", r"this software is governed by the cecill licen[cs]e under french law", "cecill"),
    ("ms-pl", r"this licen[cs]e governs use of the accompanying software\. if you use the software, you accept this licen[cs]e", "governs use of the accompanying software"),
    ("odbl", r"the open database licen[cs]e \(odbl\) is a licen[cs]e agreement intended to allow users to freely share, modify, and use this database", "open database"),
    ("blueoak", r"each contributor licenses you to do everything with this software that would otherwise infringe", "each contributor licenses you"),
]

_THEN = r"(?:\+|[- ]only|[- ]or[- ]later)?(?!\.?\d)"
_V = r"(?:,? version |,? ?v\.? ?|[- ]v?)"

#: label, regular expression, keyword: what people write for a license's name
SHORT_FORMS = [
    *[(f"{key}-{v}", r"(?:gnu )?" + key + _V + _version(v) + _THEN, key) for key, versions in (("gpl", "1.0 2.0 3.0"), ("lgpl", "2.0 2.1 3.0"), ("agpl", "1.0 3.0"), ("gfdl", "1.1 1.2 1.3")) for v in versions.split()],
    ("gpl", r"gnu gpl", "gnu gpl"),
    ("gpl", r"(?:under|by) the gpl", "the gpl"),
    ("gpl", r"gpl[- ]licen[cs]ed", "gpl"),
    ("lgpl", r"gnu lgpl", "gnu lgpl"),
    ("agpl", r"gnu agpl", "gnu agpl"),
    ("gfdl", r"(?:gnu )?gfdl", "gfdl"),
    *[(f"{label}-{v}", r"(?:sil )?" * (key == "ofl") + key + (_V if key == "apache" else r"[- ](?:v\.? ?)?") + _version(v).replace(r"(?:\.0)?", r"\.0") + _THEN, key)
      for label, key, versions in (("apache", "apache", "1.0 1.1 2.0"), ("apache", "asl", "2.0"), ("mpl", "mpl", "1.0 1.1 2.0"), ("epl", "epl", "1.0 2.0"), ("cddl", "cddl", "1.0 1.1"), ("ofl", "ofl", "1.0 1.1"),
                                   ("eupl", "eupl", "1.0 1.1 1.2"), ("odbl", "odbl", "1.0"), ("sspl", "sspl", "1.0"), ("artistic", "artistic", "1.0 2.0")) for v in versions.split()],
    ("busl-1.1", r"busl[- ]1\.1", "busl"),
    ("bsl-1.0", r"bsl-1\.0", "bsl-1.0"),
    ("bsd-2-clause", r"bsd[- ]2[- ]clause", "bsd"),
    ("bsd-2-clause", r"2[- ]clause bsd", "clause bsd"),
    ("bsd-3-clause", r"bsd[- ]3[- ]clause", "bsd"),
    ("bsd-3-clause", r"3[- ]clause bsd", "clause bsd"),
    ("bsd-4-clause", r"bsd[- ]4[- ]clause", "bsd"),
    ("bsd", r"bsd(?:[- ]style)? licen[cs]ed?", "bsd"),
    ("0bsd", r"0bsd", "0bsd"),
    ("mit", r"mit[- ]licen[cs]ed", "mit"),
    ("mit", r"mit/x11", "mit/x11"),
    ("isc", r"isc[- ]licen[cs]ed", "isc"),
    ("wtfpl", r"wtfpl", "wtfpl"),
]

#: Every match of every rule holds one of these.
ANCHORS = ("licen", "spdx", "gpl", "cc by", "cc-by", "cc0", "creative commons", "creativecommons", "public domain", ".org/", ".com/", ".net/", ".co/", ".cn/", ".eu/", "wtfpl", "unlicense.org", "cecill.info",
           # of notices
           "hereby granted", "redistribution and use in source", "substantial portions of the software", "without any express or implied warranty", "must not be misrepresented", "good, not evil", "copyright to this source code", "waived all copyright",
           "automatically confer exclusive copyright", "retain this notice", "you just do what the f", "copy of the mpl", "conditions under which a package may be copied", "hosted or managed service", "copies of vim", "independent jpeg group",
           # of short forms
           "apache", "bsd", "asl-", "asl ", "mit/x11", "mpl-", "mpl ", "epl-", "epl ", "cddl", "ofl-", "ofl ", "eupl", "odbl", "sspl", "busl", "artistic", "bsl-1", "gfdl")

#: form, pattern around a license's field, field of LICENSES, priority, confidence; matches lie between non-word characters
FORMS = [
    ("tag", r"spdx-license-identifier: ?{}", 3, 4, 1.0),
    ("field", r"licen[cs]es?[\"']? ?[:=] ?[\"']?{}(?![\w.-]*[\w-])", 3, 3, 0.95),
    ("grant", r"(?:licen[cs]ed|released|distributed|published|provided|(?:made )?available|covered) (?:under|by)(?: the)?(?: terms (?:and conditions )?of(?: the)?)? {}", 1, 3, 0.95),
    ("address", r"(?:https?://)?(?:www\.)?{}", 4, 2, 0.9),
    ("name", r"{}", 1, 1, 0.6),
]
LEVELS = 4


def _entries() -> list[tuple[str, str, str, str, str]]:
    """Rows as in ``LICENSES``; a family has one without and one for each version."""
    out = list(LICENSES)
    gnu = {"agpl", "gfdl", "gpl", "lgpl"}
    for label, name, keyword, address, versions in FAMILIES:
        out.append((label, name, keyword, label, address))
        for v in versions.split():
            out.append((f"{label}-{v}", _written(name, v), keyword, re.escape(f"{label}-{v}") + r"(?:-only|-or-later|\+)?" * (label in gnu), ""))
    for label, name, keyword, versions in ALIASES:
        out += [(label, name, keyword, "", "")] * (name != "gpl") + [(f"{label}-{v}", _written(name, v), keyword, "", "") for v in versions.split()]
    return out + [(label, "", "", "", address) for label, address in ADDRESSES]


def _written(name: str, v: str) -> str:
    return rf"{name}(?:,? |-)?(?:version |v\.? ?|- v )?{_version(v)}(?: or later)?"


def rules() -> list[tuple[str, str, str, int, float]]:
    """(label, regular expression, keyword, priority, confidence): every license in every form, then the notices and the short forms."""
    out = []
    for license in _entries():
        for form, around, field, priority, confidence in FORMS:
            if not license[field]:
                continue
            body = license[field].replace(".", r"\.") if field == 4 else license[field]
            keyword = {"tag": "spdx-license-identifier", "field": re.sub(r"\(.*|\\", "", license[3]), "address": license[4]}.get(form, license[2])
            out.append((license[0], r"(?<![\w-])" + around.format(body) + r"(?![\w])", keyword, priority, confidence))
    for written, priority, confidence in ((NOTICES, 3, 0.9), (SHORT_FORMS, 1, 0.6)):
        out += [(label, r"(?<![\w-])" + regex + r"(?![\w])", keyword, priority, confidence) for label, regex, keyword in written]
    return out


def _base(text: Column, lower: Column) -> dict[str, Column]:
    """Number of words, and per phrase the number, first and last start of its places."""
    gated = lower.contains("license")
    flat = F.regexp_replace(F.translate(text, UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return {"n_words": F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long"),
            "_flat": F.when(gated, F.concat(F.lit(" "), F.btrim(flat, F.lit(" ")), F.lit(" ")))}


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _places(phrase: str) -> tuple[Column, Column, Column]:
    """(number, first start, last start) of a phrase in ``_flat``, words between single spaces; null without any."""
    flat, own = F.col("_flat"), f" {phrase} "
    twice = F.replace(flat, F.lit(" "), F.lit("  "))  # neighbours share no space then
    pattern = " " + phrase.replace(" ", "  ") + " "
    number = (F.length(twice) - F.length(F.replace(twice, F.lit(pattern), F.lit("")))) / len(pattern)
    found = flat.contains(own)
    first = _spaces(F.substring(flat, F.lit(1), F.locate(own, flat))) - 1
    back = F.reverse(flat)
    after = _spaces(F.substring(back, F.lit(1), F.locate(own[::-1], back))) - 1
    last = F.col("n_words") - after - len(phrase.split())
    return F.when(found, number).cast("long"), F.when(found, first).cast("long"), F.when(found, last).cast("long")


def _detections(rows: DataFrame) -> DataFrame:
    """(_row, label, start, end, confidence) of the detections in ``_low`` that no other one suppresses."""
    table = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(label).alias("label"), F.lit(regex).alias("regex"), F.lit(keyword).alias("keyword"), F.lit(priority).alias("priority"), F.lit(confidence).alias("confidence"))
                      for i, (label, regex, keyword, priority, confidence) in enumerate(rules())])
    due = rows.select("_row", "_low", F.explode(F.filter(table, lambda r: F.contains(F.col("_low"), r["keyword"]))).alias("r"))
    # a text split at the matches gives the lengths between them
    due = due.select("_row", "r", F.split("_low", F.col("r.regex"), -1).alias("_between"), F.regexp_extract_all("_low", F.col("r.regex"), F.lit(0)).alias("_match")).where(F.size("_match") > 0)
    lengths = F.arrays_zip(F.transform("_between", lambda s: F.length(s)).alias("gap"), F.transform("_match", lambda s: F.length(s)).alias("size"))
    each = due.select("_row", "r.rule", "r.label", "r.priority", "r.confidence", F.posexplode(lengths).alias("k", "m")).select("_row", "rule", "label", "priority", "confidence", "k", F.col("m.gap").alias("gap"), F.col("m.size").alias("size")).where("size is not null")
    before = Window.partitionBy("_row", "rule").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before)).withColumn("start", F.col("end") - F.col("size"))
    # inside another's interval: it begins no later, ends no earlier and comes first in this order
    earlier = Window.partitionBy("_row").orderBy("start", F.desc("end"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = [F.max(F.when(F.col("priority") >= p, F.col("end"))).over(earlier).alias(f"_reach{p}") for p in range(1, LEVELS + 1)]
    each = each.select("*", *reach)
    reached = reduce(lambda c, p: c.when(F.col("priority") == p, F.col(f"_reach{p}")), range(2, LEVELS + 1), F.when(F.col("priority") == 1, F.col("_reach1")))
    return each.where(F.coalesce(reached < F.col("end"), F.lit(True))).select("_row", "label", "start", "end", "confidence")


def detections(docs: DataFrame) -> DataFrame:
    """(doc_id, label, start, end, confidence): spans in the lower-cased text with single spaces for white space."""
    low = _flat_spaces(F.lower("text"))
    rows = saved(docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", low.alias("_low")).where(_gate("_low")), "gated")
    return _detections(rows).join(rows.select("_row", "doc_id"), "_row").drop("_row")


def _flat_spaces(lower: Column) -> Column:
    return F.regexp_replace(lower, r"\s+", " ")


def _gate(column: str) -> Column:
    return reduce(lambda a, b: a | b, [F.col(column).contains(a) for a in ANCHORS])


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, the base search, and the detections.

    n_words (words of letters, digits and characters beyond ASCII), n_base (all places of
    the phrases), first_word and last_word (smallest and largest start, null without any),
    base_labels, labels (base labels and those of the detections; both distinct, sorted,
    comma-joined, empty without any), score (largest confidence; 0.5 for a base label that no
    detection confirms, 0 without labels), n_detections.  ``detections`` gives their spans.  A null text counts as empty; repeated rows
    are scanned each; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_text"), F.lower(text).alias("_lower"))
    rows = rows.withColumns(_base(F.col("_text"), F.col("_lower")))
    # anchors hold spaces, so the gate sees the text as the rules do
    rows = rows.withColumn("_low", _flat_spaces(F.col("_lower")))
    rows = rows.withColumn("_low", F.when(_gate("_low"), F.col("_low")))
    names = []
    for i, (phrase, _) in enumerate(PHRASES):
        for name, value in zip(("n", "first", "last"), _places(phrase)):
            rows = rows.withColumn(f"_{name}{i}", value)
            names.append(f"_{name}{i}")
    rows = rows.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "n_words", "_low", *names)
    # the numbers of all rows, and the text of the few that rules have to search
    rows = saved(rows, "scanned")
    found = _detections(rows.where("_low is not null").select("_row", "_low"))
    found = found.groupBy(F.col("_row").alias("_found")).agg(
        F.array_sort(F.collect_set("label")).alias("_labels"), F.max("confidence").alias("_confidence"), F.count("*").alias("n_detections"))
    rows = rows.drop("_low").join(found, F.col("_row") == F.col("_found"), "left")
    every = range(len(PHRASES))
    base = F.filter(F.array(*[F.when(F.col(f"_n{i}") > 0, F.lit(PHRASES[i][1])) for i in every]), lambda v: v.isNotNull())
    labels = F.array_sort(F.array_union(base, F.coalesce("_labels", F.array().cast("array<string>"))))
    score = F.when(F.size(labels) == 0, 0.0).otherwise(F.coalesce("_confidence", F.lit(0.5)))
    return rows.select(
        "doc_id", "n_words", sum(F.coalesce(f"_n{i}", F.lit(0)) for i in every).cast("long").alias("n_base"),
        F.least(*[F.col(f"_first{i}") for i in every]).alias("first_word"), F.greatest(*[F.col(f"_last{i}") for i in every]).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"),
        F.coalesce("n_detections", F.lit(0)).alias("n_detections"))
