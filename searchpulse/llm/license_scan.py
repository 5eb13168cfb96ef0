"""License detection by ordered signature rules.

Each rule is a regular expression with a label, a priority and a score, guarded by
keywords: a rule runs only on texts that hold all of its keywords. Of overlapping
detections the one of higher priority wins; a detection that lies inside another, or
overlaps it in part, is suppressed by the one taken first.

Rules and keywords see a copy of the text in which white space and comment marks between
words are one blank, so wrapped, indented and commented notices match; spans are those of
the text itself. A numbered item behind an empty line stays apart from what is before it,
as in a licence's title and its clause 2.

Besides the rules, three phrases are located by word position and always reported.

SPDX lines are read as expressions: each licence that one names is a detection.

Edge cases: null and empty texts have no words and no labels; whole texts of any
length are scanned; repeated rows are scanned row by row; an empty table gives no rows;
of rules with the same priority the longer match wins, then the first in the text; only the
id and the text are read, so other columns' names may clash.
"""

from __future__ import annotations

import bisect
import re

from pyspark.sql import DataFrame

from searchpulse.llm.common import alnum_words

#: Fixed phrases and their labels.
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}

# (label, names as regular expressions, keyword of every name, words of the SPDX tag)
FAMILIES = [
    ("apache-2.0", [r"apache (?:software )?licen[sc]e,? (?:version |v\.? ?)?2(?:\.0)?"], "apache", "apache-2.0"),
    ("apache-1.1", [r"apache (?:software )?licen[sc]e,? (?:version |v\.? ?)?1\.1"], "apache", "apache-1.1"),
    ("mit", [r"mit licen[sc]e", r"expat licen[sc]e"], "licen", "mit"),
    ("mit-0", [r"mit no attribution"], "no attribution", "mit-0"),
    ("isc", [r"isc licen[sc]e"], "isc licen", "isc"),
    ("bsd-2-clause", [r"(?:simplified|freebsd|2[- ]clause) bsd(?: licen[sc]e)?", r"bsd 2[- ]clause"], "bsd", "bsd-2-clause"),
    ("bsd-3-clause", [r"(?:new|revised|modified|3[- ]clause) bsd(?: licen[sc]e)?", r"bsd 3[- ]clause"], "bsd", "bsd-3-clause"),
    ("bsd-4-clause", [r"(?:original|4[- ]clause) bsd(?: licen[sc]e)?", r"bsd 4[- ]clause"], "bsd", "bsd-4-clause"),
    ("0bsd", [r"zero[- ]clause bsd(?: licen[sc]e)?"], "bsd", "0bsd"),
    ("gpl-1.0", [r"(?:gnu )?general public licen[sc]e,? (?:version |v\.? ?)1(?:\.0)?"], "general public", "gpl-1.0"),
    ("gpl-2.0", [r"(?:gnu )?general public licen[sc]e,? (?:version |v\.? ?)2(?:\.0)?", r"gplv2"], "gpl", "gpl-2.0"),
    ("gpl-3.0", [r"(?:gnu )?general public licen[sc]e,? (?:version |v\.? ?)3(?:\.0)?", r"gplv3"], "gpl", "gpl-3.0"),
    ("lgpl-2.1", [r"(?:gnu )?lesser general public licen[sc]e,? (?:version |v\.? ?)2\.1"], "lesser general", "lgpl-2.1"),
    ("lgpl-3.0", [r"(?:gnu )?lesser general public licen[sc]e,? (?:version |v\.? ?)3(?:\.0)?"], "lesser general", "lgpl-3.0"),
    ("agpl-3.0", [r"(?:gnu )?affero general public licen[sc]e(?:,? (?:version |v\.? ?)3(?:\.0)?)?"], "affero", "agpl-3.0"),
    ("gfdl-1.3", [r"(?:gnu )?free documentation licen[sc]e(?:,? (?:version |v\.? ?)1\.3)?"], "free documentation", "gfdl-1.3"),
    ("mpl-1.1", [r"mozilla public licen[sc]e,? (?:version |v\.? ?)1\.1"], "mozilla", "mpl-1.1"),
    ("mpl-2.0", [r"mozilla public licen[sc]e,? (?:version |v\.? ?)2(?:\.0)?"], "mozilla", "mpl-2.0"),
    ("epl-1.0", [r"eclipse public licen[sc]e,? (?:version |v\.? ?)?1(?:\.0)?"], "eclipse", "epl-1.0"),
    ("epl-2.0", [r"eclipse public licen[sc]e,? (?:version |v\.? ?)?2(?:\.0)?"], "eclipse", "epl-2.0"),
    ("cddl-1.0", [r"common development and distribution licen[sc]e"], "common development", "cddl-1.0"),
    ("cpl-1.0", [r"common public licen[sc]e"], "common public", "cpl-1.0"),
    ("eupl-1.2", [r"european union public licen[sc]e"], "european union", "eupl-1.2"),
    ("artistic-1.0", [r"artistic licen[sc]e,? (?:version |v\.? ?)?1(?:\.0)?"], "artistic", "artistic-1.0"),
    ("artistic-2.0", [r"artistic licen[sc]e,? (?:version |v\.? ?)?2(?:\.0)?"], "artistic", "artistic-2.0"),
    ("bsl-1.0", [r"boost software licen[sc]e"], "boost", "bsl-1.0"),
    ("busl-1.1", [r"business source licen[sc]e"], "business source", "busl-1.1"),
    ("sspl-1.0", [r"server side public licen[sc]e"], "server side", "sspl-1.0"),
    ("elastic-2.0", [r"elastic licen[sc]e(?:,? (?:version |v\.? ?)?2(?:\.0)?)?"], "elastic licen", "elastic-2.0"),
    ("zlib", [r"zlib licen[sc]e", r"zlib/libpng licen[sc]e"], "zlib", "zlib"),
    ("libpng-2.0", [r"libpng licen[sc]e"], "libpng", "libpng-2.0"),
    ("unlicense", [r"the unlicense", r"unlicense\.org"], "unlicense", "unlicense"),
    ("wtfpl", [r"do what the f\w+ you want to public licen[sc]e", r"wtfpl"], "wtf", "wtfpl"),
    ("postgresql", [r"postgresql licen[sc]e"], "postgresql", "postgresql"),
    ("python-2.0", [r"python software foundation licen[sc]e", r"psf licen[sc]e"], "licen", "python-2.0"),
    ("php-3.01", [r"php licen[sc]e(?:,? (?:version |v\.? ?)?3\.01)?"], "php", "php-3.01"),
    ("ruby", [r"ruby licen[sc]e"], "ruby", "ruby"),
    ("vim", [r"vim licen[sc]e"], "vim", "vim"),
    ("openssl", [r"openssl licen[sc]e"], "openssl", "openssl"),
    ("ofl-1.1", [r"sil open font licen[sc]e"], "open font", "ofl-1.1"),
    ("odbl-1.0", [r"open database licen[sc]e", r"open data commons open database"], "open data", "odbl-1.0"),
    ("odc-by-1.0", [r"open data commons attribution licen[sc]e"], "open data", "odc-by-1.0"),
    ("pddl-1.0", [r"public domain dedication and licen[sc]e"], "public domain", "pddl-1.0"),
    ("cdla-permissive-2.0", [r"community data licen[sc]e agreement"], "community data", "cdla-permissive-2.0"),
    ("ms-pl", [r"microsoft public licen[sc]e"], "microsoft", "ms-pl"),
    ("ms-rl", [r"microsoft reciprocal licen[sc]e"], "microsoft", "ms-rl"),
    ("ncsa", [r"university of illinois/ncsa open source licen[sc]e", r"ncsa open source licen[sc]e"], "ncsa", "ncsa"),
    ("upl-1.0", [r"universal permissive licen[sc]e"], "universal permissive", "upl-1.0"),
    ("mulanpsl-2.0", [r"mulan permissive software licen[sc]e"], "mulan", "mulanpsl-2.0"),
    ("afl-3.0", [r"academic free licen[sc]e"], "academic free", "afl-3.0"),
    ("osl-3.0", [r"open software licen[sc]e"], "open software", "osl-3.0"),
    ("qpl-1.0", [r"q public licen[sc]e"], "q public", "qpl-1.0"),
    ("cecill-2.1", [r"cecill licen[sc]e", r"ce\s?cill"], "cill", "cecill-2.1"),
    ("openrail-m", [r"openrail(?:-m|\+\+)?(?: licen[sc]e)?"], "openrail", "openrail-m"),
    ("llama-community", [r"llama \d(?:\.\d)? community licen[sc]e"], "community licen", "llama-community"),
    ("curl", [r"curl licen[sc]e"], "curl", "curl"),
    ("json", [r"json licen[sc]e", r"shall be used for good, not evil"], "good|json", "json"),
    ("beerware", [r"beer-?ware licen[sc]e"], "ware licen", "beerware"),
    ("x11", [r"x11 licen[sc]e"], "x11", "x11"),
    ("w3c", [r"w3c software (?:notice and )?licen[sc]e"], "w3c", "w3c"),
    ("icu", [r"icu licen[sc]e"], "icu", "icu"),
    ("unicode-dfs-2016", [r"unicode licen[sc]e", r"unicode,? inc\.? licen[sc]e agreement"], "unicode", "unicode-dfs-2016"),
    ("ftl", [r"freetype (?:project )?licen[sc]e"], "freetype", "ftl"),
    ("ijg", [r"independent jpeg group"], "jpeg", "ijg"),
    ("tcl", [r"tcl/tk licen[sc]e"], "tcl", "tcl"),
    ("sleepycat", [r"sleepycat licen[sc]e"], "sleepycat", "sleepycat"),
    ("watcom-1.0", [r"sybase open watcom public licen[sc]e"], "watcom", "watcom-1.0"),
    ("nasa-1.3", [r"nasa open source agreement"], "nasa", "nasa-1.3"),
    ("rpl-1.5", [r"reciprocal public licen[sc]e"], "reciprocal public", "rpl-1.5"),
    ("ecl-2.0", [r"educational community licen[sc]e"], "educational", "ecl-2.0"),
    ("zpl-2.1", [r"zope public licen[sc]e"], "zope", "zpl-2.1"),
    ("vsl-1.0", [r"vovida software licen[sc]e"], "vovida", "vsl-1.0"),
]
# Creative Commons variants: parts of the licence and the words that name them.
CC_PARTS = {
    "by": r"attribution",
    "by-sa": r"attribution[- ]share ?alike",
    "by-nd": r"attribution[- ]no ?deriv\w+",
    "by-nc": r"attribution[- ]non ?commercial",
    "by-nc-sa": r"attribution[- ]non ?commercial[- ]share ?alike",
    "by-nc-nd": r"attribution[- ]non ?commercial[- ]no ?deriv\w+",
}
CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]
# Phrases of licence bodies and notices: (label, pattern, keywords)
BODIES = [
    ("mit", r"permission is hereby granted, free of charge, to any person obtaining a copy", ["hereby granted"]),
    ("isc", r"permission to use, copy, modify, and/or distribute this software", ["and/or distribute"]),
    ("bsd", r"redistribution and use in source and binary forms", ["redistribution"]),
    ("bsd-3-clause", r"neither the name of [^\n.]{1,80} nor the names of its contributors", ["neither the name"]),
    ("apache-2.0", r"you may not use this file except in compliance with the license", ["in compliance"]),
    ("gpl", r"this program is free software[:;,] you can redistribute it", ["free software"]),
    ("gpl", r"(?:gnu )?general public licen[sc]e", ["general public"]),
    ("lgpl", r"(?:gnu )?lesser general public licen[sc]e", ["lesser general"]),
    ("mpl-2.0", r"subject to the terms of the mozilla public license", ["mozilla"]),
    ("unlicense", r"this is free and unencumbered software released into the public domain", ["unencumbered"]),
    ("cc0-1.0", r"creative commons zero|\bcc0(?:[- ]1\.0)?\b", ["cc0|creative commons"]),
    ("public-domain", r"(?:dedicated to|released into|is in) the public domain", ["public domain"]),
    ("proprietary", r"all rights reserved", ["all rights reserved"]),
    ("proprietary", r"(?:proprietary and confidential|may not be (?:copied|reproduced|redistributed))", ["proprietary|may not be"]),
    ("no-license", r"no licen[sc]e (?:is )?granted", ["granted"]),
    ("licensed-unknown", r"licen[sc]ed under (?:the )?(?:terms of )?", ["licen"]),
]
# Sentences that only one licence's text or notice holds: (label, pattern, keywords).
SENTENCES = [
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["permission notice"]),
    ("mit", r"in no event shall the authors or copyright holders be liable for any claim, damages or other liability", ["holders be liable"]),
    ("x11", r"except as contained in this notice, the names? of .{1,80}? shall not be used in advertising", ["used in advertising"]),
    ("isc", r"the software is provided .{0,2}as is.{0,2} and (?:the author|isc) disclaims all warranties", ["disclaims all warranties"]),
    ("isc", r"provided that the above copyright notice and this permission notice appear in all copies", ["permission notice"]),
    ("0bsd", r"permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\.", ["and/or distribute"]),
    ("bsd", r"redistributions of source code must retain the above copyright notice", ["redistributions"]),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice", ["redistributions"]),
    ("bsd", r"this software is provided by the (?:copyright holders and contributors|regents and contributors|authors?) .{0,2}as is", ["software is provided by"]),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display", ["advertising materials"]),
    ("bsd-3-clause", r"may be used to endorse or promote products derived from this software without specific prior written permission", ["endorse or promote"]),
    ("apache-2.0", r"unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an .{0,2}as is.{0,2} basis", ["applicable law"]),
    ("apache-2.0", r"each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license", ["hereby grants"]),
    ("apache-2.0", r"licensed to the apache software foundation \(asf\) under one or more contributor license agreements", ["apache software foundation"]),
    ("apache-1.1", r"this product includes software developed by the apache software foundation", ["apache software foundation"]),
    ("gpl-1.0-or-later", r"either version 1,? or \(at your option\) any later version", ["any later version"]),
    ("gpl-2.0-or-later", r"(?:general public license as published by the free software foundation[;,] )?either version 2 of the license, or \(at your option\) any later version", ["any later version"]),
    ("gpl-3.0-or-later", r"(?:general public license as published by the free software foundation[;,] )?either version 3 of the license, or \(at your option\) any later version", ["any later version"]),
    ("gpl-2.0-only", r"under the terms of version 2 of the gnu general public license as published by the free software foundation", ["version 2 of the gnu"]),
    ("gpl-2.0", r"terms of the gnu general public license,? version 2,? as published by the free software foundation", ["general public license"]),
    ("gpl-3.0", r"terms of the gnu general public license,? version 3,? as published by the free software foundation", ["general public license"]),
    ("lgpl-2.1-or-later", r"lesser general public license as published by the free software foundation[;,] either version 2\.1 of the license, or \(at your option\) any later version", ["any later version"]),
    ("lgpl-3.0-or-later", r"lesser general public license as published by the free software foundation[;,] either version 3 of the license, or \(at your option\) any later version", ["any later version"]),
    ("lgpl-2.0-or-later", r"library general public license as published by the free software foundation[;,] either version 2 of the license, or \(at your option\) any later version", ["any later version"]),
    ("agpl-3.0-or-later", r"affero general public license as published by the free software foundation[;,] either version 3 of the license, or \(at your option\) any later version", ["any later version"]),
    ("agpl-3.0", r"your modified version must prominently offer all users interacting with it remotely through a computer network", ["interacting with it remotely"]),
    ("lgpl", r"this library is free software[:;,] you can redistribute it", ["free software"]),
    ("gpl", r"you should have received a copy of the gnu general public license along with this program", ["general public license"]),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public license along with this", ["general public license"]),
    ("agpl-3.0", r"you should have received a copy of the gnu affero general public license along with this", ["affero general public"]),
    ("gpl", r"(?:program|software|library) is distributed in the hope that it will be useful, but without any warranty", ["hope that it will be useful"]),
    ("gfdl-1.3", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license", ["free documentation"]),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license,? v\. ?2\.0", ["source code form"]),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1\.1", ["contents of this file"]),
    ("epl-1.0", r"made available under the terms of the eclipse public license v1\.0", ["eclipse public license"]),
    ("epl-2.0", r"made available under the terms of the eclipse public license (?:v\. ?)?2\.0", ["eclipse public license"]),
    ("cddl-1.0", r"subject to the terms of the common development and distribution license", ["common development"]),
    ("zlib", r"altered source versions must be plainly marked as such,? and must not be misrepresented as being the original software", ["plainly marked"]),
    ("zlib", r"this software is provided .{0,2}as-is.{0,2},? without any express or implied warranty", ["without any express"]),
    ("bsl-1.0", r"any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ["accompanying documentation"]),
    ("unlicense", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", ["anyone is free"]),
    ("cc0-1.0", r"to the extent possible under law, .{1,80}? has waived all copyright and related or neighboring rights", ["extent possible under law"]),
    ("public-domain", r"(?:this (?:work|file|code|software) (?:is|has been) (?:hereby )?placed|placed) in(?:to)? the public domain", ["public domain"]),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document,? and changing it is allowed", ["changing it is allowed"]),
    ("ofl-1.1", r"this font software is licensed under the sil open font license", ["font software"]),
    ("ofl-1.1", r"the font software may be sold as part of a larger software package", ["font software"]),
    ("postgresql", r"for any purpose, without fee, and without a written agreement is hereby granted", ["written agreement"]),
    ("python-2.0", r"psf is making python available to licensee on an .{0,2}as is.{0,2} basis", ["psf is making"]),
    ("php-3.01", r"this product includes php(?: software)?, freely available from", ["includes php"]),
    ("openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit", ["openssl toolkit"]),
    ("beerware", r"as long as you retain this notice you can do whatever you want with this stuff", ["whatever you want"]),
    ("artistic-2.0", r"everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed", ["changing it is not allowed"]),
    ("artistic-1.0", r"the intent of this document is to state the conditions under which a package may be copied", ["intent of this document"]),
    ("ijg", r"this software is based in part on the work of the independent jpeg group", ["jpeg group"]),
    ("ftl", r"portions of this software are copyright .{1,60}? the freetype project", ["freetype project"]),
    ("ms-pl", r"if you bring a patent claim against any contributor over patents that you claim are infringed by the software", ["patent claim"]),
    ("ncsa", r"deal with the software without restriction", ["deal with the software"]),
    ("w3c", r"permission to copy, modify, and distribute this (?:work|software and its documentation), with or without modification, for any purpose and without fee or royalty", ["fee or royalty"]),
    ("vim", r"there are no restrictions on distributing unmodified copies of vim", ["copies of vim"]),
    ("sleepycat", r"redistributions in any form must be accompanied by information on how to obtain complete source code", ["complete source code"]),
    ("busl-1.1", r"the licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use", ["non-production use"]),
    ("elastic-2.0", r"you may not provide the software to third parties as a hosted or managed service", ["managed service"]),
    ("sspl-1.0", r"if you make the functionality of the program .{1,40}? available to third parties as a service, you must make the service source code available", ["service source code"]),
    ("eupl-1.2", r"licen[sc]ed under the eupl", ["eupl"]),
    ("cc-by", r"this (?:work|article|book|document|file) is (?:licensed|made available|distributed) under (?:the terms of )?(?:a|the) creative commons attribution", ["creative commons attribution"]),
    ("odbl-1.0", r"this .{1,60}? is made available under the open database license", ["open database license"]),
    ("proprietary", r"unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|document|material)", ["unauthori"]),
    ("proprietary", r"(?:this|the) (?:software|document|material) (?:contains|is) (?:the )?(?:confidential|proprietary) (?:information|property) of", ["confidential|proprietary"]),
]
# Addresses of licence texts, behind their scheme: (label, pattern, keyword).
ADDRESSES = [
    ("apache-2.0", r"apache\.org/licenses/license-2\.0", "apache.org/licenses"),
    ("apache-1.1", r"apache\.org/licenses/license-1\.1", "apache.org/licenses"),
    ("gpl-2.0", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0", "gnu.org/licenses"),
    ("gpl-3.0", r"gnu\.org/licenses/gpl-3\.0", "gnu.org/licenses"),
    ("gpl", r"gnu\.org/(?:licenses|copyleft)/gpl(?:\.\w+)?(?![\w-])", "gnu.org"),
    ("lgpl-2.1", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1", "gnu.org/licenses"),
    ("lgpl-3.0", r"gnu\.org/licenses/lgpl-3\.0", "gnu.org/licenses"),
    ("lgpl", r"gnu\.org/(?:licenses|copyleft)/(?:lgpl|lesser)(?:\.\w+)?(?![\w-])", "gnu.org"),
    ("agpl-3.0", r"gnu\.org/licenses/agpl(?:-3\.0)?", "gnu.org/licenses"),
    ("gfdl-1.3", r"gnu\.org/(?:licenses|copyleft)/fdl", "gnu.org"),
    ("gpl", r"gnu\.org/licenses/?(?![\w/])", "gnu.org/licenses"),
    ("mpl-2.0", r"mozilla\.org/(?:[a-z-]+/)?mpl/2\.0", "mozilla.org"),
    ("mpl-1.1", r"mozilla\.org/(?:[a-z-]+/)?mpl/(?:1\.1|mpl-1\.1)", "mozilla.org"),
    ("epl-1.0", r"eclipse\.org/(?:legal|org/documents)/epl-v10", "eclipse.org"),
    ("epl-2.0", r"eclipse\.org/legal/epl-(?:2\.0|v20)", "eclipse.org"),
    ("bsl-1.0", r"boost\.org/license_1_0", "boost.org"),
    ("unlicense", r"unlicense\.org", "unlicense.org"),
    ("wtfpl", r"wtfpl\.net", "wtfpl.net"),
    ("cc0-1.0", r"creativecommons\.org/publicdomain/zero/1\.0", "creativecommons"),
    ("public-domain", r"creativecommons\.org/(?:publicdomain/mark|licenses/publicdomain)", "creativecommons"),
    ("ofl-1.1", r"(?:scripts\.sil\.org/ofl|openfontlicense\.org)", "sil.org|openfontlicense"),
    ("php-3.01", r"php\.net/license/3_01", "php.net/license"),
    ("python-2.0", r"(?:python\.org/psf/license|docs\.python\.org/3/license)", "python.org"),
    ("zlib", r"zlib\.net/zlib_license", "zlib.net"),
    ("openssl", r"openssl\.org/source/license", "openssl.org"),
    ("postgresql", r"postgresql\.org/about/licen[sc]e", "postgresql.org"),
    ("odbl-1.0", r"opendatacommons\.org/licenses/odbl", "opendatacommons"),
    ("odc-by-1.0", r"opendatacommons\.org/licenses/by", "opendatacommons"),
    ("pddl-1.0", r"opendatacommons\.org/licenses/pddl", "opendatacommons"),
    ("cddl-1.0", r"(?:opensource\.org/licenses/cddl|glassfish\.dev\.java\.net/public/cddl)", "cddl"),
    ("artistic-2.0", r"(?:perlfoundation|dev\.perl)\.org/(?:artistic_license_2_0|artistic-license-20)", "perl"),
    ("json", r"json\.org/license", "json.org"),
    ("elastic-2.0", r"elastic\.co/licensing/elastic-license", "elastic.co"),
    ("sspl-1.0", r"mongodb\.com/licensing/server-side-public-license", "mongodb.com"),
    ("busl-1.1", r"mariadb\.com/bsl11", "mariadb.com"),
    ("ijg", r"ijg\.org", "ijg.org"),
    ("mulanpsl-2.0", r"license\.coscl\.org\.cn/mulanpsl2", "coscl"),
    ("cecill-2.1", r"cecill\.info/licences", "cecill.info"),
    ("eupl-1.2", r"joinup\.ec\.europa\.eu/[\w/-]*eupl", "europa.eu"),
]
# Short names as people write them: (label, pattern, keywords).
SHORT = [
    ("gpl-1.0", r"(?:gnu )?gpl[- ]?(?:version |v\.? ?)?1(?:\.0)?", ["gpl"]),
    ("gpl-2.0", r"(?:gnu )?gpl[- ,]{0,2}(?:version |v\.? ?)?2(?:\.0)?", ["gpl"]),
    ("gpl-2.0-or-later", r"(?:gnu )?gpl[- ,]{0,2}(?:version |v\.? ?)?2(?:\.0)?(?:\+|[- ,]{0,2}or (?:any )?later)", ["gpl"]),
    ("gpl-2.0-only", r"(?:gnu )?gpl[- ,]{0,2}(?:version |v\.? ?)?2(?:\.0)?[- ,]{0,2}only", ["gpl"]),
    ("gpl-3.0", r"(?:gnu )?gpl[- ,]{0,2}(?:version |v\.? ?)?3(?:\.0)?", ["gpl"]),
    ("gpl-3.0-or-later", r"(?:gnu )?gpl[- ,]{0,2}(?:version |v\.? ?)?3(?:\.0)?(?:\+|[- ,]{0,2}or (?:any )?later)", ["gpl"]),
    ("gpl-3.0-only", r"(?:gnu )?gpl[- ,]{0,2}(?:version |v\.? ?)?3(?:\.0)?[- ,]{0,2}only", ["gpl"]),
    ("lgpl-2.0", r"(?:gnu )?lgpl[- ,]{0,2}(?:version |v\.? ?)?2(?:\.0)?(?!\.1)", ["lgpl"]),
    ("lgpl-2.1", r"(?:gnu )?lgpl[- ,]{0,2}(?:version |v\.? ?)?2\.1", ["lgpl"]),
    ("lgpl-2.1-or-later", r"(?:gnu )?lgpl[- ,]{0,2}(?:version |v\.? ?)?2\.1(?:\+|[- ,]{0,2}or (?:any )?later)", ["lgpl"]),
    ("lgpl-3.0", r"(?:gnu )?lgpl[- ,]{0,2}(?:version |v\.? ?)?3(?:\.0)?", ["lgpl"]),
    ("lgpl-3.0-or-later", r"(?:gnu )?lgpl[- ,]{0,2}(?:version |v\.? ?)?3(?:\.0)?(?:\+|[- ,]{0,2}or (?:any )?later)", ["lgpl"]),
    ("agpl-3.0", r"(?:gnu )?agpl[- ,]{0,2}(?:version |v\.? ?)?3(?:\.0)?", ["agpl"]),
    ("agpl-3.0-or-later", r"(?:gnu )?agpl[- ,]{0,2}(?:version |v\.? ?)?3(?:\.0)?(?:\+|[- ,]{0,2}or (?:any )?later)", ["agpl"]),
    ("gpl", r"(?:(?:under|by) (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl|gnu gpl|gpl[- ]licen[sc]ed?|gpl licen[sc]e)", ["gpl"]),
    ("lgpl", r"(?:(?:under|by) (?:the )?(?:terms of )?(?:the )?(?:gnu )?lgpl|gnu lgpl|lgpl[- ]licen[sc]ed?|lgpl licen[sc]e)", ["lgpl"]),
    ("agpl-3.0", r"(?:under (?:the )?(?:terms of )?(?:the )?(?:gnu )?agpl|gnu agpl|agpl[- ]licen[sc]ed?|agpl licen[sc]e)", ["agpl"]),
    ("gfdl-1.3", r"(?:gnu (?:fdl|gfdl)|under the gfdl)", ["fdl"]),
    ("mit", r"(?:mit[- ]licen[sc]ed|(?:released|available|licen[sc]ed|distributed|published) under (?:the )?(?:terms of )?(?:the )?mit)", ["mit"]),
    ("apache-2.0", r"apache[- ]2(?:\.0)?(?: licen[sc]ed?)?", ["apache"]),
    ("apache-2.0", r"(?:asl|al)[- ]?2\.0", ["asl|al"]),
    ("apache-2.0", r"(?:released|available|licen[sc]ed|distributed) under (?:the )?apache v\.? ?2(?:\.0)?", ["apache"]),
    ("bsd", r"bsd[- ](?:style )?licen[sc]ed?", ["bsd"]),
    ("bsd", r"(?:released|available|licen[sc]ed|distributed) under (?:the )?(?:terms of )?(?:the )?bsd", ["bsd"]),
    ("bsd-2-clause", r"bsd[- ]2(?![\w.])", ["bsd"]),
    ("bsd-3-clause", r"bsd[- ]3(?![\w.])", ["bsd"]),
    ("mpl-2.0", r"mpl[- ]?(?:version |v\.? ?)?2(?:\.0)?", ["mpl"]),
    ("mpl-1.1", r"mpl[- ]?(?:version |v\.? ?)?1\.1", ["mpl"]),
    ("epl-1.0", r"epl[- ]?(?:version |v\.? ?)?1\.0", ["epl"]),
    ("epl-2.0", r"epl[- ]?(?:version |v\.? ?)?2\.0", ["epl"]),
    ("eupl-1.2", r"eupl[- ]?(?:version |v\.? ?)?1\.2", ["eupl"]),
    ("cddl-1.0", r"cddl(?:[- ]?(?:version |v\.? ?)?1\.[01])?", ["cddl"]),
    ("bsl-1.0", r"bsl[- ]1\.0", ["bsl"]),
    ("ofl-1.1", r"(?:sil )?ofl[- ]?(?:version |v\.? ?)?1\.1", ["ofl"]),
    ("odbl-1.0", r"odbl(?:[- ]?(?:v\.? ?)?1\.0)?", ["odbl"]),
    ("pddl-1.0", r"pddl(?:[- ]?(?:v\.? ?)?1\.0)?", ["pddl"]),
    ("ms-pl", r"ms-pl", ["ms-pl"]),
    ("python-2.0", r"psfl?[- ](?:licen[sc]ed?|2\.0)", ["psf"]),
    ("artistic-2.0", r"artistic[- ]2\.0", ["artistic"]),
    ("sspl-1.0", r"sspl(?:[- ]?(?:v\.? ?)?1(?:\.0)?)?", ["sspl"]),
    ("busl-1.1", r"busl[- ]1\.1", ["busl"]),
    ("cc0-1.0", r"cc[- ]zero", ["cc-zero|cc zero"]),
    ("public-domain", r"public[- ]domain (?:software|work|dedication|mark)", ["domain"]),
]
# What an SPDX line may name besides the families and Creative Commons variants.
SPDX_MORE = ["lgpl-2.0", "agpl-1.0", "gfdl-1.1", "gfdl-1.2", "cc0-1.0", "bsd-1-clause", "epl-1.0", "apache-1.0", "mpl-1.0", "cddl-1.1", "hpnd", "blueoak-1.0.0", "bsd-3-clause-clear", "etalab-2.0", "unicode-3.0"]
SPDX_LINE = r"spdx-license-identifier:\s*(?P<expression>\(*[a-z0-9][\w.+-]*\)*(?:\s+(?:and|or|with)\s+\(*[a-z0-9][\w.+-]*\)*)*)"

# Nothing is scanned in a text without one of these.
GATE = (
    "gnu.org", "mozilla.org", "boost.org", "wtfpl.net", "ijg.org", "coscl", "mariadb.com", "apache", "agpl", "mpl", "epl", "cddl", "ofl",
    "odbl", "pddl", "ms-pl", "psf", "sspl", "busl", "bsl-", "bsl ", "asl", "al-2", "al 2", "mit", "artistic", "cc-zero", "cc zero",
    "any later version", "permission notice", "holders be liable", "advertising", "warrant", "endorse or promote", "written agreement",
    "whatever you want", "plainly marked", "anyone is free", "extent possible under law", "jpeg", "copies of vim", "complete source code",
    "patent claim", "deal with the software", "fee or royalty", "managed service", "intent of this document", "unauthori", "confidential",
    "freetype", "accompanying documentation", "hope that it will be useful", "fdl",
    "licen", "copyright", "spdx", "creative commons", "creativecommons", "cc-by", "cc by", "cc0", "gpl", "public domain",
    "rights reserved", "redistribut", "hereby granted", "unencumbered", "openrail", "wtfpl", "bsd", "and/or distribute",
    "nasa open", "jpeg group", "no attribution", "general public", "open data commons", "proprietary", "may not be",
    "cecill", "not evil",
)


def build_rules() -> list[tuple[int, str, int, float, tuple[str, ...], str]]:
    """All rules as (number, label, priority, score, keywords, pattern), in order of precedence.

    A keyword may list alternatives with ``|``; one of them must occur. Tags
    outrank qualified names, which outrank plain names and phrases of the body.
    """
    rules = []
    for label, names, keyword, tag in FAMILIES:
        keyword = {"gpl": "gpl|general public"}.get(keyword, keyword)
        exact = re.escape(tag)
        rules.append((label, 90, 1.0, ("spdx",), rf"spdx-license-identifier:\s*{exact}(?![\w.-])"))
        for name in names:
            rules.append((label, 80, 0.95, (keyword, "licen"), rf"\blicen[sc]ed under (?:the )?(?:terms of )?(?:the )?{name}"))
            rules.append((label, 60, 0.8, (keyword,), rf"(?<!\w){name}(?!\w)"))
    for parts, words in CC_PARTS.items():
        rules.append((f"cc-{parts}", 55, 0.75, ("creative commons",), rf"creative commons {words}(?:[- ]\d\.\d)?(?: international| unported)?(?: licen[sc]e)?"))
        for version in CC_VERSIONS:
            number, label = re.escape(version), f"cc-{parts}-{version}"
            rules.append((label, 90, 1.0, ("spdx",), rf"spdx-license-identifier:\s*cc-{parts}-{number}(?![\w.-])"))
            rules.append((label, 85, 0.95, ("creativecommons",), rf"creativecommons\.org/licenses/{parts}/{number}"))
            rules.append((label, 80, 0.95, ("cc", version), rf"\bcc[- ]{parts}[- ]{number}(?!\w)"))
            rules.append((label, 75, 0.9, ("creative commons", version), rf"creative commons {words} {number}(?: international| unported| generic)?(?: licen[sc]e)?"))
    for label, pattern, keywords in BODIES:
        plain = label in ("gpl", "lgpl", "licensed-unknown", "proprietary")
        rules.append((label, 20 if plain else 50, 0.5 if plain else 0.85, tuple(keywords), pattern))
    for label, pattern, keywords in SENTENCES:
        weak = label in ("gpl", "lgpl", "proprietary")
        rules.append((label, 45 if weak else 65, 0.7 if weak else 0.9, tuple(keywords), pattern))
    for label, pattern, keyword in ADDRESSES:
        rules.append((label, 70, 0.9, (keyword,), rf"(?:https?://)?(?:www\.)?{pattern}"))
    for site in (r"opensource\.org/licen[sc]es?", r"spdx\.org/licenses", r"choosealicense\.com/licenses"):
        for label, _, _, tag in FAMILIES:
            rules.append((label, 70, 0.9, (site.split("\\")[0],), rf"{site}/{re.escape(tag)}(?:\.html|\.php)?(?![\w.-]*\w)"))
    for label, pattern, keywords in SHORT:
        # behind longer names of the same licence, and the versioned before the plain
        versioned = any(c.isdigit() for c in label) or label in ("mit", "bsd")
        priority = 62 if label.endswith(("-only", "-or-later")) else 58 if versioned else 40
        rules.append((label, priority, 0.75 if versioned else 0.6, tuple(keywords), rf"(?<![\w-]){pattern}(?!\w)(?![.-]\w)"))
    ordered = sorted(enumerate(rules), key=lambda r: (-r[1][1], r[0]))
    return [(i, *rule) for i, (_, rule) in enumerate(ordered)]


# Lines, what comments may begin them with, and their words with single blanks between.
LINE = re.compile(r"[^\n\r\v\f\x85\u2028\u2029]+")
LEADERS = re.compile(
    r"\s*+(?:(?://[/!]*+|/\*++!?|\*++/?|#++!?|;++|--++>?|%++|<!--++|>++|\|++|!++|::|\.?\\\"|'|(?:rem|dnl|c)(?=\s|$))\s*+)*+"
)
SEGMENT = re.compile(r"\S++(?: \S++)*+")
ITEM = re.compile(r"\d+[.)](?:\s|$)")
CLOSERS = ("*/", "-->")
MARKS = frozenset("*#|/;%-=+!")


def _end_of_line(text: str, start: int, end: int) -> int:
    """End of the line's words: without the close of a comment or a last word of marks alone."""
    line = text[start:end].rstrip()
    for closer in CLOSERS:
        if line.endswith(closer):
            return start + len(line[: -len(closer)].rstrip("*- \t"))
    last = line[max(line.rfind(" "), line.rfind("\t")) + 1 :]
    return start + len(line) - (len(last) if last and MARKS.issuperset(last) else 0)


def flattened(text: str) -> tuple[str, list[int], list[int]]:
    """The text with one blank between words, and where its segments begin in this copy and in ``text``."""
    parts, here, there, size, line_end = [], [], [], 0, 0
    for line in LINE.finditer(text):
        start = LEADERS.match(text, line.start(), line.end()).end()
        end = _end_of_line(text, start, line.end())
        first = True
        for m in SEGMENT.finditer(text, start, end):
            if parts:
                apart = first and ITEM.match(text, m.start(), end) and _empty_line(text, line_end, m.start())
                parts.append("\n" if apart else " ")
                size += 1
            first = False
            parts.append(m.group())
            here.append(size)
            there.append(m.start())
            size += m.end() - m.start()
            line_end = m.end()
    return "".join(parts), here, there


def _empty_line(text: str, start: int, end: int) -> bool:
    return text.count("\n", start, end) > 1


#: Number of the rule that reads SPDX expressions; it comes before all others.
SPDX_RULE = -1
_SPDX = re.compile(SPDX_LINE)
_SPDX_NAMES = {tag for *_, tag in FAMILIES} | {f"cc-{p}-{v}" for p in CC_PARTS for v in CC_VERSIONS} | set(SPDX_MORE)


def spdx_labels(text: str) -> list[tuple[int, int, str]]:
    """(start, end, label) of each licence that an SPDX line names, however they are combined.

    ``+`` is the older form of ``-or-later``; what follows ``with`` is an exception, not a licence.
    """
    found = []
    for line in _SPDX.finditer(text):
        begin, excepted = line.start("expression"), False
        for m in re.finditer(r"[a-z0-9][\w.+-]*", line["expression"]):
            word = m.group()
            if word in ("and", "or", "with"):
                excepted = word == "with"
                continue
            if not excepted:
                name = word[:-1] + "-or-later" if word.endswith("+") else word
                plain = re.sub(r"-(?:only|or-later)$", "", name)
                label = name if plain in _SPDX_NAMES else "licenseref" if name.startswith("licenseref-") else "spdx-other"
                start = line.start() if not found or found[-1][1] <= line.start() else begin + m.start()
                found.append((start, begin + m.end(), label))
            excepted = False
    return found


def detections(text: str, rules: list) -> list[tuple[int, int, int, str, int, float]]:
    """All matches of the rules whose keywords occur, as (start, end, rule, label, priority, score); ``text`` in lower case."""
    text, here, there = flattened(text)
    if not any(word in text for word in GATE):
        return []

    def place(at: int) -> int:
        segment = bisect.bisect_right(here, at) - 1
        return there[segment] + at - here[segment]

    seen: dict[str, bool] = {}

    def occurs(keyword: str) -> bool:
        if keyword not in seen:
            seen[keyword] = any(part in text for part in keyword.split("|"))
        return seen[keyword]

    found = [
        (place(a), place(b - 1) + 1, SPDX_RULE, label, 95, 1.0)
        for a, b, label in (spdx_labels(text) if "spdx-license-identifier" in text else ())
    ]
    return found + [
        (place(m.start()), place(m.end() - 1) + 1, number, label, priority, score)
        for number, label, priority, score, keywords, pattern in rules
        if all(map(occurs, keywords))
        for m in re.finditer(pattern, text)
        if m.end() > m.start()
    ]


def resolve(found: list) -> list:
    """Detections left after suppression, by start.

    Taken by priority, then length, then place, then rule: one that lies inside a
    kept detection, or overlaps it in part, goes. The kept ones never overlap.
    """
    kept: list = []
    for d in sorted(found, key=lambda d: (-d[4], d[0] - d[1], d[0], d[2])):
        at = bisect.bisect_left(kept, d)
        before = at and kept[at - 1][1] > d[0]
        after = at < len(kept) and kept[at][0] < d[1]
        if not before and not after:
            kept.insert(at, d)
    return kept


def phrase_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(start word, label) of every fixed phrase."""
    places = []
    start = 0
    while True:
        try:
            at = words.index(b"license", start)
        except ValueError:
            return sorted(places)
        for phrase, label in PHRASES.items():
            first = at - len(phrase) + 1
            if first >= 0 and tuple(words[first : at + 1]) == tuple(w.encode() for w in phrase):
                places.append((first, label))
        start = at + 1


SCAN_SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<start: int, end: int, label: string, rule: int>>"
)


def scan_text(text: str | None, rules: list) -> tuple:
    """The values of ``SCAN_SCHEMA`` for one text; spans are character offsets."""
    words = alnum_words(text)
    low = text.encode().lower() if text else b""
    places = phrase_places(words) if b"license" in low else []
    kept = resolve(detections(low.decode(), rules))
    base = sorted({label for _, label in places})
    labels = sorted({*base, *(d[3] for d in kept if d[3] != "licensed-unknown" or len(kept) == 1)})
    score = max([d[5] for d in kept] + [0.8 * bool(places)], default=0.0)
    return (
        len(words), len(places),
        places[0][0] if places else None, places[-1][0] if places else None,
        ",".join(base), ",".join(labels), score,
        [{"start": d[0], "end": d[1], "label": d[3], "rule": d[2]} for d in kept],
    )


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and the columns of ``SCAN_SCHEMA``."""
    import pyarrow as pa

    rules = build_rules()
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {id_type}, {SCAN_SCHEMA}"

    def scan(batches):
        span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("rule", pa.int32())])
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]
        compiled = [(*rule[:5], re.compile(rule[5])) for rule in rules]
        for batch in batches:
            rows = [scan_text(t, compiled) for t in batch.column(1).to_pylist()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            names = [c.split()[0] for c in SCAN_SCHEMA.split(", ")[:7]] + ["spans"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, *names])

    return docs.select(id_col, text_col).mapInArrow(scan, schema)
