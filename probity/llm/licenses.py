"""License scans by ordered signature rules.

A text becomes its words (A-Z lower-cased, letters, digits and everything outside ASCII), joined by spaces. One automaton over
the rules' keywords finds which are present; only rules whose keyword is are run. A detection that lies inside one of a rule of
the same or a higher priority is suppressed; what is left gives the labels. The four base phrases count by themselves and
always keep their labels.

Defined cases: a null text counts as empty and has no words and no labels; repeated rows are scanned each; null ids are kept;
texts of any length are scanned whole; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from probity.llm.common import slices, table

BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Label, keyword that must be present, pattern of the license's name over words joined by spaces.
NAMES = (
    ("agpl-3.0", "affero", r"gnu affero (?:general )?public licen[cs]e(?: (?:agpl|v|version))*(?: 3(?: 0)?)?"),
    ("agpl-3.0", "agpl", r"agpl ?v?3?(?: 0)?"),
    ("gpl-1.0", "public licen", r"(?:gnu )?general public licen[cs]e (?:gpl )?(?:v ?|version )1(?: 0)?"),
    ("gpl-2.0", "public licen", r"(?:gnu )?general public licen[cs]e (?:gpl )?(?:v ?|version )2(?: 0)?"),
    ("gpl-3.0", "public licen", r"(?:gnu )?general public licen[cs]e (?:gpl )?(?:v ?|version )3(?: 0)?"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl ?(?:v ?|version )?2(?: 0)?"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl ?(?:v ?|version )?3(?: 0)?"),
    ("gpl", "gpl", r"(?:gnu )?gpl licen[cs]e"),
    ("gpl", "gnu general public", r"gnu general public licen[cs]e"),
    ("lgpl-2.0", "library general public", r"gnu library general public licen[cs]e(?: (?:v ?|version )?2(?: 0)?)?"),
    ("lgpl-2.1", "lesser general public", r"(?:gnu )?lesser general public licen[cs]e (?:v ?|version )?2(?: 1)?"),
    ("lgpl-3.0", "lesser general public", r"(?:gnu )?lesser general public licen[cs]e (?:v ?|version )?3(?: 0)?"),
    ("lgpl", "lesser general public", r"(?:gnu )?lesser general public licen[cs]e"),
    ("lgpl-2.1", "lgpl", r"lgpl ?(?:v ?|version )?2(?: 1)?"),
    ("lgpl-3.0", "lgpl", r"lgpl ?(?:v ?|version )?3(?: 0)?"),
    ("gfdl-1.2", "free documentation", r"gnu free documentation licen[cs]e (?:v ?|version )?1 2"),
    ("gfdl-1.3", "free documentation", r"gnu free documentation licen[cs]e (?:v ?|version )?1 3"),
    ("gfdl", "free documentation", r"gnu free documentation licen[cs]e"),
    ("apache-1.0", "apache", r"apache (?:software )?licen[cs]e (?:v ?|version )?1 0"),
    ("apache-1.1", "apache", r"apache (?:software )?licen[cs]e (?:v ?|version )?1 1"),
    ("apache-2.0", "apache", r"apache (?:software )?licen[cs]e (?:v ?|version )?2(?: 0)?"),
    ("apache-2.0", "apache", r"apache 2(?: 0)?(?: licen[cs]e)?"),
    ("apache", "apache", r"apache (?:software )?licen[cs]e"),
    ("mit", "mit licen", r"mit licen[cs]e"),
    ("mit", "expat", r"expat licen[cs]e"),
    ("mit-0", "no attribution", r"mit no attribution(?: licen[cs]e)?"),
    ("x11", "x11", r"(?:mit )?x11 licen[cs]e"),
    ("bsd-4-clause", "bsd", r"(?:4 clause|four clause|original) bsd(?: licen[cs]e)?|bsd 4 clause(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd", r"(?:3 clause|three clause|new|modified|revised) bsd(?: licen[cs]e)?|bsd 3 clause(?: licen[cs]e)?"),
    ("bsd-2-clause", "bsd", r"(?:2 clause|two clause|simplified|free) bsd(?: licen[cs]e)?|bsd 2 clause(?: licen[cs]e)?"),
    ("0bsd", "bsd", r"(?:zero clause|0 clause) bsd(?: licen[cs]e)?|bsd zero clause(?: licen[cs]e)?"),
    ("bsd", "bsd", r"bsd (?:style )?licen[cs]e"),
    ("isc", "isc licen", r"isc licen[cs]e"),
    ("mpl-1.0", "mozilla", r"mozilla public licen[cs]e (?:v ?|version )?1 0"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e (?:v ?|version )?1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e (?:v ?|version )?2(?: 0)?"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e"),
    ("epl-1.0", "eclipse", r"eclipse public licen[cs]e (?:v ?|version )?1(?: 0)?"),
    ("epl-2.0", "eclipse", r"eclipse public licen[cs]e (?:v ?|version )?2(?: 0)?"),
    ("epl", "eclipse", r"eclipse public licen[cs]e"),
    ("edl-1.0", "eclipse", r"eclipse distribution licen[cs]e(?: (?:v ?|version )?1(?: 0)?)?"),
    ("cddl-1.0", "common development", r"common development and distribution licen[cs]e(?: (?:v ?|version )?1 0)?"),
    ("cddl-1.1", "common development", r"common development and distribution licen[cs]e (?:v ?|version )?1 1"),
    ("cpl-1.0", "common public", r"common public licen[cs]e(?: (?:v ?|version )?1 0)?"),
    ("ipl-1.0", "ibm public", r"ibm public licen[cs]e(?: (?:v ?|version )?1 0)?"),
    ("artistic-1.0", "artistic", r"artistic licen[cs]e (?:v ?|version )?1(?: 0)?"),
    ("artistic-2.0", "artistic", r"artistic licen[cs]e (?:v ?|version )?2(?: 0)?"),
    ("artistic", "artistic", r"artistic licen[cs]e"),
    ("bsl-1.0", "boost", r"boost software licen[cs]e(?: (?:v ?|version )?1(?: 0)?)?"),
    ("busl-1.1", "business source", r"business source licen[cs]e(?: (?:v ?|version )?1 1)?"),
    ("sspl-1.0", "server side public", r"server side public licen[cs]e(?: (?:v ?|version )?1)?"),
    ("elastic-2.0", "elastic", r"elastic licen[cs]e(?: (?:v ?|version )?2(?: 0)?)?"),
    ("eupl-1.1", "european union", r"european union public licen[cs]e (?:v ?|version )?1 1"),
    ("eupl-1.2", "european union", r"european union public licen[cs]e(?: (?:v ?|version )?1 2)?"),
    ("cecill-2.1", "cecill", r"cecill(?: free software)?(?: licen[cs]e)?(?: agreement)?(?: (?:v ?|version )?2 1)?"),
    ("osl-3.0", "open software", r"open software licen[cs]e(?: (?:v ?|version )?3(?: 0)?)?"),
    ("afl-3.0", "academic free", r"academic free licen[cs]e(?: (?:v ?|version )?3(?: 0)?)?"),
    ("apsl-2.0", "apple public", r"apple public source licen[cs]e(?: (?:v ?|version )?2(?: 0)?)?"),
    ("ms-pl", "microsoft public", r"microsoft public licen[cs]e"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[cs]e"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e"),
    ("libpng", "libpng", r"libpng licen[cs]e"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("wtfpl", "what the fuck", r"do what the fuck you want to public licen[cs]e"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa (?:open source )?licen[cs]e"),
    ("psf-2.0", "python software", r"python software foundation licen[cs]e(?: (?:v ?|version )?2)?"),
    ("python-2.0", "python licen", r"python licen[cs]e(?: 2(?: 0)?)?"),
    ("php-3.01", "php licen", r"php licen[cs]e(?: (?:v ?|version )?3 01)?"),
    ("ruby", "ruby licen", r"ruby licen[cs]e"),
    ("perl", "perl", r"same terms as perl(?: itself)?"),
    ("postgresql", "postgresql licen", r"postgresql licen[cs]e"),
    ("openssl", "openssl licen", r"openssl licen[cs]e"),
    ("curl", "curl licen", r"curl licen[cs]e"),
    ("vim", "vim licen", r"vim licen[cs]e"),
    ("zpl-2.1", "zope", r"zope public licen[cs]e(?: (?:v ?|version )?2 1)?"),
    ("w3c", "w3c", r"w3c (?:software )?(?:notice and )?licen[cs]e"),
    ("ofl-1.1", "open font", r"(?:sil )?open font licen[cs]e(?: (?:v ?|version )?1 1)?"),
    ("ubuntu-font", "ubuntu font", r"ubuntu font licen[cs]e"),
    ("upl-1.0", "universal permissive", r"universal permissive licen[cs]e(?: (?:v ?|version )?1(?: 0)?)?"),
    ("blueoak-1.0.0", "blue oak", r"blue oak model licen[cs]e"),
    ("mulan-psl-2.0", "mulan", r"mulan permissive software licen[cs]e(?: (?:v ?|version )?2)?"),
    ("odbl-1.0", "database licen", r"open (?:data commons )?(?:open )?database licen[cs]e"),
    ("odc-by-1.0", "open data commons", r"open data commons attribution licen[cs]e"),
    ("pddl-1.0", "open data commons", r"open data commons public domain dedication(?: and licen[cs]e)?"),
    ("ogl-uk-3.0", "open government", r"open government licen[cs]e(?: (?:v ?|version )?3(?: 0)?)?"),
    ("etalab-2.0", "licence ouverte", r"licence ouverte(?: etalab)?"),
    ("etalab-2.0", "etalab", r"etalab 2 0"),
    ("cdla-permissive-2.0", "community data", r"community data licen[cs]e agreement permissive"),
    ("cdla-sharing-1.0", "community data", r"community data licen[cs]e agreement sharing"),
    ("openrail", "rail", r"(?:creativeml |bigscience |bigcode )?open ?rail(?: m)?(?: licen[cs]e)?"),
    ("rail", "responsible ai", r"responsible ai licen[cs]e"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc0-1.0", "creative commons", r"creative commons (?:zero|cc0)(?: 1 0)?(?: universal)?"),
    ("cc-pdm-1.0", "public domain mark", r"public domain mark(?: 1 0)?"),
    ("cc-by-nc-nd-4.0", "cc by", r"cc by nc nd 4 0"), ("cc-by-nc-nd-3.0", "cc by", r"cc by nc nd 3 0"), ("cc-by-nc-nd", "cc by", r"cc by nc nd"),
    ("cc-by-nc-sa-4.0", "cc by", r"cc by nc sa 4 0"), ("cc-by-nc-sa-3.0", "cc by", r"cc by nc sa 3 0"), ("cc-by-nc-sa", "cc by", r"cc by nc sa"),
    ("cc-by-nc-4.0", "cc by", r"cc by nc 4 0"), ("cc-by-nc-3.0", "cc by", r"cc by nc 3 0"), ("cc-by-nc-2.0", "cc by", r"cc by nc 2 0"), ("cc-by-nc", "cc by", r"cc by nc"),
    ("cc-by-nd-4.0", "cc by", r"cc by nd 4 0"), ("cc-by-nd-3.0", "cc by", r"cc by nd 3 0"), ("cc-by-nd", "cc by", r"cc by nd"),
    ("cc-by-sa-4.0", "cc by", r"cc by sa 4 0"), ("cc-by-sa-3.0", "cc by", r"cc by sa 3 0"), ("cc-by-sa-2.0", "cc by", r"cc by sa 2 0"), ("cc-by-sa", "cc by", r"cc by sa"),
    ("cc-by-4.0", "cc by", r"cc by 4 0"), ("cc-by-3.0", "cc by", r"cc by 3 0"), ("cc-by-2.0", "cc by", r"cc by 2 0"), ("cc-by", "cc by", r"cc by"),
    ("cc-by-nc-nd", "creative commons", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?"),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial(?: [1-4] [05])?"),
    ("cc-by-nd", "creative commons", r"creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?"),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike(?: [1-4] [05])?"),
    ("cc-by", "creative commons", r"creative commons attribution(?: [1-4] [05])?"),
)
#: Label, keyword, priority, pattern: sentences of license texts and notices.
TEXTS = (
    ("mit", "permission is hereby granted", 80, r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsl-1.0", "permission is hereby granted", 85, r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("isc", "permission to use copy modify", 80, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", 60, r"redistributions? and use in source and binary forms"),
    ("bsd-3-clause", "neither the name", 75, r"neither the name of .{1,200}? nor the names of its contributors may be used to endorse"),
    ("bsd-4-clause", "all advertising materials", 75, r"all advertising materials mentioning features or use of this software"),
    ("gpl", "this program is free software", 70, r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("lgpl", "this library is free software", 70, r"this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e"),
    ("gpl-2.0-or-later", "either version 2", 95, r"either version 2 of the licen[cs]e or (?:at your option )?any later version"),
    ("gpl-3.0-or-later", "either version 3", 95, r"either version 3 of the licen[cs]e or (?:at your option )?any later version"),
    ("apache-2.0", "you may not use this file", 80, r"you may not use this file except in compliance with the licen[cs]e"),
    ("apache-2.0", "apache org", 90, r"apache org licenses licen[cs]e 2 0"),
    ("mpl-2.0", "this source code form", 85, r"this source code form is subject to the terms of the mozilla public licen[cs]e(?: v 2 0)?"),
    ("unlicense", "free and unencumbered", 85, r"this is free and unencumbered software released into the public domain"),
    ("zlib", "as is without any express", 60, r"this software is provided as is without any express or implied warranty"),
    ("wtfpl", "you just do what", 80, r"you just do what the fuck you want to"),
    ("public-domain", "public domain", 50, r"(?:in|into|to) the public domain"),
    ("public-domain", "public domain", 55, r"dedicated? to the public domain"),
    ("all-rights-reserved", "all rights reserved", 40, r"all rights reserved"),
    ("all-rights-reserved", "tous droits", 40, r"tous droits réservés"),
    ("all-rights-reserved", "alle rechte", 40, r"alle rechte vorbehalten"),
    ("all-rights-reserved", "todos los derechos", 40, r"todos los derechos reservados"),
    ("copyright-notice", "copyright", 30, r"copyright (?:c |© )?(?:19|20)[0-9]{2}"),
    ("copyright-notice", "©", 30, r"© ?(?:19|20)[0-9]{2}"),
    ("proprietary", "proprietary", 45, r"proprietary and confidential"),
    ("proprietary", "unauthorized", 45, r"unauthorized (?:copying|use|distribution|reproduction) of this (?:file|software|work|document)"),
    ("non-commercial", "non commercial", 35, r"(?:for )?non commercial (?:use|purposes) only"),
    ("research-only", "research", 35, r"(?:for )?(?:academic |scientific )?research (?:use|purposes) only"),
    ("evaluation-only", "evaluation", 35, r"for evaluation purposes only"),
    ("eula", "end user licen", 45, r"end user licen[cs]e agreement"),
    ("commercial", "commercial licen", 35, r"commercial licen[cs]e"),
    ("permission", "with permission", 20, r"(?:used|reprinted|reproduced) with permission"),
    ("mit", "without limitation the rights", 78, r"without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("mit", "substantial portions", 65, r"shall be included in all copies or substantial portions of the software"),
    ("mit", "in no event shall the authors", 60, r"in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("isc", "copyright notice and this permission notice", 72, r"provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "author disclaims all warranties", 62, r"the author disclaims all warranties with regard to this software"),
    ("bsd", "must retain the above copyright", 58, r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "must reproduce the above copyright", 58, r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "and contributors as is", 57, r"this software is provided by the (?:copyright holders|regents) and contributors as is"),
    ("bsd-4-clause", "this product includes software", 68, r"this product includes software developed by"),
    ("apache-2.0", "apache org", 82, r"(?:https? )?(?:www )?apache org licenses"),
    ("apache-2.0", "distributed on an as is basis", 76, r"software distributed under the licen[cs]e is distributed on an as is basis without warranties or conditions of any kind"),
    ("apache-2.0", "apache software foundation", 79, r"licen[cs]ed to the apache software foundation asf under one or more contributor licen[cs]e agreements"),
    ("apache", "apache software foundation", 61, r"this product includes software developed (?:by|at) the apache software foundation"),
    ("gpl", "gnu org", 64, r"gnu org licenses gpl"),
    ("lgpl", "gnu org", 66, r"gnu org licenses lgpl"),
    ("agpl-3.0", "gnu org", 67, r"gnu org licenses agpl"),
    ("gpl", "free software foundation", 56, r"as published by the free software foundation"),
    ("gpl", "you should have received a copy", 63, r"you should have received a copy of the gnu general public licen[cs]e"),
    ("lgpl", "you should have received a copy", 71, r"you should have received a copy of the gnu lesser general public licen[cs]e"),
    ("agpl-3.0", "you should have received a copy", 73, r"you should have received a copy of the gnu affero general public licen[cs]e"),
    ("gpl-2.0", "version 2 only", 92, r"gnu general public licen[cs]e version 2 only"),
    ("gpl-2.0", "version 2 as published", 91, r"gnu general public licen[cs]e version 2 as published by the free software foundation"),
    ("gpl-3.0", "version 3 as published", 91, r"gnu general public licen[cs]e version 3 as published by the free software foundation"),
    ("gpl-with-classpath-exception", "classpath exception", 93, r"classpath exception"),
    ("gpl-with-linking-exception", "linking exception", 93, r"(?:static )?linking exception"),
    ("gpl-with-runtime-exception", "runtime library exception", 93, r"gcc runtime library exception"),
    ("lgpl", "this library is distributed in the hope", 59, r"this library is distributed in the hope that it will be useful"),
    ("gpl", "distributed in the hope", 54, r"this program is distributed in the hope that it will be useful but without any warranty"),
    ("agpl-3.0", "through a computer network", 74, r"users interacting with it remotely through a computer network"),
    ("mpl-2.0", "mozilla org mpl", 84, r"mozilla org mpl 2 0"),
    ("mpl-1.1", "subject to the mozilla", 86, r"the contents of this file are subject to the mozilla public licen[cs]e version 1 1"),
    ("mpl", "incompatible with secondary", 50, r"incompatible with secondary licenses as defined by the mozilla public licen[cs]e"),
    ("epl-2.0", "eclipse org legal", 85, r"eclipse org legal epl 2 0"),
    ("epl-1.0", "eclipse org legal", 85, r"eclipse org legal epl v10"),
    ("cddl-1.0", "common development", 74, r"subject to the terms of the common development and distribution licen[cs]e"),
    ("cddl", "cddl", 60, r"cddl(?: v ?1(?: [01])?)?"),
    ("bsl-1.0", "boost org license", 84, r"boost org license 1 0(?: txt)?"),
    ("unlicense", "unlicense org", 82, r"unlicense org"),
    ("unlicense", "relinquishment in perpetuity", 80, r"an overt act of relinquishment in perpetuity of all present and future rights"),
    ("wtfpl", "everyone is permitted", 70, r"everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document"),
    ("gpl", "everyone is permitted", 52, r"everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document but changing it is not allowed"),
    ("zlib", "altered source versions", 70, r"altered source versions must be plainly marked as such"),
    ("zlib", "origin of this software", 70, r"the origin of this software must not be misrepresented"),
    ("ofl-1.1", "scripts sil org", 80, r"scripts sil org ofl"),
    ("ofl-1.1", "reserved font name", 78, r"with reserved font names?"),
    ("psf-2.0", "python software foundation", 66, r"python software foundation all rights reserved"),
    ("artistic", "freely available means", 52, r"freely available means that no fee is charged for the item itself"),
    ("ncsa", "to deal with the software", 64, r"permission is hereby granted .{1,80}? to deal with the software without restriction"),
    ("postgresql", "without a written agreement", 74, r"for any purpose without fee and without a written agreement is hereby granted"),
    ("openssl", "openssl project", 76, r"this product includes software developed by the openssl project"),
    ("ssleay", "cryptsoft", 76, r"this product includes cryptographic software written by eric young"),
    ("curl", "used in advertising", 48, r"shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
    ("json", "for good not evil", 88, r"the software shall be used for good not evil"),
    ("beerware", "beer", 82, r"you can buy me a beer in return"),
    ("beerware", "beerware", 80, r"the beerware licen[cs]e"),
    ("cc0-1.0", "creativecommons org", 92, r"creativecommons org publicdomain zero 1 0"),
    ("cc-pdm-1.0", "creativecommons org", 92, r"creativecommons org publicdomain mark 1 0"),
    ("cc-by-nc-nd", "creativecommons org", 91, r"creativecommons org licenses by nc nd [1-4] [05]"),
    ("cc-by-nc-sa", "creativecommons org", 91, r"creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc", "creativecommons org", 90, r"creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nd", "creativecommons org", 90, r"creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-sa", "creativecommons org", 90, r"creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by", "creativecommons org", 89, r"creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", "compartir", 72, r"(?:creative commons )?(?:reconocimiento|atribución) compartir ?igual(?: [1-4] [05])?"),
    ("cc-by-nc", "no comercial", 71, r"(?:creative commons )?(?:reconocimiento|atribución) no comercial(?: [1-4] [05])?"),
    ("cc-by-sa", "weitergabe unter gleichen", 72, r"namensnennung weitergabe unter gleichen bedingungen(?: [1-4] [05])?"),
    ("cc-by-nc", "namensnennung nicht kommerziell", 71, r"namensnennung nicht kommerziell(?: [1-4] [05])?"),
    ("cc-by-sa", "partage dans les mêmes", 72, r"attribution partage dans les mêmes conditions(?: [1-4] [05])?"),
    ("cc-by-nc", "pas d utilisation commerciale", 71, r"attribution pas d utilisation commerciale(?: [1-4] [05])?"),
    ("gpl", "licencia pública general", 66, r"licencia pública general (?:de )?gnu"),
    ("gpl", "licence publique générale", 66, r"licence publique générale (?:de )?gnu"),
    ("gpl", "öffentliche lizenz", 66, r"(?:gnu )?allgemeine öffentliche lizenz"),
    ("public-domain", "dominio público", 50, r"(?:en|de|al) (?:el )?dominio público"),
    ("public-domain", "domaine public", 50, r"(?:dans le|du|au) domaine public"),
    ("public-domain", "gemeinfrei", 50, r"gemeinfrei(?:e[mnrs]?)?"),
    ("proprietary", "confidential information of", 46, r"contains confidential information of"),
    ("proprietary", "trade secret", 44, r"trade secrets? of"),
    ("no-derivatives", "no derivative works", 36, r"no derivative works (?:are |may be )?(?:permitted|allowed|made)"),
    ("no-redistribution", "may not be redistributed", 42, r"(?:it )?may not be redistributed(?: without (?:prior )?(?:written )?permission)?"),
    ("personal-use", "personal", 38, r"for (?:your )?personal (?:and )?(?:non commercial )?use only"),
    ("educational-use", "educational", 37, r"for educational (?:use|purposes) only"),
    ("fair-use", "fair use", 22, r"(?:under|as|constitutes) fair use"),
    ("crown-copyright", "crown copyright", 48, r"© ?crown copyright"),
    ("us-government-work", "work of the", 48, r"work of the (?:united states|u s) government"),
    ("free-to-copy", "may be freely", 24, r"may be freely (?:copied|reproduced|distributed)"),
    ("reproduction-prohibited", "no part of this", 41, r"no part of this (?:publication|work|book|document) may be reproduced"),
    ("reproduction-prohibited", "prohibited", 41, r"(?:unauthorized )?reproduction (?:is )?(?:strictly )?prohibited"),
    ("reproduction-prohibited", "toute reproduction", 41, r"toute reproduction (?:même partielle )?(?:est )?interdite"),
    ("reproduction-prohibited", "prohibida la reproducción", 41, r"prohibida la reproducción(?: total o parcial)?"),
    ("unknown-license", "see licen", 15, r"see licen[cs]e(?: (?:file|txt|md))? for details"),
    ("unknown-license", "ed under", 10, r"licen[cs]ed under"),
)
_GRANT = r"(?:licen[cs]ed|released|distributed|published|shared|available|provided|covered|free)(?: \w+){0,2}? (?:under|by|with|according to)(?: the)?(?: terms(?: and conditions)? of)?(?: the| an| a)?(?: [0-9a-z]+)?? "
NAME_PRIORITY, GRANT_PRIORITY, SPDX_PRIORITY = 70, 90, 100


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    priority: int
    pattern: re.Pattern[str]


def _spdx(label: str) -> str:
    """The words of an SPDX identifier."""
    return " ".join(re.findall(r"[0-9a-z]+", label))


@lru_cache(maxsize=1)
def rules() -> tuple[tuple[Rule, ...], ahocorasick.Automaton, dict[str, list[int]]]:
    """The rules by falling priority, the automaton of their keywords, and the rules of each keyword."""

    def compiled(label: str, keyword: str, priority: int, pattern: str) -> Rule:
        return Rule(label, " ".join(re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", keyword)), priority, re.compile(rf"(?<!\S)(?:{pattern})(?!\S)"))

    found = [compiled(label, keyword, NAME_PRIORITY, pattern) for label, keyword, pattern in NAMES]
    found += [compiled(label, keyword, GRANT_PRIORITY, _GRANT + f"(?:{pattern})") for label, keyword, pattern in NAMES]
    found += [compiled(label, "spdx licen", SPDX_PRIORITY, rf"spdx licen[cs]e identifier {_spdx(label)}(?: only| or later)?") for label in dict.fromkeys(n[0] for n in NAMES)]
    found += [compiled(*t) for t in TEXTS]
    found.sort(key=lambda r: -r.priority)
    automaton, by_keyword = ahocorasick.Automaton(), {}
    for k, rule in enumerate(found):
        by_keyword.setdefault(rule.keyword, []).append(k)
    for keyword in by_keyword:
        automaton.add_word(keyword, keyword)
    automaton.make_automaton()
    return tuple(found), automaton, by_keyword


def detect(joined: str) -> list[tuple[int, int, str, int]]:
    """(start, end, label, priority) of the detections in words joined by spaces that no other suppresses, in order of place."""
    all_rules, automaton, by_keyword = rules()
    present = {keyword for _, keyword in automaton.iter(joined)}
    hits = []
    for k in sorted({k for keyword in present for k in by_keyword[keyword]}):
        rule = all_rules[k]
        hits += [(m.start(), m.end(), rule.label, rule.priority) for m in rule.pattern.finditer(joined)]
    hits.sort(key=lambda h: (h[0], -h[1], -h[3]))
    # sweep by start: a detection is contained if one of its priority or more begins no later and ends no earlier
    reach: dict[int, int] = {}
    kept = []
    for start, end, label, priority in hits:
        if any(p >= priority and far >= end for p, far in reach.items()):
            continue
        reach[priority] = max(end, reach.get(priority, 0))
        kept.append((start, end, label, priority))
    return kept


@dataclass(frozen=True)
class Scan:
    n_words: int
    n_base: int
    first_word: int | None
    last_word: int | None
    base_labels: str
    labels: str
    score: float
    detections: tuple[tuple[int, int, str], ...]


def scan(text: str | None) -> Scan:
    """All detections of a whole text; places are numbers of words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
    joined = b" ".join(words)
    padded = b" " + joined + b" "
    places, base = [], set()
    for phrase, label in BASE:
        wanted = b" " + phrase.encode() + b" "
        at, before, number = padded.find(wanted), 0, 0
        while at >= 0:
            number += padded.count(b" ", before, at)
            places.append(number)
            base.add(label)
            at, before = padded.find(wanted, at + 1), at
    decoded = joined.decode("utf-8", "replace")
    found = detect(decoded)
    spans, before, number = [], 0, 0
    for start, end, label, _ in found:  # in order of place, so that a text is counted through once
        number += decoded.count(" ", before, start)
        before = start
        spans.append((number, number + decoded.count(" ", start, end) + 1, label))
    score = max([p / 100 for *_, p in found] + [0.7] * bool(base) + [0.0])
    labels = sorted(base | {label for _, _, label, _ in found})
    return Scan(len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(labels), score, tuple(spans))


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, the figures of ``Scan``, and its detections as spans of words. No shuffle."""
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kinds = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
    span = pa.struct([("first", pa.int64()), ("after", pa.int64()), ("label", pa.string())])
    key = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<first:long,after:long,label:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [scan(t) for t in part.column("text").to_pylist()]
            columns = [pa.array([getattr(s, name) for s in found], kind) for name, kind in kinds]
            spans = pa.array([[{"first": a, "after": b, "label": label} for a, b, label in s.detections] for s in found], pa.list_(span))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns, spans], names=["doc_id", *(n for n, _ in kinds), "detections"])

    return source.mapInArrow(run, schema)


def op5_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("detections")
