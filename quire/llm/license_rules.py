"""Licence signatures, each written for what one licence says of itself or is called.

A rule is a regular expression over lower-cased words parted by single spaces,
a keyword that whatever it matches contains, a label, a priority and a
confidence.  The kinds, by priority: identifiers in SPDX tags, wording of licence
texts and notices, statements that name the licence, addresses, titles, loose
mentions.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    regex: str
    priority: int
    confidence: float


#: Phrases whose places are counted; their labels always stay.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Words before the name in a statement, and before a version.
_PARTS = {
    "{under}": r"(?:(?:licen[sc]ed|released|distributed|published|available|provided|covered|governed|shared) under|(?:covered|governed) by|subject to)(?: the)?(?: terms(?: and conditions)? of(?: the)?)?",
    "{v}": r"(?: ?version| ?ver| ?v)?",
    "{l}": r"licen[sc]e",
}

#: Identifiers in SPDX tags: label | words.
_IDENTIFIERS = r"""
mit | mit
mit-0 | mit 0
x11 | x11
isc | isc
0bsd | 0bsd
bsd-1 | bsd 1 clause
bsd-2 | bsd 2 clause(?: patent| views)?
bsd-3 | bsd 3 clause(?: clear| lbnl| attribution)?
bsd-4 | bsd 4 clause(?: uc)?
apache-1 | apache 1 [01]
apache-2 | apache 2 0
gpl-1 | gpl 1 0(?: only| or later)?
gpl-2 | gpl 2 0(?: only| or later)?
gpl-3 | gpl 3 0(?: only| or later)?
lgpl-2 | lgpl 2 [01](?: only| or later)?
lgpl-3 | lgpl 3 0(?: only| or later)?
agpl-1 | agpl 1 0(?: only| or later)?
agpl-3 | agpl 3 0(?: only| or later)?
gfdl | gfdl 1 [123](?: only| or later)?
mpl-1 | mpl 1 [01]
mpl-2 | mpl 2 0(?: no copyleft exception)?
epl-1 | epl 1 0
epl-2 | epl 2 0
cpl-1 | cpl 1 0
ipl-1 | ipl 1 0
cddl-1 | cddl 1 [01]
eupl-1 | eupl 1 [012]
cecill-2 | cecill 2 [01]
cecill-b | cecill b
cecill-c | cecill c
artistic-1 | artistic 1 0(?: perl| cl8)?
artistic-2 | artistic 2 0
zlib | zlib
libpng | libpng(?: 2 0)?
bsl-1 | bsl 1 0
unlicense | unlicense
wtfpl | wtfpl
beerware | beerware
psf-2 | psf 2 0
python | python 2 0
php-3 | php 3 0(?:1)?
ruby | ruby
openssl | openssl
postgresql | postgresql
ncsa | ncsa
ofl-1 | ofl 1 [01](?: rfn| no rfn)?
ms-pl | ms pl
ms-rl | ms rl
upl-1 | upl 1 0
afl-3 | afl 3 0
osl-3 | osl 3 0
qpl-1 | qpl 1 0
sspl-1 | sspl 1 0
busl-1 | busl 1 1
elastic-2 | elastic 2 0
odbl-1 | odbl 1 0
odc-by-1 | odc by 1 0
pddl-1 | pddl 1 0
cc0-1 | cc0 1 0
cc-by | cc by [1234] [05]
cc-by-sa | cc by sa [1234] [05]
cc-by-nc | cc by nc [1234] [05]
cc-by-nd | cc by nd [1234] [05]
cc-by-nc-sa | cc by nc sa [1234] [05]
cc-by-nc-nd | cc by nc nd [1234] [05]
blueoak-1 | blueoak 1 0 0
mulan-2 | mulanpsl 2 0
hpnd | hpnd
curl | curl
ijg | ijg
vim | vim
w3c | w3c
tcl | tcl
"""

#: Wording of licence texts and of the notices in files: label | keyword (~: may be part of a word) | expression.
_TEXTS = r"""
mit | ~hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy(?: of this software)?(?: and associated documentation files)?
mit | ~substantial portions | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | ~deal in the software | to deal in the software without restriction including without limitation the rights to use copy modify
x11 | ~x consortium | except as contained in this notice the name of the x consortium shall not be used in advertising
isc | ~with or without fee | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
hpnd | ~without fee is hereby granted | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
bsd | ~source and binary forms | redistribution and use in source and binary forms with or without modification are permitted
bsd-2 | ~list of conditions and the following disclaimer | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd-3 | ~endorse or promote | neither the name of (?:[^ ]+ ){1,8}nor the names of (?:its|their) contributors may be used to endorse or promote
bsd-4 | ~advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
apache-2 | ~except in compliance with the license | you may not use this file except in compliance with the license
apache-2 | ~apache org licenses | you may obtain a copy of the license at (?:https? )?www apache org licenses license 2 0
apache-2 | ~unless required by applicable law | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2 | ~asf under one | licensed to the apache software foundation asf under one or more contributor license agreements
apache-1 | ~developed by the apache | this product includes software developed by the apache (?:group|software foundation)
gpl | ~redistribute it and or modify | you can redistribute it and or modify it under the terms of the gnu general public license(?: as published by the free software foundation)?
gpl-2 | ~either version 2 | gnu general public license as published by the free software foundation either version 2 of the license
gpl-3 | ~either version 3 | gnu general public license as published by the free software foundation either version 3 of the license
gpl | ~copy of the gnu general public | you should have received a copy of the gnu general public license
lgpl | ~lesser general public | you can redistribute it and or modify it under the terms of the gnu lesser general public license
lgpl-2 | ~lesser general public | gnu lesser general public license as published by the free software foundation either version 2(?: 1)? of the license
lgpl-3 | ~lesser general public | gnu lesser general public license as published by the free software foundation either version 3 of the license
lgpl-2 | ~library general public | you can redistribute it and or modify it under the terms of the gnu library general public license
agpl-3 | ~affero general public | you can redistribute it and or modify it under the terms of the gnu affero general public license
agpl-3 | ~remote network interaction | remote network interaction use with the gnu general public license
gfdl | ~free documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl-1 | ~mozilla public license version 1 | the contents of this file are subject to the mozilla public license version 1 [01]
mpl-2 | ~mozilla public license v 2 | this source code form is subject to the terms of the mozilla public license v 2 0
epl-1 | ~eclipse public license v1 | made available under the terms of the eclipse public license v1 0
epl-2 | ~eclipse public license 2 | made available under the terms of the eclipse public license 2 0
cddl-1 | ~common development | the contents of this file are subject to the terms of the common development and distribution license
eupl-1 | ~eupl | licen[sc]ed under the eupl(?: version 1 [012])?
cecill-2 | ~cecill | this software is governed by the cecill license under french law
cecill-b | ~cecill b | this software is governed by the cecill b license under french law
cecill-c | ~cecill c | this software is governed by the cecill c license under french law
artistic-2 | ~everyone is permitted to copy and distribute verbatim copies of this license | artistic license 2 0 (?:[^ ]+ ){0,12}everyone is permitted to copy and distribute verbatim copies of this license
artistic-1 | ~semblance of artistic control | copyright holder maintains some semblance of artistic control
zlib | ~altered source versions | altered source versions must be plainly marked as such
zlib | ~origin of this software | the origin of this software must not be misrepresented
libpng | ~png reference library | the png reference library is supplied as is
bsl-1 | ~boost software | distributed under the boost software license version 1 0
unlicense | ~unencumbered | this is free and unencumbered software released into the public domain
unlicense | ~unlicense org | for more information please refer to (?:https? )?unlicense org
wtfpl | ~you just do what the | you just do what the fuck you want to
beerware | ~buy me a beer | you can buy me a beer in return
psf-2 | ~psf hereby grants | psf hereby grants licensee a nonexclusive royalty free world wide license
python | ~beopen | beopen python open source license agreement
php-3 | ~php license that is bundled | this source file is subject to version 3 0(?:1)? of the php license that is bundled
ruby | ~ruby s license | you can redistribute it and or modify it under the same terms as ruby s license
openssl | ~openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
postgresql | ~university of california be liable | in no event shall the university of california be liable to any party
ncsa | ~with the software without restriction | to deal with the software without restriction including without limitation the rights to use copy
ofl-1 | ~font software is licensed | this font software is licensed under the sil open font license(?: version 1 [01])?
ms-pl | ~microsoft public | this license governs use of the accompanying software (?:[^ ]+ ){0,20}microsoft public license
upl-1 | ~larger works | sublicense and distribute the software and the larger works
afl-3 | ~academic free | licensed under the academic free license version 3 0
osl-3 | ~open software license | licensed under the open software license version 3 0
qpl-1 | ~q public | this file may be distributed under the terms of the q public license
sspl-1 | ~server side public | it under the terms of the server side public license version 1
busl-1 | ~business source | use of this software is governed by the business source license
elastic-2 | ~elastic license 2 | you may not use this file except in compliance with the elastic license 2 0
odbl-1 | ~open database | is made available under the open database license
odbl-1 | ~open data commons | open data commons open database license odbl
odc-by-1 | ~open data commons | open data commons attribution license
pddl-1 | ~open data commons | open data commons public domain dedication and licen[sc]e
cc0-1 | ~waived all copyright | has waived all copyright and related or neighboring rights
cc0-1 | ~associated cc0 with this work | the person who associated cc0 with this work
cc | ~creative commons corporation | creative commons corporation is not a law firm
cc | ~creative commons public license | the work as defined below is provided under the terms of this creative commons public license
public-domain | ~no copyright claimed | no copyright claimed in the united states
public-domain | ~public domain | (?:placed|released|dedicated|given|is)(?: in| into| to) the public domain
public-domain | ~public domain | this work is in the public domain
blueoak-1 | ~blue oak | blue oak model license(?: version 1 0 0)?
mulan-2 | ~mulan | mulan psl v2
curl | ~curl and libcurl | curl and libcurl are licensed under
ijg | ~independent jpeg group | this software is based in part on the work of the independent jpeg group
vim | ~vim license | distributed under the vim license
w3c | ~w3c software | w3c software(?: and document)? notice and license
tcl | ~regents of the university of california sun | copyrighted by the regents of the university of california sun microsystems
proprietary | ~may not be reproduced | may not be reproduced(?: or transmitted)?(?: in any form)?
proprietary | ~be reproduced | no part of this (?:[^ ]+ ){1,6}may be reproduced
proprietary | ~proprietary and confidential | proprietary and confidential
proprietary | ~unauthori | unauthori[sz]ed (?:copying|reproduction|use)(?: of this file)?(?: via any medium)? is strictly prohibited
proprietary | ~trade secret | contains trade secrets? (?:of|and)
proprietary | ~written permission | without (?:the )?(?:prior|express) written permission of the (?:publisher|author|copyright (?:owner|holder))
proprietary | ~subject to a license agreement | use of this software is subject to a license agreement
"""

#: Statements that something is under a licence: label | keyword | expression.
_STATEMENTS = r"""
mit | mit | {under} mit(?: x11)?(?: {l})?
mit | ~expat | {under} expat(?: {l})?
mit-0 | ~mit no attribution | {under} mit no attribution(?: {l})?
x11 | x11 | {under} x11 {l}
isc | isc | {under} isc(?: {l})?
0bsd | ~bsd | {under} (?:0bsd|bsd zero clause|zero clause bsd)(?: {l})?
bsd-2 | ~bsd | {under} (?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: {l})?
bsd-3 | ~bsd | {under} (?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: {l})?
bsd-4 | ~bsd | {under} (?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)(?: {l})?
bsd | ~bsd | {under} bsd(?: style)?(?: {l})?
apache-1 | ~apache | {under} apache(?: software)?(?: {l})?{v} ?1 [01]
apache-2 | ~apache | {under} apache(?: software)?(?: {l})?{v} ?2(?: 0)?(?: {l})?
apache-2 | ~asl 2 | {under} asl 2 0(?: {l})?
apache | apache | {under} apache(?: software)? {l}
gpl-1 | ~gpl | {under} (?:gnu )?gpl{v} ?1(?: 0)?
gpl-2 | ~gpl | {under} (?:gnu )?gpl{v} ?2(?: 0)?(?: {l})?(?: or(?: at your option)? (?:any )?later(?: version)?)?
gpl-3 | ~gpl | {under} (?:gnu )?gpl{v} ?3(?: 0)?(?: {l})?(?: or(?: at your option)? (?:any )?later(?: version)?)?
gpl-2 | ~general public | {under} gnu general public {l}{v} ?2(?: 0)?(?: or (?:any )?later(?: version)?)?
gpl-3 | ~general public | {under} gnu general public {l}{v} ?3(?: 0)?(?: or (?:any )?later(?: version)?)?
gpl | ~general public | {under} gnu general public {l}
gpl | gpl | {under} (?:gnu )?gpl(?: {l})?
lgpl-2 | ~lgpl | {under} (?:gnu )?lgpl{v} ?2(?: [01])?(?: {l})?
lgpl-3 | ~lgpl | {under} (?:gnu )?lgpl{v} ?3(?: 0)?(?: {l})?
lgpl-2 | ~general public | {under} (?:gnu )?(?:lesser|library) general public {l}{v} ?2(?: [01])?
lgpl-3 | ~general public | {under} (?:gnu )?lesser general public {l}{v} ?3(?: 0)?
lgpl | ~lgpl | {under} (?:gnu )?lgpl(?: {l})?
agpl-3 | ~agpl | {under} (?:gnu )?agpl{v} ?3(?: 0)?(?: {l})?
agpl-3 | ~affero | {under} (?:gnu )?affero general public {l}(?:{v} ?3(?: 0)?)?
gfdl | ~free documentation | {under} (?:gnu )?free documentation {l}(?:{v} ?1(?: [123])?)?
mpl-1 | ~mozilla public | {under} mozilla public {l}{v} ?1(?: [01])?
mpl-2 | ~mozilla public | {under} mozilla public {l}{v} ?2(?: 0)?
mpl-1 | ~mpl | {under} mpl{v} ?1(?: [01])?
mpl-2 | ~mpl | {under} mpl{v} ?2(?: 0)?
epl-1 | ~epl | {under} epl{v} ?1(?: 0)?
epl-2 | ~epl | {under} epl{v} ?2(?: 0)?
epl-1 | ~eclipse public | {under} eclipse public {l}{v} ?1(?: 0)?
epl-2 | ~eclipse public | {under} eclipse public {l}{v} ?2(?: 0)?
edl-1 | ~eclipse distribution | {under} eclipse distribution {l}(?:{v} ?1(?: 0)?)?
cpl-1 | ~common public | {under} common public {l}(?:{v} ?1(?: 0)?)?
ipl-1 | ~ibm public | {under} ibm public {l}(?:{v} ?1(?: 0)?)?
cddl-1 | ~cddl | {under} cddl(?:{v} ?1(?: [01])?)?
cecill-2 | ~cecill | {under} cecill(?:{v} ?2(?: [01])?)?
artistic-1 | ~artistic | {under} artistic {l}{v} ?1(?: 0)?
artistic-2 | ~artistic | {under} artistic {l}{v} ?2(?: 0)?
artistic | ~artistic | {under} artistic {l}
zlib | ~zlib | {under} zlib(?: libpng)?(?: {l})?
bsl-1 | ~boost | {under} boost(?: software)? {l}(?:{v} ?1(?: 0)?)?
unlicense | ~unlicense | {under} unlicense
wtfpl | ~wtfpl | {under} wtfpl
beerware | ~beerware | {under} beerware {l}
psf-2 | ~python software foundation | {under} python software foundation {l}(?:{v} ?2)?
python | ~python license | {under} python license
php-3 | ~php | {under} php {l}(?:{v} ?3(?: 01?)?)?
ruby | ~ruby | {under} ruby {l}
openssl | ~openssl | {under} openssl {l}
postgresql | ~postgresql | {under} postgresql {l}
ncsa | ~ncsa | {under} (?:university of illinois )?ncsa(?: open source)? {l}
ofl-1 | ~ofl | {under} (?:sil )?ofl(?:{v} ?1(?: [01])?)?
ofl-1 | ~open font | {under} (?:sil )?open font {l}(?:{v} ?1(?: [01])?)?
ms-pl | ~ms pl | {under} ms pl
ms-pl | ~microsoft public | {under} microsoft public {l}
ms-rl | ~microsoft reciprocal | {under} microsoft reciprocal {l}
upl-1 | ~universal permissive | {under} universal permissive {l}(?:{v} ?1(?: 0)?)?
sspl-1 | ~sspl | {under} sspl(?:{v} ?1)?
busl-1 | ~busl | {under} busl(?:{v} ?1(?: 1)?)?
elastic-2 | ~elastic | {under} elastic {l}(?:{v} ?2(?: 0)?)?
odbl-1 | ~odbl | {under} odbl(?:{v} ?1(?: 0)?)?
cc0-1 | ~cc0 | {under} (?:creative commons )?cc0(?: 1 0)?(?: universal)?
cc-by-nc-nd | ~cc by nc nd | {under}(?: a)? cc by nc nd(?: [1234] [05])?(?: {l})?
cc-by-nc-sa | ~cc by nc sa | {under}(?: a)? cc by nc sa(?: [1234] [05])?(?: {l})?
cc-by-nc | ~cc by nc | {under}(?: a)? cc by nc(?: [1234] [05])?(?: {l})?
cc-by-nd | ~cc by nd | {under}(?: a)? cc by nd(?: [1234] [05])?(?: {l})?
cc-by-sa | ~cc by sa | {under}(?: a)? cc by sa(?: [1234] [05])?(?: {l})?
cc-by | ~cc by | {under}(?: a)? cc by(?: [1234] [05])?(?: {l})?
cc-by-nc-nd | ~creative commons attribution | {under}(?: a)? creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works)(?: [1234] [05])?(?: international| unported| generic)?(?: {l})?
cc-by-nc-sa | ~creative commons attribution | {under}(?: a)? creative commons attribution non ?commercial share ?alike(?: [1234] [05])?(?: international| unported| generic)?(?: {l})?
cc-by-nc | ~creative commons attribution | {under}(?: a)? creative commons attribution non ?commercial(?: [1234] [05])?(?: international| unported| generic)?(?: {l})?
cc-by-nd | ~creative commons attribution | {under}(?: a)? creative commons attribution no ?deriv(?:s|atives|ative works)(?: [1234] [05])?(?: international| unported| generic)?(?: {l})?
cc-by-sa | ~creative commons attribution | {under}(?: a)? creative commons attribution share ?alike(?: [1234] [05])?(?: international| unported| generic)?(?: {l})?
cc-by | ~creative commons attribution | {under}(?: a)? creative commons attribution(?: [1234] [05])?(?: international| unported| generic)?(?: {l})?
license | ~under the terms | licen[sc]ed under the terms(?: and conditions)?
license | ~licensed under | licensed under(?: the)? [^ ]+ {l}
license | ~dual licensed | dual licensed under
"""

#: Addresses of licence texts: label | keyword | expression.
_ADDRESSES = r"""
mit | ~licenses mit | opensource org licenses mit(?: license)?(?: php)?
bsd-2 | ~licenses bsd 2 | opensource org licenses bsd 2 clause
bsd-3 | ~licenses bsd 3 | opensource org licenses bsd 3 clause
bsd | ~bsd license | opensource org licenses bsd license(?: php)?
isc | ~licenses isc | opensource org licenses isc
apache-2 | ~licenses license 2 0 | apache org licenses license 2 0(?: txt| html)?
apache-2 | ~licenses apache 2 | opensource org licenses apache 2 0
gpl-2 | ~gnu org | gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?
gpl-3 | ~gnu org | gnu org licenses gpl 3 0(?: html| txt)?
gpl | ~gnu org | gnu org (?:licenses|copyleft) gpl(?: html)?
lgpl-2 | ~gnu org | gnu org licenses (?:old licenses )?lgpl 2 1(?: html| txt)?
lgpl-3 | ~gnu org | gnu org licenses lgpl 3 0(?: html| txt)?
agpl-3 | ~gnu org | gnu org licenses agpl(?: 3 0)?(?: html| txt)?
gfdl | ~gnu org | gnu org (?:licenses|copyleft) fdl(?: 1 [123])?(?: html| txt)?
mpl-1 | ~mozilla org | mozilla org mpl(?: mpl)? 1 [01](?: html| txt)?
mpl-2 | ~mozilla org | mozilla org mpl 2 0
epl-1 | ~eclipse org | eclipse org legal epl v10(?: html)?
epl-2 | ~eclipse org | eclipse org legal epl (?:v20|2 0)(?: html)?
bsl-1 | ~boost org | boost org license 1 0(?: txt)?
unlicense | ~unlicense org | unlicense org
wtfpl | ~wtfpl net | wtfpl net
artistic-2 | ~org | (?:opensource org|perlfoundation org) (?:licenses )?artistic (?:license )?2 0
zlib | ~licenses zlib | opensource org licenses zlib
ofl-1 | ~sil org | scripts sil org ofl
cddl-1 | ~licenses cddl | opensource org licenses cddl 1 0
eupl-1 | ~eupl | joinup ec europa eu (?:[^ ]+ ){0,8}eupl
odbl-1 | ~odbl | opendatacommons org licenses odbl(?: 1 0)?
cc0-1 | ~publicdomain zero | creativecommons org publicdomain zero 1 0
public-domain | ~publicdomain mark | creativecommons org publicdomain mark 1 0
cc-by | ~creativecommons org | creativecommons org licenses by [1234] [05]
cc-by-sa | ~creativecommons org | creativecommons org licenses by sa [1234] [05]
cc-by-nc | ~creativecommons org | creativecommons org licenses by nc [1234] [05]
cc-by-nd | ~creativecommons org | creativecommons org licenses by nd [1234] [05]
cc-by-nc-sa | ~creativecommons org | creativecommons org licenses by nc sa [1234] [05]
cc-by-nc-nd | ~creativecommons org | creativecommons org licenses by nc nd [1234] [05]
"""

#: Titles and full names: label | keyword | expression.
_TITLES = r"""
mit | ~mit li | (?:the|see|license|licence|under) mit {l}
mit | ~mit licensed | mit licensed
mit | ~license mit | license mit
isc | ~isc li | (?:the|see|under) isc {l}
isc | ~license isc | license isc
bsd-2 | ~bsd | (?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd) {l}
bsd-3 | ~bsd | (?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd) {l}
bsd-4 | ~bsd | (?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd) {l}
0bsd | ~bsd | (?:0bsd|zero clause bsd|bsd zero clause) {l}
bsd | ~bsd li | (?:the|see|under) bsd {l}
bsd | ~license bsd | license bsd
apache-1 | ~apache | apache(?: software)? {l}{v} ?1 [01]
apache-2 | ~apache | apache(?: software)? {l}{v} ?2(?: 0)?
apache-2 | ~license apache | license apache{v} ?2(?: 0)?
apache-2 | ~license asl | license asl 2 0
apache | ~apache li | (?:the|see|under) apache {l}
gpl-2 | ~gnu general public | gnu general public {l}{v} ?2(?: 0)?
gpl-3 | ~gnu general public | gnu general public {l}{v} ?3(?: 0)?
gpl | ~gnu general public | gnu general public {l}
gpl-2 | ~gpl | license (?:gnu )?gpl{v} ?2(?: 0)?
gpl-3 | ~gpl | license (?:gnu )?gpl{v} ?3(?: 0)?
lgpl-2 | ~lgpl | license (?:gnu )?lgpl{v} ?2(?: [01])?
lgpl-3 | ~lgpl | license (?:gnu )?lgpl{v} ?3(?: 0)?
lgpl-2 | ~general public | gnu (?:lesser|library) general public {l}{v} ?2(?: [01])?
lgpl-3 | ~general public | gnu lesser general public {l}{v} ?3(?: 0)?
lgpl | ~general public | gnu (?:lesser|library) general public {l}
agpl-3 | ~affero | (?:gnu )?affero general public {l}(?:{v} ?3(?: 0)?)?
gfdl | ~free documentation | gnu free documentation {l}(?:{v} ?1(?: [123])?)?
mpl-1 | ~mozilla public | mozilla public {l}{v} ?1(?: [01])?
mpl-2 | ~mozilla public | mozilla public {l}(?:{v} ?2(?: 0)?)?
epl-1 | ~eclipse public | eclipse public {l}{v} ?1(?: 0)?
epl-2 | ~eclipse public | eclipse public {l}(?:{v} ?2(?: 0)?)?
edl-1 | ~eclipse distribution | eclipse distribution {l}(?:{v} ?1(?: 0)?)?
cpl-1 | ~common public | common public {l}(?:{v} ?1(?: 0)?)?
ipl-1 | ~ibm public | ibm public {l}(?:{v} ?1(?: 0)?)?
cddl-1 | ~common development | common development and distribution {l}(?:{v} ?1(?: [01])?)?
eupl-1 | ~european union public | european union public {l}(?:{v} ?1(?: [012])?)?
artistic-1 | ~artistic | artistic {l}{v} ?1(?: 0)?
artistic-2 | ~artistic | artistic {l}{v} ?2(?: 0)?
artistic | ~perl artistic | perl artistic {l}
zlib | ~zlib | zlib(?: libpng)? {l}
bsl-1 | ~boost software | boost software {l}(?:{v} ?1(?: 0)?)?
wtfpl | ~fuck you want | do what the fuck you want to public {l}
psf-2 | ~python software foundation | python software foundation {l}(?:{v} ?2)?
php-3 | ~php | php {l}{v} ?3(?: 01?)?
openssl | ~openssl li | openssl {l}
postgresql | ~postgresql li | postgresql {l}
ncsa | ~ncsa | university of illinois ncsa open source {l}
ofl-1 | ~open font | sil open font {l}(?:{v} ?1(?: [01])?)?
ms-pl | ~microsoft public | microsoft public {l}(?: ms pl)?
ms-rl | ~microsoft reciprocal | microsoft reciprocal {l}(?: ms rl)?
upl-1 | ~universal permissive | universal permissive {l}(?:{v} ?1(?: 0)?)?
afl-3 | ~academic free | academic free {l}(?:{v} ?3(?: 0)?)?
osl-3 | ~open software li | open software {l}(?:{v} ?3(?: 0)?)?
qpl-1 | ~q public li | q public {l}(?:{v} ?1(?: 0)?)?
sspl-1 | ~server side public | server side public {l}(?:{v} ?1)?
busl-1 | ~business source | business source {l}(?:{v} ?1(?: 1)?)?
odbl-1 | ~open database | open database {l}(?:{v} ?1(?: 0)?)?
cc0-1 | ~cc0 | (?:creative commons )?cc0 1 0(?: universal)?
cc0-1 | ~creative commons zero | creative commons zero(?: v?1 0)?(?: universal)?
cc-by-nc-nd | ~creative commons attribution | creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works)(?: [1234] [05])?
cc-by-nc-sa | ~creative commons attribution | creative commons attribution non ?commercial share ?alike(?: [1234] [05])?
cc-by-nc | ~creative commons attribution | creative commons attribution non ?commercial(?: [1234] [05])?
cc-by-nd | ~creative commons attribution | creative commons attribution no ?deriv(?:s|atives|ative works)(?: [1234] [05])?
cc-by-sa | ~creative commons attribution | creative commons attribution share ?alike(?: [1234] [05])?
cc-by | ~creative commons attribution | creative commons attribution(?: [1234] [05])?
cc | ~creative commons li | creative commons {l}
"""

#: Loose mentions: label | keyword | expression.
_MENTIONS = r"""
public-domain | ~public domain | public domain
proprietary | ~all rights reserved | all rights reserved
copyright | ~copyright | copyright (?:c )?[12][0-9]{3}(?: [12][0-9]{3})*
"""

#: (lines, priority, confidence) of each kind.
_KINDS = ((_TEXTS, 85, 0.95), (_STATEMENTS, 80, 0.9), (_ADDRESSES, 75, 0.9), (_TITLES, 70, 0.8), (_MENTIONS, 40, 0.6))
#: What must stand before an identifier: the tag, with other identifiers in between.
_TAG = r"(?<=spdx licen[sc]e identifier (?:[a-z0-9 ]{1,80} (?:or|and) )?(?:%s))"


def _lines(block: str) -> list[list[str]]:
    return [[x.strip() for x in line.split(" | ")] for line in block.strip().splitlines()]


def rules() -> list[Rule]:
    """All rules, base phrases first; every expression starts and ends at a word's edge."""
    out = [Rule(label, f" {phrase} ", phrase, 100, 1.0) for phrase, label in BASE]
    out += [Rule(label, " spdx ", f"(?:{words}){_TAG % words}", 90, 1.0) for label, words in _lines(_IDENTIFIERS)]
    for block, priority, confidence in _KINDS:
        for label, keyword, regex in _lines(block):
            for name, part in _PARTS.items():
                regex = regex.replace(name, part)
            out.append(Rule(label, keyword[1:] if keyword.startswith("~") else f" {keyword} ", regex, priority, confidence))
    return out
