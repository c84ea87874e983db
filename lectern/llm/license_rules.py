"""Licence signatures, written by hand: notices, titles, sentences of the licences' own texts, identifiers and addresses.

One rule to a line: label | priority | confidence | key words | words. The words are a regular expression over
lower-cased words joined by single spaces (signs are spaces, so 2.0 is `2 0`); any match holds one of the key
words as a whole word. A higher priority is taken first; of equal ones the longer.
"""

#: Fixed values.
SIGNATURES = r"""
mit | 66 | 0.97 | hereby | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 60 | 0.95 | hereby | permission is hereby granted free of charge to any person obtaining a copy
mit | 58 | 0.9 | sublicense | to use copy modify merge publish distribute sublicense and or sell copies of the software
mit | 55 | 0.85 | portions | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 30 | 0.5 | warranty | the software is provided as is without warranty of any kind
mit | 50 | 0.8 | noninfringement | warranties of merchantability fitness for a particular purpose and noninfringement
mit | 56 | 0.85 | liable | in no event shall the authors or copyright holders be liable for any claim damages or other liability
mit | 72 | 0.95 | mit | opensource org licenses? mit( license)?( php| html)?
mit | 62 | 0.9 | mit | (the )?mit license mit
mit | 45 | 0.7 | mit | mit( style| like)? licensed?
mit-0 | 47 | 0.95 | mit | mit (no attribution|0)
mit-cmu | 60 | 0.8 | cmu | (mit )?cmu license
expat | 52 | 0.8 | expat | expat licen[sc]e
x11 | 62 | 0.85 | advertising | name of the x consortium shall not be used in advertising
x11 | 52 | 0.8 | x11 | x11( distribution)? licen[sc]e
apache | 66 | 0.97 | apache | licensed under the apache license version 2 0( the license)?
apache | 60 | 0.93 | compliance | you may not use this file except in compliance with the license
apache | 58 | 0.9 | writing | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache | 72 | 0.97 | apache | www apache org licenses license 2 0( txt| html)?
apache | 64 | 0.95 | apache | apache license version 2 0 january 2004
apache | 62 | 0.93 | apache | apache software license version 1 1
apache | 63 | 0.93 | apache | apache software license version 1 0
apache | 56 | 0.85 | apache | this product includes software developed by the apache (software foundation|group)
apache | 55 | 0.8 | perpetual | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache | 48 | 0.95 | apache asl2 apache2 | (apache 2 0|apache2( 0)?|asl2( 0)?) licen[sc]ed?
apache | 54 | 0.8 | asf | licensed to the asf under one or more contributor license agreements
apache | 61 | 0.9 | apache | licensed to the apache software foundation( asf)? under one or more contributor license agreements
gpl | 66 | 0.97 | gnu | under the terms of the gnu general public license( version [23])?( as published by the free software foundation)?
gpl | 60 | 0.9 | redistribute | this program is free software you can redistribute it( and or modify it)?
gpl | 57 | 0.88 | hope | this program is distributed in the hope that it will be useful but without any warranty
gpl | 59 | 0.9 | gnu | see the gnu general public license for more details
gpl | 58 | 0.9 | gnu | you should have received a copy of the gnu general public license along with this program
gpl | 64 | 0.93 | gnu | gnu general public license version 2 june 1991
gpl | 64 | 0.93 | gnu | gnu general public license version 3 29 june 2007
gpl | 68 | 0.93 | option | either version 2 of the license or at your option any later version
gpl | 68 | 0.93 | option | either version 3 of the license or at your option any later version
gpl | 47 | 0.95 | gpl | gpl [123] 0 (only|or later)
gpl | 72 | 0.95 | gpl | www gnu org (licenses|copyleft) gpl( [23] 0)?( html| txt)?
gpl | 63 | 0.9 | franklin | free software foundation inc 51 franklin (street|st)
gpl | 63 | 0.9 | temple | free software foundation inc 59 temple place
gpl | 55 | 0.85 | classpath | (gpl|gnu general public license) with( the)? classpath exception
gpl | 56 | 0.85 | linking | linking this library statically or dynamically with other modules is making a combined work
gpl | 54 | 0.8 | verbatim | everyone is permitted to copy and distribute verbatim copies of this license document
gpl | 48 | 0.75 | gpled gpl | gpl(ed| ed)( software| code)?
lgpl | 67 | 0.97 | lesser | under the terms of the gnu lesser general public license( version (2 1|3))?
lgpl | 67 | 0.95 | library | under the terms of the gnu library general public license( version 2)?
lgpl | 61 | 0.9 | redistribute | this library is free software you can redistribute it( and or modify it)?
lgpl | 58 | 0.88 | hope | this library is distributed in the hope that it will be useful but without any warranty
lgpl | 61 | 0.9 | lesser | see the gnu lesser general public license for more details
lgpl | 65 | 0.93 | lesser | gnu lesser general public license version 2 1 february 1999
lgpl | 65 | 0.93 | lesser | gnu lesser general public license version 3 29 june 2007
lgpl | 48 | 0.95 | lgpl | lgpl (2 0|2 1|3 0) (only|or later)
lgpl | 73 | 0.95 | lgpl lesser | www gnu org (licenses|copyleft) (lgpl|lesser)( 2 1| 3 0)?( html| txt)?
agpl | 68 | 0.97 | affero | under the terms of the gnu affero general public license( version 3)?
agpl | 62 | 0.9 | affero | see the gnu affero general public license for more details
agpl | 65 | 0.93 | affero | gnu affero general public license version 3 19 november 2007
agpl | 48 | 0.95 | agpl | agpl [13] 0 (only|or later)
agpl | 73 | 0.95 | agpl | www gnu org licenses agpl( 3 0)?( html| txt)?
gfdl | 66 | 0.95 | documentation | under the terms of the gnu free documentation license( version 1 [123])?
gfdl | 52 | 0.85 | gfdl documentation | (gfdl|gnu free documentation license)( 1 [123])?
gfdl | 58 | 0.85 | invariant | with no invariant sections no front cover texts and no back cover texts
bsd | 66 | 0.97 | redistribution | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd | 60 | 0.95 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd | 57 | 0.9 | redistributions | redistributions of source code must retain the above copyright notice
bsd | 57 | 0.9 | redistributions | redistributions in binary form must reproduce the above copyright notice
bsd | 55 | 0.9 | neither | neither the names? of .{1,80}? nor the names of (its|their) contributors
bsd | 56 | 0.85 | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd | 55 | 0.85 | contributors | this software is provided by the (copyright holders|authors?|regents) and contributors as is
bsd | 46 | 0.95 | bsd | bsd [0234] clause( clear| patent| views)?
bsd | 72 | 0.95 | bsd | opensource org licenses? bsd( license| [23] clause)?( php)?
bsd | 52 | 0.85 | regents | the regents of the university of california( berkeley)? all rights reserved
bsd | 53 | 0.8 | freebsd | (the )?freebsd (license|licence|copyright)
bsd | 53 | 0.8 | netbsd | (the )?netbsd (license|licence|foundation inc)
bsd-0 | 47 | 0.95 | 0bsd | 0bsd
bsd-0 | 64 | 0.93 | purpose | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 60 | 0.9 | permission | permission to use copy modify and (or )?distribute this software
isc | 65 | 0.93 | purpose | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that
isc | 57 | 0.85 | author | the software is provided as is and the author disclaims all warranties
isc | 72 | 0.95 | isc | opensource org licenses? isc( license)?( php)?
mpl | 66 | 0.97 | mozilla | (this source code form is )?subject to the terms of the mozilla public license v(ersion)? ?(1 1|2 0)
mpl | 60 | 0.9 | mpl | if a copy of the mpl was not distributed with this file you can obtain one at
mpl | 64 | 0.93 | mozilla | mozilla public license version (1 0|1 1|2 0)
mpl | 72 | 0.95 | mozilla | (www )?mozilla org mpl( [12] [01])?
mpl | 58 | 0.85 | initial | the initial developer of the original code is
mpl | 47 | 0.95 | mpl | mpl 2 0 no copyleft exception
npl | 52 | 0.85 | netscape | netscape public licen[sc]e
epl | 66 | 0.97 | eclipse | under the terms of the eclipse public license v?( ?[12] 0)?
epl | 64 | 0.93 | eclipse | eclipse public license v(ersion)? ?[12] ?0
epl | 72 | 0.95 | eclipse | (www )?eclipse org (legal|org documents) epl v?( ?[12]0?)?( html)?
edl | 66 | 0.9 | eclipse | eclipse distribution license( v ?1 0)?
cpl | 54 | 0.85 | common | common public license( version)?( 1 0)?
ipl | 54 | 0.85 | ibm | ibm public license( version)?( 1 0)?
cddl | 66 | 0.95 | distribution | common development and distribution license( cddl)?( version 1 [01])?
cddl | 46 | 0.95 | cddl | cddl 1 [01]
zlib | 60 | 0.93 | implied | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | 58 | 0.9 | misrepresented | the origin of this software must not be misrepresented
zlib | 58 | 0.9 | altered | altered source versions must be plainly marked as such
zlib | 53 | 0.85 | zlib | zlib libpng( license)?
libpng | 53 | 0.85 | libpng | libpng licen[sc]e
bsl | 66 | 0.95 | boost | boost software license( version)? 1 0
bsl | 72 | 0.95 | boost | www boost org license 1 0( txt)?
artistic | 64 | 0.93 | artistic | (the )?artistic license( version)? 2 0
artistic | 60 | 0.9 | artistic | (the )?(clarified )?artistic license
artistic | 57 | 0.85 | perl | (under )?the same terms as perl( itself)?
psf | 64 | 0.93 | python | python software foundation license( version)?( 2)?
psf | 57 | 0.85 | beopen | beopen python open source license agreement
ruby | 57 | 0.85 | ruby | (under )?the same terms as ruby
php | 60 | 0.9 | php | (the )?php license( version)?( 3 01?)?
php | 56 | 0.85 | php | this product includes php software
vim | 54 | 0.85 | vim | (the )?vim (license|licence)
openssl | 60 | 0.9 | openssl | openssl (project for use in the openssl toolkit|license|licence)
openssl | 57 | 0.85 | eric | includes cryptographic software written by eric young
curl | 54 | 0.8 | curl | (the )?curl license
ntp | 52 | 0.8 | ntp | (the )?ntp license
icu | 54 | 0.85 | icu | icu license( icu 1 8 1 and later)?
unicode | 58 | 0.9 | unicode | unicode( inc)? license agreement data files and software
postgresql | 60 | 0.9 | postgresql | (the )?postgresql licen[sc]e
sqlite | 52 | 0.8 | blessing | the author disclaims copyright to this source code in place of a legal notice here is a blessing
tcl | 52 | 0.8 | tcl | tcl tk license
upl | 60 | 0.9 | universal | universal permissive license( v(ersion)?)?( ?1 0)?
ncsa | 60 | 0.9 | ncsa | (university of illinois )?ncsa open source license
afl | 56 | 0.85 | academic | academic free license( version)?( ?v?[123] [012])?
osl | 60 | 0.9 | open | open software license( version)?( ?v?[123] [012])?
ecl | 56 | 0.85 | educational | educational community license( version)?( 2 0)?
w3c | 58 | 0.9 | w3c | w3c software( notice| and document notice)?( and)? license
w3c | 52 | 0.8 | w3c | w3c document license
ofl | 66 | 0.95 | sil | sil open font license( version)?( 1 [01])?
ofl | 60 | 0.9 | font | licensed under the( sil)? open font license
ofl | 57 | 0.85 | reserved | reserved font name
ms-pl | 60 | 0.9 | microsoft | microsoft public license( ms pl)?
ms-rl | 60 | 0.9 | microsoft reciprocal | microsoft reciprocal license( ms rl)?
eupl | 62 | 0.93 | european | european union public licen[sc]e( v(ersion)?)?( ?1 [012])?
cecill | 62 | 0.9 | cecill | cecill( [abc])?( licen[sc]e| free software license agreement)?( version)?( v?[12]( [01])?)?
wtfpl | 60 | 0.9 | fuck wtfpl | (do what the fuck you want to public license|wtfpl( version)?( 2)?)
unlicense | 60 | 0.95 | unencumbered | (this is )?free and unencumbered software released into the public domain
unlicense | 57 | 0.9 | anyone | anyone is free to copy modify publish use compile sell or distribute this software
unlicense | 46 | 0.95 | unlicense | (the )?unlicense( org)?
beerware | 56 | 0.85 | beerware beer | (beer ?ware license( revision 42)?|buy me a beer in return)
jsonlicense | 58 | 0.9 | evil | the software shall be used for good not evil
zpl | 56 | 0.85 | zope | zope public license( zpl)?( version)?( ?[12] [01])?
sleepycat | 54 | 0.85 | sleepycat | (the )?sleepycat license
qpl | 54 | 0.85 | qpl q qt | (qpl|q public license|qt public license)( version)?( 1 0)?
rpl | 54 | 0.85 | reciprocal | reciprocal public license( version)?( ?1 [135])?
cpal | 54 | 0.85 | attribution | common public attribution license( version)?( 1 0)?
sspl | 62 | 0.93 | sspl server | (server side public license|sspl)( version)?( v?1)?
busl | 62 | 0.93 | busl business | (business source license|busl)( version)?( 1 1)?
elastic | 62 | 0.93 | elastic | elastic license( version)?( ?2 0)?
commons-clause | 62 | 0.93 | clause | commons clause( license)?( condition)?( v1 0)?
polyform | 60 | 0.9 | polyform | polyform (noncommercial|small business|strict|shield|perimeter)( license)?( 1 0 0)?
prosperity | 54 | 0.85 | prosperity | prosperity public license
openrail | 60 | 0.9 | openrail rail | ((creativeml |bigscience )?(open ?rail|rail)( m| s)?( \+\+)? license|openrail( m)?)
llama | 58 | 0.9 | llama | llama( [234]( [0-9])?)? community license( agreement)?
odbl | 62 | 0.93 | odbl database | (open (data commons )?(open )?database license|odbl)( v?1 0)?
odc-by | 60 | 0.9 | attribution odc | (open data commons attribution license|odc by)( v?1 0)?
pddl | 60 | 0.9 | pddl dedication | (open data commons )?(public domain dedication and license|pddl)( v?1 0)?
cc0 | 66 | 0.95 | cc0 creative | (cc0|creative commons zero)( v?1 0)?( universal)?( public domain dedication)?
cc0 | 72 | 0.95 | creativecommons | creativecommons org publicdomain zero 1 0
public-domain | 70 | 0.9 | creativecommons | creativecommons org publicdomain mark 1 0
cc-by | 72 | 0.95 | creativecommons | creativecommons org licenses by [1234] [05]
cc-by-sa | 73 | 0.95 | creativecommons | creativecommons org licenses by sa [1234] [05]
cc-by-nd | 73 | 0.95 | creativecommons | creativecommons org licenses by nd [1234] [05]
cc-by-nc | 73 | 0.95 | creativecommons | creativecommons org licenses by nc [1234] [05]
cc-by-nc-sa | 74 | 0.95 | creativecommons | creativecommons org licenses by nc sa [1234] [05]
cc-by-nc-nd | 74 | 0.95 | creativecommons | creativecommons org licenses by nc nd [1234] [05]
cc-by | 65 | 0.93 | attribution | creative commons attribution [1234] [05]( international| unported| generic)?( public)?( license)?
cc-by-sa | 66 | 0.93 | attribution | creative commons attribution share ?alike [1234] [05]( international| unported| generic)?( public)?( license)?
cc-by-nd | 66 | 0.93 | attribution | creative commons attribution no ?deriv(ative)?s [1234] [05]( international| unported| generic)?( public)?( license)?
cc-by-nc | 66 | 0.93 | attribution | creative commons attribution non ?commercial [1234] [05]( international| unported| generic)?( public)?( license)?
cc-by-nc-sa | 67 | 0.93 | attribution | creative commons attribution non ?commercial share ?alike [1234] [05]( international| unported| generic)?( public)?( license)?
cc-by-nc-nd | 67 | 0.93 | attribution | creative commons attribution non ?commercial no ?deriv(ative)?s [1234] [05]( international| unported| generic)?( public)?( license)?
public-domain | 58 | 0.85 | domain | (dedicated|released|placed|donated|contributed) (in|into|to) the public domain
public-domain | 45 | 0.7 | domain | (in|into|to) the public domain
public-domain | 56 | 0.8 | domain | this (file|work|code|software) is (in the )?public domain
us-government | 54 | 0.8 | government | (this is )?a work of the (us|u s|united states) government
proprietary | 50 | 0.9 | proprietary | proprietary and confidential
proprietary | 52 | 0.9 | unauthorized | unauthorized (copying|reproduction|use|distribution)( of this file)? (via any medium )?is strictly prohibited
proprietary | 48 | 0.8 | confidential | confidential and proprietary( information)?
proprietary | 50 | 0.85 | trade | contains( valuable)? trade secrets (of|and)
proprietary | 46 | 0.75 | permission | may not be (reproduced|copied|used|distributed) without( the)?( prior| express)?( written)? permission
eula | 54 | 0.85 | eula user | (end user license agreement|eula)
shareware | 50 | 0.8 | shareware | (this is |distributed as )?shareware
freeware | 50 | 0.8 | freeware | (this is |distributed as )?freeware
source-available | 48 | 0.75 | use | (for )?(non ?commercial|personal) use only
all-rights-reserved | 20 | 0.7 | reserved | all rights reserved
copyright | 10 | 0.3 | copyright | copyright( c)? (19|20)\d{2}( (19|20)\d{2})*
copyright | 12 | 0.35 | spdx | spdx filecopyrighttext
spdx | 85 | 0.9 | spdx | spdx license identifier
notice | 15 | 0.3 | licence license licences licenses | see (the )?(accompanying )?licen[sc]es?( md| txt| file)?( for| in)
"""
