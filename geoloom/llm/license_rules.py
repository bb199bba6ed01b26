"""Signature rules of licenses: label | priority | keyword | regex, in the order in which equal detections are settled.

The regexes are for words in lower case with one space between them, and begin and end at words. The keyword is a word without
which the regex cannot match. Priorities: 1 identifiers and whole notices, 2 grants and links, 3 names with a version, 4 bare names.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    number: int
    label: str
    priority: int
    keyword: str
    regex: str


RULES_TEXT = r"""
mit | 1 | spdx | spdx license identifier mit
mit | 1 | sublicense | use copy modify merge publish distribute sublicense and or sell copies of the software
mit | 1 | noninfringement | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
mit | 2 | mit | (?:released|licensed|distributed|available|provided|published)(?: under| subject to)(?: the)?(?: terms of)?(?: the)? mit(?: expat| x11)? licen[sc]e
mit | 2 | mit | opensource org licenses mit(?: license)?(?: php| html)?
mit | 2 | mit | choosealicense com licenses mit
mit | 2 | mit | licen[sc]e(?: type)? mit
mit | 3 | mit | (?:the )?mit licen[sc]e(?: mit)?
mit | 3 | mit | (?:the )?mit(?: x11| expat) licen[sc]e
mit | 4 | expat | (?:the )?expat licen[sc]e
mit-0 | 1 | spdx | spdx license identifier mit 0
mit-0 | 2 | mit | opensource org licenses mit 0
mit-0 | 3 | mit | mit(?: 0| no attribution)(?: licen[sc]e)?
x11 | 1 | spdx | spdx license identifier x11
x11 | 3 | x11 | (?:the )?x11 licen[sc]e
isc | 1 | spdx | spdx license identifier isc
isc | 1 | fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 2 | isc | opensource org licenses isc(?: license)?(?: txt)?
isc | 2 | isc | (?:released|licensed|distributed|available) under(?: the)?(?: terms of the)? isc licen[sc]e
isc | 3 | isc | (?:the )?isc licen[sc]e
apache-1-1 | 1 | spdx | spdx license identifier apache 1 1
apache-1-1 | 3 | apache | (?:the )?apache(?: software)? licen[sc]e(?: version)? 1 1
apache-1-0 | 1 | spdx | spdx license identifier apache 1 0
apache-1-0 | 3 | apache | (?:the )?apache(?: software)? licen[sc]e(?: version)? 1 0
apache-2 | 1 | spdx | spdx license identifier apache 2 0
apache-2 | 1 | apache | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2 | 2 | apache | (?:released|licensed|distributed|available|provided) under(?: the)?(?: terms of)?(?: the)? apache(?: software)? licen[sc]e(?: version| v)? v?2(?: 0)?
apache-2 | 2 | apache | (?:www )?apache org licenses license 2 0(?: txt| html)?
apache-2 | 2 | apache | opensource org licenses apache 2 0
apache-2 | 3 | apache | (?:the )?apache(?: software)? licen[sc]e(?: version)? v?2(?: 0)?
apache-2 | 3 | apache | apache v?2(?: 0)?(?: licen[sc]e)?
apache-2 | 4 | asl | asl v?2(?: 0)?
apache | 4 | apache | (?:the )?apache(?: software)? licen[sc]e
llvm-exception | 1 | llvm | apache 2 0 with llvm exception
llvm-exception | 2 | llvm | (?:apache license v2 0 )?with llvm exceptions?
bsd-0 | 1 | spdx | spdx license identifier 0bsd
bsd-0 | 3 | bsd | (?:zero clause|0 clause|bsd zero clause) bsd(?: licen[sc]e)?
bsd-2 | 1 | spdx | spdx license identifier bsd 2 clause(?: freebsd| patent)?
bsd-2 | 2 | bsd | opensource org licenses bsd 2 clause
bsd-2 | 3 | bsd | (?:the )?(?:2|two) clause bsd(?: style)? licen[sc]e
bsd-2 | 3 | bsd | (?:the )?bsd (?:2|two) clause(?: simplified)?(?: licen[sc]e)?
bsd-2 | 3 | bsd | (?:the )?simplified bsd licen[sc]e
bsd-2 | 3 | freebsd | (?:the )?freebsd licen[sc]e
bsd-3 | 1 | spdx | spdx license identifier bsd 3 clause(?: clear)?
bsd-3 | 1 | endorse | neither the name of [^.]+(?: [^.]+){0,8} nor the names of its contributors may be used to endorse or promote products derived from this software
bsd-3 | 2 | bsd | opensource org licenses bsd 3 clause
bsd-3 | 3 | bsd | (?:the )?(?:3|three) clause bsd(?: style)? licen[sc]e
bsd-3 | 3 | bsd | (?:the )?bsd (?:3|three) clause(?: new| revised| clear)?(?: licen[sc]e)?
bsd-3 | 3 | bsd | (?:the )?(?:new|modified|revised) bsd licen[sc]e
bsd-4 | 1 | spdx | spdx license identifier bsd 4 clause
bsd-4 | 1 | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-4 | 3 | bsd | (?:the )?(?:4|four) clause bsd licen[sc]e
bsd-4 | 3 | bsd | (?:the )?(?:original|old) bsd licen[sc]e
bsd | 1 | redistributions | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | 2 | bsd | (?:released|licensed|distributed|available) under(?: the)?(?: terms of the)? bsd(?: style)? licen[sc]e
bsd | 4 | bsd | (?:the )?bsd(?: style)? licen[sc]e
gpl-1 | 1 | spdx | spdx license identifier gpl 1 0(?: only)?
gpl-1 | 3 | gnu | (?:the )?gnu general public licen[sc]e(?: version| v)? v?1(?: 0)?
gpl-2 | 1 | spdx | spdx license identifier gpl 2 0(?: only)?
gpl-2 | 2 | gpl | (?:www )?gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt| en)?
gpl-2 | 3 | gnu | (?:the )?gnu general public licen[sc]e(?: gpl)?(?: version| v)? v?2(?: 0)?(?: only)?
gpl-2 | 3 | gpl | (?:the )?(?:gnu )?gpl(?: version| v)? v?2(?: 0)?(?: only)?
gpl-2 | 3 | gplv2 | (?:the )?(?:gnu )?gplv2(?: 0)?(?: only)?
gpl-2 | 3 | gpl2 | gpl2
gpl-2-or-later | 1 | spdx | spdx license identifier gpl 2 0 or later
gpl-2-or-later | 1 | gnu | gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-2-or-later | 3 | gnu | (?:the )?gnu general public licen[sc]e(?: version| v)? v?2(?: 0)? or(?: any)? later(?: version)?
gpl-2-or-later | 3 | gpl | gpl(?: version| v)? v?2(?: 0)? or(?: any)? later(?: version)?
gpl-2-or-later | 3 | gplv2 | gplv2 or(?: any)? later
gpl-3 | 1 | spdx | spdx license identifier gpl 3 0(?: only)?
gpl-3 | 2 | gpl | (?:www )?gnu org licenses gpl 3 0(?: html| txt| en)?
gpl-3 | 2 | gnu | (?:released|licensed|distributed|available) under(?: the)?(?: terms of the)? gnu general public licen[sc]e(?: gpl)?(?: version| v)? v?3(?: 0)?
gpl-3 | 3 | gnu | (?:the )?gnu general public licen[sc]e(?: gpl)?(?: version| v)? v?3(?: 0)?(?: only)?
gpl-3 | 3 | gpl | (?:the )?(?:gnu )?gpl(?: version| v)? v?3(?: 0)?(?: only)?
gpl-3 | 3 | gplv3 | (?:the )?(?:gnu )?gplv3(?: 0)?(?: only)?
gpl-3 | 3 | gpl3 | gpl3
gpl-3-or-later | 1 | spdx | spdx license identifier gpl 3 0 or later
gpl-3-or-later | 1 | gnu | gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-3-or-later | 3 | gnu | (?:the )?gnu general public licen[sc]e(?: version| v)? v?3(?: 0)? or(?: any)? later(?: version)?
gpl-3-or-later | 3 | gpl | gpl(?: version| v)? v?3(?: 0)? or(?: any)? later(?: version)?
gpl-3-or-later | 3 | gplv3 | gplv3 or(?: any)? later
gpl | 2 | gnu | (?:released|licensed|distributed|available) under(?: the)?(?: terms of the)? gnu general public licen[sc]e
gpl | 4 | gnu | (?:the )?gnu general public licen[sc]e
gpl | 4 | gpl | (?:under|the|gnu)(?: the)? gpl(?: licen[sc]e)?
gpl | 4 | gpl | gpl licen[sc]e
classpath-exception | 1 | classpath | (?:gpl 2 0 )?with classpath exception(?: 2 0)?
classpath-exception | 3 | classpath | classpath exception
gcc-exception | 1 | gcc | (?:gpl 3 0 (?:or later )?)?with gcc exception(?: 3 1)?
gcc-exception | 3 | gcc | gcc runtime library exception
linking-exception | 3 | linking | (?:gpl )?linking exception
font-exception | 3 | font | (?:gpl )?font exception
lgpl-2 | 1 | spdx | spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2 | 3 | gnu | (?:the )?gnu library general public licen[sc]e(?: version| v)? v?2(?: 0)?
lgpl-2-1 | 1 | spdx | spdx license identifier lgpl 2 1(?: only)?
lgpl-2-1 | 2 | lgpl | (?:www )?gnu org licenses (?:old licenses )?lgpl 2 1(?: html| txt| en)?
lgpl-2-1 | 3 | gnu | (?:the )?gnu lesser general public licen[sc]e(?: lgpl)?(?: version| v)? v?2 1
lgpl-2-1 | 3 | lgpl | (?:the )?(?:gnu )?lgpl(?: version| v)? v?2 1
lgpl-2-1 | 3 | lgplv2 | (?:the )?(?:gnu )?lgplv2(?: 1)?
lgpl-2-1-or-later | 1 | spdx | spdx license identifier lgpl 2 1 or later
lgpl-2-1-or-later | 1 | gnu | gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
lgpl-3 | 1 | spdx | spdx license identifier lgpl 3 0(?: only)?
lgpl-3 | 2 | lgpl | (?:www )?gnu org licenses lgpl 3 0(?: html| txt| en)?
lgpl-3 | 3 | gnu | (?:the )?gnu lesser general public licen[sc]e(?: lgpl)?(?: version| v)? v?3(?: 0)?
lgpl-3 | 3 | lgpl | (?:the )?(?:gnu )?lgpl(?: version| v)? v?3(?: 0)?
lgpl-3 | 3 | lgplv3 | (?:the )?(?:gnu )?lgplv3(?: 0)?
lgpl-3-or-later | 1 | spdx | spdx license identifier lgpl 3 0 or later
lgpl-3-or-later | 1 | gnu | gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl | 4 | gnu | (?:the )?gnu (?:lesser|library) general public licen[sc]e
lgpl | 4 | lesser | (?:the )?lesser general public licen[sc]e
lgpl | 4 | lgpl | (?:the )?(?:gnu )?lgpl(?: licen[sc]e)?
agpl-3 | 1 | spdx | spdx license identifier agpl 3 0(?: only)?
agpl-3 | 2 | agpl | (?:www )?gnu org licenses agpl 3 0(?: html| txt| en)?
agpl-3 | 3 | affero | (?:the )?gnu affero general public licen[sc]e(?: agpl)?(?: version| v)? v?3(?: 0)?
agpl-3 | 3 | agpl | (?:the )?(?:gnu )?agpl(?: version| v)? v?3(?: 0)?
agpl-3 | 3 | agplv3 | (?:the )?(?:gnu )?agplv3(?: 0)?
agpl-3-or-later | 1 | spdx | spdx license identifier agpl 3 0 or later
agpl-3-or-later | 1 | affero | gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
agpl | 4 | affero | (?:the )?(?:gnu )?affero general public licen[sc]e
agpl | 4 | agpl | (?:the )?(?:gnu )?agpl(?: licen[sc]e)?
gfdl-1-1 | 1 | spdx | spdx license identifier gfdl 1 1(?: only| or later)?
gfdl-1-2 | 1 | spdx | spdx license identifier gfdl 1 2(?: only| or later)?
gfdl-1-2 | 3 | gnu | (?:the )?gnu free documentation licen[sc]e(?: version| v)? 1 2
gfdl-1-3 | 1 | spdx | spdx license identifier gfdl 1 3(?: only| or later)?
gfdl-1-3 | 2 | fdl | (?:www )?gnu org licenses fdl 1 3(?: html| txt| en)?
gfdl-1-3 | 3 | gnu | (?:the )?gnu free documentation licen[sc]e(?: version| v)? 1 3
gfdl | 1 | invariant | with no invariant sections no front cover texts and no back cover texts
gfdl | 4 | gnu | (?:the )?gnu free documentation licen[sc]e
gfdl | 4 | gfdl | gfdl
mpl-1-0 | 1 | spdx | spdx license identifier mpl 1 0
mpl-1-0 | 3 | mozilla | (?:the )?mozilla public licen[sc]e(?: version| v)? v?1 0
mpl-1-1 | 1 | spdx | spdx license identifier mpl 1 1
mpl-1-1 | 3 | mozilla | (?:the )?mozilla public licen[sc]e(?: version| v)? v?1 1
mpl-1-1 | 3 | mpl | mpl(?: version| v)? v?1 1
mpl-2 | 1 | spdx | spdx license identifier mpl 2 0(?: no copyleft exception)?
mpl-2 | 1 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2 | 2 | mozilla | (?:www )?mozilla org mpl 2 0
mpl-2 | 3 | mozilla | (?:the )?mozilla public licen[sc]e(?: version| v)? v?2(?: 0)?
mpl-2 | 3 | mpl | mpl(?: version| v)? v?2(?: 0)?
mpl | 4 | mozilla | (?:the )?mozilla public licen[sc]e
epl-1 | 1 | spdx | spdx license identifier epl 1 0
epl-1 | 2 | eclipse | (?:www )?eclipse org legal epl v10(?: html)?
epl-1 | 3 | eclipse | (?:the )?eclipse public licen[sc]e(?: version| v)? v?1(?: 0)?
epl-2 | 1 | spdx | spdx license identifier epl 2 0
epl-2 | 2 | eclipse | (?:www )?eclipse org legal epl 2 0
epl-2 | 3 | eclipse | (?:the )?eclipse public licen[sc]e(?: version| v)? v?2(?: 0)?
epl | 4 | eclipse | (?:the )?eclipse public licen[sc]e
edl | 3 | eclipse | (?:the )?eclipse distribution licen[sc]e(?: v| version)?(?: 1 0)?
cpl | 1 | spdx | spdx license identifier cpl 1 0
cpl | 3 | common | (?:the )?common public licen[sc]e(?: version| v)?(?: 1 0)?
cddl-1-0 | 1 | spdx | spdx license identifier cddl 1 0
cddl-1-1 | 1 | spdx | spdx license identifier cddl 1 1
cddl | 3 | cddl | cddl(?: version| v)?(?: 1 [01])?
cddl | 3 | distribution | (?:the )?common development and distribution licen[sc]e(?: cddl)?(?: version| v)?(?: 1 [01])?
eupl-1-1 | 1 | spdx | spdx license identifier eupl 1 1
eupl-1-2 | 1 | spdx | spdx license identifier eupl 1 2
eupl-1-2 | 3 | eupl | eupl(?: version| v)? v?1 2
eupl | 4 | eupl | (?:the )?eupl
eupl | 4 | european | (?:the )?european union public licen[sc]e
artistic-1 | 1 | spdx | spdx license identifier artistic 1 0(?: perl| cl8)?
artistic-2 | 1 | spdx | spdx license identifier artistic 2 0
artistic-2 | 3 | artistic | (?:the )?artistic licen[sc]e(?: version| v)? 2(?: 0)?
artistic | 4 | artistic | (?:the )?(?:perl )?artistic licen[sc]e
zlib | 1 | spdx | spdx license identifier zlib
zlib | 1 | misrepresented | the origin of this software must not be misrepresented
zlib | 3 | zlib | (?:the )?zlib(?: libpng)? licen[sc]e
libpng | 3 | libpng | (?:the )?libpng licen[sc]e
boost | 1 | spdx | spdx license identifier bsl 1 0
boost | 2 | boost | (?:www )?boost org license 1 0(?: txt)?
boost | 3 | boost | (?:the )?boost software licen[sc]e(?: version| v)?(?: 1 0)?
unlicense | 1 | spdx | spdx license identifier unlicense
unlicense | 1 | unencumbered | this is free and unencumbered software released into the public domain
unlicense | 2 | unlicense | unlicense org
unlicense | 4 | unlicense | the unlicense
wtfpl | 1 | spdx | spdx license identifier wtfpl
wtfpl | 3 | wtfpl | (?:the )?wtfpl(?: v2| version 2)?
cc0 | 1 | spdx | spdx license identifier cc0 1 0
cc0 | 2 | publicdomain | (?:https |http )?creativecommons org publicdomain zero 1 0
cc0 | 3 | cc0 | (?:creative commons )?cc0(?: 1 0)?(?: universal)?
cc0 | 3 | creative | creative commons zero(?: v?1 0)?(?: universal)?
public-domain | 2 | creativecommons | (?:https |http )?creativecommons org publicdomain mark 1 0
public-domain | 3 | domain | (?:dedicated|released|placed) (?:to|into|in) the public domain
public-domain | 4 | domain | (?:is|are) in the public domain
pddl | 1 | spdx | spdx license identifier pddl 1 0
pddl | 3 | domain | (?:odc )?public domain dedication and licen[sc]e(?: pddl)?
odbl | 1 | spdx | spdx license identifier odbl 1 0
odbl | 2 | opendatacommons | opendatacommons org licenses odbl(?: 1 0)?
odbl | 3 | database | (?:the )?open database licen[sc]e(?: odbl)?(?: v?1 0)?
odbl | 4 | odbl | (?:the )?odbl
odc-by | 1 | spdx | spdx license identifier odc by 1 0
odc-by | 2 | opendatacommons | opendatacommons org licenses by(?: 1 0)?
odc-by | 3 | odc | odc(?: by| attribution licen[sc]e)
cc-by-1 | 1 | spdx | spdx license identifier cc by 1 0
cc-by-2 | 1 | spdx | spdx license identifier cc by 2 0
cc-by-2 | 3 | cc | cc by 2 0
cc-by-3 | 1 | spdx | spdx license identifier cc by 3 0
cc-by-3 | 2 | creativecommons | creativecommons org licenses by 3 0
cc-by-3 | 3 | cc | cc by 3 0(?: unported)?
cc-by-4 | 1 | spdx | spdx license identifier cc by 4 0
cc-by-4 | 2 | creativecommons | creativecommons org licenses by 4 0
cc-by-4 | 3 | cc | cc by 4(?: 0)?(?: international)?
cc-by-4 | 3 | creative | creative commons attribution 4 0(?: international)?(?: licen[sc]e)?
cc-by | 4 | cc | cc by
cc-by | 4 | creative | creative commons attribution(?: licen[sc]e)?
cc-by-sa-3 | 1 | spdx | spdx license identifier cc by sa 3 0
cc-by-sa-3 | 2 | creativecommons | creativecommons org licenses by sa 3 0
cc-by-sa-3 | 3 | cc | cc by sa 3 0(?: unported)?
cc-by-sa-3 | 3 | creative | creative commons attribution share ?alike 3 0(?: unported)?(?: licen[sc]e)?
cc-by-sa-4 | 1 | spdx | spdx license identifier cc by sa 4 0
cc-by-sa-4 | 2 | creativecommons | creativecommons org licenses by sa 4 0
cc-by-sa-4 | 3 | cc | cc by sa 4(?: 0)?(?: international)?
cc-by-sa-4 | 3 | creative | creative commons attribution share ?alike 4 0(?: international)?(?: licen[sc]e)?
cc-by-sa | 4 | cc | cc by sa
cc-by-sa | 4 | creative | creative commons attribution share ?alike(?: licen[sc]e)?
cc-by-nd-3 | 1 | spdx | spdx license identifier cc by nd 3 0
cc-by-nd-4 | 1 | spdx | spdx license identifier cc by nd 4 0
cc-by-nd-4 | 2 | creativecommons | creativecommons org licenses by nd 4 0
cc-by-nd-4 | 3 | cc | cc by nd 4(?: 0)?(?: international)?
cc-by-nd | 4 | cc | cc by nd
cc-by-nd | 4 | creative | creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: licen[sc]e)?
cc-by-nc-3 | 1 | spdx | spdx license identifier cc by nc 3 0
cc-by-nc-3 | 3 | cc | cc by nc 3 0(?: unported)?
cc-by-nc-4 | 1 | spdx | spdx license identifier cc by nc 4 0
cc-by-nc-4 | 2 | creativecommons | creativecommons org licenses by nc 4 0
cc-by-nc-4 | 3 | cc | cc by nc 4(?: 0)?(?: international)?
cc-by-nc-4 | 3 | creative | creative commons attribution non ?commercial 4 0(?: international)?(?: licen[sc]e)?
cc-by-nc | 4 | cc | cc by nc
cc-by-nc | 4 | creative | creative commons attribution non ?commercial(?: licen[sc]e)?
cc-by-nc-sa-3 | 1 | spdx | spdx license identifier cc by nc sa 3 0
cc-by-nc-sa-4 | 1 | spdx | spdx license identifier cc by nc sa 4 0
cc-by-nc-sa-4 | 2 | creativecommons | creativecommons org licenses by nc sa 4 0
cc-by-nc-sa-4 | 3 | cc | cc by nc sa 4(?: 0)?(?: international)?
cc-by-nc-sa | 4 | cc | cc by nc sa
cc-by-nc-sa | 4 | creative | creative commons attribution non ?commercial share ?alike(?: 4 0| 3 0)?(?: international| unported)?(?: licen[sc]e)?
cc-by-nc-nd-4 | 1 | spdx | spdx license identifier cc by nc nd 4 0
cc-by-nc-nd-4 | 2 | creativecommons | creativecommons org licenses by nc nd 4 0
cc-by-nc-nd-4 | 3 | cc | cc by nc nd 4(?: 0)?(?: international)?
cc-by-nc-nd | 4 | cc | cc by nc nd
cc-by-nc-nd | 4 | creative | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: 4 0| 3 0)?(?: international| unported)?(?: licen[sc]e)?
python-2 | 1 | spdx | spdx license identifier python 2 0
python-2 | 3 | psf | (?:the )?psf licen[sc]e(?: agreement)?(?: version 2)?
python-2 | 3 | python | (?:the )?python software foundation licen[sc]e(?: agreement)?(?: version 2)?
ruby | 1 | spdx | spdx license identifier ruby
ruby | 3 | ruby | (?:the )?ruby licen[sc]e
php | 1 | spdx | spdx license identifier php 3 0?1
php | 3 | php | (?:the )?php licen[sc]e(?: version)?(?: 3 0?1)?
ofl-1-1 | 1 | spdx | spdx license identifier ofl 1 1
ofl-1-1 | 2 | ofl | scripts sil org ofl
ofl-1-1 | 3 | sil | (?:the )?sil open font licen[sc]e(?: version| v)?(?: 1 1)?
postgresql | 1 | spdx | spdx license identifier postgresql
postgresql | 3 | postgresql | (?:the )?postgresql licen[sc]e
openssl | 1 | spdx | spdx license identifier openssl
openssl | 3 | openssl | (?:the )?openssl licen[sc]e
curl | 1 | spdx | spdx license identifier curl
ncsa | 1 | spdx | spdx license identifier ncsa
ncsa | 3 | ncsa | (?:the )?(?:university of illinois )?ncsa open source licen[sc]e
upl | 1 | spdx | spdx license identifier upl 1 0
upl | 3 | universal | (?:the )?universal permissive licen[sc]e(?: upl)?(?: version 1 0)?
afl-3 | 1 | spdx | spdx license identifier afl 3 0
afl-3 | 3 | academic | (?:the )?academic free licen[sc]e(?: version| v)?(?: 3 0)?
osl-3 | 1 | spdx | spdx license identifier osl 3 0
osl-3 | 3 | osl | (?:the )?osl(?: v)? v?3 0
ms-pl | 1 | spdx | spdx license identifier ms pl
ms-pl | 3 | microsoft | (?:the )?microsoft public licen[sc]e(?: ms pl)?
ms-rl | 1 | spdx | spdx license identifier ms rl
ms-rl | 3 | microsoft | (?:the )?microsoft reciprocal licen[sc]e(?: ms rl)?
sspl | 1 | spdx | spdx license identifier sspl 1 0
sspl | 3 | server | (?:the )?server side public licen[sc]e(?: sspl)?(?: version 1)?
busl-1-1 | 1 | spdx | spdx license identifier busl 1 1
busl-1-1 | 3 | business | (?:the )?business source licen[sc]e(?: busl| bsl)?(?: version)?(?: 1 1)?
elastic-2 | 1 | spdx | spdx license identifier elastic 2 0
elastic-2 | 3 | elastic | (?:the )?elastic licen[sc]e(?: version| v)?(?: 2(?: 0)?)?
openrail | 3 | openrail | (?:creativeml |bigscience )?openrail(?: m| pp m)?(?: licen[sc]e)?
openrail | 3 | rail | (?:bigscience |responsible ai )?rail(?: 1 0)? licen[sc]e
bsl-commons | 3 | commons | commons clause(?: licen[sc]e)?(?: condition)?(?: v1 0)?
proprietary | 3 | reserved | all rights reserved
proprietary | 2 | proprietary | (?:confidential and proprietary|proprietary and confidential)
proprietary | 3 | reproduced | no part of this (?:publication|work|book|document) may be reproduced
"""

RULES: tuple[Rule, ...] = tuple(
    Rule(k, label.strip(), int(priority), keyword.strip(), regex.strip())
    for k, (label, priority, keyword, regex) in enumerate(line.split(" | ", 3) for line in RULES_TEXT.strip().split("\n"))
)
