"""The licence scan's signature rules: regular expressions over a text's words, joined by one space.

A licence has a name, an identifier and an address, written by hand below; the forms in which notices use them (identifier
line, grant, address, bare name) turn each into a rule. Notices and hints that are no form of a name are written out.
A rule's place in RULES decides between detections of the same words and priority.
"""

from __future__ import annotations

from dataclasses import dataclass

#: label | keyword (a word of every match of the name) | name | identifier | address (and its keyword)
LICENSES = r"""
apache-2.0 | apache | apache( software| public)?( license| licence)?( version| v)? (2 0|2|v2 0|v2) | apache 2 0( only)? | apache org licenses license 2 0
apache-1.1 | apache | apache software license( version)? 1 1 | apache 1 1 | apache org licenses license 1 1
apache-1.0 | apache | apache software license( version)? 1 0 | apache 1 0 | apache org licenses license 1 0
mit | mit | mit( expat| x11)? (license|licence) | mit | opensource org licen[sc]es? mit( license)?
mit-0 | mit | mit no attribution( license)? | mit 0 | opensource org licenses mit 0
x11 | x11 | x11 (license|licence) | x11 | xfree86 org( current)? license
isc | isc | isc (license|licence) | isc | opensource org licenses isc( license)?
bsd-2-clause | bsd | (simplified|freebsd|(2|two) clause) bsd( license| licence)?|bsd (2|two) clause( license| licence)? | bsd 2 clause | opensource org licenses bsd 2 clause
bsd-3-clause | bsd | (new|modified|revised|(3|three) clause) bsd( license| licence)?|bsd (3|three) clause( license| licence)? | bsd 3 clause | opensource org licenses bsd 3 clause
bsd-4-clause | bsd | (original|old|(4|four) clause) bsd( license| licence)?|bsd (4|four) clause( license| licence)? | bsd 4 clause | spdx org licenses bsd 4 clause
bsd-0-clause | bsd | (zero|0) clause bsd( license)?|bsd zero clause( license)? | 0bsd | opensource org licenses 0bsd
gpl-1.0 | public | (gnu )?general public license( version| v)? 1( 0)? | gpl 1 0( only| or later)? | gnu org licenses( old licenses)? gpl 1 0
gpl-2.0 | public | (gnu )?general public license( version| v)? 2( 0)? | gpl 2 0( only| or later)? | gnu org licenses( old licenses)? gpl 2 0
gpl-3.0 | public | (gnu )?general public license( version| v)? 3( 0)? | gpl 3 0( only| or later)? | gnu org licenses gpl( 3 0)?
lgpl-2.0 | lgpl | lgpl( version| v)? 2 0 | lgpl 2 0( only| or later)? | gnu org licenses( old licenses)? lgpl 2 0
lgpl-2.1 | lesser | (gnu )?lesser general public license( version| v)? 2 1 | lgpl 2 1( only| or later)? | gnu org licenses( old licenses)? lgpl 2 1
lgpl-3.0 | lesser | (gnu )?lesser general public license( version| v)? 3( 0)? | lgpl 3 0( only| or later)? | gnu org licenses lgpl( 3 0)?
lgpl | library | (gnu )?library general public license | lgpl | gnu org copyleft lesser
agpl-3.0 | affero | (gnu )?affero general public license( version| v)?( 3)?( 0)? | agpl 3 0( only| or later)? | gnu org licenses agpl( 3 0)?
agpl-1.0 | affero | affero general public license version 1 | agpl 1 0( only| or later)? | affero org oagpl
gfdl | documentation | (gnu )?free documentation license | gfdl 1 [123]( only| or later)? | gnu org licenses fdl( 1 [123])?
mpl-2.0 | mozilla | mozilla public license( version| v)? 2( 0)? | mpl 2 0 | mozilla org mpl 2 0
mpl-1.1 | mozilla | mozilla public license( version| v)? 1 1 | mpl 1 1 | mozilla org mpl 1 1
mpl-1.0 | mozilla | mozilla public license( version| v)? 1 0 | mpl 1 0 | mozilla org mpl mpl 1 0
epl-2.0 | eclipse | eclipse public license( version| v)? 2( 0)? | epl 2 0 | eclipse org legal epl( v)?( 2)?( 0)?
epl-1.0 | eclipse | eclipse public license( version| v)? 1( 0)? | epl 1 0 | eclipse org legal epl v10
edl-1.0 | eclipse | eclipse distribution license( version| v)?( 1 0)? | edl 1 0 | eclipse org org documents edl v10
cddl-1.0 | cddl | cddl( version| v)? 1( 0)? | cddl 1 0 | opensource org licenses cddl1
cddl-1.1 | cddl | cddl( version| v)? 1 1 | cddl 1 1 | glassfish java net public cddl
cddl | distribution | common development and distribution license | cddl | sun com cddl
cpl-1.0 | common | common public license( version)?( 1 0)? | cpl 1 0 | opensource org licenses cpl1
ipl-1.0 | ibm | ibm public license( version)?( 1 0)? | ipl 1 0 | opensource org licenses ibmpl
eupl-1.1 | union | european union public licen[sc]e( version| v)? 1 1 | eupl 1 1 | ec europa eu idabc eupl
eupl-1.2 | union | european union public licen[sc]e( version| v)? 1 2 | eupl 1 2 | joinup ec europa eu( \S+){0,6} eupl( \S+){0,2} 1 2
artistic-1.0 | artistic | artistic license( version)? 1( 0)? | artistic 1 0 | opensource org licenses artistic license 1 0
artistic-2.0 | artistic | artistic license( version)? 2( 0)? | artistic 2 0 | opensource org licenses artistic license 2 0
zlib | zlib | zlib( libpng)? (license|licence) | zlib | zlib net zlib license( html)?
libpng | libpng | libpng (license|licence) | libpng( 2 0)? | libpng org pub png src libpng license
bsl-1.0 | boost | boost software license( version)?( 1 0)? | bsl 1 0 | boost org license 1 0( txt)?
unlicense | unlicense | (the )?unlicense( license)? | unlicense | unlicense org
wtfpl | wtfpl | wtfpl( version)?( 2)? | wtfpl | wtfpl net
cc0-1.0 | cc0 | cc0( 1 0)?( universal)? | cc0 1 0 | creativecommons org publicdomain zero 1 0
cc-by-nc | nc | (cc|creative commons) by nc( [1234] [05])?(?: international)? | cc by nc [1234] [05] | creativecommons org licenses by nc [1234] [05]
cc-by-nc-sa | nc | (cc|creative commons) by nc sa( [1234] [05])?(?: international)? | cc by nc sa [1234] [05] | creativecommons org licenses by nc sa [1234] [05]
cc-by-nc-nd | nc | (cc|creative commons) by nc nd( [1234] [05])?(?: international)? | cc by nc nd [1234] [05] | creativecommons org licenses by nc nd [1234] [05]
cc-by-sa | sa | (cc|creative commons) by sa( [1234] [05])?(?: international)? | cc by sa [1234] [05] | creativecommons org licenses by sa [1234] [05]
cc-by-nd | nd | (cc|creative commons) by nd( [1234] [05])?(?: international)? | cc by nd [1234] [05] | creativecommons org licenses by nd [1234] [05]
cc-by-4.0 | cc | cc by( version)? 4 0(?: international)? | cc by 4 0 | creativecommons org licenses by 4 0
cc-by-3.0 | cc | cc by( version)? 3 0(?: unported)? | cc by 3 0 | creativecommons org licenses by 3 0
cc-by-2.5 | cc | cc by( version)? 2 5 | cc by 2 5 | creativecommons org licenses by 2 5
cc-attribution | attribution | creative commons attribution( [1234] [05])?( international| unported| generic)?( public)?( license| licence)? | cc by 1 0 | creativecommons org licenses by
cc-attribution-sa | attribution | creative commons attribution (sharealike|share alike)( [1234] [05])?( international| unported)?( license| licence)? | cc by sa 1 0 | creativecommons org licenses by sa
cc-attribution-nc | attribution | creative commons attribution (noncommercial|non commercial)( sharealike| share alike| noderivatives| no derivatives| noderivs)?( [1234] [05])?( international)?( license| licence)? | cc by nc 1 0 | creativecommons org licenses by nc
odbl | odbl | odbl( v)?( 1 0)? | odbl 1 0 | opendatacommons org licenses odbl
odc-by | odc | odc by( 1 0)? | odc by 1 0 | opendatacommons org licenses by
pddl | pddl | pddl( 1 0)? | pddl 1 0 | opendatacommons org licenses pddl
ofl-1.1 | font | (sil )?open font license( version| v)?( 1 1)? | ofl 1 1 | scripts sil org ofl
python-2.0 | python | python( software foundation)? license( version| agreement)?( 2)? | python 2 0|psf 2 0 | docs python org( 3)? license
ruby | ruby | ruby license|ruby s license | ruby | ruby lang org( en)?( about)? license
php-3.01 | php | php license( version| v)?( 3 0| 3 01)? | php 3 01 | php net license
postgresql | postgresql | postgresql (license|licence) | postgresql | postgresql org about licence
openssl | openssl | openssl (license|licence) | openssl | openssl org source license
curl | curl | curl license | curl | curl se docs copyright
ncsa | ncsa | (university of illinois )?ncsa( open source)? license | ncsa | opensource org licenses ncsa
w3c | w3c | w3c( software)?( notice and)? license | w3c( 20150513)? | w3 org consortium legal( \S+){0,3} copyright software
unicode | unicode | unicode( inc)? license( agreement)? | unicode dfs 201[56]|unicode 3 0 | unicode org (copyright|license)
vim | vim | vim license | vim | vimdoc sourceforge net( \S+){0,3} uganda
tcl | tcl | tcl tk license | tcl | tcl tk software tcltk license
json | json | json license | json | json org license
beerware | beerware | beerware( license)? | beerware | people freebsd org phk
afl-3.0 | academic | academic free license( version| v)?( [123] [012])? | afl 3 0 | opensource org licenses afl 3 0
osl-3.0 | open | open software license( version| v)?( [123] [01])? | osl 3 0 | opensource org licenses osl 3 0
qpl-1.0 | qpl | qpl( 1 0)? license | qpl 1 0 | opensource org licenses qpl
cecill | cecill | cecill( free software)?( license)?( agreement)?( [12] [01])? | cecill 2 1 | cecill info licences
ms-pl | microsoft | microsoft public license | ms pl | opensource org licenses ms pl
ms-rl | microsoft | microsoft reciprocal license | ms rl | opensource org licenses ms rl
sspl-1.0 | side | server side public license( version| v)?( 1)? | sspl 1 0 | mongodb com licensing server side public license
busl-1.1 | business | business source license( version)?( 1 1)? | busl 1 1 | mariadb com bsl11
elastic-2.0 | elastic | elastic license( version)?( 2 0| 2)? | elastic 2 0 | elastic co licensing elastic license
commons-clause | commons | commons clause( license condition)?( v1 0)? | commons clause | commonsclause com
openrail | openrail | (bigscience |creativeml )?openrail m?( license)? | openrail | licenses ai ai licenses
llama-community | llama | llama( [234])?( [123])? community license( agreement)? | llama( [234])?( [123])? community | llama com( \S+){0,2} license
"""

#: Keywords of grants, and the words before a name that make one.
GRANTS = {"licensed": r"(dual )?licensed( \S+)? under", "released": r"released( \S+)? under", "distributed": r"distributed( \S+)? under"}

#: label | priority | weight | keyword | pattern | "base" or nothing
NOTICES = r"""
mit | 1 | 0.95 | hereby | permission is hereby granted free of charge to any person obtaining a copy |
mit | 1 | 0.95 | noninfringement | fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable |
isc | 1 | 0.95 | hereby | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted |
bsd-3-clause | 1 | 0.95 | endorse | may be used to endorse or promote products derived from this software without specific prior written permission |
bsd-2-clause | 1 | 0.9 | redistributions | redistributions of source code must retain the above copyright notice |
bsd-2-clause | 1 | 0.9 | redistributions | redistributions in binary form must reproduce the above copyright notice |
bsd-4-clause | 1 | 0.95 | advertising | all advertising materials mentioning features or use of this software must display the following acknowledgement |
apache-2.0 | 1 | 0.95 | compliance | you may not use this file except in compliance with the license you may obtain a copy of the license at |
apache-2.0 | 1 | 0.9 | warranties | software distributed under the license is distributed on an as is basis without warranties or conditions of any kind |
gpl | 1 | 0.95 | redistribute | you can redistribute it and or modify it under the terms of the gnu general public license |
gpl-2.0 | 1 | 0.95 | either | general public license as published by the free software foundation either version 2 of the license or( at your option)? any later version |
gpl-3.0 | 1 | 0.95 | either | general public license as published by the free software foundation either version 3 of the license or( at your option)? any later version |
lgpl | 1 | 0.95 | lesser | under the terms of the gnu lesser general public license |
agpl-3.0 | 1 | 0.95 | affero | under the terms of the gnu affero general public license |
mpl-2.0 | 1 | 0.95 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0 |
epl | 1 | 0.9 | accompanying | this program and the accompanying materials are made available under the terms of the eclipse( public license)? |
zlib | 1 | 0.95 | misrepresented | the origin of this software must not be misrepresented |
zlib | 1 | 0.9 | implied | this software is provided as is without any express or implied warranty |
bsl-1.0 | 1 | 0.95 | boost | distributed under the boost software license version 1 0 |
unlicense | 1 | 0.95 | unencumbered | this is free and unencumbered software released into the public domain |
cc0-1.0 | 1 | 0.9 | waived | (has|have) waived all copyright and related or neighbou?ring rights |
cc-attribution | 2 | 0.8 | creative | licensed under( a| the)? creative commons attribution( [1234] [05])? |
public-domain | 2 | 0.8 | domain | (dedicated|released|placed)( \S+)? (to|into|in) the public domain |
proprietary | 2 | 0.7 | confidential | (confidential and proprietary|proprietary and confidential) |
proprietary | 2 | 0.7 | unauthorized | unauthorized (copying|use|reproduction|distribution)( \S+){0,8} is strictly prohibited |
proprietary | 2 | 0.6 | written | without( the)?( express)?( prior)? written (permission|consent) of |
no-redistribution | 2 | 0.6 | redistributed | may not be (published broadcast rewritten or )?redistributed |
gpl-2.0 | 3 | 0.6 | gplv2 | (gnu )?gplv2( license| licence)? |
gpl-3.0 | 3 | 0.6 | gplv3 | (gnu )?gplv3( license| licence)? |
gpl | 3 | 0.6 | gpl | (gnu )?gpl( license| licence)? |
gpl | 3 | 0.6 | general | general public license | base
cc-by | 3 | 0.6 | cc | cc by | base
copyright | 4 | 0.4 | copyright | copyright( c)? (19|20)\d\d( (19|20)\d\d)? |
copyright | 4 | 0.4 | copyright | copyright( c)?( \S+){1,4} all rights reserved |
reserved | 4 | 0.3 | reserved | all rights reserved | base
some-rights | 4 | 0.3 | reserved | some rights reserved |
license-file | 4 | 0.3 | license | see( the)? license( file| txt| md)?( for( \S+)?( license)? (details|information|terms)| in the project root) |
license-file | 4 | 0.3 | license | governing permissions and limitations under the license |
terms | 4 | 0.2 | terms | (subject to|see|read)( the| our)? terms (of use|of service|and conditions) |
"""


@dataclass(frozen=True)
class Signature:
    label: str
    priority: int  # 1 is the highest
    weight: float
    keyword: str
    pattern: str
    base: bool = False


def wrapped(words: str) -> str:
    """A pattern over words joined by one space, as one over a text in which a space of its own stands on either side of each word.

    Matches take whole words then, and neighbours share no space, so a plain scan finds adjoining ones as well.
    """
    return f" (?:{words.replace(r'\S', 'X').replace(r'\d', '[0-9]').replace(' ', '  ').replace('X', '[^ ]')}) "


def cells(table: str) -> list[list[str]]:
    return [[c.strip() for c in line.split(" | ")] for line in table.strip().split("\n")]


def signatures() -> tuple[Signature, ...]:
    """Notices first, then each licence's identifier, grants, address and bare name."""
    out = []
    for line in cells(NOTICES):
        label, priority, weight, keyword, pattern, base = (*line, "")[:6]
        out.append(Signature(label, int(priority), float(weight), keyword, wrapped(pattern.removesuffix("|").strip()), base == "base"))
    for label, keyword, name, identifier, address in cells(LICENSES):
        out.append(Signature(label, 1, 1.0, "spdx", wrapped(f"spdx license identifier ({identifier})")))
        for word, grant in GRANTS.items():
            out.append(Signature(label, 2, 0.9, word, wrapped(f"{grant}( the| an| a)?( terms of)?( the)? ({name})")))
        out.append(Signature(label, 2, 0.85, address.split(" ")[0].split("(")[0], wrapped(address)))
        out.append(Signature(label, 3, 0.6, keyword, wrapped(f"({name})")))
    return tuple(out)


RULES = signatures()
