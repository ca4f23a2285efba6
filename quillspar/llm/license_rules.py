"""The signature rules of the license scan, one a line: label, keyword, priority and a regex written for that wording.

The regexes run over lower-case words joined by single spaces, and match whole words; the word "license" stands for both
spellings.
Priorities: 1 texts of grants and their conditions, 2 statements of license, 3 identifiers, 4 terms of use, 5 names with a
version, 6 names, 7 hints. A rule's keyword is a word that each of its matches holds, alone or with a version joined on.
"""

#: What a detection of each priority is worth.
WEIGHTS = {1: 0.98, 2: 0.95, 3: 0.95, 4: 0.8, 5: 0.85, 6: 0.7, 7: 0.3}

SIGNATURES = r"""
mit hereby 1 permission is hereby granted free of charge to any person obtaining a copy(?: of this software and associated documentation files)?
mit notice 1 the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit noninfringement 1 without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
mit-0 hereby 1 permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
mit mit 2 (?:is )?(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?mit(?: x11)?(?: license)?
mit mit 3 spdx license identifier mit
mit mit 5 mit style license
mit mit 6 (?:the )?mit license
mit expat 6 expat license
mit-0 mit 3 spdx license identifier mit 0
mit-0 mit 5 mit no attribution(?: license)?
x11 x11 6 (?:mit )?x11 license
x11 consortium 1 except as contained in this notice the name of the x consortium shall not be used in advertising
bsd-2-clause redistribution 1 redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-2-clause redistributions 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd-2-clause redistributions 1 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution
bsd-3-clause endorse 1 neither the names? of (?:\S+ ){1,12}nor the names of (?:its|their|the) contributors may be used to endorse or promote products derived from this software(?: without specific prior written permission)?
bsd-3-clause endorse 1 the name of (?:the author|\S+) may not be used to endorse or promote products derived from this software
bsd-4-clause advertising 1 all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-2-clause bsd 3 spdx license identifier bsd 2 clause
bsd-3-clause bsd 3 spdx license identifier bsd 3 clause
bsd-4-clause bsd 3 spdx license identifier bsd 4 clause
bsd-2-clause bsd 5 (?:2|two) clause bsd(?: license)?
bsd-2-clause bsd 5 bsd 2 clause(?: license)?
bsd-2-clause bsd 5 simplified bsd(?: license)?
bsd-2-clause freebsd 5 freebsd license
bsd-3-clause bsd 5 (?:3|three) clause bsd(?: license)?
bsd-3-clause bsd 5 bsd 3 clause(?: license)?
bsd-3-clause bsd 5 (?:new|revised|modified) bsd(?: license)?
bsd-4-clause bsd 5 (?:4|four) clause bsd(?: license)?
bsd-4-clause bsd 5 (?:original|old) bsd license
bsd-0-clause bsd 5 (?:0|zero) clause bsd(?: license)?
bsd-0-clause 0bsd 3 (?:spdx license identifier )?0bsd
bsd bsd 2 (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?bsd(?: style)? license
bsd bsd 6 bsd(?: style| type)? license
isc purpose 1 permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc isc 2 (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?isc(?: license)?
isc isc 3 spdx license identifier isc
isc isc 6 isc license
zlib altered 1 altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib origin 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib zlib 2 (?:licensed|released|distributed|available) under (?:the )?zlib(?: libpng)? license
zlib zlib 3 spdx license identifier zlib
zlib zlib 6 zlib(?: libpng)? license
apache-2.0 apache 1 licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2.0 apache 1 you may obtain a copy of the license at https? www apache org licenses license 2 0
apache-2.0 apache 1 subject to the terms and conditions of this license each contributor hereby grants to you (?:\S+ ){0,20}apache
apache-2.0 apache 2 (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)?(?: license)?
apache-2.0 apache 3 spdx license identifier apache 2 0
apache-2.0 apache 5 apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)?(?: license)?
apache-1.1 apache 5 apache(?: software)?(?: license)?(?: version| v)? ?1 1
apache-1.0 apache 5 apache(?: software)?(?: license)?(?: version| v)? ?1 0
apache-unversioned apache 2 (?:licensed|released|distributed|available) under (?:the )?apache license
apache-unversioned apache 6 apache(?: software)? license
gpl-unversioned redistribute 1 you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation
gpl-2.0 version 1 gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3.0 version 1 gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2.0 version 1 gnu general public license version 2 as published by the free software foundation
gpl-unversioned gnu 1 you should have received a copy of the gnu general public license along with this (?:program|software|library|package|file)
gpl-unversioned gnu 4 see the gnu general public license for more details
gpl-2.0 gpl 2 (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl(?: version| v|v)? ?2(?: 0)?(?: only| or later)?
gpl-3.0 gpl 2 (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl(?: version| v|v)? ?3(?: 0)?(?: only| or later)?
gpl-1.0 gpl 3 spdx license identifier gpl 1 0(?: only| or later)?
gpl-2.0 gpl 3 spdx license identifier gpl 2 0(?: only| or later)?
gpl-3.0 gpl 3 spdx license identifier gpl 3 0(?: only| or later)?
gpl-1.0 gpl 5 (?:gnu )?gpl(?: version| v|v)? ?1(?: 0)?(?: only| or later)?
gpl-2.0 gpl 5 (?:gnu )?gpl(?: version| v|v)? ?2(?: 0)?(?: only| or later)?
gpl-3.0 gpl 5 (?:gnu )?gpl(?: version| v|v)? ?3(?: 0)?(?: only| or later)?
gpl-2.0 general 5 (?:gnu )?general public license(?: gpl)?(?: version| v)? ?2(?: 0)?(?: only| or later)?
gpl-3.0 general 5 (?:gnu )?general public license(?: gpl)?(?: version| v)? ?3(?: 0)?(?: only| or later)?
gpl-unversioned gnu 6 gnu (?:gpl|general public license)
gpl-unversioned gpl 6 (?:the )?gpl license
gpl-classpath-exception linking 1 linking this library statically or dynamically with other modules is making a combined work based on this library
gpl-classpath-exception classpath 3 with classpath exception(?: 2 0)?
gpl-linking-exception executable 1 as a special exception (?:\S+ ){0,24}link (?:\S+ ){0,16}executable
lgpl-2.1 lesser 1 gnu lesser general public license as published by the free software foundation either version 2 1 of the license
lgpl-3.0 lesser 1 gnu lesser general public license as published by the free software foundation either version 3 of the license
lgpl-2.0 library 1 gnu library general public license as published by the free software foundation either version 2 of the license
lgpl-2.1 lgpl 2 (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?lgpl(?: version| v|v)? ?2 1
lgpl-3.0 lgpl 2 (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?lgpl(?: version| v|v)? ?3(?: 0)?
lgpl-2.0 lgpl 3 spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2.1 lgpl 3 spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3.0 lgpl 3 spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-2.1 lgpl 5 (?:gnu )?lgpl(?: version| v|v)? ?2 1(?: only| or later)?
lgpl-3.0 lgpl 5 (?:gnu )?lgpl(?: version| v|v)? ?3(?: 0)?(?: only| or later)?
lgpl-2.1 lesser 5 (?:gnu )?lesser general public license(?: version| v)? ?2 1
lgpl-3.0 lesser 5 (?:gnu )?lesser general public license(?: version| v)? ?3(?: 0)?
lgpl-2.0 library 5 (?:gnu )?library general public license(?: version| v)? ?2(?: 0)?
lgpl-unversioned lesser 6 (?:gnu )?lesser general public license
lgpl-unversioned lgpl 6 (?:gnu )?lgpl(?: license)?
agpl-3.0 affero 1 gnu affero general public license as published by the free software foundation either version 3 of the license
agpl-3.0 agpl 2 (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?agpl(?: version| v|v)? ?3(?: 0)?
agpl-3.0 agpl 3 spdx license identifier agpl 3 0(?: only| or later)?
agpl-3.0 agpl 5 (?:gnu )?agpl(?: version| v|v)? ?3(?: 0)?(?: only| or later)?
agpl-3.0 affero 5 (?:gnu )?affero general public license(?: version| v)? ?3(?: 0)?
agpl-1.0 affero 5 affero general public license(?: version| v)? ?1(?: 0)?
agpl-unversioned affero 6 (?:gnu )?affero general public license
gfdl invariant 1 permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license (?:\S+ ){0,30}invariant sections
gfdl-1.3 documentation 5 gnu free documentation license version 1 3
gfdl-1.2 documentation 5 gnu free documentation license version 1 2
gfdl documentation 6 (?:gnu )?free documentation license
gfdl gfdl 6 (?:gnu )?gfdl
mpl-2.0 mozilla 1 this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 mozilla 1 the contents of this file are subject to the mozilla public license version 1 1
mpl-2.0 mozilla 2 (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?mozilla public license(?: version| v)? ?2(?: 0)?
mpl-2.0 mpl 3 spdx license identifier mpl 2 0
mpl-1.1 mpl 3 spdx license identifier mpl 1 1
mpl-2.0 mozilla 5 mozilla public license(?: version| v)? ?2(?: 0)?
mpl-1.1 mozilla 5 mozilla public license(?: version| v)? ?1 1
mpl-1.0 mozilla 5 mozilla public license(?: version| v)? ?1 0
mpl-2.0 mpl 5 mpl(?: version| v|v)? ?2(?: 0)?
mpl-1.1 mpl 5 mpl(?: version| v|v)? ?1 1
mpl-unversioned mozilla 6 mozilla public license
epl-1.0 eclipse 1 this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
epl-2.0 eclipse 1 this program and the accompanying materials are made available under the terms of the eclipse public license (?:v 2 0|2 0)
epl-1.0 epl 3 spdx license identifier epl 1 0
epl-2.0 epl 3 spdx license identifier epl 2 0
epl-1.0 eclipse 5 eclipse public license(?: version| v)? ?1(?: 0)?
epl-2.0 eclipse 5 eclipse public license(?: version| v)? ?2(?: 0)?
edl-1.0 eclipse 5 eclipse distribution license(?: v)?(?: ?1 0)?
epl-unversioned eclipse 6 eclipse public license
cddl-1.0 cddl 3 spdx license identifier cddl 1 0
cddl-1.1 cddl 3 spdx license identifier cddl 1 1
cddl-1.0 common 1 the contents of this file are subject to the terms of the common development and distribution license
cddl-1.0 common 5 common development and distribution license(?: cddl)?(?: version| v)?(?: ?1 0)?
cddl-1.1 cddl 5 cddl(?: version| v)? ?1 1
cddl-1.0 cddl 6 cddl(?:(?: version| v)? ?1(?: 0)?)?
cpl-1.0 common 5 common public license(?: version)?(?: 1 0)?
cpal-1.0 attribution 5 common public attribution license(?: version)?(?: 1 0)?
ibm-public ibm 5 ibm public license(?: version)?(?: 1 0)?
eupl-1.1 eupl 5 eupl(?: version| v)? ?1 1
eupl-1.2 eupl 5 eupl(?: version| v)? ?1 2
eupl-1.2 european 6 european union public license
osl-3.0 open 5 open software license(?: version| v)? ?3 0
afl-3.0 academic 5 academic free license(?: version| v)?(?: ?(?:2 1|3 0))?
artistic-2.0 artistic 3 spdx license identifier artistic 2 0
artistic-2.0 artistic 5 artistic license(?: version| v)? ?2(?: 0)?
artistic-perl perl 2 (?:this is free software )?(?:you can|you may) redistribute it and or modify it under the same terms as perl itself
artistic-1.0 artistic 6 artistic license
bsl-1.0 boost 1 boost software license version 1 0 august 17th 2003
bsl-1.0 boost 2 (?:distributed|licensed|released) under the boost software license version 1 0
bsl-1.0 bsl 3 spdx license identifier bsl 1 0
bsl-1.0 boost 6 boost software license
busl-1.1 business 1 the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work (?:\S+ ){0,30}business
busl-1.1 busl 3 spdx license identifier busl 1 1
busl-1.1 business 6 business source license(?: 1 1)?
sspl-1.0 sspl 3 spdx license identifier sspl 1 0
sspl-1.0 server 6 server side public license(?: version 1)?
elastic-2.0 elastic 3 spdx license identifier elastic 2 0
elastic-2.0 elastic 6 elastic license(?: 2 0| v2)?
commons-clause commons 6 commons clause(?: license)?(?: condition)?
polyform polyform 6 polyform (?:noncommercial|small business|perimeter|shield|strict|free trial|internal use) license
prosperity prosperity 6 prosperity public license
parity parity 6 parity public license
hippocratic hippocratic 6 hippocratic license
anti-996 996 6 anti 996 license
json evil 1 the software shall be used for good not evil
unlicense unencumbered 1 this is free and unencumbered software released into the public domain
unlicense unlicense 3 spdx license identifier unlicense
unlicense unlicense 6 (?:the )?unlicense
wtfpl fuck 1 do what the fuck you want to public license
wtfpl wtfpl 6 wtfpl
beerware beer 1 if we meet some day and you think this stuff is worth it you can buy (?:me|us) a beer in return
beerware beerware 6 beerware license
python-2.0 python 3 spdx license identifier python 2 0(?: 1)?
python-2.0 psf 3 spdx license identifier psf 2 0
python-2.0 psf 1 psf is making python available to licensee on an as is basis
python-2.0 python 6 python software foundation license
python-2.0 python 6 python license
php-3.01 php 5 php license(?: version)? 3 01
php-3.0 php 5 php license(?: version)? 3 0
php-unversioned php 6 php license
ruby ruby 6 ruby license
tcl tcl 6 tcl tk license
vim vim 6 vim license
curl curl 6 curl license
openssl openssl 1 this product includes software developed by the openssl project for use in the openssl toolkit
openssl openssl 6 openssl license
ssleay eric 1 this product includes cryptographic software written by eric young
libpng libpng 1 the png reference library is supplied as is (?:\S+ ){0,40}libpng
libpng libpng 6 libpng license
ijg independent 2 this software is based in part on the work of the independent jpeg group
freetype freetype 2 portions of this software are copyright (?:\S+ ){0,6}the freetype project
freetype freetype 6 freetype(?: project)? license
unicode unicode 1 permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
unicode unicode 6 unicode license(?: v3)?
icu icu 6 icu license
w3c w3c 6 w3c software(?: notice and)? license
ofl-1.1 font 1 this font software is licensed under the sil open font license version 1 1
ofl-1.1 ofl 3 spdx license identifier ofl 1 1
ofl-1.1 font 6 (?:sil )?open font license
ubuntu-font ubuntu 6 ubuntu font license
ncsa ncsa 3 spdx license identifier ncsa
ncsa ncsa 6 (?:university of illinois )?ncsa(?: open source)? license
llvm-exception llvm 3 with llvm exception
postgresql postgresql 3 spdx license identifier postgresql
postgresql postgresql 6 postgresql license
upl-1.0 upl 3 spdx license identifier upl 1 0
upl-1.0 universal 6 universal permissive license
ms-pl ms 3 spdx license identifier ms pl
ms-pl microsoft 6 microsoft public license
ms-rl microsoft 6 microsoft reciprocal license
ms-lpl microsoft 6 microsoft limited public license
cecill cecill 6 cecill(?: b| c)?(?: license)?(?: v?2 [01])?
mulan mulan 6 mulan (?:psl|permissive software license)(?: v2)?
blueoak blue 6 blue oak model license(?: 1 0 0)?
ecl-2.0 educational 6 educational community license(?: version)?(?: 2 0)?
intel intel 6 intel open source license
apsl apple 6 apple public source license
rpl reciprocal 6 reciprocal public license
qpl qpl 6 q public license qpl
naist naist 6 naist license
cc0-1.0 waived 1 has waived all copyright and related or neighboring rights
cc0-1.0 cc0 3 spdx license identifier cc0 1 0
cc0-1.0 cc0 5 (?:creative commons )?cc0(?: 1(?: 0)?)?
cc0-1.0 creative 5 creative commons zero(?: v?1(?: 0)?)?
cc-by-4.0 creative 1 this work is licensed under a creative commons attribution 4 0 international license
cc-by-sa-4.0 creative 1 this work is licensed under a creative commons attribution share ?alike 4 0 international license
cc-by-nc-4.0 creative 1 this work is licensed under a creative commons attribution non ?commercial 4 0 international license
cc-by-nc-sa-4.0 creative 1 this work is licensed under a creative commons attribution non ?commercial share ?alike 4 0 international license
cc-by-nc-nd-4.0 creative 1 this work is licensed under a creative commons attribution non ?commercial no ?deriv(?:ative)?s? 4 0 international license
cc-by-nd-4.0 creative 1 this work is licensed under a creative commons attribution no ?deriv(?:ative)?s? 4 0 international license
cc-by-nc-nd cc 5 cc by nc nd(?: [1-4] [05])?
cc-by-nc-sa cc 5 cc by nc sa(?: [1-4] [05])?
cc-by-nc cc 5 cc by nc(?: [1-4] [05])?
cc-by-nd cc 5 cc by nd(?: [1-4] [05])?
cc-by-sa cc 5 cc by sa(?: [1-4] [05])?
cc-by-attribution cc 5 cc by [1-4] [05]
cc-by-nc-nd creative 5 creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?
cc-by-nc-sa creative 5 creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?
cc-by-nc creative 5 creative commons attribution non ?commercial(?: [1-4] [05])?
cc-by-nd creative 5 creative commons attribution no ?deriv(?:ative)?s?(?: [1-4] [05])?
cc-by-sa creative 5 creative commons attribution share ?alike(?: [1-4] [05])?
cc-by-attribution creative 6 creative commons attribution(?: [1-4] [05])?
cc-url creativecommons 4 creativecommons org (?:licenses|publicdomain) (?:by|by sa|by nc|by nd|by nc sa|by nc nd|zero|mark)(?: [1-4] [05])?
creative-commons creative 7 creative commons(?: license)?
odbl-1.0 odbl 5 odbl(?: v?1 0)?
odbl-1.0 database 6 open (?:data commons open )?database license
odc-by odc 5 odc by(?: v?1 0)?
pddl-1.0 dedication 6 public domain dedication(?: and)? license
cdla community 6 community data license agreement (?:permissive|sharing)(?: v?(?:1|2) 0)?
ogl-uk government 6 open government license(?: v?[123] 0)?
ogl-wizards game 6 open game license
openrail openrail 6 (?:creativeml |bigscience )?openrail(?: m| pp)?(?: license)?
openrail rail 6 (?:creativeml |bigscience )?open rail(?: m| pp)?(?: license)?
llama llama 6 llama [234](?: [123])? community license(?: agreement)?
gemma gemma 6 gemma terms of use
public-domain domain 2 (?:released|placed|dedicated|put) (?:in|into|to) the public domain
public-domain domain 4 (?:is|are) in the public domain
public-domain domain 6 public domain (?:work|software|text|notice|mark)
public-domain-us government 4 (?:is|are) (?:a )?works? of the (?:united states|u s|us) government
proprietary proprietary 2 proprietary and confidential
proprietary confidential 2 confidential and proprietary
proprietary unauthorized 2 unauthorized (?:copying|use|reproduction|distribution|duplication)(?: \S+){0,8} (?:is|are) (?:strictly )?(?:prohibited|forbidden)
proprietary reproduced 2 no part of this (?:publication|book|work|document|website|site) may be reproduced(?: \S+){0,20} without (?:the )?(?:prior |express )?(?:written )?permission
proprietary permission 4 without (?:the )?(?:prior |express )?(?:written )?permission of (?:the )?(?:publisher|author|copyright (?:holder|owner)|owner|company)
proprietary trade 4 contains? (?:confidential )?trade secrets? of
commercial-license commercial 4 (?:a )?commercial license (?:is )?(?:required|available|must be (?:purchased|obtained))
non-commercial commercial 4 (?:for )?non commercial (?:use|purposes) only
non-commercial noncommercial 4 (?:for )?noncommercial (?:use|purposes) only
personal-use personal 4 for (?:your )?personal(?: and)?(?: non commercial)? use only
evaluation evaluation 4 for evaluation (?:purposes )?only
academic-use academic 4 for academic (?:use|research|purposes) only
research-use research 4 for research (?:use|purposes) only
no-ai-training training 4 (?:may|must|shall) not be used (?:for|to) train(?:ing)? (?:of )?(?:\S+ ){0,4}training (?:models|data)
reprint reprinted 4 reprinted (?:with|by) (?:the )?(?:kind )?permission(?: of)?
used-by-permission permission 4 used (?:with|by) (?:the )?(?:kind )?permission
eula eula 5 (?:software )?end user license agreement eula
eula user 6 end user license agreement
dual-license dual 4 (?:is |are )?dual licensed(?: under)?
all-rights-reserved reserved 4 all rights (?:are )?reserved
some-rights-reserved reserved 4 some rights (?:are )?reserved
no-rights-reserved reserved 4 no rights reserved
copyright-notice copyright 7 copyright (?:c |© )?(?:19|20)\d\d(?: (?:19|20)\d\d)?(?: by)?
copyright-notice © 7 © (?:copyright )?(?:19|20)\d\d
copyright-notice copyrighted 7 (?:is|are) copyrighted (?:material|work|by)
see-license file 7 see (?:the )?license file(?: for (?:details|more information))?
see-license copying 7 see (?:the )?(?:file )?copying(?: file)? for (?:details|more information)
"""
