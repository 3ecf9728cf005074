"""Signature rules for license scans: ``label | priority | keyword | regex`` in order.

Rules run on lower-cased words joined by single spaces (punctuation is gone: ``version 2.0`` reads
``version 2 0``). The keyword is a plain substring that must occur before the regex is tried.
Priority: 9 identifiers and URLs, 8 full name with version, 7 distinctive clause of the license text,
6 name without version, 4 notice, 2 weak mention. Of overlapping detections the higher priority
stands, then the longer, then the earlier rule.
"""

from __future__ import annotations

RULES = r"""
apache-2.0|9|spdx|spdx license identifier apache 2 0
apache-1.1|9|spdx|spdx license identifier apache 1 1
mit|9|spdx|spdx license identifier mit
isc|9|spdx|spdx license identifier isc
0bsd|9|spdx|spdx license identifier 0bsd
bsd-2-clause|9|spdx|spdx license identifier bsd 2 clause
bsd-3-clause|9|spdx|spdx license identifier bsd 3 clause
bsd-4-clause|9|spdx|spdx license identifier bsd 4 clause
gpl-1.0|9|spdx|spdx license identifier gpl 1 0
gpl-2.0|9|spdx|spdx license identifier gpl 2 0(?: only)?
gpl-2.0-or-later|9|spdx|spdx license identifier gpl 2 0 or later
gpl-3.0|9|spdx|spdx license identifier gpl 3 0(?: only)?
gpl-3.0-or-later|9|spdx|spdx license identifier gpl 3 0 or later
lgpl-2.0|9|spdx|spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2.1|9|spdx|spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3.0|9|spdx|spdx license identifier lgpl 3 0(?: only| or later)?
agpl-3.0|9|spdx|spdx license identifier agpl 3 0(?: only| or later)?
mpl-1.1|9|spdx|spdx license identifier mpl 1 1
mpl-2.0|9|spdx|spdx license identifier mpl 2 0
epl-1.0|9|spdx|spdx license identifier epl 1 0
epl-2.0|9|spdx|spdx license identifier epl 2 0
cddl-1.0|9|spdx|spdx license identifier cddl 1 0
bsl-1.0|9|spdx|spdx license identifier bsl 1 0
unlicense|9|spdx|spdx license identifier unlicense
zlib|9|spdx|spdx license identifier zlib
cc0-1.0|9|spdx|spdx license identifier cc0 1 0
cc-by-4.0|9|spdx|spdx license identifier cc by 4 0
cc-by-sa-4.0|9|spdx|spdx license identifier cc by sa 4 0
cc-by-nc-4.0|9|spdx|spdx license identifier cc by nc 4 0
artistic-2.0|9|spdx|spdx license identifier artistic 2 0
wtfpl|9|spdx|spdx license identifier wtfpl
spdx-tag|4|spdx|spdx license identifier
apache-2.0|9|apache org|(?:https? )?(?:www )?apache org licenses license 2 0(?: txt| html)?
apache-1.1|9|apache org|(?:https? )?(?:www )?apache org licenses license 1 1(?: txt| html)?
apache-1.0|9|apache org|(?:https? )?(?:www )?apache org licenses license 1 0(?: txt| html)?
apache|6|apache org|(?:https? )?(?:www )?apache org licenses
gpl-2.0|9|gnu org|(?:https? )?(?:www )?gnu org licenses (?:old licenses )?gpl 2 0(?: en)?(?: txt| html)?
gpl-3.0|9|gnu org|(?:https? )?(?:www )?gnu org licenses gpl 3 0(?: en)?(?: txt| html)?
gpl|6|gnu org|(?:https? )?(?:www )?gnu org licenses gpl
lgpl-2.1|9|gnu org|(?:https? )?(?:www )?gnu org licenses (?:old licenses )?lgpl 2 1(?: en)?(?: txt| html)?
lgpl-3.0|9|gnu org|(?:https? )?(?:www )?gnu org licenses lgpl 3 0(?: en)?(?: txt| html)?
lgpl|6|gnu org|(?:https? )?(?:www )?gnu org licenses lgpl
agpl-3.0|9|gnu org|(?:https? )?(?:www )?gnu org licenses agpl(?: 3 0)?(?: en)?(?: txt| html)?
gfdl-1.3|9|gnu org|(?:https? )?(?:www )?gnu org licenses fdl(?: 1 3)?(?: en)?(?: txt| html)?
gnu-site|2|gnu org|(?:https? )?(?:www )?gnu org licenses
mit|9|opensource org|(?:https? )?(?:www )?opensource org licenses? mit(?: license)?(?: php| html)?
bsd-2-clause|9|opensource org|(?:https? )?(?:www )?opensource org licenses? bsd 2 clause
bsd-3-clause|9|opensource org|(?:https? )?(?:www )?opensource org licenses? bsd 3 clause
bsd|8|opensource org|(?:https? )?(?:www )?opensource org licenses? bsd license(?: php)?
apache-2.0|9|opensource org|(?:https? )?(?:www )?opensource org licenses? apache 2 0
isc|9|opensource org|(?:https? )?(?:www )?opensource org licenses? isc
artistic-2.0|9|opensource org|(?:https? )?(?:www )?opensource org licenses? artistic 2 0
mpl-2.0|9|opensource org|(?:https? )?(?:www )?opensource org licenses? mpl 2 0
osi-site|2|opensource org|(?:https? )?(?:www )?opensource org licenses?
mpl-1.1|9|mozilla org|(?:https? )?(?:www )?mozilla org mpl mpl 1 1(?: txt| html)?
mpl-2.0|9|mozilla org|(?:https? )?(?:www )?mozilla org (?:en us )?mpl 2 0(?: txt)?
epl-1.0|9|eclipse org|(?:https? )?(?:www )?eclipse org legal epl v10(?: html)?
epl-2.0|9|eclipse org|(?:https? )?(?:www )?eclipse org legal epl (?:v20|2 0)(?: html)?
bsl-1.0|9|boost org|(?:https? )?(?:www )?boost org license 1 0(?: txt)?
unlicense|9|unlicense org|(?:https? )?(?:www )?unlicense org
wtfpl|9|wtfpl|(?:https? )?(?:www )?(?:wtfpl net|sam zoy org wtfpl)
cc0-1.0|9|creativecommons org|(?:https? )?(?:www )?creativecommons org publicdomain zero 1 0(?: legalcode)?
pdm-1.0|9|creativecommons org|(?:https? )?(?:www )?creativecommons org publicdomain mark 1 0
cc-by-4.0|9|creativecommons org|(?:https? )?(?:www )?creativecommons org licenses by 4 0(?: legalcode)?
cc-by-3.0|9|creativecommons org|(?:https? )?(?:www )?creativecommons org licenses by 3 0(?: legalcode)?
cc-by-2.5|9|creativecommons org|(?:https? )?(?:www )?creativecommons org licenses by 2 5(?: legalcode)?
cc-by-2.0|9|creativecommons org|(?:https? )?(?:www )?creativecommons org licenses by 2 0(?: legalcode)?
cc-by-1.0|9|creativecommons org|(?:https? )?(?:www )?creativecommons org licenses by 1 0(?: legalcode)?
cc-by-sa-4.0|9|creativecommons org|(?:https? )?(?:www )?creativecommons org licenses by sa 4 0(?: legalcode)?
cc-by-sa-3.0|9|creativecommons org|(?:https? )?(?:www )?creativecommons org licenses by sa 3 0(?: legalcode)?
cc-by-sa-2.5|9|creativecommons org|(?:https? )?(?:www )?creativecommons org licenses by sa 2 5(?: legalcode)?
cc-by-sa-2.0|9|creativecommons org|(?:https? )?(?:www )?creativecommons org licenses by sa 2 0(?: legalcode)?
cc-by-nc-4.0|9|creativecommons org|(?:https? )?(?:www )?creativecommons org licenses by nc 4 0(?: legalcode)?
cc-by-nc-3.0|9|creativecommons org|(?:https? )?(?:www )?creativecommons org licenses by nc 3 0(?: legalcode)?
cc-by-nc-2.5|9|creativecommons org|(?:https? )?(?:www )?creativecommons org licenses by nc 2 5(?: legalcode)?
cc-by-nd-4.0|9|creativecommons org|(?:https? )?(?:www )?creativecommons org licenses by nd 4 0(?: legalcode)?
cc-by-nd-3.0|9|creativecommons org|(?:https? )?(?:www )?creativecommons org licenses by nd 3 0(?: legalcode)?
cc-by-nc-sa-4.0|9|creativecommons org|(?:https? )?(?:www )?creativecommons org licenses by nc sa 4 0(?: legalcode)?
cc-by-nc-sa-3.0|9|creativecommons org|(?:https? )?(?:www )?creativecommons org licenses by nc sa 3 0(?: legalcode)?
cc-by-nc-nd-4.0|9|creativecommons org|(?:https? )?(?:www )?creativecommons org licenses by nc nd 4 0(?: legalcode)?
cc-by-nc-nd-3.0|9|creativecommons org|(?:https? )?(?:www )?creativecommons org licenses by nc nd 3 0(?: legalcode)?
creative-commons|4|creativecommons org|(?:https? )?(?:www )?creativecommons org
cc-by-nc-nd-4.0|8|cc by|cc by nc nd 4 0
cc-by-nc-nd-3.0|8|cc by|cc by nc nd 3 0
cc-by-nc-sa-4.0|8|cc by|cc by nc sa 4 0
cc-by-nc-sa-3.0|8|cc by|cc by nc sa 3 0
cc-by-nc-4.0|8|cc by|cc by nc 4 0
cc-by-nc-3.0|8|cc by|cc by nc 3 0
cc-by-nd-4.0|8|cc by|cc by nd 4 0
cc-by-nd-3.0|8|cc by|cc by nd 3 0
cc-by-sa-4.0|8|cc by|cc by sa 4 0
cc-by-sa-3.0|8|cc by|cc by sa 3 0
cc-by-sa-2.5|8|cc by|cc by sa 2 5
cc-by-sa-2.0|8|cc by|cc by sa 2 0
cc-by-4.0|8|cc by|cc by 4 0
cc-by-3.0|8|cc by|cc by 3 0
cc-by-2.5|8|cc by|cc by 2 5
cc-by-2.0|8|cc by|cc by 2 0
cc-by-1.0|8|cc by|cc by 1 0
cc-by-nc-nd|6|cc by|cc by nc nd
cc-by-nc-sa|6|cc by|cc by nc sa
cc-by-nc|6|cc by|cc by nc
cc-by-nd|6|cc by|cc by nd
cc-by-sa|6|cc by|cc by sa
cc-by-nc-nd-4.0|8|creative commons|creative commons attribution non ?commercial no ?deriv(?:ative)?(?:s| works)? 4 0(?: international)?(?: public)?(?: license)?
cc-by-nc-sa-4.0|8|creative commons|creative commons attribution non ?commercial share ?alike 4 0(?: international)?(?: public)?(?: license)?
cc-by-nc-sa-3.0|8|creative commons|creative commons attribution non ?commercial share ?alike 3 0(?: unported)?(?: license)?
cc-by-nc-4.0|8|creative commons|creative commons attribution non ?commercial 4 0(?: international)?(?: public)?(?: license)?
cc-by-nc-3.0|8|creative commons|creative commons attribution non ?commercial 3 0(?: unported)?(?: license)?
cc-by-sa-4.0|8|creative commons|creative commons attribution share ?alike 4 0(?: international)?(?: public)?(?: license)?
cc-by-sa-3.0|8|creative commons|creative commons attribution share ?alike 3 0(?: unported)?(?: license)?
cc-by-nd-4.0|8|creative commons|creative commons attribution no ?deriv(?:ative)?(?:s| works)? 4 0(?: international)?(?: public)?(?: license)?
cc-by-4.0|8|creative commons|creative commons attribution 4 0(?: international)?(?: public)?(?: license)?
cc-by-3.0|8|creative commons|creative commons attribution 3 0(?: unported)?(?: license)?
cc-by-2.5|8|creative commons|creative commons attribution 2 5(?: generic)?(?: license)?
cc-by-2.0|8|creative commons|creative commons attribution 2 0(?: generic)?(?: license)?
cc-by-sa|6|creative commons|creative commons attribution share ?alike
cc-by-nc|6|creative commons|creative commons attribution non ?commercial
creative-commons|4|creative commons|(?:under|with) (?:a|the) creative commons(?: license)?
creative-commons|2|creative commons|creative commons
cc0-1.0|8|cc0|cc0 1 0(?: universal)?(?: public domain dedication)?
cc0-1.0|6|cc0|cc0
apache-2.0|8|apache|(?:the )?apache (?:software )?(?:license|licence) (?:version |v ?)?2(?: 0)?
apache-1.1|8|apache|(?:the )?apache (?:software )?(?:license|licence) (?:version |v ?)?1 1
apache-1.0|8|apache|(?:the )?apache (?:software )?(?:license|licence) (?:version |v ?)?1 0
apache-2.0|8|apache|apache 2 0 (?:license|licence)
apache-2.0|7|apache|you may not use this file except in compliance with the license you may obtain a copy of the license at (?:https? )?www apache org
apache|6|apache|(?:the )?apache (?:software )?(?:license|licence)
apache-2.0|7|grant of patent|grant of patent license subject to the terms and conditions of this license
mit|8|mit license|(?:the )?mit license(?: mit)?
mit|8|mit licence|(?:the )?mit licence
mit|8|mit lizenz|(?:die |der )?mit lizenz
mit|8|licence mit|(?:la )?licence mit
mit|8|licencia mit|(?:la )?licencia mit
expat|8|expat license|(?:the )?expat license
x11|8|x11 license|(?:the )?x11 license
mit|7|permission is hereby granted|permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit|7|the above copyright notice|the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
isc|7|permission to use copy|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc|8|isc license|(?:the )?isc license
0bsd|8|zero clause bsd|(?:bsd )?zero clause bsd(?: license)?
bsd-2-clause|8|bsd|(?:the )?(?:2|two) clause bsd(?: license)?
bsd-2-clause|8|bsd|(?:the )?bsd (?:2|two) clause(?: license)?
bsd-2-clause|8|bsd|simplified bsd(?: license)?
bsd-2-clause|8|bsd|freebsd license
bsd-3-clause|8|bsd|(?:the )?(?:3|three) clause bsd(?: license)?
bsd-3-clause|8|bsd|(?:the )?bsd (?:3|three) clause(?: license)?
bsd-3-clause|8|bsd|(?:new|modified|revised) bsd(?: license)?
bsd-4-clause|8|bsd|(?:4|four) clause bsd(?: license)?
bsd-4-clause|8|bsd|original bsd(?: license)?
bsd|6|bsd|bsd style license
bsd|6|bsd|(?:the )?bsd licen[sc]e
bsd-2-clause|7|redistribution and use|redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-3-clause|7|neither the name|neither the name of (?:\S+ ){1,12}nor the names of its contributors may be used to endorse or promote products
bsd-4-clause|7|all advertising materials|all advertising materials mentioning features or use of this software must display the following acknowledge?ment
gpl-1.0|8|general public|(?:the )?(?:gnu )?general public license (?:as published by the free software foundation )?(?:either )?(?:version |v ?)?1(?: 0)?
gpl-2.0-or-later|8|general public|(?:the )?(?:gnu )?general public license (?:as published by the free software foundation )?(?:either )?(?:version |v ?)?2(?: 0)? (?:of the license )?or (?:at your option )?(?:any|later)(?: later)?(?: version)?
gpl-3.0-or-later|8|general public|(?:the )?(?:gnu )?general public license (?:as published by the free software foundation )?(?:either )?(?:version |v ?)?3(?: 0)? (?:of the license )?or (?:at your option )?(?:any|later)(?: later)?(?: version)?
gpl-2.0|8|general public|(?:the )?(?:gnu )?general public license (?:as published by the free software foundation )?(?:either )?(?:version |v ?)?2(?: 0)?
gpl-3.0|8|general public|(?:the )?(?:gnu )?general public license (?:as published by the free software foundation )?(?:either )?(?:version |v ?)?3(?: 0)?
lgpl-2.0|8|general public|(?:the )?(?:gnu )?(?:library|lesser) general public license (?:version |v ?)?2(?: 0)?
lgpl-2.1|8|general public|(?:the )?(?:gnu )?(?:library|lesser) general public license (?:version |v ?)?2 1
lgpl-3.0|8|general public|(?:the )?(?:gnu )?lesser general public license (?:version |v ?)?3(?: 0)?
agpl-3.0|8|general public|(?:the )?(?:gnu )?affero general public license(?: (?:version |v ?)?3(?: 0)?)?
lgpl|6|general public|(?:the )?(?:gnu )?(?:library|lesser) general public license
gpl|6|general public|(?:the )?(?:gnu )?general public licen[sc]e
gpl-2.0|8|gpl|(?:gnu )?gpl ?(?:version |v ?)?2(?: 0)?(?: only)?
gpl-3.0|8|gpl|(?:gnu )?gpl ?(?:version |v ?)?3(?: 0)?(?: only)?
gpl-2.0-or-later|8|gpl|(?:gnu )?gpl ?(?:version |v ?)?2(?: 0)? or later
gpl-3.0-or-later|8|gpl|(?:gnu )?gpl ?(?:version |v ?)?3(?: 0)? or later
lgpl-2.1|8|lgpl|(?:gnu )?lgpl ?(?:version |v ?)?2 1
lgpl-3.0|8|lgpl|(?:gnu )?lgpl ?(?:version |v ?)?3(?: 0)?
agpl-3.0|8|agpl|(?:gnu )?agpl ?(?:version |v ?)?3(?: 0)?
gpl|6|gpl|(?:gnu )?gpl licen[sc]ed?
gpl|4|gpl|under (?:the )?(?:gnu )?gpl
lgpl|4|lgpl|under (?:the )?(?:gnu )?lgpl
agpl|4|agpl|under (?:the )?(?:gnu )?agpl
gpl|7|free software you can redistribute|this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
lgpl|7|free software you can redistribute|this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
gpl-warranty|4|without even the implied|without even the implied warranty of merchantability or fitness for a particular purpose see the gnu (?:lesser |affero )?general public license
classpath-exception|7|classpath exception|(?:with )?(?:the )?classpath exception
gcc-exception|7|runtime library exception|gcc runtime library exception
linking-exception|7|special exception|as a special exception (?:\S+ ){1,20}(?:link|linking)
gfdl-1.1|8|free documentation|(?:gnu )?free documentation license (?:version |v ?)?1 1
gfdl-1.2|8|free documentation|(?:gnu )?free documentation license (?:version |v ?)?1 2
gfdl-1.3|8|free documentation|(?:gnu )?free documentation license (?:version |v ?)?1 3
gfdl|6|free documentation|(?:gnu )?free documentation license
mpl-1.0|8|mozilla public|(?:the )?mozilla public license (?:version |v ?)?1 0
mpl-1.1|8|mozilla public|(?:the )?mozilla public license (?:version |v ?)?1 1
mpl-2.0|8|mozilla public|(?:the )?mozilla public license (?:version |v ?)?2(?: 0)?
mpl|6|mozilla public|(?:the )?mozilla public license
mpl-2.0|7|this source code form|this source code form is subject to the terms of the mozilla public license v 2 0
epl-1.0|8|eclipse|(?:the )?eclipse public license (?:version |v ?)?1(?: 0)?
epl-2.0|8|eclipse|(?:the )?eclipse public license (?:version |v ?)?2(?: 0)?
epl|6|eclipse|(?:the )?eclipse public license
edl-1.0|8|eclipse|eclipse distribution license(?: (?:version |v ?)?1 0)?
cpl-1.0|8|common public license|(?:the )?common public license(?: (?:version |v ?)?1 0)?
ipl-1.0|8|ibm public license|(?:the )?ibm public license(?: (?:version |v ?)?1 0)?
cddl-1.0|8|common development|common development and distribution license(?: cddl)? (?:version |v ?)?1 0
cddl-1.1|8|common development|common development and distribution license(?: cddl)? (?:version |v ?)?1 1
cddl|6|common development|common development and distribution license
eupl-1.1|8|european union public|european union public licen[sc]e (?:version |v ?)?1 1
eupl-1.2|8|european union public|european union public licen[sc]e (?:version |v ?)?1 2
eupl|6|european union public|european union public licen[sc]e
cecill-2.1|8|cecill|cecill (?:version |v ?)?2 1
cecill-b|8|cecill|cecill b
cecill-c|8|cecill|cecill c
cecill|6|cecill|cecill licen[sc]e
artistic-1.0|8|artistic license|(?:the )?artistic license (?:version |v ?)?1 0
artistic-2.0|8|artistic license|(?:the )?artistic license (?:version |v ?)?2(?: 0)?
artistic|6|artistic license|(?:the )?artistic license
perl|6|same terms as perl|(?:under )?the same terms as perl(?: itself)?
python-2.0|8|python software foundation|python software foundation license(?: version 2)?
php-3.01|8|php license|(?:the )?php license (?:version |v ?)?3 01
php|6|php license|(?:the )?php license
ruby|6|ruby license|(?:the )?ruby license
zlib|8|zlib|(?:the )?zlib(?: libpng)? license
zlib|7|provided as is|this software is provided as is without any express or implied warranty in no event will the authors be held liable
libpng|8|libpng|libpng license(?: version 2)?
bsl-1.0|8|boost software|boost software license(?: (?:version |v ?)?1 0)?
bsl-1.1|8|business source|business source license(?: (?:version |v ?)?1 1)?
sspl-1.0|8|server side public|server side public license(?: (?:version |v ?)?1)?
elastic-2.0|8|elastic license|(?:the )?elastic license(?: (?:version |v ?)?2(?: 0)?)?
commons-clause|8|commons clause|commons clause(?: license condition)?(?: v ?1 0)?
polyform|8|polyform|polyform (?:noncommercial|shield|small business|strict)(?: license)?(?: 1 0 0)?
unlicense|8|unlicense|(?:the )?unlicense
unlicense|7|released into the public domain|this is free and unencumbered software released into the public domain
wtfpl|8|do what the|do what the fuck you want to public license
beerware|8|beer ware|(?:the )?beer ware license
json|7|for good not evil|the software shall be used for good not evil
postgresql|8|postgresql licen|(?:the )?postgresql licen[sc]e
openssl|8|openssl license|(?:the )?openssl license
curl|8|curl license|(?:the )?curl license
icu|8|icu license|(?:the )?icu license
ncsa|8|ncsa|(?:university of illinois )?ncsa open source license
w3c|8|w3c software|w3c software (?:notice and )?(?:and document )?licen[sc]e
ofl-1.1|8|open font|(?:sil )?open font license(?: (?:version |v ?)?1 1)?
ofl|7|reserved font name|with reserved font name
ubuntu-font|8|ubuntu font|ubuntu font licen[sc]e(?: 1 0)?
odbl-1.0|8|open database license|(?:odc )?open database license(?: odbl)?(?: v ?1 0)?
odc-by-1.0|8|open data commons attribution|open data commons attribution license(?: v ?1 0)?
pddl-1.0|8|public domain dedication and|public domain dedication and license(?: v ?1 0)?
ogl-uk-3.0|8|open government|open government licen[sc]e(?: (?:version |v ?)?3(?: 0)?)?
cdla-permissive|8|community data license|community data license agreement permissive(?: (?:version |v ?)?[12](?: 0)?)?
cdla-sharing|8|community data license|community data license agreement sharing(?: (?:version |v ?)?1(?: 0)?)?
ms-pl|8|microsoft public|microsoft public license(?: ms pl)?
ms-rl|8|microsoft reciprocal|microsoft reciprocal license(?: ms rl)?
afl-3.0|8|academic free|academic free license(?: (?:version |v ?)?3 0)?
osl-3.0|8|open software license|open software license(?: (?:version |v ?)?3 0)?
upl-1.0|8|universal permissive|universal permissive license(?: (?:version |v ?)?1 0)?
bouncy-castle|8|bouncy castle|bouncy castle licen[sc]e
jsr-spec|8|specification license|specification license agreement
openrail|8|rail|(?:creativeml )?open ?rail ?(?:m|s|d|\+\+ m)?(?: license)?
llama-community|8|community license agreement|llama (?:2|3|3 1|3 2)? ?community license agreement
public-domain|6|public domain|(?:is|are|was|placed|released|dedicated) (?:in|into|to) the public domain
public-domain|2|public domain|public domain
public-domain|6|domaine public|(?:dans le )?domaine public
public-domain|6|dominio p|(?:de )?dominio público
public-domain|6|gemeinfrei|gemeinfrei
proprietary|7|proprietary and confidential|(?:this (?:\S+ ){1,4}is )?proprietary and confidential
proprietary|7|trade secret|(?:contains|constitutes?) (?:\S+ ){0,3}trade secrets?
proprietary|7|may not be reproduced|may not be reproduced (?:\S+ ){0,12}without (?:the )?(?:prior |express )?(?:written )?(?:permission|consent)
no-redistribution|7|unauthorized copying|unauthorized copying of this (?:file|document|work)
all-rights-reserved|6|rights reserved|(?:all|some|no) rights reserved
all-rights-reserved|6|droits r|tous droits réservés
all-rights-reserved|6|derechos reservados|todos los derechos reservados
all-rights-reserved|6|rechte vorbehalten|alle rechte vorbehalten
all-rights-reserved|6|diritti riservati|tutti i diritti riservati
copyright|4|copyright|copyright (?:c |© )?(?:19|20)\d\d(?: (?:19|20)\d\d)?
copyright|4|copyright|copyright (?:c |© )?by
copyright|2|copyright|copyright notice
non-commercial|4|commercial|for non ?commercial (?:use|purposes) only
non-commercial|4|commercial|not for commercial use
research-only|4|research|for (?:academic |scientific )?research (?:use|purposes) only
evaluation-only|4|evaluation|for evaluation purposes only
terms-of-use|4|terms of|subject to (?:the|our) terms of (?:use|service)
license-notice|4|licensed under|(?:is |are )?(?:dual )?licensed under
license-notice|4|released under|(?:is |are )?released under (?:the|an?) (?:\S+ ){0,6}licen[sc]e
license-notice|4|distributed under|(?:is |are )?distributed under (?:the|an?) (?:\S+ ){0,6}licen[sc]e
license-notice|4|lizenziert unter|lizenziert unter(?: der)?
license-notice|4|sous licence|(?:publié|distribué|disponible)?(?: )?sous licence
license-notice|4|bajo licencia|(?:publicado |distribuido )?bajo licencia
license-notice|4|bajo la licencia|(?:publicado |distribuido )?bajo la licencia
see-license|2| see |see (?:the )?license (?:file|txt|md)
see-license|2|license file|see the license file
eula|4|end user license|end user license agreement
permission|2|permission|(?:reprinted|reproduced|used) with (?:kind )?permission
"""
