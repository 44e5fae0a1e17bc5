"""Signature rules for licences, written by hand, over texts reduced to lower-case words with single blanks between them.

A line without indent names the label of the rules below it. A rule line holds its priority (1 ranks first), the
words that every match contains (joined by +), and a regex. Priorities: 1 identifier tags, 2 addresses of licence
texts, 3 sentences that grant or refuse, 4 full names, 5 short names, 6 general wording.
"""

SIGNATURES = r"""
mit
 1 spdx+mit                  spdx license identifier mit
 2 opensource+mit            opensource org licenses? mit(?: license)?
 2 spdx+mit                  spdx org licenses mit(?: html)?
 3 mit                       (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?mit licen[sc]e
 3 permission+charge         permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
 3 merchantability+noninfringement  warranties of merchantability fitness for a particular purpose and noninfringement
 4 mit                       the mit licen[sc]e(?: mit)?
 5 expat                     expat licen[sc]e
mit-0
 1 spdx+mit                  spdx license identifier mit 0
 4 mit+attribution           mit no attribution(?: licen[sc]e)?
x11
 1 spdx+x11                  spdx license identifier x11
 4 x11                       x11 licen[sc]e
apache-2
 1 spdx+apache               spdx license identifier apache 2 0
 2 apache+licenses           (?:www )?apache org licenses license 2 0(?: txt| html)?
 2 opensource+apache         opensource org licenses apache 2 0
 3 apache                    licensed under (?:the )?(?:terms of the )?apache licen[sc]e(?: version)? v?2(?: 0)?
 3 compliance+license        you may not use this file except in compliance with the license
 3 basis+warranties          distributed on an as is basis without warranties or conditions of any kind
 4 apache                    apache (?:software )?licen[sc]e(?: version)? v?2(?: 0)?
 5 asl                       asl v?2 0
apache-1.1
 1 spdx+apache               spdx license identifier apache 1 1
 2 opensource+apache         opensource org licenses apache 1 1
 4 apache                    apache (?:software )?licen[sc]e(?: version)? v?1 1
apache-1.0
 1 spdx+apache               spdx license identifier apache 1 0
 4 apache                    apache (?:software )?licen[sc]e(?: version)? v?1 0
gpl-3
 1 spdx+gpl                  spdx license identifier gpl 3 0(?: only| or later)?
 2 gnu+licenses              (?:www )?gnu org licenses gpl 3 0(?: en)?(?: html| txt)?
 3 gnu                       under the terms of the gnu general public licen[sc]e(?: as published by the free software foundation)?(?: either)? version 3
 3 gnu                       licensed under (?:the )?gnu general public licen[sc]e(?: version| v)? ?3(?: 0)?
 4 gnu                       gnu general public licen[sc]e(?: gpl)?(?: version| v)? ?3(?: 0)?
 4 gnu                       gnu gpl(?: version| v)? ?3(?: 0)?
 5 gplv3                     gplv3
 5 gpl                       gpl(?: version)? v?3(?: 0)?
gpl-2
 1 spdx+gpl                  spdx license identifier gpl 2 0(?: only| or later)?
 2 gnu+licenses              (?:www )?gnu org licenses (?:old licenses )?gpl 2 0(?: en)?(?: html| txt)?
 3 gnu                       under the terms of the gnu general public licen[sc]e(?: as published by the free software foundation)?(?: either)? version 2
 3 gnu                       licensed under (?:the )?gnu general public licen[sc]e(?: version| v)? ?2(?: 0)?
 4 gnu                       gnu general public licen[sc]e(?: gpl)?(?: version| v)? ?2(?: 0)?
 4 gnu                       gnu gpl(?: version| v)? ?2(?: 0)?
 5 gplv2                     gplv2
 5 gpl                       gpl(?: version)? v?2(?: 0)?
gpl-1
 1 spdx+gpl                  spdx license identifier gpl 1 0(?: only| or later)?
 4 gnu                       gnu general public licen[sc]e(?: gpl)?(?: version| v)? ?1(?: 0)?
gpl
 3 gnu+redistribute          you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e
 3 gnu+copy                  you should have received a copy of the gnu general public licen[sc]e
 4 gnu                       gnu general public licen[sc]e
 5 gnu                       gnu gpl
lgpl-3
 1 spdx+lgpl                 spdx license identifier lgpl 3 0(?: only| or later)?
 2 gnu+licenses              (?:www )?gnu org licenses lgpl 3 0(?: en)?(?: html| txt)?
 4 gnu+lesser                gnu lesser general public licen[sc]e(?: lgpl)?(?: version| v)? ?3(?: 0)?
 5 lgpl                      lgpl(?: version)? v?3(?: 0)?
 5 lgplv3                    lgplv3
lgpl-2.1
 1 spdx+lgpl                 spdx license identifier lgpl 2 1(?: only| or later)?
 2 gnu+licenses              (?:www )?gnu org licenses (?:old licenses )?lgpl 2 1(?: en)?(?: html| txt)?
 4 gnu+lesser                gnu lesser general public licen[sc]e(?: lgpl)?(?: version| v)? ?2 1
 5 lgpl                      lgpl(?: version)? v?2 1
lgpl-2
 1 spdx+lgpl                 spdx license identifier lgpl 2 0(?: only| or later)?
 4 gnu+library               gnu library general public licen[sc]e(?: lgpl)?(?: version| v)? ?2(?: 0)?
 5 lgpl                      lgpl(?: version)? v?2 0
lgpl
 3 gnu+lesser+copy           you should have received a copy of the gnu lesser general public licen[sc]e
 4 gnu+lesser                gnu lesser general public licen[sc]e
 4 gnu+library               gnu library general public licen[sc]e
 5 gnu+lgpl                  gnu lgpl
agpl-3
 1 spdx+agpl                 spdx license identifier agpl 3 0(?: only| or later)?
 2 gnu+licenses              (?:www )?gnu org licenses agpl 3 0(?: en)?(?: html| txt)?
 4 gnu+affero                gnu affero general public licen[sc]e(?: agpl)?(?: version| v)? ?3(?: 0)?
 5 agpl                      agpl(?: version)? v?3(?: 0)?
 5 agplv3                    agplv3
agpl
 3 gnu+affero+copy           you should have received a copy of the gnu affero general public licen[sc]e
 4 gnu+affero                gnu affero general public licen[sc]e
gfdl-1.3
 1 spdx+gfdl                 spdx license identifier gfdl 1 3(?: only| or later)?
 2 gnu+licenses              (?:www )?gnu org licenses fdl 1 3(?: en)?(?: html| txt)?
 4 gnu                       gnu free documentation licen[sc]e(?: version| v)? ?1 3
gfdl
 3 document+gnu              permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e
 4 gnu                       gnu free documentation licen[sc]e
bsd-3-clause
 1 spdx+bsd                  spdx license identifier bsd 3 clause
 2 opensource+bsd            opensource org licenses bsd 3 clause
 3 endorse                   neither the name of .{1,200}? nor the names of (?:its|their|any) contributors may be used to endorse or promote products derived from this software
 4 bsd                       (?:the )?(?:3|three) clause bsd(?: licen[sc]e)?
 4 bsd                       bsd (?:3|three) clause(?: licen[sc]e)?
 4 bsd                       (?:new|modified|revised) bsd licen[sc]e
bsd-2-clause
 1 spdx+bsd                  spdx license identifier bsd 2 clause
 2 opensource+bsd            opensource org licenses bsd 2 clause
 4 bsd                       (?:the )?(?:2|two) clause bsd(?: licen[sc]e)?
 4 bsd                       bsd (?:2|two) clause(?: licen[sc]e)?
 4 bsd                       simplified bsd licen[sc]e
 4 freebsd                   freebsd licen[sc]e
bsd-4-clause
 1 spdx+bsd                  spdx license identifier bsd 4 clause
 3 advertising+mentioning    all advertising materials mentioning features or use of this software must display the following acknowledge?ment
 4 bsd                       (?:original bsd|bsd (?:4|four) clause|(?:4|four) clause bsd)(?: licen[sc]e)?
0bsd
 1 spdx+0bsd                 spdx license identifier 0bsd
 4 bsd                       (?:zero clause|0 clause|free public) bsd(?: licen[sc]e)?
 5 0bsd                      0bsd(?: licen[sc]e)?
bsd
 3 redistributions           redistributions of source code must retain the above copyright notice
 3 redistributions           redistributions in binary form must reproduce the above copyright notice
 3 bsd                       (?:licensed|released|distributed|available) under (?:the |a )?bsd(?: style)? licen[sc]e
 5 bsd                       bsd(?: style)? licen[sc]e
isc
 1 spdx+isc                  spdx license identifier isc
 2 opensource+isc            opensource org licenses isc(?: license)?
 3 permission+fee            permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
 4 isc                       (?:the )?isc licen[sc]e
mpl-2
 1 spdx+mpl                  spdx license identifier mpl 2 0
 2 mozilla                   (?:www )?mozilla org mpl 2 0
 3 mozilla                   this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0
 4 mozilla                   mozilla public licen[sc]e(?: mpl)?(?: version| v)? ?2(?: 0)?
 5 mpl                       mpl v?2 0
mpl-1.1
 1 spdx+mpl                  spdx license identifier mpl 1 1
 2 mozilla                   (?:www )?mozilla org mpl mpl 1 1(?: html)?
 4 mozilla                   mozilla public licen[sc]e(?: mpl)?(?: version| v)? ?1 1
mpl
 4 mozilla                   mozilla public licen[sc]e
epl-2
 1 spdx+epl                  spdx license identifier epl 2 0
 2 eclipse                   (?:www )?eclipse org legal epl (?:2 0|v20)(?: html)?
 4 eclipse                   eclipse public licen[sc]e(?: epl)?(?: version| v)? ?2(?: 0)?
epl-1
 1 spdx+epl                  spdx license identifier epl 1 0
 2 eclipse                   (?:www )?eclipse org legal epl (?:1 0|v10)(?: html)?
 4 eclipse                   eclipse public licen[sc]e(?: epl)?(?: version| v)? ?1(?: 0)?
epl
 4 eclipse                   eclipse public licen[sc]e
edl-1
 4 eclipse                   eclipse distribution licen[sc]e(?: version| v)? ?1 0
cddl-1.1
 1 spdx+cddl                 spdx license identifier cddl 1 1
 4 common+development        common development and distribution licen[sc]e(?: cddl)?(?: version| v)? ?1 1
cddl-1
 1 spdx+cddl                 spdx license identifier cddl 1 0
 4 common+development        common development and distribution licen[sc]e(?: cddl)?(?: version| v)? ?1 0
cddl
 4 common+development        common development and distribution licen[sc]e
cpl-1
 1 spdx+cpl                  spdx license identifier cpl 1 0
 4 common                    common public licen[sc]e(?: version| v)? ?1 0
eupl-1.2
 1 spdx+eupl                 spdx license identifier eupl 1 2
 4 european                  european union public licen[sc]e(?: eupl)?(?: version| v)? ?1 2
 5 eupl                      eupl v?1 2
eupl
 4 european                  european union public licen[sc]e
osl-3
 1 spdx+osl                  spdx license identifier osl 3 0
 4 open+software             open software licen[sc]e(?: version| v)? ?3 0
afl-3
 1 spdx+afl                  spdx license identifier afl 3 0
 4 academic                  academic free licen[sc]e(?: version| v)? ?3 0
artistic-2
 1 spdx+artistic             spdx license identifier artistic 2 0
 2 opensource+artistic       opensource org licenses artistic license 2 0
 4 artistic                  artistic licen[sc]e(?: version| v)? ?2 0
artistic-1
 1 spdx+artistic             spdx license identifier artistic 1 0
 4 artistic                  artistic licen[sc]e(?: version| v)? ?1 0
 5 perl                      same terms as perl itself
boost-1
 1 spdx+bsl                  spdx license identifier bsl 1 0
 2 boost                     (?:www )?boost org license 1 0 txt
 4 boost                     boost software licen[sc]e(?: version| v)?(?: 1 0)?
zlib
 1 spdx+zlib                 spdx license identifier zlib
 3 misrepresented            the origin of this software must not be misrepresented
 3 altered+misrepresented    altered source versions must be plainly marked as such and must not be misrepresented as being the original software
 4 zlib                      zlib(?: libpng)? licen[sc]e
libpng
 1 spdx+libpng               spdx license identifier libpng(?: 2 0)?
 4 png                       png reference library licen[sc]e
unlicense
 1 spdx+unlicense            spdx license identifier unlicense
 2 unlicense                 (?:www )?unlicense org
 3 unencumbered              this is free and unencumbered software released into the public domain
 4 unlicense                 the unlicense
wtfpl
 1 spdx+wtfpl                spdx license identifier wtfpl
 2 wtfpl                     (?:www )?wtfpl net
 4 want                      do what the f\w+ you want to public licen[sc]e
 5 wtfpl                     wtfpl
cc0
 1 spdx+cc0                  spdx license identifier cc0 1 0
 2 creativecommons           creativecommons org publicdomain zero 1 0
 4 cc0                       cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?
 4 creative+zero             creative commons zero(?: v?1 0)?(?: universal)?
cc-by-nc-nd
 1 spdx+nd                   spdx license identifier cc by nc nd \d \d
 2 creativecommons           creativecommons org licenses by nc nd \d \d
 4 noncommercial+creative    creative commons attribution noncommercial no ?deriv(?:ative)?s?(?: works)?(?: \d \d)?
 4 commercial+creative       creative commons attribution non commercial no ?deriv(?:ative)?s?(?: works)?(?: \d \d)?
 5 cc+nd                     cc by nc nd(?: \d \d)?
cc-by-nc-sa
 1 spdx+sa                   spdx license identifier cc by nc sa \d \d
 2 creativecommons           creativecommons org licenses by nc sa \d \d
 4 noncommercial+creative    creative commons attribution noncommercial share ?alike(?: \d \d)?
 4 commercial+creative       creative commons attribution non commercial share ?alike(?: \d \d)?
 5 cc+sa                     cc by nc sa(?: \d \d)?
cc-by-nc
 1 spdx+nc                   spdx license identifier cc by nc \d \d
 2 creativecommons           creativecommons org licenses by nc \d \d
 4 noncommercial+creative    creative commons attribution noncommercial(?: \d \d)?
 4 commercial+creative       creative commons attribution non commercial(?: \d \d)?
 5 cc+nc                     cc by nc(?: \d \d)?
cc-by-nd
 1 spdx+nd                   spdx license identifier cc by nd \d \d
 2 creativecommons           creativecommons org licenses by nd \d \d
 4 creative+attribution      creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: \d \d)?
 5 cc+nd                     cc by nd(?: \d \d)?
cc-by-sa
 1 spdx+sa                   spdx license identifier cc by sa \d \d
 2 creativecommons           creativecommons org licenses by sa \d \d
 4 creative+attribution      creative commons attribution share ?alike(?: \d \d)?
 5 cc+sa                     cc by sa(?: \d \d)?
cc-by
 1 spdx+cc                   spdx license identifier cc by \d \d
 2 creativecommons           creativecommons org licenses by \d \d
 4 creative+attribution      creative commons attribution(?: \d \d)?(?: international)?(?: licen[sc]e)
 5 cc                        cc by \d \d
creative-commons
 3 creative                  licensed under (?:a |the )?creative commons
 5 creative                  creative commons licen[sc]e
odbl-1
 1 spdx+odbl                 spdx license identifier odbl 1 0
 2 opendatacommons           opendatacommons org licenses odbl(?: 1 0)?
 4 open+database             open (?:data commons open )?database licen[sc]e(?: odbl)?(?: v?1 0)?
odc-by-1
 1 spdx+odc                  spdx license identifier odc by 1 0
 2 opendatacommons           opendatacommons org licenses by(?: 1 0)?
 4 open+attribution          open data commons attribution licen[sc]e
pddl-1
 1 spdx+pddl                 spdx license identifier pddl 1 0
 4 open+dedication           open data commons public domain dedication and licen[sc]e
ofl-1.1
 1 spdx+ofl                  spdx license identifier ofl 1 1
 2 sil                       scripts sil org ofl
 4 sil                       sil open font licen[sc]e(?: version| v)?(?: ?1 1)?
python-2
 1 spdx+python               spdx license identifier python 2 0
 1 spdx+psf                  spdx license identifier psf 2 0
 4 python                    python software foundation licen[sc]e(?: version| v)?(?: ?2)?
php-3
 1 spdx+php                  spdx license identifier php 3 0?1?
 4 php                       (?:the )?php licen[sc]e(?: version| v)?(?: ?3(?: 01)?)?
ruby
 1 spdx+ruby                 spdx license identifier ruby
 4 ruby                      ruby licen[sc]e
ncsa
 1 spdx+ncsa                 spdx license identifier ncsa
 4 illinois                  university of illinois(?: ncsa)? open source licen[sc]e
postgresql
 1 spdx+postgresql           spdx license identifier postgresql
 4 postgresql                (?:the )?postgresql licen[sc]e
openssl
 1 spdx+openssl              spdx license identifier openssl
 4 openssl                   openssl licen[sc]e
vim
 1 spdx+vim                  spdx license identifier vim
 4 vim                       vim licen[sc]e
w3c
 1 spdx+w3c                  spdx license identifier w3c
 4 w3c                       w3c software (?:notice|and document notice)(?: and)? licen[sc]e
ms-pl
 1 spdx+ms                   spdx license identifier ms pl
 4 microsoft                 microsoft public licen[sc]e
ms-rl
 1 spdx+ms                   spdx license identifier ms rl
 4 microsoft                 microsoft reciprocal licen[sc]e
upl-1
 1 spdx+upl                  spdx license identifier upl 1 0
 4 universal                 universal permissive licen[sc]e(?: version| v)?(?: ?1 0)?
cecill-2.1
 1 spdx+cecill               spdx license identifier cecill 2 1
 4 cecill                    cecill(?: free software)? licen[sc]e(?: agreement)?(?: version| v)?(?: ?2 1)?
mulan-psl-2
 1 spdx+mulanpsl             spdx license identifier mulanpsl 2 0
 4 mulan                     mulan permissive software licen[sc]e(?: version| v)?(?: ?2)?
bsl-1.1
 1 spdx+busl                 spdx license identifier busl 1 1
 4 business+source           business source licen[sc]e(?: version| v)?(?: ?1 1)?
sspl-1
 1 spdx+sspl                 spdx license identifier sspl 1 0
 4 server+side               server side public licen[sc]e(?: version| v)?(?: ?1)?
elastic-2
 1 spdx+elastic              spdx license identifier elastic 2 0
 4 elastic                   elastic licen[sc]e(?: version| v)?(?: ?2 0)?
public-domain
 3 domain                    (?:released|placed|dedicated) (?:in|into|to) the public domain
 6 domain                    this work is in the public domain
proprietary
 3 confidential              proprietary and confidential
 3 unauthorized              unauthorized (?:copying|reproduction|distribution|use) of this (?:file|work|software|document) (?:via any medium )?is strictly prohibited
 3 reproduced                no part of this (?:publication|work|book|document) may be reproduced
 6 reserved                  all rights reserved
 6 proprietary               proprietary licen[sc]e
"""
