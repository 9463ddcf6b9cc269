"""Signature rules of licenses, by hand: after a line `[label]`, one rule a line: kind, keywords that a text must have, expression.

Expressions are over a text's words in lower case with a space between, so `2.0` is `2 0`. They match whole words, and use
what every regular-expression engine has (no looking around, no references). Kinds, in falling priority: tag (a machine-readable
identifier), text (a clause of the license itself), notice (a statement that something is licensed), link (an address), name
(the license's name) and mention (a name that may mean something else). Of rules of one kind the earlier one goes first.
"""

RULES = r"""
[mit]
tag     | identifier mit       | spdx license identifier mit
text    | hereby granted       | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
text    | copyright portions   | (?:the )?above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
text    | sublicense sell      | (?:use copy modify merge publish distribute sublicense and or sell) copies of the software
notice  | mit under            | (?:released|licensed|licenced|distributed|available|published|provided|covered|offered) under (?:the )?(?:terms of (?:the )?|conditions of (?:the )?)?mit (?:license|licence|x11 license)
notice  | mit lizenz           | unter der mit lizenz
notice  | mit licence sous     | sous (?:la )?licence mit
notice  | mit licencia         | bajo (?:la )?licencia mit
link    | opensource mit       | opensource org licenses? mit(?: license)?(?: php)?
link    | choosealicense mit   | choosealicense com licenses mit
name    | mit license          | mit (?:open source )?license
name    | mit licence          | mit licence
name    | expat                | expat (?:license|licence)
mention | mit licensed         | mit licensed
mention | mit license          | license mit
[mit-0]
tag     | identifier mit       | spdx license identifier mit 0
name    | mit attribution      | mit no attribution(?: license)?
name    | mit 0                | mit 0(?: license)?
[x11]
tag     | identifier x11       | spdx license identifier x11
name    | x11 license          | x11 license
text    | consortium           | except as contained in this notice the name of the x consortium shall not be used in advertising
[apache-2]
tag     | identifier apache    | spdx license identifier apache 2 0
text    | apache compliance    | you may not use this file except in compliance with the license (?:\S+ ){0,12}apache org licenses license 2 0
text    | apache january       | apache license version 2 0 january 2004
text    | contributor perpetual irrevocable | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent)? ?license
notice  | apache under         | (?:released|licensed|licenced|distributed|available|published|provided|offered) under (?:the )?(?:terms of (?:the )?)?apache (?:software )?(?:license|licence) (?:version |v)?2(?: 0)?
notice  | apache lizenz        | unter der apache lizenz (?:version )?2(?: 0)?
notice  | apache licence sous  | sous (?:la )?licence apache (?:version )?2(?: 0)?
notice  | apache licencia      | bajo (?:la )?licencia apache (?:version )?2(?: 0)?
link    | apache licenses      | apache org licenses license 2 0(?: txt| html)?
link    | opensource apache    | opensource org licenses? apache 2 0
name    | apache license       | apache (?:software )?license (?:version |v)?2(?: 0)?
name    | apache licence       | apache (?:software )?licence (?:version |v)?2(?: 0)?
name    | asl                  | asl (?:version )?2 0
name    | apache               | apache 2 0(?: license| licence)?
[apache-1-1]
tag     | identifier apache    | spdx license identifier apache 1 1
name    | apache license       | apache (?:software )?license (?:version |v)?1 1
text    | apache foundation developed | this product includes software developed by the apache software foundation
[apache]
mention | apache license       | apache (?:software )?license
mention | apache licensed      | apache licensed
[gpl-1]
tag     | identifier gpl       | spdx license identifier gpl 1 0(?: only| or later)?
name    | gnu general public   | gnu general public license (?:version |v)1(?: 0)?
[gpl-2]
tag     | identifier gpl       | spdx license identifier gpl 2 0(?: only)?
tag     | identifier gpl later | spdx license identifier gpl 2 0 or later
text    | gnu june 1991        | gnu general public license version 2 june 1991
text    | gnu redistribute     | you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license
text    | gnu foundation       | under the terms of the gnu general public license (?:version 2 )?as published by the free software foundation version 2
notice  | gnu under            | (?:released|licensed|licenced|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?gnu (?:general public license|gpl)(?: gpl)? (?:version |v|v2 )?2(?: 0)?
notice  | gpl under            | (?:released|licensed|licenced|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?gpl ?(?:version |v|v ?)?2(?: 0)?
link    | gnu licenses         | gnu org licenses (?:old licenses )?gpl 2 0(?: txt| html| en html)?
link    | opensource gpl       | opensource org licenses? gpl 2 0
name    | gnu general public   | gnu general public license (?:gpl )?(?:version |v)2(?: 0)?
name    | gpl                  | (?:gnu )?gpl (?:version |v)?2(?: 0)?
name    | gplv2                | gplv2
[gpl-3]
tag     | identifier gpl       | spdx license identifier gpl 3 0(?: only)?
tag     | identifier gpl later | spdx license identifier gpl 3 0 or later
text    | gnu june 2007        | gnu general public license version 3 29 june 2007
text    | gnu redistribute     | you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license
text    | copyleft             | the gnu general public license is a free copyleft license for software and other kinds of works
notice  | gnu under            | (?:released|licensed|licenced|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?gnu (?:general public license|gpl)(?: gpl)? (?:version |v)?3(?: 0)?
notice  | gpl under            | (?:released|licensed|licenced|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?gpl ?(?:version |v)?3(?: 0)?
link    | gnu licenses         | gnu org licenses gpl 3 0(?: txt| html| en html)?
link    | opensource gpl       | opensource org licenses? gpl 3 0
name    | gnu general public   | gnu general public license (?:gpl )?(?:version |v)3(?: 0)?
name    | gpl                  | (?:gnu )?gpl (?:version |v)?3(?: 0)?
name    | gplv3                | gplv3
[gpl]
link    | gnu licenses         | gnu org (?:licenses|copyleft) gpl(?: html| txt)?
mention | gnu general public   | gnu general public (?:license|licence)
mention | gnu lizenz           | gnu (?:general public lizenz|gpl lizenz)
mention | gnu publique         | licence publique g\S+ gnu
mention | gnu licencia         | licencia p\S+ general (?:de )?gnu
mention | gnu gpl              | gnu gpl
mention | gpl                  | gpl (?:license|licence|licensed)
[lgpl-2]
tag     | identifier lgpl      | spdx license identifier lgpl 2 0(?: only| or later)?
text    | gnu library 1991     | gnu library general public license version 2 june 1991
name    | gnu library general  | gnu library general public license(?: (?:version |v)2(?: 0)?)?
[lgpl-2-1]
tag     | identifier lgpl      | spdx license identifier lgpl 2 1(?: only| or later)?
text    | gnu lesser 1999      | gnu lesser general public license version 2 1 february 1999
text    | gnu lesser foundation | under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license
link    | gnu licenses lgpl    | gnu org licenses (?:old licenses )?lgpl 2 1(?: txt| html| en html)?
link    | opensource lgpl      | opensource org licenses? lgpl 2 1
name    | gnu lesser general   | gnu lesser general public license (?:lgpl )?(?:version |v)?2 1
name    | lgpl                 | (?:gnu )?lgpl (?:version |v)?2 1
name    | lgplv2               | lgplv2(?: 1)?
[lgpl-3]
tag     | identifier lgpl      | spdx license identifier lgpl 3 0(?: only| or later)?
text    | gnu lesser 2007      | gnu lesser general public license version 3 29 june 2007
text    | gnu lesser foundation | under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license
link    | gnu licenses lgpl    | gnu org licenses lgpl 3 0(?: txt| html| en html)?
name    | gnu lesser general   | gnu lesser general public license (?:lgpl )?(?:version |v)?3(?: 0)?
name    | lgpl                 | (?:gnu )?lgpl (?:version |v)?3(?: 0)?
name    | lgplv3               | lgplv3
[lgpl]
link    | gnu licenses lgpl    | gnu org (?:licenses|copyleft) (?:lgpl|lesser)(?: html| txt)?
mention | gnu lesser general   | gnu lesser general public (?:license|licence)
mention | gnu lgpl             | gnu lgpl
mention | lgpl                 | lgpl (?:license|licence|licensed)
[agpl-3]
tag     | identifier agpl      | spdx license identifier agpl 3 0(?: only| or later)?
text    | affero november      | gnu affero general public license version 3 19 november 2007
text    | affero foundation    | under the terms of the gnu affero general public license as published by the free software foundation either version 3
link    | gnu licenses agpl    | gnu org licenses agpl(?: 3 0)?(?: txt| html| en html)?
name    | affero general       | (?:gnu )?affero general public license(?: agpl)? (?:version |v)?3(?: 0)?
name    | agpl                 | (?:gnu )?agpl (?:version |v)?3(?: 0)?
name    | agplv3               | agplv3
[agpl]
mention | affero general       | (?:gnu )?affero general public (?:license|licence)
mention | agpl                 | (?:gnu )?agpl (?:license|licence|licensed)
[gfdl]
tag     | identifier gfdl      | spdx license identifier gfdl 1 [123](?: only| or later)?
text    | invariant cover texts | with no invariant sections no front cover texts and no back cover texts
text    | gnu documentation    | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
link    | gnu licenses fdl     | gnu org (?:licenses|copyleft) fdl(?: html| txt)?
name    | gnu documentation    | gnu free documentation license(?: (?:version |v)?1 [123])?
name    | gfdl                 | (?:gnu )?gfdl(?: (?:version |v)?1 [123])?
[bsd-2]
tag     | identifier bsd       | spdx license identifier bsd 2 clause
link    | opensource bsd       | opensource org licenses? bsd 2 clause
name    | bsd clause           | (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd)(?: (?:license|licence))?
name    | simplified bsd       | simplified bsd (?:license|licence)
name    | freebsd              | freebsd (?:license|licence|copyright)
[bsd-3]
tag     | identifier bsd       | spdx license identifier bsd 3 clause
text    | endorse derived      | neither the name of (?:\S+ ){1,16}may be used to endorse or promote products derived from this software without specific prior written permission
link    | opensource bsd       | opensource org licenses? bsd 3 clause
name    | bsd clause           | (?:bsd 3 clause|3 clause bsd|three clause bsd)(?: (?:license|licence))?
name    | bsd modified         | modified bsd (?:license|licence)
name    | bsd new              | new bsd (?:license|licence)
name    | bsd revised          | revised bsd (?:license|licence)
[bsd-4]
tag     | identifier bsd       | spdx license identifier bsd 4 clause(?: uc)?
text    | advertising mentioning | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
name    | bsd clause           | (?:bsd 4 clause|4 clause bsd|four clause bsd)(?: (?:license|licence))?
name    | bsd original         | original bsd (?:license|licence)
[bsd-0]
tag     | identifier 0bsd      | spdx license identifier 0bsd
name    | bsd clause           | (?:bsd zero clause|zero clause bsd|0 clause bsd)(?: (?:license|licence))?
name    | 0bsd                 | 0bsd(?: license)?
[bsd]
text    | redistribution binary | redistribution and use in source and binary forms with or without modification are permitted
text    | redistributions retain | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
text    | redistributions reproduce | redistributions in binary form must reproduce the above copyright notice
notice  | bsd under            | (?:released|licensed|licenced|distributed|available|published) under (?:the |a )?(?:terms of (?:the )?)?bsd(?: style)? (?:license|licence)
link    | opensource bsd       | opensource org licenses? bsd license(?: php)?
mention | bsd                  | bsd(?: style)? (?:license|licence|licensed)
mention | bsd lizenz           | bsd lizenz
mention | bsd licence          | licence bsd
[isc]
tag     | identifier isc       | spdx license identifier isc
text    | fee granted          | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
link    | opensource isc       | opensource org licenses? isc(?: license)?
name    | isc                  | isc (?:license|licence)
[mpl-1-1]
tag     | identifier mpl       | spdx license identifier mpl 1 [01]
text    | mozilla contents     | the contents of this file are subject to the mozilla public license version 1 [01]
name    | mozilla public       | mozilla public license (?:version |v)?1 [01]
name    | mpl                  | mpl (?:version |v)?1 [01]
[mpl-2]
tag     | identifier mpl       | spdx license identifier mpl 2 0(?: no copyleft exception)?
text    | mozilla source       | this source code form is subject to the terms of the mozilla public license v 2 0
link    | mozilla mpl          | mozilla org (?:en us )?mpl 2 0
link    | opensource mpl       | opensource org licenses? mpl 2 0
name    | mozilla public       | mozilla public license (?:mpl )?(?:version |v ?)?2(?: 0)?
name    | mpl                  | mpl (?:version |v)?2 0
[mpl]
link    | mozilla mpl          | mozilla org mpl
mention | mozilla public       | mozilla public (?:license|licence)
[epl-1]
tag     | identifier epl       | spdx license identifier epl 1 0
link    | eclipse epl          | eclipse org (?:legal|org documents) epl v10(?: html)?
name    | eclipse public       | eclipse public license (?:version |v ?)?1(?: 0)?
name    | epl                  | epl (?:version |v)?1 0
[epl-2]
tag     | identifier epl       | spdx license identifier epl 2 0
link    | eclipse epl          | eclipse org (?:legal|org documents) epl (?:2 0|v20)(?: html)?
name    | eclipse public       | eclipse public license (?:version |v ?)?2(?: 0)?
name    | epl                  | epl (?:version |v)?2 0
[epl]
mention | eclipse public       | eclipse public (?:license|licence)
name    | eclipse distribution | eclipse distribution license(?: (?:version |v ?)?1(?: 0)?)?
[cpl-1]
tag     | identifier cpl       | spdx license identifier cpl 1 0
name    | common public        | common public license(?: (?:version |v ?)?1(?: 0)?)?
[ipl-1]
tag     | identifier ipl       | spdx license identifier ipl 1 0
name    | ibm public           | ibm public license(?: (?:version |v ?)?1(?: 0)?)?
[cddl-1]
tag     | identifier cddl      | spdx license identifier cddl 1 [01]
text    | development distribution subject | subject to the terms of the common development and distribution license
link    | opensource cddl      | opensource org licenses? cddl(?: 1 0)?
name    | common development   | common development and distribution license(?: cddl)?(?: (?:version |v ?)?1(?: [01])?)?
name    | cddl                 | cddl(?: (?:version |v)?1 [01])?
[artistic-1]
tag     | identifier artistic  | spdx license identifier artistic 1 0(?: perl| cl8)?
text    | perl itself          | under the same terms as perl itself
name    | artistic license     | artistic license (?:version |v)?1(?: 0)?
[artistic-2]
tag     | identifier artistic  | spdx license identifier artistic 2 0
link    | artistic             | (?:perlfoundation org|opensource org licenses?) artistic(?: license)? 2 0
name    | artistic license     | artistic license (?:version |v)?2(?: 0)?
[artistic]
mention | artistic license     | (?:perl )?artistic (?:license|licence)
[boost-1]
tag     | identifier bsl       | spdx license identifier bsl 1 0
text    | accompanying organization | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
link    | boost license        | boost org license 1 0(?: txt)?
name    | boost software       | boost software license(?: (?:version |v)?1(?: 0)?)?
[zlib]
tag     | identifier zlib      | spdx license identifier zlib
text    | altered misrepresented | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
text    | misrepresented origin | the origin of this software must not be misrepresented
link    | opensource zlib      | opensource org licenses? zlib(?: license)?(?: php)?
name    | zlib                 | zlib(?: libpng)? (?:license|licence)
[libpng]
tag     | identifier libpng    | spdx license identifier libpng(?: 2 0)?
name    | libpng               | libpng (?:license|licence)
[unlicense]
tag     | identifier unlicense | spdx license identifier unlicense
text    | unencumbered         | this is free and unencumbered software released into the public domain
link    | unlicense            | unlicense org
name    | unlicense            | unlicense
[wtfpl]
tag     | identifier wtfpl     | spdx license identifier wtfpl
text    | want public license  | do what the \S+ you want to public license
link    | wtfpl                | wtfpl net
name    | wtfpl                | wtfpl
[cc0]
tag     | identifier cc0       | spdx license identifier cc0 1 0
text    | worldwide copyright  | waives? all (?:of )?(?:his or her |her or his |their |our )?rights to the work worldwide under copyright law
notice  | cc0 dedicated        | dedicated (?:\S+ ){0,6}to the public domain (?:\S+ ){0,8}cc0
link    | creativecommons zero | creativecommons org publicdomain zero 1 0(?: legalcode| deed)?
name    | cc0                  | cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?
name    | creative commons zero | creative commons (?:zero|cc0)(?: (?:v)?1 0)?(?: universal)?
[cc-by]
tag     | identifier cc        | spdx license identifier cc by [1234] [05]
text    | appropriate credit   | you must give appropriate credit provide a link to the license and indicate if changes were made
link    | creativecommons by   | creativecommons org licenses by(?: [1234] [05])?(?: legalcode| deed)?(?: \w\w)?
name    | cc by                | cc by(?: (?:v)?[1234](?: [05])?)?(?: international| unported)?
name    | creative commons attribution | creative commons attribution(?: (?:license|licence))?(?: [1234] [05])?(?: international| unported| generic)?(?: (?:license|licence))?
name    | creative namensnennung | creative commons namensnennung(?: [1234] [05])?
name    | creative commons licence | licence creative commons attribution(?: [1234] [05])?
name    | creative commons licencia | licencia (?:de )?creative commons (?:reconocimiento|atribuci\S+)(?: [1234] [05])?
[cc-by-sa]
tag     | identifier cc        | spdx license identifier cc by sa [1234] [05]
text    | remix contributions  | if you remix transform or build upon the material you must distribute your contributions under the same license as the original
link    | creativecommons by   | creativecommons org licenses by sa(?: [1234] [05])?(?: legalcode| deed)?(?: \w\w)?
name    | cc by sa             | cc by sa(?: (?:v)?[1234](?: [05])?)?(?: international| unported)?
name    | creative commons attribution | creative commons attribution share ?alike(?: (?:license|licence))?(?: [1234] [05])?(?: international| unported| generic)?(?: (?:license|licence))?
[cc-by-nd]
tag     | identifier cc        | spdx license identifier cc by nd [1234] [05]
link    | creativecommons by   | creativecommons org licenses by nd(?: [1234] [05])?(?: legalcode| deed)?(?: \w\w)?
name    | cc by nd             | cc by nd(?: (?:v)?[1234](?: [05])?)?(?: international| unported)?
name    | creative commons attribution | creative commons attribution no ?deriv(?:ative)?s(?: works)?(?: [1234] [05])?(?: international| unported)?
[cc-by-nc]
tag     | identifier cc        | spdx license identifier cc by nc [1234] [05]
text    | material commercial purposes | you may not use the material for commercial purposes
notice  | cc under             | (?:released|licensed|licenced|distributed|available|published|shared) under (?:a |the )?cc by nc(?: (?:v)?[1234](?: [05])?)?(?: license| licence)?
link    | creativecommons by   | creativecommons org licenses by nc(?: [1234] [05])?(?: legalcode| deed)?(?: \w\w)?
name    | cc by nc             | cc by nc(?: (?:v)?[1234](?: [05])?)?(?: international| unported)?
name    | creative commons attribution | creative commons attribution non ?commercial(?: (?:license|licence))?(?: [1234] [05])?(?: international| unported| generic)?(?: (?:license|licence))?
[cc-by-nc-sa]
tag     | identifier cc        | spdx license identifier cc by nc sa [1234] [05]
link    | creativecommons by   | creativecommons org licenses by nc sa(?: [1234] [05])?(?: legalcode| deed)?(?: \w\w)?
name    | cc by nc             | cc by nc sa(?: (?:v)?[1234](?: [05])?)?(?: international| unported)?
name    | creative commons attribution | creative commons attribution non ?commercial share ?alike(?: [1234] [05])?(?: international| unported)?
[cc-by-nc-nd]
tag     | identifier cc        | spdx license identifier cc by nc nd [1234] [05]
link    | creativecommons by   | creativecommons org licenses by nc nd(?: [1234] [05])?(?: legalcode| deed)?(?: \w\w)?
name    | cc by nc             | cc by nc nd(?: (?:v)?[1234](?: [05])?)?(?: international| unported)?
name    | creative commons attribution | creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?(?: [1234] [05])?(?: international| unported)?
[cc]
link    | creativecommons      | creativecommons org licenses
mention | creative commons     | creative commons (?:license|licence|lizenz)
mention | creative commons     | (?:licence|licencia) creative commons
[odbl-1]
tag     | identifier odbl      | spdx license identifier odbl 1 0
link    | opendatacommons      | opendatacommons org licenses odbl(?: 1 0)?
name    | open database        | open (?:data commons open )?database license(?: odbl)?(?: (?:version |v)?1 0)?
[odc-by]
tag     | identifier odc       | spdx license identifier odc by 1 0
link    | opendatacommons by   | opendatacommons org licenses by(?: 1 0)?
name    | open data attribution | open data commons attribution license(?: odc by)?(?: (?:version |v)?1 0)?
[pddl-1]
tag     | identifier pddl      | spdx license identifier pddl 1 0
link    | opendatacommons pddl | opendatacommons org licenses pddl(?: 1 0)?
name    | public dedication    | (?:open data commons )?public domain dedication and license(?: pddl)?
[python-2]
tag     | identifier spdx      | spdx license identifier (?:psf|python) 2 0(?: 1)?
name    | python foundation    | python software foundation license(?: (?:version |v)?2)?
name    | psf                  | psf (?:license|licence)
[php-3]
tag     | identifier php       | spdx license identifier php 3 0(?: 1)?
link    | php license          | php net license 3 0(?: 1)?(?: txt)?
name    | php license          | php license(?: (?:version |v)?3 0(?: 1)?)?
[ruby]
tag     | identifier ruby      | spdx license identifier ruby
name    | ruby license         | ruby (?:license|licence)
[openssl]
tag     | identifier openssl   | spdx license identifier openssl
text    | openssl project      | this product includes software developed by the openssl project
name    | openssl              | openssl (?:license|licence)
[ofl-1-1]
tag     | identifier ofl       | spdx license identifier ofl 1 [01](?: rfn| no rfn)?
text    | sil font             | this font software is licensed under the sil open font license version 1 1
link    | sil ofl              | scripts sil org ofl
name    | open font            | (?:sil )?open font license(?: ofl)?(?: (?:version |v)?1 1)?
[eupl-1]
tag     | identifier eupl      | spdx license identifier eupl 1 [12]
text    | eupl licensed        | licensed under the eupl (?:version |v)?1 [12]
link    | eupl                 | joinup ec europa eu (?:\S+ ){0,6}eupl(?: \S+){0,4}
name    | european union public | european union public licen[cs]e(?: (?:version |v)?1 [12])?
name    | eupl                 | eupl (?:version |v)?1 [12]
[cecill]
tag     | identifier cecill    | spdx license identifier cecill (?:1 [01]|2 [01]|b|c)
text    | cecill abiding       | governed by the cecill(?: [bc])? license under french law and abiding by the rules of distribution of free software
link    | cecill               | cecill info(?: licences)?
name    | cecill               | (?:licence |license )?cecill(?: [bc])?(?: (?:version |v)?[12](?: [01])?)?
[afl-3]
tag     | identifier afl       | spdx license identifier afl (?:1 [12]|2 [01]|3 0)
name    | academic free        | academic free license(?: (?:version |v ?)?[123](?: [012])?)?
[osl-3]
tag     | identifier osl       | spdx license identifier osl (?:1 [01]|2 [01]|3 0)
name    | open software license | open software license(?: (?:version |v ?)?[123](?: [01])?)?
[ms-pl]
tag     | identifier ms        | spdx license identifier ms pl
name    | microsoft public     | microsoft public license(?: ms pl)?
name    | ms pl                | ms pl
[ms-rl]
tag     | identifier ms        | spdx license identifier ms rl
name    | microsoft reciprocal | microsoft reciprocal license(?: ms rl)?
[ncsa]
tag     | identifier ncsa      | spdx license identifier ncsa
name    | illinois             | (?:university of )?illinois(?: ncsa)? open source license
name    | ncsa                 | ncsa (?:open source )?license
[upl-1]
tag     | identifier upl       | spdx license identifier upl 1 0
name    | universal permissive | universal permissive license(?: upl)?(?: (?:version |v)?1 0)?
[postgresql]
tag     | identifier postgresql | spdx license identifier postgresql
name    | postgresql           | postgresql (?:license|licence)
[curl]
tag     | identifier curl      | spdx license identifier curl
name    | curl license         | curl license
[vim]
tag     | identifier vim       | spdx license identifier vim
name    | vim license          | vim (?:license|licence)
[json]
tag     | identifier json      | spdx license identifier json
text    | good evil            | the software shall be used for good not evil
[beerware]
tag     | identifier beerware  | spdx license identifier beerware
text    | beer                 | (?:you can )?buy me a beer in return
name    | beer ware            | beer ware (?:license|licence)
name    | beerware             | beerware (?:license|licence)
[sspl-1]
tag     | identifier sspl      | spdx license identifier sspl 1 0
name    | server side public   | server side public license(?: sspl)?(?: (?:version |v ?)?1(?: 0)?)?
name    | sspl                 | sspl(?: (?:version |v)?1(?: 0)?)?
[busl-1-1]
tag     | identifier busl      | spdx license identifier busl 1 1
name    | business source      | business source license(?: (?:version |v)?1 1)?
[elastic-2]
tag     | identifier elastic   | spdx license identifier elastic 2 0
name    | elastic license      | elastic license(?: (?:version |v)?2(?: 0)?)?
[polyform]
tag     | identifier polyform  | spdx license identifier polyform (?:noncommercial|small business) 1 0 0
name    | polyform             | polyform (?:noncommercial|strict|shield|perimeter|internal use|small business|free trial) license(?: 1 0 0)?
[commons-clause]
text    | commons clause       | (?:the )?commons clause (?:license )?condition v1 0
name    | commons clause       | commons clause
[openrail]
name    | openrail             | (?:creativeml |bigscience )?(?:open ?)?(?:bloom )?openrail(?: \+\+)?(?: m)?(?: license)?
name    | rail license         | (?:bigscience |responsible ai )(?:bloom )?rail (?:license|licence)(?: (?:version |v)?1(?: 0)?)?
[llama]
name    | llama community      | llama [23](?: [123])? community license(?: agreement)?
[gemma]
name    | gemma terms          | gemma terms of use
[blueoak-1]
tag     | identifier blueoak   | spdx license identifier blueoak 1 0 0
name    | blue oak             | blue oak model license(?: (?:version )?1 0 0)?
[mulan-2]
tag     | identifier mulanpsl  | spdx license identifier mulanpsl [12] 0
name    | mulan permissive     | mulan permissive software license(?: (?:version |v)?[12])?
[ogl]
tag     | identifier ogl       | spdx license identifier ogl uk [123] 0
link    | nationalarchives government | nationalarchives gov uk doc open government licence(?: version [123])?
name    | open government      | open government licen[cs]e(?: (?:version |v)?[123](?: 0)?)?
[etalab-2]
tag     | identifier etalab    | spdx license identifier etalab 2 0
name    | licence ouverte      | licence ouverte(?: open licence)?(?: etalab)?(?: (?:version |v)?[12](?: 0)?)?
[dl-de]
name    | datenlizenz          | datenlizenz deutschland (?:namensnennung|zero|by)(?: (?:version )?[12](?: 0)?)?
[w3c]
tag     | identifier w3c       | spdx license identifier w3c(?: 20150513| 19980720)?
name    | w3c license          | w3c software(?: notice)?(?: and document)?(?: notice)?(?: and)? license
[unicode]
tag     | identifier unicode   | spdx license identifier unicode (?:3 0|dfs 201[56]|tou)
name    | unicode license      | unicode(?: data files and software)? license(?: (?:agreement|v3))?
[ijg]
tag     | identifier ijg       | spdx license identifier ijg
text    | jpeg group           | this software is based in part on the work of the independent jpeg group
[ftl]
tag     | identifier ftl       | spdx license identifier ftl
name    | freetype             | freetype (?:project )?license
[lppl-1-3]
tag     | identifier lppl      | spdx license identifier lppl 1 [0123][ac]?
text    | latex distributed    | distributed and or modified under the conditions of the latex project public license
link    | latex lppl           | latex project org lppl(?: txt)?
name    | latex public         | latex project public license(?: (?:version |v)?1 [0123][ac]?)?
[sleepycat]
tag     | identifier sleepycat | spdx license identifier sleepycat
name    | sleepycat            | sleepycat (?:license|licence)
[zpl-2]
tag     | identifier zpl       | spdx license identifier zpl 2 [01]
name    | zope public          | zope public license(?: (?:zpl )?(?:version |v)?2 [01])?
[qpl-1]
tag     | identifier qpl       | spdx license identifier qpl 1 0
name    | q public             | q public license(?: (?:version |v)?1(?: 0)?)?
[public-domain]
notice  | public domain        | (?:this (?:work|file|code|text|software|document) is|released|placed|dedicated|is hereby placed|put) (?:in|into|in to|to) the public domain
mention | public domain        | (?:is in the|is|a work in the) public domain
mention | gemeinfrei           | gemeinfrei
mention | domaine public       | (?:dans le|du) domaine public
mention | dominio              | de dominio p\S+blico
[proprietary]
notice  | rights reserved      | all rights reserved
notice  | droits tous          | tous droits r\S+serv\S+
notice  | rechte vorbehalten   | alle rechte vorbehalten
notice  | derechos reservados  | todos los derechos reservados
notice  | confidential proprietary | confidential and proprietary
notice  | proprietary          | (?:this is |is )?proprietary software
notice  | reproduced permission | (?:no part of this (?:publication|document|work|book) may be reproduced|may not be reproduced|not be reproduced) (?:\S+ ){0,12}without (?:the )?(?:prior )?(?:express )?(?:written )?permission
text    | end user agreement   | end user license agreement
"""
