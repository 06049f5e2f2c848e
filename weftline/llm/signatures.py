"""Signature rules of licenses, written by hand: one line each, ``priority | label | keyword | regex``.

Priorities: 1 sentences of license texts, 2 identifiers and grants, 3 headers and notices, 4 names with versions, 5 bare
names, 6 dedications, 7 reservations, 8 copyright lines, 9 the bare word. A regex runs over lower-cased words set apart by
single spaces, so punctuation is a space in it, and only where its keyword occurs, which is a part of every match.
"""

from __future__ import annotations

#: One of these is in every keyword: a text without any of them needs no closer look.
STEMS = ("licen", "copyright", "permi", "warrant", "domain", "reserved", "confidential", "copyleft", "redistribut", "commons", "liab")

SIGNATURES = r"""
1 | mit | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
1 | mit | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy
1 | mit | copies of the software and to permit | publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so
1 | mit | permission notice shall be included | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
1 | mit | permission notice including the next paragraph | this permission notice including the next paragraph shall be included in all copies or substantial portions
1 | mit | without warranty of any kind express or implied | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
1 | mit | liable for any claim damages or other liability | in no event shall the authors or copyright holders be liable for any claim damages or other liability
1 | mit-0 | without restriction including without limitation the rights to use copy modify merge publish distribute sublicense | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
1 | isc | permission to use copy modify and or distribute | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
1 | 0bsd | permission to use copy modify and or distribute | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
1 | isc | permission to use copy modify and distribute | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
1 | isc | author disclaims all warranties | the software is provided as is and the author disclaims all warranties with regard to this software
1 | hpnd | permission to use copy modify and distribute | permission to use copy modify and distribute this software and its documentation for any purpose (?:and without fee )?is hereby granted
1 | hpnd | specific written prior permission | not be used in advertising or publicity pertaining to distribution of the software without specific written prior permission
1 | bsd | redistribution and use in source and binary forms | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
1 | bsd | redistribution and use in source and binary forms | redistribution and use in source and binary forms with or without modification are permitted
1 | bsd | redistributions of source code must retain | redistributions of source code must retain the (?:above )?copyright notice this list of conditions and the following disclaimer
1 | bsd | redistributions in binary form must reproduce | redistributions in binary form must reproduce the (?:above )?copyright notice this list of conditions
1 | bsd-3-clause | without specific prior written permission | neither the name of .{1,120}? nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
1 | bsd-4-clause | without specific prior written permission | all advertising materials mentioning features or use of this software must display the following acknowledge?ment .{1,400}? without specific prior written permission
1 | bsd | copyright holders and contributors as is | this software is provided by the copyright holders and contributors as is and any express or implied warranties
1 | bsd | liable for any direct indirect incidental special | in no event shall the copyright (?:holder|owner)s? or contributors be liable for any direct indirect incidental special exemplary or consequential damages
1 | apache | except in compliance with the license | you may not use this file except in compliance with the license
1 | apache | licensed under the apache license version 2 0 | licensed under the apache license version 2 0 the license
1 | apache | license for the specific language governing permissions | see the license for the specific language governing permissions and limitations under the license
1 | apache | distributed under the license is distributed on an as is basis | software distributed under the license is distributed on an as is basis without warranties or conditions of any kind
1 | apache | grant of copyright license | grant of copyright license subject to the terms and conditions of this license each contributor hereby grants to you
1 | apache | grant of patent license | grant of patent license subject to the terms and conditions of this license each contributor hereby grants to you
1 | apache | copyright license to reproduce | perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce
1 | apache | terms and conditions for use reproduction and distribution 1 definitions license | terms and conditions for use reproduction and distribution 1 definitions license shall mean
1 | gpl | gnu general public license as published by | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation
1 | gpl | redistribute it and or modify | this program is free software you can redistribute it and or modify it under the terms
1 | gpl | without even the implied warranty | this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability
1 | gpl | received a copy of the gnu general public license | you should have received a copy of the gnu general public license along with this program
1 | gpl | licenses for most software are designed | the licenses for most software are designed to take away your freedom to share and change it
1 | gpl | general public license is a free copyleft license | the gnu general public license is a free copyleft license for software and other kinds of works
1 | gpl | copies of this license document | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
1 | gpl | redistribute it under certain conditions | this is free software and you are welcome to redistribute it under certain conditions
1 | gpl | absolutely no warranty | comes with absolutely no warranty for details type show w
1 | lgpl | gnu lesser general public license as published by | this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by
1 | lgpl | redistribute it and or modify | this library is free software you can redistribute it and or modify it under the terms
1 | lgpl | received a copy of the gnu lesser general public license | you should have received a copy of the gnu lesser general public license along with this (?:library|program)
1 | lgpl | received a copy of the gnu library general public license | you should have received a copy of the gnu library general public license along with this library
1 | lgpl | incorporates the terms and conditions of version 3 of the gnu general public license | this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license
1 | agpl | gnu affero general public license as published by | under the terms of the gnu affero general public license as published by the free software foundation
1 | agpl | received a copy of the gnu affero general public license | you should have received a copy of the gnu affero general public license along with this program
1 | agpl | affero general public license is a free copyleft license | the gnu affero general public license is a free copyleft license for software
1 | gfdl | gnu free documentation license | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
1 | gfdl | entitled gnu free documentation license | a copy of the license is included in the section entitled gnu free documentation license
1 | mpl | terms of the mozilla public license v 2 0 | this source code form is subject to the terms of the mozilla public license v 2 0
1 | mpl | terms of the mozilla public license | this source code form is subject to the terms of the mozilla public license
1 | mpl | incompatible with secondary licenses | this source code form is incompatible with secondary licenses
1 | mpl | subject to the mozilla public license version 1 1 | the contents of this file are subject to the mozilla public license version 1 1
1 | mpl | licen | if a copy of the mpl was not distributed with this file you can obtain one at .{1,60}? licen[sc]e
1 | epl | terms of this eclipse public license | the accompanying program is provided under the terms of this eclipse public license
1 | epl | made available under the terms of the eclipse public license | this program and the accompanying materials are made available under the terms of the eclipse public license
1 | cpl | common public license agreement | the accompanying program is provided under the terms of this common public license agreement
1 | cddl | common development and distribution license | the contents of this file are subject to the terms of the common development and distribution license
1 | cddl | in each file and include the license file | when distributing covered code include this cddl header in each file and include the license file
1 | unlicense | released into the public domain | this is free and unencumbered software released into the public domain
1 | unlicense | dedicate any and all copyright interest | the author or authors of this software dedicate any and all copyright interest in the software to the public domain
1 | zlib | without any express or implied warranty | this software is provided as is without any express or implied warranty in no event will the authors be held liable
1 | zlib | permission is granted to anyone to use this software | permission is granted to anyone to use this software for any purpose including commercial applications
1 | boost | permission is hereby granted free of charge | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
1 | boost | distributed under the boost software license | distributed under the boost software license version 1 0 see accompanying file license 1 0 txt
1 | cc0 | overtly fully permanently irrevocably and unconditionally waives abandons and surrenders all of affirmer s copyright | overtly fully permanently irrevocably and unconditionally waives abandons and surrenders all of affirmer s copyright and related rights
1 | cc0 | waived all copyright | the person who associated a work with this deed has dedicated the work to the public domain by waiving .{0,40}? waived all copyright
1 | cc by | licensed rights defined below | by exercising the licensed rights defined below you accept and agree to be bound
1 | cc by | creative commons public license | the work as defined below is provided under the terms of this creative commons public license
1 | cc by | licensor hereby grants you a worldwide royalty free | the licensor hereby grants you a worldwide royalty free non sublicensable non exclusive irrevocable license to exercise the licensed rights
1 | artistic | copyright holder maintains some semblance of artistic control | the copyright holder maintains some semblance of artistic control over the development of the package
1 | artistic | permission to copy modify and distribute this package | permission to copy modify and distribute this package under the terms of the artistic license
1 | python | license agreement is between the python software foundation | this license agreement is between the python software foundation psf
1 | python | psf hereby grants licensee | psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce analyze test
1 | php | php license | redistribution and use in source and binary forms .{1,200}? php license
1 | ofl | font software is licensed under the sil open font license | this font software is licensed under the sil open font license version 1 1
1 | ofl | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of the font software to use study copy
1 | eupl | licensed under the eupl | licensed under the eupl version 1 [12] (?:or as soon they will be approved|only)
1 | wtfpl | do what the fuck you want to public license | do what the fuck you want to public license terms and conditions for copying distribution and modification
1 | ms-pl | license governs use of the accompanying software | this license governs use of the accompanying software if you use the software you accept this license
1 | ms-rl | reciprocal grants for any file you distribute that contains code from the software licen | reciprocal grants for any file you distribute that contains code from the software licen[sc]ed?
1 | openssl | redistributions of any form whatsoever must retain | redistributions of any form whatsoever must retain the following acknowledge?ment
1 | curl | permission to use copy modify and distribute this software for any purpose with or without fee | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
1 | libpng | permission is hereby granted to use copy modify and distribute this source code | permission is hereby granted to use copy modify and distribute this source code or portions hereof
1 | ijg | permission is hereby granted to use copy modify and distribute this software | permission is hereby granted to use copy modify and distribute this software or portions thereof for any purpose without fee
1 | postgresql | permission to use copy modify and distribute this software and its documentation | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
1 | vim | changed version of vim licen | there are no restrictions on distributing unmodified copies of vim .{0,200}? changed version of vim licen[sc]e
1 | beerware | beer ware license | the beer ware license revision 42
1 | json | software shall be used for good not evil licen | the software shall be used for good not evil licen[sc]e
1 | w3c | permission to copy modify and distribute this work | permission to copy modify and distribute this work with or without modification for any purpose and without fee or royalty is hereby granted
1 | sleepycat | redistributions in any form must be accompanied | redistributions in any form must be accompanied by information on how to obtain complete source code
1 | odbl | open database license | this license agreement is .{0,40}? open database license odbl
1 | elastic | elastic license | you may not provide the software to third parties as a hosted or managed service .{0,400}? elastic license
1 | bsl | business source license | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use .{0,400}? business source license
2 | mit | spdx license identifier mit | spdx license identifier mit(?! 0)
2 | mit-0 | spdx license identifier mit 0 | spdx license identifier mit 0
2 | apache | spdx license identifier apache | spdx license identifier apache 2 0
2 | apache | spdx license identifier apache | spdx license identifier apache 1 [01]
2 | gpl | spdx license identifier gpl | spdx license identifier gpl 2 0(?: only| or later)?
2 | gpl | spdx license identifier gpl | spdx license identifier gpl 3 0(?: only| or later)?
2 | gpl | spdx license identifier gpl | spdx license identifier gpl 1 0(?: only| or later)?
2 | lgpl | spdx license identifier lgpl | spdx license identifier lgpl 2 [01](?: only| or later)?
2 | lgpl | spdx license identifier lgpl | spdx license identifier lgpl 3 0(?: only| or later)?
2 | agpl | spdx license identifier agpl | spdx license identifier agpl [13] 0(?: only| or later)?
2 | gfdl | spdx license identifier gfdl | spdx license identifier gfdl 1 [123](?: only| or later)?
2 | bsd-2-clause | spdx license identifier bsd 2 clause | spdx license identifier bsd 2 clause(?: patent)?
2 | bsd-3-clause | spdx license identifier bsd 3 clause | spdx license identifier bsd 3 clause(?: clear)?
2 | bsd-4-clause | spdx license identifier bsd 4 clause | spdx license identifier bsd 4 clause(?: uc)?
2 | 0bsd | spdx license identifier 0bsd | spdx license identifier 0bsd
2 | isc | spdx license identifier isc | spdx license identifier isc
2 | mpl | spdx license identifier mpl | spdx license identifier mpl [12] [01](?: no copyleft exception)?
2 | epl | spdx license identifier epl | spdx license identifier epl [12] 0
2 | cpl | spdx license identifier cpl | spdx license identifier cpl 1 0
2 | cddl | spdx license identifier cddl | spdx license identifier cddl 1 [01]
2 | cc by | spdx license identifier cc by | spdx license identifier cc by [1234] [05](?! [a-z])
2 | cc by-sa | spdx license identifier cc by sa | spdx license identifier cc by sa [1234] [05]
2 | cc by-nc | spdx license identifier cc by nc | spdx license identifier cc by nc (?:sa |nd )?[1234] [05]
2 | cc by-nd | spdx license identifier cc by nd | spdx license identifier cc by nd [1234] [05]
2 | cc0 | spdx license identifier cc0 | spdx license identifier cc0 1 0
2 | zlib | spdx license identifier zlib | spdx license identifier zlib
2 | boost | spdx license identifier bsl 1 0 | spdx license identifier bsl 1 0
2 | bsl | spdx license identifier busl | spdx license identifier busl 1 1
2 | artistic | spdx license identifier artistic | spdx license identifier artistic [12] 0
2 | unlicense | spdx license identifier unlicense | spdx license identifier unlicense
2 | wtfpl | spdx license identifier wtfpl | spdx license identifier wtfpl
2 | ofl | spdx license identifier ofl | spdx license identifier ofl 1 [01]
2 | eupl | spdx license identifier eupl | spdx license identifier eupl 1 [012]
2 | python | spdx license identifier p | spdx license identifier p(?:sf|ython) 2 0
2 | php | spdx license identifier php | spdx license identifier php 3 0 ?1?
2 | ms-pl | spdx license identifier ms pl | spdx license identifier ms pl
2 | ms-rl | spdx license identifier ms rl | spdx license identifier ms rl
2 | postgresql | spdx license identifier postgresql | spdx license identifier postgresql
2 | openssl | spdx license identifier openssl | spdx license identifier openssl
2 | curl | spdx license identifier curl | spdx license identifier curl
2 | x11 | spdx license identifier x11 | spdx license identifier x11
2 | ncsa | spdx license identifier ncsa | spdx license identifier ncsa
2 | w3c | spdx license identifier w3c | spdx license identifier w3c
2 | odbl | spdx license identifier odbl | spdx license identifier odbl 1 0
2 | elastic | spdx license identifier elastic | spdx license identifier elastic 2 0
2 | proprietary | spdx license identifier licenseref | spdx license identifier licenseref (?:proprietary|commercial)
2 | mit | under the mit license | (?:licensed|released|distributed|available|published|provided) under the mit license
2 | mit | under the terms of the mit license | under the terms of the mit license
2 | mit | mit licensed | (?:is|are) mit licensed
2 | mit | license mit | license mit(?= (?:license|author|version|homepage|copyright) )
2 | mit | permissive mit | (?:the|a) permissive mit license
2 | apache | under the apache license | (?:licensed|released|distributed|available|published|provided) under the apache license
2 | apache | under the apache software license | (?:licensed|released|distributed|available|published|provided) under the apache software license
2 | apache | licensed to the apache software foundation | licensed to the apache software foundation asf under one or more contributor license agreements
2 | apache | under the terms of the apache license | under the terms of the apache license
2 | apache | org licenses license 2 0 | www apache org licenses license 2 0(?: txt| html)?
2 | apache | apache licensed | (?:is|are) apache licensed
2 | gpl | general public license as published by the free software foundation | (?:gnu )?general public license as published by the free software foundation
2 | gpl | general public license version 2 | general public license version 2(?: 0)?(?: only| or (?:at your option )?any later version)?
2 | gpl | general public license version 3 | general public license version 3(?: 0)?(?: only| or (?:at your option )?any later version)?
2 | gpl | under the gpl licen | (?:licensed|released|distributed|available|published|provided) under the gpl licen[sc]e
2 | gpl | under the gnu general public license | (?:licensed|released|distributed|available|published|provided) under the gnu general public license
2 | gpl | org licenses gpl | www gnu org licenses gpl(?: [23] 0)?(?: html| txt)?
2 | gpl | licensed under gpl | licensed under gpl ?v?[23]?
2 | lgpl | lesser general public license version | lesser general public license version (?:2 1|3)
2 | lgpl | library general public license version 2 | library general public license version 2
2 | lgpl | under the lgpl licen | (?:licensed|released|distributed|available|published|provided) under the lgpl licen[sc]e
2 | lgpl | org licenses lgpl | www gnu org licenses lgpl(?: [23] [01])?(?: html| txt)?
2 | agpl | affero general public license version | affero general public license version [13]
2 | agpl | org licenses agpl | www gnu org licenses agpl(?: 3 0)?(?: html| txt)?
2 | agpl | licensed under the agpl | licensed under the agpl ?v?3?
2 | bsd | under the bsd license | (?:licensed|released|distributed|available|published|provided) under the bsd license
2 | bsd | bsd style license that can be found in the license file | use of this source code is governed by a bsd style license that can be found in the license file
2 | bsd | under a bsd style license | under a bsd style license
2 | bsd-2-clause | 2 clause bsd license | (?:the )?2 clause bsd license
2 | bsd-2-clause | simplified bsd license | (?:the )?simplified bsd license
2 | bsd-3-clause | 3 clause bsd license | (?:the )?3 clause bsd license
2 | bsd-3-clause | bsd license | (?:new|revised|modified) bsd license
2 | bsd-4-clause | bsd license | (?:original|old) bsd license
2 | isc | under the isc license | (?:licensed|released|distributed|available|published|provided) under the isc license
2 | mpl | under the mozilla public license | (?:licensed|released|distributed|available|published|provided) under the mozilla public license
2 | mpl | mozilla public license version 2 0 | mozilla public license version 2 0
2 | epl | under the eclipse public license | (?:licensed|released|distributed|available|published|provided) under the eclipse public license
2 | epl | eclipse public license v | eclipse public license v (?:1 0|2 0)
2 | cc by | under a creative commons attribution | licensed under a creative commons attribution [1234] [05] international license
2 | cc by | commons org licenses by | creative ?commons org licenses by [1234] [05]
2 | cc by-sa | licensed under a creative commons attribution share | licensed under a creative commons attribution share ?alike
2 | cc by-sa | creative commons attribution share | creative commons attribution share ?alike [1234] [05]
2 | cc by-nc | creative commons attribution non | creative commons attribution non ?commercial(?: share ?alike| no ?derivatives)?(?: [1234] [05])?
2 | cc by-nd | creative commons attribution no | creative commons attribution no ?deriv(?:ative)?s(?: [1234] [05])?
2 | cc0 | commons cc0 | creative commons cc0(?: 1 0)?(?: universal)?
2 | cc0 | commons zero | creative commons zero(?: v?1 0)?(?: universal)?
2 | boost | under the boost software license | under the boost software license
2 | artistic | under the artistic license | under the artistic license(?: 2 0)?
2 | perl | under the same terms as perl itself licen | under the same terms as perl itself licen[sc]e
2 | unlicense | licensed under the unlicense | licensed under the unlicense
2 | ofl | under the sil open font license | under the sil open font license
2 | eupl | european union public licen | european union public licen[sc]e(?: v ?1 [012])?
3 | apache | copy of the license at | you may obtain a copy of the license at(?: https?)? www apache org
3 | mit | license that can be found in the license file | governed by an mit style license that can be found in the license file
3 | gpl | see the gnu general public license for more details | see the gnu general public license for more details
3 | lgpl | see the gnu lesser general public license for more details | see the gnu lesser general public license for more details
3 | agpl | see the gnu affero general public license for more details | see the gnu affero general public license for more details
3 | gpl | see the file copying licen | see the file copying licen[sc]e
3 | cc by | under a creative commons license | (?:provided|published|available|released) under a creative commons license
3 | cc by | some rights reserved creative commons | some rights reserved creative commons
3 | wtfpl | wtfpl licen | (?:under|the) wtfpl licen[sc]e
3 | proprietary | end user license agreement | end user license agreement
3 | proprietary | commercial license | (?:under|requires|purchase|buy) a commercial license
3 | proprietary | license agreement | (?:software|master|site|source) license agreement
4 | apache | apache license version 2 0 | (?:the )?apache license version 2 0
4 | apache | apache license 2 0 | (?:the )?apache license 2 0
4 | apache | apache license | apache license v ?2
4 | apache | apache 2 0 licen | apache 2 0 licen[sc]ed?
4 | gpl | gpl v2 licen | gpl v2 licen[sc]ed?
4 | gpl | gpl v3 licen | gpl v3 licen[sc]ed?
4 | gpl | gplv2 licen | gplv2 licen[sc]ed?
4 | gpl | gplv3 licen | gplv3 licen[sc]ed?
4 | lgpl | lgpl licen | lgpl licen[sc]ed?
4 | agpl | agpl licen | agpl licen[sc]ed?
4 | mpl | mpl 2 0 licen | mpl 2 0 licen[sc]ed?
4 | epl | epl 2 0 licen | epl 2 0 licen[sc]ed?
4 | cddl | cddl licen | cddl licen[sc]ed?
4 | boost | boost software license | boost software license(?: version)? 1 0
4 | artistic | artistic license 2 0 | artistic license 2 0
4 | php | php license | php license(?: version)? 3 0 ?1?
4 | zlib | zlib libpng license | zlib libpng license
4 | w3c | w3c software notice and license | w3c software notice and license
5 | mit | mit license | (?:the )?mit license
5 | mit | expat license | (?:the )?expat license
5 | x11 | x11 license | (?:the )?x11 license
5 | apache | apache license | (?:the )?apache license
5 | apache | apache software license | (?:the )?apache software license
5 | gpl | general public license | (?:the )?(?:gnu )?general public license
5 | gpl | gpl licen | (?:gnu )?gpl licen[sc]ed?
5 | lgpl | lesser general public license | (?:the )?(?:gnu )?lesser general public license
5 | lgpl | library general public license | (?:the )?(?:gnu )?library general public license
5 | agpl | affero general public license | (?:the )?(?:gnu )?affero general public license
5 | gfdl | free documentation license | (?:the )?(?:gnu )?free documentation license
5 | bsd | bsd license | (?:the )?bsd license
5 | isc | isc license | (?:the )?isc license
5 | mpl | mozilla public license | (?:the )?mozilla public license
5 | epl | eclipse public license | (?:the )?eclipse public license
5 | cpl | common public license | (?:the )?common public license
5 | cddl | common development and distribution license | (?:the )?common development and distribution license
5 | cc by | creative commons attribution license | creative commons attribution license
5 | cc by | creative commons licen | creative commons licen[sc]ed?
5 | zlib | zlib license | (?:the )?zlib license
5 | boost | boost software license | (?:the )?boost software license
5 | boost | boost license | (?:the )?boost license
5 | artistic | artistic license | (?:the )?artistic license
5 | python | python software foundation license | (?:the )?python software foundation license
5 | php | php license | (?:the )?php license
5 | unlicense | unlicense | the unlicense
5 | ofl | open font license | (?:the )?(?:sil )?open font license
5 | ms-pl | microsoft public license | (?:the )?microsoft public license
5 | ms-rl | microsoft reciprocal license | (?:the )?microsoft reciprocal license
5 | postgresql | postgresql license | (?:the )?postgresql license
5 | openssl | openssl license | (?:the )?openssl license
5 | ncsa | illinois ncsa open source license | (?:university of )?illinois ncsa open source license
5 | odbl | open database license | (?:the )?open database license
5 | elastic | elastic license | (?:the )?elastic license
5 | sspl | server side public license | (?:the )?server side public license
5 | bsl | business source license | (?:the )?business source license
5 | ecl | educational community license | (?:the )?educational community license
5 | osl | open software license | (?:the )?open software license
5 | afl | academic free license | (?:the )?academic free license
5 | cecill | cecill licen | (?:the )?cecill licen[sc]e
5 | beerware | beerware license | (?:the )?beerware license
5 | json | json license | (?:the )?json license
5 | sleepycat | sleepycat license | (?:the )?sleepycat license
5 | vim | vim license | (?:the )?vim license
5 | ruby | ruby license | (?:the )?ruby license
5 | perl | perl 5 license | (?:the )?perl 5 license
6 | public domain | public domain | (?:released|placed|dedicated) (?:in|into|to) the public domain
6 | public domain | public domain | (?:is|are) in the public domain
6 | public domain | public domain dedication | public domain dedication
6 | public domain | no copyright restrictions | no copyright restrictions
6 | copyleft | copyleft | copyleft all wrongs reserved
6 | permissive | permission is granted | permission is granted to (?:freely )?(?:use|copy|distribute)
7 | proprietary | all rights reserved | all rights reserved
7 | proprietary | proprietary and confidential | proprietary and confidential
7 | proprietary | confidential and proprietary | confidential and proprietary
7 | proprietary | prior written permission | without the (?:express )?prior written permission
7 | proprietary | without written permission | (?:reproduction|redistribution|copying) without written permission
7 | proprietary | permission is strictly prohibited | without (?:prior )?permission is strictly prohibited
7 | proprietary | redistribution is prohibited | redistribution is prohibited
7 | proprietary | redistribution is not permitted | redistribution is not permitted
7 | proprietary | licensed not sold | licensed not sold
7 | non-commercial | commercial use is not permitted | commercial use is not permitted
7 | disclaimer | no warranty | (?:there is|with|provides) no warranty
7 | disclaimer | not liable | (?:is|are) not liable for any damages?
8 | notice | copyright c | copyright c (?:19|20)[0-9]{2}
8 | notice | copyright | copyright (?:19|20)[0-9]{2}
8 | notice | copyright © | copyright © (?:19|20)[0-9]{2}
9 | unknown | licen | licen[sc]e[ds]?
"""


def build_rules() -> list[tuple[int, str, str, str]]:
    """(priority, label, keyword, regex) of every line."""
    rules = [tuple(map(str.strip, line.split(" | "))) for line in SIGNATURES.strip().splitlines()]
    return [(int(p), label, keyword, regex) for p, label, keyword, regex in rules]
