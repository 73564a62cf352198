"""Signatures of licenses' own sentences and notices, one a line: label, keyword, pattern.

Patterns are regexes over text in lower case, written for the sentences by which a license body or a customary notice is known;
a space in them stands for any run of white space and comment signs. A line's kind gives its priority and weight.
"""

#: Sentences that stand in a license's own text.
BODIES = r"""
mit | permission is hereby granted | permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
mit | above copyright notice | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | without limitation the rights | to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense
mit | authors or copyright holders | in no event shall the authors or copyright holders be liable for any claim, damages or other liability
mit-0 | permission is hereby granted | permission is hereby granted, free of charge, to any person obtaining a copy of this software (?:and associated documentation files )?\(the "software"\), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so\. the software is provided
mit-modern-variant | permission is hereby granted | permission is hereby granted, without written agreement and without license or royalty fees, to use, copy, modify, and distribute this software
x11 | x consortium | except as contained in this notice, the name of the x consortium shall not be used
x11 | advertising or otherwise | except as contained in this notice, the names?\(?s?\)? of (?:the )?(?:above )?copyright holders? shall not be used in advertising or otherwise
isc | permission to use | permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted
isc | author disclaims | the software is provided "as is" and the author disclaims all warranties
isc | with the use or performance | whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software
0bsd | permission to use | permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\. the software is provided
hpnd | permission to use | permission to use, copy, modify,? and distribute this software and its documentation for any purpose and without fee is hereby granted
hpnd | supporting documentation | that both that copyright notice and this permission notice appear in supporting documentation
bsd-2-clause | redistribution and use | redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met
bsd-2-clause | source code must retain | redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer
bsd-2-clause | binary form must reproduce | redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
bsd-3-clause | endorse or promote | neither the names? of (?:the )?.{1,120}? (?:nor|or) the names of (?:its|their|any) contributors may be used to endorse or promote products
bsd-3-clause | endorse or promote | may be used to endorse or promote products derived from this software without specific prior written permission
bsd-3-clause-clear | express or implied licenses | no express or implied licenses to any party's patent rights are granted by this license
bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-4-clause-uc | university of california | this product includes software developed by the university of california,? berkeley
bsd-patent | copyright holder and contributor | subject to the terms and conditions of this license, each copyright holder and contributor hereby grants to those receiving rights under this license
bsd | regents | this software is provided by the regents and contributors "?'?as is
bsd | copyright holders and contributors | this software is provided by the copyright holders and contributors "?'?as is
bsd | substitute goods | procurement of substitute goods or services; loss of use, data, or profits; or business interruption
apache-2.0 | terms and conditions for use | terms and conditions for use, reproduction, and distribution 1\. definitions
apache-2.0 | perpetual | each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license
apache-2.0 | as is | unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an "as is" basis
apache-2.0 | may not use this file | you may not use this file except in compliance with the license
apache-1.1 | included with the redistribution | the end-user documentation included with the redistribution, if any, must include the following acknowledge?ment
apache-1.0 | apache group | this product includes software developed by the apache group
apache | apache software foundation | licensed to the apache software foundation \(asf\) under one or more contributor license agreements
gpl-3.0 | free, copyleft | the gnu general public license is a free, copyleft license for software and other kinds of works
gpl-3.0 | version 3, 29 june | gnu general public license version 3, 29 june 2007
gpl-3.0 | an effective technological measure | no covered work shall be deemed part of an effective technological measure
gpl-3.0 | take away | the licenses for most software and other practical works are designed to take away your freedom
gpl-3.0 | installation information | "installation information" for a user product means any methods, procedures, authorization keys
gpl-2.0 | version 2, june 1991 | gnu general public license version 2, june 1991
gpl-2.0 | take away | the licenses for most software are designed to take away your freedom to share and change it
gpl-2.0 | verbatim copies of the program | you may copy and distribute verbatim copies of the program's source code as you receive it
gpl-2.0 | distribute or publish, that in | you must cause any work that you distribute or publish, that in whole or in part contains or is derived from the program
gpl-1.0 | version 1, february 1989 | gnu general public license version 1, february 1989
gpl | this program | (?:this program|this file|it|this library) is free software[;:,] you can redistribute it and/or modify it under the terms of the gnu general public license
gpl | distributed in the hope that it | this program is distributed in the hope that it will be useful, but without any warranty
gpl | comes with absolutely | comes with absolutely no warranty; for details type
gpl-2.0-or-later | either version 2 | gnu general public license as published by the free software foundation[;,] either version 2(?: of the license)?,? or \(at your option\) any later version
gpl-3.0-or-later | either version 3 | gnu general public license as published by the free software foundation[;,] either version 3(?: of the license)?,? or \(at your option\) any later version
gpl-2.0-only | version 2 | gnu general public license version 2 (?:only )?as published by the free software foundation
gpl-classpath-exception | statically or dynamically with | linking this library statically or dynamically with other modules is making a combined work based on this library
gpl-font-exception | unaltered portions of this font | if you create a document which uses this font, and embed this font or unaltered portions of this font into the document
gcc-runtime-exception | runtime library exception | gcc runtime library exception version 3\.1
gpl-linking-exception | link the code | permission to link the code of (?:portions of )?this program with the openssl library
lgpl-2.1 | version 2.1, february 1999 | gnu lesser general public license version 2\.1, february 1999
lgpl-2.0 | version 2, june 1991 | gnu library general public license version 2, june 1991
lgpl-3.0 | version 3, 29 june | gnu lesser general public license version 3, 29 june 2007
lgpl | redistribute it and/or modify it | this library is free software[;:,] you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl | derivative of any portion of the | a program that contains no derivative of any portion of the library, but is designed to work with the library
lgpl-3.0 | additional permissions | incorporates the terms and conditions of version 3 of the gnu general public license, supplemented by the additional permissions
lgpl-2.1-or-later | either version 2.1 | gnu lesser general public license as published by the free software foundation[;,] either version 2\.1(?: of the license)?,? or \(at your option\) any later version
agpl-3.0 | version 3, 19 november | gnu affero general public license version 3, 19 november 2007
agpl-3.0 | remotely through a computer network | all users interacting with it remotely through a computer network
agpl | public license as published | under the terms of the gnu affero general public license as published by
gfdl | copy, distribute and/or modify this document | permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license
gfdl | invariant sections | with no invariant sections, no front-cover texts,? and no back-cover texts
mpl-2.0 | source code form is subject | this source code form is subject to the terms of the mozilla public license, v\. 2\.0
mpl-2.0 | incompatible with secondary | this source code form is "incompatible with secondary licenses"
mpl-1.1 | contents of this file are subject | the contents of this file are subject to the mozilla public license version 1\.1
mpl-1.0 | contents of this file are subject | the contents of this file are subject to the mozilla public license version 1\.0
npl-1.1 | netscape public | the contents of this file are subject to the netscape public license version 1\.1
mpl-1.1 | initial developer | the initial developer of the original code is
epl-1.0 | eclipse public license v1 | this program and the accompanying materials are made available under the terms of the eclipse public license v1\.0
epl-2.0 | eclipse public license | this program and the accompanying materials are made available under the terms of the eclipse public license(?: v\.?)? 2\.0
epl | accompanying program | the accompanying program is provided under the terms of this eclipse public license
cpl-1.0 | accompanying program | the accompanying program is provided under the terms of this common public license
cddl-1.0 | common development and distribution | the contents of this file are subject to the terms of the common development and distribution license
cddl-1.0 | usr/src/opensolaris | you can obtain a copy of the license at usr/src/opensolaris\.license
ipl-1.0 | ibm public | the accompanying program is provided under the terms of this ibm public license
eupl-1.1 | licensed under the eupl | licensed under the eupl,? version 1\.1
eupl-1.2 | european union public | this european union public licence \(the .eupl.\) applies to the work
zlib | as-is | this software is provided 'as-is', without any express or implied warranty\. in no event will the authors be held liable
zlib | origin of this software | the origin of this software must not be misrepresented; you must not claim that you wrote the original software
zlib | altered source versions | altered source versions must be plainly marked as such, and must not be misrepresented as being the original software
libpng | png reference library | the png reference library is supplied "as is"
bsl-1.0 | and accompanying documentation | permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
bsl-1.0 | boost software license | distributed under the boost software license, version 1\.0
artistic-1.0 | artistic control | the copyright holder maintains some semblance of artistic control over the development of the package
artistic-2.0 | standard version | you are permitted to use the standard version and create and use modified versions for any purpose without restriction
perl | same terms as perl | (?:redistribute it and/or modify it )?under the same terms as perl itself
python-2.0 | python software foundation license | python software foundation license version 2
python-2.0 | psf hereby grants | psf hereby grants licensee a nonexclusive, royalty-free, world-wide license
python-cnri | cnri open source | cnri open source license agreement
ofl-1.1 | sil open font license | this font software is licensed under the sil open font license, version 1\.1
ofl-1.1 | reserved font name | with reserved font name
ofl-1.1 | font software | the font software may be sold as part of a larger software package but no copy of one or more of the font software typefaces may be sold by itself
odbl-1.0 | open database license | this .{1,80}? is made available under the open database license
odc-by-1.0 | attribution license | made available under the open data commons attribution license
pddl-1.0 | public domain dedication and license | made available under the public domain dedication and license
odbl-1.0 | offer the database under the odbl | you must also offer the database under the odbl
osl-3.0 | open software license | licensed under the open software license version 3\.0
afl-3.0 | academic free license | licensed under the academic free license version 3\.0
ecl-2.0 | educational community | licensed under the educational community license, version 2\.0
ms-pl | use of the accompanying software | this license governs use of the accompanying software\. if you use the software, you accept this license
ms-rl | distribute that contains code from | for any file you distribute that contains code from the software \(in source code or binary format\), you must provide recipients the source code
ms-lpl | use of code marked as .sample | this license governs use of code marked as .sample
cecill-2.1 | cecill | this software is governed by the cecill license under french law
cecill-c | cecill-c | this software is governed by the cecill-c license under french law
cecill-b | cecill-b | this software is governed by the cecill-b license under french law
postgresql | university of california | in no event shall the university of california be liable to any party for direct, indirect, special, incidental, or consequential damages
postgresql | software and its documentation | permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted
php-3.01 | php license | this source file is subject to version 3\.01 of the php license
php-3.0 | php license | this source file is subject to version 3\.0 of the php license
zend-2.0 | zend | this source file is subject to version 2\.0 of the zend license
ruby | make and give away | you may make and give away verbatim copies of the source form of the software without restriction
ruby | bsdl | (?:ruby is copyrighted free software|you can redistribute it and/or modify it under either the terms of the 2-clause bsdl)
openssl | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | eric young | this product includes cryptographic software written by eric young
ncsa | deal with the software | to deal with the software without restriction, including without limitation the rights to use, copy, modify, merge, publish
ncsa | contributors may be used | neither the names of .{1,120}? nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
qpl-1.0 | q public | this license applies to any software containing a notice placed by the copyright holder saying that it may be distributed under the terms of the q public license
lppl-1.3c | latex project public | this work may be distributed and/or modified under the conditions of the latex project public license
lppl-1.3c | maintenance status | this work has the lppl maintenance status
upl-1.0 | software, associated documentation | to any person obtaining a copy of this software, associated documentation and/or data \(collectively the "software"\)
blueoak-1.0.0 | freely|much permission | everyone may use this software as freely|this license gives everyone as much permission to work with this software as possible
mulanpsl-2.0 | mulan | licensed under mulan psl v2
unlicense | free and unencumbered | this is free and unencumbered software released into the public domain
unlicense | dedicate any and all | the author or authors of this software dedicate any and all copyright interest in the software to the public domain
wtfpl | you just do what | you just do what the fuck you want to
cc0-1.0 | waived all copyright | has waived all copyright and related or neighboring rights
cc0-1.0 | cc0 1.0 universal | cc0 1\.0 universal(?: public domain dedication)?
cc0-1.0 | publicdomain/zero | creativecommons\.org/publicdomain/zero/1\.0
cc-pdm-1.0 | publicdomain/mark | creativecommons\.org/publicdomain/mark/1\.0
cc-by-4.0 | attribution 4.0 | creative commons attribution 4\.0 international
cc-by-3.0 | attribution 3.0 | creative commons attribution 3\.0 (?:unported|united states|license)
cc-by-sa-4.0 | sharealike 4.0 | creative commons attribution-sharealike 4\.0 international
cc-by-sa-3.0 | creative commons attribution-share | creative commons attribution-share-?alike 3\.0 (?:unported|united states|license)
cc-by-nc-4.0 | noncommercial 4.0 | creative commons attribution-noncommercial 4\.0 international
cc-by-nc-sa-4.0 | noncommercial-sharealike | creative commons attribution-noncommercial-sharealike 4\.0 international
cc-by-nc-nd-4.0 | noncommercial-noderiv | creative commons attribution-noncommercial-noderiv(?:ative)?s 4\.0 international
cc-by-nd-4.0 | noderiv | creative commons attribution-noderiv(?:ative)?s 4\.0 international
cc-by | creativecommons.org | creativecommons\.org/licenses/by/[1-4]\.[05]
cc-by-sa | creativecommons.org | creativecommons\.org/licenses/by-sa/[1-4]\.[05]
cc-by-nc | creativecommons.org | creativecommons\.org/licenses/by-nc/[1-4]\.[05]
cc-by-nd | creativecommons.org | creativecommons\.org/licenses/by-nd/[1-4]\.[05]
cc-by-nc-sa | creativecommons.org | creativecommons\.org/licenses/by-nc-sa/[1-4]\.[05]
cc-by-nc-nd | creativecommons.org | creativecommons\.org/licenses/by-nc-nd/[1-4]\.[05]
cc-by | you are free to | you are free to: share . copy and redistribute the material in any medium or format
sspl-1.0 | server side public | server side public license version 1, october 16, 2018
sspl-1.0 | functionality of the program or | making the functionality of the program or modified version available to third parties as a service
elastic-2.0 | elastic license | licensed under the elastic license(?: 2\.0)?
busl-1.1 | business source license | the business source license \(this document, or the .license.\) is not an open source license
busl-1.1 | change date | on the change date, or the fourth anniversary of the first publicly available distribution
commons-clause | subject to the following condition | the software is provided to you by the licensor under the license, as defined below, subject to the following condition
polyform-noncommercial-1.0.0 | polyform | polyform noncommercial license 1\.0\.0
json | good, not evil | the software shall be used for good, not evil
beerware | this notice you can do whatever | as long as you retain this notice you can do whatever you want with this stuff
curl | daniel stenberg | copyright (?:\(c\) )?[0-9 ,-]+ daniel stenberg
ftl | freetype | portions of this software are copyright .{1,40}? the freetype project
ijg | independent jpeg | this software is based in part on the work of the independent jpeg group
icu | and associated documentation | permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files \(the "software"\), to deal in the software without restriction, .{1,200}? provided that the above copyright notice\(s\) and this permission notice appear in all copies
unicode | unicode, inc | unicode, inc\. license agreement
vim | vim is charityware | vim is charityware
tcl | software and its documentation | the authors hereby grant permission to use, copy, modify, distribute, and license this software and its documentation for any purpose
w3c | read, understood, and will comply | by obtaining, using and/or copying this work, you \(the licensee\) agree that you have read, understood, and will comply
xfree86 | xfree86 | the name of the xfree86 project,? inc\.? shall not be used in advertising
nunit | nunit | portions copyright .{1,60}? nunit
sleepycat | redistributions in any form must | redistributions in any form must be accompanied by information on how to obtain complete source code for the
intel | intel corporation | nor the names? of intel corporation (?:nor|or) the names of its contributors
nvidia | nvidia | nvidia corporation and its licensors retain all intellectual property and proprietary rights
llama-community | llama | llama [0-9.]* ?community license agreement
gemma | gemma | gemma is provided under and subject to the gemma terms of use
rail-m | use-based restrictions | use-based restrictions as referenced in paragraph 5
proprietary | confidential | (?:this|the) (?:software|file|document|code) (?:is|contains) (?:the )?(?:confidential|proprietary)
proprietary | unauthorized copying | unauthorized copying of this (?:file|software|document),? via any medium,? is strictly prohibited
proprietary | no part of this | no part of this (?:publication|document|work|book) may be reproduced
proprietary | e agreement | end[- ]user licen[sc]e agreement
proprietary | reverse engineer | you may not reverse engineer, decompile,? or disassemble
non-commercial | personal | for (?:personal|private|academic|research)(?:,? (?:and|or))? non-?commercial use only
non-commercial | commercial use | commercial use (?:is )?(?:strictly )?(?:prohibited|not permitted|forbidden)
evaluation | evaluation purposes | for evaluation purposes only
public-domain | public domain | (?:is|has been) (?:hereby )?(?:placed|released|dedicated) (?:in|into|to) the public domain
public-domain | no copyright | no copyright is claimed
public-domain | united states | work of the (?:united states|u\.s\.) government
"""

#: Customary references to a license by address or file.
REFERENCES = r"""
apache-2.0 | apache.org/licenses | apache\.org/licenses/license-2\.0
apache-1.1 | apache.org/licenses | apache\.org/licenses/license-1\.1
mit | opensource.org | opensource\.org/licen[sc]es?/mit
bsd-2-clause | opensource.org | opensource\.org/licen[sc]es?/bsd-2-clause
bsd-3-clause | opensource.org | opensource\.org/licen[sc]es?/bsd-3-clause
isc | opensource.org | opensource\.org/licen[sc]es?/isc
artistic-2.0 | opensource.org | opensource\.org/licen[sc]es?/artistic-2\.0
cpl-1.0 | opensource.org | opensource\.org/licen[sc]es?/cpl1
gpl-2.0 | gnu.org/licenses | gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
gpl-3.0 | gnu.org/licenses | gnu\.org/licenses/gpl-3\.0
gpl | gnu.org/licenses | gnu\.org/licenses/gpl(?:\.html|\.txt)?(?![-\w])
gpl | gnu.org/copyleft | gnu\.org/copyleft/gpl
lgpl-2.1 | gnu.org/licenses | gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1
lgpl-3.0 | gnu.org/licenses | gnu\.org/licenses/lgpl-3\.0
agpl-3.0 | gnu.org/licenses | gnu\.org/licenses/agpl-3\.0
gfdl | gnu.org/licenses | gnu\.org/licenses/fdl
mpl-2.0 | mozilla.org | mozilla\.org/mpl/2\.0
mpl-1.1 | mozilla.org | mozilla\.org/mpl/mpl-1\.1
mpl | mozilla.org | mozilla\.org/mpl/?(?!\w)
epl-1.0 | eclipse.org/legal | eclipse\.org/legal/epl-v10
epl-2.0 | eclipse.org/legal | eclipse\.org/legal/epl-(?:2\.0|v20)
bsl-1.0 | boost.org | boost\.org/license_1_0
unlicense | unlicense.org | unlicense\.org
ofl-1.1 | scripts.sil.org | scripts\.sil\.org/ofl
php-3.01 | php.net/license | php\.net/license/3_01
cecill | cecill.info | cecill\.info
odbl-1.0 | opendatacommons.org | opendatacommons\.org/licenses/odbl
pddl-1.0 | opendatacommons.org | opendatacommons\.org/licenses/pddl
wtfpl | wtfpl.net | wtfpl\.net
zlib | zlib.net | zlib\.net/zlib_license
lppl | latex-project.org | latex-project\.org/lppl
artistic-2.0 | perlfoundation.org | perlfoundation\.org/artistic_license_2_0
afl-3.0 | opensource.org | opensource\.org/licen[sc]es?/afl-3\.0
osl-3.0 | opensource.org | opensource\.org/licen[sc]es?/osl-3\.0
sspl-1.0 | mongodb.com | mongodb\.com/licensing/server-side-public-license
elastic-2.0 | elastic.co | elastic\.co/licensing/elastic-license
"""


def lines(block: str) -> list[tuple[str, tuple[str, ...], str]]:
    """(label, keywords, pattern) of each line; a keyword stands between bars, several by a bar without spaces."""
    out = []
    for line in block.strip().splitlines():
        label, keywords, pattern = line.split(" | ", 2)
        out.append((label, tuple(keywords.split("|")), pattern))
    return out
