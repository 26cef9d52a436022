"""Signature rules of the licence scan, in order: licence, priority, keyword, pattern.

A blank in a pattern stands for any white space.  A rule is tried only where its
keyword occurs in the text in lower case with each hyphen and each run of white
space taken as one blank; every match of a rule contains it.
Priority 3: a licence with its version; 2: a licence by name or its own
sentences; 1: a family or an unclear mention.
"""

RULES = r"""
Apache-2.0|3|apache|(?:licensed under )?(?:the )?apache (?:software )?license,? (?:version|v\.?) ?2(?:\.0)?\b
Apache-2.0|3|apache|\bapache[- ]2(?:\.0)? licen[sc]ed?\b
Apache-2.0|3|spdx license identifier|spdx-license-identifier: apache-2\.0\b
Apache-2.0|3|apache|https?://(?:www\.)?apache\.org/licenses/license-2\.0(?:\.txt|\.html)?
Apache-2.0|2|compliance|you may not use this file except in compliance with the license\b
Apache-2.0|2|as is|distributed on an "as is" basis, without (?:any )?warranties or conditions
Apache-1.1|3|apache|(?:the )?apache software license,? (?:version|v\.?) ?1\.1\b
Apache-1.1|3|spdx license identifier|spdx-license-identifier: apache-1\.1\b
Apache-1.0|3|apache|(?:the )?apache (?:software )?license,? (?:version|v\.?) ?1\.0\b
Apache-1.0|3|spdx license identifier|spdx-license-identifier: apache-1\.0\b
Apache|1|apache|\bapache (?:software )?licen[sc]ed?\b
MIT|3|mit licen|(?:released|licensed|distributed|available|provided) under (?:the )?(?:terms of )?(?:the )?mit licen[sc]e\b
MIT|3|spdx license identifier|spdx-license-identifier: mit\b
MIT|3|opensource.org|https?://(?:www\.)?opensource\.org/licenses/mit(?:-license)?(?:\.php)?\b
MIT|2|mit licen|\b(?:the )?mit licen[sc]ed?\b
MIT|2|: mit|\blicen[sc]e: mit\b
MIT|2|expat|\bexpat licen[sc]e\b
MIT|2|permission is hereby granted|permission is hereby granted, free of charge, to any person obtaining a copy of this software
MIT|2|above copyright notice|the above copyright notice and this permission notice shall be included in all copies or substantial portions
MIT|1|as is|the software is provided "as is", without warranty of any kind, express or implied
MIT-0|3|mit no attribution|\bmit no attribution(?: licen[sc]e)?\b
MIT-0|3|spdx license identifier|spdx-license-identifier: mit-0\b
X11|3|x11|\bx11 licen[sc]e\b
X11|3|spdx license identifier|spdx-license-identifier: x11\b
X11|2|consortium|except as contained in this notice, the name of the x consortium shall not be used
BSD-2-Clause|3|bsd|\b(?:2[- ]clause|two[- ]clause|simplified|freebsd)[- ]bsd licen[sc]e\b
BSD-2-Clause|3|bsd|\bbsd[- ]2[- ]clause\b(?: licen[sc]e)?
BSD-2-Clause|3|spdx license identifier|spdx-license-identifier: bsd-2-clause\b
BSD-2-Clause|3|bsd|https?://(?:www\.)?opensource\.org/licenses/bsd-2-clause\b
BSD-3-Clause|3|bsd|\b(?:3[- ]clause|three[- ]clause|new|modified|revised)[- ]bsd licen[sc]e\b
BSD-3-Clause|3|bsd|\bbsd[- ]3[- ]clause\b(?: licen[sc]e)?
BSD-3-Clause|3|spdx license identifier|spdx-license-identifier: bsd-3-clause\b
BSD-3-Clause|3|bsd|https?://(?:www\.)?opensource\.org/licenses/bsd-3-clause\b
BSD-3-Clause|2|endorse|neither the name of (?:(?!\n\s*\n|neither the name of)[\s\S])+? may be used to endorse or promote products
BSD-4-Clause|3|bsd|\b(?:4[- ]clause|four[- ]clause|original)[- ]bsd licen[sc]e\b
BSD-4-Clause|3|spdx license identifier|spdx-license-identifier: bsd-4-clause\b
BSD-4-Clause|2|advertising|all advertising materials mentioning features or use of this software must display
BSD-1-Clause|3|spdx license identifier|spdx-license-identifier: bsd-1-clause\b
0BSD|3|bsd|\b(?:zero[- ]clause bsd|bsd zero[- ]clause)(?: licen[sc]e)?\b
0BSD|3|spdx license identifier|spdx-license-identifier: 0bsd\b
BSD|1|redistribution|redistribution and use in source and binary forms, with or without modification, are permitted
BSD|1|redistribution|redistributions of source code must retain the above copyright notice
BSD|1|redistribution|redistributions in binary form must reproduce the above copyright notice
BSD|1|bsd|\bbsd[- ]licen[sc]ed?\b
BSD|1|bsd|\bbsd[- ]style licen[sc]e\b
ISC|3|spdx license identifier|spdx-license-identifier: isc\b
ISC|2|isc licen|\bisc licen[sc]ed?\b
ISC|2|permission to use|permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted
GPL-3.0|3|gnu general public|(?:licensed under )?(?:the )?(?:terms of the )?gnu general public license(?:,? as published by the free software foundation)?[,;]? (?:either )?(?:version|v\.?) ?3(?:\.0)?\b(?!(?:\.0)?(?: of the license)?,? or,? (?:\(?at your option\)?,? )?(?:any )?later)
GPL-3.0|3|gpl|\b(?:gnu )?gpl[- ]?(?:v|version )?3(?:\.0)?\b(?!\+|-or-later| or later)
GPL-3.0|3|spdx license identifier|spdx-license-identifier: gpl-3\.0(?:-only)?\b(?!-)
GPL-3.0|3|gnu.org|https?://(?:www\.)?gnu\.org/licenses/gpl-3\.0(?:\.txt|\.html|\.en\.html)?
GPL-3.0-or-later|3|gnu general public|(?:the )?gnu general public license(?:,? as published by the free software foundation)?[,;]? (?:either )?(?:version|v\.?) ?3(?:\.0)?(?: of the license)?,? or,? (?:\(?at your option\)?,? )?(?:any )?later(?: version)?
GPL-3.0-or-later|3|gpl|\bgpl[- ]?v?3(?:\.0)?(?:\+|-or-later| or later)
GPL-3.0-or-later|3|spdx license identifier|spdx-license-identifier: gpl-3\.0(?:-or-later|\+)
GPL-2.0|3|gnu general public|(?:licensed under )?(?:the )?(?:terms of the )?gnu general public license(?:,? as published by the free software foundation)?[,;]? (?:either )?(?:version|v\.?) ?2(?:\.0)?\b(?!(?:\.0)?(?: of the license)?,? or,? (?:\(?at your option\)?,? )?(?:any )?later)
GPL-2.0|3|gpl|\b(?:gnu )?gpl[- ]?(?:v|version )?2(?:\.0)?\b(?!\+|-or-later| or later)
GPL-2.0|3|spdx license identifier|spdx-license-identifier: gpl-2\.0(?:-only)?\b(?!-)
GPL-2.0|3|gnu.org|https?://(?:www\.)?gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0(?:\.txt|\.html|\.en\.html)?
GPL-2.0-or-later|3|gnu general public|(?:the )?gnu general public license(?:,? as published by the free software foundation)?[,;]? (?:either )?(?:version|v\.?) ?2(?:\.0)?(?: of the license)?,? or,? (?:\(?at your option\)?,? )?(?:any )?later(?: version)?
GPL-2.0-or-later|3|gpl|\bgpl[- ]?v?2(?:\.0)?(?:\+|-or-later| or later)
GPL-2.0-or-later|3|spdx license identifier|spdx-license-identifier: gpl-2\.0(?:-or-later|\+)
GPL-1.0|3|gnu general public|(?:the )?gnu general public license(?:,? as published by the free software foundation)?[,;]? (?:either )?(?:version|v\.?) ?1(?:\.0)?\b
GPL-1.0-or-later|3|gnu general public|(?:the )?gnu general public license(?:,? as published by the free software foundation)?[,;]? (?:either )?(?:version|v\.?) ?1(?:\.0)?(?: of the license)?,? or,? (?:\(?at your option\)?,? )?(?:any )?later(?: version)?
GPL-1.0|3|spdx license identifier|spdx-license-identifier: gpl-1\.0(?:-only)?\b(?!-or-later|\+)
GPL-1.0-or-later|3|spdx license identifier|spdx-license-identifier: gpl-1\.0(?:-or-later|\+)
GPL|2|gnu general public|\b(?:licensed under )?(?:the )?gnu general public licen[sc]e\b
GPL|1|gpl|\b(?:gnu )?gpl(?: licen[sc]ed?)?\b
GPL|2|free software|this program is free software[:;] you can redistribute it and/or modify it
GPL|1|merchantability|without even the implied warranty of merchantability or fitness for a particular purpose
LGPL-3.0|3|lesser general public|(?:the )?gnu lesser general public license(?:,? as published by the free software foundation)?[,;]? (?:either )?(?:version|v\.?) ?3(?:\.0)?\b
LGPL-3.0-or-later|3|lesser general public|(?:the )?gnu lesser general public license(?:,? as published by the free software foundation)?[,;]? (?:either )?(?:version|v\.?) ?3(?:\.0)?(?: of the license)?,? or,? (?:\(?at your option\)?,? )?(?:any )?later(?: version)?
LGPL-3.0|3|lgpl|\blgpl[- ]?v?3(?:\.0)?(?!\+|-or-later| or later)
LGPL-3.0-or-later|3|lgpl|\blgpl[- ]?v?3(?:\.0)?(?:\+|-or-later| or later)
LGPL-3.0|3|spdx license identifier|spdx-license-identifier: lgpl-3\.0(?:-only)?\b(?!-or-later|\+)
LGPL-3.0-or-later|3|spdx license identifier|spdx-license-identifier: lgpl-3\.0(?:-or-later|\+)
LGPL-3.0|3|gnu.org|https?://(?:www\.)?gnu\.org/licenses/lgpl-3\.0(?:\.txt|\.html)?
LGPL-2.1|3|lesser general public|(?:the )?gnu lesser general public license(?:,? as published by the free software foundation)?[,;]? (?:either )?(?:version|v\.?) ?2\.1\b
LGPL-2.1-or-later|3|lesser general public|(?:the )?gnu lesser general public license(?:,? as published by the free software foundation)?[,;]? (?:either )?(?:version|v\.?) ?2\.1(?: of the license)?,? or,? (?:\(?at your option\)?,? )?(?:any )?later(?: version)?
LGPL-2.1|3|lgpl|\blgpl[- ]?v?2\.1(?!\+|-or-later| or later)
LGPL-2.1-or-later|3|lgpl|\blgpl[- ]?v?2\.1(?:\+|-or-later| or later)
LGPL-2.1|3|spdx license identifier|spdx-license-identifier: lgpl-2\.1(?:-only)?\b(?!-or-later|\+)
LGPL-2.1-or-later|3|spdx license identifier|spdx-license-identifier: lgpl-2\.1(?:-or-later|\+)
LGPL-2.1|3|gnu.org|https?://(?:www\.)?gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1(?:\.txt|\.html)?
LGPL-2.0|3|library general public|(?:the )?gnu library general public license(?:,? as published by the free software foundation)?[,;]? (?:either )?(?:version|v\.?) ?2(?:\.0)?\b
LGPL-2.0-or-later|3|library general public|(?:the )?gnu library general public license(?:,? as published by the free software foundation)?[,;]? (?:either )?(?:version|v\.?) ?2(?:\.0)?(?: of the license)?,? or,? (?:\(?at your option\)?,? )?(?:any )?later(?: version)?
LGPL-2.0|3|spdx license identifier|spdx-license-identifier: lgpl-2\.0(?:-only)?\b(?!-or-later|\+)
LGPL-2.0-or-later|3|spdx license identifier|spdx-license-identifier: lgpl-2\.0(?:-or-later|\+)
LGPL|2|lesser general public|\b(?:the )?gnu lesser general public licen[sc]e\b
LGPL|2|library general public|\b(?:the )?gnu library general public licen[sc]e\b
LGPL|1|lgpl|\blgpl(?: licen[sc]ed?)?\b
AGPL-3.0|3|affero general public|(?:the )?gnu affero general public license(?:,? as published by the free software foundation)?[,;]? (?:either )?(?:version|v\.?) ?3(?:\.0)?\b
AGPL-3.0-or-later|3|affero general public|(?:the )?gnu affero general public license(?:,? as published by the free software foundation)?[,;]? (?:either )?(?:version|v\.?) ?3(?:\.0)?(?: of the license)?,? or,? (?:\(?at your option\)?,? )?(?:any )?later(?: version)?
AGPL-3.0|3|agpl|\bagpl[- ]?v?3(?:\.0)?(?!\+|-or-later| or later)
AGPL-3.0-or-later|3|agpl|\bagpl[- ]?v?3(?:\.0)?(?:\+|-or-later| or later)
AGPL-3.0|3|spdx license identifier|spdx-license-identifier: agpl-3\.0(?:-only)?\b(?!-or-later|\+)
AGPL-3.0-or-later|3|spdx license identifier|spdx-license-identifier: agpl-3\.0(?:-or-later|\+)
AGPL-3.0|3|gnu.org|https?://(?:www\.)?gnu\.org/licenses/agpl-3\.0(?:\.txt|\.html)?
AGPL-1.0|3|affero general public|\baffero general public license(?:,? as published by the free software foundation)?[,;]? (?:either )?(?:version|v\.?) ?1(?:\.0)?\b
AGPL-1.0-or-later|3|affero general public|\baffero general public license(?:,? as published by the free software foundation)?[,;]? (?:either )?(?:version|v\.?) ?1(?:\.0)?(?: of the license)?,? or,? (?:\(?at your option\)?,? )?(?:any )?later(?: version)?
AGPL|2|affero general public|\b(?:the )?(?:gnu )?affero general public licen[sc]e\b
AGPL|1|agpl|\bagpl(?: licen[sc]ed?)?\b
GFDL-1.3|3|free documentation|(?:the )?gnu free documentation license,? (?:version|v\.?) ?1\.3\b
GFDL-1.2|3|free documentation|(?:the )?gnu free documentation license,? (?:version|v\.?) ?1\.2\b
GFDL-1.1|3|free documentation|(?:the )?gnu free documentation license,? (?:version|v\.?) ?1\.1\b
GFDL|2|free documentation|\b(?:the )?gnu free documentation licen[sc]e\b
GFDL|1|gfdl|\bgfdl\b
GFDL-1.3|3|spdx license identifier|spdx-license-identifier: gfdl-1\.3(?:-only|-or-later)?\b
MPL-2.0|3|mozilla|(?:the )?mozilla public license,? (?:version|v\.?) ?2(?:\.0)?\b
MPL-2.0|3|spdx license identifier|spdx-license-identifier: mpl-2\.0\b
MPL-2.0|3|mpl|\bmpl[- ]?(?:v|version )?2(?:\.0)?\b
MPL-2.0|3|mozilla|https?://(?:www\.)?mozilla\.org/(?:en-us/)?mpl/2\.0/?
MPL-1.1|3|mozilla|(?:the )?mozilla public license,? (?:version|v\.?) ?1\.1\b
MPL-1.1|3|mpl|\bmpl[- ]?1\.1\b
MPL-1.0|3|mozilla|(?:the )?mozilla public license,? (?:version|v\.?) ?1\.0\b
MPL|2|mozilla|\b(?:the )?mozilla public licen[sc]e\b
MPL|2|source code form|this source code form is subject to the terms of the mozilla public license
EPL-2.0|3|eclipse|(?:the )?eclipse public license,?(?: -)? (?:version|v\.?) ?2(?:\.0)?\b
EPL-2.0|3|spdx license identifier|spdx-license-identifier: epl-2\.0\b
EPL-2.0|3|eclipse|https?://(?:www\.)?eclipse\.org/legal/epl-2\.0/?
EPL-1.0|3|eclipse|(?:the )?eclipse public license,?(?: -)? (?:version|v\.?) ?1(?:\.0)?\b
EPL-1.0|3|spdx license identifier|spdx-license-identifier: epl-1\.0\b
EPL-1.0|3|eclipse|https?://(?:www\.)?eclipse\.org/legal/epl-v10\.html
EPL|2|eclipse|\b(?:the )?eclipse public licen[sc]e\b
EDL-1.0|3|eclipse|(?:the )?eclipse distribution license,?(?: -)? (?:version|v\.?) ?1(?:\.0)?\b
CPL-1.0|2|common public|(?:the )?common public license(?:,? (?:version|v\.?) ?1(?:\.0)?)?\b
IPL-1.0|2|ibm|(?:the )?ibm public license(?:,? (?:version|v\.?) ?1(?:\.0)?)?\b
CDDL-1.0|3|common development|common development and distribution license(?: \(cddl\))?,? (?:version|v\.?) ?1\.0\b
CDDL-1.1|3|common development|common development and distribution license(?: \(cddl\))?,? (?:version|v\.?) ?1\.1\b
CDDL|2|common development|\bcommon development and distribution licen[sc]e\b
CDDL|1|cddl|\bcddl(?:[- ]1\.[01])?\b
CDDL-1.0|3|spdx license identifier|spdx-license-identifier: cddl-1\.0\b
CC0-1.0|3|cc0|\bcc0(?:[- ]1\.0)?(?: universal)?\b
CC0-1.0|3|spdx license identifier|spdx-license-identifier: cc0-1\.0\b
CC0-1.0|3|creativecommons|https?://(?:www\.)?creativecommons\.org/publicdomain/zero/1\.0/?
CC0-1.0|3|creative commons|creative commons zero(?: v?1\.0)?(?: universal)?\b
CC-BY-4.0|3|cc by|(?:licensed under )?(?:the )?\bcc[- ]by[- ]4\.0\b
CC-BY-4.0|3|creative commons|creative commons attribution 4\.0(?: international)?(?: \(cc by 4\.0\))?(?: licen[sc]e)?
CC-BY-4.0|3|creativecommons|https?://(?:www\.)?creativecommons\.org/licenses/by/4\.0/?
CC-BY-3.0|3|cc by|(?:licensed under )?(?:the )?\bcc[- ]by[- ]3\.0\b
CC-BY-3.0|3|creative commons|creative commons attribution 3\.0(?: unported)?(?: licen[sc]e)?
CC-BY-3.0|3|creativecommons|https?://(?:www\.)?creativecommons\.org/licenses/by/3\.0/?
CC-BY-2.5|3|cc by|(?:licensed under )?(?:the )?\bcc[- ]by[- ]2\.5\b
CC-BY-2.0|3|cc by|(?:licensed under )?(?:the )?\bcc[- ]by[- ]2\.0\b
CC-BY-1.0|3|cc by|(?:licensed under )?(?:the )?\bcc[- ]by[- ]1\.0\b
CC-BY|2|cc by|\bcc[- ]by\b(?![- ](?:nc|nd|sa|[1-4]\.))
CC-BY|1|creative commons|creative commons attribution licen[sc]e\b
CC-BY-SA-4.0|3|cc by|(?:licensed under )?(?:the )?\bcc[- ]by[- ]sa[- ]4\.0\b
CC-BY-SA-4.0|3|creative commons|creative commons attribution[- ]share ?alike 4\.0(?: international)?(?: licen[sc]e)?
CC-BY-SA-4.0|3|creativecommons|https?://(?:www\.)?creativecommons\.org/licenses/by-sa/4\.0/?
CC-BY-SA-3.0|3|cc by|(?:licensed under )?(?:the )?\bcc[- ]by[- ]sa[- ]3\.0\b
CC-BY-SA-3.0|3|creative commons|creative commons attribution[- ]share ?alike 3\.0(?: unported)?(?: licen[sc]e)?
CC-BY-SA-3.0|3|creativecommons|https?://(?:www\.)?creativecommons\.org/licenses/by-sa/3\.0/?
CC-BY-SA-2.5|3|cc by|(?:licensed under )?(?:the )?\bcc[- ]by[- ]sa[- ]2\.5\b
CC-BY-SA-2.0|3|cc by|(?:licensed under )?(?:the )?\bcc[- ]by[- ]sa[- ]2\.0\b
CC-BY-SA|2|cc by|\bcc[- ]by[- ]sa\b(?![- ][1-4]\.)
CC-BY-SA|2|creative commons|creative commons attribution[- ]share ?alike(?: licen[sc]e)?\b
CC-BY-NC-4.0|3|cc by|(?:licensed under )?(?:the )?\bcc[- ]by[- ]nc[- ]4\.0\b
CC-BY-NC-4.0|3|creative commons|creative commons attribution[- ]non-?commercial 4\.0(?: international)?(?: licen[sc]e)?
CC-BY-NC-4.0|3|creativecommons|https?://(?:www\.)?creativecommons\.org/licenses/by-nc/4\.0/?
CC-BY-NC-3.0|3|cc by|(?:licensed under )?(?:the )?\bcc[- ]by[- ]nc[- ]3\.0\b
CC-BY-NC-3.0|3|creativecommons|https?://(?:www\.)?creativecommons\.org/licenses/by-nc/3\.0/?
CC-BY-NC-2.0|3|cc by|(?:licensed under )?(?:the )?\bcc[- ]by[- ]nc[- ]2\.0\b
CC-BY-NC|2|cc by|\bcc[- ]by[- ]nc\b(?![- ](?:nd|sa|[1-4]\.))
CC-BY-NC|2|creative commons|creative commons attribution[- ]non-?commercial(?: licen[sc]e)?\b
CC-BY-NC-SA-4.0|3|cc by|(?:licensed under )?(?:the )?\bcc[- ]by[- ]nc[- ]sa[- ]4\.0\b
CC-BY-NC-SA-4.0|3|creative commons|creative commons attribution[- ]non-?commercial[- ]share ?alike 4\.0(?: international)?(?: licen[sc]e)?
CC-BY-NC-SA-4.0|3|creativecommons|https?://(?:www\.)?creativecommons\.org/licenses/by-nc-sa/4\.0/?
CC-BY-NC-SA-3.0|3|cc by|(?:licensed under )?(?:the )?\bcc[- ]by[- ]nc[- ]sa[- ]3\.0\b
CC-BY-NC-SA-3.0|3|creativecommons|https?://(?:www\.)?creativecommons\.org/licenses/by-nc-sa/3\.0/?
CC-BY-NC-SA|2|cc by|\bcc[- ]by[- ]nc[- ]sa\b(?![- ][1-4]\.)
CC-BY-NC-ND-4.0|3|cc by|(?:licensed under )?(?:the )?\bcc[- ]by[- ]nc[- ]nd[- ]4\.0\b
CC-BY-NC-ND-4.0|3|creative commons|creative commons attribution[- ]non-?commercial[- ]no ?deriv(?:ative)?s 4\.0(?: international)?(?: licen[sc]e)?
CC-BY-NC-ND-4.0|3|creativecommons|https?://(?:www\.)?creativecommons\.org/licenses/by-nc-nd/4\.0/?
CC-BY-NC-ND-3.0|3|cc by|(?:licensed under )?(?:the )?\bcc[- ]by[- ]nc[- ]nd[- ]3\.0\b
CC-BY-NC-ND|2|cc by|\bcc[- ]by[- ]nc[- ]nd\b(?![- ][1-4]\.)
CC-BY-ND-4.0|3|cc by|(?:licensed under )?(?:the )?\bcc[- ]by[- ]nd[- ]4\.0\b
CC-BY-ND-4.0|3|creative commons|creative commons attribution[- ]no ?deriv(?:ative)?s 4\.0(?: international)?(?: licen[sc]e)?
CC-BY-ND-4.0|3|creativecommons|https?://(?:www\.)?creativecommons\.org/licenses/by-nd/4\.0/?
CC-BY-ND-3.0|3|cc by|(?:licensed under )?(?:the )?\bcc[- ]by[- ]nd[- ]3\.0\b
CC-BY-ND|2|cc by|\bcc[- ]by[- ]nd\b(?![- ][1-4]\.)
CC|1|creative commons|\bcreative commons(?: licen[sc]ed?)?\b
CC-PDM-1.0|3|creativecommons|https?://(?:www\.)?creativecommons\.org/publicdomain/mark/1\.0/?
Unlicense|3|spdx license identifier|spdx-license-identifier: unlicense\b
Unlicense|3|unlicense|https?://(?:www\.)?unlicense\.org/?
Unlicense|2|unlicense|\b(?:the )?unlicense\b
Unlicense|2|public domain|this is free and unencumbered software released into the public domain
Public-Domain|2|public domain|\b(?:released|dedicated|placed) (?:in|into|to) the public domain\b
Public-Domain|1|public domain|\b(?:in )?the public domain\b
WTFPL|3|spdx license identifier|spdx-license-identifier: wtfpl\b
WTFPL|2|do what the|\bdo what the fuck you want to public licen[sc]e\b
WTFPL|2|wtfpl|\bwtfpl\b
Zlib|3|spdx license identifier|spdx-license-identifier: zlib\b
Zlib|2|zlib|\bzlib(?:/libpng)? licen[sc]e\b
Zlib|2|as is|this software is provided 'as-is', without any express or implied warranty
Libpng|2|libpng|\blibpng licen[sc]e\b
BSL-1.0|3|boost|(?:the )?boost software license(?:,? (?:version|v\.?) ?1\.0)?\b
BSL-1.0|3|spdx license identifier|spdx-license-identifier: bsl-1\.0\b
BSL-1.0|3|boost|https?://(?:www\.)?boost\.org/license_1_0\.txt
BUSL-1.1|3|business source|(?:the )?business source license(?:,? (?:version|v\.?)? ?1\.1)?\b
BUSL-1.1|3|spdx license identifier|spdx-license-identifier: busl-1\.1\b
SSPL-1.0|3|server side|(?:the )?server side public license(?:,? (?:version|v\.?) ?1(?:\.0)?)?\b
SSPL-1.0|3|spdx license identifier|spdx-license-identifier: sspl-1\.0\b
Elastic-2.0|3|elastic licen|(?:the )?elastic license,? (?:version|v\.?)? ?2(?:\.0)?\b
Elastic-2.0|3|spdx license identifier|spdx-license-identifier: elastic-2\.0\b
Commons-Clause|2|commons clause|\bcommons clause(?: licen[sc]e)?(?: condition)?\b
Artistic-2.0|3|artistic licen|(?:the )?artistic license,? (?:version|v\.?)? ?2(?:\.0)?\b
Artistic-2.0|3|spdx license identifier|spdx-license-identifier: artistic-2\.0\b
Artistic-1.0|3|artistic licen|(?:the )?artistic license,? (?:version|v\.?)? ?1(?:\.0)?\b
Artistic|2|artistic licen|\b(?:the )?artistic licen[sc]e\b
Perl|2|same terms as perl|under the same terms as perl(?: itself)?\b
PSF-2.0|3|python software foundation|(?:the )?python software foundation license(?:,? (?:version|v\.?) ?2(?:\.0)?)?\b
PSF-2.0|2|psf|\bpsf licen[sc]e\b
Ruby|2|ruby licen|\b(?:the )?ruby licen[sc]e\b
PHP-3.01|3|php licen|(?:the )?php license,? (?:version|v\.?)? ?3\.01\b
PHP-3.0|3|php licen|(?:the )?php license,? (?:version|v\.?)? ?3\.0\b(?!1)
PHP|2|php licen|\b(?:the )?php licen[sc]e\b
W3C|2|w3c|\bw3c (?:software )?(?:notice and )?licen[sc]e\b
OpenSSL|2|openssl|\b(?:the )?openssl licen[sc]e\b
OpenSSL|2|openssl|this product includes software developed by the openssl project
SSLeay|2|cryptographic|this product includes cryptographic software written by eric young
OFL-1.1|3|open font|(?:the )?sil open font license,? (?:version|v\.?)? ?1\.1\b
OFL-1.1|3|spdx license identifier|spdx-license-identifier: ofl-1\.1\b
OFL|2|open font|\b(?:the )?(?:sil )?open font licen[sc]e\b
ODbL-1.0|3|open database|(?:the )?open (?:data commons open )?database license(?: \(odbl\))?(?:,? (?:version|v\.?)? ?1\.0)?\b
ODbL-1.0|2|odbl|\bodbl(?:[- ]1\.0)?\b
ODC-By-1.0|3|open data commons|\bopen data commons attribution licen[sc]e(?: v?1\.0)?\b
PDDL-1.0|3|public domain dedication|\b(?:open data commons )?public domain dedication and licen[sc]e\b
CDLA-Permissive-2.0|3|data license|community data license agreement ?[-–]? ?permissive(?:,? (?:version|v\.?) ?2\.0)?\b
CDLA-Sharing-1.0|3|data license|community data license agreement ?[-–]? ?sharing(?:,? (?:version|v\.?) ?1\.0)?\b
EUPL-1.2|3|european union|(?:the )?european union public licen[sc]e,? (?:version|v\.?)? ?1\.2\b
EUPL-1.1|3|european union|(?:the )?european union public licen[sc]e,? (?:version|v\.?)? ?1\.1\b
EUPL|2|european union|\b(?:the )?european union public licen[sc]e\b
EUPL|1|eupl|\beupl(?:[- ]1\.[012])?\b
CeCILL-2.1|3|cecill|\bcecill(?:[- ](?:version|v\.?)? ?2\.1)\b
CeCILL|2|cecill|\bcecill(?:-[bc])?(?: licen[sc]e)?\b
OGL-UK-3.0|3|open government|(?:the )?open government licen[sc]e,? (?:version|v\.?)? ?3\.0\b
OGL-UK|2|open government|\b(?:the )?open government licen[sc]e\b
OSL-3.0|3|open software license|(?:the )?open software license,? (?:version|v\.?)? ?3\.0\b
AFL-3.0|3|academic free|(?:the )?academic free license,? (?:version|v\.?)? ?3\.0\b
AFL|2|academic free|\b(?:the )?academic free licen[sc]e\b
MS-PL|2|microsoft|\b(?:the )?microsoft public licen[sc]e(?: \(ms-pl\))?
MS-RL|2|microsoft|\b(?:the )?microsoft reciprocal licen[sc]e(?: \(ms-rl\))?
MS-PL|3|spdx license identifier|spdx-license-identifier: ms-pl\b
NCSA|2|ncsa|\b(?:the )?university of illinois/ncsa open source licen[sc]e\b
UPL-1.0|3|universal permissive|(?:the )?universal permissive license(?:,? (?:version|v\.?)? ?1\.0)?\b
Vim|2|vim licen|\b(?:the )?vim licen[sc]e\b
Beerware|2|beer|\b(?:the )?beer-?ware licen[sc]e\b
JSON|2|good, not evil|the software shall be used for good, not evil
QPL-1.0|2|q public|\b(?:the )?q public licen[sc]e(?: version 1\.0)?\b
Sleepycat|2|sleepycat|\b(?:the )?sleepycat licen[sc]e\b
ZPL-2.1|2|zope|\b(?:the )?zope public licen[sc]e(?:,? version 2\.1)?\b
Unicode|2|unicode|\bunicode,? inc\. licen[sc]e agreement\b
Blue-Oak-1.0|2|blue oak|\bblue oak model licen[sc]e(?: 1\.0\.0)?\b
OpenRAIL|2|rail|\b(?:creativeml |bigscience |bigcode )?open ?rail(?:[-+]{1,2}m)?(?: licen[sc]e)?\b
Llama-Community|2|llama|\bllama ?(?:2|3|3\.1|3\.2|3\.3)? community licen[sc]e(?: agreement)?\b
Proprietary|2|rights reserved|\ball rights reserved\b
Proprietary|2|proprietary|\bproprietary and confidential\b
Proprietary|1|unauthori|unauthori[sz]ed (?:copying|reproduction)(?: or copying)? of this (?:file|document|work)\b
Dual|1|dual licen|\bdual[- ]licen[sc]ed\b
Unclear|1|spdx license identifier|spdx-license-identifier: [a-z0-9.+-]{2,40}
Unclear|1|licensed under|\blicensed under (?:the )?(?:terms of )?(?:(?!\n\s*\n|licensed under|\.(?:\s|$))[\s\S])+? licen[sc]e\b
Unclear|1|open source|\bopen[- ]source licen[sc]e\b
"""
