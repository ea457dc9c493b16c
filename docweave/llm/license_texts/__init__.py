"""Templates of common licences beside those in ``licenses.TEMPLATES``: notices, headers and whole texts.

Names are SPDX names with ``-notice``, ``-header`` or ``-terms`` (a text without preamble), or a
family's name alone where the wording gives no version.  Every wording has a sibling for each listed
version and one without, so that a notice of another version is nearer to its own.  The files beside
this one are the licences' texts, word for word.
"""

from __future__ import annotations

import pkgutil
import re
from functools import cache

WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")  # words of normalised texts and templates
LEADS = ["Licensed under", "Released under", "Distributed under", "Published under", "Available under"]
FILES = [
    "Apache-2.0", "Artistic-1.0-Perl", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0",
    "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0",
]

#: Family, words of its name, versions.
VERSIONED = [
    ("Apache", ["Apache License"], ["1.0", "1.1", "2.0"]),
    ("GPL", ["GNU General Public License", "GNU GPL"], ["1", "2", "3", "1.0", "2.0", "3.0"]),
    ("LGPL", ["GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL"], ["2", "2.1", "3", "2.0", "3.0"]),
    ("AGPL", ["GNU Affero General Public License", "GNU AGPL"], ["1", "3", "1.0", "3.0"]),
    ("GFDL", ["GNU Free Documentation License"], ["1.1", "1.2", "1.3"]),
    ("MPL", ["Mozilla Public License"], ["1.0", "1.1", "2.0"]),
    ("EPL", ["Eclipse Public License"], ["1.0", "2.0"]),
    ("EUPL", ["European Union Public Licence"], ["1.1", "1.2"]),
    ("BSL", ["Boost Software License"], ["1.0"]),
    ("Artistic", ["Artistic License"], ["1.0", "2.0"]),
]
PLAIN = {
    "MIT": ["the MIT License"],
    "ISC": ["the ISC License"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the 2-Clause BSD License", "the Simplified BSD License"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the 3-Clause BSD License", "the New BSD License"],
    "BSD-4-Clause": ["the BSD 4-Clause License", "the 4-Clause BSD License"],
    "0BSD": ["the BSD Zero Clause License"],
    "BSD": ["the BSD License"],
    "Unlicense": ["the Unlicense"],
    "Zlib": ["the zlib License"],
    "WTFPL": ["the WTFPL"],
    "CC0-1.0": ["CC0 1.0", "the CC0 1.0 Universal Public Domain Dedication"],
    "CC0": ["CC0"],
}
CREATIVE = {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC": "Attribution-NonCommercial",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
SPDX = [
    "MIT", "MIT-0", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "Apache-1.1", "Apache-2.0", "GPL-1.0-only",
    "GPL-1.0-or-later", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.0-only", "LGPL-2.0-or-later",
    "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "GPL-2.0",
    "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-1.1", "MPL-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "CC0-1.0", "Unlicense",
    "Zlib", "BSL-1.0", "WTFPL", "Artistic-2.0", "GFDL-1.3-only", "GFDL-1.3-or-later",
    *(f"CC-{kind}-{v}" for kind in CREATIVE for v in ("3.0", "4.0")),
]

REDISTRIBUTION = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and
the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution."""
ADVERTISING = """3. All advertising materials mentioning features or use of this software must display the following acknowledgement:
This product includes software developed by the copyright holder."""
ENDORSEMENT = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEXTS = {
    "BSD-2-Clause": f"{REDISTRIBUTION} {DISCLAIMER}",
    "BSD-3-Clause": f"{REDISTRIBUTION} 3. {ENDORSEMENT} {DISCLAIMER}",
    "BSD-4-Clause": f"{REDISTRIBUTION} {ADVERTISING} 4. {ENDORSEMENT} {DISCLAIMER}",
    "MIT-0": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING
FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate
any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large
and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of
all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to http://unlicense.org""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin
of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a
product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must
be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or
altered from any source distribution.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit
the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do
so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license
grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all
derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code
generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO
EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MPL-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}
GNU_HEADER = """This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as
published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version. This {what} is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with
this {what}."""
GNU = {
    "GPL-1.0": ("General Public License", "1"), "GPL-2.0": ("General Public License", "2"), "LGPL-2.0": ("Library General Public License", "2"),
    "LGPL-2.1": ("Lesser General Public License", "2.1"), "LGPL-3.0": ("Lesser General Public License", "3"),
    "AGPL-3.0": ("Affero General Public License", "3"),
}
AFFERO_13 = """13. Remote Network Interaction; Use with the GNU General Public License. Notwithstanding any other provision of this
License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a
computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by
providing access to the Corresponding Source from a network server at no charge, through some standard or customary means of
facilitating copying of software. This Corresponding Source shall include the Corresponding Source for any work covered by version 3
of the GNU General Public License that is incorporated pursuant to the following paragraph. Notwithstanding any other provision of
this License, you have permission to link or combine any covered work with a work licensed under version 3 of the GNU General Public
License into a single combined work, and to convey the resulting work. The terms of this License will continue to apply to the part
which is the covered work, but the work with which it is combined will remain governed by version 3 of the GNU General Public
License.
"""


def _version(v: str) -> str:
    return v if "." in v else f"{v}.0"


def notices() -> dict[str, list[str]]:
    """Lists of wordings for each name."""
    found: dict[str, list[str]] = {}

    def add(name: str, wording: str) -> None:
        found.setdefault(f"{name}-notice", []).extend(f"{lead} {wording}." for lead in LEADS)

    for family, names, versions in VERSIONED:
        for name in names:
            for v in versions:
                for wording in (f"the {name}, version {v}", f"the {name} v{v}", f"the {name} {v}", f"version {v} of the {name}"):
                    add(f"{family}-{_version(v)}", wording)
                if name.endswith(("License", "Licence")):
                    short = name.removeprefix("GNU ").rsplit(" ", 1)
                    if family in ("Apache", "Artistic"):
                        add(f"{family}-{_version(v)}", f"the {short[0]} {v} {short[1]}")
            add(family, f"the {name}")
    for name, wordings in PLAIN.items():
        for wording in wordings:
            add(name, wording)
    for kind, name in CREATIVE.items():
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            add(f"CC-{kind}-{v}", f"CC {kind} {v}")
            after = {"3.0": "Unported ", "4.0": "International "}.get(v, "")
            add(f"CC-{kind}-{v}", f"a Creative Commons {name} {v} {after}License")
            add(f"CC-{kind}-{v}", f"the Creative Commons {name} {v} {after}License")
        add(f"CC-{kind}", f"CC {kind}")
        add(f"CC-{kind}", f"a Creative Commons {name} License")
        add(f"CC-{kind}", f"the Creative Commons {name} License")
    for name in SPDX:
        found.setdefault(f"{name}-notice", []).append(f"SPDX-License-Identifier: {name}")
    return found


def files() -> dict[str, str]:
    texts = {name: pkgutil.get_data(__name__, f"{name}.txt").decode() for name in FILES}
    whole = texts["GPL-3.0"]
    start, end = whole.index("TERMS AND CONDITIONS"), whole.index("END OF TERMS AND CONDITIONS")
    terms, a, b = whole[start:end], "  13. Use with the GNU Affero", "  14. Revised Versions"
    before, after = terms[: terms.index(a)], terms[terms.index(b) :]
    affero = (before + AFFERO_13 + after).replace('refers to version 3 of the GNU General', 'refers to version 3 of the GNU Affero General')
    at = affero.index(b)
    return texts | {"GPL-3.0-terms": terms, "AGPL-3.0-terms": affero[:at] + " ".join(affero[at:].split()).replace("GNU General Public License", "GNU Affero General Public License")}


@cache
def common() -> list[tuple[str, str]]:
    """Name and text of each template, longer ones first: of equal findings at one place the longer stays."""
    headers = [(f"{k}-header", GNU_HEADER.format(what="library" if k[0] == "L" else "program", name=name, v=v)) for k, (name, v) in GNU.items()]
    made = [*files().items(), *TEXTS.items(), *headers, *((name, w) for name, ws in notices().items() for w in ws)]
    return sorted(made, key=lambda x: -len(WORD.findall(x[1])))
