"""Known license texts and notices (public, as published)."""

from pathlib import Path

_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so"
)
_MIT = (
    f"{_MIT_GRANT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be "
    f"included in all copies or substantial portions of the Software.\n\n{_AS_IS}"
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution.\n\n"
)
_BSD_TAIL = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission.\n\n"
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_TAIL = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
    "for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any "
    "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
    "restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
    "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but "
    "is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
    "original software.\n3. This notice may not be removed or altered from any source distribution."
)
_WTFPL = (
    "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n\n"
    "0. You just DO WHAT THE FUCK YOU WANT TO."
)
_APACHE_NOTICE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
    "License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by "
    "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
    "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
    "governing permissions and limitations under the License."
)

KNOWN = [
    ("0BSD", f"{_ISC_GRANT}.\n\n{_ISC_TAIL}"),
    ("0BSD", f"BSD Zero Clause License\n\n{_ISC_GRANT}.\n\n{_ISC_TAIL}"),
    ("Apache-2.0", _APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-2-Clause", f"BSD 2-Clause License\n\n{_BSD_HEAD}{_BSD_TAIL}"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_NAMES + _BSD_TAIL),
    ("BSD-3-Clause", f"BSD 3-Clause License\n\n{_BSD_HEAD}{_BSD_NAMES}{_BSD_TAIL}"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_TAIL}"),
    ("ISC", f"ISC License\n\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_TAIL}"),
    ("MIT", _MIT),
    ("MIT", f"MIT License\n\n{_MIT}"),
    ("MIT", f"The MIT License (MIT)\n\n{_MIT}"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT-0", f"MIT No Attribution\n\n{_MIT_GRANT}.\n\n{_AS_IS}"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("WTFPL", _WTFPL),
    ("Zlib", _ZLIB),
    ("Zlib", f"zlib License\n\n{_ZLIB}"),
]

# Whole texts as published, in the files of ``published_licenses`` (from
# Debian's common-licenses). A text that serves both "only" and "or later"
# goes by "only".
_PUBLISHED = {
    "Apache-2.0": "Apache-2.0",
    "Artistic": "Artistic-1.0-Perl",
    "BSD": "BSD-3-Clause",
    "CC0-1.0": "CC0-1.0",
    "GFDL-1.2": "GFDL-1.2-only",
    "GFDL-1.3": "GFDL-1.3-only",
    "GPL-1": "GPL-1.0-only",
    "GPL-2": "GPL-2.0-only",
    "GPL-3": "GPL-3.0-only",
    "LGPL-2": "LGPL-2.0-only",
    "LGPL-2.1": "LGPL-2.1-only",
    "LGPL-3": "LGPL-3.0-only",
    "MPL-1.1": "MPL-1.1",
    "MPL-2.0": "MPL-2.0",
}
PUBLISHED = {f: (Path(__file__).parent / "published_licenses" / f"{f}.txt").read_text("utf-8") for f in _PUBLISHED}
_END = "END OF TERMS AND CONDITIONS"
_APACHE_OWNER = "Copyright [yyyy] [name of copyright owner]"  # a copyright line once it is filled in


def _writings(text: str) -> list[str]:
    """The text, without its owner line, without the appendix on how to apply
    it, with and without the words that end the terms, and older links."""
    terms = text.split(_END)[0]
    found = [text, text.replace(_APACHE_OWNER, ""), terms, terms + _END]
    return list(dict.fromkeys(x for t in found for x in (t, t.replace("https://", "http://"))))


def _notice(file: str, first: str, last: str) -> list[str]:
    """A notice that a published text gives for use in files."""
    text = PUBLISHED[file]
    at = text.rindex(first)
    notice = text[at : text.index(last, at) + len(last)]
    return list(dict.fromkeys([notice, notice.replace("https://", "http://")]))


KNOWN += [(i, t) for f, i in _PUBLISHED.items() for t in _writings(PUBLISHED[f])]
KNOWN += [("GPL-2.0-or-later", t) for t in _notice("GPL-2", "This program is free software", "USA.")]
KNOWN += [("GPL-3.0-or-later", t) for t in _notice("GPL-3", "This program is free software", "licenses/>.")]
KNOWN += [("MPL-2.0", t) for t in _notice("MPL-2.0", "This Source Code Form is subject to", "MPL/2.0/.")]

# Identifiers that are also found in a line of their own.
_TAGS = (
    "0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Artistic-1.0-Perl Artistic-2.0 BSL-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 "
    "CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CDDL-1.0 EPL-1.0 EPL-2.0 EUPL-1.2 GFDL-1.2-only "
    "GFDL-1.2-or-later GFDL-1.3-only GFDL-1.3-or-later GPL-1.0-only GPL-1.0-or-later GPL-2.0-or-later GPL-3.0-or-later ISC "
    "LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT-0 MPL-1.1 OFL-1.1 "
    "Unlicense WTFPL Zlib"
)
KNOWN += [(i, f"SPDX-License-Identifier: {i}") for i in _TAGS.split()]
