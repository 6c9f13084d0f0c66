"""Templates of public licences: names, the words a unit must hold, and wordings.

Fixed values: the names, headers and texts below are those of the public licences.  Short notices
are built from each licence's names by a few common phrases.
"""

from __future__ import annotations

#: Licence, words that tell it (and its version) from its relatives, and its names in prose.
NAMES = [
    ("MIT", ["mit", "license"], ["the MIT License"]),
    ("ISC", ["isc", "license"], ["the ISC License"]),
    ("BSD-2-Clause", ["bsd", "2"], ["the BSD 2-Clause License"]),
    ("BSD-3-Clause", ["bsd", "3"], ["the BSD 3-Clause License"]),
    ("Apache-2.0", ["apache", "2"], ["the Apache License, Version 2.0"]),
    ("GPL-2.0", ["general", "2"], ["the GNU General Public License, version 2"]),
    ("GPL-3.0", ["general", "3"], ["the GNU General Public License, version 3"]),
    ("LGPL-2.1", ["lesser", "2", "1"], ["the GNU Lesser General Public License, version 2.1"]),
    ("LGPL-3.0", ["lesser", "3"], ["the GNU Lesser General Public License, version 3"]),
    ("AGPL-3.0", ["affero", "3"], ["the GNU Affero General Public License, version 3"]),
    ("MPL-2.0", ["mozilla", "2"], ["the Mozilla Public License, version 2.0"]),
    ("CC-BY-4.0", ["by", "4"], ["CC BY 4.0", "the Creative Commons Attribution 4.0 International License"]),
    ("CC-BY-NC-4.0", ["nc", "4"], ["CC BY-NC 4.0"]),
    ("CC-BY-NC-4.0", ["noncommercial", "4"], ["the Creative Commons Attribution-NonCommercial 4.0 International License"]),
    ("CC-BY-SA-4.0", ["sa", "4"], ["CC BY-SA 4.0"]),
    ("CC-BY-SA-4.0", ["sharealike", "4"], ["the Creative Commons Attribution-ShareAlike 4.0 International License"]),
]
PHRASES = ["Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "This program is free software, licensed under the terms of {}.", "This source code is subject to the terms of {}."]

#: SPDX identifiers, and the words of each that a unit must hold.
SPDX = [
    ("MIT", "MIT", ["mit"]),
    ("ISC", "ISC", ["isc"]),
    ("BSD-2-Clause", "BSD-2-Clause", ["bsd", "2"]),
    ("BSD-3-Clause", "BSD-3-Clause", ["bsd", "3"]),
    ("Apache-2.0", "Apache-2.0", ["apache", "2"]),
    ("GPL-2.0", "GPL-2.0-only", ["gpl", "2"]),
    ("GPL-2.0", "GPL-2.0-or-later", ["gpl", "2"]),
    ("GPL-3.0", "GPL-3.0-only", ["gpl", "3"]),
    ("GPL-3.0", "GPL-3.0-or-later", ["gpl", "3"]),
    ("LGPL-2.1", "LGPL-2.1-or-later", ["lgpl", "2", "1"]),
    ("LGPL-3.0", "LGPL-3.0-or-later", ["lgpl", "3"]),
    ("AGPL-3.0", "AGPL-3.0-or-later", ["agpl", "3"]),
    ("MPL-2.0", "MPL-2.0", ["mpl", "2"]),
    ("CC-BY-4.0", "CC-BY-4.0", ["by", "4"]),
    ("CC-BY-NC-4.0", "CC-BY-NC-4.0", ["nc", "4"]),
    ("CC-BY-SA-4.0", "CC-BY-SA-4.0", ["sa", "4"]),
]

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:"""
_MIT_REST = """The above copyright notice and this permission notice shall be included in all copies or substantial portions
of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_REST = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:"""
_BSD_TWO = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""
_BSD_REST = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""
_APACHE_REST = """Unless required by applicable law or agreed to in writing, software distributed under the License is
distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
the specific language governing permissions and limitations under the License."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_GNU = """This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public
License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later
version."""
_GNU_REST = """This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} Public License for more details.

You should have received a copy of the GNU {kind} Public License along with this {what}. If not, see
<https://www.gnu.org/licenses/>."""
#: Licence, kind in its name, what it covers, version, date of its title, words that must occur.
_GNU_KINDS = [
    ("GPL-2.0", "General", "program", "2", "Version 2, June 1991", ["2"]),
    ("GPL-3.0", "General", "program", "3", "Version 3, 29 June 2007", ["3"]),
    ("LGPL-2.1", "Lesser General", "library", "2.1", "Version 2.1, February 1999", ["lesser", "2", "1"]),
    ("LGPL-3.0", "Lesser General", "library", "3", "Version 3, 29 June 2007", ["lesser", "3"]),
    ("AGPL-3.0", "Affero General", "program", "3", "Version 3, 19 November 2007", ["affero", "3"]),
]


def templates() -> list[tuple[str, list[str], str]]:
    """(licence, words that must occur, wording), the order breaks ties."""
    out = [(name, must, phrase.format(long)) for name, must, longs in NAMES for long in longs for phrase in PHRASES]
    out += [(name, ["spdx", *must], f"SPDX-License-Identifier: {spdx}") for name, spdx, must in SPDX]
    for first, whole, name in [
        (_MIT, f"MIT License\n\n{_MIT}\n\n{_MIT_REST}", "MIT"),
        (_ISC, f"ISC License\n\n{_ISC}\n\n{_ISC_REST}", "ISC"),
    ]:
        out += [(name, [], first), (name, [], whole)]
    out += [
        ("BSD-2-Clause", ["redistributions"], f"{_BSD}\n\n{_BSD_TWO}\n\n{_BSD_REST}"),
        ("BSD-2-Clause", ["redistributions"], f"{_BSD}\n\n{_BSD_TWO}"),
        ("BSD-3-Clause", ["redistributions", "neither", "endorse"], f"{_BSD}\n\n{_BSD_TWO}\n\n{_BSD_THIRD}\n\n{_BSD_REST}"),
        ("BSD-3-Clause", ["redistributions", "neither", "endorse"], f"{_BSD}\n\n{_BSD_TWO}\n\n{_BSD_THIRD}"),
        ("BSD-3-Clause", ["bsd"], "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD license."),
        ("Apache-2.0", ["apache", "2"], _APACHE),
        ("Apache-2.0", ["apache", "2"], f"{_APACHE}\n\n{_APACHE_REST}"),
        ("Apache-2.0", ["apache", "2"], "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
        ("MPL-2.0", ["mozilla", "2"], _MPL),
        ("MPL-2.0", ["mozilla", "2"], "Mozilla Public License Version 2.0"),
        ("Proprietary", ["rights", "reserved"], "All rights reserved."),
    ]
    for name, kind, what, version, date, must in _GNU_KINDS:
        head, rest = (t.format(what=what, kind=kind, version=version) for t in (_GNU, _GNU_REST))
        out += [(name, must, head), (name, must, f"{head}\n\n{rest}"), (name, must, f"GNU {kind} Public License {date}")]
        out.append((name, must, f"GNU {kind} Public License {date} Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."))
    return out
