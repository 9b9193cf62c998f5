"""Texts, standard headers and short declarations of public licences, by SPDX identifier, as their stewards word them."""

from __future__ import annotations

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions:"""
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT
NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies."""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR
ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
means."""
_MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_MPL_1_HEADER = """The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/ Software distributed under the License is distributed on an
"AS IS" basis, WITHOUT WARRANTY OF ANY KIND, either express or implied. See the License for the specific language governing rights and limitations under the
License."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from
the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the
original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered
source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from
any source distribution."""
_BSD_ADVERTISING = """3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes
software developed by the organization."""
_APACHE_1_NOTICE = """The end-user documentation included with the redistribution, if any, must include the following acknowledgment: "This product includes software
developed by the Apache Software Foundation (http://www.apache.org/)." """
_EPL_HEADER = "This program and the accompanying materials are made available under the terms of the Eclipse Public License"
_CC0 = """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal,
Public Domain Dedication."""


def _gnu_header(name: str, version: str) -> str:
    """The notice that the licence asks to be put at the head of each file."""
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free "
        f"Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope "
        f"that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        f"See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this program."
    )


def _gnu(name: str, version: str, short: str) -> list[str]:
    header = _gnu_header(name, version)
    first = header.split(" This program is distributed")[0]
    return [header, first, f"This work is licensed under the GNU {name}, version {version}.", f"GNU {name.upper()} Version {version}", f"Licensed under the {short}."]


TEXTS = {
    "MIT": [f"MIT License {_MIT_GRANT} {_MIT_NOTICE} {_MIT_WARRANTY}", _MIT_GRANT, _MIT_WARRANTY, "Released under the MIT License.", "This project is licensed under the terms of the MIT license."],
    "Apache-2.0": [_APACHE_HEADER, "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "GPL-3.0": _gnu("General Public License", "3", "GPLv3"),
    "GPL-2.0": _gnu("General Public License", "2", "GPLv2"),
    "LGPL-3.0": _gnu("Lesser General Public License", "3", "LGPLv3"),
    "AGPL-3.0": _gnu("Affero General Public License", "3", "AGPLv3"),
    "BSD-2-Clause": [f"{_BSD_TERMS} {_BSD_WARRANTY}", "Released under the BSD 2-Clause License.", "Use of this source code is governed by a BSD 2-clause license that can be found in the LICENSE file."],
    "BSD-3-Clause": [
        f"{_BSD_TERMS} {_BSD_THIRD} {_BSD_WARRANTY}", _BSD_THIRD, "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "LGPL-2.1": [*_gnu("Lesser General Public License", "2.1", "LGPLv2.1"), _gnu_header("Lesser General Public License", "2.1").replace("This program", "This library").replace("this program", "this library")],
    "BSD-4-Clause": [f"{_BSD_TERMS} {_BSD_ADVERTISING} {_BSD_THIRD.replace('3.', '4.')} {_BSD_WARRANTY}", _BSD_ADVERTISING, "Released under the BSD 4-Clause License."],
    "0BSD": [f"{_ISC_GRANT.split(', provided')[0]}. {_ISC_WARRANTY}", "Released under the 0BSD License.", "Zero-Clause BSD (0BSD)"],
    "Apache-1.1": [_APACHE_1_NOTICE, "Licensed under the Apache Software License, Version 1.1.", "The Apache Software License, Version 1.1"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)", "Distributed under the Boost Software License, Version 1.0.", "Boost Software License - Version 1.0"],
    "EPL-1.0": [f"{_EPL_HEADER} v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html", "Licensed under the Eclipse Public License v1.0.", "Eclipse Public License - v 1.0"],
    "EPL-2.0": [f"{_EPL_HEADER} 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "Licensed under the Eclipse Public License v2.0.", "Eclipse Public License - v 2.0"],
    "MPL-1.1": [_MPL_1_HEADER, "Licensed under the Mozilla Public License, Version 1.1.", "Mozilla Public License Version 1.1"],
    "Zlib": [_ZLIB, _ZLIB.split(" Permission is granted")[0], "Released under the zlib License."],
    "MPL-2.0": [_MPL_HEADER, "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."],
    "CC0-1.0": [_CC0, "Released under CC0 1.0."],
    "ISC": [f"ISC License {_ISC_GRANT} {_ISC_WARRANTY}", _ISC_GRANT, "Released under the ISC License."],
    "Unlicense": [_UNLICENSE, "This is free and unencumbered software released into the public domain."],
}
#: Parts of the Creative Commons licences, as codes and as words.
CC_PARTS = {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
for _code in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
    _words = "-".join(CC_PARTS[x] for x in _code.split("-"))
    for _version, _kind in (("4.0", "International"), ("3.0", "Unported")):
        TEXTS[f"CC-{_code}-{_version}"] = [f"Licensed under CC {_code} {_version}.", f"Licensed under Creative Commons {_words} CC {_code} {_version}.", f"This work is licensed under a Creative Commons {_words} {_version} {_kind} License."]

#: Words beside those of its identifier that tell a licence from its relatives.
TELLING = {
    "GPL-3.0": ("3", "gplv3"), "GPL-2.0": ("2", "gplv2"), "LGPL-3.0": ("lesser", "3", "lgplv3"), "LGPL-2.1": ("lesser", "2.1", "lgplv2.1"), "AGPL-3.0": ("affero", "3", "agplv3"),
    "MIT": ("sublicense", "noninfringement"), "ISC": ("fee", "tortious"), "0BSD": ("fee", "tortious"), "BSD-2-Clause": ("redistributions",), "BSD-3-Clause": ("redistributions", "endorse"),
    "Apache-2.0": ("apache", "2.0"), "EPL-1.0": ("eclipse", "v1.0"), "EPL-2.0": ("eclipse", "v2.0"), "BSL-1.0": ("boost",), "MPL-1.1": ("mozilla", "1.1"), "MPL-2.0": ("mozilla", "2.0"), "BSD-4-Clause": ("advertising",), "Apache-1.1": ("acknowledgment",),
}
#: Words by which a passage is about a relative.
FOREIGN = {"GPL-3.0": ("lesser", "affero"), "GPL-2.0": ("lesser", "affero")}
#: A wording of so many terms is told by its identifier's words as well: longer ones are texts, which may leave out or renumber some.
SHORT = 60
#: Identifiers that tags may follow by "-only", "-or-later" or "+".
GNU = ("GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "AGPL-3.0")


def statements() -> list[tuple[str, str]]:
    """(identifier, wording) of all of them."""
    return [(x, text) for x, texts in TEXTS.items() for text in texts]
