"""Licence templates: whole texts, notices, short forms and SPDX tags of public licences.

The long texts (``licenses/*.txt``) are the distributed ones.  ``X-text`` is a
whole text, ``X-line`` a short form, ``X-spdx`` the tag; other names are notices,
or whole texts of the licences that have no notice (MIT, BSD, ISC, Unlicense ...).
"""

from __future__ import annotations

import pkgutil

LONG = ("Apache-2.0", "Artistic-1.0", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1",
        "LGPL-3.0", "MPL-1.1", "MPL-2.0")
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met:"""
_BSD_TWO = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
    disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
    following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THREE = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
    products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
    INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
    IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
    CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
    PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
    TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
    POSSIBILITY OF SUCH DAMAGE."""
_GNU = """This {thing} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} as published
    by the Free Software Foundation{stop} either version {version} of the License, or (at your option) any later version. This
    {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."""
_GPL, _LGPL, _AGPL = "General Public License", "Lesser General Public License", "Affero General Public License"
NOTICES = {
    "GPL-2.0-notice": _GNU.format(thing="program", mark=";", name=_GPL, stop=";", version="2"),
    "GPL-3.0-notice": _GNU.format(thing="program", mark=":", name=_GPL, stop=",", version="3"),
    "LGPL-2.1-notice": _GNU.format(thing="library", mark=";", name=_LGPL, stop=";", version="2.1"),
    "LGPL-3.0": _GNU.format(thing="program", mark=":", name=_LGPL, stop=",", version="3"),
    "AGPL-3.0": _GNU.format(thing="program", mark=":", name=_AGPL, stop=",", version="3"),
    "EPL-1.0": """This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0
        which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html""",
    "EPL-2.0": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0
        which is available at https://www.eclipse.org/legal/epl-2.0/""",
    "BSD-2-Clause": f"{_BSD_HEAD} {_BSD_TWO} {_BSD_END}",
    "BSD-3-Clause": f"{_BSD_HEAD} {_BSD_TWO} {_BSD_THREE} {_BSD_END}",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of
        this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for
        the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an
        overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE
        SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
        OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY
        CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to
        https://unlicense.org""",
    "CC0-1.0": """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this
        work.""",
}
MIT_END = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
    WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
    HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
    OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
    IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
    CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
    NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_NAMES = {
    "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "ISC": "ISC License",
    "GPL-2.0": "GNU General Public License, version 2", "LGPL-2.1": "GNU Lesser General Public License, version 2.1",
    "LGPL-3.0": "GNU Lesser General Public License, version 3", "AGPL-3.0": "GNU Affero General Public License, version 3",
    "MPL-2.0": "Mozilla Public License, version 2.0", "EPL-1.0": "Eclipse Public License, version 1.0",
    "EPL-2.0": "Eclipse Public License, version 2.0", "Unlicense": "Unlicense", "CC0-1.0": "CC0 1.0 Universal License",
}
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives",
       "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
       "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_TAGS = ("Apache-2.0", "MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Unlicense", "CC0-1.0", "MPL-2.0", "EPL-1.0", "EPL-2.0",
         *(f"{x}{y}" for x in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for y in ("", "-only", "-or-later")),
         *(f"CC-{x}-{v}" for x in _CC for v in ("4.0", "3.0")))


def long_texts() -> dict[str, str]:
    return {f"{x}-text": (pkgutil.get_data("deliverylens.llm", f"licenses/{x}.txt") or b"").decode() for x in LONG}


def all_texts() -> dict[str, str]:
    out = {**long_texts(), **NOTICES}
    out |= {f"{x}-line": f"Licensed under the {name}." for x, name in _NAMES.items()}
    for x, name in _CC.items():
        for v, kind in (("4.0", "International"), ("3.0", "Unported")):
            out[f"CC-{x}-{v}"] = f"This work is licensed under a Creative Commons {name} {v} {kind} License."
            out[f"CC-{x}-{v}-line"] = f"Licensed under CC {x} {v}."
    return out | {f"{x}-spdx": f"SPDX-License-Identifier: {x}" for x in _TAGS}
