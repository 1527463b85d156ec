"""Known license texts and equivalent spellings."""

from __future__ import annotations

# Published license texts, without their copyright lines.
_WARRANTY_MIT = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_GRANT_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_WARRANTY_BSD = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_TERMS_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.\n\n"
)
_NAMES_BSD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission.\n\n"
)
_WARRANTY_ISC = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
    "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_MIT = (
    f"{_GRANT_MIT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or "
    f"substantial portions of the Software.\n\n{_WARRANTY_MIT}"
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    f"copyright notice and this permission notice appear in all copies.\n\n{_WARRANTY_ISC}"
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
    "from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to "
    "alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must "
    "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
    "appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
    "software.\n\n3. This notice may not be removed or altered from any source distribution."
)
TEXTS = {
    "0BSD": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n{_WARRANTY_ISC}",
    "BSD-2-Clause": _TERMS_BSD + _WARRANTY_BSD,
    "BSD-3-Clause": _TERMS_BSD + _NAMES_BSD + _WARRANTY_BSD,
    "ISC": _ISC,
    "ISC (titled)": f"ISC License\n\n{_ISC}",
    "MIT": _MIT,
    "MIT (titled)": f"MIT License\n\n{_MIT}",
    "MIT (The)": f"The MIT License (MIT)\n\n{_MIT}",
    "MIT-0": f"{_GRANT_MIT}.\n\n{_WARRANTY_MIT}",
    "Zlib": _ZLIB,
    "Zlib (titled)": f"zlib License\n\n{_ZLIB}",
}

# Fixed values: (spelling found, spelling kept) of whole words.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("behaviour", "behavior"),
    ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("initialise", "initialize"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"),
    ("non commercial", "noncommercial"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("redistribution s", "redistributions"),
    ("sub license", "sublicense"),
    ("sublicence", "sublicense"),
    ("wilful", "willful"),
)

_CC_TERMS = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
_GNU = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}
_GNU_VERSIONS = {"GPL": ("1", "2", "3"), "LGPL": ("2.1", "3"), "AGPL": ("3",)}
#: (license, its names); every name stands in each of LEADS.
_NAMES = [
    ("MIT", ("MIT License", "MIT", "Expat License")),
    ("ISC", ("ISC License",)),
    ("Zlib", ("zlib License", "zlib/libpng License")),
    ("BSD-2-Clause", ("BSD 2-Clause License", "Simplified BSD License", "2-Clause BSD License", "BSD-2-Clause License")),
    ("BSD-3-Clause", ("BSD 3-Clause License", "New BSD License", "Modified BSD License", "3-Clause BSD License", "BSD-3-Clause License")),
    ("Apache-2.0", ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2.0", "Apache-2.0 License")),
    ("MPL-2.0", ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "Mozilla Public License, v. 2.0")),
    ("EPL-2.0", ("Eclipse Public License 2.0", "Eclipse Public License, Version 2.0", "Eclipse Public License v2.0")),
    ("BSL-1.0", ("Boost Software License, Version 1.0", "Boost Software License 1.0")),
    ("Unlicense", ("Unlicense",)),
    ("CC0-1.0", ("CC0 1.0", "CC0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal", "Creative Commons CC0 1.0 Universal License")),
]
for _short, _full in _GNU.items():
    for _v in _GNU_VERSIONS[_short]:
        for _long in {_v, f"{_v}.0" if "." not in _v else _v}:
            _later = (
                f"{_full}, version {_long} or later", f"{_full}, version {_long} or any later version", f"{_full} v{_long} or later",
                f"{_full}, version {_long}, or (at your option) any later version", f"{_short} v{_long} or later", f"{_short} {_long} or later", f"{_short}v{_long} or later", f"{_short}v{_long}+",
            )
            _only = (
                f"{_full}, version {_long}", f"{_full} v{_long}", f"{_full} version {_long}", f"{_full} {_long}", f"{_short} v{_long}", f"{_short} {_long}",
                f"{_short}v{_long}", f"{_short}-{_long}", f"{_full}, version {_long} only", f"{_full} v{_long} only", f"{_short} version {_long}",
            )
            _id = _v if "." in _v else f"{_v}.0"
            _NAMES += [(f"{_short}-{_id}-or-later", _later[:-1]), (f"{_short}-{_id}", _only)]
for _short, _full in _CC_TERMS.items():
    for _v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
        _NAMES.append(
            (
                f"CC-{_short}-{_v}",
                (
                    f"CC {_short} {_v}", f"CC-{_short} {_v} License", f"CC {_short} {_v} International", f"Creative Commons {_full} {_v}",
                    f"Creative Commons {_full} {_v} License", f"Creative Commons {_full} {_v} International License",
                    f"Creative Commons {_full} {_v} International", f"Creative Commons {_full} {_v} Unported License",
                    f"Creative Commons {_full} {_v} International Public License",
                ),
            )
        )
_LEADS = (
    "Licensed under the", "Licensed under", "Released under the", "Released under", "Distributed under the", "Distributed under",
    "This work is licensed under the", "This work is licensed under a", "This work is licensed under", "This project is licensed under the",
    "This software is licensed under the", "This program is licensed under the", "This software is released under the", "This work is released under the",
    "This file is licensed under the", "This code is licensed under the", "This document is licensed under the", "This article is licensed under the",
    "This content is licensed under", "This content is licensed under a", "License:", "SPDX-License-Identifier:",
)
_APACHE_NOTICE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a '
    "copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed "
    'under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for '
    "the specific language governing permissions and limitations under the License."
)
_MPL_NOTICE = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You "
    "can obtain one at https://mozilla.org/MPL/2.0/."
)
_BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered "
    'by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the '
    "Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the "
    "Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies "
    "of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of "
    "machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR "
    "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT "
    "SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute "
    "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions "
    "that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We "
    "make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt "
    "act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT "
    "WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)


def _gnu_notice(name: str, version: str, later: bool) -> str:
    also = "either " if later else ""
    tail = f"version {version} of the License, or (at your option) any later version." if later else f"version {version} of the License."
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software "
        f"Foundation, {also}{tail}"
    )


#: (license, text) of standard statements, for lines and blocks; TEXTS are for whole documents and their blocks.
STATEMENTS = (
    [(name, f"{lead} {said}") for name, spellings in _NAMES for said in spellings for lead in _LEADS]
    + [(name, f"SPDX-License-Identifier: {name}{end}") for name in sorted({n for n, _ in _NAMES}) for end in ("", "-only")]
    + [
        (f"{s}-{v if '.' in v else v + '.0'}{'-or-later' if later else ''}", _gnu_notice(full, v, later))
        for s, full in _GNU.items() for v in _GNU_VERSIONS[s] for later in (False, True)
    ]
    + [("Apache-2.0", _APACHE_NOTICE), ("Apache-2.0", _APACHE_NOTICE.split("\n\n")[0]), ("MPL-2.0", _MPL_NOTICE), ("BSL-1.0", _BOOST)]
    + [("Apache-2.0", _APACHE_NOTICE.split("\n\n")[2]), ("BSL-1.0", f"Boost Software License - Version 1.0 - August 17th, 2003\n\n{_BOOST}")]
    + [("Unlicense", _UNLICENSE), ("Unlicense", _UNLICENSE.split("\n\n")[0]), ("BSL-1.0", _BOOST.split("\n\n")[0])]
    + [("MIT", f"{_GRANT_MIT}, subject to the following conditions:"), ("MIT-0", f"{_GRANT_MIT}."), ("ISC", _ISC.split("\n\n")[0])]
    + [("0BSD", TEXTS["0BSD"].split("\n\n")[0])]
    + [("BSD-3-Clause", _NAMES_BSD.strip()), ("BSD", _TERMS_BSD.split("\n\n")[0]), ("Zlib", _ZLIB.split("\n\n")[1])]
)

#: Digests of the canonical form of texts too long to stand here.
DIGESTS = {
    "Apache-2.0": "f714f7e6b7c9a096246ef6da791fd51c93e520e9efd6ebda82bea82608c739c3",
    "CC0-1.0": "bd0e52fb1af40ab9797ba72f1d627b83d449e9926f66d21c51209413ac988137",
    "GFDL-1.2": "8aeaf5e8e3488d7c9d65e8416c911f7fe37b3bd88429feabc64ec6283117b8eb",
    "GFDL-1.3": "fb286966d28cff8aa94a7303127495846303801d66ef183d841d5971038d2aa0",
    "GPL-1.0": "3b7c00b08d5c6de2349faf7a31bb6e49ff8a2273a7cfdd16f96859720b00d9ef",
    "GPL-2.0": "9aae015a6322bbdec1a61c624a33b2c7d3b56283db1642e6e18d7820d4957b61",
    "GPL-3.0": "6ff3a9a8b11f055a64cb21003d19dbe88dd6a41f7487672c402dfe38b6fe2582",
    "LGPL-2.0": "2f0a8618627c179dd830ddb8fa74635ae037468a5880f3b46a73915ae1990c24",
    "LGPL-2.1": "56d21d93f6012cbd7f1195b72528da245ccf843598ff833a87101eb36863f95b",
    "LGPL-3.0": "f0cae4b317f4f263dca8e79625f8d9c7618c87e0ca6665c79b0f1c12ac856938",
    "MPL-1.1": "260b601de5d5e5ec00bd903c42a1ac3b0cf3eebd7b1e529b025961a8d981cb56",
    "MPL-2.0": "a90ba5346ad1927fede05edb2d96afdd4948d68d16cef5d29e84239426134356",
}
