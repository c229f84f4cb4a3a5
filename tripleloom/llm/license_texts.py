"""Templates of well-known public licenses: full texts of short ones, the standard notices of long ones, and one-line statements.

``MUST`` has the phrases that tell a template from its neighbours.
"""

TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions""",
    "Apache-2.0 statement": "Licensed under the Apache License, Version 2.0.",
    "MIT statement": "Released under the MIT License.",
    "GPL-3.0 statement": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 statement": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 statement": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0 statement": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}

NOTICE = """This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.
This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details.
You should have received a copy of the GNU {kind} along with this {thing}. If not, see <https://www.gnu.org/licenses/>."""
GNU = {"GPL": "General Public License", "LGPL": "Lesser General Public License", "AGPL": "Affero General Public License"}
CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}

#: Phrases (of words as in ``common.words``) that a text must hold to be the template.
MUST: dict[str, tuple[str, ...]] = {
    "MIT": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "ISC": ("provided that the above copyright notice and this permission notice appear in all copies",),
    "BSD-3-Clause": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",),
    "Apache-2.0": ("apache license", "2 0"),
    "MPL-2.0": ("mozilla public license", "2 0"),
    "Apache-2.0 statement": ("apache license", "2 0"),
    "MIT statement": ("mit license",),
}

# The neighbours that lack a clause of the MIT and ISC texts.
for _name, _of in (("MIT-0", "MIT"), ("0BSD", "ISC")):
    TEMPLATES[_name] = TEMPLATES[_of].replace("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "").replace(", provided that the above copyright notice and this permission notice appear in all copies", "")

for _short, _version in (("GPL", "2.0"), ("GPL", "3.0"), ("LGPL", "2.1"), ("LGPL", "3.0"), ("AGPL", "3.0")):
    _name, _kind, _number = f"{_short}-{_version}", GNU[_short], _version.removesuffix(".0")
    TEMPLATES.setdefault(_name, NOTICE.format(thing="library" if _short == "LGPL" else "program", kind=_kind, version=_number))
    TEMPLATES.setdefault(f"{_name} statement", f"This work is licensed under the GNU {_kind}, version {_number}.")
    TEMPLATES[f"{_name} short statement"] = f"Released under the GNU {_kind}, version {_number}."
    MUST[_name] = MUST[f"{_name} statement"] = MUST[f"{_name} short statement"] = (f"version {_number.replace('.', ' ')}", f"gnu {_kind.lower()}")
for _short, _kind in GNU.items():
    TEMPLATES[f"{_short} statement"] = f"Released under the GNU {_kind}."
    MUST[f"{_short} statement"] = (f"gnu {_kind.lower()}",)

for _short, _kind in CC.items():
    for _version, _port in (("4.0", "International"), ("3.0", "Unported")):
        # A name of the older library keeps its form; the other form has a name of its own.
        _old, _digits = f"CC-{_short}-{_version} statement", _version.replace(".", " ")
        _line, _long = f"Licensed under CC {_short} {_version}.", f"This work is licensed under a Creative Commons {_kind} {_version} {_port} License."
        for _text, _form, _phrase in ((_line, "short", f"cc {_short} {_digits}"), (_long, "long", f"creative commons {_kind} {_digits}")):
            _name = _old if TEMPLATES.get(_old, _text) == _text else f"CC-{_short}-{_version} {_form} statement"
            TEMPLATES[_name] = _text
            MUST[_name] = (_phrase.lower().replace("-", " "),)

for _name, _text, _phrases in (
    ("Apache statement", "Released under the Apache License.", ("apache license",)),
    ("BSD statement", "Released under the BSD License.", ("bsd",)),
    ("BSD-2-Clause statement", "Released under the BSD 2-Clause License.", ("bsd 2 clause",)),
    ("BSD-3-Clause statement", "Released under the BSD 3-Clause License.", ("bsd 3 clause",)),
    ("ISC statement", "Released under the ISC License.", ("isc license",)),
    ("Zlib statement", "Released under the zlib License.", ("zlib license",)),
    ("MPL-2.0 statement", "Licensed under the Mozilla Public License, Version 2.0.", ("mozilla public license", "2 0")),
    ("MPL statement", "Released under the Mozilla Public License.", ("mozilla public license",)),
    ("CC0-1.0 statement", "Released under CC0 1.0.", ("cc0 1 0",)),
    ("CC0-1.0 long statement", "This work is released under the Creative Commons CC0 1.0 Universal Public Domain Dedication.", ("cc0 1 0",)),
):
    TEMPLATES[_name] = _text
    MUST[_name] = _phrases
