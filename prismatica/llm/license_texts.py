"""Templates of licence headers and of whole licence files (read on the driver from ``licenses``)."""

from __future__ import annotations

from pathlib import Path

#: Whole licence texts, by licence. The text of CC-BY-NC-4.0 isn't among them; its notices are.
FULL = {p.stem: p.read_text("utf-8") for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}


def _gnu(name: str, version: str) -> list[str]:
    """The header that the GNU licences ask for, for any later version and for one version only, and short notices."""
    subject, rest = ("This library", "library") if name == "Lesser" else ("This program", "program")
    full = f"GNU {name} General Public License" if name else "GNU General Public License"
    tail = f"""This {rest} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {full} for more details. You should have received a copy of the {full} along with this {rest}."""
    where = {"2.0": "if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "2.1": "if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"}
    end = f"{tail} {where.get(version, 'If not, see <https://www.gnu.org/licenses/>.')}"
    number = version.removesuffix(".0")
    begin = f"{subject} is free software: you can redistribute it and/or modify it under the terms of the {full} as published by the Free Software Foundation"
    return [
        f"{begin}, either version {number} of the License, or (at your option) any later version. {end}",
        f"{begin}, version {number} of the License. {end}",
        f"This work is licensed under the {full}, version {number}.",
        f"Licensed under the {full} v{version}.",
    ]


#: Headers of source files, and notices of a line or a few, by licence.
HEADERS = {
    "AGPL-3.0": _gnu("Affero", "3.0"),
    "Apache-2.0": [
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        """Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work
        for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0 (the "License");
        you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0. See LICENSE in the project root for license information.",
    ],
    "BSD-2-Clause": [FULL["BSD-2-Clause"]],
    "BSD-3-Clause": [FULL["BSD-3-Clause"], "Use of this source code is governed by a BSD-style license.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under the Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.",
        """This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.
        To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.""",
    ],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0": _gnu("", "2.0"),
    "GPL-3.0": _gnu("", "3.0"),
    "ISC": [FULL["ISC"], "Released under the ISC License.", "Licensed under the ISC License."],
    "LGPL-2.1": _gnu("Lesser", "2.1"),
    "LGPL-3.0": _gnu("Lesser", "3.0"),
    "MIT": [
        FULL["MIT"],
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Licensed under the MIT License. See LICENSE in the project root for license information.",
        "This source code is licensed under the MIT license found in the LICENSE file in the root directory of this source tree.",
    ],
    "NCSA": [FULL["NCSA"]],
    "OFL-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1."],
    "Unicode-3.0": [FULL["Unicode-3.0"]],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
        You can obtain one at http://mozilla.org/MPL/2.0/.""",
    ],
}

#: SPDX identifiers in lower case; the forms of the GNU licences name the same texts.
SPDX = {name.lower() + end: name for name in HEADERS for end in (("", "-only", "-or-later", "+") if "GPL" in name else ("",))}
