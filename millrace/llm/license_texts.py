"""Texts by which licenses are known: headers, notices and naming sentences, with the phrases that set them apart."""

from __future__ import annotations

from typing import NamedTuple


class Template(NamedTuple):
    """A text of a license; a block must also hold all phrases of ``must``, and none of ``unless`` in or around it."""

    label: str
    text: str
    must: tuple[str, ...] = ()
    unless: tuple[str, ...] = ()


# Phrases that count as a license by themselves, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_ENDORSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_NOTICE = "is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version"


def _gnu() -> list[Template]:
    """The GNU family: its naming sentences and notices differ only in name and version."""
    out = []
    for label, name, short, version in (
        ("agpl-3", "GNU Affero General Public License", "AGPL", "3"),
        ("gpl-2", "GNU General Public License", "GPL", "2"),
        ("gpl-3", "GNU General Public License", "GPL", "3"),
        ("lgpl-2.1", "GNU Lesser General Public License", "LGPL", "2.1"),
        ("lgpl-3", "GNU Lesser General Public License", "LGPL", "3"),
    ):
        low, v = name.lower(), version.replace(".", " ")
        out += [
            Template(label, f"licensed under the {name}, version {version}", (f"{low} version {v}",)),
            Template(label, f"under the terms of the {name} version {version}", (f"{low} version {v}",)),
            Template(label, "This program " + _NOTICE.format(name, version), (low, f"version {v} of the license")),
            Template(label, f"licensed under the GNU {short} version {version}", (f"gnu {short.lower()} version {v}",)),
            Template(label, f"licensed under the {short}v{version}", (f"{short.lower()}v{v}",)),
            Template(label, f"SPDX-License-Identifier: {short}-{version}.0" if "." not in version else f"SPDX-License-Identifier: {short}-{version}", (f"license identifier {short.lower()} {v}",)),
        ]
    return out


def _creative_commons() -> list[Template]:
    """The Creative Commons family: kinds of Attribution, written in full and in short."""
    out = []
    for label, name, short in (
        ("cc-by", "Attribution", "BY"),
        ("cc-by-nc", "Attribution NonCommercial", "BY-NC"),
        ("cc-by-nc-nd", "Attribution NonCommercial NoDerivatives", "BY-NC-ND"),
        ("cc-by-nc-sa", "Attribution NonCommercial ShareAlike", "BY-NC-SA"),
        ("cc-by-nd", "Attribution NoDerivatives", "BY-ND"),
        ("cc-by-sa", "Attribution ShareAlike", "BY-SA"),
    ):
        for version in ("3.0", "4.0"):
            v = version.replace(".", " ")
            code = short.lower().replace("-", " ")
            for form in {name, name.replace("NonCommercial", "Non Commercial").replace("ShareAlike", "Share Alike").replace("NoDerivatives", "No Derivatives")}:
                out.append(Template(label, f"licensed under a Creative Commons {form} {version} International License", (f"{form.lower()} {v}",)))
            out.append(Template(label, f"Licensed under CC {short} {version}", (f"cc {code} {v}",)))
    return sorted(out)


# Texts of common licenses.
TEMPLATES: list[Template] = [
    Template("apache-2", "Licensed under the Apache License, Version 2.0", ("apache license", "version 2 0")),
    Template("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ("apache",)),
    Template("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", ("governing permissions and limitations under the license",)),
    Template("boost-1", "Distributed under the Boost Software License, Version 1.0.", ("boost software license",)),
    Template("bsd-2", _BSD, ("redistribution and use in source and binary forms",), ("used to endorse or promote", "neither the name")),
    Template("bsd-3", _BSD + " " + _ENDORSE, ("redistribution and use in source and binary forms", "used to endorse or promote")),
    Template("bsd-3", "licensed under the BSD 3-Clause License", ("bsd 3 clause",)),
    Template("bsd-2", "licensed under the BSD 2-Clause License", ("bsd 2 clause",)),
    Template("cc0", "dedicated to the public domain under the CC0 1.0 Universal dedication", ("cc0 1 0",)),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0", ("cc0",)),
    Template("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ("eclipse public license", "2 0")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ("with or without fee is hereby granted", "provided that the above copyright notice")),
    Template("isc", "licensed under the ISC License", ("isc license",)),
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template("mit", _GRANT + " (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ("permission is hereby granted free of charge", "to deal in the software without restriction"), ("in binary form",)),
    Template("mit", _GRANT, ("permission is hereby granted free of charge", "associated documentation files")),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla public license",)),
    Template("mpl-2", "licensed under the Mozilla Public License, version 2.0", ("mozilla public license", "2 0")),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered",)),
    Template("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed", ("verbatim or modified",)),
    Template("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", ("permission is granted to anyone to use this software",)),
    *_gnu(),
    *_creative_commons(),
]
