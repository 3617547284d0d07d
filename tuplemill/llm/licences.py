"""Public licence statements by family: sentences, notices, titles and the words that name a family."""

from __future__ import annotations

import re

#: What a family is called in sentences, its SPDX identifiers, other titles, public notices, and its names as words.
_CALLED = {
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0"],
    "mit": ["MIT License"],
    "isc": ["ISC License"],
    "bsd": ["BSD License"],
    "bsd-2-clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "bsd-3-clause": ["BSD 3-Clause License", "New BSD License"],
    "gpl": ["GNU General Public License, version 3", "GNU General Public License, version 2", "GPL, version 2 or later"],
    "lgpl": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License, version 3", "LGPL, version 3"],
    "agpl": ["GNU Affero General Public License, version 3", "AGPL, version 3"],
    "gfdl": ["GNU Free Documentation License, version 1.3"],
    "mpl-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, v. 2.0"],
    "epl": ["Eclipse Public License 2.0", "Eclipse Public License v1.0"],
    "eupl": ["European Union Public Licence, version 1.2"],
    "cddl": ["Common Development and Distribution License 1.0"],
    "cpl": ["Common Public License 1.0"],
    "artistic": ["Artistic License 2.0"],
    "boost": ["Boost Software License, Version 1.0"],
    "zlib": ["zlib License"],
    "unlicense": ["Unlicense"],
    "wtfpl": ["WTFPL", "Do What The Fuck You Want To Public License"],
    "ofl": ["SIL Open Font License, Version 1.1"],
    "ncsa": ["University of Illinois/NCSA Open Source License"],
    "postgresql": ["PostgreSQL License"],
    "afl": ["Academic Free License version 3.0"],
    "cc0": ["CC0 1.0 Universal", "CC0 1.0"],
}
_SPDX = {
    "apache-2.0": ["Apache-2.0"],
    "mit": ["MIT"],
    "isc": ["ISC"],
    "bsd-2-clause": ["BSD-2-Clause"],
    "bsd-3-clause": ["BSD-3-Clause"],
    "gpl": ["GPL-3.0-or-later", "GPL-2.0-only"],
    "lgpl": ["LGPL-2.1-only", "LGPL-3.0-or-later"],
    "agpl": ["AGPL-3.0-or-later"],
    "gfdl": ["GFDL-1.3-or-later"],
    "mpl-2.0": ["MPL-2.0"],
    "epl": ["EPL-2.0"],
    "eupl": ["EUPL-1.2"],
    "cddl": ["CDDL-1.0"],
    "cpl": ["CPL-1.0"],
    "artistic": ["Artistic-2.0"],
    "boost": ["BSL-1.0"],
    "zlib": ["Zlib"],
    "unlicense": ["Unlicense"],
    "wtfpl": ["WTFPL"],
    "ofl": ["OFL-1.1"],
    "ncsa": ["NCSA"],
    "postgresql": ["PostgreSQL"],
    "afl": ["AFL-3.0"],
    "cc0": ["CC0-1.0"],
}
_TITLES = {
    "apache-2.0": ["Apache License", "Apache-2.0"],
    "mit": ["The MIT License", "The MIT License (MIT)", "License: MIT"],
    "bsd-2-clause": ["The BSD 2-Clause License"],
    "bsd-3-clause": ["The BSD 3-Clause License"],
    "gpl": ["GNU General Public License"],
    "lgpl": ["GNU Lesser General Public License"],
    "agpl": ["GNU Affero General Public License"],
    "gfdl": ["GNU Free Documentation License"],
    "mpl-2.0": ["Mozilla Public License", "Mozilla Public License, version 2.0"],
    "epl": ["Eclipse Public License"],
    "boost": ["Boost Software License"],
    "ofl": ["SIL Open Font License"],
}
_NOTICES = {
    "apache-2.0": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'],
    "mit": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.'],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "bsd-3-clause": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "gfdl": ["Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."],
    "cpl": ["This program and the accompanying materials are made available under the terms of the Common Public License v1.0."],
    "cddl": ["The contents of this file are subject to the terms of the Common Development and Distribution License."],
    "boost": ["Distributed under the Boost Software License, Version 1.0.", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license."],
    "zlib": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "ofl": ["This Font Software is licensed under the SIL Open Font License, Version 1.1."],
    "ncsa": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal with the Software without restriction.'],
    "postgresql": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted."],
    "cc0": ["Released into the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
}
NAMES = {
    "apache-2.0": ["apache"],
    "mit": ["mit", "associated documentation files", "copy of this software"],
    "isc": ["isc", "this permission notice appear"],
    "bsd": ["bsd", "redistribution and use", "source and binary forms"],
    "bsd-2-clause": ["bsd 2 clause", "2 clause bsd", "simplified bsd"],
    "bsd-3-clause": ["bsd 3 clause", "3 clause bsd", "new bsd", "neither the name of"],
    "gpl": ["gpl", "gplv2", "gplv3", "gnu general public"],
    "lgpl": ["lgpl", "lgplv2", "lgplv3", "lesser general public", "gnu lesser general public", "gnu library general public"],
    "agpl": ["agpl", "agplv3", "affero general public", "gnu affero general public"],
    "gfdl": ["gfdl", "gnu free documentation"],
    "mpl-2.0": ["mpl", "mozilla"],
    "epl": ["epl", "eclipse public"],
    "eupl": ["eupl", "european union public"],
    "cddl": ["cddl", "common development and distribution"],
    "cpl": ["cpl", "common public license"],
    "artistic": ["artistic"],
    "boost": ["boost", "bsl", "accompanying documentation covered"],
    "zlib": ["zlib", "including commercial applications"],
    "unlicense": ["unlicense", "free and unencumbered"],
    "wtfpl": ["wtfpl", "what the fuck you want"],
    "ofl": ["ofl", "open font"],
    "ncsa": ["ncsa", "deal with the software"],
    "postgresql": ["postgresql", "without a written agreement"],
    "afl": ["afl", "academic free"],
    "cc0": ["cc0", "waived all copyright"],
}
#: Creative Commons licences: every family is attribution and what else it asks for.
_COMMONS = {"nc": "NonCommercial", "nd": "NoDerivatives", "sa": "ShareAlike"}
for _asks in ([], ["sa"], ["nc"], ["nd"], ["nc", "sa"], ["nc", "nd"]):
    _code, _long = "-".join(["by", *_asks]), "-".join(["Attribution", *(_COMMONS[x] for x in _asks)])
    _family, _words = f"cc-{_code}", _code.replace("-", " ")
    _CALLED[_family] = [f"CC {_code.upper()} 4.0", f"Creative Commons {_long} 4.0 International License"]
    _SPDX[_family] = [f"CC-{_code.upper()}-4.0"]
    _TITLES[_family] = [f"Creative Commons {_long} 4.0 International", f"{_long} 4.0 International"]
    _spoken = _long.lower().replace("-", " ")
    NAMES[_family] = [f"cc {_words}", f"licenses {_words}"] + [f"{_lead}{_s}" for _lead in ("", "commons ") for _s in {_spoken, _spoken.replace("noncommercial", "non commercial"), _spoken.replace("noderivatives", "noderivs")} if _asks or _lead]
NAMES["cc-by"] += ["attribution 4", "attribution 3"]

#: All statements of a family; those that regard only how it is called come from one rule.
TEMPLATES = {
    family: _NOTICES.get(family, [])
    + [form.format(x if x.startswith("CC") else f"{article} {x}") for x in called for article in ["a" if x.startswith("Creative") else "the"] for form in ("Licensed under {}.", "Released under {}.", "This work is licensed under {}.")]
    + [f"SPDX-License-Identifier: {x}" for x in _SPDX.get(family, [])]
    for family, called in _CALLED.items()
}
#: Lines that are a statement if nothing else stands on them.
TITLES = {family: [x for x in called if len(x.split()) > 1] + _TITLES.get(family, []) for family, called in _CALLED.items()}
#: Sentences that sound alike and are no licence.
LOOKALIKES = [
    "The driver's license was issued in the state last year.",
    "A license is required for fishing in this lake.",
    "All rights reserved.",
    "Copyright by the authors.",
    "The general public was invited to the work of the foundation.",
    "Version 2.0 of the program was released under the direction of the new team.",
    "The permission was granted to any person with a copy of the documents.",
    "He worked under the terms of the contract.",
    "The apache helicopter landed near the base.",
    "Students at MIT built a new machine.",
    "The source of the river is in the mountains.",
    "This work is subject to change without notice.",
]


def tokens(text: str) -> list[str]:
    """Small-letter runs of letters, digits and characters beyond ASCII."""
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())


_NAME_OF = {name: family for family, names in NAMES.items() for name in names}
_ANY_NAME = re.compile(f"(?<= )(?:{'|'.join(sorted(_NAME_OF, key=len, reverse=True))})(?= )")


def named(words: list[str]) -> set[str]:
    """The families that words name; where names start alike the longest counts, so CC BY-NC-ND isn't CC BY-NC, nor is AGPL GPL."""
    return {_NAME_OF[m] for m in _ANY_NAME.findall(f" {' '.join(words)} ")}
