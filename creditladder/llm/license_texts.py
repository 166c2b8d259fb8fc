"""Passages by which licences are known: notices and the opening or telling paragraphs of the public licence texts."""

from __future__ import annotations

from typing import NamedTuple


class Passage(NamedTuple):
    label: str
    text: str
    #: Phrases that must stand in a file word for word, at about their places in the passage.
    phrases: tuple[str, ...]


# Wording of the base phrases.
BASE = (
    Passage("mit", "under the mit license", ("under the mit license",)),
    Passage("apache-2", "apache license version 2", ("apache license version 2",)),
    Passage("cc-by-nc", "cc by nc", ("cc by nc",)),
)

# Wording of the licences.
PASSAGES = (
    Passage(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    Passage(
        "apache-2",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at",
        ("apache license version 2 0", "except in compliance with the license"),
    ),
    Passage("gpl-3", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    Passage("gpl-2", "This work is licensed under the GNU General Public License, version 2", ("gnu general public license version 2",)),
    Passage(
        "gpl-3",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version",
        ("the gnu general public license as published by", "either version 3 of the license"),
    ),
    Passage(
        "gpl-2",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, "
        "or (at your option) any later version",
        ("the gnu general public license as published by", "either version 2 of the license"),
    ),
    Passage(
        "lgpl",
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version",
        ("gnu lesser general public license",),
    ),
    Passage(
        "agpl-3",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3",
        ("gnu affero general public license",),
    ),
    Passage(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met",
        ("redistribution and use in source and binary forms", "are permitted provided that the following conditions are met"),
    ),
    Passage(
        "bsd-3",
        "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior "
        "written permission",
        ("may be used to endorse or promote products derived from this software",),
    ),
    Passage(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies",
        ("distribute this software for any purpose with or without fee", "is hereby granted"),
    ),
    Passage(
        "mpl-2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at",
        ("mozilla public license v 2 0",),
    ),
    Passage(
        "bsl-1",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        "documentation covered by this license",
        ("any person or organization obtaining a copy of the software", "covered by this license"),
    ),
    Passage(
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
        "damages arising from the use of this software",
        ("software is provided as is without any express or implied warranty", "in no event will the authors be held liable"),
    ),
    Passage("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Passage(
        "cc0",
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the "
        "public domain worldwide",
        ("all copyright and related and neighboring rights", "public domain"),
    ),
    Passage("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    Passage("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike",)),
    Passage("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial",)),
)
