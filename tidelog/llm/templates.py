"""Public license texts and notices, as the license scan looks for them.

Each entry is (label, family, words it cannot do without, text). Labels of one family differ in few words; a block gets
the one of a family that it holds most of. Full licenses are given by their paragraphs.
"""

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_FREE = "This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."

TEMPLATES = (
    ("apache-2.0", "apache", "apache license 2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "apache", "apache license 2", "This project is licensed under the terms of the Apache License 2.0."),
    (
        "apache-2.0", "apache", "apache license",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ),
    (
        "apache-2.0", "apache", "license",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    ("mit", "mit", "mit license", "Released under the MIT License."),
    ("mit", "mit", "mit license", "This project is licensed under the terms of the MIT License."),
    (
        "mit", "mit", "permission granted",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, '
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    ("mit", "mit", "notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "mit", "warranty noninfringement", _WARRANTY),
    ("isc", "isc", "isc license", "Released under the ISC License."),
    ("isc", "isc", "permission hereby granted", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd", "bsd", "bsd license", "Released under the BSD License."),
    ("bsd-2-clause", "bsd", "bsd license 2", "Licensed under the BSD 2-Clause License."),
    ("bsd-3-clause", "bsd", "bsd license 3", "Licensed under the BSD 3-Clause License."),
    ("bsd", "bsd", "redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd", "bsd", "redistributions source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "bsd", "redistributions binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-3-clause", "bsd", "endorse promote", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd", "bsd", "disclaimed contributors", _BSD_WARRANTY),
    ("gpl-2.0", "gnu", "gnu general public license 2", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "gnu", "gnu general public license 3", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl-2.1", "gnu", "gnu lesser public license 2 1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("lgpl-3.0", "gnu", "gnu lesser public license 3", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("agpl-3.0", "gnu", "gnu affero public license 3", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("gpl-2.0", "gnu", "gnu general public license 2", _FREE.format(thing="program", name="General Public License", version="2")),
    ("gpl-3.0", "gnu", "gnu general public license 3", _FREE.format(thing="program", name="General Public License", version="3")),
    ("lgpl-2.1", "gnu", "gnu lesser public license 2 1", _FREE.format(thing="library", name="Lesser General Public License", version="2.1")),
    ("lgpl-3.0", "gnu", "gnu lesser public license 3", _FREE.format(thing="library", name="Lesser General Public License", version="3")),
    ("agpl-3.0", "gnu", "gnu affero public license 3", _FREE.format(thing="program", name="Affero General Public License", version="3")),
    (
        "mpl-2.0", "mpl", "mozilla public license",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("mpl-2.0", "mpl", "mozilla public license", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "unlicense", "public domain", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "zlib", "misrepresented", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
    ("bsl-1.0", "bsl", "boost", "Distributed under the Boost Software License, Version 1.0."),
    ("cc0-1.0", "cc", "cc0", "Licensed under CC0 1.0 Universal, public domain dedication."),
    ("cc-by-4.0", "cc", "cc by 4", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "cc", "cc by sa 4", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "cc", "cc by nc 4", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nd-4.0", "cc", "cc by nd 4", "Licensed under CC BY-ND 4.0."),
    ("cc-by-nc-sa-4.0", "cc", "cc by nc sa 4", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-nc-nd-4.0", "cc", "cc by nc nd 4", "Licensed under CC BY-NC-ND 4.0."),
    ("cc-by-4.0", "cc", "creative commons attribution 4", "Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "cc", "creative commons attribution sharealike 4", "Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc-4.0", "cc", "creative commons attribution noncommercial 4", "Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nd-4.0", "cc", "creative commons attribution noderivatives 4", "Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc-by-nc-sa-4.0", "cc", "creative commons attribution noncommercial sharealike 4", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("cc-by-nc-nd-4.0", "cc", "creative commons attribution noncommercial noderivatives 4", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
)
