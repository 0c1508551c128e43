"""Notices and whole texts of well-known public licenses, as published.

Of each: its label, patterns that a span must hold, patterns that make another license
of it. Words are lower-case and without punctuation, one space between them.
"""

from __future__ import annotations

WARRANTY_OF_BSD = """
this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to
the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or
contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of
substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in
contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the
possibility of such damage
"""

CONDITIONS_OF_BSD = """
redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the
documentation and or other materials provided with the distribution
"""

NOTICE_OF_GNU = """
is free software you can redistribute it and or modify it under the terms of the gnu {name} public license as published by the free software
foundation either version {version} of the license or at your option any later version this program is distributed in the hope that it will be
useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {name}
public license for more details
"""

BODIES = (
    (
        "mit",
        """
        permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to
        deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or
        sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as
        is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular
        purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an
        action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software
        """,
        ("without restriction", "sublicense"),
        (),
    ),
    (
        "isc",
        """
        permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above
        copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with
        regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special
        direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract
        negligence or other tortious action arising out of or in connection with the use or performance of this software
        """,
        ("with or without fee", "copyright notice"),
        (),
    ),
    ("bsd-2-clause", CONDITIONS_OF_BSD + WARRANTY_OF_BSD, ("reproduce the above",), ("neither the name", "endorse or promote", "advertising materials")),
    (
        "bsd-3-clause",
        CONDITIONS_OF_BSD
        + """
        3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
        without specific prior written permission
        """
        + WARRANTY_OF_BSD,
        ("endorse or promote",),
        ("advertising materials",),
    ),
    (
        "apache-2.0",
        """
        licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of
        the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the
        license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific
        language governing permissions and limitations under the license
        """,
        ("apache license version 2",),
        ("apache license version 2 [1-9]",),
    ),
    ("gpl-3.0", NOTICE_OF_GNU.format(name="general", version=3), ("version 3",), ("lesser", "library general", "affero")),
    ("gpl-2.0", NOTICE_OF_GNU.format(name="general", version=2), ("version 2",), ("lesser", "library general", "affero", "version 2 1")),
    ("lgpl-3.0", NOTICE_OF_GNU.format(name="lesser general", version=3), ("lesser", "version 3"), ("affero",)),
    ("lgpl-2.1", NOTICE_OF_GNU.format(name="lesser general", version="2 1"), ("lesser", "version 2 1"), ("affero",)),
    ("agpl-3.0", NOTICE_OF_GNU.format(name="affero general", version=3), ("affero", "version 3"), ()),
    (
        "zlib",
        """
        this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from
        the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and
        redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you
        wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not
        required altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be
        removed or altered from any source distribution
        """,
        ("misrepresented",),
        (),
    ),
    (
        "bsl-1.0",
        """
        permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by
        this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to
        permit third parties to whom the software is furnished to do so all subject to the following
        """,
        ("person or organization",),
        (),
    ),
    (
        "unlicense",
        """
        this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this
        software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means
        """,
        ("unencumbered",),
        (),
    ),
)
