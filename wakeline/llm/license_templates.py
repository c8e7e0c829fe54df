"""License wordings as templates, in the markup that ``license_scan`` compiles.

Plain words are mandatory. ``<<beginOptional>> ... <<endOptional>>`` may be left out, and may nest.
``<<var;words=0-12>>`` stands for any words, as many as it says. Case and punctuation do not count.
"""

#: The phrases and labels every scan looks for.
BASE = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)

#: Short statements that name a license and its version.
NOTICES = (
    ("gpl-2.0", "gnu general public license <<beginOptional>>as published by the free software foundation"
                " <<beginOptional>>either<<endOptional>><<endOptional>> version 2"),
    ("gpl-3.0", "gnu general public license <<beginOptional>>as published by the free software foundation"
                " <<beginOptional>>either<<endOptional>><<endOptional>> version 3"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("apache-2.0", "apache license <<beginOptional>>version<<endOptional>> 2 0"),
    ("cc-by-4.0", "cc by 4 0"),
    ("cc-by-nc", "cc by nc"),
    ("cc-by-nc-4.0", "cc by nc 4 0"),
    ("cc-by-sa", "cc by <<beginOptional>>nc<<endOptional>> sa"),
    ("cc-by-nd", "cc by <<beginOptional>>nc<<endOptional>> nd"),
    ("creative-commons", "creative commons attribution <<var;words=0-4>> license"),
    ("mit-notice", "<<beginOptional>>released<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> mit license"),
)

#: Whole license texts and file headers.
TEXTS = (
    ("mit-text", """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction,
        including without limitation the rights to use, copy, modify, merge, publish, distribute,
        sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
        furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice <<beginOptional>>(including the next
        paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
        NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        NONINFRINGEMENT. IN NO EVENT SHALL <<var;words=1-20>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", """
        Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for
        any purpose with or without fee is hereby granted, provided that the above copyright notice and this
        permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND <<var;words=1-20>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
        SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""),
    ("bsd", """
        Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met:
        <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer.
        <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution.
        <<beginOptional>><<beginOptional>>3.<<endOptional>> Neither the name of <<var;words=1-20>> nor the
        names of its contributors may be used to endorse or promote products derived from this software
        without specific prior written permission.<<endOptional>>
        THIS SOFTWARE IS PROVIDED BY <<var;words=1-20>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
        PURPOSE ARE DISCLAIMED."""),
    ("apache-header", """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at <<var;words=1-12>> Unless required
        by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS"""),
    ("gpl-header", """
        is free software<<beginOptional>>: you can<<endOptional>> redistribute it and/or modify it under the
        terms of the GNU <<beginOptional>>Lesser<<endOptional>> <<beginOptional>>Affero<<endOptional>> General
        Public License as published by the Free Software Foundation"""),
)
