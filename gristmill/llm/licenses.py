"""Licence scan by canonical digest: whole texts are normalised, hashed and joined to known licences. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Known licence texts and notices.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.

You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0 (line)": "Licensed under the Apache License, Version 2.0.",
    "MIT (line)": "Released under the MIT License.",
    "GPL-3.0 (line)": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 (line)": "Licensed under CC BY-NC 4.0.",
}

#: Equivalent spellings, after lower-casing and removal of punctuation.
SPELLINGS = {"licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "sub license": "sublicense", "non commercial": "noncommercial", "non infringement": "noninfringement", "copyright holder": "copyright owner", "copyright holders": "copyright owners", "acknowledgement": "acknowledgment", "organisation": "organization", "recognise": "recognize", "favour": "favor", "https": "http", "merchantibility": "merchantability", "redistribution s": "redistributions"}

#: Whole lines that name a holder with a year or sign, or only title a licence, are no part of its text.
_NO_WORD = r"[^\p{L}\p{N}\n]*"
_COPYRIGHT = rf"(?m)^{_NO_WORD}(copyright{_NO_WORD}(\(c\)|©|[0-9]{{4}}|<year>|\[yyyy\])|\(c\){_NO_WORD}(copyright\b|[0-9]{{4}})|©|all rights reserved|spdx-license-identifier)[^\n]*$"
_NAMED = r"(the )?[a-z0-9.-]{2,12}( [0-9]-clause)? licen[cs]e"
_TITLE = rf"(?m)^{_NO_WORD}{_NAMED}({_NO_WORD}\([a-z0-9 .-]{{2,20}}\))?{_NO_WORD}$"
#: Numbers, letters and bullets of lists.
_MARKER = r"(?m)^[^\p{L}\p{N}\n]*\(?([0-9]{1,2}|[a-z])[.)][ \t]+"
#: How the head of a licence begins, before its opening words; other texts that quote a licence at their end aren't one.
_HEAD = rf"\A[^\p{{L}}\p{{N}}©]*(©|copyright|c\)|{_NAMED})"
#: Words that a text must have for its opening to be looked for, and characters of a head's line at most.
_WHOLE, _LINE = 25, 160


def opening(texts: dict[str, str]) -> str:
    """A pattern of the first four words of every known text that is no mere line."""
    split = lambda t: "".join(c if c.isalnum() else " " for c in t.lower()).split()
    first = sorted({tuple(w[:4]) for w in map(split, texts.values()) if len(w) >= _WHOLE})
    return "|".join(r"[^\p{L}\p{N}]+".join(w) for w in first) or r"\A\b\B"


def without_head(text: Column, texts: dict[str, str]) -> Column:
    """A lower-case text from its licence's opening words on, where what is ahead of them reads as a head: it begins with a
    title or a copyright, and has no line of prose. Holders may go on over any number of lines."""
    at = F.regexp_instr(text, F.lit(opening(texts)))
    head = F.substring(text, F.lit(1), at - 1)
    strip = (at > 1) & F.rlike(head, F.lit(_HEAD)) & ~F.rlike(head, F.lit(rf"[^\n]{{{_LINE + 1}}}"))
    return F.when(strip, F.substring(text, at, F.char_length(text))).otherwise(text)


def canonical(text: Column, texts: dict[str, str] | None = None) -> Column:
    """Lower case, without head, copyright and title lines, marks of lists and punctuation, words one space apart, in one spelling; null is empty."""
    out = without_head(F.lower(F.coalesce(text, F.lit(""))), KNOWN if texts is None else texts)
    for pattern in (_COPYRIGHT, _TITLE, _MARKER):
        out = F.regexp_replace(out, pattern, "")
    # two spaces between words, so that each word of a row of equal ones has spaces of its own to match
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", "  ")), F.lit(" "))
    for a, b in sorted(SPELLINGS.items(), key=lambda x: " " in x[0]):  # words first, then phrases
        out = F.replace(out, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b.replace(' ', '  ')} "))
    return F.replace(F.trim(out), F.lit("  "), F.lit(" "))


def known(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """license, digest of each known text; one name for each digest, the first by name."""
    rows = spark.createDataFrame(list((KNOWN if texts is None else texts).items()), "license string, text string")
    rows = rows.select("license", F.sha2(canonical(F.col("text"), texts), 256).alias("digest"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def license_scan(docs: DataFrame, texts: dict[str, str] | None = None, most: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, digest, license (null if the whole text is no known licence).

    Texts without a word have no licence; very long texts are read whole. Ids keep their type, other columns are not
    looked at. Repeated rows each have a row; an empty table gives no rows. The known
    digests are broadcast up to `most` of them, which is checked; beyond, the join is shuffled on the digest, in which
    only texts of one licence share a key.
    """
    n = len(KNOWN if texts is None else texts)
    side = known(docs.sparkSession, texts)
    text = canonical(F.col(text_col), texts)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("_gm_text"))
    rows = rows.select("doc_id", F.sha2("_gm_text", 256).alias("digest"), (F.col("_gm_text") != "").alias("_gm_any"))
    out = rows.join(F.broadcast(side) if n <= most else side, "digest", "left")
    return out.select("doc_id", "digest", F.when(F.col("_gm_any"), F.col("license")).alias("license"))
