import re

import pytest

from caselink.llm import licenses
from caselink.llm.licenses import PHRASES, TEMPLATES, compile_template, scan


def brute_base(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


TEXTS = [
    "Released under the MIT License.", "UNDER THE MIT LICENSE under the mit license", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.",
    "under the mit licenses", "", None, "cc by nc cc-by-nc CC BY NC", "This work is licensed under the GNU General Public License, version 3.", "Éunder the mit license", "apache license version 2",
]


def _scan(text):
    pick = {b" " + b" ".join(licenses.words(k)) + b" ": v for k, v in PHRASES.items()}
    return scan(text, pick, [compile_template(k, v) for k, v in TEMPLATES.items()])


@pytest.mark.parametrize("text", TEXTS)
def test_base_equals_brute_force(text):
    assert _scan(text)[:5] == brute_base(text)


def test_templates_accept_optional_and_replaced_words_only():
    label = lambda t: _scan(t)[5].split(",")
    assert "tmpl:apache-2.0-notice" in label("Licensed under the Apache License, Version 2.0.")
    assert "tmpl:apache-2.0-notice" not in label("Licensed under the Apache License, Version 3.0")
    assert "tmpl:gpl-notice" in label("This work is licensed under the GNU General Public License, version 3.")
    for t in ("It is not licensed under the Apache License, Version 2.0.", "never released under the MIT License", "was not yet licensed under CC BY-NC 4.0", "isn't licensed under the GNU General Public License, version 3"):
        assert "tmpl" not in _scan(t)[5], t


#: Complete texts, written out as they stand in files.
MIT = """The MIT License (MIT)

Copyright (c) 2020 Ann Lee and friends

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING
OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_TOP = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or
other materials provided with the distribution."""
BSD_THIRD = "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is
distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT
ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of
this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely,
subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you
use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly
marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""
WHOLE = {"tmpl:mit-text": MIT, "tmpl:isc-text": ISC, "tmpl:bsd-2-text": BSD_TOP + BSD_END, "tmpl:bsd-3-text": BSD_TOP + BSD_THIRD + BSD_END, "tmpl:apache-2.0-header": APACHE, "tmpl:gpl-header": GPL, "tmpl:zlib-text": ZLIB}


@pytest.mark.parametrize("label", WHOLE)
def test_whole_texts_match_word_for_word(label):
    """The text as it stands matches; with any mandatory word changed, dropped or doubled it does not."""
    template = compile_template(label, TEMPLATES[label])
    named = lambda tokens: label in scan(b" ".join(tokens).decode(), {}, [template])[5]
    tokens = licenses.words(WHOLE[label])
    assert named(tokens) and named([b"foo", *tokens, b"bar"])
    others = {x for x in _scan(WHOLE[label])[5].split(",") if x.endswith(("-text", "-header"))}
    assert others == {label}
    # What regions of the template may hold: these words are not mandatory where they stand.
    regions = (
        "the mit license mit copyright c 2020 ann lee and friends", "shall the authors or copyright holders be", "and the author disclaims", "shall the author be", "by the copyright holders and contributors as",
        "shall the copyright holder or contributors be", "of the copyright holder nor", "of its contributors", "met 1 redistributions", "disclaimer 2 redistributions", "distribution 3 neither", "restrictions 1 the", "required 2 altered",
        "software 3 this notice", "this program is", "this file except", "and or distribute this software for", "at http www", "version 3 of", "or at your option any", "version this program is",
    )
    loose: set[int] = set()
    for region in map(licenses.words, regions):
        inner = 0 if region[0] == b"the" else 1
        for i in range(len(tokens) - len(region) + 1):
            if tokens[i : i + len(region)] == region:
                loose |= set(range(i + inner, i + len(region) - inner))
    fixed = [i for i in range(len(tokens)) if i not in loose]
    end = licenses.words(GPL).index(b"details") if label == "tmpl:gpl-header" else len(tokens)
    tried = 0
    for i in fixed:
        if i > end:
            continue
        tried += 1
        assert not named([*tokens[:i], b"zzz", *tokens[i + 1 :]]), (label, i, tokens[i])
        assert not named(tokens[:i] + tokens[i + 1 :]), (label, i, tokens[i])
    assert tried > 0.5 * len(tokens[:end])
    assert not named(tokens[: end - 3]) and not named(tokens[20:])
    middle = [i for i in fixed if i < end and i - 1 in fixed]
    assert all(not named([*tokens[:i], b"not", *tokens[i:]]) for i in middle[:: max(1, len(middle) // 20)])


def test_openings_are_not_the_text():
    isc = ISC[: ISC.index(" THE SOFTWARE")]
    assert "tmpl:isc-text" not in _scan(isc + " You must also pay us 10 percent")[5]
    assert _scan(MIT)[7].split(":")[1:] and _scan(MIT)[6] == 1.0


def test_automaton_equals_regular_expression():
    """Every text over three words, against the template as a pattern."""
    import itertools

    t = compile_template("x", "[[a]] b c {{0-1}} [[a b]] c")
    pattern = re.compile(r"(a )?b c (\w )?(a b )?c ")
    for n in range(2, 7):
        for w in itertools.product("abc", repeat=n):
            text = " ".join(w)
            want = pattern.search(text + " ") is not None
            got = "x" in scan(text, {}, [t])[5]
            assert got == want, text


def test_defined_cases(messy, nothing):
    rows = licenses.scan_licenses(messy).collect()
    assert len(rows) == messy.count()
    assert all(r["score"] == 0.0 and r["labels"] == "" and r["first_word"] is None for r in rows)
    assert licenses.scan_licenses(nothing).count() == 0
