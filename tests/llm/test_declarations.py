import itertools

import pytest

from textloom.llm import declarations, licenses
from textloom.llm.license_texts import TEMPLATES


def found(text):
    out = licenses._kernel(*licenses.kernels.buffers(licenses._column([text])))[0][0]
    return [x["license"] for x in out]


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("SPDX-License-Identifier: MIT", ["MIT"]),
        ("// spdx-license-identifier: Apache-2.0 OR MIT", ["Apache-2.0", "MIT"]),
        ("/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) AND (MIT OR BSD-3-Clause) */", ["BSD-3-Clause", "GPL-2.0", "MIT"]),
        ("# SPDX-License-Identifier: GPL-3.0-or-later -->", ["GPL-3.0"]),
        ("SPDX-License-Identifier: Artistic-2.0", ["Artistic-2.0"]),
        ("SPDX-License-Identifier: MIT AND", ["MIT"]),
        ("SPDX-License-Identifier: OR MIT", []),
        ("SPDX-License-Identifier: (MIT", []),
        ("SPDX-License-Identifier:", []),
        ("Licensed under the MIT license and the Apache License, Version 2.0.", ["Apache-2.0", "MIT"]),
        ("Licensed under the Apache License, Version 2.0 and the MIT license.", ["Apache-2.0", "MIT"]),
        ("Dual licensed under MIT or Apache-2.0.", ["Apache-2.0", "MIT"]),
        ("Licensed under either of MIT, ISC, or BSD-3-Clause at your option", ["BSD-3-Clause", "ISC", "MIT"]),
        ("Licensed under the Apache-2.0 license", ["Apache-2.0"]),
        ("available under MIT/Apache-2.0", ["Apache-2.0", "MIT"]),
        ("Code is MIT-licensed.", ["MIT"]),
        ("This is not licensed under MIT.", []),
        ("no longer MIT-licensed", []),
        ("licensed under an MIT-style license", []),
        ("licensed under MIT-style terms", []),
        ("The club is licensed under local law. MIT is a school.", []),
        ("Released under the MIT License.", ["MIT"]),
    ],
)
def test_declared(text, names):
    assert sorted(found(text)) == names
    assert sorted(found(f"some words before\n{text}\nand more after it")) == names


def test_every_name_alone_and_in_pairs():
    known = [t.name for t in TEMPLATES if t.name != "All-Rights-Reserved"]
    for name in known:
        assert found(f"SPDX-License-Identifier: {name}") == [name]
    for a, b in itertools.pairwise(known):
        assert declarations.expression(f"{a} OR ({b})") == [a, b]
        assert declarations.listed(f" {a} or {b}.") == [a, b]


def expressions(depth):
    """Expressions with what they name, by the grammar."""
    yield "MIT", ["MIT"]
    yield "GPL-2.0+", ["GPL-2.0"]
    if depth:
        for (a, x), (b, y) in itertools.product(list(expressions(depth - 1))[:6], repeat=2):
            yield f"{a} AND {b}", x + y
            yield f"({a} OR {b})", x + y
            yield f"{a} WITH x-exception" if " " not in a else f"({a})", x


def test_expressions_by_the_grammar():
    for text, names in expressions(2):
        assert declarations.expression(text) == names
        assert declarations.expression(text + "  */") == names
        assert declarations.expression(text + " AND") == names
