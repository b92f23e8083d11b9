import pytest

from tests.llm import fixtures
from textloom.llm import licenses
from textloom.llm.license_texts import TEMPLATES


def names(text):
    return [n for _, _, b in licenses.blocks_of(text.encode()) for n, *_ in licenses.judged(b)]


@pytest.mark.parametrize(
    ("line", "name"),
    [("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("Released under the MIT License.", "MIT"), ("All rights reserved.", "All-Rights-Reserved"), ("licensed under cc by 4.0", "CC-BY-4.0"), ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0")],
)
def test_notices(line, name):
    assert names(f"Some text.\n{line}\nMore of it.") == [name]


@pytest.mark.parametrize("template", TEMPLATES, ids=lambda t: t.name)
def test_whole_texts_win_their_own_template(template):
    assert names("Copyright (c) 2020 A. Author\n\n" + template.text)[0] == template.name


@pytest.mark.parametrize("line", ["A fishing license is a permission to fish.", "He had the rights of a citizen and no warrant.", "Copyright matters.", ""])
def test_other_uses_of_the_words(line):
    assert names(line) == []


def test_two_licenses_and_line_breaks():
    text = "Released under the\nMIT License.\n\n\n\n\nLicensed under the Apache License, Version 2.0."
    assert names(text) == ["MIT", "Apache-2.0"]
    assert names("Released under the MIT License.\nLicensed under CC BY-NC 4.0.") in (["MIT", "CC-BY-NC-4.0"], ["CC-BY-NC-4.0", "MIT"])


def test_savings_are_those_of_a_plain_computation():
    import zstandard

    block = b"permission is hereby granted free of charge to any person obtaining a copy"
    frame = licenses._FRAME
    alone = len(zstandard.ZstdCompressor(level=licenses.LEVEL, **frame).compress(block))
    got = dict((k, s) for s, k in licenses.savings(block))
    for k, t in enumerate(TEMPLATES):
        known = zstandard.ZstdCompressionDict(" ".join(licenses.words_of(t.text)).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        assert abs(got[k] - (1 - len(zstandard.ZstdCompressor(level=licenses.LEVEL, dict_data=known, **frame).compress(block)) / alone)) < 0.1
    assert max(got, key=got.get) == 0


def test_scan(spark):
    rows = [*fixtures.documents(), (900, "a\nReleased under the MIT License.\nb", None, None, 1), (900, "a\nReleased under the MIT License.\nb", None, None, 1)]
    out = licenses.scan(spark.createDataFrame(rows, fixtures.DOCS), ["doc_id"]).collect()
    assert len(out) == len(rows)
    found = [(r.row.doc_id, [(b.first_line, b.last_line, b.license) for b in r.blocks]) for r in out if r.blocks]
    assert found == [(900, [(1, 1, "MIT")])] * 2
    assert licenses.scan(spark.createDataFrame([], fixtures.DOCS)).count() == 0


@pytest.mark.parametrize("n", [0, 30, 100, 2000])
@pytest.mark.parametrize(("notice", "name"), [("Released under the MIT License.", "MIT"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("All rights reserved.", "All-Rights-Reserved"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0")])
def test_notices_in_long_lines(n, notice, name):
    assert names(f"{fixtures.prose(n, n)} {notice}") == [name]
    assert names(f"{fixtures.prose(n, n)} {notice} {fixtures.prose(n + 1, n)}") == [name]


def test_every_template_with_a_key_is_judged():
    gpl = "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability"
    assert "All-Rights-Reserved" in names(f"All rights reserved. {gpl}")


def wrapped(text, mark, width=60):
    import textwrap

    return "\n".join(mark + x for x in textwrap.wrap(text, width))


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", ";; "])
@pytest.mark.parametrize("template", [t for t in TEMPLATES if len(t.forms[-1]) > 200], ids=lambda t: t.name)
def test_wrapped_and_commented_texts(template, mark):
    """The longest form of each license, as a file's header with a copyright line, is one license and whole."""
    text = mark + "Copyright (c) 2020 A. Author\n" + mark.strip() + "\n" + wrapped(template.forms[-1], mark)
    blocks = licenses.blocks_of((text + "\n\nint main(void) { return 0; }").encode())
    assert [n for *_, b in blocks for n, *_ in licenses.judged(b)] == [template.name]
    (block,) = blocks
    assert block[0] <= 2 and block[1] >= text.count("\n") - 1 and licenses.judged(block[2])[0][2] == 0


@pytest.mark.parametrize("line", ["This file is not released under the MIT License.", "It was never licensed under the Apache License, Version 2.0.", "All rights reserved seats were sold.", "No license is granted, and the software is provided for review."])
def test_statements_that_license_nothing(line):
    assert names(line) == []


def test_versions_and_clauses_differ_by_a_word():
    text = next(t for t in TEMPLATES if t.name == "GPL-3.0").forms[-1]
    assert names(text.replace("version 3", "version 2")) == ["GPL-2.0"] and names(text.replace("version 3", "version 7")) == []
    three = next(t for t in TEMPLATES if t.name == "BSD-3-Clause").forms[-1]
    assert names(three.replace("the copyright holder nor", "the Example Company Limited nor")) == ["BSD-3-Clause"]
    assert names(three[: three.index("3. Neither")] + three[three.index("THIS SOFTWARE") :]) == ["BSD-2-Clause"]


def brute(text):
    """Every template against every place of the words, by plain comparison of short forms."""
    words, found = licenses.words_of(text), set()
    for t in TEMPLATES:
        for form in t.forms:
            own = licenses.words_of(form)
            if 4 <= len(own) <= licenses.SHORT:
                found |= {t.name for k in range(len(words) - len(own) + 1) if words[k : k + len(own)] == own and not licenses.NEGATIONS & set(words[max(0, k - 3) : k])}
    return found


def test_short_forms_against_brute_force():
    import random

    draw = random.Random(5)
    short = [f for t in TEMPLATES for f in t.forms if 4 <= len(licenses.words_of(f)) <= licenses.SHORT]
    for k in range(300):
        parts = [draw.choice([draw.choice(short), fixtures.prose(k, draw.randrange(1, 40)), "not", "the license of", "under the terms"]) for _ in range(draw.randrange(1, 8))]
        text = draw.choice([" ", "\n", " # "]).join(parts)
        assert set(names(text)) == brute(text), text


def test_long_and_odd_texts(spark):
    """A text full of notices, one of many short lines, bytes beyond ASCII, clashing columns: whole, and in bounded time."""
    full = " ".join(f for t in TEMPLATES for f in t.forms)
    texts = ["\n".join([full] * 3), "All rights reserved.\n" * 3000, "Äpfel under the " * 3000, fixtures.prose(2, 4000) + " Released under the MIT License. Ende ß", None, ""]
    rows = [(k, t, "blocks", "row", 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, fixtures.DOCS).withColumnRenamed("lang", "blocks").withColumnRenamed("source", "row")
    got = {r.row.doc_id: {b.license for b in r.blocks} for r in licenses.scan(docs).collect()}
    assert got[0] == {t.name for t in TEMPLATES} and got[1] == {"All-Rights-Reserved"} and got[3] == {"MIT"} and got[2] == got[4] == got[5] == set()
