"""Small tables with the odd cases every operator has to stand."""

import random
import zlib

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + str(draw.randrange(40)) for _ in range(n))


def documents() -> list[tuple]:
    """Copies, near copies, shared passages, repeated lines, null and empty values, a very long text, repeated rows."""
    rows, base = [], prose(1, 180)
    for k in range(6):
        words = base.split()
        for j in range(k):
            words[(37 * j + 11 * k) % len(words)] = f"edit{k}x{j}"
        rows.append((k, " ".join(words)))
    rows += [(k, prose(50 + k, 20 + 15 * k) + "\n" + prose(7, 70) + "\nshared foot line\n" + prose(90 + k, 30)) for k in range(6, 14)]
    rows += [(14, base), (15, base), (16, None), (17, ""), (18, " \t\n"), (19, "one two three"), (20, "One TWO three"), (21, "a b c d e"), (22, "ünï cödé ßtr 日本 語 " * 12)]
    rows += [(23, "same line\n" * 40), (24, "### $$$ %%% ||| <> & *" * 20), (25, prose(3, 6000)), (26, "x" * 3000), (26, "x" * 3000), (None, "no id here " + prose(8, 60)), (27, prose(3, 300) + " " + prose(3, 300))]
    out = []
    for k, (i, text) in enumerate(rows):
        out.append((i, text, None if k % 9 == 0 else "en", None if k % 11 == 0 else ("hot" if k % 3 == 0 else f"s{k % 12}"), None if text is None else len(text)))
    return out


def held_out(i) -> bool:
    return zlib.crc32(str(i).encode()) % 4 == 2
