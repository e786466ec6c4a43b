"""Small tables with nulls, empty and long texts, repeated rows, and extra columns named like outputs."""

import random

SYLLABLES = ["ba", "ko", "ri", "tes", "mun", "é", "zu", "lo", "wan", "pi", "ß", "Sa", "ter"]


def prose(rng, n):
    out = []
    for _ in range(n):
        out.append("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))))
        if rng.random() < 0.08:
            out[-1] += "."
        if rng.random() < 0.04:
            out[-1] += "\n"
    return " ".join(out)


def texts(seed=1, n=60):
    """(id, text): prose, near and exact copies, shared lines, odd texts; ids ascend from 0."""
    rng = random.Random(seed)
    shared = [prose(rng, 9).replace("\n", " ") for _ in range(3)]
    rows = []
    for i in range(n):
        lines = [prose(rng, rng.randint(3, 60)) for _ in range(rng.randint(1, 4))]
        if i % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), "  " + shared[i % len(shared)].upper() + "\t\r" if i % 2 else shared[i % len(shared)])
        rows.append("\n".join(lines))
    for i in range(0, n, 4):  # near copies: one word in each of them changed
        w = rows[i].split(" ")
        w[rng.randrange(len(w))] = "changed"
        rows.append(" ".join(w))
    rows += [rows[5]] * 7 + [None, "", " ", "\n\n", "\t \r\n x", "One", "one", "ONE two", "x" * 5000, ("Long text " * 3 + prose(rng, 200) + " ") * 40,
                             "a  b   c    d　e", "it's we'll I'M 12 345 ... !!! <|endoftext|> \U0001f600 İ", "\x1c\x1d \x85 a \x1f b"]
    return list(enumerate(rows))
