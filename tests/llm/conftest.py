import random

import pytest

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="session")
def rng():
    return random.Random(11)


def sentences(rng, n, letters="abcdefg"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def documents(spark, rng):
    """Texts with copies, near copies, shared lines, odd characters, nulls, repeated rows and columns whose names clash."""
    rows, base = [], sentences(rng, 120)
    shared = "A line that very Many documents hold."
    for i in range(60):
        words = sentences(rng, rng.randint(0, 80)).split()
        text = "\n".join([" ".join(words), shared + " " * (i % 3), "short", "é" * 21]) if i % 4 == 0 else " ".join(words)
        rows.append((i, text))
    for i in range(60, 90):
        words = base.split()
        for _ in range(i % 12):
            words[rng.randrange(len(words))] = sentences(rng, 1)
        rows.append((i, " ".join(words)))
    rows += [(90, base), (91, base), (92, base.upper()), (93, None), (94, ""), (95, " \n\t "), (96, "one two"), (97, "one two"), (98, "One TWO three")]
    rows += [(99, "x\x00y \x01 　 İΣ ΑΣ 12'll don't <|endoftext|> 😀😀  \r\n\x1c a\u0085b"), (100, "word " * 3000), (101, "a" * 5000)]
    rows += [(3, rows[3][1]), (None, "no id but text\n" + shared), (None, None)]
    wide = [(i, t, i if i is None else i % 5, "c", 1.0) for i, t in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, n_lines int, ids string, score double")
